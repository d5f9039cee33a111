"""URL filter: host and path rules first, then a weighted vocabulary counted by an Aho-Corasick automaton.

``rules``: (host, path, verdict). A rule fits its host and all subdomains if the url's path starts with the
rule's; of several the longest wins. Urls that no rule fits are judged by their terms: a term counts where no
letter or digit touches it; one strict term blocks, and so do ``soft_hits`` distinct soft ones.

Nulls and empties: a null url, or one without ``://``, has an empty host and path, no rule fits it, and its
terms are looked for in the whole text (none in null, so it is allowed). Rows with equal ids are judged one by
one. An empty table gives an empty result. Other columns are ignored. A very long url is read once from end to end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from loomcast.shipping import shipped

# Terms of the vocabulary (lower case).
STRICT = ("casino", "escort", "hentai", "phishing", "porn", "viagra", "warez", "xxx")
SOFT = ("adult", "bet", "bets", "bonus", "cheap", "crack", "deal", "free", "jackpot", "keygen", "loan", "lottery",
        "pills", "poker", "sexy", "torrent", "win", "winner")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits as a struct (rule, verdict), null if none does."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    # a later `when` stands above the earlier ones, so the longest come last
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


class Terms:
    """Counts of strict and distinct soft terms that stand alone in a text."""

    def __init__(self, strict: Sequence[str], soft: Sequence[str]):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for kind, terms in (("soft", soft), ("strict", strict)):
            for t in terms:
                self.find.add_word(t.lower(), (kind, t.lower()))
        self.find.make_automaton()

    def count(self, text: str) -> tuple[int, int]:
        low = text.lower()
        strict, soft = 0, set()
        for end, (kind, term) in self.find.iter(low):
            start = end + 1 - len(term)
            if (start and low[start - 1].isalnum()) or (end + 1 < len(low) and low[end + 1].isalnum()):
                continue
            if kind == "strict":
                strict += 1
            else:
                soft.add(term)
        return strict, len(soft)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], strict: Sequence[str] = STRICT,
          soft: Sequence[str] = SOFT, soft_hits: int = 2, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), and the counts of strict and distinct soft terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(strict, soft)
        for batch in batches:
            counts = [terms.count(u) if u else (0, 0) for u in batch.column("url").to_pylist()]
            keep = [n for n in batch.schema.names if n != "url"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in keep), pa.array([c[0] for c in counts], pa.int64()),
                 pa.array([c[1] for c in counts], pa.int64())], [*keep, "strict_hits", "soft_hits"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)) \
        .select("page_id", "url", "host", "path", F.col("fit")["rule"].alias("rule"), F.col("fit")["verdict"].alias("ruled"))
    counted = rows.transform(shipped).mapInArrow(run, "page_id long, host string, path string, rule string, ruled string, "
                                   "strict_hits long, soft_hits long")
    own = F.when((F.col("strict_hits") > 0) | (F.col("soft_hits") >= soft_hits), "block").otherwise("allow")
    return counted.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"),
                          "strict_hits", "soft_hits")

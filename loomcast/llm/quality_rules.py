"""Line-first cleaning of documents. DataFrame functions only.

Every line is judged on its own: too many symbols or shouting punctuation, navigation (many separators, few
words between them), boilerplate (fixed phrases of licences, cookies, scripts: one for every 15 words at least, so
that prose which names a cookie stays), and whether an earlier line is the same. Failing lines go; a document that loses too large a part of its word characters is rejected, as
is one that fails the base rule (too few words, or too many words in repeated windows).

Nulls and empties: a null text has no words and is rejected by the base rule, so is an empty text. Rows with
equal ids are judged one by one. An empty table gives an empty result. Working columns have names that
the input does not have, so extra columns cannot clash. Windows are compared by 64-bit hashes. A very long text is
one row's work and needs memory for its words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loomcast.llm.storage import fresh

GAP = r"[\x20\x09-\x0D]+"

# Phrases that mark boilerplate lines (lower case).
BOILERPLATE = ("all rights reserved", "copyright", "cookie", "creative commons", "javascript", "licensed under",
               "lorem ipsum", "privacy policy", "spdx-license-identifier", "terms of service", "terms of use")


@dataclass(frozen=True)
class Rules:
    """Thresholds, in parts of a hundred where they are shares."""

    min_words: int = 20
    max_repeat: int = 30  # words in windows that occur twice, of all words
    window: int = 8
    max_line_symbols: int = 40  # symbols per 100 words of a line
    max_line_shouts: int = 40  # words that end in !! or ??, per 100 words of a line
    boilerplate_words: int = 15  # a line of at most so many words per phrase in it is boilerplate
    min_separators: int = 3  # of a navigation line, and one for at most four words
    max_lost: int = 60  # word characters of failed lines, per 100 of all lines


SYMBOLS = "#*$%&|<>"
BULLETS = (" | ", " > ", " • ", " · ", " » ")


def _count(text: Column, part: str) -> Column:
    """How often ``part`` occurs; cheap where it does not."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def _any(text: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def _line_fails(line: Column, rules: Rules) -> Column:
    """The rules for one line that has a word."""
    n = F.size(F.split(F.trim(line), GAP))
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS.replace("|", ""), ""))
    shouts = F.regexp_count(line, F.lit(r"[!?]{2}(?=[\x20\x09-\x0D]|$)"))
    separators = sum((_count(line, p) for p in BULLETS[1:]), _count(line, BULLETS[0]))
    return (symbols * 100 > n * rules.max_line_symbols) | (shouts * 100 > n * rules.max_line_shouts) \
        | ((separators >= rules.min_separators) & (separators * 4 >= n)) \
        | (F.regexp_count(F.lower(line), F.lit("|".join(BOILERPLATE))) * rules.boilerplate_words >= n)


def _letters(text: Column) -> Column:
    """Code points outside white space."""
    return F.length(F.regexp_replace(text, GAP, ""))


def judged(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> tuple[DataFrame, dict[str, str]]:
    """The input with columns for n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars,
    base_failed, kept and the cleaned text, and the names these columns have."""
    k = rules.window
    names = {f: fresh(docs, f"_judged_{f}") for f in
             ("text", "words", "lines", "distinct_lines", "windows", "clean", "found", "suspect", "n_words", "word_chars",
              "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept", "cleaned")}
    at = lambda f: F.col(names[f])

    def step(df: DataFrame, drop: tuple = (), **fields: Column) -> DataFrame:
        """More columns; each step is a projection of its own, so no expensive value is computed twice."""
        return df.withColumns({names[f]: c for f, c in fields.items()}).drop(*[names[f] for f in drop])

    df = step(docs, text=F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    df = step(df, words=F.filter(F.split(at("text"), GAP), lambda w: w != ""),
              lines=F.filter(F.split(at("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = step(df, windows=F.transform(at("words"), lambda w: F.xxhash64(w)), n_words=F.size(at("words")).cast("long"),
              word_chars=F.length(F.array_join(at("words"), "")).cast("long"),
              n_symbols=sum((_count(at("text"), c) for c in SYMBOLS[1:]), _count(at("text"), SYMBOLS[0])),
              distinct_lines=F.array_distinct(at("lines")))
    # a text without any of the marks that the line rules look for has no failing line
    df = step(df, drop=("words",), suspect=(at("n_symbols") > 0) | _any(at("text"), ("!!", "??", "!?", "?!", *BULLETS))
              | _any(F.lower(at("text")), BOILERPLATE))
    # hashes of 2, 4, ... words from those of half as many; a window that is no power of two takes a shorter last step
    width = 1
    while width < k:
        more = min(width, k - width)
        df = step(df, windows=F.transform(at("windows"), lambda h, i: F.xxhash64(h, F.get(at("windows"), i + more))))
        width += more
    df = step(df, windows=F.slice(at("windows"), F.lit(1), F.greatest(at("n_words").cast("int") - (k - 1), F.lit(0))),
              clean=F.when(at("suspect"), F.filter(at("distinct_lines"), lambda x: ~_line_fails(x, rules)))
              .otherwise(at("distinct_lines")))
    # windows in order of their hash; only documents with a repeat are sorted
    repeats = F.size(F.array_distinct(at("windows"))) < F.size(at("windows"))
    df = step(df, windows=F.when(repeats, F.array_sort(F.transform(at("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda a, b: F.coalesce(F.get(at("windows"), a)["h"] == F.get(at("windows"), b)["h"], F.lit(False))
    df = step(df, drop=("windows",), found=F.array_sort(F.transform(
        F.filter(at("windows"), lambda x, i: same(i, i - 1) | same(i, i + 1)), lambda x: x["i"])))
    # each window covers k words, less where the next begins before its end
    covered = F.transform(at("found"), lambda p, i: F.least(F.lit(k), F.coalesce(F.get(at("found"), i + 1) - p, F.lit(k))))
    df = step(df, drop=("found",), cleaned=F.array_join(at("clean"), "\n"),
              n_repeat_words=F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
              n_dup_lines=(F.size(at("lines")) - F.size(at("distinct_lines"))).cast("long"))
    whole = F.size(at("clean")) == F.size(at("lines"))
    df = step(df, drop=("lines", "distinct_lines", "clean", "text", "suspect"),
              lost_chars=F.when(whole, F.lit(0)).otherwise(at("word_chars") - _letters(at("cleaned"))).cast("long"),
              base_failed=(at("n_words") < rules.min_words) | (at("n_repeat_words") * 100 > at("n_words") * rules.max_repeat))
    return step(df, kept=~at("base_failed") & (at("lost_chars") * 100 <= at("word_chars") * rules.max_lost)), names


def _only_kept(df: DataFrame, kept: str) -> DataFrame:
    """Rows to keep. A filter on the verdict alone would be moved below the steps, where every value it needs
    is written out once per use; a condition that is not deterministic stays where it is."""
    place = fresh(df, "_place")
    return df.withColumn(place, F.spark_partition_id()).filter(F.col(kept) & (F.col(place) >= 0)).drop(place)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """doc_id and the figures and verdict of every row."""
    df, name = judged(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), rules=rules)
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept"]
    return df.select("doc_id", *[F.col(name[f]).alias(f) for f in fields])


def clean(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Kept documents with all their columns, the text without its failed lines."""
    df, name = judged(docs, text_col, rules)
    return _only_kept(df, name["kept"]).withColumn(text_col, F.col(name["cleaned"])).select(docs.columns)


def kept_documents(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Kept documents as they are."""
    df, name = judged(docs, text_col, rules)
    return _only_kept(df, name["kept"]).select(docs.columns)

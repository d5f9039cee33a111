"""Small tables with the awkward rows that every operator must take, and plain versions of the methods."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    out = []
    for i in range(words):
        w = "".join(r.choice(["th", "er", "an", "on", "re", "é", "ou", "st"]) for _ in range(r.randint(1, 4)))
        out.append(w + (".\n" if i % 17 == 16 else "." if i % 9 == 8 else ""))
    return " ".join(out)


def awkward(spark, extra: bool = True):
    """Nulls in any column, empty, blank and very long texts, repeated rows, ties, clashing names."""
    base = prose(1, 60)
    rows = [(1, base, "en", "a", 10), (2, base, "en", "a", 10), (3, base + " tail", None, None, None), (3, base + " tail", None, None, None),
            (4, None, "en", "a", 0), (5, "", "en", "a", 0), (6, " \n\t ", "en", "a", 4), (None, base, "en", "a", 1),
            (None, None, None, None, None), (7, prose(2, 30000), "en", "b", 1), (8, "x" * 50000, "en", "b", 1),
            (9, "one", "en", "c", 3), (10, "one two three", "en", "c", 3), (11, "One  TWO\nthree", "en", "c", 3),
            (12, "ends <|endoftext|> here\x00 \u00a0 \u2003 日本 😀", "xx", "d", 5), (13, prose(3, 200), "en", "d", 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in ("kept", "rank", "_group", "sequence_id", "node", "grp", "run", "own", "_judged_text", "bands", "Shard",
                     "size", "_id", "_rows", "key", "pattern", "payload", "cluster"):
            df = df.selectExpr("*", f"'{name}' as `{name}`")
    return df


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]

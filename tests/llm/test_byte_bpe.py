"""Byte-level BPE by ranks against the library, on awkward texts and on pieces that merge many pairs at once."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from loomcast.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANDOM = random.Random(7)
TEXTS = [
    None, "", " ", "a", "don't 'S 'll we're", "<|endoftext|> <|endoftext|>", "a  b\x85\xa0 c  d",
    "  \n\n  x  \r\n\ty ", "\x00\x00 a\x00", "日本語のテキスト", "🙂🙂 x\U0001F9FF", "café naïve ÀÉÎ", "x" * 3000, "é" * 300,
    "aaabaaab" * 60, "".join(RANDOM.choice("abcdefgh") for _ in range(700)), "word " * 4000, "a" + "!" * 300 + "b",
    # a letter and a number that the JVM's Unicode version does not know
    "ࡰaࡰb 1\U00010d40 \U00010d402", "the thatthethat " * 30,
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH),
                             special_tokens={})


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pieces string")


def test_ids_equal_the_library(spark, library):
    """Also long pieces of few letters, where one step joins many pairs and a lower rank may come between."""
    long = ["".join(RANDOM.choice(letters) for _ in range(150)) for letters in ("the", "tha", "in", "and", "aeiou", "!?.", "0")
            for _ in range(6)]
    texts = TEXTS + long
    got = {r[0]: list(r[1]) for r in byte_bpe.encode(rows(spark, texts), PATH, public_tokenizers.PATTERN, remembered=3).collect()}
    assert got == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_round_trip_digests(spark, library):
    out = byte_bpe.round_trip(rows(spark, TEXTS), PATH, public_tokenizers.PATTERN)
    for row in out.collect():
        text = TEXTS[row.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_decoding(spark):
    ids = byte_bpe.encode(rows(spark, TEXTS), PATH, public_tokenizers.PATTERN, remembered=50)
    assert {r[0]: bytes(r[1]) for r in byte_bpe.decode(ids, PATH).collect()} == {i: (t or "").encode() for i, t in enumerate(TEXTS)}


def test_repeated_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert byte_bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).count() == 3
    assert byte_bpe.round_trip(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_every_pair_has_one_of_its_two_places(n):
    keys = RANDOM.sample(range(1 << 36), n)
    slots = byte_bpe._slots(keys, [k * 4 + 1 for k in keys])
    half = len(slots) // 2
    for k in keys:
        at = [side * half + (k * byte_bpe.ODD[side] >> 18 & half - 1) for side in (0, 1)]
        assert [slots[i] for i in at].count(k * 4 + 1) == 1
    assert len(slots) - slots.count(0) == n


def test_short_pieces_equal_the_library_wherever_they_are_folded(spark, library):
    """Pieces up to the length at which the step changes, once remembered and once folded in their document."""
    texts = ["".join(RANDOM.choice("thearinosé") for _ in range(n)) for n in range(1, 70) for _ in range(4)]
    want = {i: library.encode_ordinary(t) for i, t in enumerate(texts)}
    for remembered in (0, 1000):
        out = byte_bpe.encode(rows(spark, texts), PATH, public_tokenizers.PATTERN, remembered=remembered)
        assert {r[0]: list(r[1]) for r in out.collect()} == want
    words = byte_bpe.Words({"a": 1}, byte_bpe.frequent_words(spark.createDataFrame([(["a", "bc"],)], "pieces array<string>"), PATH, 5).toArrow())
    assert {x.itemsize for x in (words.at, words.length, words.start, words.size)} == {4}  # memory of a known word


def test_plans_do_not_spell_out_the_pairs(spark):
    """The driver keeps the text of every plan; the array of pairs is a subquery's value in it, and no row carries it."""
    words = byte_bpe.frequent_words(spark.createDataFrame([(["thearinos", "bc"],)], "pieces array<string>"), PATH, 5)
    modes = spark._jvm.org.apache.spark.sql.execution.ExplainMode
    text = words._jdf.queryExecution().explainString(modes.fromString("formatted"))
    assert len(text) < 100_000
    folds = [part for part in text.split("\n\n") if "transform(array(Subquery" in part]
    assert len(folds) == 1 and "arrays" not in folds[0].split("Input")[1]

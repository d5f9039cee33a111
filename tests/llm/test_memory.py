"""What tasks hold beside the heap: rows of whole texts in a batch, parts of texts, words that a worker remembers."""

import public_tokenizers
import pyarrow as pa
import pytest

from loomcast.llm import memory, near_dedup, packing, words
from loomcast.llm.memory import ROWS, lean, small_batches

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_texts_are_taken_in_parts_of_a_megabyte():
    texts = pa.array(["x" * (1 << 18)] * 16)
    assert [hi - lo for lo, hi in words.slices(texts)] == [4, 4, 4, 4]


@pytest.mark.parametrize("job", ["pack", "dedup"])
def test_jobs_on_whole_texts_run_with_small_batches(spark, monkeypatch, job):
    module, before, seen = {"pack": packing, "dedup": near_dedup}[job], spark.conf.get(ROWS), []
    stored = module.stored
    monkeypatch.setattr(module, "stored", lambda df: seen.append(int(spark.conf.get(ROWS))) or stored(df))
    docs = spark.createDataFrame([(i, f"one two three four five six {i // 2}") for i in range(40)], "doc_id long, text string")
    out = packing.pack(docs, TOKENIZER, 2, 64) if job == "pack" else near_dedup.near_duplicates(docs)
    assert out.count() == 40
    assert seen[0] == memory.TEXTS and spark.conf.get(ROWS) == before


def test_a_smaller_setting_stays_and_comes_back_after_an_error(spark):
    before = spark.conf.get(ROWS)
    spark.conf.set(ROWS, "7")
    try:
        with pytest.raises(KeyError), small_batches(spark):
            assert spark.conf.get(ROWS) == "7"
            raise KeyError
        assert spark.conf.get(ROWS) == "7"
    finally:
        spark.conf.set(ROWS, before)


def test_lean_tasks_give_back_after_the_last_batch(monkeypatch):
    calls = []
    monkeypatch.setattr(memory, "give_back", lambda: calls.append(1))
    out = lean(lambda batches: (b + 1 for b in batches))(iter([1, 2]))
    assert next(out) == 2 and not calls
    assert list(out) == [3] and calls == [1]

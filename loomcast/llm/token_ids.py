"""Encoding of whole texts to token ids and back (the method is in ``bpe``).

Nulls and empties: a null text is empty, an empty text has no id and decodes to the empty text. Rows with
equal or null ``doc_id`` are encoded one by one; an empty table gives an empty result; other columns are
ignored. A very long text is encoded in parts and needs memory for its ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomcast.llm.vocab import Vocabulary
from loomcast.llm.words import slices
from loomcast.shipping import shipped


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text's ids as an array of integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary.at(tokenizer)
        for names, texts in _rows(batches):
            ids = vocab.encode(texts)
            yield pa.RecordBatch.from_arrays([names, pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _input(docs, id_col, text_col).transform(shipped).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of rows as ``encode`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary.at(tokenizer)
        for batch in batches:
            texts = [vocab.decode(x.values.to_numpy()) if x.is_valid else None for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").transform(shipped).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the ids and of the text decoded from them, without moving either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary.at(tokenizer)
        for names, texts in _rows(batches):
            n, of_ids, of_text = [], [], []
            for ids in vocab.encode(texts):
                n.append(len(ids))
                of_ids.append(hashlib.sha256(ids.astype("<u4", copy=False).tobytes()).hexdigest())
                of_text.append(hashlib.sha256(vocab.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([names, pa.array(n, pa.int64()), pa.array(of_ids, pa.string()),
                                              pa.array(of_text, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _input(docs, id_col, text_col) \
        .transform(shipped).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _rows(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for lo, hi in slices(batch.column(1), 1 << 20):
            part = batch.slice(lo, hi - lo)
            yield part.column(0), part.column(1).to_pylist()

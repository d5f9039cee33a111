"""Token ids in packed binary form: best-fit-decreasing packing with a segment tree over remaining capacity.

Each task encodes its documents, gathers a block of about ``block_tokens`` ids, cuts documents longer than a
sequence without losing an id, and packs the block: pieces longest first, each into the sequence with the
least room that still holds it. A sequence is one row of the written table:

``sequence_id``, ``n_tokens``, ``input_ids`` (little-endian unsigned ids, padded to the length),
``cu_seqlens`` (0 and the running ends of its segments), ``position_ids`` (little-endian unsigned 16 or 32
bits, starting from 0 again in each segment, 0 in the padding), ``doc_ids``, ``doc_starts``, ``doc_tokens``.

Nulls and empties: a null or empty text is the end token alone. Rows with equal or null ``doc_id`` are
packed one by one. An empty table gives an empty result; other columns are ignored. A very long text is encoded in
parts and cut into full sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from loomcast.llm.storage import stored
from loomcast.llm.vocab import Vocabulary
from loomcast.llm.words import slices
from loomcast.shipping import shipped

SEQUENCES = ("sequence_id long, n_tokens long, input_ids binary, cu_seqlens array<int>, position_ids binary, "
             "doc_ids array<long>, doc_starts array<long>, doc_tokens array<long>")


class Rooms:
    """How many open sequences have each remaining capacity, as a segment tree of counts over capacities.

    ``least(n)`` finds the smallest capacity of at least n in logarithmic time.
    """

    def __init__(self, length: int):
        self.width = 1 << length.bit_length()
        self.tree = [0] * (2 * self.width)
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, sequence: int):
        self.open.setdefault(room, []).append(sequence)
        self._change(room, 1)

    def take(self, room: int) -> int:
        self._change(room, -1)
        return self.open[room].pop()

    def _change(self, room: int, by: int):
        node = room + self.width
        while node:
            self.tree[node] += by
            node >>= 1

    def least(self, room: int) -> int | None:
        node = room + self.width
        if self.tree[node]:
            return room
        while node > 1:  # up to the first right neighbour that holds something, then down its left edge
            if not node & 1 and self.tree[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.width
            node >>= 1
        return None


def best_fit(lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of every piece (best fit, longest first), and the number of sequences."""
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms, n = Rooms(length), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        room = rooms.least(size)
        if room is None:
            room, at, n = length, n, n + 1
        else:
            at = rooms.take(room)
        sequence[i], offset[i] = at, length - room
        if room > size:
            rooms.add(room - size, at)
    return sequence, offset, n


def _sequences(names: list, ids: list[np.ndarray], length: int, first: int, kind: str) -> pa.RecordBatch:
    """The packed rows of one block."""
    doc, start = [], []
    for i, x in enumerate(ids):
        cuts = range(0, len(x), length)
        doc += [i] * len(cuts)
        start += cuts
    doc, start = np.array(doc, np.int64), np.array(start, np.int64)
    total = np.fromiter(map(len, ids), np.int64, len(ids))
    size = np.minimum(total[doc] - start, length)
    sequence, offset, n = best_fit(size, length)
    matrix, position = np.zeros((n, length), kind), np.zeros((n, length), "<u2" if length <= 1 << 16 else "<u4")
    order = np.lexsort((offset, sequence))
    count = np.arange(length)
    for i in order.tolist():
        a, b, d = offset[i], offset[i] + size[i], doc[i]
        matrix[sequence[i], a:b] = ids[d][start[i]:start[i] + size[i]]
        position[sequence[i], a:b] = count[:size[i]]
    used = np.bincount(sequence, weights=size, minlength=n).astype(np.int64)
    edge = np.searchsorted(sequence[order], np.arange(n + 1))
    ends = (offset + size)[order]
    cu = [np.concatenate([[0], ends[a:b]]) for a, b in zip(edge[:-1], edge[1:])]
    per = lambda x: pa.array([x[order][a:b] for a, b in zip(edge[:-1], edge[1:])], pa.list_(pa.int64()))
    named = pa.array([[names[d] for d in doc[order][a:b].tolist()] for a, b in zip(edge[:-1], edge[1:])], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array(first + np.arange(n)), pa.array(used), pa.array([r.tobytes() for r in matrix], pa.binary()),
         pa.array(cu, pa.list_(pa.int32())), pa.array([r.tobytes() for r in position], pa.binary()),
         named, per(start), per(total[doc])],
        ["sequence_id", "n_tokens", "input_ids", "cu_seqlens", "position_ids", "doc_ids", "doc_starts", "doc_tokens"])


def packed_sequences(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048,
                     block_tokens: int = 1 << 21, kind: str = "<u2", id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Packed rows as in the module's text. ``kind`` must hold the vocabulary's ids; memory is bounded by a
    block, or by the longest document. Ids of sequences are unique: task number, then a count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, end = Vocabulary.at(tokenizer), np.array([end_id], np.uint32)
        if max(int(vocab.token_length.size) - 1, end_id) > np.iinfo(np.dtype(kind)).max:
            raise ValueError(f"ids of this vocabulary do not fit {kind}")
        first, names, ids, held = TaskContext.get().partitionId() << 40, [], [], 0
        for batch in batches:
            for lo, hi in slices(batch.column(1), 1 << 20):
                part = batch.slice(lo, hi - lo)
                for name, x in zip(part.column(0).to_pylist(), vocab.encode(part.column(1).to_pylist())):
                    x = np.concatenate([x, end]).astype(kind)
                    names.append(name)
                    ids.append(x)
                    held += len(x)
                    if held >= block_tokens:
                        out = _sequences(names, ids, length, first, kind)
                        first, names, ids, held = first + out.num_rows, [], [], 0
                        yield from _small(out)
        if ids:
            yield from _small(_sequences(names, ids, length, first, kind))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .transform(shipped).mapInArrow(run, SEQUENCES)


def _small(batch: pa.RecordBatch, rows: int = 256):
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, **options) -> None:
    """The packed table as Parquet files, by Spark's committer."""
    packed_sequences(docs, tokenizer, end_id, **options).write.parquet(path)


SEGMENTS = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
            "offset long, resets boolean")


def segments(packed: DataFrame, kind: str = "<u2") -> DataFrame:
    """One row per segment read from a packed table; ``resets``: its positions run from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["input_ids"], kind)
                position = np.frombuffer(r["position_ids"], "<u2" if len(ids) <= 1 << 16 else "<u4")
                ends = r["cu_seqlens"]
                for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                    rows.append((r["doc_ids"][k], r["doc_starts"][k], b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()),
                                 r["doc_tokens"][k], r["sequence_id"], a, bool((position[a:b] == np.arange(b - a)).all())))
            names = [c.split()[0] for c in SEGMENTS.split(", ")]
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            kinds = [pa.int64()] * 7 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return packed.transform(shipped).mapInArrow(run, SEGMENTS)


def written_segments(docs: DataFrame, tokenizer: str, end_id: int, **options) -> DataFrame:
    """Write the packed table to the shared folder, read it back and list its segments."""
    return segments(stored(packed_sequences(docs, tokenizer, end_id, **options)), options.get("kind", "<u2"))

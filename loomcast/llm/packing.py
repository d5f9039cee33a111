"""Packing of documents into fixed-length token sequences: shortest-pack-first over the length histogram.

``pieces`` encodes every document once and cuts what exceeds a sequence into full sequences and a rest.
``pattern_table`` sees only how many pieces there are of each length, never a document: lengths are placed
longest first, each into the packs with the most room, and a pack pattern carries the number of its copies.
``place`` gives the k-th piece of a length the k-th place that the patterns have for that length.

Nulls and empties: a null or empty text has the end token only, so every row is packed. Rows with equal or
null ``doc_id`` are packed one by one. An empty table gives an empty result. Columns beyond the two that are
named are ignored, so their names cannot clash. A very long text is encoded in parts and cut into full sequences.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from loomcast.llm.memory import lean, small_batches
from loomcast.llm.storage import partitions, stored
from loomcast.llm.vocab import Vocabulary
from loomcast.llm.words import slices
from loomcast.shipping import shipped

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per piece: its document, first token, length, CRC of its ids, and the document's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, end = Vocabulary.at(tokenizer), np.array([end_id], np.uint32)
        for batch in batches:
            for lo, hi in slices(batch.column(1), 1 << 20):
                part = batch.slice(lo, hi - lo)
                names, rows = part.column(0).to_pylist(), []
                for name, ids in zip(names, vocab.encode(part.column(1).to_pylist())):
                    ids = np.concatenate([ids, end]).astype("<u4", copy=False)
                    for at in range(0, len(ids), length):
                        cut = ids[at:at + length]
                        rows.append((name, at, len(cut), zlib.crc32(cut.tobytes()), len(ids)))
                yield _batch(rows, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        vocab.forget()  # an idle worker holds no words

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .transform(shipped).mapInArrow(lean(run), PIECES)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pattern_table(histogram: dict[int, int], length: int) -> list[tuple[int, Counter]]:
    """(copies, {piece length: times}) of every pack pattern.

    The state is the number of packs of each pattern by the room left. A length goes to the packs with the
    most room that fits; packs are opened when none has room. Work depends on the number of lengths, not on
    the number of pieces.
    """
    by_room: dict[int, list[list]] = defaultdict(list)  # room -> [copies, contents]
    rooms: list[int] = []  # largest first

    def add(room: int, copies: int, inside: tuple):
        if not by_room[room]:
            heapq.heappush(rooms, -room)
        by_room[room].append([copies, inside])

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            while rooms and not by_room[-rooms[0]]:
                heapq.heappop(rooms)
            room = -rooms[0] if rooms else 0
            if room >= size:
                copies, inside = by_room[room].pop()
            else:
                # as many new packs as are needed when each takes as many of this length as fit
                room, inside = length, ()
                copies = -(-left // (length // size))
            times = min(room // size, max(1, left // copies))
            # never fill a pack deeper than the next roomiest one while others wait
            second = max((r for r in by_room if by_room[r]), default=0) if room < length else 0
            while times > 1 and room - (times - 1) * size < second:
                times -= 1
            used = min(copies, left // times)
            if used < copies and inside:
                add(room, copies - used, inside)
            add(room - times * size, used, (*inside, (size, times)))
            left -= used * times
    out = []
    for room in by_room:
        for copies, inside in by_room[room]:
            contents: Counter = Counter()
            for size, times in inside:
                contents[size] += times
            out.append((copies, contents))
    return out


class Places:
    """Places of all patterns by length: ranks lo..hi-1 of a length sit at one offset of consecutive sequences."""

    def __init__(self, patterns: list[tuple[int, Counter]]):
        rows, first = [], 0
        for copies, contents in patterns:
            offset = 0
            for size in sorted(contents, reverse=True):
                for _ in range(contents[size]):
                    rows.append((size, copies, first, offset))
                    offset += size
            first += copies
        rows.sort(key=lambda r: r[0])
        table = np.array(rows, np.int64).reshape(-1, 4)
        self.sequences = first
        self.size, self.first, self.offset = table[:, 0], table[:, 2], table[:, 3]
        before = np.cumsum(table[:, 1]) - table[:, 1]
        start = np.searchsorted(self.size, self.size)
        self.rank = before - before[start] if len(table) else before
        # one sorted key for (length, first rank)
        self.span = int(table[:, 1].sum()) + 1
        self.key = self.size * self.span + self.rank

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, size * self.span + rank, "right") - 1
        return self.first[at] + rank - self.rank[at], self.offset[at]


def ranked(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows with ``rank`` 0, 1, ... within ``key``; a frequent key is dealt over many groups.

    Rows of a key are numbered inside a hash group and shifted by the sizes of the groups before.
    """
    groups = partitions(rows.sparkSession)
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64(*order), F.lit(groups)).cast("int"))
    within = Window.partitionBy(key, "_group").orderBy(*order)
    before = Window.partitionBy(key).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(key, "_group").count() \
        .select(key, "_group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return dealt.withColumn("_in", F.row_number().over(within) - 1).join(sizes, [key, "_group"]) \
        .withColumn("rank", (F.col("_before") + F.col("_in")).cast("long")).select(*rows.columns, "rank")


def place(cut: DataFrame, length: int) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``. ``cut`` is read twice, so it should be a stored table.

    The histogram has at most ``length`` entries and the places follow from it alone, so both are small
    whatever the number of documents.
    """
    spark = cut.sparkSession
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    places = spark.sparkContext.broadcast(Places(pattern_table(histogram, length)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            sequence, offset = table.find(batch.column("length").to_numpy(), rank)
            columns = [batch.column(c) for c in batch.schema.names if c != "rank"]
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)],
                                             [*names, "sequence_id", "offset"])

    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    return ranked(cut, "length", order).transform(shipped).mapInArrow(run, PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Every document in sequences of at most ``length`` tokens: one row per piece."""
    with small_batches(docs.sparkSession):
        cut = stored(pieces(docs, tokenizer, end_id, length, id_col, text_col))
    return place(cut, length)

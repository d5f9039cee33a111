"""Ranked lexical search of many items at once, with the work that items share done once per document.

1. ``sharing_plan`` mines the shared term sets of a block of items. Terms that occur in exactly the same items are
   one set. Every item is then a list of sets, most shared first; neighbours that two or more items have become a
   node of their own, again and again, so the items are the ends of a graph whose inner nodes are shared term sets.
2. ``postings`` reads each text once and stores, per document, its number of terms and the counts of the terms that
   the block asks for. Numbers of documents and terms and document frequencies are aggregated from that table.
3. A task turns the counts of some thousand documents into one accumulator per document and set, adds them up along
   the graph (a node is computed once, whatever the number of its items) and keeps the best documents of every item.
   The best of all tasks are ranked by a window.

Items are taken in blocks of bounded size, each block against all documents; the driver holds one block at a time.

Score of a document: the sum over the item's distinct terms of w * ((10^9 tf) div (1000 tf + 8 m)), with
w = floor(1000 ln((2N+2) / (2df+1))) and m = 100 - 90 + (90 n N) div L, all but w in 64-bit integers.

Terms are maximal runs of ASCII letters and digits and of all characters outside ASCII; A-Z count as a-z. Nulls and
empties: a null or empty text has no term, counts nowhere and is never found; an item without terms has no rows. Rows
with equal or null ids are documents and items of their own; equal scores are ranked by ascending id, a null id last.
An empty table gives an empty result. Other columns are ignored. A long text is counted in parts of a megabyte.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from loomcast.llm.storage import stored
from loomcast.shipping import shipped

BLOCK_ITEMS, BLOCK_BYTES = 4096, 16 << 20  # items and bytes of terms of a block
CELLS = 1 << 22  # accumulators that a task holds at a time
PART = 1 << 20

_KEPT = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _KEPT else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in parts."""
    at, text = 0, text.translate(_FOLD)
    while at < len(text):
        end = text.find(b" ", at + PART)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


@dataclass(frozen=True)
class Plan:
    """Sets of terms and the graph of their sums. Nodes below ``sets`` are sets, then come pairs of earlier nodes."""

    set_of: np.ndarray  # for every (term, number of its set)
    sets: int
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # nodes and the two that each adds, by depth
    nodes: int
    item_node: np.ndarray  # items and their remaining nodes, flat
    item_start: np.ndarray

    @property
    def additions(self) -> int:
        return self.nodes - self.sets + len(self.item_node)


def sharing_plan(items: list[list[int]], n_terms: int) -> Plan:
    """The graph of the items, each given as its distinct terms."""
    owners: list[list[int]] = [[] for _ in range(n_terms)]
    for no, item in enumerate(items):
        for term in item:
            owners[term].append(no)
    number: dict[tuple[int, ...], int] = {}
    set_of = np.array([number.setdefault(tuple(o), len(number)) for o in owners], np.int64)
    rows: list[list[int]] = [[] for _ in items]
    for own, no in sorted(number.items(), key=lambda x: (-len(x[0]), x[1])):
        for item in own:
            rows[item].append(no)
    depth, pairs = [0] * len(number), []
    while True:
        seen = Counter(pair for row in rows for pair in set(zip(row, row[1:])))
        chosen, taken = {}, set()
        for (a, b), times in sorted(seen.items(), key=lambda x: (-x[1], x[0])):
            if times > 1 and a not in taken and b not in taken:
                taken |= {a, b}
                chosen[a, b] = len(depth)
                pairs.append((len(depth), a, b))
                depth.append(1 + max(depth[a], depth[b]))
        if not chosen:
            break
        rows = [_joined(row, chosen) for row in rows]
    by_depth = defaultdict(list)
    for pair in pairs:
        by_depth[depth[pair[0]]].append(pair)
    levels = [tuple(np.array(x, np.int64) for x in zip(*by_depth[d])) for d in sorted(by_depth)]
    start = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    return Plan(set_of, len(number), levels, len(depth), np.array([n for r in rows for n in r], np.int64), start)


def _joined(row: list[int], chosen: dict[tuple[int, int], int]) -> list[int]:
    out, i = [], 0
    while i < len(row):
        node = chosen.get((row[i], row[i + 1])) if i + 1 < len(row) else None
        out.append(row[i] if node is None else node)
        i += 1 if node is None else 2
    return out


def postings(docs: DataFrame, index: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, number of terms, and the counts of the block's terms, for every document with a term."""
    known = docs.sparkSession.sparkContext.broadcast(index)  # a block's terms: at most BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in batches:
            ids, sizes, hits, counts = [], [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, found = 0, Counter()
                for words in terms(text.as_buffer().to_pybytes() if text.is_valid else b""):
                    n += len(words)
                    found.update(map(get, words))
                if n:
                    found.pop(None, None)
                    ids.append(name)
                    sizes.append(n)
                    hits.append(list(found))
                    counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(hits, pa.list_(pa.int32())),
                 pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n", "term", "tf"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")) \
        .transform(shipped).mapInArrow(run, "doc_id long, n long, term array<int>, tf array<long>")


class Best:
    """The best documents of every item so far: score descending, then id ascending, null last."""

    def __init__(self, top: int, items: int):
        self.top, self.least = top, np.ones(items, np.int64)
        self.item, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.doc, self.unnamed = np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, doc: np.ndarray, unnamed: np.ndarray):
        """``scores`` has a row per item and a column per document."""
        item, at = np.nonzero(scores >= self.least[:, None])
        if not len(item):
            return
        both = [np.concatenate(x) for x in ((self.item, item), (self.score, scores[item, at]), (self.doc, doc[at]),
                                            (self.unnamed, unnamed[at]))]
        order = np.lexsort((both[2], both[3], -both[1], both[0]))
        self.item, self.score, self.doc, self.unnamed = (x[order] for x in both)
        place = np.arange(len(order)) - np.searchsorted(self.item, self.item)
        last = place == self.top - 1
        self.least[self.item[last]] = np.maximum(self.score[last], 1)
        keep = place < self.top
        self.item, self.score, self.doc, self.unnamed = (x[keep] for x in (self.item, self.score, self.doc, self.unnamed))


def scores(plan: Plan, weight: np.ndarray, n_docs: int, n_terms: int, n: np.ndarray, term: np.ndarray, tf: np.ndarray,
           owner: np.ndarray) -> np.ndarray:
    """Scores of some documents for all items. ``owner`` is the document of each entry of ``term`` and ``tf``."""
    m = 10 + (90 * n * n_docs) // n_terms
    part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
    sums = np.zeros((plan.nodes + 1, len(n)), np.int64)  # the last row stays zero
    np.add.at(sums, (plan.set_of[term], owner), part)
    for node, a, b in plan.levels:
        sums[node] = sums[a] + sums[b]
    out = np.zeros((len(plan.item_start) - 1, len(n)), np.int64)
    for i, (a, b) in enumerate(zip(plan.item_start[:-1], plan.item_start[1:])):
        out[i] = sums[plan.item_node[a:b]].sum(0)
    return out


def _ranked(found: DataFrame, names: list, plan: Plan, weight: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    shared = found.sparkSession.sparkContext.broadcast((names, plan, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, plan, weight = shared.value
        step = max(1, CELLS // (plan.nodes + len(names) + 1))
        best = Best(top, len(names))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                lists, ids = part.column("term"), part.column("doc_id")
                owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                got = scores(plan, weight, n_docs, n_terms, part.column("n").to_numpy(), lists.flatten().to_numpy(),
                             part.column("tf").flatten().to_numpy(), owner)
                best.add(got, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item, pa.int32()), pa.array([names[i] for i in best.item], pa.int64()),
             pa.array(best.doc, pa.int64(), mask=best.unnamed), pa.array(best.score, pa.int64())],
            ["item", "item_id", "doc_id", "score"])

    some = found.filter(F.size("term") > 0).transform(shipped).mapInArrow(run, "item int, item_id long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return some.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top) \
        .select("item_id", "rank", "doc_id", "score")


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """(item_id, distinct terms) of the items in blocks."""
    block, size = [], 0
    rows = items.select(F.col(item_col).cast("long"), F.col(text_col).cast("string").cast("binary"))
    for name, text in rows.toLocalIterator():
        own = sorted({t for part in terms(bytes(text or b"")) for t in part})
        if block and (len(block) >= BLOCK_ITEMS or size + sum(map(len, own)) > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((name, own))
        size += sum(map(len, own))
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` documents of every item with a score above 0."""
    spark, out = docs.sparkSession, None
    for block in _blocks(items, item_col, item_text):
        index = {t: i for i, t in enumerate(dict.fromkeys(t for _, own in block for t in own))}
        found = stored(postings(docs, index, id_col, text_col))
        n_docs, n_terms = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        weight = np.zeros(len(index), np.int64)
        # as many rows as the block has terms
        for term, df in found.select(F.explode("term").alias("term")).groupBy("term").count().collect():
            weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        plan = sharing_plan([[index[t] for t in own] for _, own in block], len(index))
        ranked = _ranked(found, [name for name, _ in block], plan, weight, n_docs, n_terms, top)
        out = ranked if out is None else out.union(ranked)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out

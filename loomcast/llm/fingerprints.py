"""SimHash fingerprints of documents and the search of all fingerprints within a Hamming radius.

A term is a word or a pair of neighbouring words; its weight is the part of the text it spans. Every term's
hash votes with its weight on each bit, and the sign of the sum is the fingerprint's bit. For the search the bits are cut into
blocks; two fingerprints that differ in at most ``radius`` bits agree on all but ``radius`` blocks, so each
choice of the remaining blocks is a table keyed by their bits (a permutation that puts these blocks first).
With no fewer bits than blocks none may agree, so there is a table per block, and a query is looked up with
every value that differs from its own in so few bits that no pair is missed. The exact distance decides in both.

Nulls and empties: a null text is empty; a text without words has the fingerprint of zeros. Equal texts have
equal fingerprints. Rows with equal ids are each fingerprinted; null ids come first in the order. An empty
table gives an empty result. Other columns are ignored. A very long text needs memory for the hashes of its
words, which are made in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomcast.llm.storage import partitions, stored
from loomcast.llm.words import buffer_of, mix, slices, word_bounds, word_hashes
from loomcast.shipping import shipped

BITS = 128
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1
_PLACE = (np.arange(BITS // 8) * 256).astype(np.int64)
_OTHER, _NEXT = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15)
TERMS = 1 << 16  # votes counted at a time


def votes(words: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Sum of the weighted signed bits of all terms of one text, given its words' hashes and lengths."""
    total = np.zeros(BITS)
    for lo in range(0, len(words), TERMS):
        hi = min(lo + TERMS, len(words))
        w, n = words[lo:min(hi + 1, len(words))], spans[lo:min(hi + 1, len(words))]
        with np.errstate(over="ignore"):
            pair = mix(w[:-1] * _NEXT + w[1:]) if len(w) > 1 else w[:0]
        terms = np.concatenate([w[:hi - lo], pair])
        weight = np.concatenate([n[:hi - lo], 2 * (n[:-1] + n[1:])]).astype(np.float64)
        with np.errstate(over="ignore"):
            both = np.stack([mix(terms + _NEXT), mix(terms ^ _OTHER)], axis=1)
        cell = both.view(np.uint8).reshape(len(terms), BITS // 8) + _PLACE
        count = np.bincount(cell.ravel(), weights=np.repeat(weight, BITS // 8), minlength=256 * BITS // 8)
        total += (count.reshape(BITS // 8, 256) @ _SIGNS).ravel()
    return total


def fingerprints(texts: pa.Array) -> np.ndarray:
    """One row of 16 bytes per text."""
    data, offsets = buffer_of(texts)
    starts, ends = word_bounds(data, offsets)
    hashes, edge = word_hashes(data, starts, ends), np.searchsorted(starts, offsets)
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    for i, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
        if b > a:
            out[i] = np.packbits(votes(hashes[a:b], ends[a:b] - starts[a:b]) > 0)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Part of equal bits, row by row."""
    return 1 - np.unpackbits(a ^ b, axis=1).sum(axis=1) / BITS


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by as many from the following text's begin."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (32 hexadecimal digits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                prints = pa.array([p.tobytes().hex() for p in fingerprints(part.column(1))], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), prints], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .transform(shipped).mapInArrow(run, "doc_id long, fingerprint string")


def in_order(docs: DataFrame) -> tuple[DataFrame, str | None]:
    """Rows (run, own, doc_id, text) in partitions sorted by run, doc_id, text, and the first text of all.

    A run is a range of ids; its rows are followed by one row that is not its own, the first of the next run.
    """
    spark = docs.sparkSession
    runs = 4 * partitions(spark)
    first = docs.agg(F.min("doc_id")).first()[0]
    cuts = sorted(set(docs.select(F.col("doc_id").cast("double").alias("i")).approxQuantile(
        "i", [k / runs for k in range(1, runs)], 0.25 / runs))) if first is not None else []
    cuts = [min(int(c), (1 << 63) - 1) for c in cuts if c > first]
    # cuts are rounded: the smallest id at or above a cut opens its run, and its row also ends the run before
    array = lambda ids: F.array(*[F.lit(c) for c in ids]).cast("array<long>")
    run_of = lambda ids: F.size(F.filter(array(ids), lambda c: c <= F.col("doc_id")))
    if cuts:
        lowest = docs.filter("doc_id is not null").groupBy(run_of(cuts).alias("run")).agg(F.min("doc_id").alias("low"))
        cuts = sorted(r["low"] for r in lowest.filter("run > 0").collect())
    bounds, runs_of = array(cuts), run_of(cuts)
    opener = F.array_contains(bounds, F.col("doc_id"))
    rows = docs.withColumn("run", F.when(F.col("doc_id").isNull(), 0).otherwise(runs_of)) \
        .withColumn("copies", F.when(F.coalesce(opener, F.lit(False)), F.array(F.lit(True), F.lit(False)))
                    .otherwise(F.array(F.lit(True)))) \
        .select("doc_id", "text", "run", F.explode("copies").alias("own")) \
        .withColumn("run", F.when(F.col("own"), F.col("run")).otherwise(F.col("run") - 1))
    opening = docs.orderBy(F.col("doc_id").asc_nulls_first(), "text").limit(1).select("text").collect()
    return rows.repartitionByRange(partitions(spark), "run") \
        .sortWithinPartitions("run", F.col("own").desc(), F.col("doc_id").asc_nulls_first(), "text"), \
        opening[0][0] if opening else None


COMPARED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's fingerprint against those of its edited text and of the next document by id (see ``edited``)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows, opening = in_order(docs)

    def emit(names: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
        changed = [edited(t, f) for t, f in zip(texts, following)]
        own = fingerprints(pa.array([*texts, following[-1]], pa.large_string()))
        own, after = own[:-1], own[1:]
        # the next text is the next row's, except where a run ends
        other = [i for i in range(len(texts) - 1) if following[i] is not texts[i + 1]]
        if other:
            after = after.copy()
            after[other] = fingerprints(pa.array([following[i] for i in other], pa.large_string()))
        of_edited = fingerprints(pa.array(changed, pa.large_string()))
        return pa.RecordBatch.from_arrays([
            pa.array(names, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array([p.tobytes().hex() for p in own], pa.string()),
            pa.array([p.tobytes().hex() for p in of_edited], pa.string()),
            pa.array(likeness(own, of_edited), pa.float64()), pa.array(likeness(own, after), pa.float64())],
            [c.split()[0] for c in COMPARED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts, following, held = [], [], [], 0
        last = None  # a row that waits for the next one: (run, doc_id, text)
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                for k, own, name, text in zip(*(part.column(c).to_pylist() for c in ("run", "own", "doc_id", "text"))):
                    if last is not None and (k == last[0] or opening is not None):
                        names.append(last[1])
                        texts.append(last[2])
                        following.append(text if k == last[0] else opening)
                        held += len(last[2])
                    last = (k, name, text) if own else None
                    if held > 1 << 21:
                        yield emit(names, texts, following)
                        names, texts, following, held = [], [], [], 0
        if last is not None:  # only the last document of all has no row behind it
            names.append(last[1])
            texts.append(last[2])
            following.append(opening)
        if texts:
            yield emit(names, texts, following)

    return rows.select("run", "own", "doc_id", "text").transform(shipped).mapInArrow(run, COMPARED)


def _tables(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Each fingerprint once per table, keyed by the table's number and the bits of its chosen blocks."""
    digits = BITS // 4 // blocks
    part = lambda b: F.substring("fingerprint", 1 + b * digits, digits)
    keys = [F.concat(F.lit(f"{t}:"), *[part(b) for b in chosen])
            for t, chosen in enumerate(combinations(range(blocks), blocks - radius))]
    return prints.withColumn("key", F.explode(F.array(*[F.xxhash64(k) for k in keys])))


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two fingerprints of 32 hexadecimal digits."""
    out = F.lit(0)
    for at in range(1, BITS // 4 + 1, 8):
        half = lambda c: F.conv(F.substring(c, at, 8), 16, 10).cast("long")  # noqa: B023,E731
        out = out + F.bit_count(half(a).bitwiseXOR(half(b)))
    return out


def _tolerances(radius: int, blocks: int) -> list[int]:
    """Bits that each block may differ in. One more in every block makes more than ``radius`` bits, so two
    fingerprints within the radius keep to the tolerance of a block at least."""
    each, more = divmod(radius + 1, blocks)
    return [each - (b >= more) for b in range(blocks)]


def _near_blocks(queries: DataFrame, prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Pairs by a table per block. A pair counts in the first block whose tolerance it keeps to, so it comes once."""
    width, digits, bits = BITS // blocks, BITS // 4 // blocks, _tolerances(radius, blocks)
    number = lambda at, n: F.conv(F.substring("fingerprint", at, n), 16, 10).cast("long")
    half = lambda at: F.shiftleft(number(at, 8), 32).bitwiseOR(number(at + 8, 8))
    text = lambda side: F.lower(F.concat(*[F.lpad(F.hex(f"{side}{k}"), 16, "0") for k in (0, 1)]))
    keys = F.array(*[number(1 + b * digits, digits) + (b << width) for b in range(blocks)])
    masks = F.array(*[F.array(*[F.lit(sum(1 << k for k in ones)).cast("long") for n in range(t + 1)
                                for ones in combinations(range(width), n)]) for t in bits])
    halves = lambda rows, side: rows.select("fingerprint").distinct() \
        .select(half(1).alias(f"{side}0"), half(17).alias(f"{side}1"), keys.alias("keys"))
    left = halves(queries, "q").select("q0", "q1", F.explode(F.flatten(F.zip_with(
        "keys", masks, lambda key, of: F.transform(of, lambda m: key.bitwiseXOR(m))))).alias("key"))
    right = halves(prints, "p").select("p0", "p1", F.explode("keys").alias("_key"))
    other = [F.col(f"q{k}").bitwiseXOR(F.col(f"p{k}")) for k in (0, 1)]
    apart = F.bit_count(other[0]) + F.bit_count(other[1])
    first = F.lit(blocks)
    for b in reversed(range(blocks)):
        side, at = divmod(b * width, 64)
        of = F.shiftrightunsigned(other[side], 64 - width - at).bitwiseAND(F.lit((1 << width) - 1))
        first = F.when(F.bit_count(of) <= bits[b], b).otherwise(first)
    here = F.shiftright("_key", width) == first
    # one row of the left became hundreds, which the planner's size does not show: never broadcast
    return left.join(right.hint("merge"), (F.col("key") == F.col("_key")) & (apart <= radius) & here) \
        .select(text("q").alias("fingerprint"), text("p").alias("near"), apart.cast("int").alias("distance"))


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 4) -> DataFrame:
    """All pairs (fingerprint, near, distance) of a query fingerprint and a fingerprint within ``radius`` bits.

    Both sides are made distinct first, so copies meet once. ``blocks`` must divide 32; more blocks than
    ``radius`` make longer keys and more tables. With fewer, blocks must be 4, 8, 16 or 32: a block may then
    differ in some bits, and the values looked up for a query grow with the choices of these bits.
    """
    if (BITS // 4) % blocks or blocks <= radius and blocks < 4:
        raise ValueError("blocks must divide 32 and be more than radius or at least 4")
    if radius >= blocks:
        return _near_blocks(queries, prints, radius, blocks)
    left = _tables(queries.select("fingerprint").distinct(), radius, blocks)
    right = _tables(prints.select("fingerprint").distinct(), radius, blocks).withColumnRenamed("fingerprint", "near")
    return left.join(right, "key").select("fingerprint", "near").distinct() \
        .withColumn("distance", distance(F.col("fingerprint"), F.col("near")).cast("int")).filter(F.col("distance") <= radius)


# bits within which texts that share four fifths of their five-word shingles lie (README has the distances measured)
NEAR_COPY = 22


def searched(docs: DataFrame, every: int = 100, radius: int = NEAR_COPY, blocks: int = 8) -> DataFrame:
    """``compared`` with ``n_within``: for rows whose id is divisible by ``every`` the number of documents, itself
    included, whose fingerprint is within ``radius`` bits; null for other rows."""
    rows = stored(compared(docs))
    asked = rows.filter(F.col("doc_id") % every == 0)
    copies = rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"))
    found = within_radius(asked, copies, radius, blocks) \
        .join(copies.withColumnRenamed("fingerprint", "near"), "near") \
        .groupBy("fingerprint").agg(F.sum("copies").alias("n_within"))
    return rows.join(found, "fingerprint", "left").select(
        *[c.split()[0] for c in COMPARED.split(", ")],
        F.when(F.col("doc_id") % every == 0, F.col("n_within")).alias("n_within"))

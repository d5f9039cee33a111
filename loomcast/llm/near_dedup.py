"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find.

1. A document's set is its distinct k-word shingles. Documents with equal sets are one class.
2. Classes that share a band of their signatures are candidates. Inside a bucket every class is only chained
   to the smallest one, and union-find over these chains gives candidate clusters: classes of two clusters
   share no bucket.
3. Inside a cluster the full sets are compared through an index of their shingles, exactly. A cluster of more
   than ``block`` classes is dealt over blocks: two rounds with different deals link what lies in one block,
   then only the classes outside the largest group of their cluster are compared with the whole cluster. A
   class of which fewer than the needed part of shingles occurs anywhere else in its cluster can have no
   link, which leaves it out of the blocks without changing the result.
4. Union-find over verified links gives the components.

Only links are put out, at most one per class and block, never the pairs of a group. No bucket, cluster or
partner is capped.

Nulls and empties: a null or empty text, or one without words, has an empty set, belongs to itself and is
kept. A row with a null id takes the component of its copies with an id and is then not kept; without such a
copy its component is null and it is kept. Rows with equal ids and texts are alike; rows with equal ids and
other texts are documents of their own: a class is known by its set's digest, never by an id. An empty table
gives an empty result. Other columns are ignored. A very long text needs memory for its set of shingle hashes; its
words are hashed in blocks. Words and shingles are compared by 64-bit hashes, sets of one class by 128 bits.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomcast.llm.components import components, local_forest
from loomcast.llm.memory import lean, small_batches
from loomcast.llm.storage import partitions, stored
from loomcast.llm.superminhash import band_keys, signatures
from loomcast.llm.words import mix, shingles, slices, words_of
from loomcast.shipping import shipped


@dataclass(frozen=True)
class Near:
    words: int = 5  # of a shingle
    per_hundred: int = 80  # least similarity: 100 * intersection >= per_hundred * union
    bands: int = 32
    rows: int = 5
    block: int = 4000  # classes compared in one task


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, start = words_of(texts)
    for a, b in zip(start[:-1].tolist(), start[1:].tolist()):
        yield np.unique(shingles(hashes[a:b], k))


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes."""
    with np.errstate(over="ignore"):
        one, two = mix(s + np.uint64(1)), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        return int(one.sum(dtype=np.uint64).view(np.int64)), int(two.sum(dtype=np.uint64).view(np.int64))


SETS = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, mark long"


def described(docs: DataFrame, near: Near) -> DataFrame:
    """Per row: the size of its set, the set's digest, and its band keys (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                sets = list(shingle_sets(part.column(1), near.words))
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                digest = np.array([_digest(s) for s in sets], np.int64).reshape(-1, 2)
                offsets = np.concatenate([[0], np.cumsum(size)])
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                keys = band_keys(signatures(flat, offsets, near.bands * near.rows), near.bands, near.rows).view(np.int64)
                bands = pa.array([k if n else [] for k, n in zip(keys, size.tolist())], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size), pa.array(digest[:, 0]), pa.array(digest[:, 1]), bands,
                     part.column(2)], ["doc_id", "n_shingles", "h1", "h2", "bands", "mark"])

    return docs.transform(shipped).mapInArrow(lean(run), SETS)


def sets_of(docs: DataFrame, near: Near) -> DataFrame:
    """node, cluster and the sorted set as bytes, of rows (node, cluster, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                data = pa.array([s.tobytes() for s in shingle_sets(part.column(2), near.words)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), data], ["node", "cluster", "shingles"])

    return docs.transform(shipped).mapInArrow(lean(run), "node long, cluster long, shingles binary")


def compare(node: np.ndarray, group: np.ndarray, probe: np.ndarray, sets: list[np.ndarray], per_hundred: int):
    """Links among sets, enough to join all groups that a link joins: probes against every set.

    An index lists, for each shingle, the sets that have it; a probe counts its overlaps with sets of other
    groups in one pass. Groups are merged as links are found, so no second link joins the same two.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out = []
    for i in np.flatnonzero(probe).tolist():
        n = len(sets[i])
        lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        # an intersection of per_hundred parts of this set is needed at least
        if np.count_nonzero(hi - lo > 1) * 100 < per_hundred * n:
            continue
        total = int((hi - lo).sum())
        begin = np.concatenate([[0], np.cumsum(hi - lo)[:-1]])
        hits = owner[np.arange(total) + np.repeat(lo - begin, hi - lo)]
        both = np.bincount(hits, minlength=len(sets))
        near = both * 100 >= per_hundred * (n + size - both)
        near[i] = False
        own = find(int(group[i]))
        for j in np.flatnonzero(near).tolist():
            other = find(int(group[j]))
            if other != own:
                out.append((int(node[i]), int(node[j])))
                low, high = min(own, other), max(own, other)
                parent[high] = low
                own = low
    return out


def _links(rows: DataFrame, near: Near) -> DataFrame:
    """Links inside each ``task`` of rows (task, node, grp, probe, shingles)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        node, grp = table.column("node").to_numpy(), table.column("grp").to_numpy()
        order = np.argsort(node, kind="stable")
        found = compare(node[order], grp[order], table.column("probe").to_numpy()[order], [sets[i] for i in order],
                        near.per_hundred) if len(sets) > 1 else []
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return rows.transform(shipped).groupBy("task").applyInArrow(run, "a long, b long")


def _grouped(sets: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return sets.withColumn("grp", F.col("node"))
    return sets.join(comps.withColumnRenamed("root", "grp"), "node", "left").withColumn("grp", F.coalesce("grp", "node"))


def verified_links(sets: DataFrame, near: Near) -> DataFrame:
    """Links (a, b) that join exactly the classes whose full sets are similar. ``sets``: a stored table."""
    size = sets.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("blocks", F.ceil(F.col("n") / near.block).cast("int"))
    large = size.filter("blocks > 1")
    task = lambda *c: F.xxhash64(*c)
    small = sets.join(size.filter("blocks = 1 and n > 1").select("cluster"), "cluster", "left_semi")
    links = _links(_small_tasks(small, sets.count()).withColumn("grp", F.col("node")).withColumn("probe", F.lit(True)), near)
    if not large.limit(1).count():
        return links
    # clusters of many classes: leave out those that cannot have a link
    members = sets.join(large, "cluster")
    seen = _supported(members, near)
    members = stored(members.join(seen, "node", "left_semi"))
    found, comps = None, None
    for seed in (1, 2):
        deal = F.pmod(F.xxhash64("node", F.lit(seed)), F.col("blocks"))
        rows = _grouped(members, comps).withColumn("probe", F.lit(True)).withColumn("task", task("cluster", deal))
        more = stored(_links(rows.select("task", "node", "grp", "probe", "shingles"), near))
        found = more if found is None else found.union(more)
        comps = components(found)
    # what is not in the largest group of its cluster meets the whole cluster
    groups = _grouped(members, comps)
    counts = groups.groupBy("cluster", "grp").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("cluster").agg(F.max_by("grp", F.struct("n", -F.col("grp"))).alias("main"))
    groups = groups.join(main, "cluster")
    strays = groups.filter("grp <> main")
    stray_blocks = strays.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / near.block).cast("int").alias("sb"))
    deal = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")  # the types of x and y, as task hashes them
    mine = F.pmod(F.xxhash64("node", F.lit(4)), F.col("sb")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # a stray is in its own stray block with every block; a member in its block with every stray block
    left = strays.join(stray_blocks, "cluster").withColumn("y", every("blocks")) \
        .select(task("cluster", mine, "y").alias("task"), "node", "grp", F.lit(True).alias("probe"), "shingles")
    right = groups.join(stray_blocks, "cluster").withColumn("x", every("sb")) \
        .filter((F.col("grp") == F.col("main")) | (mine != F.col("x"))) \
        .select(task("cluster", "x", deal).alias("task"), "node", "grp", F.lit(False).alias("probe"), "shingles")
    last = _links(left.union(right), near)
    return links.union(found).union(last)


def _small_tasks(sets: DataFrame, total: int) -> DataFrame:
    """Clusters share tasks of about a thousand sets: comparing several small clusters together costs no more."""
    return sets.withColumn("task", F.pmod(F.xxhash64("cluster"), F.lit(max(partitions(sets.sparkSession), total // 1000))))


def _supported(members: DataFrame, near: Near) -> DataFrame:
    """Nodes with enough shingles that another class of the cluster has too."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                s = np.frombuffer(batch.column(2)[row].as_buffer(), np.int64)
                fill = lambda c: pa.array(np.full(len(s), batch.column(c)[row].as_py()))
                yield pa.RecordBatch.from_arrays([fill(0), fill(1), pa.array(s)], ["node", "cluster", "h"])

    each = members.select("node", "cluster", "shingles").transform(shipped).mapInArrow(spread, "node long, cluster long, h long")
    shared = each.groupBy("cluster", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cluster", "h")
    total = members.select("node", (F.octet_length("shingles") / 8).alias("size"))
    return each.join(shared, ["cluster", "h"], "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("k")) \
        .join(total, "node").filter(F.col("k") * 100 >= F.col("size") * near.per_hundred).select("node")


FILTER_BITS = 1 << 25  # four megabytes, whatever the number of members


def mark(id_col: str, text_col: str) -> Column:
    """64 bits of an id with its text: rows with equal ids and other texts are told apart by it."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def perhaps_in(members: DataFrame) -> Callable[[Column], Column]:
    """Whether a mark may be among the members', by a bit table of fixed size: no member is missed, and with few
    members hardly another one is taken. Texts of the others then need not be shuffled for an exact join."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    parts = members.select((place("mark") + 1).alias("p")) \
        .groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    for k, bits in parts:
        table[(k - 1) * len(bits):k * len(bits)] = np.frombuffer(bits, np.uint8)
    shared = members.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def perhaps(p: pd.Series) -> pd.Series:
        at = p.to_numpy().astype(np.int64)
        return pd.Series((shared.value[at >> 3] >> (at & 7)) & 1 == 1)

    return lambda mark: perhaps(place(mark))


def near_duplicates(docs: DataFrame, near: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable) and kept (doc_id is that id), one row per row."""
    return verdicts(docs, near, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def verdicts(docs: DataFrame, near: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``near_duplicates`` with the row's ``mark`` and ``chosen``: of a component, only one id with one text is."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       mark(id_col, text_col).alias("mark"))
    with small_batches(docs.sparkSession):
        rows = stored(described(docs, near))
    # a class is an equal set; its node is 64 bits of the digest, and a row with the smallest id has its text
    low = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark")))
    classes = rows.filter("n_shingles > 0").groupBy("h1", "h2").agg(low.alias("low"), F.first("bands").alias("bands")) \
        .filter("low is not null").withColumn("node", F.xxhash64("h1", "h2"))
    classes = stored(classes)
    buckets = stored(classes.select("node", F.explode("bands").alias("band")))
    leaders = buckets.groupBy("band").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    chains = buckets.join(leaders, "band").filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")) \
        .distinct()
    clusters = components(chains)
    members = clusters.select("node", F.col("root").alias("cluster")) \
        .union(clusters.select(F.col("root").alias("node"), F.col("root").alias("cluster")).distinct())
    members = stored(members.join(classes.select("node", "low.mark"), "node"))
    # rows that repeat an id and a text have one mark, and give their text once
    named = docs.transform(shipped).filter(F.col("doc_id").isNotNull()).filter(perhaps_in(members)("mark"))
    texts = named.groupBy("mark").agg(F.first("text").alias("text")).join(members, "mark").select("node", "cluster", "text")
    with small_batches(docs.sparkSession):
        sets = stored(sets_of(texts, near))
    found = components(verified_links(sets, near))
    # stored, so that the last joins have plain exchanges on both sides and a class of many copies can be split
    of_class = stored(classes.select("h1", "h2", "node", "low").join(found, "node", "left")
                      .select("h1", "h2", "low", F.coalesce("root", "node").alias("root")))
    of_root = stored(of_class.groupBy("root").agg(F.min("low").alias("of")))
    of_class = stored(of_class.join(of_root, "root").select("h1", "h2", "of"))
    own = F.when(F.col("n_shingles") > 0, F.col("of.doc_id")).otherwise(F.col("doc_id"))
    kept = F.col("doc_id").eqNullSafe(own)
    one = (F.col("n_shingles") == 0) | F.col("of").isNull() | (F.col("mark") == F.col("of.mark"))
    return rows.drop("bands").join(of_class, ["h1", "h2"], "left") \
        .select("doc_id", "n_shingles", own.alias("component_id"), kept.alias("kept"), "mark", (kept & one).alias("chosen"))

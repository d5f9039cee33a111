"""Quality classifier from weak labels.

Several heuristic labellers vote good, bad or nothing on every document; none looks at the table of labels.
The vote patterns of all documents are counted (at most three to the number of labellers), and
expectation-maximisation over these counts estimates how often each labeller is right in good documents and
in each way of being bad, and with that the probability that a pattern belongs to a bad document. At most ``sample``
distinct texts of either kind, those of the smallest hashes, train a linear scorer over hashed shape 4-grams, in
groups whose weights are averaged; it scores all texts. A text with many copies is one text of the sample.

Nulls and empties: a text without words is rejected; one of fewer than five is judged by its votes alone. Rows with equal ids or texts are each scored, equally.
An empty table gives an empty result; with no document of one kind the posterior of its votes decides.
``kept_documents`` returns the input's columns, whatever their names. Texts are read in slices of a few megabytes; a very
long text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomcast.llm.memory import lean, small_batches
from loomcast.llm.storage import fresh, stored
from loomcast.llm.words import buffer_of, slices, word_bounds, word_hashes
from loomcast.shipping import shipped

BAD, NONE, GOOD = 0, 1, 2
SLOTS = 1 << 13
LABELLERS = ("neighbours", "symbols", "separators", "capitals", "variety", "lines", "sentences", "length")
RELATIONS = 4  # features behind the hashed ones
FEW = 5  # words; shorter texts show the scorer too little and are judged by their votes

_KIND = np.ones(256, np.int64)  # letters and bytes above ASCII
_KIND[65:91], _KIND[48:58], _KIND[:33], _KIND[10] = 2, 3, 4, 5
_PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
_KIND[_PUNCTUATION] = np.arange(6, 6 + len(_PUNCTUATION))
_SYMBOL, _STOP, _BAR, _UPPER = (np.isin(np.arange(256), list(x)) for x in
                                (b"#*$%&<>=~^_+|", b".!?", b"|>", bytes(range(65, 91))))
PART = 1 << 18  # bytes of text judged at a time


@dataclass(frozen=True)
class Fit:
    sample: int = 4000  # distinct texts of each kind that train the scorer
    groups: int = 8  # of the sample, trained apart and averaged
    epochs: int = 30
    rate: float = 0.5
    ridge: float = 1e-5
    prior_bad: float = 0.1
    threshold: float = 0.5  # probability of a bad document from which it is rejected


def figures(texts: pa.Array) -> np.ndarray:
    """One row per text: words, and the shares the labellers look at."""
    data, offsets = buffer_of(texts)
    starts, ends = word_bounds(data, offsets)
    hashes, edge = word_hashes(data, starts, ends), np.searchsorted(starts, offsets)
    total = lambda mask: np.concatenate([[0], np.cumsum(mask[data])])
    symbols, stops = total(_SYMBOL), total(_STOP)
    n = np.diff(edge)
    size = ends - starts
    second = np.minimum(starts + 1, max(len(data) - 1, 0))
    capital = _UPPER[data[starts]] & _UPPER[data[second]] & (size > 1) if len(starts) else np.zeros(0, bool)
    lone = (size == 1) & _BAR[data[starts]] if len(starts) else np.zeros(0, bool)
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[edge])
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    first = edge[:-1][n > 0]
    same[first] = False
    per = np.maximum(n, 1)
    out = np.zeros((len(texts), 9))
    out[:, 0] = n
    out[:, 1] = sums(same) / per
    out[:, 2] = (symbols[offsets[1:]] - symbols[offsets[:-1]]) / per
    out[:, 3] = sums(lone) / per
    out[:, 4] = sums(capital) / per
    out[:, 6] = (stops[offsets[1:]] - stops[offsets[:-1]]) / per
    out[:, 7] = sums(size) / per
    raw = data.tobytes()
    for i in np.flatnonzero(n > 0).tolist():
        a, b = edge[i], edge[i + 1]
        out[i, 5] = len(np.unique(hashes[a:b])) / n[i] ** 0.75  # variety falls slowly with length
        lines = [x for x in raw[offsets[i]:offsets[i + 1]].split(b"\n") if x.strip()]
        out[i, 8] = 1 - len(set(lines)) / len(lines) if len(lines) > 2 else -1
    return out


def votes(f: np.ndarray) -> np.ndarray:
    """Votes of the labellers (columns in their order) from ``figures``."""
    n = f[:, 0]

    def vote(bad, good):
        return np.where(n == 0, BAD, np.where(bad, BAD, np.where(good, GOOD, NONE)))

    enough = n >= 20
    return np.stack([
        vote(f[:, 1] > 0.2, enough & (f[:, 1] < 0.02)),
        vote(f[:, 2] > 0.4, enough & (f[:, 2] < 0.1)),
        vote(f[:, 3] > 0.15, enough & (f[:, 3] < 0.02)),
        vote(enough & (f[:, 4] > 0.4), enough & (f[:, 4] < 0.1)),
        vote(enough & (f[:, 5] < 0.8), enough & (f[:, 5] > 1.5)),
        vote(f[:, 8] > 0.4, (f[:, 8] >= 0) & (f[:, 8] < 0.1)),
        vote(enough & ((f[:, 6] > 0.7) | (f[:, 6] < 0.002)), (f[:, 6] > 0.02) & (f[:, 6] < 0.4)),
        vote((f[:, 7] > 25) & enough, (f[:, 7] > 2.5) & (f[:, 7] < 15))], axis=1).astype(np.int64)


def estimate(patterns: np.ndarray, counts: np.ndarray, prior_bad: float = 0.1, rounds: int = 200):
    """EM over vote patterns. A document is good, or bad in one way of as many as there are labellers.

    Way k begins as what labeller k alone finds, and keeps at least half of its bad votes there; labellers that
    find the same documents come to share ways. Given the class, votes are independent; a labeller that is
    silent says nothing. Returns the probability of a bad document for each pattern, and the rates of bad votes
    of every labeller (columns) in good documents (row 0) and in each way.
    """
    k = patterns.shape[1]
    says_bad, speaks = (patterns == BAD).astype(float), (patterns != NONE).astype(float)
    says_good = speaks - says_bad
    start = np.vstack([np.full(k, 0.02), np.full((k, k), 0.1) + 0.8 * np.eye(k)])
    low, high = np.full((k + 1, k), 1e-6), np.full((k + 1, k), 1 - 1e-6)
    high[0], low[1:] = 0.2, np.where(np.eye(k) > 0, 0.5, 1e-6)
    prior = np.concatenate([[1 - prior_bad], np.full(k, prior_bad / k)])
    rate, share, weight = start, prior, counts.astype(float)
    for _ in range(rounds):
        log = says_bad @ np.log(rate).T + says_good @ np.log(1 - rate).T + np.log(share)
        p = np.exp(log - log.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w = p * weight[:, None]
        # the start counts as ten documents of each class
        rate = np.clip((w.T @ says_bad + 10 * start) / (w.T @ speaks + 10), low, high)
        share = (w.sum(axis=0) + 10 * prior) / (weight.sum() + 10)
    return 1 - p[:, 0], rate


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """Square roots of the shares of hashed shape 4-grams, and of repeated neighbours, for each text."""
    data, offsets = buffer_of(texts)
    kind = _KIND[data]
    gram = np.zeros(len(data), np.int64)
    if len(data) > 3:
        code = ((kind[:-3] * 64 + kind[1:-2]) * 64 + kind[2:-1]) * 64 + kind[3:]
        gram[:-3] = (code * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - 13)
    starts, ends = word_bounds(data, offsets)
    hashes, edge = word_hashes(data, starts, ends), np.searchsorted(starts, offsets)
    for i in range(len(texts)):
        a, b = offsets[i], max(offsets[i], offsets[i + 1] - 3)
        out = np.zeros(SLOTS + RELATIONS)
        if b > a:
            out[:SLOTS] = np.sqrt(np.bincount(gram[a:b], minlength=SLOTS) / (b - a))
        w = hashes[edge[i]:edge[i + 1]]
        for back in range(1, RELATIONS):
            if len(w) > back:
                out[SLOTS + back - 1] = np.sqrt(np.mean(w[back:] == w[:-back]))
        out[-1] = 1
        yield out


def train(x: np.ndarray, y: np.ndarray, fit: Fit) -> np.ndarray:
    """Weights of a logistic regression by full-batch gradient steps with adaptive rates, from zero."""
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    of = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum()))  # both kinds weigh the same
    for t in range(1, 10 * fit.epochs + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (of * (p - y)) + fit.ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= fit.rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def vote_codes(docs: DataFrame) -> DataFrame:
    """pattern (votes in base three) and key of rows (text, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = 3 ** np.arange(len(LABELLERS))
        for batch in batches:
            for lo, hi in slices(batch.column(0), PART):
                code = votes(figures(batch.column(0).slice(lo, hi - lo))) @ power
                yield pa.RecordBatch.from_arrays([pa.array(code), batch.column(1).slice(lo, hi - lo)], ["pattern", "key"])

    return docs.transform(shipped).mapInArrow(lean(run), "pattern long, key long")


@dataclass(frozen=True)
class Model:
    """Posterior of vote patterns, rates of the labellers, and weights of the scorer (None without training)."""

    posterior: dict[int, float]
    rates: np.ndarray
    weights: np.ndarray | None
    threshold: float

    def bad(self, texts: pa.Array) -> np.ndarray:
        """Probability of a bad document; 1 for a text without words."""
        words = np.diff(np.searchsorted(word_bounds(*buffer_of(texts))[0], buffer_of(texts)[1]))
        power = 3 ** np.arange(len(LABELLERS))
        by_votes = lambda t: np.array([self.posterior.get(int(c), 0.0) for c in votes(figures(t)) @ power])
        if self.weights is None:
            p = by_votes(texts)
        else:
            p = np.fromiter((1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))) for x in features(texts)), float, len(texts))
            few = np.flatnonzero((words > 0) & (words < FEW))
            if len(few):
                p[few] = by_votes(texts.take(pa.array(few)))
        return np.where(words == 0, 1.0, p)


def learn(docs: DataFrame, fit: Fit = Fit(), text_col: str = "text") -> Model:
    """Votes of all documents, EM over their patterns, and a scorer trained on the posterior of a bounded sample."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    power = 3 ** np.arange(len(LABELLERS))
    # equal texts have one vote pattern and are one text of the sample
    with small_batches(docs.sparkSession):
        coded = stored(vote_codes(texts.withColumn("key", F.xxhash64("text"))).groupBy("key", "pattern").agg(F.count(F.lit(1)).alias("n")))
    counted = coded.groupBy("pattern").agg(F.sum("n")).collect()  # at most 3 ** labellers rows
    codes = np.array([r[0] for r in counted], np.int64)
    counts = np.array([r[1] for r in counted], np.int64)
    bad, rates = estimate(codes[:, None] // power % 3, counts, fit.prior_bad)
    posterior = dict(zip(codes.tolist(), bad.tolist()))
    if not (bad > 0.5).any() or not (bad <= 0.5).any():
        return Model(posterior, rates, None, fit.threshold)
    sample: dict[int, float] = {}
    for kind in (codes[bad > 0.5], codes[bad <= 0.5]):
        # at most ``sample`` rows of each kind: the smallest hashes
        for key, pattern in coded.filter(F.col("pattern").isin(kind.tolist())).select("key", "pattern") \
                .orderBy(F.xxhash64("key"), "key").limit(fit.sample).collect():
            sample[key] = posterior[pattern]
    keys = docs.sparkSession.sparkContext.broadcast(np.array(sorted(sample), np.int64))  # at most twice the sample

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of the sample."""
        for batch in batches:
            own = batch.column(1).to_numpy()
            at = np.minimum(np.searchsorted(keys.value, own), len(keys.value) - 1)
            yield batch.filter(pa.array(keys.value[at] == own))

    def weigh(table: pa.Table) -> pa.Table:
        y = np.array([sample[k] for k in table.column("key").to_pylist()])
        order = np.lexsort((table.column("key").to_numpy(), y))  # the sum does not depend on the order rows arrive in
        x = np.empty((len(order), SLOTS + RELATIONS))
        for row, one in zip(x, features(table.column("text").take(pa.array(order)).combine_chunks())):
            row[:] = one.astype(np.float32)
        w = train(x, y[order], fit)
        return pa.table({"slot": pa.array(np.arange(len(w))), "w": pa.array(w)})

    rows = texts.withColumn("key", F.xxhash64("text")).transform(shipped).mapInArrow(drawn, "text string, key long") \
        .groupBy("key").agg(F.first("text").alias("text"))
    trained = rows.withColumn("grp", F.pmod("key", F.lit(fit.groups))).groupBy("grp").applyInArrow(weigh, "slot long, w double") \
        .groupBy("slot").agg(F.avg("w"))
    with small_batches(docs.sparkSession):
        trained = trained.collect()  # one row per feature
    weights = np.zeros(SLOTS + RELATIONS)
    for slot, w in trained:
        weights[slot] = w
    return Model(posterior, rates, weights if trained else None, fit.threshold)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, bad (probability) and kept of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the weights: a fixed number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1), PART):
                part = batch.slice(lo, hi - lo)
                bad = shared.value.bad(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bad), pa.array(bad < shared.value.threshold)],
                                                 ["doc_id", "bad", "kept"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")) \
        .transform(shipped).mapInArrow(lean(run), "doc_id long, bad double, kept boolean")


def kept_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Documents that the scorer keeps, with all their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.large_string()).fill_null("")
            for lo, hi in slices(texts, PART):
                keep = shared.value.bad(texts.slice(lo, hi - lo)) < shared.value.threshold
                yield batch.slice(lo, hi - lo).filter(pa.array(keep))

    return docs.transform(shipped).mapInArrow(lean(run), docs.schema)

"""Near duplicates, components and fingerprints against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cases import awkward, nothing, prose, texts
from loomcast.llm import fingerprints, near_dedup
from loomcast.llm.components import components
from loomcast.llm.superminhash import signatures
from loomcast.llm.words import words_of

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_set(text, k):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def plain_components(rows, k, per_hundred=80):
    """{position: (set size, smallest id reachable)}."""
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and both * 100 >= per_hundred * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    out = {}
    for group in members.values():
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            out[i] = (len(sets[i]), min(ids) if ids else None)
    return out


def changed(text, seed, times):
    r, w = random.Random(seed), text.split(" ")
    for _ in range(times):
        w[r.randrange(len(w))] = f"new{seed}x{r.randrange(1000)}"
    return " ".join(w)


def near_rows():
    base, other = prose(11, 150), prose(12, 300)
    rows = [(100 + i, changed(base, i, i % 12)) for i in range(60)]
    rows += [(300 + i, changed(other, i, i % 30)) for i in range(40)]
    rows += [(500 + i, prose(1000 + i, 25) + " " + base[:400]) for i in range(30)]  # a shared passage
    rows += [(700 + i, prose(20 + i // 2, 5)) for i in range(10)]
    return rows + [(50, base), (900, None), (901, ""), (902, "one two")]


@pytest.mark.parametrize("block, k", [(4000, 5), (9, 4)])
def test_components_equal_brute_force(spark, block, k):
    rows = near_rows()
    want = {rows[i][0]: v for i, v in plain_components(rows, k).items()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df, near_dedup.Near(words=k, block=block)).collect()
    assert {r[0]: (r[1], r[2], r[3]) for r in got} == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_awkward_rows(spark):
    df = awkward(spark)
    got = near_dedup.near_duplicates(df, near_dedup.Near(words=4)).collect()
    assert len(got) == df.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[2]["component_id"] == by[3]["component_id"] == 1 and by[1]["kept"] and not by[2]["kept"]
    assert by[11]["component_id"] == 10  # capitals and white space do not count
    assert all(by[i]["n_shingles"] == 0 and by[i]["kept"] and by[i]["component_id"] == i for i in (4, 5, 6))
    nulls = sorted((r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is None)
    assert nulls[0] == (0, None, True) and nulls[1][1:] == (1, False)
    assert near_dedup.near_duplicates(nothing(spark)).count() == 0


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components_of_long_chains_and_hubs(spark, monkeypatch, one_task):
    from loomcast.llm import components as module

    monkeypatch.setattr(module, "ONE_TASK", one_task)
    rng = random.Random(2)
    order = list(range(300))
    rng.shuffle(order)
    links = list(zip(order, order[1:])) + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (7000, 6000)]
    df = spark.createDataFrame(links, "a long, b long").repartition(8)
    got = {r[0]: r[1] for r in components(df).collect()}
    want = {i: 0 for i in range(1, 300)} | {1000 + i: 1000 for i in range(1, 200)} | {7000: 6000}
    assert got == want


def test_signatures_estimate_similarity_and_stop_early_without_change():
    rng = np.random.default_rng(4)
    common, m = rng.integers(0, 2**63, 800, dtype=np.uint64), 160
    a = np.unique(np.concatenate([common, rng.integers(0, 2**63, 200, dtype=np.uint64)]))
    b = np.unique(np.concatenate([common, rng.integers(0, 2**63, 200, dtype=np.uint64)]))
    small = a[:3]
    s = signatures(np.concatenate([a, b, small]), np.array([0, len(a), len(a) + len(b), len(a) + len(b) + 3]), m)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.12
    # an element's offers are a permutation: every position of a single element's signature has its own step
    one = signatures(a[:1], np.array([0, 1]), m)[0]
    assert sorted(np.floor(one).astype(int)) == list(range(m))
    assert (s[2] == np.min([signatures(x[None], np.array([0, 1]), m)[0] for x in small], axis=0)).all()
    assert np.isinf(signatures(a[:0], np.array([0, 0]), m)).all()


def test_words_and_hashes():
    hashes, edge = words_of(pa.array(["Ab  c\x0bd", None, "", "AB c", "é\u00a0x ab"]))
    assert np.diff(edge).tolist() == [3, 0, 0, 2, 2]
    assert hashes[0] == hashes[3] == hashes[6] and hashes[1] == hashes[4] and len(set(hashes.tolist())) == 4


def plain_edit(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (name, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        out.append((name, len(text), hashlib.sha256((text[:len(text) - half] + after[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("which", ["awkward", "prose", "one"])
def test_edited_texts_and_neighbours(spark, which):
    df = awkward(spark) if which == "awkward" else spark.createDataFrame(
        [(3 * i, prose(i, 5 + i)) for i in range(300 if which == "prose" else 1)], "doc_id long, text string")
    got = fingerprints.compared(df).collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == plain_edit(texts(df))
    if which == "prose":
        by = {r["doc_id"]: r for r in got}
        for r in got:
            after = by.get(r["doc_id"] + 3, by[0])
            bits = lambda h: np.frombuffer(bytes.fromhex(h), np.uint8)[None]
            assert r["near_next"] == fingerprints.likeness(bits(r["fingerprint"]), bits(after["fingerprint"]))[0]
            assert r["near_edited"] == fingerprints.likeness(bits(r["fingerprint"]), bits(r["edited_fingerprint"]))[0]
        assert np.mean([r["near_edited"] > r["near_next"] for r in got if r["doc_id"] > 60]) > 0.95
    assert fingerprints.compared(nothing(spark)).count() == 0


def test_equal_texts_have_equal_fingerprints(spark):
    got = fingerprints.fingerprint(awkward(spark)).collect()
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["fingerprint"])
    assert by[1] == by[2] and by[4] == by[5] == by[6] == {"0" * 32}


@pytest.mark.parametrize("radius, blocks", [(3, 4), (6, 8), (0, 4)])
def test_search_finds_all_within_the_radius(spark, radius, blocks):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2, (20, 128), dtype=np.uint8)
    prints = [base[i % 20].copy() for i in range(200)]
    for i, p in enumerate(prints):
        p[rng.choice(128, i % 9, replace=False)] ^= 1
    text = [np.packbits(p).tobytes().hex() for p in prints]
    df = spark.createDataFrame([(t,) for t in text], "fingerprint string")
    got = {(r[0], r[1], r[2]) for r in fingerprints.within_radius(df.limit(40), df, radius, blocks).collect()}
    asked = {r[0] for r in df.limit(40).collect()}
    want = set()
    for i, a in enumerate(text):
        for j, b in enumerate(text):
            d = int((prints[i] != prints[j]).sum())
            if a in asked and d <= radius:
                want.add((a, b, d))
    assert got == want


def test_search_counts_documents(spark):
    df = spark.createDataFrame([(i, prose(i // 3, 40)) for i in range(120)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_within"] for r in fingerprints.searched(df, every=10).collect()}
    assert all((n is None) == bool(i % 10) for i, n in got.items()) and all(got[i] >= 3 for i in got if i % 10 == 0)
    assert fingerprints.searched(nothing(spark)).count() == 0


@pytest.mark.parametrize("radius, blocks", [(22, 8), (9, 8), (8, 4), (40, 32)])
def test_search_finds_all_within_a_wide_radius(spark, radius, blocks):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2, (8, 128), dtype=np.uint8)
    prints = [base[i % 8].copy() for i in range(240)]
    for i, p in enumerate(prints):
        p[rng.choice(128, i % (radius + 5), replace=False)] ^= 1
    text = [np.packbits(p).tobytes().hex() for p in prints]
    df = spark.createDataFrame([(t,) for t in text], "fingerprint string")
    got = sorted((r[0], r[1], r[2]) for r in fingerprints.within_radius(df.limit(40), df, radius, blocks).collect())
    want = {(a, b, int((p != q).sum())) for a, p in list(zip(text, prints))[:40] for b, q in zip(text, prints)}
    assert got == sorted(w for w in want if w[2] <= radius)


def test_search_counts_edited_texts(spark):
    rows = []
    for k in range(4):
        words = prose(50 + k, 400).split(" ")
        for e in range(10):  # document 10k and nine copies with up to six of 400 words changed each
            w, r = list(words), random.Random(e)
            for at in r.sample(range(len(w)), 6 * (e > 0)):
                w[at] = f"edit{e}"
            rows.append((10 * k + e, " ".join(w)))
    plain = dict(rows)
    for k in range(4):
        for e in range(1, 10):
            a, b = shingle_set(plain[10 * k], 5), shingle_set(plain[10 * k + e], 5)
            assert len(a & b) >= 0.8 * len(a | b)
    got = {r["doc_id"]: r["n_within"] for r in fingerprints.searched(spark.createDataFrame(rows, "doc_id long, text string"), every=10).collect()}
    assert [got[10 * k] for k in range(4)] == [10] * 4


@pytest.mark.parametrize("start, step", [((1 << 62) + 1, 3), (-(1 << 63), 1 << 58), ((1 << 63) - 200, 1)])
def test_neighbours_of_ids_beyond_doubles(spark, start, step):
    n = 64 if step > 3 else 200
    rows = [(start + step * i, prose(i, 12)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.compared(df).collect()}
    want = {i: hashlib.sha256(fingerprints.edited(t, rows[(k + 1) % n][1]).encode()).hexdigest() for k, (i, t) in enumerate(rows)}
    assert got == want


def test_words_of_one_structure_are_not_alike(spark):
    """Documents of words that a polynomial hash cannot tell apart stay apart in near_dedup and fingerprints."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join([one] * 30)), (2, " ".join([two] * 30)), (3, one[:1024]), (4, two[:1024])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in near_dedup.near_duplicates(docs, near_dedup.Near(words=4)).collect()}
    assert [out[i].component_id for i in (1, 2, 3, 4)] == [1, 2, 3, 4]
    prints = {r.doc_id: r.fingerprint for r in fingerprints.searched(docs).collect()}
    assert len(set(prints.values())) == 4


def test_repeated_rows_meet_the_comparison_once(spark, monkeypatch):
    base = prose(8, 80)
    rows = [(1, base)] * 50 + [(2, base + " more")] * 50
    seen = []
    plain = near_dedup.sets_of
    monkeypatch.setattr(near_dedup, "sets_of", lambda texts, near: seen.append(texts) or plain(texts, near))
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {r.component_id for r in out.collect()} == {1} and seen[0].count() == 2

"""Ranked lexical search against plain loops over all documents and items."""

import math
import random
import re
from collections import Counter

import pytest

from cases import awkward, nothing, prose, texts
from loomcast.llm import lexical_search

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(UPPER))


def plain(docs, items, top=10):
    bags = [(d, words(t)) for d, t in docs]
    bags = [(d, Counter(w), len(w)) for d, w in bags if w]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        found = []
        for doc, bag, n in bags:
            m, score = 10 + (90 * n * n_docs) // total, 0
            for t in set(words(text)) & set(bag):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def got(docs, items, **more):
    return sorted((tuple(r) for r in lexical_search.search(docs, items, **more).collect()), key=repr)


@pytest.fixture(scope="module")
def items(spark):
    shared = prose(1, 30)
    rows = [(1, shared), (2, shared + " extra one"), (3, prose(2, 50)), (3, "one"), (None, "One TWO three 日本"), (5, None), (6, ""), (7, " .,; "),
            (8, "x" * 50000), (9, prose(3, 20) + " " + shared), (10, "nowhere to befound")]
    return spark.createDataFrame([(a, b, 0) for a, b in rows], "item_id long, text string, rank int")


def test_equals_plain_loops(spark, items):
    docs = awkward(spark)
    assert got(docs, items) == plain(texts(docs), [(r[0], r[1]) for r in items.collect()])


def test_ties_and_small_blocks(spark, items, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i % 7, 40)) for i in range(90)], "doc_id long, text string").repartition(5)
    want = plain(texts(docs), [(r[0], r[1]) for r in items.collect()], 4)
    assert got(docs, items, top=4) == want
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 3)
    assert got(docs, items, top=4) == want


def test_small_slices_keep_the_best():
    rng = random.Random(3)
    best = lexical_search.Best(3, 2)
    import numpy as np

    all_scores = np.array([[rng.randint(0, 5) for _ in range(200)] for _ in range(2)])
    ids = np.array(rng.sample(range(1000), 200))
    for lo in range(0, 200, 7):
        best.add(all_scores[:, lo:lo + 7], ids[lo:lo + 7], np.zeros(len(ids[lo:lo + 7]), bool))
    for item in range(2):
        want = sorted((-s, d) for s, d in zip(all_scores[item].tolist(), ids.tolist()) if s > 0)[:3]
        mine = best.item == item
        assert list(zip((-best.score[mine]).tolist(), best.doc[mine].tolist())) == want


def test_plan_shares_sets_and_keeps_every_term():
    rng = random.Random(5)
    common = list(range(40))
    items = [sorted({*rng.sample(common, 30), 40 + i}) for i in range(25)] + [[], common, common]
    plan = lexical_search.sharing_plan(items, 40 + 25)
    inside = {i: Counter() for i in range(plan.nodes)}
    for term, own in enumerate(plan.set_of.tolist()):
        inside[own][term] += 1
    for level in plan.levels:
        for node, a, b in zip(*(x.tolist() for x in level)):
            inside[node] = inside[a] + inside[b]
    for no, item in enumerate(items):
        nodes = plan.item_node[plan.item_start[no]:plan.item_start[no + 1]].tolist()
        assert sum((inside[n] for n in nodes), Counter()) == Counter(item)
    assert plan.additions < sum(map(len, items)) / 2


def test_empty_tables(spark, items):
    assert got(nothing(spark), items) == []
    assert got(awkward(spark), items.limit(0)) == []


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(lexical_search, "PART", 10)
    text = prose(4, 300)
    assert [w.decode() for part in lexical_search.terms(text.encode()) for w in part] == words(text)

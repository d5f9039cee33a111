"""Conversation repair against a plain search over edits, row by row."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from loomcast.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def plain_repair(rows):
    """Cheapest edits over (rows done, state), by relaxing whole strings until nothing changes."""
    seen, faults, bad = set(), defaultdict(int), []
    for _, role, text in rows:
        body = text.strip(SPACE)
        bad.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
        if bad[-1]:
            faults[bad[-1]] += 1
    nexts = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    layer = {"": (0, "", ())}

    def insert(layer):
        again = True
        while again:
            again = False
            for state, (cost, audit, lines) in list(layer.items()):
                for initial, word in (("u", "user"), ("a", "assistant")):
                    if initial in nexts[state]:
                        new = (cost + 2, audit + "I", (*lines, f"{word}:"))
                        if nexts[state][initial] not in layer or new < layer[nexts[state][initial]]:
                            layer[nexts[state][initial]], again = new, True
        return layer

    for (_, role, text), fault in zip(rows, bad):
        new = {}

        def offer(state, value):
            if state not in new or value < new[state]:
                new[state] = value

        for state, (cost, audit, lines) in insert(layer).items():
            offer(state, (cost + 3, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] in nexts[state]:
                    offer(nexts[state][role[:1]], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                for initial, word in (("u", "user"), ("a", "assistant")):
                    if initial in nexts[state]:
                        offer(nexts[state][initial], (cost + 2 + more, audit + "R", (*lines, f"{word}:{text}")))
        layer = new
    ends = [v for s, v in insert(layer).items() if s in ("", "a")]
    cost, audit, lines = min(ends)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain(rows):
    by = defaultdict(list)
    for conv, turn, role, text in plain_damage(rows):
        by[conv].append((turn, role, text))
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        out[conv] = plain_repair(own) if own else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return out


def got(spark, rows, parts=3):
    found = cr.repair(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    assert len(found) == len({r[0] for r in found})
    return {r[0]: tuple(r[1:]) for r in found}


def some_rows(seed, conversations, most, roles=("user", "assistant", "system", "tool", "User", "")):
    rng, rows = random.Random(seed), []
    for conv in range(conversations):
        for turn in range(rng.randint(1, most)):
            text = rng.choice(["Hello.", "Fine!", "And then", "What?", " \n", "", f"Text {rng.randint(0, 9)}.", "é日本?\t", None])
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn + (rng.random() < 0.1), role, text))
    return list({(r[0], r[1]): r for r in rows}.values())


def test_equals_a_plain_search(spark):
    rows = some_rows(1, 150, 14) + [(None, 0, "user", "Hi."), (None, None, None, None), (900, None, "assistant", "No turn."),
                                    (900, None, "user", "First."), (901, None, None, None), (902, 5, "system", "Alone."), (903, 1, "user", "x" * 300000 + ".")]
    assert got(spark, rows) == plain(rows)


def test_long_conversations_and_many_tasks(spark, monkeypatch):
    """One conversation holds most rows; chunks of few rows and tasks' borders everywhere."""
    rows = some_rows(2, 12, 6) + [(77, t, ("user", "assistant", "system")[(t * t) % 3], f"Row {t % 40}{'.!'[t % 2] if t % 5 else ''}") for t in range(400)]
    rows = [(c + 1000 if c < 12 else c, t, r, x) for c, t, r, x in rows]
    want = plain(rows)
    assert got(spark, rows) == want
    monkeypatch.setattr(cr, "ROWS", 7)
    monkeypatch.setattr(cr, "BYTES", 60)
    chunk_rows = list(cr._runs(iter(_batches([(1, 0, "user", "a" * 30)] * 20 + [(2, 0, "user", "b")] + [(3, 0, "u", "c")], 6))))
    assert [t.num_rows for t, _ in chunk_rows] == [2] * 10 + [1, 1] and [w for _, w in chunk_rows] == [False] * 10 + [True, False]


def _batches(rows, size):
    import pyarrow as pa

    for lo in range(0, len(rows), size):
        part = rows[lo:lo + size]
        yield pa.RecordBatch.from_pydict({"conv": [r[0] for r in part], "turn": [r[1] for r in part], "role": [r[2] for r in part],
                                          "text": [r[3] for r in part]})


@pytest.mark.parametrize("length", range(1, 5))
def test_all_short_sequences(length):
    """Every sequence of symbols against the plain search."""
    kinds = {"s-": ("system", "{}."), "st": ("system", "{}"), "u-": ("user", "{}."), "ut": ("user", "{}"), "a-": ("assistant", "{}!"),
             "at": ("assistant", "{}"), "x-": ("tool", "{}?"), "xt": ("tool", "{}"), "xd": ("user", " ")}
    sequences = list(itertools.product(kinds, repeat=length))
    if length == 4:
        sequences = random.Random(4).sample(sequences, 1500)
    found = cr.matrices(sequences)
    for sequence in sequences:
        rows = [(i, kinds[k][0], kinds[k][1].format(f"t{i}")) for i, k in enumerate(sequence)]
        want = plain_repair(rows)
        assert cr.cheapest(found[sequence][cr.START]) == (want[5], want[6]), sequence


def test_chunks_fold_to_the_whole():
    """Matrices of chunks, folded one after another, give the edits of the whole sequence."""
    rng = random.Random(9)
    for _ in range(60):
        whole = tuple(rng.choice(["s-", "u-", "ut", "a-", "at", "x-", "xd"]) for _ in range(rng.randint(2, 40)))
        cut = rng.randint(1, len(whole) - 1)
        fold = cr.Fold(1)
        for part, piece in enumerate((whole[:cut], whole[cut:])):
            cells = [c for row in cr.matrices([piece])[piece] for c in row]
            fold.add({"part": part, "no": 0, "first": "u", "last": "u", "turn_lo": None, "turn_hi": None, "n_turns": 0, "blank": 0, "duplicate": 0,
                      "truncated": 0, "illegal": 0, "costs": [c and c[0] for c in cells], "audits": [c and "".join(cr.letters(c[1])) for c in cells]})
        row, places = fold.result()
        assert (row[6], row[7]) == cr.cheapest(cr.matrices([whole])[whole][cr.START])
        assert "".join(p[3] for p in places) == row[7] and places[0][2] == cr.START


def test_rules_are_shared():
    sequences = [["u-", "a-"] * 30, ["s-"] + ["u-", "a-"] * 30, ["u-", "u-", "u-", "u-", "u-"]]
    short, rules = cr.grammar([list(s) for s in sequences])

    def spelt(x):
        return [x] if isinstance(x, str) else spelt(rules[x][1]) + spelt(rules[x][2])

    assert [[s for x in row for s in spelt(x)] for row in short] == sequences
    assert len(rules) + sum(map(len, short)) < 30


def test_empty_table_and_other_columns(spark):
    assert cr.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = some_rows(5, 20, 5)
    more = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as part", "2 as cost", "3 as conv", "'x' as audit")
    assert {r[0]: tuple(r[1:]) for r in cr.repair(more).collect()} == plain(rows)

"""Faults of conversations and their cheapest repair, by dynamic programming over a grammar.

A conversation is the sequence of its rows' role initials and faults. The initials of a repaired one are
``(s?(ua)+)?``, an automaton of four states. A row is a min-plus matrix over these states: the cheapest cost from
state to state, with the string of edits that has it. ``grammar`` finds pairs of symbols that repeat in the sequences
of a batch (Re-Pair); every rule's matrix is the product of two, computed once from the bottom up and shared by all
conversations that contain it. Edit strings are ropes: a product refers to the two parts and copies nothing. Of equal
costs the ASCII-least string is taken. That is sound part by part: two strings of one cost for the same rows are never
one the other's beginning, as what is longer has more insertions and so costs more.

Rows are range-partitioned by conversation and turn, so that a long conversation lies in many tasks. A task cuts its
rows into chunks of one conversation, bounded in rows and bytes. A conversation that begins and ends inside a task as
one chunk is finished there. Those that touch a task's border, or are long, follow a second path: repeats across chunks
are found by an aggregation, each chunk gives its matrix, a streamed fold over a conversation's chunks picks the edits,
and a streamed hash takes the repaired chunks. Only that fold's edit string and that hash are sequential, as the result
is one string and SHA-256 is; both hold one chunk and the edit string at a time.

Nulls and empties: a null conv_id is a conversation of its own; null role and text are one space; null turns come first
and count in no gap. Rows of one turn are ordered by role, the text's first 32 characters and its hash. Repeated rows
are duplicates. A conversation without rows, an empty table: defined below, empty. Other columns are ignored. A very
long text is a chunk of its own.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from loomcast.llm.storage import partitions, stored
from loomcast.shipping import shipped

ROWS, BYTES = 1024, 1 << 20  # of a chunk
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_SPACE = " \t\n\x0b\x0c\r"
# edits of the task: keep, rerole, delete, insert, and what an undeleted truncated row adds
RULES = {"K": 0, "R": 2, "D": 3, "I": 2, "cut": 1}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
CHUNK = "part int, no long, turns array<long>, roles array<string>, texts array<string>"


# --- min-plus matrices with ropes ---------------------------------------------------------------------------------

def letters(rope) -> Iterator[str]:
    """The strings that a rope is made of."""
    todo = [rope]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        else:
            todo += (x[1], x[0])


def _less(a, b) -> bool:
    """Whether rope ``a`` comes before ``b``; a part that both share at one place is passed over."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y or x == "" and y == "":
            continue
        if not isinstance(x, str):
            left += (x[1], x[0])
            right.append(y)
        elif not isinstance(y, str):
            left.append(x)
            right += (y[1], y[0])
        else:
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x < y
            if x[n:]:
                left.append(x[n:])
            if y[n:]:
                right.append(y[n:])
    return not left and bool(right)


def better(a, b):
    """The cheaper of two (cost, rope), or the ASCII-least of equal ones; None is none."""
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if _less(b[1], a[1]) else a


def times(a: list, b: list) -> list:
    """Product of two matrices, as lists of four rows."""
    out = []
    for row in a:
        new = [None] * 4
        for k, x in enumerate(row):
            if x is not None:
                for j, y in enumerate(b[k]):
                    if y is not None:
                        cost, old = x[0] + y[0], new[j]
                        if old is None or cost < old[0]:
                            new[j] = (cost, (x[1], y[1]))
                        elif cost == old[0] and _less((x[1], y[1]), old[1]):
                            new[j] = (cost, (x[1], y[1]))
        out.append(new)
    return out


def _step(state: int) -> int | None:
    """Where an inserted or reroled row leads."""
    return ASSISTANT if state == USER else USER


def insertions() -> list:
    """The cheapest insertions between any two states."""
    out = []
    for i in range(4):
        row, state, k = [None] * 4, i, 0
        while row[state] is None:
            row[state] = (RULES["I"] * k, "I" * k)
            state, k = _step(state), k + 1
        out.append(row)
    return out


def symbol_matrix(symbol: str) -> list:
    """Insertions, then one row: ``symbol`` is its initial and ``-`` (sound), ``t`` (truncated) or ``d`` (to delete)."""
    initial, fault = symbol
    out = [[None] * 4 for _ in range(4)]
    for i in range(4):
        out[i][i] = (RULES["D"], "D")
        if fault != "d":
            more = RULES["cut"] if fault == "t" else 0
            out[i][_step(i)] = better(out[i][_step(i)], (RULES["R"] + more, "R"))
            if i in NEXT.get(initial, {}):
                j = NEXT[initial][i]
                out[i][j] = better(out[i][j], (RULES["K"] + more, "K"))
    return times(insertions(), out)


def grammar(sequences: list[list]) -> tuple[list[list], list[tuple]]:
    """The sequences with repeated pairs replaced by rules, and the rules (name, left, right), earlier ones first."""
    rules: list[tuple] = []
    while True:
        seen: Counter = Counter()
        for row in sequences:
            at = -1
            for i, pair in enumerate(zip(row, row[1:])):
                # of aaa, the second pair overlaps the first
                if pair[0] == pair[1] and at == i - 1 and row[i - 1] == pair[0]:
                    at = -1
                    continue
                at = i
                seen[pair] += 1
        chosen, taken = {}, set()
        for pair, n in sorted(seen.items(), key=lambda x: (-x[1], str(x[0]))):
            if n > 1 and not taken & set(pair):
                taken |= set(pair)
                name = len(rules)
                rules.append((name, *pair))
                chosen[pair] = name
        if not chosen:
            return sequences, rules
        sequences = [_replaced(row, chosen) for row in sequences]


def _replaced(row: list, chosen: dict) -> list:
    out, i = [], 0
    while i < len(row):
        name = chosen.get((row[i], row[i + 1])) if i + 1 < len(row) else None
        out.append(row[i] if name is None else name)
        i += 1 if name is None else 2
    return out


_SYMBOLS: dict[str, list] = {}


def matrices(sequences: list[tuple[str, ...]]) -> dict[tuple[str, ...], list]:
    """The transfer matrix of every distinct sequence of symbols (which must not be empty)."""
    distinct = list(dict.fromkeys(sequences))
    short, rules = grammar([list(s) for s in distinct])
    known: dict = {}

    def of(name):
        if isinstance(name, str):
            if name not in _SYMBOLS:
                _SYMBOLS[name] = symbol_matrix(name)
            return _SYMBOLS[name]
        return known[name]

    for name, left, right in rules:
        known[name] = times(of(left), of(right))
    out = {}
    for sequence, row in zip(distinct, short):
        while len(row) > 1:  # balanced, so that ropes stay flat
            row = [times(a if isinstance(a, list) else of(a), b if isinstance(b, list) else of(b)) if b is not None else a
                   for a, b in zip(row[::2], row[1::2] + [None] * (len(row) % 2))]
        out[sequence] = row[0] if isinstance(row[0], list) else of(row[0])
    return out


def cheapest(row: list) -> tuple[int, str]:
    """Cost and edits of a conversation from the entries that lead from the start to every state."""
    last = times([row], insertions())[0]
    best = better(last[START], last[ASSISTANT])
    return best[0], "".join(letters(best[1]))


# --- rows of a conversation ---------------------------------------------------------------------------------------

def symbols(roles: list[str], texts: list[str], repeated: set[int] = frozenset()) -> tuple[tuple[str, ...], Counter]:
    """Symbols of the rows and numbers of their faults; ``repeated`` are rows known to repeat one of another chunk."""
    seen, out, faults = set(), [], Counter()
    for i, (role, text) in enumerate(zip(roles, texts)):
        body = text.rstrip(_SPACE)
        fault = "blank" if not body else "duplicate" if i in repeated or (role, text) in seen else \
            "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        # the role of a row that must go does not matter
        out.append("xd" if fault in ("blank", "duplicate") else initial + ("t" if fault else "-"))
    return tuple(out), faults


def illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


def gaps(turns: list) -> int:
    known = [t for t in turns if t is not None]
    return max(known) - min(known) + 1 - len(set(known)) if known else 0


def repaired(roles: list[str], texts: list[str], edits: str, state: int = START) -> list[str]:
    """``role:text`` of the repaired rows; ``state`` is the one before them."""
    out, i = [], 0
    for edit in edits:
        if edit == "D":
            i += 1
            continue
        if edit == "K":
            role, state = roles[i], NEXT[roles[i][:1]][state]
        else:
            role, state = "assistant" if state == USER else "user", _step(state)
        out.append(f"{role}:{'' if edit == 'I' else texts[i]}")
        i += edit != "I"
    return out


# --- Spark jobs ---------------------------------------------------------------------------------------------------

def damaged(rows: DataFrame, columns: tuple[str, str, str, str]) -> DataFrame:
    """The rows after the damage that the CRC-32 of ``conv_id:turn`` picks: conv, turn, role, text."""
    conv, turn, role, text = (F.col(c) for c in columns)
    word = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(word(conv), F.lit(":"), word(turn)).cast("binary")) % 20
    changed = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(word(text), "[.!?]", "")).otherwise(word(text))
    return rows.select(conv.cast("long").alias("conv"), turn.cast("long").alias("turn"), hit.alias("hit"),
                       F.when(hit == 4, "user").otherwise(word(role)).alias("role"), changed.alias("text")) \
        .filter("hit <> 0") \
        .select("conv", "turn", "role", "text", F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(
            F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def in_order(rows: DataFrame) -> DataFrame:
    """Range partitions by conversation and turn; also equal turns and equal rows are spread."""
    keys: list[Column] = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("_head"), F.asc("_hash"), F.asc("_row")]
    keyed = rows.withColumns({"_head": F.substring("text", 1, 32), "_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    return keyed.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys) \
        .select("conv", "turn", "role", "text")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
    """Chunks of one conversation each, and whether a chunk is known to be all of it."""
    rest, first, open_run = None, True, False
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        conv = table.column("conv").combine_chunks()
        names, unnamed = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((names[1:] != names[:-1]) | (unnamed[1:] != unnamed[:-1])) + 1
        starts = np.concatenate([[0], edges])
        size = np.cumsum(pc.binary_length(table.column("text")).to_numpy())
        for a, b in zip(starts, np.concatenate([starts[1:], [table.num_rows]])):
            last = b == table.num_rows
            cut = a
            while b - cut > ROWS or size[b - 1] - (size[cut - 1] if cut else 0) > BYTES and b - cut > 1:
                limit = (size[cut - 1] if cut else 0) + BYTES
                end = min(cut + ROWS, max(cut + 1, int(np.searchsorted(size, limit, "right"))))
                if end >= b:
                    break
                yield table.slice(cut, end - cut), False
                cut, open_run = end, True
            if last:
                rest = table.slice(cut, b - cut)
            else:
                yield table.slice(cut, b - cut), not first and not open_run
                first, open_run = False, False
    if rest is not None:
        yield rest, False


def _finished(whole: list[tuple]) -> list[tuple]:
    """Result rows of whole conversations, given as (conv, turns, roles, texts)."""
    coded = [symbols(roles, texts) for _, _, roles, texts in whole]
    found = matrices([s for s, _ in coded])
    out, done = [], {}
    for (conv, turns, roles, texts), (sequence, faults) in zip(whole, coded):
        if sequence not in done:
            done[sequence] = cheapest(found[sequence][START])
        cost, audit = done[sequence]
        text = "\n".join(repaired(roles, texts, audit))
        out.append((conv, gaps(turns), faults["blank"], faults["duplicate"], faults["truncated"], illegal(roles), cost, audit,
                    hashlib.sha256(text.encode()).hexdigest()))
    return out


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_RESULT = [("conv_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())]
_CHUNK = [("part", pa.int32()), ("no", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())),
          ("texts", pa.list_(pa.string()))]


def chunked(rows: DataFrame) -> DataFrame:
    """Results of the conversations that a task has as a whole, and chunks (``part`` is not null) of the others."""
    schema = pa.schema([*_RESULT, *_CHUNK])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, whole, size = TaskContext.get().partitionId(), 0, [], 0
        for table, complete in _runs(batches):
            conv = table.column("conv")[0].as_py()
            turns, roles, texts = (table.column(c).to_pylist() for c in ("turn", "role", "text"))
            if complete:
                whole.append((conv, turns, roles, texts))
                size += table.num_rows
                if size >= 16 * ROWS:
                    yield _arrow([(*r, *[None] * 5) for r in _finished(whole)], schema)
                    whole, size = [], 0
            else:
                yield _arrow([(conv, *[None] * (len(_RESULT) - 1), part, no, turns, roles, texts)], schema)
                no += 1
        if whole:
            yield _arrow([(*r, *[None] * 5) for r in _finished(whole)], schema)

    return rows.transform(shipped).mapInArrow(run, f"{RESULT}, {CHUNK}")


def repeats(chunks: DataFrame) -> DataFrame:
    """part, no and the rows of a chunk whose role and text an earlier chunk of the conversation has."""
    row = chunks.select("conv_id", "part", "no", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "r"))
    own = row.groupBy("conv_id", "part", "no", F.sha2(F.to_json("r"), 256).alias("what")).agg(F.min("i").alias("i"))
    before = own.groupBy("conv_id", "what").agg(F.min(F.struct("part", "no")).alias("at"))
    # no equal chunk number in two tasks: the pair orders the chunks
    again = own.alias("o").join(before.alias("b"), F.col("o.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("o.what") == F.col("b.what"))) \
        .filter((F.col("o.part") > F.col("b.at.part")) | ((F.col("o.part") == F.col("b.at.part")) & (F.col("o.no") > F.col("b.at.no"))))
    return again.groupBy("part", "no").agg(F.collect_list("i").alias("again"))


_TRANSFER = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("no", pa.int64()), ("first", pa.string()), ("last", pa.string()),
                       ("turn_lo", pa.int64()), ("turn_hi", pa.int64()), ("n_turns", pa.int64()), ("blank", pa.int64()),
                       ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
                       ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
_TRANSFER_DDL = "conv_id long, part int, no long, first string, last string, turn_lo long, turn_hi long, n_turns long, blank long, " \
    "duplicate long, truncated long, illegal long, costs array<long>, audits array<string>"


def transfers(chunks: DataFrame) -> DataFrame:
    """A row per chunk: its counts and its matrix of 16 costs and edit strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 16):
                rows = batch.slice(lo, 16).to_pylist()
                coded = [symbols(r["roles"], r["texts"], set(r["again"] or ())) for r in rows]
                found = matrices([s for s, _ in coded])
                out = []
                for r, (sequence, faults) in zip(rows, coded):
                    known = [t for t in r["turns"] if t is not None]
                    cells = [c for row in found[sequence] for c in row]
                    out.append((r["conv_id"], r["part"], r["no"], r["roles"][0][:1], r["roles"][-1][:1], min(known, default=None),
                                max(known, default=None), len(set(known)), faults["blank"], faults["duplicate"], faults["truncated"],
                                illegal(r["roles"]), [c and c[0] for c in cells], [c and "".join(letters(c[1])) for c in cells]))
                yield _arrow(out, _TRANSFER)

    return chunks.transform(shipped).mapInArrow(run, _TRANSFER_DDL)


def _by_conversation(rows: DataFrame) -> DataFrame:
    """All chunks of a conversation in one task, in order; a task streams them."""
    return rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "no")


class Fold:
    """The chunks of one conversation so far."""

    def __init__(self, conv: int | None):
        self.conv, self.counts, self.places = conv, Counter(), []
        self.first_turn = self.last_turn = self.last = None
        self.row: list = [(0, ()), None, None, None]  # cost and list of edit strings by state

    def add(self, r: dict):
        for name in ("blank", "duplicate", "truncated", "illegal"):
            self.counts[name] += r[name]
        if self.last is not None:
            self.counts["illegal"] += self.last + r["first"] not in ("su", "ua", "au")
        self.last = r["last"]
        if r["turn_lo"] is not None:
            self.counts["turns"] += r["n_turns"] - (self.last_turn == r["turn_lo"])
            self.first_turn = r["turn_lo"] if self.first_turn is None else self.first_turn
            self.last_turn = r["turn_hi"]
        new: list = [None] * 4
        for i, x in enumerate(self.row):
            for j in range(4):
                cost = r["costs"][4 * i + j]
                if x is not None and cost is not None:
                    new[j] = self._better(new[j], (x[0] + cost, (x[1], i, r["audits"][4 * i + j])))
        self.row = new
        self.places.append((r["part"], r["no"]))

    @staticmethod
    def _parts(chain: tuple) -> list[tuple[int, str]]:
        out = []
        while chain:
            out.append(chain[1:])
            chain = chain[0]
        return out[::-1]

    def _better(self, a, b):
        if a is None or a[0] != b[0]:
            return b if a is None or b[0] < a[0] else a
        x, y, chains = a[1], b[1], ([], [])
        while x is not y:  # chains have one link per chunk: up to where they part
            chains[0].append(x[2])
            chains[1].append(y[2])
            x, y = x[0], y[0]
        return b if "".join(chains[1][::-1]) < "".join(chains[0][::-1]) else a

    def result(self) -> tuple[tuple, list[tuple]]:
        """The conversation's row without its hash, and (part, no, state before, edits) of every chunk."""
        best = None
        for i, x in enumerate(self.row):
            for j in ENDS:
                more = insertions()[i][j]
                if x is not None and more is not None:
                    end = (x[0] + more[0], (x[1], i, more[1]))
                    best = end if best is None else self._better(best, end)
        parts = self._parts(best[1])
        state_edits = [(state, edits) for state, edits in parts[:-1]]
        state_edits[-1] = (state_edits[-1][0], state_edits[-1][1] + parts[-1][1])
        known = self.last_turn is not None
        row = (self.conv, self.last_turn - self.first_turn + 1 - self.counts["turns"] if known else 0,
               *[self.counts[c] for c in ("blank", "duplicate", "truncated", "illegal")], best[0], "".join(e for _, e in parts))
        return row, [(*place, *x) for place, x in zip(self.places, state_edits)]


def folded(transfer: DataFrame) -> DataFrame:
    """A row per conversation (``part`` is null), and the edits chosen for each of its chunks."""
    schema = pa.schema([*_RESULT[:-1], ("part", pa.int32()), ("no", pa.int64()), ("state", pa.int32()), ("edits", pa.string())])

    def rows_of(fold: Fold) -> Iterator[pa.RecordBatch]:
        row, places = fold.result()
        yield _arrow([(*row, None, None, None, None)], schema)
        for lo in range(0, len(places), 1000):
            yield _arrow([(fold.conv, *[None] * (len(row) - 1), *p) for p in places[lo:lo + 1000]], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                for r in batch.slice(lo, 64).to_pylist():
                    if fold is not None and fold.conv != r["conv_id"]:
                        yield from rows_of(fold)
                        fold = None
                    fold = fold or Fold(r["conv_id"])
                    fold.add(r)
        if fold is not None:
            yield from rows_of(fold)

    return _by_conversation(transfer).transform(shipped).mapInArrow(
        run, RESULT.rsplit(",", 1)[0] + ", part int, no long, state int, edits string")


def hashed(chunks: DataFrame, chosen: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its repaired rows, streamed over its chunks."""

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("no", pa.int64()), ("n", pa.int64()), ("body", pa.string())])
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                lines = repaired(r["roles"], r["texts"], r["edits"], r["state"])
                yield _arrow([(r["conv_id"], r["part"], r["no"], len(lines), "\n".join(lines))], schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
        conv, sha, begun, any_row = None, hashlib.sha256(), False, False
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if any_row and r["conv_id"] != conv:
                    yield _arrow([(conv, sha.hexdigest())], schema)
                    sha, begun = hashlib.sha256(), False
                conv, any_row = r["conv_id"], True
                if r["n"]:
                    sha.update((("\n" if begun else "") + r["body"]).encode())
                    begun = True
        if any_row:
            yield _arrow([(conv, sha.hexdigest())], schema)

    bodies = chunks.join(chosen.select("part", "no", "state", "edits"), ["part", "no"]).transform(shipped) \
        .mapInArrow(rebuild, "conv_id long, part int, no long, n long, body string")
    return _by_conversation(bodies).mapInArrow(digest, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           damage: bool = True) -> DataFrame:
    """One row per conv_id: gaps, numbers of faults, cost and edits of the cheapest repair, and the repaired rows' hash."""
    columns = (conv_col, turn_col, role_col, text_col)
    if damage:
        after = damaged(rows, columns)
    else:
        conv, turn, role, text = (F.col(c) for c in columns)
        after = rows.select(conv.cast("long").alias("conv"), turn.cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"),
                            F.coalesce(text, F.lit(" ")).alias("text"))
    parts = stored(chunked(in_order(after)))
    result = [c for c, _ in _RESULT]
    chunks = parts.filter(F.col("part").isNotNull()).select("conv_id", *[c for c, _ in _CHUNK])
    chosen = stored(folded(transfers(chunks.join(repeats(chunks), ["part", "no"], "left"))))
    hashes = hashed(chunks, chosen.filter(F.col("part").isNotNull()))
    long = chosen.filter(F.col("part").isNull()).alias("c").join(hashes.alias("h"), F.col("c.conv_id").eqNullSafe(F.col("h.conv_id"))) \
        .select("c.conv_id", *[f"c.{c}" for c in (*COUNTS, "audit")], "h.repaired_sha256")
    done = parts.filter(F.col("part").isNull()).select(result).union(long)
    ids = rows.select(F.col(conv_col).cast("long").alias("conv_id")).distinct()
    none = ids.alias("i").join(done.select(F.col("conv_id").alias("d")), F.col("i.conv_id").eqNullSafe(F.col("d")), "left_anti") \
        .select("conv_id", *[F.lit(0).cast("long").alias(c) for c in COUNTS], F.lit("").alias("audit"),
                F.lit(hashlib.sha256(b"").hexdigest()).alias("repaired_sha256"))
    return done.union(none)

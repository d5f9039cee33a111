"""Byte-level BPE by ranks: Spark's higher-order functions fold the merges over distinct words.

A text is cut into pieces by the vocabulary's pattern. A piece is an array of its bytes' ids; ``aggregate`` folds the
merges over it: every step joins the leftmost pair of lowest rank and looks up the two new neighbours, until no pair
has a rank (a rank is the id of the joined token). The ranks of pairs are one array in which a pair stands in one of two
places, as a plain map would be searched entry by entry. It is the value of a subquery, not a literal: Spark writes a
literal out in the text of every plan, and the driver keeps those texts. A step over a piece of more than ``LONG``
bytes joins all pairs of the lowest rank from the left, unless that would make a pair of a still lower rank at any
point: then it joins the leftmost pair only. Both ways give the same tokens.

All pieces of the table are counted, and the ``remembered`` most frequent ones of at most ``LONG`` bytes are folded
once, as a table of distinct words of bounded size that every worker holds. A document's other pieces, each once, are
folded where the document is. Which pieces are remembered changes no result. Arrow tasks only put the ids of known
pieces in their places; no document and no word list is shuffled.

Decoding concatenates the tokens' bytes.

Nulls and empties: a null or empty text has no ids and decodes to nothing. Rows with equal or null ids are
encoded one by one; an empty table gives an empty result; other columns are ignored. A very long text needs
memory in proportion to its own length, a very long piece time in proportion to its length times the number of
ranks that occur in it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loomcast.llm.bpe import spread
from loomcast.llm.memory import give_back
from loomcast.llm.storage import fresh, partitions
from loomcast.llm.words import buffer_of, word_hashes
from loomcast.shipping import shipped

LONG = 64  # bytes of a piece
REMEMBERED = 700_000


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), use), F.lit(1))


def whole_tokens(path: str) -> dict[str, int]:
    """The tokens that a piece of text can be equal to."""
    out = {}
    for token, rank in load_ranks(path).items():
        try:
            out[token.decode()] = rank
        except UnicodeDecodeError:
            pass
    return out


ODD = (0x5BD1D, 0x3A8F5)  # the two places of a pair in its table are middle bits of its products with these


def _slots(keys: list[int], entries: list[int]) -> list[int]:
    """Every entry in the lower or upper half of an array, at one of its key's two places; zero where there is none."""
    half = 1 << max(10, (len(keys) * 21 // 20).bit_length())
    while True:
        held = [-1] * (2 * half)
        for i in range(len(keys)):
            side = 0
            for _ in range(500):
                at = side * half + (keys[i] * ODD[side] >> 18 & half - 1)
                held[at], i = i, held[at]
                if i < 0:
                    break
                side = int(at < half)  # the one that stood there goes to its other place
            else:
                break
        else:
            return [0 if i < 0 else entries[i] for i in held]
        half *= 2


def _pair_slots(ranks: dict[bytes, int], span: int) -> list[int]:
    """All pairs of tokens that make a token, as numbers left, right, token, dealt by ``_slots``."""
    keys, entries = [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                keys.append(a * span + b)
                entries.append(keys[-1] * span + rank)
    return _slots(keys, entries)


@dataclass(frozen=True)
class Merges:
    """The fold over one vocabulary; ``table`` is the array made by ``_pair_slots``, bound by ``_let``."""

    table: Column
    half: int  # of the table's length
    ones: Column  # a short piece's number of a byte that is the last one, by the byte
    twos: Column  # of a byte before another one, by both

    SPAN = 1 << 20  # above every id: a pair and its id are one number
    NONE = 1 << 20  # rank of a pair that makes no token
    PLACES = 1 << 24  # above every place in a piece
    LOW = 28  # bits of an id and of a place in a short piece

    @classmethod
    @lru_cache(maxsize=4)
    def arrays(cls, path: str) -> pa.Table:
        """One row of the arrays ``table``, ``ones`` and ``twos``."""
        ranks = load_ranks(path)
        if max(ranks.values()) >= cls.SPAN - 1:
            raise ValueError("too many ids for one number per pair")
        ones = [(cls.NONE << cls.LOW) + ranks[bytes([b])] for b in range(256)]
        twos = [(ranks.get(bytes([a, b]), cls.NONE) << cls.LOW) + ranks[bytes([a])] for a in range(256) for b in range(256)]
        columns = (_pair_slots(ranks, cls.SPAN), ones, twos)
        return pa.table([pa.array([x], pa.list_(pa.int64())) for x in columns], ["table", "ones", "twos"])

    @classmethod
    def put(cls, df: DataFrame, name: str, path: str, use: Callable[[Merges], Column]) -> DataFrame:
        """``df`` with a column that is made by the fold."""
        arrays = cls.arrays(path)
        half = len(arrays["table"][0]) // 2
        one_row = df.sparkSession.createDataFrame(arrays).select(F.struct(*arrays.column_names)).scalar()
        # a higher-order function takes a subquery only by a column's name; Spark puts it in place of a name used once
        held = fresh(df, "arrays")
        value = _let(F.col(held), lambda row: _let(row["table"], lambda table: _let(row["ones"], lambda ones: _let(
            row["twos"], lambda twos: use(cls(table, half, ones, twos))))))
        return df.withColumn(held, one_row).select(*df.columns, value.alias(name))

    def _rank(self, a: Column, b: Column) -> Column:
        """Id of the token that a pair makes, NONE for no token or no right part."""

        def found(key: Column) -> Column:
            at = lambda odd: F.shiftright(key * F.lit(odd), 18).bitwiseAND(F.lit(self.half - 1)).cast("int")
            one, two = F.get(self.table, at(ODD[0])), F.get(self.table, at(ODD[1]) + F.lit(self.half))
            rank = lambda e: e.bitwiseAND(F.lit(self.SPAN - 1))
            return F.when(F.shiftright(one, 20) == key, rank(one)).when(F.shiftright(two, 20) == key, rank(two)) \
                .otherwise(F.lit(self.NONE).cast("bigint"))

        return _let(F.shiftleft(a, 20) + b, found)

    def _pair(self, a: Column, b: Column) -> Column:
        """``_rank`` before the id ``a`` in one number."""
        return self._rank(a, b) * F.lit(self.SPAN) + a

    @classmethod
    def _id(cls, entry: Column) -> Column:
        return entry.bitwiseAND(F.lit(cls.SPAN - 1))

    def _chain(self, ids: Column) -> Column:
        return F.transform(ids, lambda a, i: self._pair(a, F.get(ids, i + 1)))

    def ids(self, piece: Column) -> Column:
        """Ids of a piece that is no token itself. The state has, for every id, the rank of its pair with the next one."""
        # one character per byte
        letters = F.split(F.decode(piece.cast("binary"), "ISO-8859-1"), "")
        values = F.transform(letters, F.ascii)
        folded = F.when(F.octet_length(piece) > LONG, self._fold_long(piece, values)).otherwise(self._fold_short(piece, values))
        return folded.cast("array<int>")

    def _fold_short(self, piece: Column, values: Column) -> Column:
        """A number has rank, place of the first byte and id, so the least one is the leftmost pair of lowest rank.

        Before the first stands an id that makes no pair, so that every id has one before it.
        """
        keep, before = F.lit((1 << self.LOW) - 1), (self.NONE << self.LOW) + (1 << self.LOW) - 1

        def begun(values: Column) -> Column:
            first = lambda b, i: F.get(self.twos, b * F.lit(256) + F.get(values, i + 1))
            last = lambda b: F.get(self.ones, b)
            return F.flatten(F.array(F.array(F.lit(before)), F.transform(
                values, lambda b, i: F.coalesce(first(b, i), last(b)) + F.shiftleft(i.cast("bigint"), 20))))

        def joined(s: Column, least: Column) -> Column:
            best = F.shiftright(least, self.LOW)

            def at(i: Column) -> Column:
                left, right = F.get(s, i - 2), self._id(F.get(s, i + 1))
                own = F.shiftleft(self._rank(best, right), self.LOW) + (least.bitwiseAND(keep) - self._id(least) + best)
                other = F.shiftleft(self._rank(self._id(left), best), self.LOW) + left.bitwiseAND(keep)
                return F.flatten(F.array(F.slice(s, F.lit(1), i - 2), F.array(other, own), F.slice(s, i + 2, F.lit(LONG))))

            return _let(F.array_position(s, least).cast("int"), at)

        def turn(s: Column, _: Column) -> Column:
            return _let(F.array_min(s), lambda least: F.when(least >= F.lit(self.NONE << self.LOW), s).otherwise(joined(s, least)))

        state = F.aggregate(F.sequence(F.lit(1), F.octet_length(piece)), _let(values, begun), turn)
        return F.transform(F.slice(state, F.lit(2), F.lit(LONG)), self._id)

    def _fold_long(self, piece: Column, values: Column) -> Column:
        def turn(s: Column, _: Column) -> Column:
            # lowest rank first, then place
            lowest = F.array_min(F.transform(s, lambda e, i: F.shiftright(e, 20) * F.lit(self.PLACES) + i))
            return _let(lowest, lambda m: F.when(m >= F.lit(self.NONE * self.PLACES), s).otherwise(
                self._lowest(s, F.shiftright(m, 24), m.bitwiseAND(F.lit(self.PLACES - 1)))))

        turns, ids = F.sequence(F.lit(1), F.octet_length(piece)), F.transform(values, lambda b: self._id(F.get(self.ones, b)))
        return F.transform(F.aggregate(turns, _let(ids, self._chain), turn), self._id)

    def _leftmost(self, state: Column, best: Column, at: Column) -> Column:
        return F.transform(F.filter(state, lambda _, i: i != at + 1), lambda e, i: F.when(
            i == at, self._pair(best, self._id(F.get(state, (at + 2).cast("int"))))).otherwise(F.when(
                i == at - 1, self._pair(self._id(e), best)).otherwise(e)))

    def _lowest(self, state: Column, best: Column, at: Column) -> Column:
        """All pairs of the lowest rank, from the left and without overlap, if no lower rank can come between."""
        hits = F.array_join(F.transform(state, lambda e: F.when(F.shiftright(e, 20) == best, "1").otherwise("0")), "")
        # of pairs that overlap, every second one
        marks = F.split(F.regexp_replace(hits, "11", "10"), "")

        def rebuilt(mark: Column) -> Column:
            # a pair that was just joined meets the first id of the next pair before that is joined
            between = F.exists(F.sequence(F.lit(0), F.size(state)), lambda i: (F.get(mark, i) == "1") & (F.get(mark, i + 2) == "1")
                               & (F.shiftright(self._pair(best, self._id(F.get(state, i + 2))), 20) < best))
            joined = F.filter(F.transform(state, lambda e, i: F.when(F.get(mark, i) == "1", best).otherwise(F.when(
                (i > 0) & (F.get(mark, i - 1) == "1"), F.lit(None)).otherwise(self._id(e)))), lambda x: x.isNotNull())
            return _let(_let(joined, self._chain), lambda s: F.when(
                F.coalesce(between, F.lit(False)) | (F.array_min(F.transform(s, lambda e: F.shiftright(e, 20))) < best),
                self._leftmost(state, best, at)).otherwise(s))

        return _let(marks, rebuilt)


def _members(name: str, letters: str) -> set[str]:
    """Which letters the library's pattern engine counts to a class such as ``\\p{L}``."""
    single = tiktoken.Encoding("one", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return set(single.decode(single.encode_ordinary(letters)))


def wide_pattern(spark: SparkSession, pattern: str) -> str:
    """The pattern with letters and numbers that Unicode got after the JVM's version of it."""
    bare = spark.range(1, 0x110000).filter("not (id between 55296 and 57343)") \
        .filter(F.expr(r"decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").rlike(r"^\p{Cn}$"))
    # ranges of code points without a meaning in the JVM: a few hundred, whatever the data
    runs = bare.select("id", (F.col("id") - F.row_number().over(Window.orderBy("id"))).alias("run")) \
        .groupBy("run").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("lo").collect()
    letters = "".join(chr(c) for run in runs for c in range(run["lo"], run["hi"] + 1))
    out = pattern
    for name in (r"\p{L}", r"\p{N}"):
        spans: list[list[int]] = []
        for c in sorted(map(ord, _members(name, letters))):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
        more = name + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans)
        parts = out.split(name)
        out = parts[0]
        for part in parts[1:]:
            inside = out.count("[") > out.count("]")
            out += (more if inside else f"[{more}]") + part
    return out


def pieces(spark: SparkSession, text: Column, pattern: str) -> Column:
    """All matches of the pattern, white space, letters and numbers as in Unicode."""
    rare = text.rlike(r"\p{Cn}")
    plain, wide = "(?U)" + pattern, "(?U)" + wide_pattern(spark, pattern)
    return F.when(rare, F.regexp_extract_all(text, F.lit(wide), F.lit(0))) \
        .otherwise(F.regexp_extract_all(text, F.lit(plain), F.lit(0)))


def counted_pieces(cut: DataFrame) -> DataFrame:
    """piece and n: how often each distinct piece of at most LONG bytes occurs; ``cut`` has arrays of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _slices(batch.column(0)):
                seen = batch.column(0).slice(lo, hi - lo).flatten().value_counts()
                seen = seen.filter(pc.less_equal(pc.binary_length(seen.field("values")), LONG))
                yield pa.RecordBatch.from_arrays([seen.field("values"), seen.field("counts")], ["piece", "n"])

    return cut.select("pieces").transform(shipped).mapInArrow(run, "piece string, n long") \
        .groupBy("piece").agg(F.sum("n").alias("n"))


def _slices(lists: pa.ListArray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` pieces, at least one row each."""
    total, i = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), 0
    while i < len(lists):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def frequent_words(cut: DataFrame, path: str, most: int) -> DataFrame:
    """piece and ids of the most frequent distinct pieces, folded from their bytes also where they are tokens."""
    top = counted_pieces(cut).orderBy(F.desc("n"), "piece").limit(most).select("piece").repartition(partitions(cut.sparkSession))
    return _folded(top, path, F.array("piece")).select("piece", F.element_at("ids", 1).alias("ids"))


def _folded(df: DataFrame, path: str, words: Column) -> DataFrame:
    """``df`` with the ids of an array of words."""
    return Merges.put(df, "ids", path, lambda merges: F.transform(words, merges.ids))


class Words:
    """Known pieces by the hash of their bytes, and their ids; some thirty bytes each."""

    def __init__(self, tokens: dict[str, int], words: pa.Table):
        pieces, ids, size = [pa.array(list(tokens), pa.large_string())], [np.fromiter(tokens.values(), np.int32, len(tokens))], \
            [np.ones(len(tokens), np.int32)]
        for batch in words.to_batches():
            pieces.append(batch.column(0).cast(pa.large_string()))
            ids.append(batch.column(1).flatten().to_numpy().astype(np.int32))
            size.append(batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int32))
        self.letters, edge = buffer_of(pa.concat_arrays(pieces))
        self.ids, of = np.concatenate(ids), np.concatenate(size)
        if max(len(self.letters), len(self.ids)) > np.iinfo(np.int32).max:
            raise ValueError("too many words to remember")
        # a piece that is a token has its own id, whatever its bytes would be merged to: the first of equal hashes stays
        self.hash, first = np.unique(word_hashes(self.letters, edge[:-1], edge[1:], fold=False), return_index=True)
        self.at, self.length = edge[:-1][first].astype(np.int32), np.diff(edge)[first].astype(np.int32)
        self.start, self.size = (np.cumsum(of, dtype=np.int64) - of)[first].astype(np.int32), of[first]

    def places(self, pieces: pa.Array) -> np.ndarray:
        """Where each piece is, -1 where it is not known; pieces are compared byte by byte."""
        data, edge = buffer_of(pieces)
        hashes, length = word_hashes(data, edge[:-1], edge[1:], fold=False), np.diff(edge)
        place = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        same = np.flatnonzero((self.hash[place] == hashes) & (self.length[place] == length))
        differ = data[spread(edge[:-1][same], length[same])] != self.letters[spread(self.at[place[same]], length[same])]
        total, ends = np.concatenate([[0], np.cumsum(differ)]), np.concatenate([[0], np.cumsum(length[same])])
        same = same[total[ends[1:]] == total[ends[:-1]]]
        out = np.full(len(pieces), -1)
        out[same] = place[same]
        return out


def known_ids(cut: DataFrame, words: Broadcast) -> DataFrame:
    """doc_id, the ids of known pieces with -1, -2, ... for the first, second, ... unknown one, and the unknown pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        for batch in batches:
            for lo, hi in _slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                lists = part.column(1)
                owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                coded = lists.flatten().dictionary_encode()
                spelt, code = coded.dictionary, coded.indices.to_numpy()
                place = known.places(spelt)
                start, size = np.where(place < 0, 0, known.start[place]), np.where(place < 0, 1, known.size[place])
                flat = known.ids[spread(start[code], size[code])]
                ends = np.cumsum(size[code])
                odd = np.flatnonzero(place[code] < 0)
                pair, where = np.unique(owner[odd] * max(1, len(spelt)) + code[odd], return_inverse=True)
                doc = pair // max(1, len(spelt))
                first = np.searchsorted(doc, np.arange(len(lists) + 1))
                flat[ends[odd] - 1] = -1 - (where - first[doc[where]])
                edge = np.concatenate([[0], ends])[np.searchsorted(owner, np.arange(len(lists) + 1))]
                unknown = pa.ListArray.from_arrays(pa.array(first, pa.int32()), coded.dictionary.take(pa.array(pair % max(1, len(spelt)))))
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(flat, edge), unknown], ["doc_id", "coded", "rare"])

    return cut.transform(shipped).mapInArrow(run, "doc_id long, coded binary, rare array<string>")


def _lists(flat: np.ndarray, edge: np.ndarray) -> pa.Array:
    """Parts of an array of 32-bit numbers as bytes."""
    data = np.ascontiguousarray(flat, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((edge * 4).astype(np.int32)), pa.py_buffer(data)])


def _whole(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of rows (doc_id, coded, ids of the unknown pieces), and where each row's begin."""
    rows = part.num_rows
    n = pc.binary_length(part.column(1)).to_numpy().astype(np.int64) // 4
    flat = np.frombuffer(b"".join(x.as_buffer() for x in part.column(1)), np.int32)
    owner = np.repeat(np.arange(rows), n)
    lists = part.column(2)
    first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    inner = lists.flatten()
    size = inner.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    pool = np.concatenate([inner.flatten().to_numpy().astype(np.int32), flat])
    odd = np.flatnonzero(flat < 0)
    of = first[owner[odd]] - flat[odd] - 1
    count, start = np.ones(len(flat), np.int64), np.arange(len(flat)) + int(size.sum())
    count[odd], start[odd] = size[of], (np.cumsum(size) - size)[of]
    total = np.concatenate([[0], np.cumsum(count)])
    return pool[spread(start, count)], total[np.concatenate([[0], np.cumsum(n)])]


def _shared_words(cut: DataFrame, path: str, remembered: int) -> Broadcast:
    """``remembered`` short words and the tokens; the driver's Python keeps none of them."""
    words = Words(whole_tokens(path), frequent_words(cut, path, remembered).toArrow())
    shared = cut.sparkSession.sparkContext.broadcast(words)
    del words
    give_back()
    return shared


def _encoded(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, remembered: int) -> DataFrame:
    """doc_id, coded and the ids of the unknown pieces."""
    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      pieces(docs.sparkSession, F.coalesce(F.col(text_col).cast("string"), F.lit("")), pattern).alias("pieces"))
    coded = known_ids(cut, _shared_words(cut, path, remembered))
    return _folded(coded, path, F.col("rare")).select("doc_id", "coded", "ids")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           remembered: int = REMEMBERED) -> DataFrame:
    """doc_id and the text's ids as an array of integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _byte_slices(batch.column(1)):
                ids, edge = _whole(batch.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(
                    pa.array(edge, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return _encoded(docs, path, pattern, id_col, text_col, remembered).mapInArrow(run, "doc_id long, ids array<int>")


def _byte_slices(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    total, i = np.cumsum(pc.binary_length(column).to_numpy().astype(np.int64)), 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


class Tokens:
    """Bytes of all tokens, one after another."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes of some ids."""
        return self.data[spread(self.start[ids], self.size[ids])].tobytes()


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the bytes of rows as ``encode`` gives them."""
    shared = encoded.sparkSession.sparkContext.broadcast(Tokens(load_ranks(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [None if not x.is_valid else shared.value.joined(x.values.to_numpy()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").transform(shipped).mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
               remembered: int = REMEMBERED) -> DataFrame:
    """Digests of the ids and of the bytes decoded from them, without moving either."""
    shared = docs.sparkSession.sparkContext.broadcast(Tokens(load_ranks(path)))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _byte_slices(batch.column(1)):
                ids, edge = _whole(batch.slice(lo, hi - lo))
                of_ids, of_bytes = [], []
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    of_ids.append(hashlib.sha256(" ".join(map(str, ids[a:b].tolist())).encode()).hexdigest())
                    of_bytes.append(hashlib.sha256(shared.value.joined(ids[a:b])).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(edge), pa.int64()),
                                                  pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names)

    return _encoded(docs, path, pattern, id_col, text_col, remembered) \
        .mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

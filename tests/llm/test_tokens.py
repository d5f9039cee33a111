"""Encoding, packing and binary output against the tokenizers library and plain loops."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from cases import awkward, nothing, prose, texts
from loomcast.llm import bpe, packing, token_ids, token_output
from loomcast.llm.vocab import Vocabulary

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = ["", "a", "  x  y \n\n z\t", "don't we'll I'D it's ''s", "x<|endoftext|>y  <|endoftext|> z<|startoftext|>q",
       "naïve Ärger ÅNGSTRÖM é İstanbul ΑΣ ΟΔΟΣ", "日本語 漢字", "😀👩‍👩‍👧 x", "a\u00a0b\u2003c \u200bd\x85e\x1cf\x00g h", "    ", "\n",
       "1234 5,678.90 ½ ²", "\u0301abc \u0301d", "x" * 300 + " " + "ab" * 200, "ﬁ ǅ ß ẞ", "<|end <|", "a \u00a0\u3000 b", "\r\n\r\n a\r\n",
       "\u00a0 \u00a0x", "a\u00a0  b", "tab\tnew\n\nline  "]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_equal_the_librarys(path):
    library, own = Tokenizer.from_file(path), Vocabulary(path)
    rng = random.Random(5)
    some = ODD + [prose(i, 40) for i in range(20)] + \
        ["".join(rng.choice("ab é.\n\t '!1\u00a0S") for _ in range(60)) for _ in range(200)]
    for text, ids in zip(some, own.encode(some)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_decoding_equals_the_librarys():
    library, own = Tokenizer.from_file(BYTE), Vocabulary(BYTE)
    for text in ODD:
        ids = own.encode([text])[0]
        assert own.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)
    for ids in ([167], [220, 167, 222], [50256, 11], [26525, 120]):  # bytes that are no UTF-8
        assert own.decode(np.array(ids, np.uint32)) == library.decode(ids, skip_special_tokens=False)


def test_a_long_text_is_cut_without_change(monkeypatch):
    from loomcast.llm import vocab

    library, text = Tokenizer.from_file(BYTE), prose(4, 3000)
    monkeypatch.setattr(vocab, "PIECE", 500)
    assert Vocabulary(BYTE).encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_forgetting_words_changes_nothing(monkeypatch):
    from loomcast.llm import vocab

    some = [prose(i, 50) for i in range(12)]
    want = [x.tolist() for x in Vocabulary(BYTE).encode(some)]
    monkeypatch.setattr(vocab, "KEEP", 60)
    monkeypatch.setattr(vocab, "BATCH", 300)
    assert [x.tolist() for x in Vocabulary(BYTE).encode(some)] == want


def plain_merge(pairs, symbols):
    rank_of = pairs.lookup()
    while True:
        best = min(((rank_of[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank_of), default=None)
        if best is None:
            return symbols
        i = best[1]
        symbols = symbols[:i] + [rank_of[symbols[i], symbols[i + 1]][1]] + symbols[i + 2:]


def test_segment_trees_merge_leftmost_lowest_rank():
    pairs = Vocabulary.at(BYTE).pairs
    rng = random.Random(3)
    words = [bytes(rng.choice(b"abcdethe  \xc3\xa9") for _ in range(rng.choice([1, 2, 3, 5, 9, 33, 64, 65, 200]))) for _ in range(300)]
    ids, counts = bpe.encode_words(pairs, words)
    ends = np.cumsum(counts)
    for w, n, end in zip(words, counts, ends):
        assert ids[end - n:end].tolist() == plain_merge(pairs, pairs.first[np.frombuffer(w, np.uint8)].tolist())


def test_round_trip_query_rows(spark):
    df = awkward(spark)
    library = Tokenizer.from_file(BYTE)
    want = []
    for name, text in texts(df):
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((name, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, token_ids.round_trip(df, BYTE).collect()), key=str) == sorted(want, key=str)
    back = token_ids.decode(token_ids.encode(df, BYTE), BYTE)
    assert sorted((texts(back)), key=str) == sorted(((i, t or "") for i, t in texts(df)), key=str)
    assert token_ids.round_trip(nothing(spark), BYTE).count() == 0


def check_pieces(rows, want, length):
    """Every id in one piece, sequences gapless; returns the padding share."""
    by_sequence, by_doc = defaultdict(list), Counter()
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        ids = want[r["doc_id"], r["doc_tokens"]]
        assert 0 < r["length"] <= length
        assert zlib.crc32(ids[r["start"]:r["start"] + r["length"]].astype("<u4").tobytes()) == r["ids_crc32"]
        by_doc[r["doc_id"], r["doc_tokens"]] += r["length"]
    pad = 0
    for spans in by_sequence.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= length
        pad += length - at
    return by_doc, pad / max(1, len(by_sequence) * length)


@pytest.mark.parametrize("which", ["pack", "binary"])
def test_packing_of_awkward_rows(spark, which):
    df, library = awkward(spark), Tokenizer.from_file(WORD)
    want, times = {}, Counter()
    for name, text in texts(df):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], np.uint32)
        want[name, len(ids)] = ids
        times[name, len(ids)] += len(ids)
    if which == "pack":
        rows = packing.pack(df, WORD, 2, 512).collect()
        assert packing.pack(nothing(spark), WORD, 2, 512).count() == 0
    else:
        rows = token_output.written_segments(df, WORD, 2, length=512, block_tokens=5000).collect()
        assert all(r["resets"] for r in rows)
        assert token_output.written_segments(nothing(spark), WORD, 2, length=512).count() == 0
    by_doc, _ = check_pieces(rows, want, 512)
    assert by_doc == times


def test_patterns_hold_every_length_and_little_padding():
    rng = np.random.default_rng(1)
    for n in (1, 7, 3000):
        sizes = np.minimum(4096, np.exp(rng.normal(6.3, 1.1, n)).astype(int) + 1)
        histogram = Counter(sizes.tolist())
        patterns = packing.pattern_table(dict(histogram), 4096)
        held, sequences = Counter(), 0
        for copies, inside in patterns:
            assert sum(k * v for k, v in inside.items()) <= 4096
            sequences += copies
            for k, v in inside.items():
                held[k] += copies * v
        assert held == histogram
        if n == 3000:
            assert sequences <= 1.01 * -(-int(sizes.sum()) // 4096)
        places = packing.Places(patterns)
        seen = set()
        for size, count in histogram.items():
            sequence, offset = places.find(np.full(count, size), np.arange(count))
            seen.update(zip(sequence.tolist(), offset.tolist()))
        assert len(seen) == n


def test_best_fit_equals_a_plain_search():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 101, 400)
    sequence, offset, n = token_output.best_fit(sizes, 100)
    rooms = []
    for i in np.argsort(-sizes, kind="stable"):
        fits = [r for r in rooms if r >= sizes[i]]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - sizes[i])
        else:
            rooms.append(100 - sizes[i])
    assert n == len(rooms)
    used = np.bincount(sequence, weights=sizes)
    assert sorted(100 - used) == sorted(rooms)


def test_binary_rows(spark):
    df = spark.createDataFrame([(1, prose(1, 900)), (2, "a b"), (3, None)], "doc_id long, text string")
    for r in token_output.packed_sequences(df, BYTE, 50256, length=256).collect():
        ids, position = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2")
        assert len(ids) == len(position) == 256 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"]
        assert not ids[r["n_tokens"]:].any() and not position[r["n_tokens"]:].any()
    with pytest.raises(Exception, match="do not fit"):
        token_output.packed_sequences(df, BYTE, 50256, length=256, kind="<u1").collect()


def thue_morse(n):
    """Two words of n letters with the structure that a polynomial hash cannot tell apart."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_words_of_one_structure_keep_their_ids(path):
    library, rng, some = Tokenizer.from_file(path), random.Random(3), []
    for n in (64, 128, 256, 1024, 2048):
        some += [" ".join(thue_morse(n)), *thue_morse(n)]
    for _ in range(40):  # words that differ by blocks that change places
        blocks = ["".join(rng.choice("ab") for _ in range(16)) for _ in range(8)]
        some.append(" ".join("".join(rng.sample(blocks, 8)) for _ in range(6)))
    own = Vocabulary(path)
    for text, ids in zip(some, own.encode(some)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    """Even where every word has the same hash."""
    from loomcast.llm import vocab

    monkeypatch.setattr(vocab, "word_hashes", lambda data, starts, ends, fold=True: np.zeros(len(starts), np.uint64))
    for path in (BYTE, WORD):
        library, own = Tokenizer.from_file(path), Vocabulary(path)
        for _ in range(2):
            for text, ids in zip(ODD, own.encode(ODD)):
                assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_hashes_of_long_and_short_words(monkeypatch):
    from loomcast.llm import words

    text = " ".join([*thue_morse(4096), "a", "A", "b", "x" * 3000, "x" * 3001])
    data, offsets = words.buffer_of(pa.array([text], pa.large_string()))
    starts, ends = words.word_bounds(data, offsets)
    whole = words.word_hashes(data, starts, ends)
    assert whole[2] == whole[3] and len(set(whole.tolist())) == len(whole) - 1
    monkeypatch.setattr(words, "BLOCK", 700)  # long words in parts
    assert (words.word_hashes(data, starts, ends) == whole).all()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_plain_words_are_cut_without_a_pattern(monkeypatch, name):
    """Letters, digits and marks of ASCII and letters of Latin-1 are cut by arrays; the rest goes to the patterns."""
    vocabulary = Vocabulary(P.path(name))
    mixed, own = [], vocabulary._encode_mixed
    monkeypatch.setattr(vocabulary, "_encode_mixed", lambda words: mixed.extend(words) or own(words))
    pick = random.Random(5).choice
    some = ["a", "The", "ing", " ", "  ", "9", "12", ",", "...", "(", "é", "É", "\n", "-", "_", "Ñandú", "Æ", "ÿ", "~", "ß"]
    odd = ["'s", "'", "x'll", "÷", "×", "Ÿ", "日", "\x01", "\xa0", "Ā"]
    plain = ["".join(pick(some) for _ in range(60)) for _ in range(80)]
    rare = ["".join(pick(some + odd) for _ in range(60)) for _ in range(80)]
    for texts in (plain, rare):
        want = [e.ids for e in vocabulary.library.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in vocabulary.encode(texts)] == want
        if texts is plain:
            assert all(not w.strip() for w in mixed)
    assert mixed

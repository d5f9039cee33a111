"""Ids of whole texts from a public tokenizer file, with a bounded memory of words already encoded.

Texts are cut at white space by array arithmetic; words are found by 64-bit hashes and compared byte by byte, so two
words of one hash never share ids. Each new word of at most ``LONGEST`` bytes is pre-tokenised once (letters,
digits and marks of ASCII and letters of Latin-1 by array arithmetic; else the library's own pre-tokeniser, or the whole library where the file has a normaliser,
for letters outside ASCII and Latin-1), merged by ``bpe.encode_words`` and kept in a pool. The ids of a
text are then gathered from the pool. A very long text is taken in parts, a very long word is encoded alone.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from loomcast.llm.bpe import PairTable, byte_letters, encode_ranges, encode_words, load_model, spread
from loomcast.llm.memory import give_back
from loomcast.llm.words import FOLD, buffer_of, word_bounds, word_hashes

KEEP = 500_000  # words remembered by a worker
LONGEST = 256  # bytes of a word that is remembered
PIECE = 1 << 20  # characters of a text handled at a time
BATCH = 1 << 19  # characters of many texts handled at a time

# fixed patterns of the public vocabularies, for ASCII and the letters of Latin-1
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile("[\x01-\x7fÀ-ÖØ-öø-ÿ]*")
_BYTE_LEVEL = re.compile(
    rf"\x00|'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\x00\t-\r {_LETTER}0-9]+|[\t-\r ]+(?![^\x00\t-\r ])|[\t-\r ]+")
_LOWER_CASE = re.compile(r"\x00|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\x00\t-\r a-zß-öø-ÿ0-9]+")
# white space outside ASCII, a null character or a special token: the text is cut by the library's rules
_RARE = re.compile("[\x00\x85\xa0  -     　]|<\\|")
_BORDER = re.compile("(?<=[!-~]) (?=[!-~])")


def _is_rare(text: str) -> bool:
    if text.isascii():
        return "<|" in text or "\x00" in text
    return _RARE.search(text) is not None


# 1 letters, 2 digits, 3 marks of ASCII; 0 the rest and the apostrophe, which begins pieces of its own kind
_KIND = np.array([0 if not "!" <= c <= "~" or c == "'" else 1 if c.isalpha() else 2 if c.isdigit() else 3 for c in map(chr, range(256))], np.uint8)
_LATIN = 0xC3  # first byte of the letters of Latin-1, of which these second bytes are signs
_SIGNS = (0x97, 0xB7)


def _kinds(data: np.ndarray) -> np.ndarray:
    """The kind of every byte; both bytes of a letter of Latin-1 are letters."""
    kind = _KIND[data]
    at = np.flatnonzero(data[:-1] == _LATIN)
    at = at[~np.isin(data[at + 1], _SIGNS)]
    kind[at] = kind[at + 1] = 1
    return kind


def _lower(data: np.ndarray) -> np.ndarray:
    """Small letters of ASCII and Latin-1."""
    out = FOLD[data]
    at = np.flatnonzero(data[:-1] == _LATIN) + 1
    at = at[(data[at] <= 0x9E) & (data[at] != _SIGNS[0])]
    out[at] += 32
    return out


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number; beyond the end they are zero."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data), "<u8", padded, strides=(1,))


class Vocabulary:
    """Encoder and decoder for one tokenizer file; one instance per Python worker."""

    _known: dict[str, Vocabulary] = {}

    @classmethod
    def at(cls, path: str) -> Vocabulary:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = load_model(path)
        self.pairs = PairTable(spec["model"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.normalised = spec["normalizer"] is not None
        self.byte_of = {v: k for k, v in byte_letters().items()}
        self._decoder(spec["model"]["vocab"])
        self.forget()
        del spec  # tens of megabytes of letters
        give_back()

    def _decoder(self, vocab: dict[str, int]):
        byte_of = self.byte_of
        tokens = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for text, i in [*vocab.items(), *self.special.items()]:
            tokens[i] = bytes(byte_of[c] for c in text) if all(c in byte_of for c in text) else text.encode()
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.token_start = np.concatenate([[0], np.cumsum(self.token_length)[:-1]])

    def forget(self):
        """Remembered words go; the next texts begin anew."""
        self.hash = np.zeros(0, np.uint64)
        self.start, self.count, self.at, self.size = (np.zeros(0, np.int32) for _ in range(4))
        self.letters, self.written = np.zeros(1 << 16, np.uint8), 0  # bytes of the remembered words
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _encode_new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ranges of bytes, and where the ids of each begin and how many they are."""
        at = np.empty((2, len(starts)), np.int64)
        begin = starts if self.normalised or not len(starts) else starts + (data[starts] == 32)
        kinds = _kinds(data)
        others = np.concatenate([[0], np.cumsum(kinds == 0)])
        plain = (begin < ends) & (others[begin] == others[ends])
        ids = np.zeros(0, np.int64)
        if plain.any():
            piece, size, first = self._runs(kinds, starts[plain], begin[plain], ends[plain])
            ids, count = encode_ranges(self.pairs, _lower(data) if self.normalised else data, piece, size)
            count = np.add.reduceat(count, first)
            at[0, plain], at[1, plain] = np.cumsum(count) - count, count
        if not plain.all():
            rest = ~plain
            more, own = self._encode_mixed([data[a:b].tobytes() for a, b in zip(starts[rest].tolist(), ends[rest].tolist())])
            at[0, rest], at[1, rest] = own[0] + len(ids), own[1]
            ids = np.concatenate([ids, more])
        return ids, at

    def _runs(self, kinds: np.ndarray, starts: np.ndarray, begin: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces of ranges that have one known kind after another from ``begin`` on, and a space before it at most: where
        each piece begins, its bytes, and the number of each range's first piece."""
        n = ends - begin
        head, place = np.cumsum(n) - n, spread(begin, n)
        kind = kinds[place]
        cut = np.ones(len(kind), bool)
        cut[1:] = kind[1:] != kind[:-1]
        if self.normalised:
            cut |= kind == 2  # every digit is a piece
        cut[head] = True
        cuts = np.flatnonzero(cut)
        first = np.searchsorted(cuts, head)
        piece, size = place[cuts], np.diff(np.append(cuts, len(kind)))
        piece[first], size[first] = starts, size[first] + (begin - starts)
        return piece, size, first

    def _encode_mixed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``_encode_new`` of words of any characters."""
        texts = [w.decode() for w in words]
        plain = np.fromiter((t.isascii() or _PLAIN.fullmatch(t) is not None for t in texts), bool, len(texts))
        simple = "\x00".join([t for t, ok in zip(texts, plain) if ok])
        found = (_LOWER_CASE.findall(simple.lower()) if self.normalised else _BYTE_LEVEL.findall(simple)) if simple else []
        marks = np.flatnonzero(np.fromiter((p == "\x00" for p in found), bool, len(found)))
        n_plain = int(plain.sum())
        edges = np.concatenate([[-1], marks, [len(found)]])
        per_word = (np.diff(edges) - 1)[:n_plain]
        pieces = [p.encode() for p in found if p != "\x00"]
        rest = [t for t, ok in zip(texts, plain) if not ok]
        whole: list = []
        if self.normalised:
            whole = [np.asarray(e.ids, np.int64) for e in self.library.encode_batch(rest, add_special_tokens=False)]
        else:
            more = []
            for t in rest:
                own = [bytes(self.byte_of[c] for c in p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(t)]
                more.append(len(own))
                pieces += own
            per_word = np.concatenate([per_word, np.array(more, np.int64)])
        ids, counts = encode_words(self.pairs, pieces)
        ends = np.concatenate([[0], np.cumsum(counts)])
        edge = np.concatenate([[0], np.cumsum(per_word)])
        per_word = ends[edge[1:]] - ends[edge[:-1]]
        if whole:
            ids = np.concatenate([ids, *whole])
            per_word = np.concatenate([per_word, np.fromiter(map(len, whole), np.int64, len(whole))])
        begin = np.concatenate([[0], np.cumsum(per_word)[:-1]]) if len(words) else np.zeros(0, np.int64)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        start, count = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        start[order], count[order] = begin, per_word
        return ids, np.stack([start, count])

    def _remember(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        ids, at = self._encode_new(data, starts, ends)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * (self.used + len(ids)))
        self.pool[self.used:self.used + len(ids)] = ids
        size = ends - starts
        own = self._folded(data[spread(starts, size)])
        if self.written + len(own) > len(self.letters):
            self.letters = np.resize(self.letters, 2 * (self.written + len(own)))
        self.letters[self.written:self.written + len(own)] = own
        place = np.searchsorted(self.hash, hashes)
        self.hash = np.insert(self.hash, place, hashes)
        self.start = np.insert(self.start, place, at[0] + self.used)
        self.count = np.insert(self.count, place, at[1])
        self.at = np.insert(self.at, place, self.written + np.cumsum(size) - size)
        self.size = np.insert(self.size, place, size)
        self.used += len(ids)
        self.written += len(own)

    def _folded(self, data: np.ndarray) -> np.ndarray:
        """Bytes as the hash takes them: a file with a normaliser ignores case."""
        return FOLD[data] if self.normalised else data

    def _lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(self.hash, hashes)
        known = np.zeros(len(hashes), bool)
        inside = place < len(self.hash)
        known[inside] = self.hash[place[inside]] == hashes[inside]
        return place, known

    def _other(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which ranges are not the word that is remembered under their hash: eight bytes are compared at a time."""
        length = ends - starts
        other = length != self.size[place]
        own, kept = _eights(self._folded(data)), _eights(self.letters[:self.written])
        left, at, word = np.flatnonzero(~other), starts, self.at[place]
        for done in range(0, LONGEST, 8):
            left = left[length[left] > done]
            if not len(left):
                break
            differ = (own[at[left] + done] ^ kept[word[left] + done]) & _MASKS[np.minimum(length[left] - done, 8)]
            other[left[differ != 0]] = True
        return other

    def _ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ranges of bytes, one after another, and the number of ids of each range."""
        usual = np.flatnonzero(ends - starts <= LONGEST)
        hashes = word_hashes(data, starts[usual], ends[usual], fold=self.normalised)
        distinct, first, code = np.unique(hashes, return_index=True, return_inverse=True)
        place, known = self._lookup(distinct)
        if not known.all():
            if len(self.hash) + int((~known).sum()) > KEEP:
                self.forget()
                known[:] = False
            new = usual[first[~known]]
            self._remember(distinct[~known], data, starts[new], ends[new])
            place, _ = self._lookup(distinct)
        place = place[code]
        n, begin = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        alone = np.concatenate([np.flatnonzero(ends - starts > LONGEST),
                                usual[self._other(data, starts[usual], ends[usual], place)] if len(usual) else usual])
        n[usual], begin[usual] = self.count[place], self.start[place]
        pool = self.pool[:self.used]
        if len(alone):
            ids, at = self._encode_new(data, starts[alone], ends[alone])
            n[alone], begin[alone] = at[1], at[0] + len(pool)
            pool = np.concatenate([pool, ids.astype(np.uint32)])
        return pool[spread(begin, n)], n

    def _ranges(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is encoded on its own: words, with the space before them and the white space between them
        where ids depend on it."""
        starts, ends = word_bounds(data, offsets)
        if self.normalised or not len(data):
            return starts, ends
        text = np.searchsorted(offsets, starts, "right") - 1
        before = np.concatenate([[0], ends[:-1]])
        before = np.maximum(before, offsets[text])  # the end of the word before, or the text's begin
        gap = starts - before
        joined = (gap > 0) & (data[starts - 1] == 32)
        alone = (gap > 0) & ~joined
        tails = np.searchsorted(starts, offsets)
        has = tails[1:] > tails[:-1]
        tail = offsets[:-1].copy()
        tail[has] = ends[tails[1:][has] - 1]
        long, rest = gap > 1, tail < offsets[1:]
        a = np.concatenate([starts - joined, before[long], starts[alone] - 1, tail[rest]])
        b = np.concatenate([ends, starts[long] - 1, starts[alone], offsets[1:][rest]])
        order = np.argsort(a, kind="stable")
        return a[order], b[order]

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        data, offsets = buffer_of(pa.array(texts, pa.large_string()))
        starts, ends = self._ranges(data, offsets)
        if not len(starts):
            return [np.zeros(0, np.uint32)] * len(texts)
        ids, n = self._ids(data, starts, ends)
        total = np.concatenate([[0], np.cumsum(n)])
        edge = total[np.searchsorted(starts, offsets)]
        return [ids[a:b] for a, b in zip(edge[:-1], edge[1:])]

    def _rare(self, text: str) -> np.ndarray:
        """A text with unusual white space or special tokens, by the library's own pre-tokeniser."""
        if self.normalised:
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        out = []
        for part in self.cut_special.split(text) if self.cut_special else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], np.uint32))
            elif part:
                pieces = [bytes(self.byte_of[c] for c in p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]
                out.append(encode_words(self.pairs, pieces)[0].astype(np.uint32))
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def encode(self, texts: list) -> list[np.ndarray]:
        """The ids of every text as unsigned 32-bit integers; a null text has none."""
        parts, owner = [], []
        for i, text in enumerate(texts):
            for part in self._pieces(text or ""):
                parts.append(part)
                owner.append(i)
        got: list = [None] * len(parts)
        i = 0
        while i < len(parts):
            j, size, usual = i, 0, []
            while j < len(parts) and (j == i or size + len(parts[j]) <= BATCH):
                size += len(parts[j])
                if _is_rare(parts[j]):
                    got[j] = self._rare(parts[j])
                else:
                    usual.append(j)
                j += 1
            for k, ids in zip(usual, self._batch([parts[k] for k in usual])):
                got[k] = ids
            i = j
        if len(parts) == len(texts):
            return got
        out: list = [[] for _ in texts]
        for i, ids in zip(owner, got):
            out[i].append(ids)
        return [np.concatenate(x) if len(x) > 1 else x[0] for x in out]

    def _pieces(self, text: str):
        """A long text in parts; a cut is made only before a single space between two ASCII words."""
        at = 0
        while len(text) - at > PIECE:
            cut = _BORDER.search(text, at + PIECE)
            if cut is None:
                break
            yield text[at:cut.start()]
            at = cut.start()
        yield text[at:]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        parts = []
        for at in range(0, len(ids), PIECE):
            part = ids[at:at + PIECE].astype(np.int64)
            parts.append(self.token_bytes[spread(self.token_start[part], self.token_length[part])].tobytes())
        return b"".join(parts).decode("utf-8", "replace")

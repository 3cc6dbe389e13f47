"""Byte-pair encoding of whole corpora with public vocabulary files.

The ids are those of the ``tokenizers`` library. Texts are cut at spaces into pieces
that its pre-tokenizer never joins; each distinct piece is encoded once per worker and
kept in a bounded dictionary, so a text costs a split and a join. Pieces not yet known
are encoded together, by merging in numpy over all their words at once; words over
``LONG`` bytes go to the library itself. Texts with special tokens or with white space
beside a space take a slower path through the whole text, with the same ids.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain, compress, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

BYTE_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LOWER_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
LOWER_AND_GAPS = regex.compile(LOWER_WORDS.pattern + "| ")
LONG = 64
BIG = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for a, z in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(a), ord(z) + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Pairs:
    """(a, b) -> value for non-negative a, b: an open hash table read by whole arrays."""

    def __init__(self, a: np.ndarray, b: np.ndarray, value: np.ndarray):
        self.bits = max(10, int(np.ceil(np.log2(max(len(a), 1) * 4))))
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.value = np.full(1 << self.bits, -1, np.int32)
        key = a.astype(np.int64) << 24 | b
        at, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = todo[self.key[at[todo]] == -1]
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.key[at[put]], self.value[at[put]] = key[put], value[put]
            todo = todo[self.key[at[todo]] != key[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        key = a.astype(np.int64) << 24 | b
        at = self._slot(key)
        there = self.key[at]
        out = np.where(there == key, self.value[at], np.int32(-1))
        todo = np.flatnonzero((there != key) & (there != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            there = self.key[at[todo]]
            hit = there == key[todo]
            out[todo[hit]] = self.value[at[todo[hit]]]
            todo = todo[~hit & (there != -1)]
        return out


class Vocabulary:
    """What a BPE vocabulary file holds: symbols of bytes, merges, labels, special tokens."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model, vocab = j["model"], j["model"]["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.lower = self.suffix != ""  # the word-end file also lower-cases and drops white space
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        signs = byte_symbols()
        byte_of = {s: i for i, s in enumerate(signs)}
        self.first = np.array([vocab[s] for s in signs], np.int32)
        self.last = np.array([vocab[s + self.suffix] for s in signs], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int32)
        self.right = np.array([vocab[b] for _, b in merges], np.int32)
        end = len(self.suffix)
        self.merged = np.array([vocab[(a[:-end] if end and a.endswith(self.suffix) else a) + b] for a, b in merges], np.int32)
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.labels: list[bytes] = [b""] * self.size
        for t, i in vocab.items():
            if all(c in byte_of for c in t):
                self.labels[i] = bytes(byte_of[c] for c in t)
        for t, i in self.special.items():
            self.labels[i] = t.encode()


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Merger:
    """Encodes words by their lowest-ranked merge, one a round, over all words at once."""

    def __init__(self, v: Vocabulary):
        self.v, self.pairs = v, Pairs(v.left, v.right, np.arange(len(v.left), dtype=np.int32))
        self._library = None

    def library(self, word: bytes) -> list[int]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.v.path)
            self._library.encode_special_tokens = True
        return self._library.encode(word.decode("utf-8"), add_special_tokens=False).ids

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = self.pairs.get(a, b)
        return np.where(r < 0, BIG, r)

    def words(self, words: list[bytes], most: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each word has."""
        parts = [self._words(words[k : k + most]) for k in range(0, len(words), most)]
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        v, n = self.v, len(words)
        lens = np.fromiter(map(len, words), np.int64, n)
        long = np.flatnonzero(lens > LONG)
        data = np.frombuffer(b"".join(words), np.uint8)
        sym = v.first[data]
        ends = np.cumsum(lens)
        full = np.flatnonzero(lens > 0)
        sym[ends[full] - 1] = v.last[data[ends[full] - 1]]
        word = np.repeat(np.arange(n, dtype=np.int32), lens)
        if len(long):
            keep = lens[word] <= LONG
            sym, word = sym[keep], word[keep]
        done_s, done_w = [], []
        same = word[:-1] == word[1:]
        rank = np.full(len(sym), BIG, np.int32)
        rank[:-1][same] = self._rank(sym[:-1][same], sym[1:][same])
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, starts)
            size = np.diff(np.concatenate((starts, [len(sym)])))
            of = np.repeat(least, size)
            over = of == BIG
            if over.any():
                done_s.append(sym[over])
                done_w.append(word[over])
                sym, word, rank, of = sym[~over], word[~over], rank[~over], of[~over]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == of)
            at = at[np.concatenate(([True], word[at[1:]] != word[at[:-1]]))]
            sym[at] = v.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            nxt = at + 2
            follows = nxt < len(sym)
            follows[follows] = word[nxt[follows]] == word[at[follows]]
            rank[at] = BIG
            rank[at[follows]] = self._rank(sym[at[follows]], sym[nxt[follows]])
            before = at[at > 0]
            before = before[word[before - 1] == word[before]]
            rank[before - 1] = self._rank(sym[before - 1], sym[before])
            sym, word, rank = sym[keep], word[keep], rank[keep]
        for w in long.tolist():
            ids = np.array(self.library(words[w]), np.int32)
            done_s.append(ids)
            done_w.append(np.full(len(ids), w))
        if not done_s:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        s, w = np.concatenate(done_s), np.concatenate(done_w)
        order = np.argsort(w, kind="stable")
        return s[order], np.bincount(w, minlength=n)


def _bytes_of(column: pa.LargeBinaryArray) -> list[bytes]:
    """As ``to_pylist`` of an array of its own without nulls, in a quarter of the time."""
    ends = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1].tolist()
    data = column.buffers()[2].to_pybytes() if ends[-1] else b""
    return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


class TextEncoder:
    """Whole texts to ids, as little-endian 16-bit numbers (both vocabularies fit)."""

    def __init__(self, v: Vocabulary, words=None, most: int = 300_000):
        self.v, self.most = v, most
        self.words = words or Merger(v).words
        self.known: dict[bytes, bytes | None] = {}
        self.firsts: dict[bytes, bytes] = {}
        self.tokens: dict[str, bytes] = {}
        self.old: dict[bytes, bytes | None] = {}
        self.old_tokens: dict[str, bytes] = {}
        self.marks = [t.encode() for t in v.special]
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, v.special)) + ")")

    # pieces -------------------------------------------------------------------
    def _normal(self, text: str) -> str:
        if not self.v.lower:
            return text
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def _pretokens(self, text: str) -> list[bytes]:
        if self.v.lower:
            return [m.encode() for m in LOWER_WORDS.findall(self._normal(text))]
        return [m.encode() for m in BYTE_WORDS.findall(text)]

    def _slow(self, text: str) -> bytes:
        out = []
        for part in self.split_special.split(text):
            if part in self.v.special:
                out.append(np.array([self.v.special[part]], "<u2").tobytes())
            elif part:
                out.append(self.words(self._pretokens(part))[0].astype("<u2").tobytes())
        return b"".join(out)

    def _learn(self, missing: list[bytes]) -> None:
        """Encodes new pieces (each stands after a space) in one go."""
        if self.v.lower:
            plain = missing
            both = LOWER_AND_GAPS.findall(self._normal(b" ".join(missing).decode("utf-8")))
            gap = np.fromiter((t == " " for t in both), bool, len(both))
            ends = np.concatenate(((np.cumsum(~gap))[gap], [len(both) - gap.sum()]))
            tokens = [t for t in both if t != " "]
        else:
            texts = b" ".join(missing).decode("utf-8").split(" ")
            odd = [k for k, s in enumerate(texts) if not s or s.strip() != s]
            for k in odd:
                self.known[missing[k]] = None  # white space beside a space: the text takes the slow path
            out = set(odd)
            plain = [p for k, p in enumerate(missing) if k not in out] if odd else missing
            tokens = BYTE_WORDS.findall(" " + " ".join(s for k, s in enumerate(texts) if k not in out)) if plain else []
            first = np.fromiter((t[0] == " " for t in tokens), bool, len(tokens))
            ends = np.concatenate((np.flatnonzero(first)[1:], [len(tokens)]))
        self.known.update(zip(plain, self._cut(tokens, ends), strict=True))

    def _cut(self, tokens: list[str], ends: np.ndarray) -> list[bytes]:
        """The ids of runs of tokens that end at ``ends``; tokens are kept like pieces."""
        new = list(dict.fromkeys(filterfalse(self.tokens.__contains__, tokens)))
        if self.old_tokens:
            again = [t for t in new if t in self.old_tokens]
            self.tokens.update(zip(again, map(self.old_tokens.__getitem__, again), strict=True))
            new = list(filterfalse(self.tokens.__contains__, new))
        if new:
            ids, n = self.words([t.encode() for t in new])
            stops = (np.cumsum(n) * 2).tolist()
            data = ids.astype("<u2").tobytes()
            self.tokens.update(zip(new, [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)], strict=True))
        found = list(map(self.tokens.__getitem__, tokens))
        total = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))))
        data, stops = b"".join(found), total[ends].tolist()
        return [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def _age(self) -> None:
        """Pieces and tokens that were not met since ``most`` others were learned are forgotten."""
        if len(self.known) > self.most:
            self.known, self.old = {}, self.known
            self.firsts.clear()
        if len(self.tokens) > self.most:
            self.tokens, self.old_tokens = {}, self.tokens

    def _know(self, pieces: Iterable[bytes]) -> None:
        """Sees to it that all ``pieces`` are known."""
        missing = set(filterfalse(self.known.__contains__, pieces))
        again = [p for p in missing if p in self.old] if self.old else []
        self.known.update(zip(again, map(self.old.__getitem__, again), strict=True))
        missing.difference_update(again)
        if missing:
            self._learn(list(missing))

    def texts(self, texts: list[bytes]) -> list[bytes]:
        self._age()
        if not texts:
            return []
        if not self.v.lower:
            return self._after_spaces(texts)
        split = [t.split() for t in texts]
        self._know(chain.from_iterable(split))
        return [self._slow(t.decode("utf-8")) if self._marked(t) else b"".join(map(self.known.__getitem__, pieces)) for t, pieces in zip(texts, split, strict=True)]

    def _marked(self, text: bytes) -> bool:
        return b"<|" in text and any(m in text for m in self.marks)

    def _after_spaces(self, texts: list[bytes]) -> list[bytes]:
        """Of byte-level texts: Arrow splits them and numbers the distinct pieces, then puts their
        ids in place; first pieces, which stand after no space, have numbers of their own."""
        split = pc.split_pattern(pa.array(texts, pa.large_binary()), pattern=b" ")
        starts = np.asarray(split.offsets).astype(np.int64)
        coded = split.values.dictionary_encode()
        at, distinct = np.asarray(coded.indices).astype(np.int64), _bytes_of(coded.dictionary)
        head = starts[:-1]
        later = np.zeros(len(distinct), bool)
        later[np.delete(at, head)] = True
        later = later.tolist()
        self._know(compress(distinct, later))
        ids = [self.known[p] if used else b"" for p, used in zip(distinct, later, strict=True)]
        odd = np.fromiter((x is None for x in ids), bool, len(ids))[at]
        own, place = np.unique(at[head], return_inverse=True)
        heads = [distinct[k] for k in own.tolist()]
        if new := [h for h in heads if h not in self.firsts]:
            found = [BYTE_WORDS.findall(h.decode("utf-8")) for h in new]
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
            self.firsts.update(zip(new, self._cut([t for f in found for t in f], ends), strict=True))
        at[head], odd[head] = len(ids) + place, False
        odd = np.logical_or.reduceat(odd, head)
        # A run of white space that the first space may extend, special tokens, white space beside a space: the slow path.
        spaced = np.fromiter((h[-4:].decode("utf-8", "ignore")[-1:].isspace() for h in heads), bool, len(heads))[place]
        odd |= spaced & (np.diff(starts) > 1)
        odd |= np.fromiter(map(self._marked, texts), bool, len(texts))
        joined = pa.array([x or b"" for x in ids] + [self.firsts[h] for h in heads], pa.large_binary()).take(pa.array(at))
        stops = np.frombuffer(joined.buffers()[1], np.int64)[starts].tolist()
        data = memoryview(joined.buffers()[2] or b"")
        return [self._slow(t.decode("utf-8")) if o else bytes(data[a:b]) for t, o, a, b in zip(texts, odd.tolist(), stops, stops[1:], strict=False)]


@lru_cache(maxsize=4)
def text_encoder(path: str) -> TextEncoder:
    """One encoder for each worker process and vocabulary."""
    return TextEncoder(vocabulary(path))

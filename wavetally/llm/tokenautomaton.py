"""BPE encoding by a compiled tokenization automaton, and decoding by its arc labels.

The automaton reads tokens. It starts as one state with an arc for every byte, and each
merge (u, v), in order, is one gadget: the state that u leads to is copied without its arc
for v, u leads to the copy from now on, and the new token uv gets an arc from every state
with an arc for u, to where v led. A token sequence is what BPE yields if and only if the
automaton has a path for it.

An arc's target depends on its token alone, so states are named by the token that leads to
them: the state of token a is born with a (as the state that a's right part had then), and
every later merge (a, v) copies it once more, forbidding v. A token t made later than a has
an arc where its left part had one when t was made. So the copies of a state need no rows
of their own: the table of (state, forbidden token, time of the copy), with the times and
parts of all tokens, answers an arc test in at most as many look-ups as a and t have parts.

Each prefix of a word has one path; the last token of a prefix is the one token that ends
there and has an arc from the state of the prefix before it. Words go through the tables
in numpy, all together, one byte a step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Pairs, TextEncoder, Vocabulary, vocabulary
from .common import chunks, text_bytes

NEVER = np.int32(2**31 - 1)


class Automaton:
    def __init__(self, v: Vocabulary):
        if v.suffix:
            raise ValueError("word-end vocabularies have other start symbols")
        self.v = v
        made = [int(NEVER)] * v.size  # time of making; bytes at -1
        for t in v.first.tolist():
            made[t] = -1
        left, right, copies = [0] * v.size, [0] * v.size, {}
        for k, (a, b, c) in enumerate(zip(v.left.tolist(), v.right.tolist(), v.merged.tolist(), strict=True)):
            if self._arc(made, left, right, copies, a, b):  # else no tokenization has a then b: c cannot arise
                made[c], left[c], right[c], copies[a, b] = k, a, b, k
        self.made, self.left, self.right = (np.array(x, np.int32) for x in (made, left, right))
        pairs = np.array(list(copies), np.int64).reshape(-1, 2)
        self.copies = Pairs(pairs[:, 0], pairs[:, 1], np.array(list(copies.values()), np.int32))
        self._trie()

    @staticmethod
    def _arc(made, left, right, copies, a: int, t: int) -> bool:
        until = int(NEVER)
        while True:
            if copies.get((a, t), until) < until:
                return False
            if made[a] < 0 and made[t] < 0:
                return True
            if made[t] >= made[a]:  # t's arcs were made after the copy of the same merge
                t, until = left[t], made[t] + 1
            else:  # a's state was born before it
                a, until = right[a], made[a]

    def arcs(self, a: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Which states (of last tokens a, or -1 at the start) have an arc for tokens t."""
        out, todo = np.ones(len(a), bool), np.flatnonzero(a >= 0)
        a, t = a[todo], t[todo]
        until = np.full(len(todo), NEVER, np.int32)
        while len(todo):
            k = self.copies.get(a, t)
            banned = (k >= 0) & (k < until)
            out[todo[banned]] = False
            made_a, made_t = self.made[a], self.made[t]
            later = made_t >= made_a
            go = ~banned & (np.maximum(made_a, made_t) >= 0)
            todo, a, t, later, until = todo[go], a[go], t[go], later[go], np.where(later, made_t + 1, made_a)[go]
            a, t = np.where(later, a, self.right[a]), np.where(later, self.left[t], t)
        return out

    def _trie(self) -> None:
        """Bytes of all tokens that can arise, as a trie in one table."""
        nodes: dict[tuple[int, int], int] = {}
        token = [-1]
        for t in np.flatnonzero(self.made < NEVER).tolist():
            at = 0
            for byte in self.v.labels[t]:
                nxt = nodes.get((at, byte))
                if nxt is None:
                    nxt = nodes[at, byte] = len(token)
                    token.append(-1)
                at = nxt
            token[at] = t
        a, b = np.array(list(nodes), np.int64).reshape(-1, 2).T
        self.child, self.token = Pairs(a, b, np.array(list(nodes.values()), np.int32)), np.array(token, np.int32)

    def words(self, words: list[bytes], most: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._words(words[k : k + most]) for k in range(0, len(words), most)]
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = len(words)
        lens = np.fromiter(map(len, words), np.int64, n)
        data = np.frombuffer(b"".join(words), np.uint8)
        base = np.cumsum(lens) - lens  # first byte of each word
        # ``last[base + w + i]``: token that ends after i bytes of word w; ``length`` its bytes
        first = base + np.arange(n)
        last, length = np.full(len(data) + n, -1, np.int32), np.zeros(len(data) + n, np.int32)
        words_by_length = np.argsort(-lens, kind="stable")
        open_w = np.zeros(0, np.int64)  # word, start and trie node of open substrings
        open_at, node = np.zeros(0, np.int64), np.zeros(0, np.int32)
        counts = np.searchsorted(-lens[words_by_length], -np.arange(1, (lens.max() if n else 0) + 1), "right")
        for i, alive in enumerate(counts.tolist()):
            fresh = words_by_length[:alive]  # words of more than i bytes
            keep = lens[open_w] > i
            open_w = np.concatenate((open_w[keep], fresh))
            open_at = np.concatenate((open_at[keep], np.full(alive, i)))
            node = self.child.get(np.concatenate((node[keep], np.zeros(alive, np.int32))), data[base[open_w] + i])
            there = node >= 0
            open_w, open_at, node = open_w[there], open_at[there], node[there]
            t = self.token[node]
            hit = np.flatnonzero(t >= 0)
            before = first[open_w[hit]] + open_at[hit]
            good = hit[self.arcs(last[before], t[hit])]
            to = first[open_w[good]] + i + 1
            last[to], length[to] = t[good], i + 1 - open_at[good]
        # back from the end of each word
        at, w, out_t, out_w, out_p = lens.copy(), np.arange(n), [], [], []
        live = at > 0
        while live.any():
            w, at = w[live], at[live]
            cell = first[w] + at
            out_t.append(last[cell])
            out_w.append(w)
            out_p.append(at)
            at = at - length[cell]
            live = at > 0
        if not out_t:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        t, w, p = np.concatenate(out_t), np.concatenate(out_w), np.concatenate(out_p)
        order = np.argsort(first[w] + p, kind="stable")
        return t[order], np.bincount(w, minlength=n)


@lru_cache(maxsize=2)
def codec(path: str) -> tuple[TextEncoder, Vocabulary]:
    v = vocabulary(path)
    return TextEncoder(v, words=Automaton(v).words), v


class Emitter:
    """Labels of arcs, and decimal ids, by one gather over all of a text's tokens."""

    def __init__(self, strings: list[bytes]):
        lens = np.array([len(s) for s in strings], np.int64)
        self.data, self.lens = np.frombuffer(b"".join(strings), np.uint8), lens
        self.at = np.cumsum(lens) - lens

    def emit(self, ids: np.ndarray) -> bytes:
        n = self.lens[ids]
        ends = np.cumsum(n)
        return self.data[np.repeat(self.at[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


def roundtrip(docs: DataFrame, vocabulary_path: str, keep: list[Column | str], text_col: str = "text", block: int = 1 << 18) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256 and decoded_sha256 of each whole text.

    Null texts count as empty: no tokens, digests of nothing. Bytes that are no UTF-8 after
    decoding become U+FFFD, as in the library. Long texts are emitted ``block`` tokens at a
    time. Repeated rows have equal results; other columns are not read.
    """
    kept = docs.select(*keep)
    schema = kept.schema.simpleString()[7:-1].replace(":", " ")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, v = codec(vocabulary_path)
        labels, decimals = Emitter(v.labels), Emitter([b"%d," % i for i in range(v.size)])
        for b in chunks(batches, "_text"):
            n, ids_sha, text_sha = [], [], []
            for data in encoder.texts(b.column("_text").to_pylist()):
                ids = np.frombuffer(data, "<u2")
                h, out = hashlib.sha256(), []
                for at in range(0, len(ids), block):
                    part = ids[at : at + block]
                    h.update(decimals.emit(part)[: None if at + block < len(ids) else -1])
                    out.append(labels.emit(part))
                n.append(len(ids))
                ids_sha.append(h.hexdigest())
                decoded = b"".join(out).decode("utf-8", "replace").encode("utf-8")
                text_sha.append(hashlib.sha256(decoded).hexdigest())
            out = b.drop_columns(["_text"]).append_column("n_tokens", pa.array(n, pa.int64()))
            yield out.append_column("ids_sha256", pa.array(ids_sha)).append_column("decoded_sha256", pa.array(text_sha))

    return docs.select(*keep, text_bytes(text_col).alias("_text")).mapInArrow(of, f"{schema}, n_tokens long, ids_sha256 string, decoded_sha256 string")

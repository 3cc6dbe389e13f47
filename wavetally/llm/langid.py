"""Language identification by rank-order n-gram profiles.

A profile is the ``top`` most frequent n-grams (1 to 3 letters, words padded with ``_``)
in rank order. A document takes the language whose profile has the least out-of-place
distance to its own; an n-gram that a profile lacks counts ``top``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_batch, chunks, text_bytes

LETTERS = regex.compile(r"\p{L}+")
PAD, GAP = ord("_"), ord(" ")
#: Words of one text that are looked up at a time, and entries of the dictionary.
BLOCK, KNOWN = 100_000, 150_000


class Grams:
    """n-gram counts of whole texts; those of each distinct word are kept."""

    def __init__(self):
        self.known: dict[bytes, bytes] = {}

    def _learn(self, words: list[bytes]) -> None:
        padded = ["_" + "_".join(found) + "_" if (found := LETTERS.findall(w.decode("utf-8").lower())) else "" for w in words]
        c = np.frombuffer((" ".join(padded) + "   ").encode("utf-32-le"), np.uint32).astype(np.int64)
        a, b, d = c[:-2], c[1:-1], c[2:]
        one = (a != PAD) & (a != GAP)
        two = (a != GAP) & (b != GAP) & ((a != PAD) | (b != PAD))
        three = two & (d != GAP) & (b != PAD)
        grams = np.stack([a << 42, a << 42 | b << 21, a << 42 | b << 21 | d], axis=1)
        there = np.stack([one, two, three], axis=1)
        data = grams[there].tobytes()
        gaps = np.flatnonzero(a == GAP)[: len(words)]
        ends = (np.cumsum(there.sum(axis=1))[gaps] * 8).tolist()
        self.known.update((w, data[s:e]) for w, s, e in zip(words, [0, *ends[:-1]], ends, strict=True))

    def counts(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of a text, as numbers in code point order, and their counts."""
        words, parts = text.split(), []
        for at in range(0, len(words), BLOCK):
            block = words[at : at + BLOCK]
            if missing := set(filterfalse(self.known.__contains__, block)):
                if len(self.known) > KNOWN:
                    self.known.clear()
                    missing = set(block)
                self._learn(list(missing))
            parts.append(np.unique(np.frombuffer(b"".join(map(self.known.__getitem__, block)), np.int64), return_counts=True))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(parts) == 1:
            return parts[0]
        grams, pos = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return grams, np.bincount(pos, np.concatenate([p[1] for p in parts])).astype(np.int64)


def ranked(grams: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent first; ties by code points."""
    return grams[np.lexsort((grams, -counts))[:top]]


def learn_profiles(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", top: int = 300, sample: int = 3000) -> dict[str, np.ndarray]:
    """Profiles of all languages among the rows of ``train`` with a language. About
    ``sample`` documents of each language are read, whole, chosen by a hash of their id.
    The driver gets ``top`` n-grams a language."""
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    size = rows.groupBy(lang_col).agg(F.count("*").alias("n"))
    share = {r[0]: min(1.0, sample / r[1]) for r in size.collect()}
    if not share:
        return {}
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(10)), F.lit(1_000_000)) / 1e6
    pick = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col(lang_col))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = Grams(), {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                g, n = grams.counts(text)
                mine = total.setdefault(lang, {})
                for k, v in zip(g.tolist(), n.tolist(), strict=True):
                    mine[k] = mine.get(k, 0) + v
        schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
        for lang, mine in total.items():
            yield as_batch(schema, [lang] * len(mine), list(mine), list(mine.values()))

    counted = rows.where(draw < pick).select(F.col(lang_col).cast("string"), text_bytes(text_col)).mapInArrow(of, "lang string, gram long, n long")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).toPandas()
    return {lang: g.sort_values("r")["gram"].to_numpy() for lang, g in sorted(best.groupby("lang"))}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], keep: list[Column | str], text_col: str = "text", top: int = 300, none: str = "und") -> DataFrame:
    """``keep`` columns, lang_pred and score (1: the profile itself, 0: nothing shared).

    Texts that are null or have no letter are ``none`` with score 0, and so are all where
    no profile was learned. Equal distances go to the first language in order.
    """
    langs = sorted(profiles)
    known = np.unique(np.concatenate([profiles[k] for k in langs])) if langs else np.zeros(0, np.int64)
    place = np.full((len(known) + 1, len(langs)), top, np.int64)
    for i, k in enumerate(langs):
        place[np.searchsorted(known, profiles[k]), i] = np.arange(len(profiles[k]))
    missing = place == top
    kept = docs.select(*keep)
    schema = kept.schema.simpleString()[7:-1].replace(":", " ")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in chunks(batches, "_text"):
            said, score = [], []
            for text in b.column("_text").to_pylist():
                mine = ranked(*grams.counts(text), top)
                if not len(mine) or not langs:
                    said.append(none)
                    score.append(0.0)
                    continue
                at = np.searchsorted(known, mine)
                at[at == len(known)] = 0
                at = np.where(known[at] == mine, at, len(known))
                far = np.where(missing[at], top, np.abs(place[at] - np.arange(len(mine))[:, None])).sum(axis=0)
                best = int(np.argmin(far))
                said.append(langs[best])
                score.append(1.0 - float(far[best]) / (top * len(mine)))
            out = b.drop_columns(["_text"])
            yield out.append_column("lang_pred", pa.array(said, pa.string())).append_column("score", pa.array(score, pa.float64()))

    return docs.select(*keep, text_bytes(text_col).alias("_text")).mapInArrow(of, f"{schema}, lang_pred string, score double")

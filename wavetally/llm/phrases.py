"""Phrase collocations by Apriori level-wise passes.

Level k counts the phrases of k words that can be frequent: only those whose first and last
k - 1 words are both frequent phrases of the level below. The frequent phrases of that level
reach every task as a bitmap of their hashes, whose size is a parameter and does not grow with
the data; a phrase that passes by a foreign bit is counted like any other and leaves at the
threshold, so counts are exact at every size. Tasks count in numpy and send each distinct
phrase once. Cuts are then scored by joins with the level tables.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_batch, chunks, text_bytes, written

#: Marks that end a piece, all read as the first of them.
BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"." * 10)
BASE = 0x9E3779B97F4A7C15
COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("n", pa.int64())])
#: Bytes of text at a time, distinct phrases a task holds, and distinct words it remembers.
BLOCK, HELD, KNOWN = 4 << 20, 200_000, 1 << 19


def parts(texts: list[bytes], most: int = BLOCK) -> Iterator[tuple[bytes, bool]]:
    """The texts, joined by a break, in parts of about ``most`` bytes that end between words;
    and whether a part goes on where the one before it stopped."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > most:
            yield b".".join(held), False
            held, size = [], 0
        if len(text) <= most:
            held.append(text)
            size += len(text)
            continue
        at = 0
        while at < len(text):
            end = min(len(text), at + most)
            while end < len(text) and text[end] not in b" \t":
                end += 1
            yield text[at:end], at > 0
            at = end
    if held:
        yield b".".join(held), False


def words_of(text: bytes) -> list[bytes]:
    """Words in order, with ``.`` between pieces. Only A to Z are lower-cased."""
    return text.translate(BREAKS).replace(b".", b" . ").lower().split()


class Grams:
    """Local numbers and hashes of words; number 0 is the break."""

    def __init__(self):
        self.ids, self.hashes = {b".": 0}, np.zeros(1, np.uint64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        new = set(words).difference(self.ids)
        if len(self.ids) + len(new) > KNOWN and len(self.ids) > 1:
            self.__init__()
            new = set(words).difference(self.ids)
        if new:
            n = len(self.ids)
            self.ids.update(zip(new, range(n, n + len(new)), strict=True))
            self.hashes = np.concatenate((self.hashes, np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))))
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    @staticmethod
    def places(hashes: list[np.ndarray], lang: str, log_bits: int) -> np.ndarray:
        """Where phrases stand in the bitmap: their words' hashes in order, and the language."""
        g = np.full(len(hashes[0]), xxhash.xxh64_intdigest(lang.encode("utf-8"), 7), np.uint64)
        for h in hashes:
            g = (g ^ h) * np.uint64(BASE)
            g ^= g >> np.uint64(29)
        return g >> np.uint64(64 - log_bits)


def _frequent(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def candidates(ids: np.ndarray, hashes: np.ndarray, lang: str, k: int, bits: np.ndarray, log_bits: int) -> np.ndarray:
    """Starts of phrases of k words within a piece whose two shorter phrases are frequent."""
    m = len(ids) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    stops = np.concatenate(([0], np.cumsum(ids == 0)))
    at = np.flatnonzero(stops[k:] == stops[:m])
    h = hashes[ids]
    need = np.zeros(m + 1, bool)
    need[at] = need[at + 1] = True
    below = np.flatnonzero(need)
    good = np.zeros(m + 1, bool)
    good[below] = _frequent(bits, Grams.places([h[below + j] for j in range(k - 1)], lang, log_bits))
    return at[good[at] & good[at + 1]]


def tally(ids: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """One start of each distinct phrase of k words among those at ``at``, and their counts."""
    key = ids[at]
    for j in range(1, k):  # a number has 20 bits, so three fit beside one another
        if j >= 3:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key << 20 | ids[at + j]
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return at[first], n


def count_level(docs: DataFrame, k: int, least: int, bits: np.ndarray | None, log_bits: int) -> DataFrame:
    """docs: (lang, text as bytes). (lang, phrase, n) of phrases of k words with n of ``least``
    or more; at level 1 also a row without phrase that counts all words of the language."""
    sent = docs.sparkSession.sparkContext.broadcast(bits.tobytes() if bits is not None else b"")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, grams, total = np.frombuffer(sent.value, np.uint8), Grams(), {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, mine in total.items():
                yield as_batch(COUNTS, [lang] * len(mine), list(mine), list(mine.values()))
            total.clear()

        for b in chunks(batches, "text", BLOCK):
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                mine, tail = total.setdefault(lang, Counter()), []
                for part, goes_on in parts(texts):
                    words = (tail if goes_on else []) + words_of(part)
                    tail = words[len(words) - k + 1 :] if k > 1 else []
                    if k == 1:
                        found = Counter(words)
                        found.pop(b".", None)
                        mine.update(found)
                        mine[None] += sum(found.values())
                        continue
                    ids = grams.numbers(words)
                    at = candidates(ids, grams.hashes, lang, k, table, log_bits)
                    for p, n in zip(*(x.tolist() for x in tally(ids, at, k)), strict=True):
                        mine[b" ".join(words[p : p + k])] += n
            if sum(map(len, total.values())) > HELD:
                yield from flush()
        yield from flush()

    counted = docs.mapInArrow(of, "lang string, phrase binary, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return counted.where(F.col("phrase").isNull() | (F.col("n") >= least)).select("lang", F.col("phrase").cast("string").alias("phrase"), "n", F.lit(k).alias("k"))


def bitmap(level: DataFrame, log_bits: int) -> np.ndarray:
    """The hashes of a level's phrases as a bitmap: at most 2 ** log_bits / 64 rows reach the driver."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("slot", pa.int64()), ("bits", pa.int64())])
        for b in batches:
            found = []
            for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.append(Grams.places([np.array([xxhash.xxh64_intdigest(w)], np.uint64) for w in phrase.split(b" ")], lang, log_bits)[0])
            at = np.array(found, np.uint64)
            yield as_batch(schema, (at >> np.uint64(6)).astype(np.int64), (np.uint64(1) << (at & np.uint64(63))).view(np.int64))

    rows = level.where("phrase IS NOT NULL").select("lang", text_bytes("phrase")).mapInArrow(of, "slot long, bits long")
    found = rows.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(1 << (log_bits - 6), np.int64)
    out[found["slot"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def levels(docs: DataFrame, longest: int = 5, least: int = 100, log_bits: int = 26, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Frequent phrases of 1 to ``longest`` words: lang (null: ``und``), phrase, n, k; and of
    each language a row without phrase that counts its words. A level without phrases ends it."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_bytes(text_col).alias("text"))
    found, bits = [], None
    for k in range(1, longest + 1):
        found.append(written(count_level(rows, k, least, bits, log_bits), f"level-{k}"))
        if k < longest:
            bits = bitmap(found[-1], log_bits)
            if not bits.any():
                break
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    return out


def scored(frequent: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, n, score of all phrases of two words or more: the cut with the
    lowest floor(1000 a n / (l r)), the earliest of equal ones."""
    total = frequent.where("phrase IS NULL").select("lang", F.col("n").alias("total"))
    total = F.broadcast(total) if total.count() <= 100_000 else total  # one row a language
    grams = frequent.where("phrase IS NOT NULL")
    words = F.split("phrase", " ")
    cut = grams.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), words.alias("w"), F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cut = cut.withColumns({"first": F.array_join(F.expr("slice(w, 1, cut)"), " "), "rest": F.array_join(F.expr("slice(w, cut + 1, k - cut)"), " ")}).drop("w")
    part = lambda name, n: grams.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    both = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(total, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    both = both.withColumns({"_x": F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("total"), "_y": wide("l") * wide("r")})
    best = both.groupBy("lang", "phrase", "k", "a", F.col("total").alias("n")).agg(F.min(F.struct(F.expr("_x div _y").alias("score"), "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "k", "a", "best.l", "best.r", "n", "best.score")


def uncovered(table: DataFrame) -> DataFrame:
    """Without phrases that lie in a longer one of equal count. A phrase has at least the count
    of any that holds it, so one word more is enough: all between have the same count."""
    w = F.split("phrase", " ")
    inner = F.array_distinct(F.array(F.array_join(F.slice(w, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(w, F.lit(2), F.col("k") - 1), " ")))
    longer = table.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("a")).withColumnRenamed("a", "_a")
    return table.join(longer, ["lang", "phrase"], "left").where("_a IS NULL OR _a < a").drop("_a")


def mine(docs: DataFrame, top: int = 2000, longest: int = 5, least: int = 100, text_col: str = "text", lang_col: str = "lang", log_bits: int = 26) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Null texts have no words, null languages are ``und``, other columns are not read; repeated
    rows count as often as they stand. No documents or no frequent phrase: an empty table. The
    best of 64 parts are ranked first, so no task ranks all phrases of a language.
    """
    table = written(uncovered(scored(levels(docs, longest, least, log_bits, text_col, lang_col))), "phrases")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = table.withColumn("_r", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("_r") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words sums, over subsequences of three and four characters, the products
of their gap weights ``DECAY ** span`` (spans up to ``SPAN``), scaled by a factor of each
word's length; it sees a word through inserted characters and gaps, in any script, and runs
of single letters ("i d i o t") are read as one word.

Labels belong to whole texts, while few of a toxic text's words are to blame. So the machine
is trained as a multiple-instance one: first on all words of the labelled texts with their
texts' labels, then in turns on the witnesses of each toxic text (its words of 0.5 and more, or
else the one of the highest) against all words of clean texts. Every step is a sum of normal equations over Spark
partitions; the driver sees a matrix as large as the number of landmarks. The decision
function is a sum of kernels with the landmarks, so it is kept as one weight per (hashed)
subsequence, and a word costs a few look-ups. A text's score comes from its most suspicious
words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, filterfalse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, drop_written, text_bytes, written

DECAY, SPAN, LONGEST = 0.75, 7, 24
#: Subsequences are hashed into so many weights.
TABLE_BITS = 21
#: Words of one text that are looked up at a time, and entries of the dictionary.
BLOCK, KNOWN = 200_000, 400_000
#: So many of a text's most suspicious words count; NOTHING stands in for missing ones.
TOP, NOTHING = 3, -1.5
STRIP = ".,;:!?\"'()[]{}<>|#$%&*-_/\\=+~`"


@lru_cache(maxsize=64)
def _tuples(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words of n characters: positions and weights of their subsequences."""
    out = []
    for k in (3, 4):
        at = [t for i in range(n - k + 1) for r in combinations(range(i + 1, min(n, i + SPAN)), k - 1) for t in [(i, *r)]]
        at = np.array(at, np.int64).reshape(-1, k)
        out.append((at, DECAY ** (at[:, -1] - at[:, 0] + 1.0) if len(at) else np.zeros(0)))
    return out


@lru_cache(maxsize=64)
def _scale(n: int) -> float:
    total = sum(float((w**2).sum()) for _, w in _tuples(n))
    return 1 / np.sqrt(total) if total else 0.0


def _features(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per word length: which words, hashed keys (words, tuples), weights (tuples)."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lens).tolist():
        if n < 3:
            continue
        which = np.flatnonzero(lens == n)
        c = np.frombuffer("".join([words[k] for k in which]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(-1, n)
        keys, weights = [], []
        for at, w in _tuples(n):
            if len(w):
                key = c[:, at[:, 0]]
                for j in range(1, at.shape[1]):
                    key = key * np.uint64(0x9E3779B1) + c[:, at[:, j]]
                keys.append(((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64))
                weights.append(w * _scale(n))
        yield which, np.concatenate(keys, axis=1), np.concatenate(weights)


_MARKS = str.maketrans("", "", STRIP)


@lru_cache(maxsize=100_000)
def plain(token: bytes) -> tuple[str, ...]:
    """A token without marks around it, lower case, after a sign for its start, and, if there
    are marks within, once more without them; over ``LONGEST`` characters, overlapping parts
    that together hold every span of the whole."""
    word = token.decode("utf-8", "replace").lower().strip(STRIP)
    if len(word) < LONGEST and word.isalnum():
        return ("^" + word,)
    bare = word.translate(_MARKS)
    return tuple(w[k : k + LONGEST] for w in ("^" + x for x in ((word,) if bare == word else (word, bare))) for k in range(0, max(1, len(w) - SPAN) if len(w) > LONGEST else 1, LONGEST - SPAN))


def spelled(tokens: list[bytes], single: np.ndarray) -> list[tuple[int, bytes]]:
    """Where runs of three or more single letters begin, and the words they spell."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], single.astype(np.int8), [0]))))
    return [(a, b"".join(tokens[a:b])) for a, b in edges.reshape(-1, 2).tolist() if b - a >= 3]


def units(text: bytes) -> list[tuple[int, str]]:
    """All words of a text with their places, spelled ones among them."""
    tokens = text.split()
    parts = list(map(plain, tokens))
    single = np.fromiter((len(p) == 1 and len(p[0]) == 2 for p in parts), bool, len(parts))
    extra = [(i, p) for i, w in spelled(tokens, single) for p in plain(w)] if single.any() else []
    return [(i, p) for i, ps in enumerate(parts) for p in ps if len(p) > 3] + extra


class Scorer:
    """Kernel expansion sum_l beta_l k(word, landmark_l) + bias, by subsequence weights."""

    def __init__(self, table: np.ndarray, bias: float, link: tuple[float, ...] = ()):
        self.table, self.bias, self.link = table, bias, link
        self.known: dict[bytes, float] = {}

    def raw(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        for k in range(0, len(words), 4096):
            for which, keys, weights in _features(words[k : k + 4096]):
                out[k + which] += self.table[keys] @ weights
        return out

    def words(self, tokens: list[bytes]) -> np.ndarray:
        """The largest score of each token's parts; NaN for single letters."""
        parts = list(map(plain, tokens))
        flat = [p for ps in parts for p in ps]
        if not flat:
            return np.zeros(0)
        place = {p: k for k, p in enumerate(dict.fromkeys(flat))}  # tokens differ in marks and capitals
        scores = self.raw(list(place))[np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))]
        starts = np.cumsum([0] + [len(p) for p in parts])[:-1]
        out = np.maximum.reduceat(scores, starts)
        out[[len(p) == 1 and len(p[0]) == 2 for p in parts]] = np.nan
        return out

    def prepare(self, texts: list[bytes]) -> None:
        """Scores the new words of many texts together."""
        if len(self.known) > KNOWN:
            self.known.clear()
        missing: set[bytes] = set()
        for text in texts:
            missing.update(filterfalse(self.known.__contains__, text.split()))
            if len(missing) > BLOCK:
                self._learn(missing)
                missing = set()
        self._learn(missing)

    def _learn(self, missing: set[bytes]) -> None:
        tokens = list(missing)
        self.known.update(zip(tokens, self.words(tokens).tolist(), strict=True))

    def evidence(self, text: bytes) -> list[float]:
        """Scores of the most suspicious words, repeats counted, and the text's length (a
        long text meets such words by chance)."""
        tokens, best = text.split(), [NOTHING] * TOP
        for at in range(0, len(tokens), BLOCK):
            block = tokens[at : at + BLOCK]
            if missing := set(filterfalse(self.known.__contains__, block)):
                self._learn(missing)
            v = np.fromiter(map(self.known.__getitem__, block), np.float64, len(block))
            single = np.isnan(v)
            if single.any():
                v[single] = NOTHING
                if more := [w for _, w in spelled(block, single)]:
                    v = np.concatenate((v, np.nan_to_num(self.words(more), nan=NOTHING)))
            best += (np.partition(v, len(v) - TOP) if len(v) > TOP else v)[-TOP:].tolist()
        return [*sorted(best)[-TOP:], float(np.log1p(len(tokens)))]

    def score(self, text: bytes) -> float:
        z = self.link[0] + sum(w * e for w, e in zip(self.link[1:], self.evidence(text), strict=True))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


# ---------------------------------------------------------------- Nyström features
class Landmarks:
    """Kernels with the landmarks by lists of (landmark, weight) for each subsequence."""

    def __init__(self, marks: list[str]):
        self.marks = marks
        found = [(keys, np.broadcast_to(which[:, None], keys.shape), np.broadcast_to(weights, keys.shape)) for which, keys, weights in _features(marks)]
        key, mark, weight = (np.concatenate([f[k].ravel() for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        order = np.argsort(key, kind="stable")
        self.mark, self.weight = mark[order], weight[order].astype(np.float64)
        self.key, self.start, self.n = np.unique(key[order], return_index=True, return_counts=True)
        values, vectors = np.linalg.eigh(self.kernel(marks))
        good = values > 1e-6 * values.max(initial=0.0)
        self.root = vectors[:, good] / np.sqrt(values[good])

    def kernel(self, words: list[str]) -> np.ndarray:
        m = len(self.marks)
        out = np.zeros(len(words) * m)
        for which, keys, weights in _features(words):
            at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
            row, column = np.nonzero(self.key[at] == keys)
            at = at[row, column]
            n = self.n[at]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            entry = np.repeat(self.start[at], n) + inside
            out += np.bincount(np.repeat(which[row] * m, n) + self.mark[entry], np.repeat(weights[column], n) * self.weight[entry], len(out))
        return out.reshape(len(words), m)

    def table(self, theta: np.ndarray) -> np.ndarray:
        """One weight for each subsequence of the machine ``theta`` over the features."""
        coefficient = self.root @ theta[:-1]
        return np.bincount(np.repeat(self.key, self.n), self.weight * coefficient[self.mark], 1 << TABLE_BITS)


# ---------------------------------------------------------------- training
def _fit(words: DataFrame, marks: list[str], steps: int, ridge: float) -> tuple[np.ndarray, float]:
    """The machine (squared hinge, Newton steps) trained on ``words``: w, and the weights
    ``up`` and ``down`` of the word as one of a toxic and as one of a clean text."""
    landmarks, theta = Landmarks(marks), None
    shared = words.sparkSession.sparkContext.broadcast(landmarks)  # a few MB
    width = landmarks.root.shape[1] + 1

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                x = (mine.kernel(b.column(0).to_pylist()) @ mine.root).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]), *(pa.array([np.asarray(b.column(k)).tobytes()]) for k in (1, 2))], names=["x", "up", "down"])

    blocks = written(words.select("w", F.col("up").cast("double"), F.col("down").cast("double")).mapInArrow(features, "x binary, up binary, down binary"), "features")
    n_up, n_down = words.agg(F.sum("up"), F.sum("down")).first()
    keep = np.full(width, ridge)
    keep[-1] = 1e-9
    for _ in range(steps):

        def equations(batches: Iterator[pa.RecordBatch], theta=theta) -> Iterator[pa.RecordBatch]:
            a, b = np.zeros((width, width)), np.zeros(width)
            for batch in batches:
                for data, up, down in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    p, n = np.frombuffer(up) * (0.5 / n_up), np.frombuffer(down) * (0.5 / n_down)
                    x = np.hstack([np.frombuffer(data, np.float32).reshape(len(p), width - 1), np.ones((len(p), 1))])
                    if theta is not None:  # else all are inside
                        f = x @ theta
                        p, n = np.where(f < 1, p, 0.0), np.where(f > -1, n, 0.0)
                    a += (x * (p + n)[:, None]).T @ x
                    b += x.T @ (p - n)
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([b.tobytes()])], names=["a", "b"])

        a, b = np.diag(keep), np.zeros(width)
        for r in blocks.mapInArrow(equations, "a binary, b binary").toLocalIterator():  # one row a partition
            a += np.frombuffer(r["a"]).reshape(width, width)
            b += np.frombuffer(r["b"])
        new = np.linalg.solve(a, b)
        done = theta is not None and np.abs(new - theta).max() < 1e-6 * np.abs(new).max()
        theta = new
        if done:
            break
    drop_written(blocks)
    shared.destroy()
    return landmarks.table(theta), float(theta[-1])


def _drawn(words: DataFrame, importance: Column, sure: Column, instances: int, tasks: int) -> DataFrame:
    """About ``instances`` words and those that are ``sure``, drawn by importance; the weights
    of a word are divided by its chance, so that sums over all words keep their expectation."""
    words = words.withColumn("s", importance)
    total = words.agg(F.sum("s")).first()[0] or 1.0
    words = words.withColumn("p", F.when(sure, 1.0).otherwise(F.least(F.lit(1.0), F.col("s") * instances / total)))
    drawn = words.where(F.pmod(F.xxhash64("w", F.lit(9)), F.lit(1 << 30)) < F.col("p") * (1 << 30))
    return written(drawn.select("w", (F.col("up") / F.col("p")).alias("up"), (F.col("down") / F.col("p")).alias("down")).repartition(tasks), "drawn")


def _around(tokens: list[bytes], i: int) -> int:
    """The neighbours of a word, as a hash."""
    return xxhash.xxh64_intdigest(b" ".join(tokens[max(0, i - 1) : i] + tokens[i + 1 : i + 2])) >> 1


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    w = np.zeros(x.shape[1])
    for _ in range(100):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 24_000, instances: int = 16_000, landmarks: int = 480, turns: int = 2, ridge: float = 1e-4, tasks: int = 8) -> Scorer:
    """Fits on about ``sample`` labelled documents (chosen by a hash of their id, whole
    texts) for which ``use`` holds. The driver gets the landmarks, their normal equations
    from each of ``tasks`` partitions, and a few numbers of each sampled document. A fit takes
    about ``instances`` of the words, drawn by importance.

    Null labels and labels of missing documents are left out; a document with several labels
    is toxic if one says so. Equal texts count once (toxic if one is). A word counts in toxic
    texts as often as it has different neighbours there, so that near copies of a text lend
    its words no weight. Without toxic or without clean texts the scorer calls none toxic.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & use).groupBy(id_col).agg(F.max(label_col).alias("bad"))
    share = min(1.0, sample / max(1, known.count()))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(8)), F.lit(1_000_000)) / 1e6
    few = known.where(draw < share).select(F.col(id_col).alias("_id"), F.col("bad").cast("int").alias("_bad"))
    # ``few`` holds about ``sample`` rows of two numbers, whatever the input.
    texts = docs.select(F.col(id_col).alias("_id"), text_bytes(text_col).alias("_text")).join(F.broadcast(few), "_id").select("_bad", "_text")
    texts = texts.groupBy(F.xxhash64("_text").alias("_hash")).agg(F.max("_bad").alias("_bad"), F.first("_text").alias("_text"))
    texts = written(texts.select("_bad", "_text"), "sampled")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("w", pa.string()), ("near", pa.int64()), ("g", pa.int64())])
        for b in chunks(batches, "_text"):
            good: dict[str, int] = {}
            bad: set[tuple[str, int]] = set()
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not toxic:
                    for _, w in units(text):
                        good[w] = good.get(w, 0) + 1
                    continue
                tokens = text.split()
                near = [_around(tokens, i) for i in range(len(tokens))]
                bad.update((p, near[i]) for i, p in units(text))
            w = [*good, *(x for x, _ in bad)]
            near = pa.concat_arrays([pa.nulls(len(good), pa.int64()), pa.array([x for _, x in bad], pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), near, pa.array([*good.values(), *[0] * len(bad)], pa.int64())], schema=schema)

    counted = texts.mapInArrow(seen, "w string, near long, g long").groupBy("w", "near").agg(F.sum("g").alias("g"))
    counted = counted.groupBy("w").agg(F.count("near").cast("double").alias("up"), F.sum("g").cast("double").alias("down"))
    counted = written(counted, "words")
    n_b, n_g = counted.agg(F.sum("up"), F.sum("down")).first()
    if not n_b or not n_g:
        return Scorer(np.zeros(1 << TABLE_BITS), -1.0, (-4.0, *[0.0] * (TOP + 1)))

    def most(rows: DataFrame, order: list[Column], n: int) -> list[str]:
        return [r["w"] for r in rows.orderBy(*order, "w").limit(n).select("w").collect()]

    third = landmarks // 3
    rest = most(counted.where("down > 0"), [F.xxhash64("w")], third)
    excess = F.col("up") * F.log((F.col("up") / n_b) / ((F.col("down") + 1) / (n_g + 1)))
    marks = most(counted.where("up > 0"), [F.desc(excess)], third) + most(counted.where("down > 0"), [F.desc("down")], third) + rest
    drawn = _drawn(counted, F.col("up") * (n_g / n_b) + F.col("down"), F.lit(False), instances, tasks)
    table, bias = _fit(drawn, list(dict.fromkeys(marks)), 3, ridge)
    drop_written(drawn)
    for _ in range(turns):
        shared = docs.sparkSession.sparkContext.broadcast((table.astype(np.float32), bias))

        def witness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer, known = Scorer(*shared.value), {}
            for b in chunks(batches, "_text"):
                found = []
                for text in b.column(0).to_pylist():
                    us = units(text)
                    if missing := list({u for _, u in us if u not in known}):
                        known.update(zip(missing, scorer.raw(missing).tolist(), strict=True))
                    if us:
                        worst, tokens = max(known[u] for _, u in us), text.split()
                        found += [(u, _around(tokens, i)) for i, u in us if known[u] >= min(0.5, worst)]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())], names=["w", "near"])

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(*shared.value)
            for b in batches:
                yield b.append_column("f", pa.array(scorer.raw(b.column(0).to_pylist())))

        blamed = texts.where("_bad = 1").select("_text").mapInArrow(witness, "w string, near long").distinct().groupBy("w").agg(F.count("*").cast("double").alias("up"))
        now = counted.select("w", "down").join(blamed, "w", "left").select("w", F.coalesce("up", F.lit(0.0)).alias("up"), "down").where("up > 0 or down > 0")
        now = written(now.mapInArrow(scored, "w string, up double, down double, f double"), "witnesses")
        near = F.col("down") * F.exp(4 * F.greatest(F.lit(-2.0), F.least(F.lit(1.0), F.col("f"))))
        hard = most(now.where("down > 0 and up = 0"), [F.desc(near)], third)
        marks = most(now.where("up > 0"), [F.desc("up")], third) + hard + rest
        drawn = _drawn(now, near, F.col("up") > 0, instances, tasks)
        table, bias = _fit(drawn, list(dict.fromkeys(marks)), 8, ridge)
        drop_written(drawn)
        drop_written(now)
        shared.destroy()
    raw = Scorer(table, bias)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "_text"):
            texts_ = b.column(1).to_pylist()
            raw.prepare(texts_)
            found = np.array([raw.evidence(t) for t in texts_], np.float64).reshape(-1, TOP + 1)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(found[:, k]) for k in range(TOP + 1))], names=["bad", *(f"e{k}" for k in range(TOP + 1))])

    got = texts.mapInArrow(tops, "bad int, " + ", ".join(f"e{k} double" for k in range(TOP + 1))).toPandas()
    got = got.sort_values(list(got.columns)).to_numpy()
    drop_written(texts)
    drop_written(counted)
    return Scorer(table, bias, _logistic(np.column_stack([np.ones(len(got)), got[:, 1:]]), got[:, 0]))


def assess(docs: DataFrame, scorer: Scorer, keep: list[Column | str], text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """``keep`` columns, score and predicted. Null and empty texts have the score of a text
    without words; repeated rows are scored alike; no other column is read."""
    kept = docs.select(*keep)
    schema = kept.schema.simpleString()[7:-1].replace(":", " ")
    model = docs.sparkSession.sparkContext.broadcast((scorer.table.astype(np.float32), scorer.bias, scorer.link))  # 8 MB

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Scorer(*model.value)
        for b in chunks(batches, "_text"):
            texts = b.column("_text").to_pylist()
            mine.prepare(texts)
            s = np.array([mine.score(t) for t in texts], np.float64)
            out = b.drop_columns(["_text"]).append_column("score", pa.array(s))
            yield out.append_column("predicted", pa.array((s >= cut).astype(np.int32)))

    return docs.select(*keep, text_bytes(text_col).alias("_text")).mapInArrow(of, f"{schema}, score double, predicted int")


def reject(docs: DataFrame, scorer: Scorer, text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """``docs`` without the rows whose text scores ``cut`` or more; all columns stay. Null and
    empty texts score as in ``assess``."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    return assess(docs, scorer, [whole], text_col, cut).where("predicted = 0").select("doc.*")

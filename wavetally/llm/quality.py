"""Quality rules: counts over whole texts, then robust multivariate outliers.

DataFrame functions only: no Python runs on the executors.

Minimum covariance determinant (MCD) estimates are made per language and source, per
language, and over all rows. Each starts from two median/MAD subsets (Euclidean and maximum
norm); after two concentration steps (mean and covariance of the share ``h`` of rows with the
smallest Mahalanobis distances) the start with the smaller determinant goes on until no
logarithm of a determinant falls by ``settled`` any more (or ``most_steps`` are made). A group's estimate is then drawn towards that of the level
above by as much as ``prior`` rows weigh: small groups follow their language, large ones
themselves, and no number of rows switches the method on or off.

A step is one aggregation: sums of the vector and its products for every group and distance
on a logarithmic grid, combined before the shuffle, so that a group with most of the rows
sends a few thousand sums a task; quantiles and moments come from those. Vectors are whole
numbers (of 1 / UNIT), so the sums are exact and do not depend on the order of rows.
"""

from __future__ import annotations

from functools import reduce
from operator import add as add_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, drop_written, written

#: Group tables up to so many rows (a few MB) are broadcast.
SMALL = 20_000

#: Statistic vector: logarithm of the mean word length, then angles asin(sqrt(share)) of
#: symbols, capitals and end marks among word characters, and of repeated words.
STATS = ("word_length", "symbols", "capitals", "marks", "repeats")
#: Standard deviations that are added (squared) to each variance: a statistic that is
#: constant in a group then rejects only what is far from it in absolute terms.
NOISE = (0.12, 0.06, 0.10, 0.07, 0.12)
P = len(STATS)
#: Statistics are whole numbers of 1 / UNIT.
UNIT = 10_000
#: Median of the chi-squared distribution with five degrees of freedom.
CHI2_MEDIAN = 4.351460191


def counts(docs: DataFrame, keep: list[str], text_col: str = "text", window: int = 5) -> DataFrame:
    """``keep`` columns and the counts of each whole text (null: none)."""
    w = window
    base = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    base = base.withColumn("_w", F.array_remove(F.split("_t", r"[\x20\x09-\x0D]+", -1), ""))
    has_word = lambda x: F.btrim(x, F.lit(SPACES)) != ""
    base = base.withColumn("_l", F.filter(F.split("_t", "\n", -1), has_word)).withColumn("n_words", F.size("_w").cast("long"))
    hashes = F.when(
        F.col("n_words") > w,
        F.transform(F.sequence(F.lit(1), (F.col("n_words") - w + 1).cast("int")), lambda i: F.xxhash64(F.slice("_w", i, w))),
    )
    base = base.select(
        *keep,
        "n_words",
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count("_t", F.lit(r"[.!?]")).cast("long").alias("n_marks"),
        hashes.alias("_h"),
    )
    # Only texts with a repeated window sort their windows.
    sorted_ = F.when(
        F.size(F.array_distinct("_h")) < F.size("_h"),
        F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    base = base.withColumn("_s", sorted_).drop("_h")
    at = lambda i: F.get(F.col("_s"), i)["h"]
    twice = F.filter("_s", lambda x, i: F.coalesce(at(i - 1) == x["h"], F.lit(False)) | F.coalesce(at(i + 1) == x["h"], F.lit(False)))
    base = base.withColumn("_p", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("_s")
    covered = F.aggregate(
        F.transform("_p", lambda x, i: F.least(F.coalesce(F.get(F.col("_p"), i + 1) - x, F.lit(w)), F.lit(w))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return base.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_p")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vector() -> list[Column]:
    def angle(k: str, n: str) -> Column:
        return F.asin(F.sqrt(F.least(F.lit(1.0), F.col(k) / F.greatest(F.lit(1.0), F.col(n)))))

    mean = F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1))
    parts = [mean, angle("n_symbols", "word_chars"), angle("n_capitals", "word_chars"), angle("n_marks", "word_chars"), angle("n_repeat_words", "n_words")]
    return [F.round(x * UNIT) for x in parts]


# ---------------------------------------------------------------- estimates
_X, _M = [f"x{i}" for i in range(P)], [f"m{i}" for i in range(P)]
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
_C, _K = [f"c{i}{j}" for i, j in _PAIRS], [f"k{i}{j}" for i, j in _PAIRS]


def _factor(params: DataFrame) -> DataFrame:
    """Adds k{i}{j}, the inverse of the Cholesky factor of c{i}{j} + noise, and the log
    determinant. One row a group; later expressions name earlier ones."""
    total = lambda terms: " + ".join(terms) or "0D"
    made = []
    for i, j in _PAIRS:
        inner = total(f"l{i}{k} * l{j}{k}" for k in range(j))
        if i == j:
            made.append(f"sqrt(greatest(c{i}{i} + {NOISE[i] ** 2}D - ({inner}), {NOISE[i] ** 2 / 4}D)) AS l{i}{i}")
        else:
            made.append(f"(c{i}{j} - ({inner})) / l{j}{j} AS l{i}{j}")
    for i, j in _PAIRS:
        inner = total(f"l{i}{m} * k{m}{j}" for m in range(j, i))
        made.append(f"({int(i == j)}D - ({inner})) / l{i}{i} AS k{i}{j}")
    made.append(f"2 * ({total(f'ln(l{i}{i})' for i in range(P))}) AS logdet")
    return params.selectExpr("*", *made).drop(*[f"l{i}{j}" for i, j in _PAIRS])


def _d2() -> Column:
    """Squared Mahalanobis distance of x0.. from m0.. under k00.. ."""
    far = [F.col(f"x{i}") / UNIT - F.col(f"m{i}") for i in range(P)]
    return reduce(add_, [F.pow(reduce(add_, [F.col(f"k{i}{j}") * far[j] for j in range(i + 1)]), F.lit(2.0)) for i in range(P)])


def _grid(d2: Column) -> Column:
    """Distances on a logarithmic grid: at most a few thousand values."""
    return F.round(F.log1p(d2), 3)


def _near(table: DataFrame, groups: int) -> DataFrame:
    """Broadcast where it has at most SMALL rows; a shuffled join, split by AQE, beyond that."""
    return F.broadcast(table) if groups <= SMALL else table


def _moments(rows: DataFrame, share: float) -> DataFrame:
    """rows: g, start, q, x0.. . Mean m0.. and covariance c00.., per g and start, of the rows
    with the smallest ``share`` of q."""
    sums = [F.sum(x).alias(x) for x in _X] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in _PAIRS]
    cells = rows.groupBy("g", "start", "q").agg(F.count("*").alias("n"), *sums)
    by = Window.partitionBy("g", "start")
    cells = cells.withColumn("before", F.sum("n").over(by.orderBy("q").rowsBetween(Window.unboundedPreceding, -1))).withColumn("all", F.sum("n").over(by))
    inside = cells.where(F.coalesce("before", F.lit(0)) < F.col("all") * share)
    got = inside.groupBy("g", "start").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in [*_X, *(f"s{i}{j}" for i, j in _PAIRS)]])
    mean = [(F.col(f"x{i}") / F.col("n") / UNIT).alias(f"m{i}") for i in range(P)]
    cov = [(F.col(f"s{i}{j}") / F.col("n") / UNIT**2 - F.col(f"x{i}") / F.col("n") / UNIT * (F.col(f"x{j}") / F.col("n") / UNIT)).alias(f"c{i}{j}") for i, j in _PAIRS]
    return got.select("g", "start", *mean, *cov)


def estimates(rows: DataFrame, h: float = 0.75, most_steps: int = 12, settled: float = 2e-3) -> tuple[DataFrame, int]:
    """rows: g, x0.. . One row per g: n, m0.., c00.. of the MCD subset; and their number."""
    med = written(rows.groupBy("g").agg(F.count("*").alias("n"), *[F.percentile(x, 0.5).alias(m) for x, m in zip(_X, _M, strict=True)]), "medians")
    groups = med.count()
    mad = rows.join(_near(med, groups), "g").groupBy("g").agg(*[F.percentile(F.abs(F.col(x) - F.col(m)), 0.5).alias(f"a{i}") for i, (x, m) in enumerate(zip(_X, _M, strict=True))])
    first = written(med.join(mad, "g"), "medians")
    z = [F.abs(F.col(f"x{i}") - F.col(f"m{i}")) / (1.4826 * F.col(f"a{i}") + NOISE[i] * UNIT) for i in range(P)]
    starts = F.array(F.struct(F.lit(0).alias("start"), _grid(reduce(add_, [a * a for a in z])).alias("q")), F.struct(F.lit(1).alias("start"), _grid(F.pow(F.greatest(*z), F.lit(2.0))).alias("q")))
    tried = rows.join(_near(first, groups), "g").select("g", *_X, F.inline(starts))
    now, before = written(_factor(_moments(tried, 0.5)), "mcd"), None
    for step in range(most_steps):
        q = _grid(_d2()).alias("q")
        then = written(_factor(_moments(rows.join(_near(now, 2 * groups), "g").select("g", "start", q, *_X), h)), "mcd")
        if step == 1:  # the better start goes on
            then = written(then.groupBy("g").agg(F.min_by(F.struct("start", *_M, *_C, *_K, "logdet"), F.struct("logdet", "start")).alias("e")).select("g", "e.*"), "mcd")
        same = before is not None and step > 1 and not then.join(now.select("g", F.col("logdet").alias("was")), "g").where(F.col("was") - F.col("logdet") > settled).limit(1).count()
        drop_written(now)
        now, before = then, step
        if same:
            break
    return written(now.join(med.select("g", "n"), "g").select("g", "n", *_M, *_C), "estimates"), groups


def _drawn_to(own: DataFrame, above: DataFrame, prior: float) -> DataFrame:
    """own: g, up, n, m0.., c00.., mid; above: the same of the level above, with up as g. The
    estimates of ``own`` with ``prior`` rows of the level above added, of the same columns."""
    names = [*_M, *_C]
    joined = own.join(above.select(F.col("g").alias("up"), *[F.col(c).alias(f"p_{c}") for c in names]), "up")
    return joined.select("g", "up", "n", *[((F.col("n") * F.col(c) + prior * F.col(f"p_{c}")) / (F.col("n") + prior)).alias(c) for c in names])


def _groups() -> list[Column]:
    """Keys of the three levels, finest first; nulls are a value of their own."""
    return [
        F.concat(F.lit("2"), F.to_json(F.struct("_lang", "_source"))),
        F.concat(F.lit("1"), F.to_json(F.struct("_lang"))),
        F.lit("0"),
    ]


def assess(
    docs: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    cutoff: float = 25.745,
    prior: float = 200.0,
    h: float = 0.75,
) -> DataFrame:
    """One row per document: ``keep``, the counts, base_failed, distance, kept.

    ``cutoff`` bounds the squared distance (chi-squared with five degrees of freedom
    exceeds 25.745 once in 10,000). Rows that fail the base rules are rejected, take no part
    in the estimates and have no distance. Null text counts as empty and fails; null
    languages and sources are groups of their own. Groups of any size have an estimate, drawn
    to that of their language and of all rows by ``prior`` rows. Repeated rows are judged
    alike. Ids may be null or repeated, other columns are ignored; an empty table gives none.
    """
    named = docs.select(*keep, F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), F.col(text_col).alias("_text"))
    found = counts(named, [*keep, "_lang", "_source"], "_text").withColumn("base_failed", base_failed())
    found = written(found.withColumns({**dict(zip(_X, vector(), strict=True)), **{f"g{i}": g for i, g in enumerate(_groups())}}).drop("_lang", "_source"), "counts")
    good = found.where("not base_failed")
    raw, groups = estimates(good.select(F.explode(F.array("g0", "g1", "g2")).alias("g"), *_X), h)
    ups = good.select("g0", "g1").distinct()
    up = ups.select(F.col("g0").alias("g"), F.col("g1").alias("up")).unionByName(ups.select(F.col("g1").alias("g"), F.lit("0").alias("up")).distinct())
    own = raw.join(up, "g", "left")
    all_ = own.where("g = '0'")
    langs = _drawn_to(own.where("up = '0'"), all_, prior)
    finest = _drawn_to(own.where("up != '0'"), langs, prior)
    shrunk = written(_factor(finest).select("g", "up", "n", *_M, *_K), "shrunk")
    # The usual consistency factor from the median distance, drawn to that of all rows alike.
    placed = found.join(_near(shrunk.withColumnRenamed("g", "g0"), groups), "g0", "left")
    placed = placed.select(*keep, "g0", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n", F.when(~F.col("base_failed"), _d2()).alias("d2"))
    placed = written(placed, "distances")
    mids = placed.where("d2 is not null").groupBy("g0").agg(F.percentile(F.log1p("d2").cast("decimal(12,3)").cast("double"), 0.5).alias("mid"), F.count("*").alias("m"))
    common = mids.agg((F.sum(F.col("mid") * F.col("m")) / F.sum("m")).alias("common"))
    mid = (F.col("mid") * F.col("m") + prior * F.col("common")) / (F.col("m") + prior)
    scales = mids.crossJoin(F.broadcast(common)).select("g0", F.greatest(F.lit(1.0), F.expm1(mid) / CHI2_MEDIAN).alias("scale"))
    out = placed.join(_near(scales, groups), "g0", "left").withColumn("distance", F.col("d2") / F.col("scale"))
    verdict = ~F.col("base_failed") & (F.col("distance") <= cutoff)
    return out.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", verdict.alias("kept")
    )

"""Queries of the engine over the driver's tables, each with its DuckDB equivalent.

``events`` stands for detections (``purchase`` candidate, ``view`` control, value / 1000 as
score), ``signup`` and ``error`` rows for injections of the two codes. They exercise the
operators; the scores are no correlations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavetally.functions import codes, stats, waveforms
from wavetally.operators import intervals, orderstats, rates, robust, sequences, suppression, thresholds
from wavetally.plans import bootstrap
from wavetally.sources import manifests, recordings, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LEVELS = (0.5, 0.8, 0.9)
DAY = 86_400_000_000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- bindings
def micros(c: str):
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ev(spark: SparkSession, d: str) -> DataFrame:
    us = micros("ts")
    return table(spark, d, "events").select(
        "event_id", F.col("user_id").cast("string").alias("subject_id"), F.col("event_type").alias("code_id"), (F.col("value") / 1000.0).alias("score"), "value",
        us.alias("us"), F.concat_ws("-", F.col("user_id").cast("string"), F.floor(us / DAY).cast("string")).alias("record_id"),
    )


def inj(spark: SparkSession, d: str) -> DataFrame:
    rows = ev(spark, d).where(F.col("code_id").isin("signup", "error"))
    rows = rows.withColumn("anchor_index", F.row_number().over(Window.partitionBy("subject_id", "code_id").orderBy("us", "event_id")))
    both = F.count("*").over(Window.partitionBy("subject_id", "anchor_index"))
    return rows.withColumn("_n", both).where("_n = 2").select("subject_id", "code_id", "anchor_index", "score", "us", "event_id")


def expo(spark: SparkSession, d: str) -> DataFrame:
    return ev(spark, d).groupBy("subject_id", "record_id").agg(((F.max("us") - F.min("us")) / 3.6e9).alias("hours"))


EV = """ev AS (SELECT event_id, CAST(user_id AS VARCHAR) AS subject_id, event_type AS code_id, value / 1000.0 AS score, value,
 epoch_us(ts) AS us, CAST(user_id AS VARCHAR) || '-' || CAST(epoch_us(ts) // 86400000000 AS VARCHAR) AS record_id FROM events)"""
INJ = EV + """, inj AS (SELECT subject_id, code_id, anchor_index, score, us, event_id FROM (SELECT *, count(*) OVER (PARTITION BY subject_id, anchor_index) AS n_codes
 FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, code_id ORDER BY us, event_id) AS anchor_index FROM ev WHERE code_id IN ('signup', 'error'))) WHERE n_codes = 2)"""
EXPO = """expo AS (SELECT subject_id, record_id, (max(us) - min(us)) / 3.6e9 AS hours FROM ev GROUP BY ALL)"""
RANKED = """ranked AS (SELECT code_id, score, sum(n) OVER (PARTITION BY code_id ORDER BY score DESC) AS recovered, sum(n) OVER (PARTITION BY code_id) AS trials
 FROM (SELECT code_id, score, count(*) AS n FROM inj GROUP BY ALL))"""
MATCHED = RANKED + """, levels AS (SELECT unnest([0.5, 0.8, 0.9]::DOUBLE[]) AS level),
 thr AS (SELECT code_id, level, max(score) AS threshold, min(recovered) AS recoveries, any_value(trials) AS trials FROM ranked, levels
 WHERE recovered >= greatest(1, ceil(level * trials - 1e-12)) GROUP BY code_id, level)"""


def _matched(spark, d):
    return thresholds.at_least(inj(spark, d), ["code_id"], list(LEVELS), cell=0.01)


# ---------------------------------------------------------------- thresholds and points
@query("matched_threshold", f"WITH {INJ}, {MATCHED} SELECT code_id, level, threshold, recoveries::BIGINT AS recoveries, trials::BIGINT AS trials, (min(recoveries) OVER (PARTITION BY level))::BIGINT AS matched_recoveries FROM thr")
def matched_threshold(spark, d):
    return _matched(spark, d).withColumn("matched_recoveries", F.min("recoveries").over(Window.partitionBy("level")))


@query("exact_threshold", f"""WITH {INJ}, {RANKED}, k AS (SELECT *, floor(0.8 * trials + 0.5) AS k FROM ranked)
 SELECT code_id, max(score) AS threshold, min(recovered)::BIGINT AS recoveries, any_value(k)::BIGINT AS wanted, min(recovered) <> any_value(k) AS tied FROM k WHERE recovered >= k AND k > 0 GROUP BY code_id""")
def exact_threshold(spark, d):
    return thresholds.exact_count(inj(spark, d), ["code_id"], 0.8, cell=0.01)


GRID = [i / 200 for i in range(1, 61)]


@query("grid_threshold", f"""WITH {INJ}, g AS (SELECT unnest({GRID}::DOUBLE[]) AS t), c AS (SELECT code_id, t, count(*) AS trials, count(*) FILTER (score >= t) AS n FROM inj, g GROUP BY ALL)
 SELECT code_id, any_value(trials) AS trials, max(t) FILTER (n / trials >= 0.7) AS threshold, coalesce(min(n) FILTER (n / trials >= 0.7), 0) AS successes, count(*) FILTER (n / trials >= 0.7) > 0 AS calibrated FROM c GROUP BY code_id""")
def grid_threshold(spark, d):
    return thresholds.grid_threshold(inj(spark, d), ["code_id"], GRID, 0.7)


@query("decimal_grid", """WITH r AS (SELECT p_brand, min(p_size) * 0.01::DOUBLE AS start, max(p_size) * 0.01::DOUBLE AS stop, max(p_size) - min(p_size) AS n FROM part GROUP BY p_brand)
 SELECT p_brand, i::BIGINT AS i, CASE WHEN i = n THEN stop ELSE start + i * 0.01::DOUBLE END AS threshold FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM r)""")
def decimal_grid(spark, d):
    """A grid over the range of each brand's sizes."""
    r = table(spark, d, "part").groupBy("p_brand").agg((F.min("p_size") * 0.01).alias("start"), (F.max("p_size") * 0.01).alias("stop"))
    return thresholds.decimal_grids(r.withColumn("step", F.lit(0.01)), "start", "stop", "step").select("p_brand", "i", "threshold")


SCORES_GRID = thresholds.drifting_grid(0.0, 0.5, 0.005)


@query("score_grid_froc", f"""WITH {INJ}, {EXPO}, h AS (SELECT sum(hours) AS hours FROM expo), g AS (SELECT generate_subscripts(x, 1) - 1 AS i, unnest(x) AS threshold FROM (SELECT {SCORES_GRID}::DOUBLE[] AS x)),
 e AS (SELECT code_id, i, threshold, count(*) FILTER (score >= threshold) AS events FROM ev, g WHERE code_id IN ('purchase', 'view') GROUP BY ALL)
 SELECT code_id, i::INTEGER AS i, threshold, events, round(events / hours, 9) AS rate FROM e, h""")
def score_grid_froc(spark, d):
    rows = ev(spark, d).where(F.col("code_id").isin("purchase", "view"))
    hours = expo(spark, d).agg(F.sum("hours").alias("hours"))
    out = thresholds.counts_at_or_above(rows, ["code_id"], SCORES_GRID).crossJoin(F.broadcast(hours))  # one row
    return out.select("code_id", "i", "threshold", F.col("n").alias("events"), F.round(F.col("n") / F.col("hours"), 9).alias("rate"))


def _role_thresholds(spark, d):
    """The injection codes' thresholds, applied to the detection codes."""
    t = _matched(spark, d)
    role = F.when(F.col("code_id") == "signup", "candidate").otherwise("control")
    return t.select("level", role.alias("role"), F.when(role == "candidate", "purchase").otherwise("view").alias("code_id"), "threshold", "recoveries", "trials")


POINTS = MATCHED + """, roles AS (SELECT level, CASE WHEN code_id = 'signup' THEN 'candidate' ELSE 'control' END AS role, CASE WHEN code_id = 'signup' THEN 'purchase' ELSE 'view' END AS code_id, threshold, recoveries, trials FROM thr),
 h AS (SELECT sum(hours) AS hours FROM expo),
 points AS (SELECT r.level, r.role, r.code_id, r.threshold, count(*) FILTER (e.score >= r.threshold) AS events, r.recoveries::BIGINT AS recoveries, r.trials::BIGINT AS trials FROM roles r JOIN ev e USING (code_id) GROUP BY ALL)"""


def _points(spark, d):
    t = _role_thresholds(spark, d)
    hits = t.join(ev(spark, d).select("code_id", "score"), "code_id").groupBy(*t.columns).agg(F.count_if(F.col("score") >= F.col("threshold")).alias("events"))
    return hits.crossJoin(F.broadcast(expo(spark, d).agg(F.sum("hours").alias("hours")))).withColumn("rate", F.try_divide("events", "hours"))  # one row


@query("froc_points", f"WITH {INJ}, {EXPO}, {POINTS} SELECT level, role, code_id, threshold, events, recoveries, trials, round(hours, 6) AS hours, round(events / hours, 9) AS rate FROM points, h")
def froc_points(spark, d):
    return _points(spark, d).select("level", "role", "code_id", "threshold", "events", "recoveries", "trials", F.round("hours", 6).alias("hours"), F.round("rate", 9).alias("rate"))


TAIL_SQL = """CASE WHEN n IS NOT NULL THEN list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(mid) + (n - i) * ln(1 - mid)))) ELSE 1 - list_sum(list_transform(range(0, k), lambda i: exp(i * ln(mid) - mid - lgamma(i + 1)))) END"""
INTERVALS = POINTS + f""", pts AS (SELECT level, role, code_id, threshold, events, recoveries, trials, hours FROM points, h),
 q AS (SELECT level, role, 'rl' AS what, trials AS n, recoveries AS k, 0.025 AS target, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM pts WHERE recoveries > 0 UNION ALL SELECT level, role, 'ru', trials, recoveries + 1, 0.975, 0.0, 1.0 FROM pts WHERE recoveries < trials
  UNION ALL SELECT level, role, 'pl', NULL, events, 0.025, 0.0, 2.0 * events + 50 FROM pts WHERE events > 0 UNION ALL SELECT level, role, 'pu', NULL, events + 1, 0.975, 0.0, 2.0 * events + 50 FROM pts UNION ALL SELECT level, role, 'po', NULL, events + 1, 0.95, 0.0, 2.0 * events + 50 FROM pts),
 it AS (SELECT *, 0 AS turn FROM q UNION ALL SELECT level, role, what, n, k, target, CASE WHEN s < target THEN mid ELSE lo END, CASE WHEN s < target THEN hi ELSE mid END, turn + 1 FROM (SELECT *, {TAIL_SQL} AS s FROM (SELECT *, (lo + hi) / 2 AS mid FROM it WHERE turn < 60))),
 b AS (SELECT level, role, max((lo + hi) / 2) FILTER (what = 'rl') AS rl, max((lo + hi) / 2) FILTER (what = 'ru') AS ru, max((lo + hi) / 2) FILTER (what = 'pl') AS pl, max((lo + hi) / 2) FILTER (what = 'pu') AS pu, max((lo + hi) / 2) FILTER (what = 'po') AS po FROM it WHERE turn = 60 GROUP BY ALL)
 SELECT level, role, code_id, threshold, events, recoveries, trials, round(hours, 6) AS hours, round(coalesce(rl, 0), 9) AS recovery_lower, round(coalesce(ru, 1), 9) AS recovery_upper, round(coalesce(pl, 0) / hours, 9) AS rate_lower, round(pu / hours, 9) AS rate_upper, round(po / hours, 9) AS rate_one_sided_upper FROM pts JOIN b USING (level, role)"""


@query("froc_intervals", f"WITH RECURSIVE {INJ}, {EXPO}, {INTERVALS}")
def froc_intervals(spark, d):
    out = rates.with_intervals(_points(spark, d))
    bounds = ("recovery_lower", "recovery_upper", "rate_lower", "rate_upper", "rate_one_sided_upper")
    return out.select("level", "role", "code_id", "threshold", "events", "recoveries", "trials", F.round("hours", 6).alias("hours"), *[F.round(c, 9).alias(c) for c in bounds])


@query("poisson_window_probability", f"WITH {EV}, {EXPO}, h AS (SELECT sum(hours) AS hours FROM expo) SELECT code_id, round(1 - exp(-(count(*) / any_value(hours)) * 20 / 3600), 9) AS p FROM ev, h GROUP BY code_id")
def poisson_window_probability(spark, d):
    hours = F.broadcast(expo(spark, d).agg(F.sum("hours").alias("hours")))  # one row
    n = ev(spark, d).groupBy("code_id").agg(F.count("*").alias("n")).crossJoin(hours)
    return n.select("code_id", F.round(stats.window_probability(F.col("n") / F.col("hours"), 20), 9).alias("p"))


@query("recovery_surface", """WITH t AS (SELECT l_returnflag, max(l_quantity) * 0.5 AS threshold FROM lineitem GROUP BY ALL)
 SELECT l.l_returnflag AS code_id, round(l_discount * 100)::BIGINT AS amplitude_mad, l_linestatus AS interval_jitter_fraction, threshold, count(*) FILTER (l_quantity >= threshold) AS recovered, count(*) AS trials, round(count(*) FILTER (l_quantity >= threshold) / count(*), 9) AS fraction
 FROM lineitem l JOIN t USING (l_returnflag) GROUP BY ALL""")
def recovery_surface(spark, d):
    """Each code's own threshold is half of its greatest score."""
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("code_id"), F.round(F.col("l_discount") * 100).cast("long").alias("amplitude_mad"), F.col("l_linestatus").alias("interval_jitter_fraction"), F.col("l_quantity").alias("score"))
    t = rows.groupBy("code_id").agg((F.max("score") * 0.5).alias("threshold"))
    return rates.recovery_surface(rows, t, "score").withColumn("fraction", F.round("fraction", 9)).drop("lower", "upper")


PAIRS = """per AS (SELECT subject_id, sum(hours) AS hours FROM expo GROUP BY ALL), pairs AS (SELECT p.subject_id, p.hours, count(*) FILTER (e.code_id = 'purchase' AND e.score >= 0.05) AS candidate_events,
 count(*) FILTER (e.code_id = 'view' AND e.score >= 0.05) AS control_events FROM per p LEFT JOIN ev e USING (subject_id) GROUP BY ALL)"""


def _pairs(spark, d):
    e, x = ev(spark, d), expo(spark, d)
    return rates.paired(rates.subject_counts(e, x, "purchase", 0.05), rates.subject_counts(e, x, "view", 0.05))


@query("participant_counts", f"WITH {EV}, {EXPO}, {PAIRS} SELECT subject_id, round(hours, 6) AS hours, candidate_events AS events FROM pairs")
def participant_counts(spark, d):
    return rates.subject_counts(ev(spark, d), expo(spark, d), "purchase", 0.05).select("subject_id", F.round("hours", 6).alias("hours"), "events")


@query("participant_rate_difference", f"WITH {EV}, {EXPO}, {PAIRS} SELECT subject_id, round((candidate_events - control_events) / hours, 9) AS difference FROM pairs WHERE hours > 0")
def participant_rate_difference(spark, d):
    n = ev(spark, d).where("score >= 0.05").groupBy("subject_id").pivot("code_id", ["purchase", "view"]).agg(F.count("event_id"))
    per = expo(spark, d).groupBy("subject_id").agg(F.sum("hours").alias("hours")).join(n, "subject_id", "left").na.fill(0, ["purchase", "view"]).where("hours > 0")
    return per.select("subject_id", F.round((F.col("purchase") - F.col("view")) / F.col("hours"), 9).alias("difference"))


@query("paired_contrast", f"""WITH {EV}, {EXPO}, {PAIRS} SELECT sum(candidate_events)::BIGINT AS candidate_events, sum(control_events)::BIGINT AS control_events, count(*) AS subjects, round(sum(hours), 6) AS hours,
 round((sum(candidate_events) - sum(control_events)) / sum(hours), 9) AS difference, round(sum(candidate_events) / sum(control_events), 9) AS ratio FROM pairs""")
def paired_contrast(spark, d):
    c = rates.contrast(_pairs(spark, d))
    return c.select("candidate_events", "control_events", "subjects", F.round("hours", 6).alias("hours"), F.round("difference", 9).alias("difference"), F.round("ratio", 9).alias("ratio"))


@query("rate_ratio_gate", f"""WITH {EV}, r AS (SELECT subject_id, count(*) FILTER (code_id = 'purchase') AS a, count(*) FILTER (code_id = 'view') AS b FROM ev GROUP BY ALL)
 SELECT subject_id, a - b AS upper, round(CASE WHEN b > 0 THEN a / b END, 9) AS ratio, a - b < 0 AS upper_below_zero, coalesce(b > 0 AND a / b <= 0.7, false) AS ratio_small, a - b < 0 AND coalesce(b > 0 AND a / b <= 0.7, false) AS passes FROM r""")
def rate_ratio_gate(spark, d):
    n = ev(spark, d).groupBy("subject_id").agg(F.count_if(F.col("code_id") == "purchase").alias("a"), F.count_if(F.col("code_id") == "view").alias("b"))
    rows = n.select("subject_id", (F.col("a") - F.col("b")).alias("upper"), F.try_divide("a", "b").alias("ratio"))
    return rates.gates(rows, "upper", "ratio").withColumn("ratio", F.round("ratio", 9))


@query("storage_floor", f"""WITH {EV}, s AS (SELECT code_id, record_id, min(score) AS threshold FROM ev WHERE score >= 0.001 GROUP BY ALL), f AS (SELECT code_id, min(threshold) AS floor, max(threshold) AS ceiling FROM s GROUP BY ALL)
 SELECT f.code_id, floor, floor = ceiling AS single, count(*) FILTER (e.score < floor) AS below FROM f JOIN ev e USING (code_id) GROUP BY ALL""")
def storage_floor(spark, d):
    e = ev(spark, d)
    return thresholds.storage_floor(e.where("score >= 0.001").groupBy("code_id", "record_id").agg(F.min("score").alias("threshold")), e, ["code_id"])


@query("coverage_guard", f"WITH {INJ}, {MATCHED} SELECT code_id, level, threshold >= 0.02 - 1e-12 AS covered FROM thr")
def coverage_guard(spark, d):
    return _matched(spark, d).select("code_id", "level", thresholds.covered(F.col("threshold"), F.lit(0.02)).alias("covered"))


@query("paired_anchor_check", f"""WITH {EV}, a AS (SELECT subject_id, us // 3600000000 AS anchor, count(*) FILTER (code_id = 'signup') AS a, count(*) FILTER (code_id = 'error') AS b FROM ev WHERE code_id IN ('signup', 'error') GROUP BY ALL)
 SELECT count(*) FILTER (greatest(a, b) > 1) AS repeated, count(*) FILTER (a = 0 OR b = 0) AS unpaired, count(*) FILTER (a > 0 AND b > 0) AS paired FROM a""")
def paired_anchor_check(spark, d):
    rows = ev(spark, d).withColumn("anchor", F.floor(F.col("us") / 3_600_000_000))
    return thresholds.paired_condition(rows, "signup", "error", ["subject_id", "anchor"])


@query("threshold_transport", f"""WITH {INJ}, {MATCHED} SELECT t.level, t.code_id, t.threshold, count(*) FILTER (e.score >= t.threshold) AS recovered, count(*) AS trials FROM thr t JOIN (SELECT * FROM ev WHERE day(make_timestamp(us)) > 15) e USING (code_id) GROUP BY ALL""")
def threshold_transport(spark, d):
    late = ev(spark, d).where(F.dayofmonth(F.expr("timestampadd(MICROSECOND, us, timestamp_ntz'1970-01-01 00:00:00')")) > 15).select("code_id", "score")
    t = _matched(spark, d).select("level", "code_id", "threshold")
    return t.join(late, "code_id").groupBy("level", "code_id", "threshold").agg(F.count_if(F.col("score") >= F.col("threshold")).alias("recovered"), F.count("*").alias("trials"))


# ---------------------------------------------------------------- robust statistics
@query("robust_mad", f"WITH {EV} SELECT code_id, round(1.4826 * mad(score), 9) AS mad FROM ev GROUP BY code_id")
def robust_mad(spark, d):
    return robust.mad(ev(spark, d), ["code_id"], "score").select("code_id", F.round("mad", 9).alias("mad"))


@query("quantile_interval", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.025) AS low, quantile_cont(l_extendedprice, 0.5) AS mid, quantile_cont(l_extendedprice, 0.975) AS high FROM lineitem GROUP BY 1")
def quantile_interval(spark, d):
    return orderstats.quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"low": 0.025, "mid": 0.5, "high": 0.975}).drop("n")


@query("trailing_scale", f"""WITH {EV}, b AS (SELECT DISTINCT subject_id, us // {DAY} AS bin FROM ev), s AS (SELECT b.subject_id, b.bin, e.value FROM b JOIN ev e ON e.subject_id = b.subject_id AND e.us // {DAY} >= b.bin - 5 AND e.us // {DAY} < b.bin),
 m AS (SELECT subject_id, bin, count(*) AS n, median(value) AS m FROM s GROUP BY ALL HAVING count(*) >= 5)
 SELECT subject_id, bin, any_value(m.n) AS n, round(1.4826 * median(abs(value - m)), 9) AS mad FROM s JOIN m USING (subject_id, bin) GROUP BY ALL""")
def trailing_scale(spark, d):
    out = robust.trailing_mad(ev(spark, d), ["subject_id"], "us", "value", DAY, 5 * DAY, 5)
    return out.select("subject_id", "bin", "n", F.round("mad", 9).alias("mad"))


# ---------------------------------------------------------------- sequences
@query("rolling_moments", f"""WITH {EV}, r AS (SELECT subject_id, event_id, count(*) OVER w AS n, sum(CAST(value AS DECIMAL(18, 2))) OVER w AS s, sum(CAST(value AS DECIMAL(18, 2)) * CAST(value AS DECIMAL(18, 2))) OVER w AS q FROM ev WINDOW w AS (PARTITION BY subject_id ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
 SELECT subject_id, event_id, round(s::DOUBLE, 6) AS total, round(q::DOUBLE - s::DOUBLE * s::DOUBLE / 5, 6) AS energy FROM r WHERE n = 5""")
def rolling_moments(spark, d):
    v = F.col("value").cast("decimal(18,2)")
    rows = sequences.rolling(ev(spark, d), ["subject_id"], ["us", "event_id"], {"s": v, "q": v * v}, 5, F.floor(F.col("us") / DAY))
    s, q = F.col("s").cast("double"), F.col("q").cast("double")
    return rows.select("subject_id", "event_id", F.round(s, 6).alias("total"), F.round(q - s * s / 5, 6).alias("energy"))


@query("strided_scan", f"WITH {EV} SELECT subject_id, event_id, k FROM (SELECT subject_id, event_id, row_number() OVER (PARTITION BY subject_id ORDER BY us, event_id) - 1 AS k FROM ev) WHERE k % 5 = 0")
def strided_scan(spark, d):
    k = F.row_number().over(Window.partitionBy("subject_id").orderBy("us", "event_id")) - 1
    return sequences.strided(ev(spark, d).select("subject_id", "event_id", k.cast("long").alias("k")), "k", 5)


HOUR = 3_600_000_000
ISLANDS = f"""iv AS (SELECT subject_id, us AS start, us + {2 * HOUR} AS stop FROM ev), mk AS (SELECT *, max(stop) OVER (PARTITION BY subject_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM iv),
 ids AS (SELECT *, sum(CASE WHEN prev IS NULL OR start > prev THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS i FROM mk),
 islands AS (SELECT subject_id, min(start) AS start, max(stop) AS stop, count(*) AS n FROM ids GROUP BY subject_id, i)"""


def _windows(spark, d, hours: int = 2):
    return ev(spark, d).select("subject_id", F.col("us").alias("start"), (F.col("us") + hours * HOUR).alias("stop"))


@query("island_merge", f"WITH {EV}, {ISLANDS} SELECT * FROM islands")
def island_merge(spark, d):
    return intervals.merge(_windows(spark, d), ["subject_id"])


@query("run_erosion", f"WITH {EV}, {ISLANDS} SELECT subject_id, start + {HOUR} AS start, stop - {HOUR} AS stop FROM islands WHERE start + {HOUR} < stop - {HOUR}")
def run_erosion(spark, d):
    return intervals.erode(intervals.merge(_windows(spark, d), ["subject_id"]), HOUR).select("subject_id", "start", "stop")


@query("interval_mask", "SELECT o_custkey AS record_id, greatest(0, ceil((epoch_us(o_orderdate) / 1e6) * 0.01 - 1e-10)::BIGINT) AS start, ceil((epoch_us(o_orderdate) / 1e6 + 1000) * 0.01 - 1e-10)::BIGINT AS stop FROM orders")
def interval_mask(spark, d):
    s = micros("o_orderdate") / 1e6
    return table(spark, d, "orders").select(F.col("o_custkey").alias("record_id"), F.greatest(F.lit(0), intervals.left_sample(s, 0.01)).alias("start"), intervals.left_sample(s + 1000, 0.01).alias("stop"))


@query("exposure_report", f"""WITH {EV}, {ISLANDS}, er AS (SELECT subject_id, start + {HOUR // 2} AS start, stop - {HOUR // 2} AS stop FROM islands WHERE start + {HOUR // 2} < stop - {HOUR // 2}),
 bad AS (SELECT subject_id, us AS start, us + {HOUR // 4} AS stop FROM ev WHERE code_id = 'error'),
 bm AS (SELECT *, max(stop) OVER (PARTITION BY subject_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM bad),
 bi AS (SELECT *, sum(CASE WHEN prev IS NULL OR start > prev THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS i FROM bm),
 bu AS (SELECT subject_id, min(start) AS start, max(stop) AS stop FROM bi GROUP BY subject_id, i),
 a AS (SELECT subject_id, sum(stop - start)::BIGINT AS stage_samples FROM islands GROUP BY 1), b AS (SELECT subject_id, sum(stop - start)::BIGINT AS eroded_samples FROM er GROUP BY 1),
 c AS (SELECT er.subject_id, sum(least(er.stop, bu.stop) - greatest(er.start, bu.start))::BIGINT AS invalid_samples FROM er JOIN bu ON er.subject_id = bu.subject_id AND er.start < bu.stop AND bu.start < er.stop GROUP BY 1)
 SELECT subject_id, stage_samples, coalesce(eroded_samples, 0) AS eroded_samples, coalesce(invalid_samples, 0) AS invalid_samples, coalesce(eroded_samples, 0) - coalesce(invalid_samples, 0) AS eligible_samples,
 round((coalesce(eroded_samples, 0) - coalesce(invalid_samples, 0)) / 1000000.0 / 3600, 9) AS eligible_hours FROM a LEFT JOIN b USING (subject_id) LEFT JOIN c USING (subject_id)""")
def exposure_report(spark, d):
    stage = intervals.merge(_windows(spark, d), ["subject_id"])
    bad = ev(spark, d).where("code_id = 'error'").select("subject_id", F.col("us").alias("start"), (F.col("us") + HOUR // 4).alias("stop"))
    out = intervals.exposure(stage, intervals.erode(stage, HOUR // 2), bad, 1e6, ["subject_id"], 6 * HOUR)
    return out.withColumn("eligible_hours", F.round("eligible_hours", 9))


LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("flatline_runs", f"""WITH s AS (SELECT l_returnflag, l_discount AS v, row_number() OVER w AS k, coalesce(abs(l_discount - lag(l_discount) OVER w) <= 0.01 + 1e-12, false) AS flat FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY {', '.join(LINE)})),
 r AS (SELECT *, sum(CASE WHEN flat THEN 0 ELSE 1 END) OVER (PARTITION BY l_returnflag ORDER BY k) AS run FROM s)
 SELECT l_returnflag, min(k) AS first, max(k) AS last, count(*) AS n FROM r GROUP BY l_returnflag, run HAVING count(*) >= 4""")
def flatline_runs(spark, d):
    rows = sequences.flat_runs(table(spark, d, "lineitem"), ["l_returnflag"], LINE, "l_discount", 0.01 + 1e-12, 4, F.floor(F.col("l_orderkey") / 4096))
    return rows.select("l_returnflag", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "n")


@query("gap_interpolation", f"""WITH {EV}, v AS (SELECT subject_id, event_id, us, CASE WHEN code_id <> 'error' THEN value END AS v FROM ev),
 n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN us END IGNORE NULLS) OVER b AS t0, last_value(v IGNORE NULLS) OVER b AS v0, first_value(CASE WHEN v IS NOT NULL THEN us END IGNORE NULLS) OVER a AS t1, first_value(v IGNORE NULLS) OVER a AS v1 FROM v
 WINDOW b AS (PARTITION BY subject_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY subject_id ORDER BY us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT subject_id, event_id, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (us - t0) / (t1 - t0) END, 6) AS filled FROM n""")
def gap_interpolation(spark, d):
    rows = ev(spark, d).select("subject_id", "event_id", "us", F.when(F.col("code_id") != "error", F.col("value")).alias("v"))
    return sequences.interpolate(rows, ["subject_id"], "us", "v", F.floor(F.col("us") / DAY)).select("subject_id", "event_id", F.round("filled", 6).alias("filled"))


@query("local_maxima", f"""WITH {EV}, s AS (SELECT *, CASE WHEN code_id <> 'error' THEN score END AS q FROM ev), n AS (SELECT *, lag(q) OVER w AS l, lead(q) OVER w AS r FROM s WINDOW w AS (PARTITION BY subject_id ORDER BY us, event_id))
 SELECT subject_id, event_id, score FROM n WHERE q IS NOT NULL AND NOT coalesce(l > q, false) AND NOT coalesce(r >= q, false)""")
def local_maxima(spark, d):
    return sequences.local_maxima(ev(spark, d), ["subject_id"], ["us", "event_id"], "score", F.col("code_id") != "error").select("subject_id", "event_id", "score")


NMS = f"""WITH RECURSIVE {EV}, o AS (SELECT subject_id, event_id, us, score, row_number() OVER (PARTITION BY subject_id ORDER BY score DESC, event_id) AS k FROM ev),
 f AS (SELECT subject_id, k, [us] AS kept, [event_id] AS ids FROM o WHERE k = 1 UNION ALL
 SELECT o.subject_id, o.k, CASE WHEN len(list_filter(f.kept, lambda x: abs(x - o.us) <= {12 * HOUR})) = 0 THEN list_append(f.kept, o.us) ELSE f.kept END,
 CASE WHEN len(list_filter(f.kept, lambda x: abs(x - o.us) <= {12 * HOUR})) = 0 THEN list_append(f.ids, o.event_id) ELSE f.ids END FROM f JOIN o ON o.subject_id = f.subject_id AND o.k = f.k + 1),
 t AS (SELECT subject_id, ids FROM f QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY k DESC) = 1) SELECT subject_id, unnest(ids) AS event_id FROM t"""


def _suppressed(spark, d, cells):
    rows = ev(spark, d).select("subject_id", "event_id", "us", "score")
    return suppression.suppress(rows, ["subject_id"], 12 * HOUR, "us", [-F.col("score"), F.col("event_id")], cells).select("subject_id", "event_id")


@query("nms", NMS)
def nms(spark, d):
    return _suppressed(spark, d, 64)


@query("nms_grouped", NMS)
def nms_grouped(spark, d):
    """Cells of a few radii: most verdicts cross an edge."""
    return _suppressed(spark, d, 8)


@query("nms_zero_radius", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1")
def nms_zero_radius(spark, d):
    best = sequences.best_per_center(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", [F.desc("l_extendedprice"), F.asc("l_partkey"), F.asc("l_suppkey")])
    return best.select(*LINE)


MATCH = f"""WITH RECURSIVE {EV}, m AS (SELECT subject_id, us / 1e6 AS t, CASE code_id WHEN 'signup' THEN 0 ELSE 1 END AS kind FROM ev WHERE code_id IN ('signup', 'purchase')),
 o AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY t, kind) AS k FROM m),
 f AS (SELECT subject_id, 0::BIGINT AS k, []::DOUBLE[] AS wait, 0 AS waiting, NULL::DOUBLE AS truth_t, NULL::DOUBLE AS found_t FROM (SELECT DISTINCT subject_id FROM o) UNION ALL
  SELECT subject_id, k, CASE WHEN taken THEN w[2:] ELSE list_append(w, t) END, CASE WHEN taken THEN waiting ELSE kind END,
   CASE WHEN taken THEN CASE WHEN kind = 1 THEN w[1] ELSE t END END, CASE WHEN taken THEN CASE WHEN kind = 1 THEN t ELSE w[1] END END
  FROM (SELECT *, len(w) > 0 AND waiting <> kind AS taken FROM (SELECT o.subject_id, o.k, o.t, o.kind, f.waiting, list_filter(f.wait, lambda x: o.t - x <= 3600) AS w FROM f JOIN o ON o.subject_id = f.subject_id AND o.k = f.k + 1)))
 SELECT subject_id, truth_t, found_t FROM f WHERE truth_t IS NOT NULL"""


@query("event_match", MATCH)
def event_match(spark, d):
    t = ev(spark, d).select("subject_id", "code_id", (F.col("us") / 1e6).alias("t"))
    pick = lambda c: t.where(F.col("code_id") == c).select("subject_id", "t")
    return sequences.match_events(pick("signup"), pick("purchase"), ["subject_id"], 3600.0)


@query("band_join", f"WITH {EV} SELECT a.subject_id, a.event_id AS truth_id, b.event_id AS found_id FROM ev a JOIN ev b ON a.subject_id = b.subject_id AND a.code_id = 'signup' AND b.code_id = 'purchase' AND abs(a.us - b.us) <= {6 * HOUR}")
def band_join(spark, d):
    pick = lambda c, t, i: ev(spark, d).where(F.col("code_id") == c).select("subject_id", F.col("us").alias(t), F.col("event_id").alias(i))
    return sequences.band_join(pick("signup", "t", "truth_id"), pick("purchase", "f", "found_id"), ["subject_id"], "t", "f", 6 * HOUR).select("subject_id", "truth_id", "found_id")


@query("nearest_anchor", f"""WITH {EV}, a AS (SELECT subject_id, event_id, us FROM ev WHERE code_id = 'signup'), b AS (SELECT subject_id, us, score FROM ev WHERE code_id = 'purchase'),
 h AS (SELECT a.subject_id, a.event_id, b.us AS start, b.score FROM a JOIN b ON a.subject_id = b.subject_id AND abs(a.us - b.us) <= {6 * HOUR})
 SELECT a.subject_id, a.event_id, coalesce(max(h.score), 0) AS matched_score, arg_max(h.start, (h.score, -h.start)) AS matched_start FROM a LEFT JOIN h ON a.event_id = h.event_id GROUP BY ALL""")
def nearest_anchor(spark, d):
    e = ev(spark, d)
    a, b = e.where("code_id = 'signup'").select("subject_id", "event_id", "us"), e.where("code_id = 'purchase'").select("subject_id", F.col("us").alias("start"), "score")
    return sequences.nearest_best(a, b, ["subject_id"], "us", "start", "score", 6 * HOUR, "event_id").select("subject_id", "event_id", "matched_score", "matched_start")


@query("interval_containment", f"WITH {EV}, {ISLANDS} SELECT e.subject_id, e.event_id FROM ev e JOIN islands i ON e.subject_id = i.subject_id AND e.us - {HOUR} >= i.start AND e.us + {HOUR} <= i.stop")
def interval_containment(spark, d):
    w = ev(spark, d).select("subject_id", "event_id", (F.col("us") - HOUR).alias("start"), (F.col("us") + HOUR).alias("stop"))
    return intervals.contained(w, intervals.merge(_windows(spark, d), ["subject_id"]), ["subject_id"], 6 * HOUR).select("subject_id", "event_id")


# ---------------------------------------------------------------- signals and templates
@query("ncc_embedding", """WITH t AS (SELECT embedding AS t FROM embeddings ORDER BY vec_id LIMIT 1), x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS a, unnest(t)::DOUBLE AS b FROM embeddings, t)
 SELECT vec_id, round(corr(a, b), 6) AS score FROM x GROUP BY vec_id""")
def ncc_embedding(spark, d):
    e = table(spark, d, "embeddings")
    t = [float(v) for v in e.orderBy("vec_id").select("embedding").first()[0]]  # the template: one vector
    n, mean = len(t), sum(t) / len(t)
    c = [v - mean for v in t]
    power = sum(v * v for v in c)
    x = F.transform("embedding", lambda v: v.cast("double"))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    num = add(F.zip_with(x, F.array(*[F.lit(v) for v in c]), lambda p, q: p * q))
    energy = add(F.transform(x, lambda v: v * v)) - add(x) * add(x) / n
    return e.select("vec_id", F.round(num / F.sqrt(energy * power), 6).alias("score"))


@query("transition_easing", """WITH k AS (SELECT event_id, (event_id % 15 + 1) / 15.0::DOUBLE AS u FROM events) SELECT event_id, round(0.5 - 0.5 * cos(pi() * u), 9) AS cosine, round(10 * pow(u, 3) - 15 * pow(u, 4) + 6 * pow(u, 5), 9) AS minimum_jerk, round(pow(sin(pi() * u), 4), 9) AS bump FROM k""")
def transition_easing(spark, d):
    """Shapes of the ways between levels, an event standing for a fifteenth of one."""
    u = (F.col("event_id") % 15 + 1) / 15.0
    return table(spark, d, "events").select("event_id", F.round(0.5 - 0.5 * F.cos(F.pi() * u), 9).alias("cosine"), F.round(10 * F.pow(u, 3) - 15 * F.pow(u, 4) + 6 * F.pow(u, 5), 9).alias("minimum_jerk"), F.round(F.pow(F.sin(F.pi() * u), 4), 9).alias("bump"))


#: Digits of a number as the symbols of a rhythm.
DIGITS, SYMBOLS = "0123456789", "SLEPSLESLE"
CENTS = f"translate(CAST(CAST(round(abs(s_acctbal) * 100) AS BIGINT) AS VARCHAR), '{DIGITS}', '{SYMBOLS}')"


@query("waveform_template", f"""WITH ok AS (SELECT * FROM (SELECT s_suppkey, {CENTS} AS rhythm FROM supplier) WHERE regexp_matches(rhythm, '[SLE]')),
 c AS (SELECT s_suppkey, i, substr(rhythm, i, 1) AS c, length(regexp_extract(substr(rhythm, 1, i - 1), '[^P]*$')) AS since FROM ok, range(1, 20) t(i) WHERE i <= length(rhythm)),
 st AS (SELECT s_suppkey, 0 AS k, 0.0::DOUBLE AS level, 40 AS hold FROM ok UNION ALL SELECT s_suppkey, i, CASE WHEN c = 'P' THEN 0.0::DOUBLE WHEN since % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END,
  greatest(1, round_even((CASE c WHEN 'S' THEN 0.35::DOUBLE WHEN 'L' THEN 0.75::DOUBLE WHEN 'E' THEN 0.55::DOUBLE ELSE 1.0::DOUBLE END * 1.1::DOUBLE) * 100::DOUBLE, 0)::INTEGER) FROM c
  UNION ALL SELECT s_suppkey, length(rhythm) + 1, 0.0::DOUBLE, 40 FROM ok),
 nx AS (SELECT *, lead(level) OVER (PARTITION BY s_suppkey ORDER BY k) AS next FROM st),
 seg AS (SELECT s_suppkey, 2 * k AS seg, level AS a, level AS b, hold AS n FROM nx UNION ALL SELECT s_suppkey, 2 * k + 1, level, next, greatest(1, round_even((0.15::DOUBLE * 1.1::DOUBLE) * 100::DOUBLE, 0)::INTEGER) FROM nx WHERE next <> level),
 pl AS (SELECT *, sum(n) OVER (PARTITION BY s_suppkey ORDER BY seg) - n AS first FROM seg)
 SELECT s_suppkey, (first + j - 1)::INTEGER AS sample, round(CASE WHEN a = b THEN a ELSE a + (b - a) * (0.5 - 0.5 * cos(pi() * (j / n))) END, 9) AS value FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM pl)""")
def waveform_template(spark, d):
    """The waveform of each supplier's balance, its digits read as a rhythm."""
    cents = F.round(F.abs("s_acctbal") * 100).cast("long").cast("string")
    rhythms = table(spark, d, "supplier").select("s_suppkey", F.translate(cents, DIGITS, SYMBOLS).alias("rhythm"))
    out = waveforms.samples(waveforms.segments(rhythms, waveforms.Waveform(), 1.1))
    return out.select("s_suppkey", "sample", F.round("value", 9).alias("value"))


@query("sample_counts", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(1, round_even(l_quantity * 0.5, 0)::BIGINT) AS samples FROM lineitem")
def sample_counts(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.greatest(F.lit(1), F.rint(F.col("l_quantity") * 0.5).cast("long")).alias("samples"))


# ---------------------------------------------------------------- bootstrap
def _study(spark, d):
    """Hours in whole millionths, whose sums are exact."""
    return _pairs(spark, d).select("subject_id", F.col("candidate_events"), F.col("control_events"), (F.round("hours", 6).cast("decimal(18,6)") * 1_000_000).cast("long").alias("hours"))


DRAWS = """ids AS (SELECT subject_id, row_number() OVER (ORDER BY subject_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT subject_id FROM {0})),
 w AS (SELECT r AS replicate, ids.subject_id, count(*) AS weight FROM range({1}) a(r), (SELECT i AS k, n FROM ids) b, ids WHERE ids.i = ('0x' || substr(md5('7|' || r || '|' || k), 1, 15))::BIGINT % b.n GROUP BY ALL)"""


#: Replicates of the pilot's and of the confirmatory bootstrap.
PILOT, CONFIRMATORY = 10_000, 50_000


@query("bootstrap_cluster", f"""WITH {EV}, {EXPO}, {PAIRS}, {DRAWS.format('pairs', PILOT)}, d AS (SELECT replicate, (sum(weight * candidate_events) - sum(weight * control_events))::DOUBLE / sum(weight * round(hours, 6)::DECIMAL(18, 6))::DOUBLE AS difference FROM w JOIN pairs USING (subject_id) GROUP BY replicate)
 SELECT count(*) AS replicates, round(quantile_cont(difference, 0.025), 9) AS lower, round(quantile_cont(difference, 0.975), 9) AS upper FROM d""")
def bootstrap_cluster(spark, d):
    """The pilot's interval of the rate difference, from md5 draws of subjects."""
    out = bootstrap.hash_cluster(_study(spark, d), PILOT, "7")
    difference = (F.col("candidate_events") - F.col("control_events")).cast("double") / (F.col("hours") / 1_000_000)
    found = bootstrap.interval_columns(out.select(difference.alias("difference")))
    return found.select(F.col("n").alias("replicates"), F.round("lower", 9).alias("lower"), F.round("upper", 9).alias("upper"))


def _matched_interval(spark, d, draws):
    i, e, x = inj(spark, d), ev(spark, d), expo(spark, d)
    both = e.where(F.col("code_id").isin("signup", "error"))
    stored = both.where("score >= 0.001").groupBy("code_id", "record_id").agg(F.min("score").alias("threshold"))
    floors = {r["code_id"]: r["floor"] for r in thresholds.storage_floor(stored, both, ["code_id"]).collect()}  # two codes
    return bootstrap.matched_interval(i, both, x, "signup", "error", 0.9, CONFIRMATORY, 42, floors, draws)


@query("bootstrap_matched")
def bootstrap_matched(spark, d):
    """The confirmatory interval with both thresholds selected anew, by counter-based draws."""
    return _matched_interval(spark, d, "counter")


@query("bootstrap_numpy")
def bootstrap_numpy(spark, d):
    """The same by the stream of one numpy generator."""
    return _matched_interval(spark, d, "numpy")


@query("label_seed", "SELECT n_name, array_to_string(list_reverse(regexp_extract_all(substr(sha256('42|' || n_name), 1, 16), '..')), '') AS seed FROM nation")
def label_seed(spark, d):
    return table(spark, d, "nation").select("n_name", bootstrap.seed_column(F.concat_ws("|", F.lit("42"), "n_name")).alias("seed"))


# ---------------------------------------------------------------- codes
BOOK_SQL = f"book AS (SELECT p_brand AS code_id, translate(CAST(sum(p_size) AS VARCHAR), '{DIGITS}', '{SYMBOLS}') AS rhythm FROM part GROUP BY p_brand)"
WORDS_SQL = "words AS (SELECT DISTINCT translate(lpad(to_binary(p_partkey % 256), 8, '0'), '01', 'SL') AS word FROM part), ok AS (SELECT word FROM words WHERE length(replace(word, 'S', '')) = 4 AND word NOT LIKE '%SSS%' AND word NOT LIKE '%LLL%')"


@query("code_overlaps", f"WITH {BOOK_SQL} SELECT a.code_id AS suffix_code, b.code_id AS prefix_code, n::INTEGER AS overlap, right(a.rhythm, n) AS sequence FROM book a, book b, range(1, 20) t(n) WHERE n < least(length(a.rhythm), length(b.rhythm)) AND right(a.rhythm, n) = left(b.rhythm, n)")
def code_overlaps(spark, d):
    """A code for each brand, from the sum of its sizes."""
    total = F.sum("p_size").cast("string")
    return codes.overlaps(table(spark, d, "part").groupBy(F.col("p_brand").alias("code_id")).agg(F.translate(total, DIGITS, SYMBOLS).alias("rhythm")))


def _words(spark, d):
    return codes.balanced_words(codes.binary_words(table(spark, d, "part"), "p_partkey"))


@query("balanced_words", f"WITH {WORDS_SQL} SELECT word FROM ok")
def balanced_words(spark, d):
    return _words(spark, d)


FREE = " AND ".join(f"NOT (right({a}, {n}) = left({b}, {n}))" for a, b in (("a.word", "a.word"), ("a.word", "b.word"), ("b.word", "a.word"), ("b.word", "b.word")) for n in range(1, 8))
PAIRS_SQL = f"prs AS (SELECT a.word AS first, b.word AS second, hamming(a.word, b.word)::INTEGER AS distance FROM ok a JOIN ok b ON a.word < b.word WHERE {FREE})"


@query("hamming_pairs", f"WITH {WORDS_SQL}, {PAIRS_SQL} SELECT * FROM prs")
def hamming_pairs(spark, d):
    return codes.pairs_by_distance(_words(spark, d))


@query("select_pair", f"WITH {WORDS_SQL.replace('ok AS', 'ok0 AS')}, ok AS (SELECT word FROM ok0 WHERE word LIKE 'SS%' AND word NOT LIKE 'SS%SS%'), {PAIRS_SQL} SELECT * FROM prs WHERE distance = (SELECT max(distance) FROM prs)")
def select_pair(spark, d):
    return codes.select_pair(_words(spark, d))


@query("rhythm_check", "SELECT p_partkey, regexp_matches(p_brand, '^[SLEP]+$') AND regexp_matches(p_brand, '[SLE]') AS valid FROM part")
def rhythm_check(spark, d):
    return table(spark, d, "part").select("p_partkey", codes.valid_rhythm(F.col("p_brand")).alias("valid"))


# ---------------------------------------------------------------- manifests and files
def _manifest(spark, d):
    """Rows of a confirmatory manifest from parts; every rule is broken by some."""
    name, odd = F.concat_ws("", F.lit("p"), F.col("p_partkey").cast("string")), lambda n: F.col("p_partkey") % n == 0
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return table(spark, d, "part").select(
        F.concat(F.when(odd(23), "_").otherwise(""), name).alias("record_id"), F.col("p_brand").alias("subject_id"), F.lower("p_type").alias("cohort"),
        F.concat(name, F.when(F.col("p_size") % 7 == 0, F.lit("/../x")).otherwise(F.lit("")), F.lit(".edf")).alias("signal_file"), F.when(odd(19), F.upper(sha("p_name"))).otherwise(sha("p_name")).alias("signal_sha256"),
        F.concat(name, F.when(odd(17), "..").otherwise(""), F.lit(".hyp")).alias("annotation_file"), F.when(~odd(13), sha("p_type")).alias("annotation_sha256"),
        F.when(odd(11), "add").when(odd(2), "subtract").otherwise("identity").alias("operation"), F.when(odd(4), "B").otherwise("").alias("channel_b"),
        (F.col("p_size") - 3).cast("double").alias("source_sample_rate_hz"), F.lit(100.0).alias("target_sample_rate_hz"),
    )


MANIFEST = """m AS (SELECT CASE WHEN p_partkey % 23 = 0 THEN '_' ELSE '' END || 'p' || p_partkey AS record_id, p_brand AS subject_id, lower(p_type) AS cohort, 'p' || p_partkey || CASE WHEN p_size % 7 = 0 THEN '/../x' ELSE '' END || '.edf' AS signal_file,
 CASE WHEN p_partkey % 19 = 0 THEN upper(sha256(p_name)) ELSE sha256(p_name) END AS signal_sha256, 'p' || p_partkey || CASE WHEN p_partkey % 17 = 0 THEN '..' ELSE '' END || '.hyp' AS annotation_file, CASE WHEN p_partkey % 13 <> 0 THEN sha256(p_type) END AS annotation_sha256,
 CASE WHEN p_partkey % 11 = 0 THEN 'add' WHEN p_partkey % 2 = 0 THEN 'subtract' ELSE 'identity' END AS operation, CASE WHEN p_partkey % 4 = 0 THEN 'B' ELSE '' END AS channel_b, (p_size - 3)::DOUBLE AS rate FROM part)"""
NAME_SQL = "regexp_matches({0}, '^[A-Za-z0-9][A-Za-z0-9._-]*$')"
RULES_SQL = {
    "record_id": NAME_SQL.format("record_id"), "subject_id": NAME_SQL.format("subject_id"), "cohort": "cohort IN ('economy', 'small', 'medium', 'promo')",
    "signal_file": NAME_SQL.format("signal_file") + " AND NOT contains(signal_file, '..')", "annotation_file": NAME_SQL.format("annotation_file") + " AND NOT contains(annotation_file, '..')",
    "signal_sha256": "regexp_matches(signal_sha256, '^[0-9a-f]{64}$')", "annotation_sha256": "regexp_matches(annotation_sha256, '^[0-9a-f]{64}$')",
    "operation": "operation IN ('identity', 'subtract')", "channels": "(operation = 'subtract') = (channel_b <> '')", "rates": "rate > 0",
}


@query("manifest_unpivot", f"WITH {MANIFEST} SELECT record_id, 'signal' AS role, signal_file AS file, signal_sha256 AS sha256 FROM m UNION ALL SELECT record_id, 'annotation', annotation_file, annotation_sha256 FROM m")
def manifest_unpivot(spark, d):
    return manifests.assets(_manifest(spark, d))


@query("manifest_violations", f"WITH {MANIFEST} " + " UNION ALL ".join(f"SELECT record_id, '{k}' AS rule FROM m WHERE NOT coalesce({c}, false)" for k, c in RULES_SQL.items()))
def manifest_violations(spark, d):
    checks = manifests.record_checks(("economy", "small", "medium", "promo"))
    return _manifest(spark, d).select("record_id", F.explode(manifests.violations(checks)).alias("rule"))


def _downloads(spark, d):
    p = table(spark, d, "part")
    name = F.concat_ws("", F.lit("p"), (F.col("p_partkey") - F.when(F.col("p_partkey") % 50 == 1, 1).otherwise(0)).cast("string"))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return p.select(
        F.concat(F.lit(" s"), (F.col("p_partkey") - F.when(F.col("p_partkey") % 40 == 1, 1).otherwise(0)).cast("string")).alias("subject_id"), F.when(F.col("p_size") == 7, "train").when(F.col("p_size") % 2 == 0, "test").otherwise("development").alias("split"),
        F.concat(name, F.when(F.col("p_size") == 9, ".txt").otherwise(".EDF")).alias("psg_file"), F.upper(sha("p_name")).alias("psg_sha256"),
        F.concat(F.when(F.col("p_size") == 11, "a/").otherwise(""), F.lit("h"), F.col("p_partkey").cast("string"), F.lit(".edf ")).alias("hypnogram_file"), F.when(F.col("p_size") == 13, "00").otherwise(sha("p_type")).alias("hypnogram_sha256"),
    )


@query("download_violations", """WITH m AS (SELECT 's' || (p_partkey - CASE WHEN p_partkey % 40 = 1 THEN 1 ELSE 0 END) AS subject_id, CASE WHEN p_size = 7 THEN 'train' WHEN p_size % 2 = 0 THEN 'test' ELSE 'development' END AS split,
  'p' || (p_partkey - CASE WHEN p_partkey % 50 = 1 THEN 1 ELSE 0 END) || CASE WHEN p_size = 9 THEN '.txt' ELSE '.EDF' END AS psg_file, sha256(p_name) AS psg_sha256,
  CASE WHEN p_size = 11 THEN 'a/' ELSE '' END || 'h' || p_partkey || '.edf' AS hypnogram_file, CASE WHEN p_size = 13 THEN '00' ELSE sha256(p_type) END AS hypnogram_sha256 FROM part),
 f AS (SELECT psg_file AS file, psg_sha256 AS d, subject_id FROM m UNION ALL SELECT hypnogram_file, hypnogram_sha256, subject_id FROM m)
 SELECT subject_id, 'split' AS rule FROM m WHERE split NOT IN ('development', 'test') UNION ALL SELECT subject_id, 'psg_file' FROM m WHERE NOT lower(psg_file) LIKE '%.edf' UNION ALL SELECT subject_id, 'hypnogram_file' FROM m WHERE contains(hypnogram_file, '/')
 UNION ALL SELECT subject_id, 'hypnogram_sha256' FROM m WHERE NOT regexp_matches(hypnogram_sha256, '^[0-9a-f]{64}$') UNION ALL SELECT subject_id, 'subject_repeats' FROM m GROUP BY subject_id HAVING count(*) > 1
 UNION ALL SELECT min(subject_id), CASE WHEN count(DISTINCT d) > 1 THEN 'file_conflicts' ELSE 'file_repeats' END FROM f GROUP BY file HAVING count(*) > 1""")
def download_violations(spark, d):
    return manifests.download_violations(_downloads(spark, d))


@query("digest_check", "WITH e AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN sha256(url) ELSE sha256(html) END AS want FROM pages), f AS (SELECT page_id, sha256(html) AS got FROM pages WHERE page_id % 7 <> 0) SELECT e.page_id AS file, CASE WHEN f.page_id IS NULL THEN 'missing' ELSE 'mismatch' END AS problem FROM e LEFT JOIN f USING (page_id) WHERE f.page_id IS NULL OR want <> got")
def digest_check(spark, d):
    p = table(spark, d, "pages")
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    want = p.select(F.col("page_id").alias("file"), F.when(F.col("page_id") % 5 == 0, sha("url")).otherwise(sha("html")).alias("sha256"))
    return manifests.digest_problems(want, p.where("page_id % 7 <> 0").select(F.col("page_id").alias("file"), sha("html").alias("sha256")))


@query("clock_parse", f"WITH {EV}, c AS (SELECT event_id, strftime(make_timestamp(us), '%H:%M:%S') AS clock FROM ev) SELECT event_id, clock, (split_part(clock, ':', 1)::INTEGER * 3600 + split_part(clock, ':', 2)::INTEGER * 60 + split_part(clock, ':', 3)::INTEGER - 84600 + 86400) % 86400 AS onset FROM c")
def clock_parse(spark, d):
    c = table(spark, d, "events").select("event_id", F.date_format("ts", "HH:mm:ss").alias("clock"))
    return c.withColumn("onset", F.pmod(recordings.clock_seconds(F.col("clock")) - 84600, F.lit(86400)).cast("int"))


@query("origin_align", f"WITH {EV} SELECT event_id, round(value + CASE WHEN code_id = 'error' THEN 0 ELSE (us - (us // {DAY}) * {DAY}) / 1e6 - 2.0 END, 6) AS onset FROM ev")
def origin_align(spark, d):
    e = ev(spark, d)
    origin = F.when(F.col("code_id") != "error", F.col("us"))
    return e.select("event_id", F.round(intervals.aligned(F.col("value"), origin, F.floor(F.col("us") / DAY) * DAY, 2.0), 6).alias("onset"))


@query("channel_type_counts", "SELECT CASE WHEN contains(upper(p_name), 'EOG') THEN 'EOG' WHEN contains(upper(p_name), 'EMG') THEN 'EMG' WHEN contains(upper(p_name), 'ECG') OR contains(upper(p_name), 'EKG') THEN 'ECG' ELSE 'EEG' END AS kind, count(*) AS n FROM part GROUP BY ALL")
def channel_type_counts(spark, d):
    return table(spark, d, "part").groupBy(manifests.channel_type(F.col("p_name")).alias("kind")).agg(F.count("*").alias("n"))


@query("duplicate_groups", "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return manifests.repeated(rows, "digest", "doc_id")


@query("validate_numeric", "SELECT count(*) FILTER (try_cast(props AS DOUBLE) IS NULL) AS props, count(*) FILTER (value IS NULL OR isnan(value) OR isinf(value)) AS value, count(*) FILTER (user_id IS NULL) AS user_id FROM events")
def validate_numeric(spark, d):
    return tables.count_not_numeric(table(spark, d, "events"), ["props", "value", "user_id"])


@query("domain_rules", f"WITH {EV} SELECT count(*) FILTER (NOT score BETWEEN 0 AND 0.1) AS score_range, count(*) FILTER (NOT us > 0) AS time_positive, count(*) FILTER (code_id NOT IN ('purchase', 'view', 'signup', 'error')) AS known_code FROM ev")
def domain_rules(spark, d):
    return tables.rule_violations(ev(spark, d), {"score_range": F.col("score").between(0, 0.1), "time_positive": F.col("us") > 0, "known_code": F.col("code_id").isin("purchase", "view", "signup", "error")})


@query("union_bundles", f"WITH {EV} SELECT event_id, 'a' AS bundle, score FROM ev WHERE code_id = 'purchase' UNION ALL SELECT event_id, 'b', NULL FROM ev WHERE code_id = 'view'")
def union_bundles(spark, d):
    e = ev(spark, d)
    return tables.combine(e.where("code_id = 'purchase'").select("event_id", F.lit("a").alias("bundle"), "score"), e.where("code_id = 'view'").select("event_id", F.lit("b").alias("bundle")))


@query("key_intersection", f"WITH {EV} SELECT record_id FROM ev WHERE code_id = 'purchase' INTERSECT SELECT record_id FROM ev WHERE code_id = 'view'")
def key_intersection(spark, d):
    e = ev(spark, d)
    return e.where("code_id = 'purchase'").select("record_id").intersect(e.where("code_id = 'view'").select("record_id"))


@query("key_difference", f"WITH {EV} SELECT record_id FROM ev WHERE code_id = 'purchase' EXCEPT SELECT record_id FROM ev WHERE code_id = 'view'")
def key_difference(spark, d):
    e = ev(spark, d)
    return e.where("code_id = 'purchase'").select("record_id").subtract(e.where("code_id = 'view'").select("record_id"))


@query("rate_projection", f"WITH {EV}, {ISLANDS} SELECT subject_id, ceil(start * (0.0000001 / 0.000001) - 1e-10)::BIGINT AS start, ceil(stop * (0.0000001 / 0.000001) - 1e-10)::BIGINT AS stop FROM islands")
def rate_projection(spark, d):
    rows = intervals.merge(_windows(spark, d), ["subject_id"]).select("subject_id", "start", "stop")
    return intervals.project_rate(rows, 0.000001, 0.0000001, 1 << 60)


@query("windowed_scale", """SELECT event_type AS code_id, w AS window_start, w + INTERVAL 1 HOUR AS window_end, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY ALL""")
def windowed_scale(spark, d):
    from wavetally.streaming.causal_gate import windowed_scale as scale

    e = table(spark, d, "events").select(F.col("event_type").alias("code_id"), "ts", F.col("value").alias("score"))
    return scale(e).select("code_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "n")

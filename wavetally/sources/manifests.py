"""Manifests: validation with all violations named, assets, digests, checksum lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHA256 = "^[0-9a-f]{64}$"
SAFE_NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"


def violations(checks: dict[str, Column]) -> Column:
    """Names of the checks that a row fails (a null check fails)."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())


def safe_name(c: Column) -> Column:
    return c.rlike(SAFE_NAME) & ~c.contains("..")


def record_checks(cohorts, operations=("identity", "subtract")) -> dict[str, Column]:
    """Rules of a confirmatory manifest row."""
    return {
        "record_id": F.col("record_id").rlike(SAFE_NAME),
        "subject_id": F.col("subject_id").rlike(SAFE_NAME),
        "cohort": F.col("cohort").isin(*cohorts),
        "signal_file": safe_name(F.col("signal_file")),
        "annotation_file": safe_name(F.col("annotation_file")),
        "signal_sha256": F.col("signal_sha256").rlike(SHA256),
        "annotation_sha256": F.col("annotation_sha256").rlike(SHA256),
        "operation": F.col("operation").isin(*operations),
        "channels": (F.col("operation") == "subtract") == (F.coalesce(F.col("channel_b"), F.lit("")) != ""),
        "rates": (F.col("source_sample_rate_hz") > 0) & (F.col("target_sample_rate_hz") > 0),
    }


def validated(df: DataFrame, checks: dict[str, Column], key: str = "record_id") -> DataFrame:
    """All rows are checked before any filter; every failing rule is reported at once."""
    bad = df.withColumn("rule", F.explode(violations(checks))).groupBy("rule").agg(F.count("*").alias("n"), F.min(key).alias("first"))
    found = [f"{r['rule']}: {r['n']} rows, first {r['first']}" for r in bad.orderBy("rule").collect()]
    twice = df.groupBy(key).count().where("count > 1").count()
    if twice:
        found.append(f"{key}: {twice} values repeat")
    if found:
        raise ValueError("; ".join(found))
    return df


def select_split(df: DataFrame, split: str, subject: str = "subject_id") -> DataFrame:
    """Rows of a split, whose subjects must be unique."""
    rows = df.where(F.col("split") == split)
    if not rows.groupBy(subject).count().where("count > 1").isEmpty():
        raise ValueError("a subject repeats within the split")
    return rows


def assets(df: DataFrame, key: str = "record_id") -> DataFrame:
    """Two rows for each record: its signal and its annotations, with their digests."""
    pair = lambda role: F.struct(F.lit(role).alias("role"), F.col(f"{role}_file").alias("file"), F.col(f"{role}_sha256").alias("sha256"))
    return df.select(key, F.inline(F.array(pair("signal"), pair("annotation"))))


#: Where the two data sets are published.
SOURCES = {"edfx": "https://physionet.org/files/sleep-edfx/1.0.0", "cap": "https://physionet.org/files/capslpdb/1.0.0"}


def routing(df: DataFrame, sources: dict[str, str] = SOURCES) -> DataFrame:
    """Dataset, folder and base address, derived from the cohort."""
    dataset = F.when(F.col("cohort").startswith("cap"), "cap").otherwise("edfx")
    out = df.withColumn("dataset", dataset).withColumn("folder", F.concat_ws("/", "dataset", F.when(F.col("dataset") == "edfx", F.col("cohort"))))
    base = F.when(F.col("dataset") == "cap", sources["cap"]).otherwise(F.concat_ws("/", F.lit(sources["edfx"]), "cohort"))
    return out.withColumn("base_url", base)


def digests(files: DataFrame, content: str = "content") -> DataFrame:
    """files: as the binaryFile source gives them."""
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2(content, 256).alias("sha256"), F.octet_length(content).alias("bytes"))


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    return digests(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder))


def digest_problems(expected: DataFrame, found: DataFrame, file: str = "file", digest: str = "sha256") -> DataFrame:
    """Missing and mismatched files, all of them."""
    have = found.select(F.col(file).alias("_f"), F.col(digest).alias("_d"))
    joined = expected.join(have, F.col(file) == F.col("_f"), "left")
    problem = F.when(F.col("_f").isNull(), "missing").when(F.lower(digest) != F.lower("_d"), "mismatch")
    return joined.select(file, problem.alias("problem")).where("problem is not null")


def checksum_list(text: DataFrame, line: str = "value") -> DataFrame:
    """``digest path`` lines; a path that repeats is an error."""
    parts = F.split(F.trim(line), r"\s+", 2)
    rows = text.where(F.trim(line) != "").select(F.lower(parts[0]).alias("sha256"), F.regexp_replace(parts[1], r"^\*", "").alias("file"))
    if not rows.groupBy("file").count().where("count > 1").isEmpty():
        raise ValueError("a path repeats in the checksum list")
    return rows


def exactly_one(records: DataFrame, files: DataFrame, prefix: Column, suffix: str | Column, key: str) -> DataFrame:
    """The one file of each record with its prefix and suffix; none or several raise.

    Prefixes may have any lengths: a file offers its beginnings of all lengths that occur, at
    most as many as a name has characters, and meets records by equality."""
    asked = records.select(key, prefix.alias("_p"), (suffix if isinstance(suffix, Column) else F.lit(suffix)).alias("_s"))
    lengths = F.broadcast(asked.agg(F.collect_set(F.length("_p")).alias("_l")))  # one row
    begins = F.transform(F.filter("_l", lambda n: n <= F.length("file")), lambda n: F.left("file", n))
    named = files.select("file").distinct().crossJoin(lengths).select("file", F.explode(begins).alias("_p"))
    fits = asked.join(named, "_p", "left").where(F.col("file").isNull() | F.endswith("file", F.col("_s")))
    found = asked.select(key).join(fits.groupBy(key).agg(F.count("file").alias("n"), F.min("file").alias("file")), key, "left")
    if not found.where("coalesce(n, 0) != 1").isEmpty():
        raise ValueError("a record does not have exactly one file")
    return found.select(key, "file")


#: The splits of a download manifest.
SPLITS = ("development", "test")


def download_violations(df: DataFrame) -> DataFrame:
    """(subject_id, rule) of all rows of a download manifest (subject_id, split, psg_file,
    psg_sha256, hypnogram_file, hypnogram_sha256) that break a rule: split, subject_id,
    psg_file, psg_sha256, hypnogram_file, hypnogram_sha256, subject_repeats, file_repeats (listed
    twice with one digest) and file_conflicts (with several). Texts count without outer blanks,
    digests in lower case."""
    clean = {c: F.trim(F.coalesce(c, F.lit(""))) for c in ("subject_id", "split", "psg_file", "hypnogram_file")}
    clean |= {c: F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("psg_sha256", "hypnogram_sha256")}
    rows = df.select(*[x.alias(c) for c, x in clean.items()])
    name = lambda c: F.lower(c).endswith(".edf") & ~F.col(c).rlike(r"[/\\\\]") & (F.length(c) > 0)
    checks = {"split": F.col("split").isin(*SPLITS), "subject_id": F.col("subject_id") != ""}
    for role in ("psg", "hypnogram"):
        checks |= {f"{role}_file": name(f"{role}_file"), f"{role}_sha256": F.col(f"{role}_sha256").rlike(SHA256)}
    alone = rows.select("subject_id", F.explode(violations(checks)).alias("rule"))
    twice = rows.groupBy("subject_id").count().where("count > 1").select("subject_id", F.lit("subject_repeats").alias("rule"))
    listed = rows.select("subject_id", F.inline(F.array(*[F.struct(F.col(f"{r}_file").alias("file"), F.col(f"{r}_sha256").alias("sha256")) for r in ("psg", "hypnogram")])))
    files = listed.groupBy("file").agg(F.count("*").alias("n"), F.count_distinct("sha256").alias("d"), F.min("subject_id").alias("subject_id")).where("n > 1")
    return alone.unionByName(twice).unionByName(files.select("subject_id", F.when(F.col("d") > 1, "file_conflicts").otherwise("file_repeats").alias("rule")))


def download_files(df: DataFrame, split: str) -> DataFrame:
    """(subject_id, split, role, file, sha256) of one split or ``all``, after a check of the whole
    manifest; a broken rule or a split without files raises."""
    if split not in (*SPLITS, "all"):
        raise ValueError(f"no split is called {split!r}")
    broken = [f"{r['rule']}: {r['n']}, first {r['s']}" for r in download_violations(df).groupBy("rule").agg(F.count("*").alias("n"), F.min("subject_id").alias("s")).orderBy("rule").collect()]
    if broken:
        raise ValueError("; ".join(broken))
    part = lambda r: F.struct(F.lit(r).alias("role"), F.trim(f"{r}_file").alias("file"), F.lower(F.trim(f"{r}_sha256")).alias("sha256"))
    rows = df.where(F.lit(split == "all") | (F.trim("split") == split)).select(F.trim("subject_id").alias("subject_id"), F.trim("split").alias("split"), F.inline(F.array(part("psg"), part("hypnogram"))))
    if rows.isEmpty():
        raise ValueError(f"no files in split {split!r}")
    return rows


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """file, bytes and modified of every file; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def channel_type(name: Column) -> Column:
    """EOG, then EMG, then ECG or EKG in the name, else EEG."""
    n = F.upper(name)
    return F.when(n.contains("EOG"), "EOG").when(n.contains("EMG"), "EMG").when(n.contains("ECG") | n.contains("EKG"), "ECG").otherwise("EEG")


def repeated(df: DataFrame, digest: str, member: str) -> DataFrame:
    """Digests of more than one row, how many rows, and the first."""
    return df.groupBy(digest).agg(F.count("*").alias("n"), F.min(member).alias("first")).where("n > 1")


#: File names of the two studies. Groups: subject and night.
NAMES = {
    "sc": r"^sleep-cassette/SC4(\d{2})([12])[EFG]0-PSG\.edf$",
    "st": r"^sleep-telemetry/ST7(\d{2})([12])J0-PSG\.edf$",
}


def named(files: DataFrame, patterns: dict[str, str] = NAMES, path: str = "file") -> DataFrame:
    """Files that match a study's pattern, with study, subject and night; others go. A null path
    matches none."""
    study = F.coalesce(*[F.when(F.col(path).rlike(p), F.lit(k)) for k, p in patterns.items()])
    part = lambda n: F.coalesce(*[F.when(F.col("study") == k, F.regexp_extract(path, p, n)) for k, p in patterns.items()]).cast("int")
    return files.withColumn("study", study).where("study is not null").withColumns({"subject": part(1), "night": part(2)})


def classified(records: DataFrame, nights: DataFrame, placebo: DataFrame, first_subject: int = 12) -> DataFrame:
    """records: as ``named`` gives them. nights: (subject, night) of study sc; placebo: (subject,
    placebo_night) of study st. Adds participant, cohort, role and condition. Subjects of sc
    under ``first_subject`` go, as they served development; a record without a row of its table
    raises."""
    sc = records.where((F.col("study") == "sc") & (F.col("subject") >= first_subject)).join(nights.select("subject", "night", F.lit(True).alias("_known")), ["subject", "night"], "left")
    st = records.where("study = 'st'").join(placebo.select("subject", "placebo_night"), "subject", "left").withColumn("_known", F.col("placebo_night").isNotNull())
    both = sc.withColumn("placebo_night", F.lit(None).cast("int")).unionByName(st)
    if not both.where("_known is null or not _known").isEmpty():
        raise ValueError("a record is missing from its table of subjects")
    kind = F.when(F.col("study") == "sc", "sc").when(F.col("night") == F.col("placebo_night"), "placebo").otherwise("drug")
    # The cohorts, roles and conditions below.
    named_as = lambda sc, placebo, drug: F.when(kind == "sc", sc).when(kind == "placebo", placebo).otherwise(drug)
    return both.withColumns({
        "participant_id": F.concat(F.upper("study"), F.lpad(F.col("subject").cast("string"), 2, "0")),
        "cohort": named_as("sleep_edf_sc_confirmatory", "sleep_edf_st_placebo", "sleep_edf_st_temazepam"),
        "analysis_role": named_as("primary_confirmation", "threshold_transport", "exploratory_drug_condition"),
        "condition": named_as("spontaneous", "placebo", "temazepam"),
    }).drop("_known", "placebo_night")


def require_counts(rows: DataFrame, want: dict[str, tuple[int, int]], role: str = "analysis_role", subject: str = "participant_id") -> DataFrame:
    """``want``: rows and subjects of each role, a few roles. Any other count raises."""
    got = {r[role]: (r["n"], r["s"]) for r in rows.groupBy(role).agg(F.count("*").alias("n"), F.count_distinct(subject).alias("s")).collect()}
    wrong = {k: got.get(k, (0, 0)) for k in want if got.get(k, (0, 0)) != want[k]}
    if wrong:
        raise ValueError(f"rows and subjects differ from the plan: {wrong}")
    return rows


def build_manifest(records: DataFrame, checksums: DataFrame, subjects: DataFrame) -> DataFrame:
    """Records with the digests of their two files and their subject's row; a record that
    lacks one raises."""
    sums = lambda role: checksums.select(F.col("file").alias(f"{role}_file"), F.col("sha256").alias(f"{role}_sha256"))
    out = records.join(sums("signal"), "signal_file", "left").join(sums("annotation"), "annotation_file", "left").join(subjects, "subject_id", "left_outer")
    if not out.where("signal_sha256 is null or annotation_sha256 is null").isEmpty():
        raise ValueError("a file has no checksum")
    return out.orderBy("cohort", "record_id")

"""Near copies against all pairs: fingerprints within the radius and similar shingle sets."""

import numpy as np
import xxhash
from pyspark.sql import functions as F

from wavetally.llm import simhash

DOCS = "doc_id long, text string, source string"


def plain_components(rows, cut, radius):
    def of(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def vote(s):
        h = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    sets = [of(t) for _, t, *_ in rows]
    fp = [vote(s) for s in sets]
    near = [[j for j, b in enumerate(sets) if a == b or (len(a & b) >= cut * len(a | b) and bin(fp[i] ^ fp[j]).count("1") <= radius)] for i, a in enumerate(sets)]
    label = [i for i, *_ in rows]
    while True:
        new = [min(label[j] for j in js) for js in near]
        if new == label:
            return {i: c for (i, *_), c in zip(rows, label, strict=True)}
        label = new


def copies(seed, groups=40, words=80):
    """Texts with 0 to 4 words changed: similarities around 0.8, far apart in fingerprints."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    line, texts = [word() for _ in range(12)], [None, "", " \n", "one two", "One TWO", "one two three"]
    for g in range(groups):
        base = [word() for _ in range(words)] + (line if g % 2 else [])
        for _ in range(25 if g == 0 else 4):
            t = list(base)
            for k in rng.choice(len(t), rng.integers(0, 5), replace=False):
                t[k] = word()
            texts.append(" ".join(t))
    return [(i, texts[k], "s") for i, k in enumerate(rng.permutation(len(texts)).tolist())]


def test_copies_against_all_pairs(spark):
    rows = copies(0)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.Copies(df).classes().collect()}
    assert got == plain_components(rows, 0.8, 14)
    # The radius loses few of the pairs that are similar enough.
    every = plain_components(rows, 0.8, 64)
    dropped = [i for i, c in every.items() if c != i]
    assert sum(got[i] != i for i in dropped) >= 0.9 * len(dropped)


def test_blocks_and_numbers_of_partitions(spark):
    rows = copies(2, groups=12)
    df = spark.createDataFrame(rows, DOCS)
    nodes = simhash.Copies(df).rows.select("node", "fp", "size").distinct().cache()
    fp = {r["node"]: r["fp"] for r in nodes.collect()}
    near = {(max(a, b), min(a, b)) for a in fp for b in fp if a != b and bin((fp[a] ^ fp[b]) % (1 << 64)).count("1") <= 10}
    for options, block in (((4,), 4096), ((5,), 8), ((6,), 4096), ((8,), 16)):
        pairs = simhash.Probes(nodes, 10, options).pairs(nodes.withColumn("c", F.col("node")), simhash._apart, block)
        assert {tuple(r) for r in pairs.distinct().collect()} == near


def test_first_of_each(spark):
    rows = [*copies(1), (3, "again and again", "a"), (3, "again and again", "a"), (None, "no id here", "b"), (None, "no id here", "c")]
    df = spark.createDataFrame(rows, DOCS).withColumn("node", F.lit("n")).withColumn("uid", F.lit(1.5)).withColumn("text_u", F.lit("x"))
    left = simhash.Copies(df).first_of_each()
    assert left.columns == df.columns
    want = plain_components(rows[:-4], 0.8, 14)
    ids = [r["doc_id"] for r in left.where("text is null or text not in ('again and again', 'no id here')").collect()]
    assert sorted(ids) == sorted(set(want.values()))
    assert left.where("text = 'again and again'").count() == 1 and left.where("text = 'no id here'").count() == 1
    assert simhash.Copies(df.limit(0)).first_of_each().count() == 0


def test_sketches_hold_back_no_similar_pair(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    for _ in range(200):
        a, b = (np.unique(np.concatenate((base[rng.random(300) < 0.9], rng.integers(0, 1 << 63, 20).astype(np.uint64)))) for _ in "ab")
        differ = int(np.bitwise_count((simhash.odd_sketch(a) ^ simhash.odd_sketch(b)).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b)) and (differ - len(np.setxor1d(a, b))) % 2 == 0
    assert not simhash.odd_sketch(np.zeros(0, np.uint64)).any()


def test_group_under_the_cut_gives_few_pairs(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    base, texts = [word() for _ in range(100)], []
    for _ in range(150):
        t = list(base)
        for k in rng.choice(100, 6, replace=False):
            t[k] = word()
        texts.append(" ".join(t))
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    found = []
    plain = simhash.Copies._similar

    class Watched(simhash.Copies):
        def _similar(self, pairs, text_col):
            found.append(pairs.count())
            return plain(self, pairs, text_col)

    got = {r["doc_id"]: r["component_id"] for r in Watched(spark.createDataFrame(rows, DOCS)).classes().collect()}
    assert got == plain_components(rows, 0.8, 14)
    assert found[1] < 1000  # of 11,175 pairs, most of them near in fingerprints


def test_picked_rows_are_not_shuffled(spark):
    from pyspark.sql import functions as F

    from wavetally.llm.simhash import _picked

    rows = spark.range(0, 100_000, 1, 3).select(F.monotonically_increasing_id().alias("uid"), F.col("id"), F.lit("x").alias("text"))
    wanted = rows.where("id % 7 = 3 or id in (0, 32767, 32768, 99999)").select("uid", "id")
    got = _picked(rows, wanted.select("uid").unionByName(wanted.select("uid").limit(5)))
    assert got.columns == rows.columns
    assert sorted(r["id"] for r in got.select("id").collect()) == sorted(r["id"] for r in wanted.select("id").collect())
    assert _picked(rows, wanted.select("uid").limit(0)).count() == 0
    # Only blocks of bits meet in an exchange, also where no table may be broadcast by itself.
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = got._jdf.queryExecution().optimizedPlan().toString() + _picked(rows, wanted.select("uid"))._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan

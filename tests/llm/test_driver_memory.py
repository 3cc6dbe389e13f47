"""What near-dedup leaves with the driver: copies of its tables, joins with empty tables, links of components."""

import numpy as np
from pyspark.cloudpickle import dumps
from pyspark.sql import functions as F

from wavetally.llm import components, simhash

DOCS = "doc_id long, text string, source string"


def groups_of_texts(seed=5, groups=30, words=60):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for k in range(4):
            texts.append(" ".join([*base[:k], word(), *base[k + 1 :]]))
    return [(i, t, "s") for i, t in enumerate(texts)]


def test_tables_of_probes_are_sent_once_and_empty_tables_are_not_joined(spark):
    rng = np.random.default_rng(1)
    fps = spark.createDataFrame([(int(x), k) for k, x in enumerate(rng.integers(-(1 << 62), 1 << 62, 500))], "fp long, node long").cache()
    probes = simhash.Probes(fps, 10)
    assert len(dumps(probes)) < 50_000  # else each query of a slice has its own copy of the tables
    plan = lambda block: probes.pairs(fps, simhash._nearest, block)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(4096) and "Join" in plan(2)


def test_second_components_start_from_the_first(spark, monkeypatch):
    rows, given, plain = groups_of_texts(), [], components.connected_components

    def watched(edges):
        given.append(sorted(tuple(r) for r in edges.where("u != v").collect()))
        return plain(edges)

    monkeypatch.setattr(simhash, "connected_components", watched)
    got = simhash.Copies(spark.createDataFrame(rows, DOCS)).nodes.select("node", "component").collect()
    first, second = given
    to = {}
    for u, v in second:
        to.setdefault(u, set()).add(v)
    # All links of this table are found in the first round, so the second gets one link a node.
    assert len(first) >= len(second) and all(len(x) == 1 for x in to.values())
    assert dict(second) == {r["node"]: r["component"] for r in got if r["node"] != r["component"]}
    assert len({r["component"] for r in got}) == 30

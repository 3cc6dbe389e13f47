"""A toxic document that is copied very often does not unlearn its insults."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetally.llm import toxicity


@pytest.mark.parametrize("near", [False, True])
def test_insults_of_a_copied_document_are_learned(spark, near):
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghiklmnorstu"), rng.integers(3, 9)))
    bad = ["idiot", "moron", "scumbag", "loser"]
    texts = []
    for i in range(500):
        w = [word() for _ in range(40)]
        if i % 5 == 0:
            for k in rng.choice(40, 3, replace=False):
                w[k] = str(rng.choice(bad))
        texts.append(w)
    copied = [word() for _ in range(60)]
    copied[5:50:12] = bad
    for _ in range(1500):
        w = list(copied)
        if near:
            w[int(rng.integers(20, 28))] = word()
        texts.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    toxic = {i for i, _ in rows if i >= 500 or i % 5 == 0}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in toxic)) for i, _ in rows if i < 400 or i >= 500], "doc_id long, toxic int")
    scorer = toxicity.train(df, labels, F.lit(True))
    raw = toxicity.Scorer(scorer.table, scorer.bias)
    assert min(raw.words([b.encode() for b in bad])) > 0 > np.median(raw.words([w.encode() for w in copied if w not in bad]))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.assess(df, scorer, ["doc_id"]).collect()}
    assert all(got[i] == (i in toxic) for i in range(400, 600))

import numpy as np
import pytest

from wavetally.llm import capfilter


def brute(rows, cut):
    links, comp = {}, {}
    good = [(k, r) for k, r in enumerate(rows) if r[1] is not None and r[2] is not None and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    n, label = len(rows), [r[0] for r in rows]
    near = {k: [] for k in range(n)}
    for k, a in good:
        for j, b in good:
            if k != j and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cut:
                    near[k].append(j)
    while True:
        new = [min([label[k], *(label[j] for j in near[k])]) for k in range(n)]
        if new == label:
            break
        label = new
    return sorted((rows[k][0], len(near[k]), label[k], rows[k][0] == label[k]) for k in range(n))


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for c in range(12):
        centre = rng.normal(size=32)
        for _ in range(30 if c == 0 else 4):
            rows.append((len(rows), (centre + rng.normal(size=32) * rng.choice([0.01, 0.1, 0.2])).astype(np.float32).tolist(), int(c % 3)))
    rows += [(len(rows) + k, rng.normal(size=32).astype(np.float32).tolist(), k % 3) for k in range(60)]
    n = len(rows)
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 0), (n + 2, rows[0][1], None), (n + 3, None, 0), (n + 4, [0.0] * 32, 0), (n + 5, [None] + [1.0] * 31, 0), (n + 6, [float("nan")] * 32, 0)]
    # Vectors of another length link among themselves.
    rows += [(n + 7 + k, [1.0, 2.0, 3.0 + k / 100], 0) for k in range(4)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, node string, f int")
    for block in (512, 8):
        got = sorted(tuple(r) for r in capfilter.near_duplicates(df, block=block).collect())
        assert got == brute(rows, 0.98)
    assert capfilter.near_duplicates(df.limit(0)).count() == 0


def test_recall_on_many_vectors_with_a_dense_group(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(2000, 64))
    x = np.vstack([centres[rng.integers(0, 2000, 18_000)] + rng.normal(size=(18_000, 64)) * rng.choice([0.05, 0.12], (18_000, 1)), centres[0] + rng.normal(size=(2500, 64)) * 0.13]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = capfilter.near_duplicates(df).toPandas().sort_values("vec_id")["n_links"].to_numpy()
    want = np.zeros(len(x), np.int64)
    for k in (0, 1):
        y = x[k::2].astype(np.float64)
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        want[k::2] = (y @ y.T >= 0.98).sum(axis=1) - 1
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum() and want.sum() > 1_000_000


def test_list_decoding_finds_every_filter():
    rng = np.random.default_rng(1)
    code = capfilter.ProductCode(12, size=5, tables=1)
    x = rng.normal(size=(40, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turned = x @ code.turn[0]
    want = set()
    for a in range(5**4):
        js = [a // 5 ** (3 - k) % 5 for k in range(4)]
        direction = np.concatenate([code.codes[0][k][j] for k, j in enumerate(js)])
        want |= {(r, a) for r in np.flatnonzero(turned @ direction >= 0.5).tolist()}
    row, f = code.decode(x, 0.5)
    assert set(zip(row.tolist(), f.tolist(), strict=True)) == want
    row, _ = code.decode_all(x, 0.9, 7)
    assert np.bincount(row, minlength=40).min() >= 7


def test_components(spark):
    from wavetally.llm.components import connected_components

    edges = [(i, i + 1) for i in range(0, 60) if i % 10 != 9] + [(5, 5), (3, 2), (100, 7), (None, 4)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: i // 10 * 10 for i in range(60)} | {100: 0}
    hub = spark.createDataFrame([(0, k) for k in range(1, 1200)], "u long, v long")
    assert {r["component"] for r in connected_components(hub).collect()} == {0}


def test_pipeline_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghiklmnorstu"), rng.integers(3, 9)))
    clean = [" ".join(word() for _ in range(60)) for _ in range(30)]
    texts = clean + [clean[0], clean[1] + " extra", None, "too short", "a b c d e " * 30, clean[2] + " password=hunter2222"]
    rows = [(i, t, "en", "s", len(t or ""), "kept") for i, t in enumerate(texts)] + [(3, clean[3], "en", "s", 1, "kept")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0) for i in range(30)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == df.columns, name
    ids = sorted(r["doc_id"] for r in left.collect())
    assert len(ids) == len(set(ids)) and set(range(4, 30)) <= set(ids) and not {30, 32, 33, 34} & set(ids)
    assert not left.where("text like '%hunter%'").count()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() >= len(ids)

"""Phrase mining, suffix sort and periodic runs against plain versions on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavetally.llm import phrases, queries, repetitions, suffixsort

TABLE = "doc_id long, text string, lang string, rid long, n long, phrase string, start long, gram string"


def table(spark, rows):
    """Rows (doc_id, text, lang) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, 7, 7, "x", 7, "x") for i, t, lang in rows], TABLE)


def plain_spans(texts, length):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((sum(g and (x == 0 or not gone[x - 1]) for x, g in enumerate(gone)), kept))
    return out


def noise(rng, n, letters="abcdefgh äß\n"):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.fixture(scope="module")
def repeats():
    rng = random.Random(5)
    passage, other = noise(rng, 300), noise(rng, 230)
    texts = [None, "", "short", "x" * 199, "y" * 201, "z" * 700, "ab" * 300, noise(rng, 500)]
    texts += [noise(rng, 90) + passage + noise(rng, 120), passage, passage[:210] + "!" + passage[211:], noise(rng, 40) + passage[30:260] + other, other[:199], other + other]
    long = noise(rng, 9_000)
    texts += [long, long[:4_000] + "?" + long[4_000:], noise(rng, 300)] + [noise(rng, 60) + passage[50:275] + noise(rng, 60) for _ in range(40)]
    texts += [texts[8]] * 3
    return [(i if i != 9 else None, t, "en") for i, t in enumerate(texts)] + [(3, "x" * 199, "en")]


@pytest.mark.parametrize("length", [200, 32])
def test_repeated_strings_go(spark, repeats, length):
    got = suffixsort.remove_repeats(table(spark, repeats), length).collect()
    texts = [(t or "").encode() for _, t, _ in repeats]
    want = sorted((str(i), len(t), n, k) for (i, _, _), t, (n, k) in zip(repeats, texts, plain_spans(texts, length), strict=True))
    assert sorted((str(r["doc_id"]), r["n_bytes"], len(r["start"]), bytes(r["kept"])) for r in got) == want


def test_repeated_strings_against_sql(spark, repeats, tmp_path):
    table(spark, repeats).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.op12_suffix_dedup(spark, str(tmp_path))
    cur = con.execute(queries.REPEATS_SQL)
    assert got.columns == [c[0] for c in cur.description]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, cur.fetchall()))


def test_long_texts_come_in_slices(spark, monkeypatch):
    rng = random.Random(6)
    a = noise(rng, 5_000)
    rows = [(1, a + noise(rng, 400) + a[:2_500], "en"), (2, a[1_000:3_000], "en"), (3, "q" * 6_000, "en"), (4, noise(rng, 3_000), "en")]
    texts = [t.encode() for _, t, _ in rows]
    monkeypatch.setattr(suffixsort, "BLOCK", 1 << 11)
    parts = [x for x in suffixsort.slices(texts, 200)]
    assert len(parts) > 8 and max(len(p[0]) for p in parts) <= 1 << 11
    covered = Counter((int(n), int(at) + s) for data, number, first, place in parts for n, f, e, at in zip(number, first, [*first[1:], len(data)], place, strict=True) for s in range(e - f - 199))
    assert covered == Counter((i, s) for i, t in enumerate(texts) for s in range(len(t) - 199))
    monkeypatch.undo()
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffixsort.remove_repeats(table(spark, rows)).collect()}
    assert got == {i: k for (i, _, _), (_, k) in zip(rows, plain_spans(texts, 200), strict=True)}


def test_least_keys():
    x = np.random.default_rng(1).integers(0, 1 << 60, 1_000).astype(np.uint64)
    assert (suffixsort._least(x, 77) == np.array([x[i : i + 77].min() for i in range(1_000 - 76)])).all()


def test_stretches_that_touch_become_one():
    a, e = suffixsort.merged(np.array([10, 0, 20, 40, 3]), np.array([20, 5, 30, 41, 4]))
    assert list(zip(a.tolist(), e.tolist(), strict=True)) == [(0, 5), (10, 30), (40, 41)]


def plain_runs(x):
    out = []
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i < len(x) - q:
            j = i
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            part = x[i : j + q]
            if j > i and len(part) >= max(6, 4 * q) and not any(part[d:] == part[: len(part) - d] for d in range(1, q)):
                out.append((i, len(part), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 9)), max_size=8))
def test_runs_are_those_of_the_plain_search(parts):
    x = [v for word, times in parts for v in word * times]
    text = b" ".join(b"w%d" % v for v in x)
    want = plain_runs(x)
    if x:
        assert list(zip(*(v.tolist() for v in repetitions.runs_of(np.array(x))), strict=True)) == want
    for n, start, length, period, kept in repetitions._batch([text, b"", text], [b"1", b"2", b"3"], False)[::2]:
        assert n == len(x) and list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == want
        gone = {i for s, m, q in want for i in range(s + q, s + m)}
        assert kept == b" ".join(b"w%d" % v for i, v in enumerate(x) if i not in gone)


def test_blocks_and_vocabulary():
    names = repetitions.Names(np.array([ord(c) for c in "abaabaabaabx"]))
    assert repetitions.lz_blocks(names).tolist() == [0, 1, 2, 3, 11, 12]
    start, half = repetitions.vocabulary(names, *repetitions.covering_squares(names, repetitions.lz_blocks(names)))
    assert sorted("abaabaabaabx"[s : s + 2 * h] for s, h in zip(start, half, strict=True)) == ["aa", "aabaab", "abaaba", "baabaa"]


def test_periodic_runs_of_documents(spark, tmp_path):
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice(["a", "b", "c", "dé"]) for _ in range(n))
    texts = [None, "", "\t\n ", "a a a a a", "a a a a a a", "a b\x0ba b a\nb a  b x"] + [words(rng.randrange(1, 200)) for _ in range(60)] + [words(3_000), "long " * 20_000]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, "b b b b b b b", "en"), (4, "a a a a a a", "en")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r["doc_id"]), tuple(r)[1:]) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect())
    want = []
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h, n = zlib.crc32(("" if i is None else str(i)).encode()), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        runs = plain_runs(w) if n < 10_000 else [(0, n, 1)]
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        gone = {j for s, m, q in runs for j in range(s + q, s + m)}
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((str(i), (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha(lines), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))))
    assert got == sorted(want)


def corpus(rng, n):
    words = ["New", "york", "the", "of", "in", "a", "b", "Äpfel", "x_y"]
    piece = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))
    return [(i, rng.choice(".,;\n:!? \t").join(piece() for _ in range(rng.randrange(1, 6))), rng.choice(["en", "en", "de", None, "und"])) for i in range(n)]


def test_phrases_against_sql(spark, tmp_path):
    rng = random.Random(8)
    rows = corpus(rng, 5_000) + [(1, None, "en"), (None, "new york new york", None), (2, "", "fr"), (2, "lone words", "fr")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(queries.PHRASES_SQL).fetchall())
    got = sorted(map(tuple, queries.op11_phrases(spark, str(tmp_path)).collect()))
    assert len(want) > 200 and len({r[0] for r in want}) == 3
    assert got == want
    # A bitmap so small that nearly all bits are set lets foreign phrases pass; the counts stay right.
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, phrases.mine(docs, log_bits=6).collect())) == want
    assert phrases.mine(docs, top=3).count() == 9  # three languages


def test_phrases_across_slices_of_a_long_text(spark, monkeypatch):
    rng = random.Random(9)
    text = " ".join(rng.choice(["p", "q", "r.", "ss"]) for _ in range(3_000))
    words = phrases.words_of(text.encode())
    for most in (1, 40, 1_000):
        joined = []
        for part, goes_on in phrases.parts([b"one two", text.encode(), b"three"], most):
            joined += ([] if goes_on or not joined else [b"."]) + phrases.words_of(part)
        assert joined == [b"one", b"two", b".", *words, b".", b"three"]


def test_products_pass_64_bits(spark):
    big = 4_000_000_000_000
    frequent = spark.createDataFrame([("en", None, big, 1), ("en", "a", big - 5, 1), ("en", "b", big - 7, 1), ("en", "a b", big - 9, 2)], "lang string, phrase string, n long, k int")
    row = phrases.scored(frequent).first()
    assert row["score"] == 1000 * (big - 9) * big // ((big - 5) * (big - 7))


def test_contained_phrases_go(spark):
    rows = [("en", "a b", 2, 100), ("en", "a b c", 3, 100), ("en", "b c", 2, 120), ("de", "a b", 2, 100), ("en", "x a b c", 4, 99)]
    got = phrases.uncovered(spark.createDataFrame(rows, "lang string, phrase string, k int, a long"))
    assert sorted((r["lang"], r["phrase"]) for r in got.collect()) == [("de", "a b"), ("en", "a b c"), ("en", "b c"), ("en", "x a b c")]


def test_empty_tables(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    for q in (queries.op11_phrases, queries.op12_suffix_dedup, queries.op13_periodic_runs):
        assert q(spark, str(tmp_path)).collect() == []

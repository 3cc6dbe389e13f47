"""The thin queries over the operators, one per contract, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


def tokenizer_path(name: str) -> str:
    """Vocabulary files are named, never copied; every worker opens its own."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import fingerprint_hex, near_duplicates

    out = near_duplicates(read(spark, sf_dir, "documents"), shingle=4, radius=4)
    return out.select("doc_id", fingerprint_hex().alias("fingerprint"), "component_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import assess

    return assess(read(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), limit=2048, end_id=0)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest_columns, learn, scan

    docs = read(spark, sf_dir, "documents")
    found = scan(docs, ["doc_id"], learn(docs))
    return found.select("doc_id", *[c.alias(k) for k, c in digest_columns().items()])


def op5_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenautomaton import roundtrip

    return roundtrip(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), ["doc_id"])


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .capfilter import near_duplicates

    return near_duplicates(read(spark, sf_dir, "embeddings"), cut=0.98)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    out = shard(read(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import held_out
    from .toxicity import assess, train

    docs = read(spark, sf_dir, "documents")
    scorer = train(docs, read(spark, sf_dir, "labels"), ~held_out())
    return assess(docs, scorer, ["doc_id", held_out().alias("held_out")])


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rans import read_files, store

    return read_files(spark, store(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import held_out
    from .langid import identify, learn_profiles

    docs = read(spark, sf_dir, "documents")
    return identify(docs, learn_profiles(docs, ~held_out()), ["doc_id", held_out().alias("held_out")])


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import mine

    return mine(read(spark, sf_dir, "documents"), top=2000)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixsort import remove_repeats

    out = remove_repeats(read(spark, sf_dir, "documents"), length=200)
    return out.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("start").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repetitions import collapse, digest_columns

    out = collapse(read(spark, sf_dir, "documents"), altered=True)
    return out.select("doc_id", *[c.alias(k) for k, c in digest_columns().items()])


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_quality_rules": op2_quality_rules,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_secret_scans": op4_secret_scans,
    "op5_bpe_roundtrip": op5_bpe_roundtrip,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_sharding": op7_sharding,
    "op8_toxicity": op8_toxicity,
    "op9_token_files": op9_token_files,
    "op10_language_id": op10_language_id,
    "op11_phrases": op11_phrases,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}
#: Phrases counted without pruning, all cuts, products in 128 bits.
PHRASES_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
 p AS (SELECT lang, unnest(string_split_regex(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
 g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) kk(k) WHERE len(w) >= k),
 f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
 total AS (SELECT lang, sum(n)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
 c AS (SELECT lang, phrase, k, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 100),
 cuts AS (SELECT c.*, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS rest FROM c, range(1, 5) jj(j) WHERE j < k),
 scored AS (SELECT u.lang, u.phrase, u.k, u.w, u.a, l.n AS l, r.n AS r, total.n::BIGINT AS n, ((1000::HUGEINT * u.a * total.n) // (l.n::HUGEINT * r.n))::BIGINT AS score, j
  FROM cuts u JOIN f l ON l.lang = u.lang AND l.phrase = u.head JOIN f r ON r.lang = u.lang AND r.phrase = u.rest JOIN total ON total.lang = u.lang
  QUALIFY row_number() OVER (PARTITION BY u.lang, u.phrase ORDER BY score, j) = 1),
 inner_phrases AS (SELECT s.lang, array_to_string(s.w[i:i + m - 1], ' ') AS phrase, max(s.a) AS a FROM scored s, range(1, 5) ii(i), range(2, 5) mm(m) WHERE m < s.k AND i + m - 1 <= s.k GROUP BY ALL),
 kept AS (SELECT s.* FROM scored s LEFT JOIN inner_phrases o ON o.lang = s.lang AND o.phrase = s.phrase WHERE o.a IS NULL OR 100 * o.a < 100 * s.a)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept) WHERE rank <= 2000"""

#: Windows of hex digits, two a byte, cut from parts of 455 bytes; runs of covered bytes; the rest.
REPEATS_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
 b AS (SELECT r, b, substr(x, (512 * b + 1)::BIGINT, 910) AS part FROM (SELECT r, x, unnest(range(0, length(x) // 512 + 1)) AS b FROM t WHERE length(x) >= 400)),
 w AS (SELECT r, 256 * b + j AS i, substr(part, (2 * j + 1)::BIGINT, 400) AS s FROM (SELECT r, b, part, unnest(range(0, least(256, length(part) // 2 - 199))) AS j FROM b)),
 k AS (SELECT r, i, md5_number(s) AS h FROM w),
 d AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
 c AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM k SEMI JOIN d USING (h)),
 g AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM c),
 spans AS (SELECT r, run, min(i) AS a, max(i) + 200 AS e FROM g GROUP BY r, run),
 cut AS (SELECT r, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS last FROM spans),
 kept AS (SELECT t.r, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, (2 * last + 1)::BIGINT, (2 * (a - last))::BIGINT), '' ORDER BY a) || any_value(substr(x, (2 * m + 1)::BIGINT)) AS rest
  FROM t JOIN cut ON cut.r = t.r JOIN (SELECT r, max(e) AS m FROM spans GROUP BY r) o ON o.r = t.r GROUP BY t.r)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, x))) AS kept_sha256 FROM t LEFT JOIN kept ON kept.r = t.r"""

ORACLE_SQL: dict[str, str] = {"op11_phrases": PHRASES_SQL, "op12_suffix_dedup": REPEATS_SQL}

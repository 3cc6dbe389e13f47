"""Training-text pipeline: quality rules, toxicity, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``. Between stages the rows are a Parquet table in the shared folder.
Columns of clashing names, null ids and repeated rows pass through: a document is known by
its id and a hash of its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetally.llm import packing, quality, secrets, simhash, toxicity
from wavetally.llm.common import drop_written, held_out, read, written
from wavetally.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text", "lang", "source")
    return quality.assess(packed, keep=("_doc",)).where("kept").select("_doc.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on what is left of them, calls toxic go."""
    return toxicity.reject(docs, toxicity.train(docs, read(spark, sf_dir, "labels"), ~held_out()))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the least id: pairs of SimHash
    fingerprints within 14 bits whose sets of five-word shingles have a Jaccard similarity of
    0.8 or more. Null texts count as empty; of repeated rows one stays; an empty table gives
    an empty table."""
    return simhash.Copies(docs, shingle=5, cut=0.8, radius=14).first_of_each()


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that the scan, with formats learned from what is left, finds is replaced in its
    text. Null texts stay null; an empty table gives an empty table."""
    return secrets.redact(docs, secrets.learn(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, with its sequence and place."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), limit=2048, end_id=0)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", drop_toxic),
    ("simhash near-dedup", one_of_each_group),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: The toxicity model and the packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        then = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if name != STAGES[0][0]:
            drop_written(docs)
        docs = then
    return docs

"""From raw documents to a training mixture: five stages, each a function (spark, docs, sf_dir) -> DataFrame.

Every stage but the last returns the columns of documents; each works on all that the one before it kept. run() writes
each stage's result as Parquet in the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelbrick.llm import decontam, minhash, mixing, pii, quality
from voxelbrick.llm.common import stored, table

#: Documents scored below it are rejected.
REJECT_BELOW = 0.5


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It learns from the labelled documents outside the held-out fold."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, REJECT_BELOW, keep_columns=True).where("predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near-duplicates: five-word shingles, similarity 0.8.

    Of rows with one doc_id the first by text (null first), then by a hash of the row, stays; rows without a doc_id stay."""
    kept = minhash.near_duplicates(docs, k=5, percent=80).where("kept").select("doc_id").distinct()
    first = Window.partitionBy("doc_id").orderBy("text", F.xxhash64(F.to_json(F.struct(*docs.columns))))
    named = docs.join(kept, "doc_id", "left_semi").withColumn("_place", F.row_number().over(first)).where("_place = 1")
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by <KIND>, n_chars counted anew."""
    found = pii.find_pii(docs)
    made = {"text": F.col("pii_redacted"), "n_chars": F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("pii_redacted")).cast("long")}
    return found.select(*[made[c].alias(c) if c in made else F.col(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, with size, source_size, target, copies and taken."""
    return mixing.mixture(docs)


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("pii", redact_pii),
    ("mixing", mix_sources),
]

#: SQL can't express the classifier, the rounding or the sketch.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to a mixed training set, stage by stage.

Every stage but the last returns the columns of documents; what it decides holds for all that
follow.  ``run`` writes each stage's result and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import decontaminate, langid, line_dedup, minhash, mixing
from quarrylight.llm.shared import Scratch, clear, jobs
from quarrylight.llm.tables import documents, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model rejects go."""
    model = langid.learn(docs, langid.bucket_of(F.col("doc_id"), 4) != 2)
    return langid.accepted(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on ten or more sources go but for their first place; so do documents of which nothing is left."""
    removed = "_" * (1 + max(map(len, docs.columns)))  # a name that no column has
    clean = line_dedup.cleaned(docs, removed=removed)
    clean = clean.where((F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    columns = [F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return clean.select(*columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return minhash.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed training set: passages of documents with their texts, in the order of the schedule's slots."""
    return mixing.mixture(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing_stage),
]

#: Language identification is trained by gradient descent, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what the stages before the last wrote is removed."""
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        mark = jobs()
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        clear(since=mark)
        scratch.keep_only(name)
    return docs

"""The fixture tables, and the domain's objects as views of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_line_title

NO_TITLE = "(без названия)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(frame: DataFrame) -> DataFrame:
    """The frame in at least as many partitions as there are cores, or 32.

    A table of one small file is one task.  Where a scan gives so few tasks its rows are
    dealt out, for work that costs more per row than a shuffle does; scans of more tasks are left alone.
    """
    cores = min(32, frame.sparkSession.sparkContext.defaultParallelism)
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: id, title, snippet, tags, wing, room, content."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), first_line_title(F.col("text"), NO_TITLE).alias("title"), F.left("text", F.lit(200)).alias("snippet"), F.array("lang", "source").alias("tags"), F.col("source").alias("wing"), F.col("lang").alias("room"), F.col("text").alias("content"))


#: The same rule in SQL.
TITLE_SQL = """CASE WHEN line = '' THEN '(без названия)' WHEN length(line) > 80 THEN left(line, 80) || '...' ELSE line END"""
BARE = r"""regexp_replace({0}, '^[\s\x1c-\x1f\x85\xa0\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+|[\s\x0b\x1c-\x1f\x85\xa0\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '', 'g')"""


def bare(expression: str) -> str:
    """SQL for the text stripped of all white space."""
    return BARE.format(expression)


NOTES_SQL = f"""notes AS (
  SELECT id, {TITLE_SQL} AS title, left(text, 200) AS snippet, [lang, source] AS tags, source AS wing, lang AS room, text AS content
  FROM (SELECT doc_id AS id, text, lang, source, {bare("split_part(" + bare("coalesce(text, '')") + ", chr(10), 1)")} AS line FROM documents))"""

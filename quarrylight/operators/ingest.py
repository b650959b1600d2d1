"""From texts to numbered chunks, with gates and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunks, strip

#: Folders that are collections by themselves; files of others go to the last one.
WINGS = ("books", "articles", "drafts", "misc")
OTHER = "misc"


def wing_of(relative_path: Column, wings: tuple[str, ...] = WINGS) -> Column:
    """The first folder of a path if it is a known one and not the file itself."""
    parts = F.split(relative_path, "/")
    return F.when((F.size(parts) > 1) & parts[0].isin(*wings), parts[0]).otherwise(OTHER)


def gated(texts: DataFrame, text: str = "text", least: int = 50) -> DataFrame:
    """Adds ``error``, null for texts with at least so many characters once stripped."""
    size = F.length(strip(F.coalesce(text, F.lit(""))))
    return texts.withColumn("error", F.when(size < least, F.concat(F.lit("text too short: "), size.cast("string"))))


def numbered_chunks(texts: DataFrame, *, key: str, text: str, base: str, target: int = 2000, overlap: int = 200) -> DataFrame:
    """A drawer for each chunk: id (stable, from key and place), content, room, title, tag, chunk_index, n_chunks."""
    pieces = texts.select(key, F.col(base).alias("base"), chunks(F.col(text), target, overlap).alias("chunks"))
    rows = pieces.select(key, "base", F.size("chunks").alias("n_chunks"), F.posexplode("chunks").alias("chunk_index", "content"))
    place = F.concat((F.col("chunk_index") + 1).cast("string"), F.lit("/"), F.col("n_chunks").cast("string"))
    title = F.when(F.col("n_chunks") > 1, F.concat("base", F.lit(" (часть "), place, F.lit(")"))).otherwise(F.col("base"))
    tag = F.concat(F.lit("chunk_"), F.replace(place, F.lit("/"), F.lit("_of_")))
    return rows.select(F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.col("chunk_index").cast("string")), 256).alias("id"), F.col(key), "content", F.left("base", F.lit(60)).alias("room"), title.alias("title"), tag.alias("tag"), "chunk_index", "n_chunks")


def outcomes(attempts: DataFrame, key: str, ok: Column, warn_under: float = 0.8) -> DataFrame:
    """Per document: n, n_ok and outcome (failed without any success, warning under the ratio, else processed)."""
    n = attempts.groupBy(key).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"))
    return n.withColumn("outcome", F.when(F.col("n_ok") == 0, "failed").when(F.col("n_ok") / F.col("n") < warn_under, "warning").otherwise("processed"))

"""Ingestion of dropped files in batches that count once.

A batch parses its files one time, writes their texts (the markdown copies), the chunks with what became of each, and the files'
outcomes, each to a folder of the batch's own, and last a row of the ledger with the batch's counts.  Only batches
in the ledger are read: a batch that broke off is written over when it is run again, one that is in the ledger changes nothing when it is.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import gated, numbered_chunks, wing_of
from ..sources.files import PARSERS, Parser, extension, parsed

TEXTS = "relative_path string, wing string, stem string, text string, error string"
DRAWERS = "id string, relative_path string, content string, room string, title string, tag string, chunk_index int, n_chunks int, wing string, added_by string, stored boolean"
OUTCOMES = "relative_path string, wing string, outcome string, error string, n_chunks long, n_stored long, archived_as string"
LEDGER = "files long, processed long, warning long, failed long, stored long, at timestamp"
NONE_STORED = "no chunk was stored"
WARN_UNDER = 0.8


class Store:
    """The tables below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, table: str, batch: int | None = None) -> str:
        return f"{self.folder}/{table}" + ("" if batch is None else f"/batch={batch}")

    def _there(self, path: str) -> bool:
        """Whether a folder of Spark's writers is there and complete."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def done(self, batch: int) -> bool:
        return self._there(self._path("ledger", batch))

    def put(self, frame: DataFrame, table: str, batch: int) -> DataFrame:
        """Writes a batch's rows over what a broken run may have left, and reads them."""
        frame.write.mode("overwrite").parquet(self._path(table, batch))
        return self.spark.read.schema(frame.schema).parquet(self._path(table, batch))

    def ledger(self) -> DataFrame:
        """A row for each batch that counts."""
        return self._read("ledger", LEDGER)

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, batch long").parquet(self._path(table))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], f"{schema}, batch long")  # nothing has been written yet

    def _counted(self, table: str, schema: str) -> DataFrame:
        return self._read(table, schema).join(self.ledger().select("batch"), "batch", "left_semi")

    def markdown(self) -> DataFrame:
        """The texts that were read, by collection and path."""
        return self._counted("texts", TEXTS).where(F.col("error").isNull()).select("wing", "relative_path", "text", "batch")

    def drawers(self) -> DataFrame:
        return self._counted("drawers", DRAWERS).where("stored").drop("stored")

    def outcomes(self) -> DataFrame:
        return self._counted("outcomes", OUTCOMES)

    def failures(self) -> DataFrame:
        return self.outcomes().where(F.col("outcome") == "failed").select("relative_path", "wing", "error", "archived_as", "batch")


def read_texts(files: DataFrame, parsers: dict[str, Parser] = PARSERS, least: int = 50) -> DataFrame:
    """Files (path, relative_path, content) as texts with their collection; parse errors stay, texts that are too short get one."""
    short = gated(parsed(files, parsers).withColumnRenamed("error", "__parse"), "text", least)
    return short.select("relative_path", wing_of(F.col("relative_path")).alias("wing"), F.regexp_extract("relative_path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"), "text", F.coalesce("__parse", "error").alias("error"))


def chunked(texts: DataFrame, target: int = 2000, overlap: int = 200) -> DataFrame:
    """The drawers of texts without an error."""
    drawers = numbered_chunks(texts.where(F.col("error").isNull()), key="relative_path", text="text", base="stem", target=target, overlap=overlap)
    return drawers.withColumns({"wing": wing_of(F.col("relative_path")), "added_by": F.lit("ingest")})


def _archived(outcomes: DataFrame, before: DataFrame, at: datetime) -> DataFrame:
    """Adds ``archived_as``: processed or failed, collection and file name; a name that is taken gets the time, and if that is taken a number too."""
    root = F.when(F.col("outcome") == "failed", "failed").otherwise("processed")
    name = F.regexp_extract("relative_path", r"([^/]*)$", 1)
    keys = {"__root": root, "__name": name}
    taken = before.withColumns(keys).groupBy("__root", "wing", "__name").agg(F.count("*").alias("__taken"))
    rows = outcomes.withColumns(keys).join(taken, ["__root", "wing", "__name"], "left")
    place = F.row_number().over(Window.partitionBy("__root", "wing", "__name").orderBy("relative_path"))
    late = place - F.when(F.col("__taken").isNull(), 1).otherwise(0)  # how many of this batch had to give way up to here
    dot = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 2)
    stem = F.left(name, F.length(name) - F.length(dot))
    marked = F.concat(stem, F.lit(f"_{at:%Y%m%d_%H%M%S}"), F.when(late > 1, F.concat(F.lit("_"), late.cast("string"))).otherwise(""), dot)
    return rows.withColumn("archived_as", F.concat_ws("/", "__root", "wing", F.when(late == 0, name).otherwise(marked)))


def ingest_batch(store: Store, files: DataFrame, batch: int, *, at: datetime, accepts: Column | None = None, parsers: dict[str, Parser] = PARSERS, least: int = 50, target: int = 2000, overlap: int = 200) -> bool:
    """Takes in a batch of files; False if the ledger has it already.

    A file fails if it can't be read, its text is too short or none of its chunks is stored; under 80 % of them stored
    it is processed with a warning.  ``accepts`` tells of a drawer whether the store takes it (all, if not given).  Files
    that repeat a path are files each by itself, but share their drawers' ids; a null content is an error of its row.
    """
    if store.done(batch):
        return False
    texts = store.put(read_texts(files, parsers, least), "texts", batch)
    stored = F.coalesce(accepts, F.lit(False)) if accepts is not None else F.lit(True)
    drawers = store.put(chunked(texts, target, overlap).withColumn("stored", stored), "drawers", batch)
    counts = drawers.groupBy("relative_path").agg(F.count("*").alias("n_chunks"), F.count_if("stored").alias("n_stored"))
    files_ = texts.join(counts, "relative_path", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_chunks", "n_stored")})
    error = F.coalesce("error", F.when(F.col("n_stored") == 0, NONE_STORED))
    outcome = F.when(error.isNotNull(), "failed").when(F.col("n_stored") < WARN_UNDER * F.col("n_chunks"), "warning").otherwise("processed")
    outcomes = _archived(files_.select("relative_path", "wing", outcome.alias("outcome"), error.alias("error"), "n_chunks", "n_stored"), store.outcomes(), at)
    seen = Observation(f"batch {batch}")
    kinds = ("processed", "warning", "failed")
    watched = outcomes.select("relative_path", "wing", "outcome", "error", "n_chunks", "n_stored", "archived_as").observe(
        seen, F.count("*").alias("files"), *(F.count_if(F.col("outcome") == k).alias(k) for k in kinds), F.coalesce(F.sum("n_stored"), F.lit(0)).alias("stored"))
    store.put(watched, "outcomes", batch)
    found = seen.get
    row = [found["files"], *(found[k] for k in kinds), found["stored"], at]
    store.put(store.spark.createDataFrame([row], LEDGER).coalesce(1), "ledger", batch)
    return True


def ingest_stream(spark: SparkSession, inbox: str, out: str, checkpoint: str, *, archive: str | None = None, once: bool = False, every: str = "30 seconds") -> StreamingQuery:
    """Reads files as they are dropped and takes each micro-batch in once; ``Store(spark, out)`` reads what came of it.

    The checkpoint, not a file's place, tells what was handled; ``archive`` moves handled files there.
    """
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true")
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    files = reader.load(inbox).where(extension(F.col("path")).isin(*PARSERS))
    root = inbox.rstrip("/").split(":", 1)[-1] + "/"
    relative = F.substring(F.col("path"), F.instr("path", root) + len(root), F.length("path"))
    files = files.withColumn("relative_path", relative).select("path", "relative_path", "content")
    store = Store(spark, out)

    def take(batch: DataFrame, number: int) -> None:
        ingest_batch(store, batch, number, at=datetime.now())

    writer = files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()

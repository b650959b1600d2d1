"""A keyed table kept as a log of numbered batches, with buckets that are compacted.

Rows of a batch put a whole row, patch some columns of one, or delete one.  A batch counts once its row of the ledger is
written: one that broke off is written over when it is appended again, one that is in the ledger changes nothing.
Compaction folds the buckets that the log has touched into new base files and then writes the list of what
file a bucket is read from; the base of other buckets stays as it is.  Nothing that a reader may have open is changed.

A batch is written as it comes, without a shuffle.  Folding shuffles the rows of keys that have several, and of the others only a hash of the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PUT, PATCH, DELETE = "put", "patch", "delete"
#: A filter of keys has at most 2 to this power of bits (16 MB), which are sent to all tasks.
MOST_BITS = 27
#: A compaction whose tasks would write fewer rows into a file of a bucket brings a bucket's rows together first.
ROWS_PER_FILE = 2**17


def patched(log: DataFrame, key: str, order: Sequence[str | Column], columns: Sequence[str], *, op: str = "op", given: str = "given") -> DataFrame:
    """The table that a log of puts, patches and deletes leaves: key and columns.

    A put gives all columns, a patch those named in ``given`` (if that is null, those that aren't null in it), and each column has the value
    that was given last.  A key is there if its last put or delete is a put, so patches of what isn't there do nothing.
    Rows of another or no kind are passed over; null is a key like others.  Rows of a key in the same place of the order are taken deletes first, then patches, then puts,
    and among equals by their hash.  One aggregation with partial results, whatever a key's history.
    """
    at = F.struct(*order, F.col(op), F.xxhash64(key, *columns, given))
    whole = F.col(op).isin(PUT, DELETE)

    def last(c: str) -> Column:
        patches = (F.col(op) == PATCH) & F.when(F.col(given).isNull(), F.col(c).isNotNull()).otherwise(F.array_contains(given, F.lit(c)))
        return F.max_by(c, F.when((F.col(op) == PUT) | patches, at)).alias(c)

    folded = log.groupBy(key).agg(F.max_by(op, F.when(whole, at)).alias("__state"), *map(last, columns))
    return folded.where(F.col("__state") == PUT).drop("__state")


class LogStore:
    """The table below a folder that all executors reach; ``columns`` is its schema without the key, as DDL."""

    def __init__(self, spark: SparkSession, folder: str, key: str, key_type: str, columns: str, buckets: int = 64):
        self.spark, self.folder, self.key, self.key_type, self.buckets = spark, folder.rstrip("/"), key, key_type, buckets
        empty = spark.createDataFrame([], f"{key} {key_type}, {columns}")
        self.columns, self._base = empty.columns[1:], empty.schema.add("bucket", "integer").add("upto", "long")
        self._log = spark.createDataFrame([], f"{key} {key_type}, {columns}, op string, given array<string>, seq long, batch long, bucket int").schema

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _numbers(self, table: str, name: str) -> list[int]:
        """Numbers of the complete folders of a table; one for each batch or compaction that there is."""
        fs, at = self._fs(f"{self.folder}/{table}/{name}=*/_SUCCESS")
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in fs.globStatus(at) or [])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.write.mode("overwrite").partitionBy(*(c for c in rows.columns if c == "bucket")).parquet(path)

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Takes in rows (key, columns, op, seq, and given if it likes); False if the batch is there already.

        Batches may come in any order, but none before one that has been compacted.
        """
        if batch in self._numbers("ledger", "batch"):
            return False
        if batch <= max(self._numbers("manifest", "upto"), default=batch - 1):
            raise ValueError(f"batch {batch} comes after a compaction of later ones")
        if "given" not in rows.columns:
            rows = rows.withColumn("given", F.lit(None).cast("array<string>"))
        typed = (F.col(f.name).cast(f.dataType).alias(f.name) for f in self._log if f.name not in ("batch", "bucket"))
        self._write(rows.select(*typed), f"{self.folder}/log/batch={batch}")
        self.spark.range(1).select(F.lit(batch).alias("number")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={batch}")
        return True

    def _manifest(self) -> tuple[int | None, dict[int, int]]:
        """The last compaction, and for each bucket the compaction that wrote its base: at most as many entries as there are buckets."""
        upto = max(self._numbers("manifest", "upto"), default=None)
        if upto is None:
            return None, {}
        return upto, {r["bucket"]: r["base"] for r in self.spark.read.schema("bucket int, base long").parquet(f"{self.folder}/manifest/upto={upto}").collect()}

    def _history(self, upto: int | None, bases: dict[int, int], batches: list[int]) -> DataFrame:
        """Base rows as puts, and the rows of the batches."""
        empty = self.spark.createDataFrame([], self._log)
        base, log = empty, empty
        if bases:
            paths = [f"{self.folder}/base/upto={n}/bucket={b}" for b, n in sorted(bases.items())]
            found = self.spark.read.schema(self._base).option("basePath", f"{self.folder}/base").parquet(*paths)
            base = found.select(self.key, *self.columns, F.lit(PUT).alias("op"), F.lit(None).cast("array<string>").alias("given"), F.lit(0).cast("long").alias("seq"), F.lit(upto).cast("long").alias("batch"), "bucket")
        if batches:
            written = StructType([f for f in self._log if f.name != "bucket"])
            log = self.spark.read.schema(written).option("basePath", f"{self.folder}/log").parquet(*(f"{self.folder}/log/batch={n}" for n in batches)).withColumn("bucket", self._bucket()).select(*self._log.names)
        return base.unionByName(log)

    def _folded(self, history: DataFrame, rows: int) -> DataFrame:
        """The table that a history of so many rows leaves.

        A key's only row is the table's row if it is a put, and none otherwise, so it stays where it is.  Keys with several rows are found by counting
        hashes and set bits of a filter; all rows that it lets through are folded by key.  Other keys' rows among them come out as they
        would have, so the filter's size decides how much is shuffled, not what comes out.
        """
        bits = 2 ** min(MOST_BITS, max(15, (8 * rows).bit_length()))
        place = lambda of: F.pmod(of, F.lit(bits)) + 1
        several = history.groupBy(F.xxhash64(self.key).alias("__hash")).agg(F.count("*").alias("__n")).where("__n > 1").select(place(F.col("__hash")).alias("__place"))
        marks = several.groupBy(F.bitmap_bucket_number("__place").alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__place")).alias("__bits"))
        own = place(F.xxhash64(self.key))
        at = F.bitmap_bit_position(own)
        byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        marked = history.withColumn("__part", F.bitmap_bucket_number(own)).join(F.broadcast(marks), "__part", "left")  # at most 4096 rows of 4 kB
        met = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
        alone = marked.where(~met & (F.col("op") == PUT)).select(self.key, *self.columns)
        return alone.unionByName(patched(marked.where(met), self.key, ["batch", "seq"], self.columns))

    def read(self) -> DataFrame:
        """The table as of the last batch."""
        upto, bases = self._manifest()
        later = [n for n in self._numbers("ledger", "batch") if upto is None or n > upto]
        history = self._history(upto, bases, later)
        return self._folded(history, history.count())

    def compact(self) -> int:
        """Folds all batches since the last compaction into the base of the buckets that they touch; how many buckets those are."""
        upto, bases = self._manifest()
        later = [n for n in self._numbers("ledger", "batch") if upto is None or n > upto]
        if not later:
            return 0
        log = self._history(upto, {}, later)
        touched = sorted(r["bucket"] for r in log.select("bucket").distinct().collect())  # at most as many as there are buckets
        history = self._history(upto, {b: n for b, n in bases.items() if b in touched}, later)
        rows = history.count()
        target = f"{self.folder}/base/upto={later[-1]}"
        folded = self._folded(history, rows).withColumn("bucket", self._bucket())
        small = rows < ROWS_PER_FILE * self.buckets * history.rdd.getNumPartitions()
        self._write(folded.hint("rebalance", "bucket") if small else folded, target)
        fs, at = self._fs(f"{target}/bucket=*")
        left = {int(s.getPath().getName().split("=")[1]) for s in fs.globStatus(at) or []}  # a bucket whose keys are all deleted has no file
        new = {b: n for b, n in bases.items() if b not in touched} | dict.fromkeys(left, later[-1])
        self.spark.createDataFrame(sorted(new.items()), "bucket int, base long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/upto={later[-1]}")
        return len(touched)

    def vacuum(self) -> None:
        """Removes batches that are compacted and base files that are no longer read; readers that opened them before break off."""
        upto, bases = self._manifest()
        if upto is None:
            return
        old = [f"log/batch={n}" for n in self._numbers("log", "batch") if n <= upto]
        for n in self._numbers("base", "upto"):
            fs, at = self._fs(f"{self.folder}/base/upto={n}/bucket=*")
            old += [f"base/upto={n}/{s.getPath().getName()}" for s in fs.globStatus(at) or [] if bases.get(int(s.getPath().getName().split("=")[1])) != n]
        for name in old:
            fs, at = self._fs(f"{self.folder}/{name}")
            fs.delete(at, True)

"""Tables that jobs write on the way, in the folder all executors share.

The folder is the session's ``spark.checkpoint.dir``.  Where that is unset on a local master (tests,
one machine) a folder of this process is made and removed at exit; on a cluster it has to be set.  A written table cuts the
lineage: a lost executor costs only the running stage, never what came before it.
"""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_jobs: list[Scratch] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or on a local master a folder of our own if it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors reach")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quarrylight-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


class Scratch:
    """Intermediate tables of one job.

    ``keep`` writes a frame as Parquet and reads it back; ``drop`` removes a table that later
    steps no longer read.  The tables that the returned frame reads stay until ``clear``.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"
        self.names: list[str] = []
        _jobs.append(self)

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        self.names.append(name)
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables.  Shuffles and broadcasts of what is no longer used are freed when the driver collects garbage, so it is asked to."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()


    def keep_only(self, *names: str) -> None:
        """Drops all tables but these."""
        self.drop(*(n for n in self.names if n not in names))
        self.names = list(names)


def jobs() -> int:
    """How many jobs of this process have tables; a mark for ``clear``."""
    return len(_jobs)


def clear(since: int = 0) -> None:
    """Removes all tables of this process's jobs, or of those begun after the mark; frames that they returned can't be read any more."""
    while len(_jobs) > since:
        _jobs.pop().drop("")


def own_columns(frame: DataFrame, **names: str) -> DataFrame:
    """The named columns under names that the job uses: ``own_columns(docs, doc_id="id")``.

    Other columns, whatever they are called, do not reach the job.
    """
    return frame.select(*(frame[f"`{theirs}`"].alias(ours) for ours, theirs in names.items()))

"""Folders that all executors share, and tables written there to cut a plan's lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def new_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; on a local master, where that is unset, below one of this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors reach")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="quarrylight-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = f"file://{_own[0]}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(frame: DataFrame) -> DataFrame:
    """The frame, written to a new folder and read from there."""
    folder = new_folder(frame.sparkSession)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)

"""Running a streaming query over what is there, and reading its result as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..scratch import new_folder

def run_once(stream: DataFrame) -> DataFrame:
    """All rows that an append-mode stream gives for the input at hand."""
    spark = stream.sparkSession
    folder = new_folder(spark)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")

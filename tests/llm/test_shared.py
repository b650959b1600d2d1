import pytest

from quarrylight.llm import shared


def test_tables_are_written_read_and_removed(spark):
    scratch = shared.Scratch(spark, "test")
    assert scratch.path.startswith(shared.shared_dir(spark))
    kept, gone = scratch.keep(spark.range(5).toDF("a"), "kept"), scratch.keep(spark.range(3).toDF("a"), "gone")
    assert (kept.count(), gone.count()) == (5, 3)
    scratch.drop("gone")
    with pytest.raises(Exception, match="gone"):
        spark.read.parquet(f"{scratch.path}/gone")
    assert kept.count() == 5
    shared.clear()
    with pytest.raises(Exception, match="kept"):
        spark.read.parquet(f"{scratch.path}/kept")


def test_own_columns(spark):
    frame = spark.createDataFrame([(1, "x", 2)], "`the id` long, `a.b` string, id long")
    assert shared.own_columns(frame, id="the id", text="a.b").collect() == [(1, "x")]

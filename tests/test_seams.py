"""Form parameters, recordings, and channels in blocks."""

from pyspark.sql import functions as F

from quarrylight.functions import text as tx
from quarrylight.operators import generate, relations


def test_query_parameters(spark):
    cases = {
        "https://a.org/?email=x%40y.org&email=z": "x@y.org", "/p?a=1&email=": "", "?email": "", "https://a.org/p#?email=no": None, "https://a.org/?mail=1": None,
        "?e%6Dail=a+b%2B": "a b+", "?email=100%&x": "100%", "?email=%D0%B6=1\n2": "ж=1\n2", "?&=1&EMAIL=2": None, "": None, None: None, "not a url ?email=1 2#email=3": "1 2",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "url string").select("url", tx.query_parameter(F.col("url"), "email").alias("v")).collect()
    assert {r["url"]: r["v"] for r in rows} == cases


def test_recordings(spark):
    def hear(recording, language):
        if recording == b"noise":
            raise RuntimeError("no server")
        return None if not recording else f" {language} {len(recording)}\n"

    frame = spark.createDataFrame([(1, b"abc", "old"), (2, b"", "old"), (3, b"noise", "old"), (4, None, "old"), (5, b"x" * 600_000, "old")], "id long, content binary, text string")
    rows = {r["id"]: (r["text"], r["error"]) for r in generate.transcribed(frame, hear, language="en").collect()}
    assert rows == {1: ("en 3", None), 2: ("", None), 3: (None, "RuntimeError: no server"), 4: (None, "ValueError: no recording"), 5: ("en 600000", None)}
    assert generate.transcribed(frame.limit(0), hear).count() == 0


def test_channels_in_blocks_meet_each_row_once(spark, monkeypatch):
    monkeypatch.setattr(relations, "STRIPS", 3)
    frame, channels = spark.range(40), spark.range(25).select(F.concat(F.lit("c"), "id").alias("code"))
    found = relations.fan_out(frame, channels, ["A", "B"], most_channels=4)
    assert found.columns == ["id", "code", "variant"]
    assert "Cartesian" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == sorted((i, f"c{c}", v) for i in range(40) for c in range(25) for v in "AB")
    twice = relations.fan_out(frame.unionByName(frame), channels, ["A"], most_channels=4)
    assert twice.count() == 2000 and twice.distinct().count() == 1000

import zlib

from pyspark.sql import functions as F

from quarrylight.llm import langid
from quarrylight.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = QUERIES["op3_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["accepted"] for r in got) / len(got) > 0.98


def train(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs, langid.learn(docs, F.lit(True))


def test_defined_cases(spark):
    rows = [(i, f"the cat and the dog number {i} sat on the mat", "en") for i in range(60)] + [(100 + i, f"der Hund und die Katze {i} sitzen auf der Matte", "de") for i in range(60)]
    rows += [(500, None, "en"), (501, "123 !?", "de"), (502, "", "en"), (503, "the cat", None), (None, "der Hund", "de"), (504, "xq zzv", "")]
    docs, model = train(spark, rows)
    assert model.languages == ["", "de", "en"]
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert [got[d]["lang_pred"] for d in (500, 501, 502)] == ["und"] * 3 and [got[d]["score"] for d in (500, 501, 502)] == [0.0] * 3
    assert got[503]["lang_pred"] == "en" and got[None]["lang_pred"] == "de"
    long = spark.createDataFrame([(1, "und die Katze " * 50_000)], "doc_id long, text string")
    assert langid.identify(long, model).first()["lang_pred"] == "de"
    assert langid.identify(docs.limit(0), model).count() == 0
    wide = docs.withColumns({"has_letter": F.lit(1), "score": F.lit("s")})
    kept = langid.accepted(wide, model)
    assert kept.columns == wide.columns and {500, 501, 502}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_nothing_to_learn_from(spark):
    docs, model = train(spark, [(1, "hello", None)])
    assert model is None
    (r,) = langid.identify(docs, model).collect()
    assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)


def test_training_twice_gives_the_same(spark):
    rows = [(i, f"word{i % 7} text {i % 3}", "ab"[i % 2]) for i in range(50)]
    one, two = train(spark, rows)[1], train(spark, rows)[1]
    assert (one.table == two.table).all() and one.threshold == two.threshold


def rows_in_training(spark, rows, monkeypatch, **options):
    """How many texts each label has in the training task."""
    import json
    import tempfile
    from pathlib import Path

    seen = Path(tempfile.mkdtemp()) / "seen"
    monkeypatch.setattr(langid, "train", lambda samples, at=str(seen): Path(at).write_text(json.dumps([s[0] for s in samples])) and None)
    langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), **options)
    labels = json.loads(seen.read_text())
    return {x: labels.count(x) for x in set(labels)}


def test_the_sample_is_bounded_by_rows(spark, monkeypatch):
    """An id on very many rows, a row that repeats, and many rows: no more than the sample of each."""
    rows = [(7, f"text number {i} of the many", "en") for i in range(3000)] + [(9, "immer derselbe Text", "de")] * 3000 + [(i, f"texte {i}", "fr") for i in range(500)]
    assert rows_in_training(spark, rows, monkeypatch, sample=10, in_all=30) == {"en": 10, "de": 1, "fr": 10}
    assert rows_in_training(spark, rows, monkeypatch, sample=10, in_all=6) == {"en": 2, "de": 1, "fr": 2}

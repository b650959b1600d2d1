"""Batches of files that count once."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarrylight.sources import files as sources
from quarrylight.streaming import ingest

SCHEMA = "path string, relative_path string, content binary"
LONG = "A sentence that is long enough to pass. " * 3


def frame(spark, **contents):
    rows = [(p.replace("__", "/").replace("_DOT_", "."), p.replace("__", "/").replace("_DOT_", "."), c if c is None else bytearray(c.encode())) for p, c in contents.items()]
    return spark.createDataFrame(rows, SCHEMA)


def everything(store):
    return [sorted(map(repr, t.collect())) for t in (store.ledger(), store.outcomes(), store.drawers(), store.markdown())]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path))
    assert everything(store) == [[], [], [], []]
    first = frame(spark, books__a_DOT_txt=LONG, b_DOT_md="short", c_DOT_bin="x", drafts__n_DOT_txt=None)
    assert ingest.ingest_batch(store, first, 0, at=datetime(2024, 1, 1))
    before = everything(store)
    assert not ingest.ingest_batch(store, first, 0, at=datetime(2024, 1, 2))
    assert not ingest.ingest_batch(store, frame(spark, other_DOT_txt=LONG), 0, at=datetime(2024, 1, 2))
    assert everything(store) == before
    got = {r["relative_path"]: (r["outcome"], r["archived_as"]) for r in store.outcomes().collect()}
    assert got == {"books/a.txt": ("processed", "processed/books/a.txt"), "b.md": ("failed", "failed/misc/b.md"), "c.bin": ("failed", "failed/misc/c.bin"), "drafts/n.txt": ("failed", "failed/drafts/n.txt")}
    assert [tuple(r)[:5] for r in store.ledger().collect()] == [(4, 1, 0, 3, 1)]


def test_a_broken_batch_is_not_seen_and_is_written_over(spark, tmp_path, monkeypatch):
    store = ingest.Store(spark, str(tmp_path))
    whole, put = frame(spark, books__a_DOT_txt=LONG), ingest.Store.put

    def breaks(self, rows, table, batch):
        if table == "ledger":
            raise RuntimeError("lost")
        return put(self, rows, table, batch)

    monkeypatch.setattr(ingest.Store, "put", breaks)
    with pytest.raises(RuntimeError):
        ingest.ingest_batch(store, whole, 7, at=datetime(2024, 1, 1))
    monkeypatch.setattr(ingest.Store, "put", put)
    assert everything(store) == [[], [], [], []]
    assert ingest.ingest_batch(store, whole, 7, at=datetime(2024, 1, 1))
    assert [len(x) for x in everything(store)] == [1, 1, 1, 1]


def test_each_file_is_parsed_once(spark, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()

    def parser(content):
        import uuid

        (marks / uuid.uuid4().hex).write_text("")
        return content.decode()

    store = ingest.Store(spark, str(tmp_path / "out"))
    ingest.ingest_batch(store, frame(spark, a_DOT_txt=LONG, b_DOT_txt="short", d_DOT_txt=LONG), 0, at=datetime(2024, 1, 1), parsers={".txt": parser})
    assert len(list(marks.iterdir())) == 3


def test_warnings_names_that_are_taken_and_no_files(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path))
    text = "\n\n".join(f"Paragraph {i} " + "w" * 60 for i in range(10))
    accepts = F.col("chunk_index") % 2 == 0
    for batch, at in ((0, datetime(2024, 1, 1)), (1, datetime(2024, 1, 2, 3, 4, 5))):
        ingest.ingest_batch(store, frame(spark, books__x__a_DOT_tar_DOT_txt=text, books__y__a_DOT_tar_DOT_txt=text, books__plain_DOT_txt=LONG), batch, at=at, accepts=accepts, target=100, overlap=0)
    got = {(r["batch"], r["relative_path"]): (r["outcome"], r["archived_as"]) for r in store.outcomes().collect()}
    assert got[0, "books/x/a.tar.txt"] == ("warning", "processed/books/a.tar.txt")
    assert got[0, "books/y/a.tar.txt"][1] == "processed/books/a.tar_20240101_000000.txt"
    assert got[1, "books/x/a.tar.txt"][1] == "processed/books/a.tar_20240102_030405.txt"
    assert got[1, "books/y/a.tar.txt"][1] == "processed/books/a.tar_20240102_030405_2.txt"
    assert got[1, "books/plain.txt"][1] == "processed/books/plain_20240102_030405.txt"
    assert ingest.ingest_batch(store, frame(spark, a_DOT_txt=LONG), 2, at=datetime(2024, 1, 3), accepts=F.lit(None).cast("boolean"))
    assert store.failures().where("batch = 2").first()["error"] == ingest.NONE_STORED
    assert ingest.ingest_batch(store, spark.createDataFrame([], SCHEMA), 3, at=datetime(2024, 1, 3))
    assert [tuple(r)[:5] for r in store.ledger().where("batch = 3").collect()] == [(0, 0, 0, 0, 0)]
    assert set(sources.PARSERS) >= {".txt", ".md"}

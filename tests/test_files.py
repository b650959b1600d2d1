"""Parsers, folders and the streaming ingestion."""

import io
import zipfile

from pyspark.sql import functions as F

from quarrylight.sources import files
from quarrylight.streaming import ingest


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' if s else f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for s, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_html():
    html = "<h1>A &amp; B</h1><p> one <b>two</b></p><script>x()</script><h2>C</h2><h4>D</h4><blockquote>q</blockquote><p> </p>"
    assert files.html_to_markdown(html) == "# A & B\n\none two\n\n## C\n\n### D\n\n> q"


def test_other_formats():
    assert files.parse_docx(docx(("Heading1", "T"), ("", " body "), ("Heading3", "U"), ("", ""))) == "# T\n\nbody\n\n### U"
    rich = rb"{\rtf1{\fonttbl{\f0 Arial;}}Hello \b bold\b0\par caf\'e9 \u1078?}"
    assert files.parse_rtf(rich) == "Hello bold\ncaf" + chr(0xE9) + " " + chr(1078)
    assert files.parse_text("ж".encode("cp1251")) == "ж" and files.parse_text("a".encode("utf-8-sig")) == "a" and files.parse_text("a".encode("utf-16")) == "a"
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("b.xhtml", "<p>two</p>")
        z.writestr("a.xhtml", "<h1>one</h1>")
    assert files.parse_epub(book.getvalue()) == "# one\n\ntwo"


def test_contents_are_opened_a_piece_at_a_time(spark, monkeypatch):
    pa = files.pa
    batch = pa.RecordBatch.from_arrays([pa.array([b"x" * n if n else None for n in (3, 0, 4, 9, 30, 1, 1)])], ["content"])
    assert [p.num_rows for p in files.pieces(batch, "content", 10)] == [3, 1, 1, 2]
    assert list(files.pieces(batch.slice(0, 0), "content")) == []
    frame = spark.createDataFrame([(i, f"{i}.txt", None if i % 7 == 0 else b"text %d " % i * 40_000) for i in range(30)], "id long, path string, content binary").coalesce(1)
    read = files.parsed(frame)
    assert "MapInArrow" in read._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: (r["text"], r["error"] is None) for r in read.drop("content").collect()} == {i: (None, False) if i % 7 == 0 else ((f"text {i} " * 40_000).strip(), True) for i in range(30)}


def test_folder_and_stream(spark, tmp_path):
    inbox = tmp_path / "inbox"
    for name, text in {"books/a.txt": "Long enough. " * 300, "b.MD": "# T\n" + "word " * 30, "other/c.txt": "short", "books/d.docx": None, "e.bin": "x"}.items():
        (inbox / name).parent.mkdir(parents=True, exist_ok=True)
        (inbox / name).write_bytes(b"not a zip" if text is None else text.encode())
    found = files.found_files(spark, str(inbox))
    assert sorted(r["relative_path"] for r in found.collect()) == ["b.MD", "books/a.txt", "books/d.docx", "other/c.txt"]
    batch = ingest.chunked(ingest.read_texts(found)).select("relative_path", "chunk_index", "wing", "tag")
    assert {r["relative_path"]: r["wing"] for r in batch.collect()} == {"b.MD": "misc", "books/a.txt": "books"}
    store = ingest.Store(spark, str(tmp_path / "out"))
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest_stream(spark, str(inbox), store.folder, str(tmp_path / "state"), once=True).awaitTermination()
        assert sorted(map(tuple, store.drawers().select("relative_path", "chunk_index", "wing", "tag").collect())) == sorted(map(tuple, batch.collect()))
        failed = {r["relative_path"]: r["error"] for r in store.failures().collect()}
        assert set(failed) == {"books/d.docx", "other/c.txt"} and failed["other/c.txt"].startswith("text too short")
        assert [(r["files"], r["processed"], r["failed"]) for r in store.ledger().collect()] == [(4, 2, 2)]


def test_key_values_and_front_matter(spark):
    lines = spark.createDataFrame([("A=1",), ("TOKEN= x=y ",), ("#TOKEN=z",)], "value string")
    assert [r[0] for r in files.key_values(lines, "TOKEN").collect()] == ["x=y"]
    post = '---\ntitle: "Hi"\ndate: 2024-03-01\ntags: [a, "b c"]\n---\nBody\n'
    row = files.front_matter(spark.createDataFrame([(post,), ("plain",)], "text string")).collect()
    assert (row[0]["title"], row[0]["description"], str(row[0]["date"]), row[0]["tags"], row[0]["body"]) == ("Hi", None, "2024-03-01 00:00:00", ["a", "b c"], "Body\n")
    assert row[1]["title"] is None and row[1]["tags"] == [] and row[1]["body"] == "plain"


def test_unknown_extension_is_an_error(spark):
    rows = spark.createDataFrame([("x.zip", b"1"), ("y.txt", b" t ")], "path string, content binary")
    got = {r["path"]: (r["text"], r["error"]) for r in files.parsed(rows).select("path", "text", "error").collect()}
    assert got["y.txt"] == ("t", None) and "no parser for .zip" in got["x.zip"][1]
    assert files.parsed(rows.where(F.lit(False))).count() == 0

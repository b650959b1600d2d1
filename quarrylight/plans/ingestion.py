"""Queries: sentences, chunks, gates, parsers, payloads."""

from __future__ import annotations

import io
import zipfile
import zlib
from datetime import datetime, timedelta
from html import escape

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import changes, generate, ingest
from ..scratch import new_folder
from ..sources import files, remote
from ..streaming import ingest as ingestion
from .registry import Registry
from .tables import bare, dealt, table

registry = Registry()
query = registry.query


def _sentences_sql(text: str) -> str:
    """Sentences without lookbehind: a mark goes behind every end, and the text is split at the marks."""
    marked = f"regexp_replace({text}, '([.!?…])[\\s\\x0b]+', '\\1' || chr(31), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(31)), lambda x: {bare('x')}), lambda x: x <> '')"


@query(f"SELECT doc_id, i AS position, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_sentences_sql('text')} AS s FROM documents))")
def sentence_split(spark, sf_dir):
    s = dealt(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("position", "sentence"))
    return s.withColumn("position", (F.col("position") + 1).cast("long"))


def _chunks_sql(text: str, target: int, overlap: int) -> str:
    body, now = "u.body", "s.open"
    full = f"length({now}) + length({body}) + 2 > {target} AND {now} <> ''"
    tail = f"CASE WHEN length({now}) > {overlap} THEN right({now}, {overlap}) ELSE '' END"
    units = f"""list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda p: {bare('p')}), lambda p: p <> '')"""
    return f"""WITH RECURSIVE src AS (SELECT doc_id, {text} AS t FROM documents),
paras AS (SELECT doc_id, j, p[j] AS para FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS j FROM (SELECT doc_id, {units} AS p FROM src WHERE length(t) > {target}))),
parts AS (SELECT doc_id, j, 0 AS k, chr(10) || chr(10) AS sep, para AS body FROM paras WHERE length(para) <= {target}
  UNION ALL SELECT doc_id, j, k, ' ', s[k] FROM (SELECT doc_id, j, s, unnest(range(1, len(s) + 1)) AS k FROM (SELECT doc_id, j, {_sentences_sql('para')} AS s FROM paras WHERE length(para) > {target}))),
units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY j, k) AS i, sep, body FROM parts),
fold AS (SELECT doc_id, 1::BIGINT AS i, NULL::VARCHAR AS done, body AS open FROM units WHERE i = 1
  UNION ALL SELECT s.doc_id, u.i, CASE WHEN {full} THEN {bare(now)} END,
    CASE WHEN {full} THEN {bare(f"({tail}) || u.sep || {body}")} WHEN {now} = '' THEN {body} ELSE {bare(f"{now} || u.sep || {body}")} END
  FROM fold s JOIN units u ON u.doc_id = s.doc_id AND u.i = s.i + 1),
made AS (SELECT doc_id, i, done AS content FROM fold WHERE done IS NOT NULL
  UNION ALL SELECT doc_id, 1000000000, {bare('open')} FROM fold WHERE (doc_id, i) IN (SELECT doc_id, max(i) FROM units GROUP BY 1) AND {bare('open')} <> ''
  UNION ALL SELECT doc_id, 0, {bare('t')} FROM src WHERE length(t) <= {target} AND {bare('t')} <> '')
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS chunk_index, content FROM made"""


def _chunks(spark, sf_dir, text, target, overlap):
    return dealt(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(tx.chunks(text, target, overlap)).alias("chunk_index", "content"))


@query(_chunks_sql("text", 2000, 200))
def chunk_sentences(spark, sf_dir):
    """Documents have no blank lines, so long ones are cut at sentences."""
    return _chunks(spark, sf_dir, F.col("text"), 2000, 200)


@query(_chunks_sql("replace(text, chr(10), chr(10) || chr(10))", 700, 80))
def chunk_paragraphs(spark, sf_dir):
    """Every line a paragraph."""
    return _chunks(spark, sf_dir, F.replace("text", F.lit("\n"), F.lit("\n\n")), 700, 80)


@query("""WITH c AS (""" + _chunks_sql("text", 2000, 200) + """), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM c)
SELECT sha256(doc_id || ':' || chunk_index) AS id, doc_id, left('doc-' || doc_id, 60) AS room, CASE WHEN n > 1 THEN 'doc-' || doc_id || ' (часть ' || (chunk_index + 1) || '/' || n || ')' ELSE 'doc-' || doc_id END AS title,
  'chunk_' || (chunk_index + 1) || '_of_' || n AS tag, content FROM n""")
def numbered_chunks(spark, sf_dir):
    """Chunks as drawers with stable ids."""
    d = dealt(table(spark, sf_dir, "documents")).withColumn("base", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    return ingest.numbered_chunks(d, key="doc_id", text="text", base="base").select("id", "doc_id", "room", "title", "tag", "content")


@query(f"SELECT doc_id, CASE WHEN length({bare('text')}) < 50 THEN 'text too short: ' || length({bare('text')}) END AS error FROM documents")
def text_gate(spark, sf_dir):
    return ingest.gated(table(spark, sf_dir, "documents")).select("doc_id", "error")


@query("SELECT user_id, count(*) AS n, count(*) FILTER (value < 60) AS n_ok, CASE WHEN count(*) FILTER (value < 60) = 0 THEN 'failed' WHEN count(*) FILTER (value < 60) / count(*) < 0.8 THEN 'warning' ELSE 'processed' END AS outcome FROM events GROUP BY 1")
def upload_outcomes(spark, sf_dir):
    return ingest.outcomes(table(spark, sf_dir, "events"), "user_id", F.col("value") < 60)


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'misc' WHEN 1 THEN 'books' WHEN 2 THEN 'misc' ELSE 'drafts' END AS wing FROM pages")
def wings_of_paths(spark, sf_dir):
    """Collections by first folder."""
    n = F.col("page_id") % 4
    path = F.when(n == 0, "file.txt").when(n == 1, "books/a/b.txt").when(n == 2, "unknown/b.txt").otherwise("drafts/c.md")
    return table(spark, sf_dir, "pages").select("page_id", ingest.wing_of(path).alias("wing"))


@query()
def html_to_markdown(spark, sf_dir):
    """Raw pages as markdown."""
    pages = dealt(table(spark, sf_dir, "pages")).select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return files.parsed(pages).select(F.split_part("path", F.lit("."), F.lit(1)).cast("long").alias("page_id"), F.col("text").alias("markdown"), "error")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN '' END AS id, CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN 0.0 END AS distance, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN event_type END AS content FROM events WHERE event_id % 3 <> 2")
def payload_normalisation(spark, sf_dir):
    """Hits may be objects or bare strings; anything else is dropped."""
    n = F.col("event_id") % 3
    object_ = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("value").alias("distance"), F.col("event_type").alias("content")))
    raw = F.when(n == 0, object_).when(n == 1, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise("[1, 2]")
    e = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    kind = F.schema_of_variant(F.parse_json("raw"))
    hit = F.from_json("raw", "id string, distance double, content string")
    e = e.select("event_id", "raw", kind.alias("kind"), F.when(kind.startswith("OBJECT"), hit).alias("hit"))
    text = F.when(F.col("kind") == "STRING", F.variant_get(F.parse_json("raw"), "$", "string"))
    e = e.where(F.col("kind").startswith("OBJECT") | (F.col("kind") == "STRING"))
    return e.select("event_id", F.coalesce("hit.id", F.lit("")).alias("id"), F.coalesce("hit.distance", F.lit(0.0)).alias("distance"), F.coalesce("hit.content", text, F.lit("")).alias("content"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN event_id % 4 = 0 THEN 'number: x' || event_id END AS error FROM events")
def error_collecting_load(spark, sf_dir):
    """What can't be read is an error of its row, and the load goes on."""
    given = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise("1")
    number = given.try_cast("int")
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.when(number.isNull(), F.concat(F.lit("number: "), given)).alias("error"))


@query("SELECT DISTINCT '_init_' || coalesce(source, 'misc') AS id, coalesce(source, 'misc') AS wing, true AS is_active FROM documents")
def placeholder_seeds(spark, sf_dir):
    """A placeholder for each collection of documents; seeding twice writes the same rows over themselves."""
    wings = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("misc")).alias("wing")).distinct()
    seeds = wings.select(F.concat(F.lit("_init_"), "wing").alias("id"), "wing", F.lit(True).alias("is_active"))
    log = seeds.withColumn("seq", F.lit(1)).unionByName(seeds.withColumn("seq", F.lit(2)))
    return changes.fold(log, "id", ["seq"], take_last=["wing", "is_active"])


@query("SELECT 'k' || n_nationkey AS line, n_name AS token FROM nation")
def key_value_lines(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("line"), F.concat(F.lit("TOKEN= "), "n_name", F.lit("  ")).alias("value"))
    stripped = tx.strip(F.substring("value", F.lit(len("TOKEN=") + 1), F.length("value")))
    return n.where(F.col("value").startswith("TOKEN=")).select("line", stripped.alias("token"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE doc_id / 10.0::DOUBLE END AS distance, CASE WHEN doc_id % 4 = 0 THEN '' ELSE coalesce(text, '') END AS content FROM documents")
def hit_defaults(spark, sf_dir):
    """Hits without a distance count as 1, without a text as empty."""
    d = table(spark, sf_dir, "documents")
    hits = d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") / 10.0).alias("distance"), F.when(F.col("doc_id") % 4 != 0, F.col("text")).alias("content"))
    return hits.select("id", F.coalesce("distance", F.lit(1.0)).alias("distance"), F.coalesce("content", F.lit("")).alias("content"))


@query("SELECT lang AS name, count(*) AS n, true AS is_active FROM documents WHERE lang IN ('de', 'fr', 'missing') GROUP BY 1")
def catalog_listing(spark, sf_dir):
    """Which of a list of names there are, each with how many objects it has and the constant flag of seed rows."""
    names = table(spark, sf_dir, "documents").where(F.col("lang").isin("de", "fr", "missing"))
    return names.groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("n")).withColumn("is_active", F.lit(True))


#: Documents as dropped files: several folders and endings, names that repeat, two batches.
_DROPPED = """f AS (SELECT doc_id, doc_id % 2 AS batch, CASE doc_id % 5 WHEN 0 THEN 'books' WHEN 1 THEN 'articles' WHEN 2 THEN 'elsewhere' ELSE 'drafts' END || '/s' || doc_id || '/d' || doc_id // 9 AS stem_path, CASE doc_id % 8 WHEN 0 THEN '.MD' WHEN 1 THEN '.xyz' ELSE '.txt' END AS ending, text AS raw FROM documents)"""
_STORED = "length(content) % 7 > 1"


def _dropped(spark, sf_dir):
    n = F.col("doc_id")
    folder = F.when(n % 5 == 0, "books").when(n % 5 == 1, "articles").when(n % 5 == 2, "elsewhere").otherwise("drafts")
    ending = F.when(n % 8 == 0, ".MD").when(n % 8 == 1, ".xyz").otherwise(".txt")
    path = F.concat(folder, F.lit("/s"), n.cast("string"), F.lit("/d"), F.floor(n / 9).cast("string"), ending)
    return dealt(table(spark, sf_dir, "documents")).select(path.alias("path"), path.alias("relative_path"), F.encode("text", "UTF-8").alias("content"), (n % 2).alias("batch"))


def _taken_in(spark, sf_dir):
    """Both batches, the first of them twice."""
    store, dropped = ingestion.Store(spark, new_folder(spark)), _dropped(spark, sf_dir)
    for batch in (0, 1, 0):
        at = datetime(2024, 1, 1) + timedelta(seconds=batch)
        ingestion.ingest_batch(store, dropped.where(F.col("batch") == batch).drop("batch"), batch, at=at, accepts=F.length("content") % 7 > 1)
    return store


_INGESTED = f"""{_DROPPED},
t AS (SELECT *, {bare('raw')} AS text FROM f),
e AS (SELECT *, CASE WHEN ending = '.xyz' THEN 'ValueError: no parser for .xyz' WHEN raw IS NULL THEN 'TypeError' WHEN length(text) < 50 THEN 'text too short: ' || length(text) END AS parse FROM t),
c AS ({_chunks_sql(bare('text'), 2000, 200)}),
n AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER ({_STORED}) AS n_stored FROM c GROUP BY 1),
o AS (SELECT e.doc_id, batch, stem_path || ending AS relative_path, CASE WHEN split_part(stem_path, '/', 1) = 'elsewhere' THEN 'misc' ELSE split_part(stem_path, '/', 1) END AS wing, split_part(stem_path, '/', 3) AS stem, ending,
  coalesce(parse, CASE WHEN n_stored = 0 THEN 'no chunk was stored' END) AS error, CASE WHEN parse IS NULL THEN n_chunks ELSE 0 END AS n_chunks, CASE WHEN parse IS NULL THEN n_stored ELSE 0 END AS n_stored FROM e LEFT JOIN n USING (doc_id)),
k AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'failed' WHEN n_stored < 0.8 * n_chunks THEN 'warning' ELSE 'processed' END AS outcome FROM o),
a AS (SELECT *, CASE WHEN outcome = 'failed' THEN 'failed' ELSE 'processed' END AS root FROM k),
p AS (SELECT *, row_number() OVER (PARTITION BY root, wing, stem, ending, batch ORDER BY relative_path) - CASE WHEN min(batch) OVER (PARTITION BY root, wing, stem, ending) < batch THEN 0 ELSE 1 END AS late FROM a)"""


@query(f"""WITH {_INGESTED} SELECT batch, relative_path, wing, outcome, error, n_chunks::BIGINT AS n_chunks, n_stored::BIGINT AS n_stored,
  root || '/' || wing || '/' || stem || CASE WHEN late = 0 THEN '' ELSE '_20240101_00000' || batch || CASE WHEN late > 1 THEN '_' || late ELSE '' END END || ending AS archived_as FROM p""")
def ingest_outcomes(spark, sf_dir):
    """What became of each dropped file, after a batch was run again."""
    return _taken_in(spark, sf_dir).outcomes().select("batch", "relative_path", "wing", "outcome", "error", "n_chunks", "n_stored", "archived_as")


@query(f"""WITH {_INGESTED} SELECT batch, count(*) AS files, count(*) FILTER (outcome = 'processed') AS processed, count(*) FILTER (outcome = 'warning') AS warning,
  count(*) FILTER (outcome = 'failed') AS failed, sum(n_stored)::BIGINT AS stored FROM p GROUP BY 1""")
def ingest_ledger(spark, sf_dir):
    """The counts of each batch, as observed while it was written."""
    return _taken_in(spark, sf_dir).ledger().select("batch", "files", "processed", "warning", "failed", "stored")


@query(f"WITH {_INGESTED} SELECT sha256(k.relative_path || ':' || chunk_index) AS id, k.wing, k.batch, c.chunk_index, c.content FROM c JOIN k USING (doc_id) WHERE k.n_chunks > 0 AND {_STORED}")
def ingest_drawers(spark, sf_dir):
    """The drawers that dropped files left."""
    return _taken_in(spark, sf_dir).drawers().select("id", "wing", "batch", "chunk_index", "content")


@query(f"WITH {_INGESTED} SELECT k.wing, k.relative_path, t.text FROM k JOIN t USING (doc_id) JOIN e USING (doc_id) WHERE e.parse IS NULL")
def ingest_markdown(spark, sf_dir):
    """The markdown copies of what could be read."""
    return _taken_in(spark, sf_dir).markdown().select("wing", "relative_path", "text")


# Encodings that files come in, and words for texts in Russian.
ENCODINGS = ("utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-32-be", "cp1252", "cp1251", "koi8-r", "cp866")
WORDS = "завтра будет дождь возьми зонт старый дом стоит лесом добрый кузнец играют собака столом книга лежит открой окно сегодня жарко поезд приходит полдень встреча начнётся".split()
_RUSSIAN = f"'Первая строка, номер ' || doc_id || '. ' || array_to_string(list_transform(string_split(text, ' '), lambda w: {WORDS}[1 + (length(w) * 7 + (CASE WHEN w = '' THEN 0 ELSE unicode(w) END)) % {len(WORDS)}]), ' ')"


def _made(texts, column, write, ending):
    """Texts as files (doc_id, path, content): ``write`` gives a file's ending and bytes; a null text is a null content of that ending."""

    def pack(batches):
        for part in (part for batch in batches for part in files.pieces(batch, column)):
            made = [(ending, None) if (text := t.as_py()) is None else write(n.as_py(), text) for n, t in zip(part.column("doc_id"), part.column(column), strict=True)]
            paths = [f"{n}{e}" for n, (e, _) in zip(part.column("doc_id").to_pylist(), made, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(paths, pa.string()), pa.array([c for _, c in made], pa.binary())], ["doc_id", "path", "content"])

    return texts.mapInArrow(pack, "doc_id long, path string, content binary")


@query(f"SELECT doc_id, {bare(f'CASE WHEN doc_id % 9 >= 6 THEN {_RUSSIAN} ELSE text END')} AS text, text IS NULL AS failed FROM documents")
def decoded_files(spark, sf_dir):
    """Documents as text files in many encodings, read without being told which; those for Cyrillic get Russian words."""
    d = dealt(table(spark, sf_dir, "documents")).select("doc_id", "text", (F.col("doc_id") % 9).alias("n"))
    number = lambda w: F.pmod(F.length(w) * 7 + F.ascii(w), F.lit(len(WORDS))) + 1
    words = F.transform(F.split("text", " "), lambda w: F.element_at(F.lit(WORDS), number(w)))
    russian = F.concat(F.lit("Первая строка, номер "), F.col("doc_id").cast("string"), F.lit(". "), F.array_join(words, " "))
    raw = d.select("doc_id", "n", F.when(F.col("n") >= 6, russian).otherwise(F.col("text")).alias("raw"))

    read = files.parsed(_made(raw, "raw", lambda doc_id, text: (".txt", text.encode(ENCODINGS[doc_id % len(ENCODINGS)])), ".txt"))
    return read.select("doc_id", "text", F.col("error").isNotNull().alias("failed"))


def _service(spark, sf_dir):
    """Events behind a service, which files in the shared folder stand in for: the rows, the folder and the name of the service's format."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    folder = new_folder(spark)
    name = f"events_{folder[-32:]}"
    remote.register(spark, name, remote.ParquetClient(f"{folder}/items", "event_id", e.columns), "event_id long, user_id long, event_type string, value double")
    return e, folder, name


@query("SELECT event_id, user_id, event_type, value FROM events")
def remote_listing(spark, sf_dir):
    """A service's items, read page by page in parallel."""
    e, folder, name = _service(spark, sf_dir)
    e.repartitionByRange("event_id").sortWithinPartitions("event_id").write.parquet(f"{folder}/items")
    return spark.read.format(name).options(after=-1, page=5000).load()


@query("SELECT event_id, user_id, event_type, value FROM events")
def remote_updates(spark, sf_dir):
    """A service's items as a stream that is stopped, and started again when later ones have come."""
    e, folder, name = _service(spark, sf_dir)
    half = e.agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0] // 2
    updates = spark.readStream.format(name).options(after=-1, page=5000).load()
    for come in (F.col("event_id") <= half, F.col("event_id") > half):
        e.where(come).repartitionByRange("event_id").sortWithinPartitions("event_id").write.mode("append").parquet(f"{folder}/items")
        updates.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(updates.schema).parquet(f"{folder}/out")


_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _packed(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as packed:
        for name, content in parts.items():
            packed.writestr(name, content)
    return out.getvalue()


def _docx(lines: list[str]) -> bytes:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in lines)
    return _packed({"word/document.xml": f'<w:document xmlns:w="{_W}"><w:body>{body}</w:body></w:document>'})


def _epub(lines: list[str]) -> bytes:
    """Two pages, of which the manifest names the later one by name first."""
    page = lambda part: "<html><body>" + "".join(f"<p>{escape(line)}</p>" for line in part) + "</body></html>"
    half = len(lines) // 2
    items = "".join(f'<item id="{n}" href="{n}.xhtml" media-type="application/xhtml+xml"/>' for n in ("b", "a"))
    return _packed({"META-INF/container.xml": '<container><rootfiles><rootfile full-path="in/p.opf"/></rootfiles></container>', "in/p.opf": f"<package><manifest>{items}</manifest></package>", "in/a.xhtml": page(lines[half:]), "in/b.xhtml": page(lines[:half])})


def _rtf(lines: list[str]) -> bytes:
    letter = lambda c: f"\\u{ord(c)}?" if ord(c) > 127 else f"\\{c}" if c in "\\{}" else c
    return ("{\\rtf1{\\fonttbl{\\f0 Any;}}" + "\\par ".join("".join(map(letter, line)) for line in lines) + "}").encode()


_WRITERS = (("docx", _docx), ("epub", _epub), ("rtf", _rtf))


@query(f"""SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN {bare('text')} ELSE array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {bare('x')}), lambda x: x <> ''), chr(10) || chr(10)) END AS text, text IS NULL AS failed FROM documents""")
def packed_files(spark, sf_dir):
    """Documents as Word, EPUB and RTF files, a paragraph a line, read by the parser of their ending."""
    d = dealt(table(spark, sf_dir, "documents")).select("doc_id", "text")

    def pack(doc_id, text):
        ending, write = _WRITERS[doc_id % len(_WRITERS)]
        return f".{ending}", write(text.split("\n"))

    read = files.parsed(_made(d, "text", pack, ".docx"))
    return read.select("doc_id", "text", F.col("error").isNotNull().alias("failed"))


_PAGE_LINES = 8


def _pdf(text: str) -> bytes:
    """Pages of eight lines in a font whose codes are those of the text's own alphabet."""
    lines = text.split("\n")
    alphabet = sorted(set(text) - {"\n"})
    codes = {c: f"{n:04x}" for n, c in enumerate(alphabet)}
    parts = [f"{min(100, len(alphabet) - i)} beginbfchar " + " ".join(f"<{codes[c]}> <{c.encode('utf-16-be').hex()}>" for c in alphabet[i : i + 100]) + " endbfchar" for i in range(0, len(alphabet), 100)]
    contents = ["BT /F 9 Tf 10 TL " + " T* ".join(f"<{''.join(map(codes.__getitem__, line))}> Tj" for line in lines[i : i + _PAGE_LINES]) + " ET" for i in range(0, len(lines), _PAGE_LINES)]
    streams = [zlib.compress(part.encode()) for part in ("1 begincodespacerange <0000> <ffff> endcodespacerange " + " ".join(parts), *contents)]
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Resources << /Font << /F 3 0 R >> >> /Kids [" % len(contents) + b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(len(contents))) + b"] >>", b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 4 0 R >>"]
    for i, data in enumerate(streams):
        bodies += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (4 + 2 * i)] * bool(i)
        bodies.append(b"<< /Filter /FlateDecode /Length %d >> stream\n%s\nendstream" % (len(data), data))
    out, places = [b"%PDF-1.7\n"], []
    at = len(out[0])
    for n, body in enumerate(bodies, 1):
        places.append(at)
        out.append(b"%d 0 obj %s endobj\n" % (n, body))
        at += len(out[-1])
    out.append(b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places))
    out.append(b"trailer << /Root 1 0 R /Size %d >>\nstartxref\n%d\n%%%%EOF" % (len(bodies) + 1, at))
    return b"".join(out)


@query(f"""SELECT doc_id, array_to_string(list_filter(list_transform(range(0, len(lines), {_PAGE_LINES}), lambda p: array_to_string(list_filter(lines[p + 1:p + {_PAGE_LINES}], lambda x: x <> ''), chr(10))), lambda y: y <> ''), chr(10) || chr(10)) AS text, lines IS NULL AS failed
  FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: {bare('x')}) AS lines FROM documents)""")
def paged_files(spark, sf_dir):
    """Documents as PDF files of several pages, read by their parser; blank pages and lines are left out."""
    d = dealt(table(spark, sf_dir, "documents")).select("doc_id", "text")

    read = files.parsed(_made(d, "text", lambda doc_id, text: (".pdf", _pdf(text)), ".pdf"))
    return read.select("doc_id", "text", F.col("error").isNotNull().alias("failed"))


def _spoken(recording: bytes, language: str) -> str:
    """A deterministic stand-in for a speech model: what the bytes say, behind the mark of a language that is not the asked one."""
    return recording.decode("utf-8") if language == "ru" else f"[{language}] {recording.decode('utf-8')}"


@query(f"SELECT doc_id, {bare('text')} AS text, text IS NULL AS failed FROM documents")
def voice_notes(spark, sf_dir):
    """Recordings to texts, through the seam for a speech model."""
    d = dealt(table(spark, sf_dir, "documents")).select("doc_id", F.encode("text", "utf-8").alias("content"))
    heard = generate.transcribed(d, _spoken)
    return heard.select("doc_id", "text", F.col("error").isNotNull().alias("failed"))

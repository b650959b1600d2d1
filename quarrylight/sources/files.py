"""Folders of documents as tables: discovery, format dispatch, parsers, key=value and front-matter files."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import strip
from .charsets import decoded
from .pdf import parse_pdf

Parser = Callable[[bytes], str]

_HEADS = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "### ", "blockquote": "> ", "p": ""}


class _Blocks(HTMLParser):
    """Collects the text of headings, paragraphs and quotes in the order in which they begin."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, list[str]]] = []
        self.open: list[int] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in _HEADS:
            self.open.append(len(self.blocks))
            self.blocks.append((tag, []))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in _HEADS:
            for i in reversed(range(len(self.open))):
                if self.blocks[self.open[i]][0] == tag:
                    del self.open[i:]
                    break

    def handle_data(self, data):
        if not self.hidden and data.strip():
            for i in self.open:
                self.blocks[i][1].append(data.strip())


def html_to_markdown(html: str) -> str:
    """Headings, quotes and paragraphs as markdown blocks apart by blank lines; empty ones are left out."""
    reader = _Blocks()
    reader.feed(html)
    reader.close()
    return "\n\n".join(_HEADS[tag] + " ".join(parts) for tag, parts in reader.blocks if parts)


def parse_html(content: bytes) -> str:
    return html_to_markdown(content.decode("utf-8", errors="ignore"))


def parse_text(content: bytes) -> str:
    """The text in the encoding that it is found to be in; what can't be decoded is replaced."""
    return decoded(content)


_PAGES = (".xhtml", ".html", ".htm")


def epub_pages(book: zipfile.ZipFile) -> list[str]:
    """The book's pages in the order of its package's manifest; without a package that can be read, all pages by name, numbers
    in them in order of size.

    The container names the package, whose manifest names the files, from the package's folder on.
    """
    names = set(book.namelist())
    try:
        container = ElementTree.fromstring(book.read("META-INF/container.xml"))
        package = next(e.get("full-path") for e in container.iter() if e.tag.rpartition("}")[2] == "rootfile")
        items = [e for e in ElementTree.fromstring(book.read(package)).iter() if e.tag.rpartition("}")[2] == "item"]
        pages = [posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(e.get("href", "").partition("#")[0]))) for e in items if "html" in e.get("media-type", "")]
        found = [p for p in dict.fromkeys(pages) if p in names]
    except (KeyError, StopIteration, TypeError, ElementTree.ParseError, zipfile.BadZipFile, zlib.error):
        found = []
    by_number = lambda name: [(0, int(part), "") if part.isdecimal() else (1, 0, part) for part in re.split(r"([0-9]+)", name)]
    return found or sorted((n for n in names if n.lower().endswith(_PAGES)), key=by_number)


def parse_epub(content: bytes) -> str:
    """The pages of the book as markdown; those that can't be read or have no text are skipped."""
    parts = []
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        for name in epub_pages(book):
            try:
                parts.append(parse_html(book.read(name)))
            except (zipfile.BadZipFile, zlib.error, OSError, ValueError):
                continue
    return "\n\n".join(p for p in parts if p)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def parse_docx(content: bytes) -> str:
    """Paragraphs apart by blank lines; headings of the first three levels are marked."""
    with zipfile.ZipFile(io.BytesIO(content)) as packed:
        root = ElementTree.fromstring(packed.read("word/document.xml"))
    parts = []
    for paragraph in root.iter(f"{_W}p"):
        text = "".join(t.text or "" for t in paragraph.iter(f"{_W}t")).strip()
        if text:
            style = paragraph.find(f"{_W}pPr/{_W}pStyle")
            level = re.fullmatch(r"heading\s*([1-3])", style.get(f"{_W}val", "").lower()) if style is not None else None
            parts.append("#" * int(level[1]) + " " + text if level else text)
    return "\n\n".join(parts)


def parse_rtf(content: bytes) -> str:
    """Text of a rich text file: groups of settings and control words are left out, escapes are read."""
    out: list[str] = []
    skip, stack = False, []
    for m in re.finditer(r"\\u(-?\d+)\s?\??|\\'([0-9a-f]{2})|\\([a-z]+)(-?\d*)\s?|\\([^a-z])|([{}])|([^\\{}\r\n]+)", content.decode("utf-8", errors="ignore"), re.I):
        code, byte, word, _, sign, brace, plain = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif sign == "*" or word in ("fonttbl", "colortbl", "stylesheet", "info", "pict"):
            skip = True
        elif not skip:
            out.append(chr(int(code) % 65536) if code else bytes.fromhex(byte).decode("cp1252", errors="replace") if byte else {"par": "\n", "line": "\n", "tab": "\t"}.get(word, "") if word else (sign if sign in "\\{}" else "") if sign else plain or "")
    return "".join(out)


#: By extension; entries can be added.
PARSERS: dict[str, Parser] = {".txt": parse_text, ".md": parse_text, ".markdown": parse_text, ".html": parse_html, ".htm": parse_html, ".epub": parse_epub, ".docx": parse_docx, ".rtf": parse_rtf, ".pdf": parse_pdf}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def found_files(spark: SparkSession, folder: str, parsers: dict[str, Parser] = PARSERS) -> DataFrame:
    """Files under a folder that some parser reads: path, relative_path, content, length; a distributed binary scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    relative = F.regexp_replace("path", r"^[a-z]*:/*", "/")
    root = re.sub(r"^[a-z]*:/*", "/", folder).rstrip("/") + "/"
    relative = F.substring(relative, F.instr(relative, root) + len(root), F.length(relative))
    return files.where(extension(F.col("path")).isin(*parsers)).select("path", relative.alias("relative_path"), "content", "length")


#: Bytes of contents that a worker has open as Python objects at a time, if no single file has more.
PIECE = 1 << 20


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch in which a column of texts or bytes has about so many bytes at most."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, "right")))
        yield batch.slice(low, high - low)
        low = high


def parsed(files: DataFrame, parsers: dict[str, Parser] = PARSERS) -> DataFrame:
    """Adds ``text`` and ``error`` (null where the text could be read); unknown extensions are errors.

    Contents are opened a piece of a batch at a time, so a worker's memory doesn't grow with how long a batch's files are in sum.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in pieces(batch, "content")):
            texts, errors = [], []
            for path, content in zip(part.column("path").to_pylist(), part.column("content"), strict=True):
                ending = re.search(r"\.[^./]+$", path)
                parser = parsers.get(ending[0].lower()) if ending else None
                try:
                    if parser is None:
                        raise ValueError(f"no parser for {ending[0].lower() if ending else 'files without an extension'}")
                    texts.append(parser(bytes(content.as_py())).strip())
                    errors.append(None)
                except Exception as e:  # one bad file is a row with its error, not a failed job
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array(errors, pa.string())], [*part.schema.names, "text", "error"])

    return files.mapInArrow(parse, StructType([*files.schema, StructField("text", StringType()), StructField("error", StringType())]))


def key_values(lines: DataFrame, key: str, line: str = "value") -> DataFrame:
    """What stands behind ``key=`` in lines that begin so, stripped."""
    return lines.where(F.col(line).startswith(f"{key}=")).select(strip(F.substring(F.col(line), F.lit(len(key) + 2), F.length(line))).alias(key))


def front_matter(texts: DataFrame, text: str = "text") -> DataFrame:
    """Adds title, description, date and tags from a ``---`` block at the top, and body (the rest)."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    field = lambda name: F.nullif(strip(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1)), F.lit(""))
    tags = F.transform(F.split(F.regexp_extract(head, r"(?m)^tags:[ \t]*\[(.*?)\]", 1), ","), lambda t: strip(F.regexp_replace(t, "[\"']", "")))
    return texts.withColumns({"title": field("title"), "description": field("description"), "date": F.try_to_timestamp(field("date")), "tags": F.filter(tags, lambda t: t != ""), "body": F.regexp_replace(text, r"(?s)\A---\n.*?\n---(?:\n|\z)", "")})

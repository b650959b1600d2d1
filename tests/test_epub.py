"""Books by their package."""

import io
import zipfile

from quarrylight.sources import files

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>'


def book(pages, items=None, container=CONTAINER):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if container:
            z.writestr("META-INF/container.xml", container)
        if items is not None:
            z.writestr("OEBPS/book.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest>' + "".join(f'<item href="{h}" media-type="{m}"/>' for h, m in items) + "</manifest></package>")
        for name, text in pages.items():
            z.writestr(name, text)
    return out.getvalue()


PAGE = "application/xhtml+xml"


def test_order_of_the_manifest():
    pages = {"OEBPS/a.xhtml": "<p>first</p>", "OEBPS/text/b c.html": "<h1>second</h1>", "OEBPS/z.css": "p {}", "left-out.html": "<p>no</p>", "OEBPS/blank.xhtml": "<p> </p>"}
    items = [("text/b%20c.html", PAGE), ("z.css", "text/css"), ("missing.xhtml", PAGE), ("blank.xhtml", PAGE), ("a.xhtml#part", PAGE), ("a.xhtml", PAGE)]
    assert files.parse_epub(book(pages, items)) == "# second\n\nfirst"


def test_without_a_package_by_name_and_number():
    pages = {f"chap{n}.html": f"<p>{n}</p>" for n in (10, 2, 1)}
    want = "1\n\n2\n\n10"
    assert files.parse_epub(book(pages, container=None)) == want
    assert files.parse_epub(book(pages, container="<broken")) == want
    assert files.parse_epub(book(pages, container="<container/>")) == want
    assert files.parse_epub(book(pages, items=[])) == want


def test_a_bad_page_is_skipped():
    pages = {"OEBPS/a.xhtml": "<p>" + "good " * 50 + "</p>", "OEBPS/b.xhtml": "<p>" + "bad " * 50 + "</p>"}
    content = bytearray(book(pages, [("b.xhtml", PAGE), ("a.xhtml", PAGE)]))
    at = content.index(b"bad bad")  # stored as it is, so its checksum no longer holds
    content[at : at + 3] = b"dab"
    assert files.parse_epub(bytes(content)) == ("good " * 50).strip()

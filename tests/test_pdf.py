"""Pages of PDF files."""

import zlib

import pytest

from quarrylight.plans import ingestion
from quarrylight.sources import files
from quarrylight.sources.pdf import glyph, parse_pdf


def built(objects, *, trailer="", packed=False, version="1.7"):
    """A file of numbered objects (bytes, or a pair of a dictionary's inside and a stream's bytes); the first is the catalog."""
    out, places = bytearray(f"%PDF-{version}\n%\xff\xfe\n".encode("latin-1")), {}
    body = {n: o if isinstance(o, bytes) else b"<< %s /Length %d >>\nstream\n%s\nendstream" % (o[0], len(o[1]), o[1]) for n, o in enumerate(objects, 1)}
    if not packed:
        for n, o in body.items():
            places[n] = len(out)
            out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
        start = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(body) + 1) + b"".join(b"%010d 00000 n \n" % places[n] for n in body)
        out += b"trailer\n<< /Root 1 0 R /Size %d %s >>\nstartxref\n%d\n%%%%EOF" % (len(body) + 1, trailer.encode(), start)
        return bytes(out)
    loose = {n: o for n, o in body.items() if not isinstance(objects[n - 1], bytes)}
    inside = {n: o for n, o in body.items() if n not in loose}
    for n, o in loose.items():
        places[n] = (1, len(out), 0)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
    heads, joined = b"", b""
    for i, (n, o) in enumerate(inside.items()):
        heads += b"%d %d " % (n, len(joined))
        joined += o + b" "
        places[n] = (2, len(body) + 1, i)
    data = zlib.compress(heads + joined)
    places[len(body) + 1] = (1, len(out), 0)
    out += b"%d 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(body) + 1, len(inside), len(heads), len(data), data)
    start = len(out)
    places[len(body) + 2] = (1, start, 0)
    rows = [bytes(6)] + [bytes([k]) + a.to_bytes(4) + bytes([b]) for k, a, b in (places[n] for n in range(1, len(body) + 3))]
    above, filtered = bytes(6), b""
    for row in rows:  # differences from the row above
        filtered += b"\x02" + bytes((a - b) & 255 for a, b in zip(row, above, strict=True))
        above = row
    data = zlib.compress(filtered)
    out += b"%d 0 obj\n<< /Type /XRef /W [1 4 1] /Size %d /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 6 >> /Length %d >>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % (len(body) + 2, len(body) + 3, len(data), data, start)
    return bytes(out)


FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"


def pages(*contents, font=FONT, more=(), resources=b""):
    """Catalog, tree, font, then page and content by turns."""
    kids = b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(contents)))
    tree = b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 3 0 R >> %s >> >>" % (len(contents), kids, resources)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", tree, font]
    for i, content in enumerate(contents):
        objects += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (5 + 2 * i), (b"/Filter /FlateDecode", zlib.compress(content))]
    return [*objects, *more]


ONE = b"BT /F1 12 Tf 72 700 Td (First \\(line\\)) Tj 0 -14 Td (sec) Tj (ond \\256) Tj ET"
TWO = b"BT /F1 12 Tf 14 TL 72 700 Td [(Wo) 30 (rd) -400 (next)] TJ T* ( ) Tj (last) ' ET"
WANT = "First (line)\nsecond ®\n\nWord next\nlast"


@pytest.mark.parametrize("packed", [False, True])
def test_pages_in_order_and_blank_ones_left_out(packed):
    assert parse_pdf(built(pages(ONE, b"BT ET", TWO), packed=packed)) == WANT
    assert files.PARSERS[".pdf"] is parse_pdf


def test_a_later_section_replaces_objects():
    old = built(pages(ONE))
    content = b"BT /F1 12 Tf (new) Tj ET"
    new = old + b"\n"
    place = len(new)
    new += b"5 0 obj\n<< /Length 6 0 R >>\nstream\n%s\nendstream\nendobj\n" % content
    length = len(new)
    new += b"6 0 obj %d endobj\n" % len(content)
    start = len(new)
    new += b"xref\n5 2\n%010d 00000 n \n%010d 00000 n \ntrailer << /Root 1 0 R /Size 7 /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (place, length, int(old.rsplit(b"startxref\n")[-1].split()[0]), start)
    assert parse_pdf(new) == "new"


def test_map_to_unicode_and_differences():
    font = b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 6 0 R >>"
    table = b"1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0001> <043F> <0002> <D83DDE00> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0416> <00660069>] endbfrange"
    assert parse_pdf(built(pages(b"BT /F1 9 Tf <00010002 001000110012> Tj <00200021 0099> Tj ET", font=font, more=[(b"", table)]))) == "п😀abcЖfi�"
    font = b"<< /Type /Font /Subtype /Type1 /Encoding << /BaseEncoding /MacRomanEncoding /Differences [1 /afii10017 /afii10023 /afii10097 65 /eacute /period /uni0416 /seven /no#20such] >> >>"
    assert parse_pdf(built(pages(b"BT /F1 9 Tf (\\001\\002\\3ABCDE\\216) Tj ET", font=font))) == "АЁяé.Ж7�é"
    assert [glyph(n) for n in ("afii10022", "afii10024", "afii10049", "afii10071", "ccedilla", "colon", "a.alt")] == ["Е", "Ж", "Я", "ё", "ç", ":", "a"]


def test_forms_images_and_filters():
    image = b"q 10 0 0 10 0 0 cm BI /W 1 /H 1 ID (\x01(( EI Q "
    form = (b"/Type /XObject /Subtype /Form /Resources << /Font << /F1 3 0 R >> /XObject << /X 6 0 R >> >> /Filter [/ASCIIHexDecode]", b"BT /F1 9 Tf 0 500 Td (inside) Tj ET /X Do".hex().encode() + b">")
    objects = pages(b"BT /F1 9 Tf 0 600 Td (before) Tj ET " + image + b"/X Do BT 0 400 Td /F1 9 Tf (after) Tj 40 0 Td (it) Tj ET", more=[form], resources=b"/XObject << /X 6 0 R >>")
    assert parse_pdf(built(objects)) == "before\ninside\nafter it"


@pytest.mark.parametrize("content", [b"", b"text", built(pages(ONE))[:200], built(pages(ONE)).replace(b"startxref\n", b"startxref\n9"), built(pages(ONE), trailer="/Encrypt 9 0 R"), built([b"<< >>"]), built(pages(ONE)).replace(b"/FlateDecode", b"/JBIG2Decode"), built(pages(ONE)).replace(b"5 0 obj", b"8 0 obj")])
def test_damaged_and_encrypted_files_are_error_rows(spark, content):
    rows = files.parsed(spark.createDataFrame([("a.pdf", content), ("b.PDF", built(pages(ONE, TWO)))], "path string, content binary")).collect()
    assert rows[0]["text"] is None and rows[0]["error"]
    assert (rows[1]["text"], rows[1]["error"]) == (WANT, None)


def test_circles_end():
    objects = pages(ONE)
    objects[1] = objects[1].replace(b"/Kids [4 0 R]", b"/Kids [2 0 R 4 0 R 4 0 R]")
    assert parse_pdf(built(objects)) == "First (line)\nsecond ®"
    objects = pages(ONE)
    objects[4] = b"5 0 R"
    with pytest.raises(ValueError):
        parse_pdf(built([*objects[:4], b"6 0 R", b"5 0 R"]))


def test_a_hybrid_file_and_one_of_many_pages():
    file = built(pages(ONE), packed=True)
    stream = int(file.rsplit(b"startxref\n")[-1].split()[0])
    hybrid = file + b"\n"
    start = len(hybrid)
    hybrid += b"xref\n0 6\n" + b"0000000000 65535 f \n" * 6 + b"trailer << /Root 1 0 R /Size 6 /XRefStm %d >>\nstartxref\n%d\n%%%%EOF" % (stream, start)
    assert parse_pdf(hybrid) == "First (line)\nsecond ®"
    text = "\n".join(f"{n} слово {chr(0x4E00 + n % 3000)}" for n in range(40000))
    want = text.split("\n")
    assert parse_pdf(ingestion._pdf(text)) == "\n\n".join("\n".join(want[i : i + 8]) for i in range(0, len(want), 8))

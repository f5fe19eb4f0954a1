"""PDF files made here: plain and compressed streams, object streams, fonts with a map, and a corpus from one."""

import re
import zlib

import pytest

from silvan.sources import corpora, pdf


def stream(content, compress=True, **more):
    body = zlib.compress(content) if compress else content
    head = "".join(f" /{k} {v}" for k, v in more.items()) + (" /Filter /FlateDecode" if compress else "")
    return b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(body), head.encode(), body)


def make(objects):
    out = b"%PDF-1.5\n%\xe2\xe3\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects)
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


def document(pages, fonts=b"<< /F1 5 0 R >>", more=(), compress=True):
    kids = b" ".join(b"%d 0 R" % (100 + k) for k in range(len(pages)))
    objects = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [%s] /Resources << /Font %s >> >>" % (kids, fonts)), (5, b"<< /Type /Font /Subtype /Type1 /BaseFont /Times >>"), *more]
    for k, content in enumerate(pages):
        objects += [(100 + k, b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (200 + k)), (200 + k, stream(content, compress))]
    return make(objects)


TABLET = rb"""BT /F1 12 Tf 14 TL 72 700 Td (Tablet) Tj T* (I) Tj T* T* (He who saw \(the\) deep,) Tj T* [(the coun) -20 (try's) -300 (foundation)] TJ
T* T* (who knew) Tj 60 0 Td (his ways) Tj ET
q 1 0 0 1 0 -20 cm BT /F1 12 Tf 1 0 0 1 72 500 Tm (7) Tj ET Q"""


@pytest.mark.parametrize("compress", [True, False])
def test_lines_of_pages(compress):
    got = pdf.text_of(document([TABLET, b"BT /F1 10 Tf 72 700 Td <48e9> Tj 0 -12 TD (\\101\\\n B) Tj (line) ' ET"], compress=compress))
    assert got.split("\f") == ["Tablet\nI\n\nHe who saw (the) deep,\nthe country's foundation\n\nwho knew his ways\n\n7\n", "Hé\nA B\nline\n", ""]


def test_map_of_a_font_and_objects_in_streams():
    cmap = b"/CIDInit begincmap 1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0001> <0048> <0002> <D835DCB3> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<00660066> <0078>] endbfrange"
    inner = b"7 0 8 41 << /Type /Font /Subtype /Type0 /ToUnicode 9 0 R>> [ 1 2 (x) ]"
    holder = stream(inner, N=2, First=9)
    holder = stream(b"7 0 8 61 " + b"<< /Type /Font /Subtype /Type0 /ToUnicode 9 0 R >>".ljust(61) + b"[ 1 2 (x) ]", Type="/ObjStm", N=2, First=9)
    data = document([b"BT /F2 9 Tf 50 50 Td <0001000200100012> Tj [<0020> 5 <0021>] TJ ET"], b"<< /F1 5 0 R /F2 7 0 R >>", [(9, stream(cmap)), (6, holder)])
    assert pdf.text_of(data) == "H𝒳acffx\n\f"
    assert pdf.Document(data).get(pdf.Ref(8)) == [1, 2, b"x"]


def test_later_definitions_count_and_odd_files():
    first = document([b"BT /F1 9 Tf 0 0 Td (old) Tj ET"])
    assert pdf.text_of(first + b"\n200 0 obj\n" + stream(b"BT /F1 9 Tf 0 0 Td (new) Tj Tj (1) Td ET") + b"\nendobj\n") == "new\n\f"
    assert pdf.text_of(b"") == "" == pdf.text_of(b"no pdf at all") and pdf.text_of(document([b""])) == "\n\f"
    assert pdf.text_of(re.sub(rb"/FlateDecode", b"/LZWDecode  ", first)) == "\n\f"
    with pytest.raises(ValueError, match="encrypted"):
        pdf.text_of(first + b"trailer << /Encrypt 5 0 R >>")


def test_gilgamesh_from_a_pdf(spark, tmp_path):
    (tmp_path / "g.pdf").write_bytes(document([TABLET, rb"BT /F1 12 Tf 14 TL 72 700 Td (went on) Tj T* T* (Tablet II) Tj T* T* (Second) Tj T* (text) Tj ET"]))
    got = corpora.gilgamesh(pdf.read_pdf(spark, str(tmp_path / "g.pdf"))).orderBy("position", "depth").collect()
    assert [(r["key"], r["text"]) for r in got] == [
        ("Tablet 1", None), ("Tablet 1:p1", "He who saw (the) deep, the country's foundation"), ("Tablet 1:p2", "who knew his ways"), ("Tablet 1:p3", "went on"),
        ("Tablet 2", None), ("Tablet 2:p1", "Second text"),
    ]

import io
import zipfile

from pyspark.sql import functions as F

from skein.config import MEDIA_DOCX
from skein.sources import documents as D


def test_media_routing(spark):
    rows = [
        ("text/plain", b"hi"), ("text/plain; charset=utf-8", b"hi"), ("text/plain", b"\xff\xfe"),
        ("application/pdf", b"%PDF"), ("application/pdf; charset=x", b"%PDF"), (MEDIA_DOCX, b"zip"),
        ("text/html", b"<p>"), (None, b"x"),
    ]
    df = spark.createDataFrame(rows, "content_type string, content binary")
    got = [(r.route, r.status, r.text) for r in D.media_route(df).collect()]
    assert got == [("text", 200, "hi"), ("text", 200, "hi"), ("text", 422, None), ("pdf", 200, None),
                   ("unsupported", 415, None), ("docx", 200, None), ("unsupported", 415, None),
                   ("unsupported", 415, None)]


def _docx_with_table():
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = (f'<w:document xmlns:w="{ns}"><w:body>'
           '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
           '<w:p><w:r><w:t>para</w:t></w:r></w:p></w:body></w:document>')
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", xml)
    return buf.getvalue()


def test_docx_bfs_order_and_failures(spark):
    assert D.docx_text(_docx_with_table()) == "para\ncell\n"
    assert D.docx_text(_docx_with_table(), order="document") == "cell\npara\n"
    assert D.docx_text(b"not a zip") is None
    empty = io.BytesIO()
    with zipfile.ZipFile(empty, "w") as z:
        z.writestr("word/document.xml", "<document/>")
    assert D.docx_text(empty.getvalue()) == "   "
    rows = [("a", "docx", _docx_with_table()), ("b", "docx", b"junk"), ("c", "pdf", b"%PDF"),
            ("d", "docx", D.make_docx(["x", "y"]))]
    df = spark.createDataFrame(rows, "path string, route string, content binary")
    got = {r.path: (r.status, r.text) for r in D.extract(df).collect()}
    assert got == {"a": (200, "para\ncell\n"), "b": (422, None), "c": (415, None), "d": (200, "x\ny\n")}


def test_extractor_crash_is_422(spark):
    def boom(_):
        raise RuntimeError("parser crashed")

    df = spark.createDataFrame([("a", "pdf", b"%PDF")], "path string, route string, content binary")
    r = D.extract(df, {"pdf": boom}).first()
    assert (r.status, r.text) == (422, None)


def test_binary_file_source(spark, tmp_path):
    p = tmp_path / "up"
    p.mkdir()
    (p / "a.docx").write_bytes(D.make_docx(["hello"]))
    files = D.read_uploads(spark, str(p), "*.docx").withColumn("content_type", F.lit(MEDIA_DOCX))
    out = D.extract(D.media_route(files).drop("text")).first()
    assert (out.status, out.text) == (200, "hello\n")


def test_whole_text_files(spark, tmp_path):
    d = tmp_path / "txt"
    d.mkdir()
    (d / "a.txt").write_text("line one\nline two\n", encoding="utf-8")
    (d / "b.txt").write_text("héllo", encoding="utf-8")
    got = sorted(r.text for r in D.read_text_files(spark, str(d), "*.txt").collect())
    assert got == ["héllo", "line one\nline two\n"]

"""Document sources: table scans, uploaded files, media-type routing, UTF-8
gate and binary extraction (DOCX built in; any other type pluggable).

Routing and the UTF-8 gate are native expressions. Extraction runs one parser
call per file inside ``mapInPandas`` (Arrow batches, executors only); a parser
that fails or raises gives status 422 for that file and never fails the job.
"""

from __future__ import annotations

import io
import zipfile
from collections import deque
from collections.abc import Callable, Mapping
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import MEDIA_DOCX, MEDIA_PDF, MEDIA_TEXT_PREFIX

Extractor = Callable[[bytes], "str | None"]


def scan_documents(df: DataFrame, memory_col: str = "source") -> DataFrame:
    """Documents offered to a memory: ``doc_id, memory, text, n_bytes``."""
    return df.select("doc_id", F.col(memory_col).alias("memory"), "text",
                     F.octet_length("text").cast("long").alias("n_bytes"))


def read_uploads(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Uploaded files as rows ``path, modificationTime, length, content``."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


def read_text_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Plain-text files, one document per file: ``path, text`` (whole file as
    one value, as an uploaded text body)."""
    r = spark.read
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def route(content_type: Column | str) -> Column:
    """``text`` for any ``text/plain*`` (prefix match), ``docx`` / ``pdf`` on
    exact equality, else ``unsupported`` (also when missing)."""
    ct = F.col(content_type) if isinstance(content_type, str) else content_type
    return (F.when(ct.startswith(MEDIA_TEXT_PREFIX), F.lit("text"))
            .when(ct == F.lit(MEDIA_DOCX), F.lit("docx"))
            .when(ct == F.lit(MEDIA_PDF), F.lit("pdf"))
            .otherwise(F.lit("unsupported")))


def utf8_status(content: Column | str) -> Column:
    """200 for valid UTF-8 bytes, 422 otherwise."""
    c = F.col(content) if isinstance(content, str) else content
    return F.when(F.is_valid_utf8(c.cast("string")), F.lit(200)).otherwise(F.lit(422)).cast("long")


def media_route(df: DataFrame, content_type_col: str = "content_type", content_col: str = "content") -> DataFrame:
    """Adds ``route`` and ``status``: 415 unsupported, 422 undecodable text,
    200 accepted (binary types are decided by their extractor later), and the
    decoded ``text`` for text routes."""
    r = route(content_type_col)
    status = F.when(r == "unsupported", F.lit(415)).when(r == "text", utf8_status(content_col)) \
        .otherwise(F.lit(200)).cast("long")
    text = F.when(r == "text", F.try_validate_utf8(F.col(content_col).cast("string")))
    return df.withColumn("route", r).withColumn("status", status).withColumn("text", text)


#: Fixed value: the text of a DOCX without any text element.
NO_TEXT = "   "


def docx_text(data: bytes, order: str = "bfs") -> str | None:
    """Text of a DOCX: every element named ``t`` (any namespace) in
    breadth-first order (``order="document"``: document order), each followed
    by a newline; three spaces when there is none; None when the file is not a
    zip or has no ``word/document.xml``."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            xml = z.read("word/document.xml")
    except (zipfile.BadZipFile, KeyError, OSError, ValueError):
        return None
    root = ElementTree.fromstring(xml)
    out: list[str] = []
    if order == "document":
        nodes = root.iter()
    else:
        def bfs():
            q = deque([root])
            while q:
                n = q.popleft()
                yield n
                q.extend(list(n))
        nodes = bfs()
    for n in nodes:
        if n.tag.rsplit("}", 1)[-1] == "t":
            out.append((n.text or "") + "\n")
    return "".join(out) if out else NO_TEXT


DEFAULT_EXTRACTORS: Mapping[str, Extractor] = {"docx": docx_text}


def extract(df: DataFrame, extractors: Mapping[str, Extractor] | None = None, key_col: str = "path",
            content_col: str = "content", route_col: str = "route") -> DataFrame:
    """Run the extractor of each row's route over its bytes.

    Output ``key, route, status, text``: 200 with text, 422 when the extractor
    returns None or raises, 415 when no extractor exists for the route."""
    ex = dict(DEFAULT_EXTRACTORS if extractors is None else extractors)
    key_type = df.schema[key_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            status, text = [], []
            for rt, data in zip(pdf[route_col], pdf[content_col]):
                fn = ex.get(rt)
                if fn is None:
                    status.append(415)
                    text.append(None)
                    continue
                try:
                    t = fn(bytes(data)) if data is not None else None
                except Exception:  # noqa: BLE001 - a bad file must not fail the job
                    t = None
                status.append(200 if t is not None else 422)
                text.append(t)
            yield pd.DataFrame({key_col: pdf[key_col], route_col: pdf[route_col],
                                "status": pd.Series(status, dtype="int64"), "text": text})

    return df.select(key_col, route_col, content_col).mapInPandas(
        run, f"{key_col} {key_type}, {route_col} string, status long, text string")


def make_docx(paragraphs: list[str]) -> bytes:
    """A minimal DOCX with one paragraph per string (for tests and round trips)."""
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    ElementTree.register_namespace("w", ns)
    doc = ElementTree.Element(f"{{{ns}}}document")
    body = ElementTree.SubElement(doc, f"{{{ns}}}body")
    for p in paragraphs:
        r = ElementTree.SubElement(ElementTree.SubElement(body, f"{{{ns}}}p"), f"{{{ns}}}r")
        t = ElementTree.SubElement(r, f"{{{ns}}}t")
        t.text = p
        t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types/>')
        z.writestr("word/document.xml", ElementTree.tostring(doc, xml_declaration=True, encoding="UTF-8"))
    return buf.getvalue()


@F.pandas_udf(T.BinaryType())
def docx_from_text(texts: pd.Series) -> pd.Series:
    """Pack each text as a DOCX, one paragraph per line."""
    return texts.map(lambda t: make_docx((t or "").split("\n")))

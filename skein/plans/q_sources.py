"""Queries of the source / extraction family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MEDIA_DOCX
from ..sources import documents as D
from ..sources.tables import spread, table
from .catalog import query


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Uploads derived from the tables: documents as UTF-8 text, pages as HTML."""
    docs = spread(table(spark, sf, "documents")).select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"),
        F.lit("text/plain; charset=utf-8").alias("content_type"), F.encode("text", "UTF-8").alias("content"))
    pages = table(spark, sf, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"),
        F.lit("text/html").alias("content_type"), F.encode("html", "UTF-8").alias("content"))
    return docs.unionByName(pages)


@query("scan_documents",
       "SELECT doc_id, source AS memory, text, strlen(text)::BIGINT AS n_bytes FROM documents")
def scan_documents(spark, sf):
    return D.scan_documents(table(spark, sf, "documents"))


@query("media_route",
       "SELECT 'document' AS kind, doc_id AS id, 'text' AS route, 200::BIGINT AS status FROM documents "
       "UNION ALL SELECT 'page', page_id, 'unsupported', 415 FROM pages")
def media_route(spark, sf):
    return D.media_route(requests(spark, sf)).select("kind", "id", "route", "status")


@query("utf8_gate",
       "SELECT 'document' AS kind, doc_id AS id, 200::BIGINT AS status, strlen(text)::BIGINT AS n_bytes "
       "FROM documents UNION ALL SELECT 'page', page_id, 200, strlen(html) FROM pages")
def utf8_gate(spark, sf):
    r = requests(spark, sf)
    return r.select("kind", "id", D.utf8_status("content").alias("status"),
                    F.octet_length("content").cast("long").alias("n_bytes"))


@query("docx_extract",
       "SELECT doc_id, 200::BIGINT AS status, text || chr(10) AS text FROM documents")
def docx_extract(spark, sf):
    """Documents packed as DOCX files (one paragraph per line), routed by
    media type and extracted back."""
    docs = spread(table(spark, sf, "documents")).select(
        "doc_id", F.lit(MEDIA_DOCX).alias("content_type"), D.docx_from_text(F.col("text")).alias("content"))
    routed = D.media_route(docs).drop("text")
    out = D.extract(routed, key_col="doc_id")
    return out.select("doc_id", "status", "text")

"""Streaming ingest into a vector memory (Structured Streaming).

Documents arrive as files (Parquet rows or uploaded binaries); each micro-batch
is chunked, embedded and written to the memory by ``foreachBatch``. The write
of micro-batch ``b`` replaces this stream's own directory ``b`` in the memory, so a batch
that is replayed after a failure (same id, from the checkpoint) rewrites the
same rows instead of appending them twice. Rows that cannot be stored go to a
dead-letter folder for the same batch id; they never stop the stream.

``maxFilesPerTrigger`` bounds each micro-batch (the back-pressure of a bounded
ingest queue); ``wait=True`` runs everything available and blocks
(``availableNow``), as long as that takes unless a ``timeout`` is given;
``wait=False`` keeps running in the background.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..config import ChunkConfig
from ..operators import embed as E
from ..operators import text as ops
from ..sources.memory import VectorMemory
from ..sources.tables import remove


def document_stream(spark: SparkSession, path: str, schema: StructType, glob: str | None = None,
                    max_files_per_trigger: int = 1) -> DataFrame:
    """A stream over a table's files: ``path`` is a folder, or one Parquet file or
    table. Its last character is written as a pattern, since Spark streams from a
    single file only through one; ``glob`` filters the names of the files inside."""
    path = path.rstrip("/")
    if path[-1] not in "*?]}":
        path = f"{path[:-1]}[{path[-1]}]"
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.parquet(path)


def ingest_batch(memory: VectorMemory, config: ChunkConfig, keys: list[str], dead_letters: str,
                 embed: Callable[[DataFrame], DataFrame] = E.hash_embed, writer: str = "ingest"):
    """The ``foreachBatch`` function: chunk → embed → store (idempotent per writer and
    id). Chunks that cannot be stored, such as those on which an embedder of
    ``embed.python_embed`` failed, go to ``dead_letters/rejected``."""
    def run(batch: DataFrame, batch_id: int) -> None:
        # embedded once: the store and the rejects read the same rows
        staged = os.path.join(dead_letters, "staged", f"batch={batch_id}")
        embed(ops.chunk(batch, keys, config)).write.mode("overwrite").parquet(staged)
        chunks = batch.sparkSession.read.parquet(staged)
        rejected = memory.store(chunks, batch_id=batch_id, writer=writer)
        rejected.write.mode("overwrite").parquet(os.path.join(dead_letters, "rejected", f"batch={batch_id}"))
        remove(batch.sparkSession, staged)  # stored and rejected: the copy has done its work

    return run


def start_ingest(stream: DataFrame, memory: VectorMemory, config: ChunkConfig, checkpoint: str,
                 dead_letters: str, keys: list[str] | None = None, wait: bool = True,
                 timeout: float | None = None, processing_time: str = "5 seconds", writer: str | None = None,
                 embed: Callable[[DataFrame], DataFrame] = E.hash_embed) -> StreamingQuery:
    """Start the stream. ``writer`` names its folder in the memory; by default the name
    follows from the checkpoint, so a restart is the same writer and another stream is not."""
    name = writer or hashlib.sha1(checkpoint.encode()).hexdigest()[:12]
    w = (stream.writeStream.foreachBatch(ingest_batch(memory, config, keys or ["doc_id"], dead_letters, embed, name))
         .option("checkpointLocation", checkpoint))
    if wait:
        q = w.trigger(availableNow=True).start()
        q.awaitTermination(timeout)
        if q.isActive:
            q.stop()
            raise TimeoutError("ingest did not finish in time")
        if q.exception() is not None:
            raise q.exception()
    else:
        q = w.trigger(processingTime=processing_time).start()
    return q

"""Corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
``run`` writes every stage as Parquet in the shared work folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import mixing, ngram_rtree, packing, quality_rank, quality_rules
from skein.llm.common import written
from skein.llm.queries import tokenizer_path
from skein.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents scored below the threshold go."""
    return quality_rank.keep_quality(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the base rule or the rules' posterior reject go."""
    return quality_rules.keep_good(docs.select(*COLUMNS))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near copies the first document stays."""
    return ngram_rtree.keep_one(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to target weights: documents, or the blocks of words taken of them, as
    often as the mix takes them."""
    return mixing.mix_documents(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of all documents in sequences, with their token ids."""
    return packing.pack_documents(docs.select(*COLUMNS), tokenizer_path())


STAGES = [
    ("quality classifier", classify),
    ("quality rules", judge),
    ("n-gram jaccard join", deduplicate),
    ("source mixing", mix),
    ("packing", pack),
]

#: Learned scores and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

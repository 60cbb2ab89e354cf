"""Registered queries of the training-data operators: each applies its operator, with
production parameters, to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import arc_convert, feast_whitening, language_codes, mask_search, mixing, ngram_rtree, packing, quality_rank, quality_rules, rp_forest, toxic_segments, url_sweep, word_bpe
from .common import held_out


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", "posterior")


def op2_arc_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc_convert.round_trip(table(spark, sf_dir, "pages"))


def op3_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    model = language_codes.fit(language_codes.training_rows(docs, out))
    return language_codes.identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    r = quality_rank.rank_quality(docs, labels, 4, 2)
    return r.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


#: The rules of the query: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op5_url_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_sweep.judge_urls(table(spark, sf_dir, "pages"), rules)


def op6_count_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_rtree.linked_documents(table(spark, sf_dir, "documents"))


def op7_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    r = toxic_segments.score_toxicity(docs, labels, 5, 0)
    return r.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", "evidence",
                    F.size("passages").alias("n_passages"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op9_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op11_mask_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feast_whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_arc_convert, op3_language_codes, op4_pairwise_quality, op5_url_sweep,
                                   op6_count_rtree, op7_toxic_segments, op8_source_mix, op9_projection_forest, op10_balanced_packing,
                                   op11_mask_search, op12_feast_whitening, op13_word_bpe)}
ORACLES: dict[str, str] = {
    "op2_arc_convert": arc_convert.oracle(),
    "op5_url_sweep": url_sweep.oracle(URL_RULES),
    "op6_count_rtree": ngram_rtree.oracle(),
    "op8_source_mix": mixing.oracle(),
    "op9_projection_forest": rp_forest.oracle(),
    "op11_mask_search": mask_search.oracle(),
}

"""The registered queries of this package; see each operator's module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trickle.llm import (
    language,
    lexical_search,
    mixing,
    mtree,
    neighbours,
    packing,
    quality_rules,
    recompression,
    secret_scan,
    simhash,
    toxicity,
    url_filters,
    vector_codes,
)
from trickle.llm.common import read_table
from trickle.llm.oracles import all_oracles  # noqa: F401


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(read_table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality_rules.judge(docs, labels)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxicity.score(docs, labels)


def op5_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return neighbours.score(docs, labels)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return recompression.find_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs, shingle=4, distance=4)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return mixing.mix(docs).select("doc_id", "size", "source", "source_size", "target", "taken")


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.judge(read_table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return lexical_search.rank(docs, items, k=50)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    coded, books = vector_codes.compress(vectors, parts=16, entries=64, rounds=2, scale=256)
    return vector_codes.with_label_errors(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256")
    )


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_exact_top_k": op2_exact_top_k,
        "op3_quality_rules": op3_quality_rules,
        "op4_toxicity": op4_toxicity,
        "op5_quality_neighbours": op5_quality_neighbours,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_secret_scan": op7_secret_scan,
        "op8_language_id": op8_language_id,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_mix_sources": op10_mix_sources,
        "op11_url_filters": op11_url_filters,
        "op12_lexical_search": op12_lexical_search,
        "op13_vector_codes": op13_vector_codes,
    }

"""The operators bound to the tables, with production parameters: one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choicelake.llm import ann, decontam, langid, licenses, packing, quality, sharding, simhash, tokens, urls
from choicelake.llm.common import doc_crc, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(quality.training_rows(docs, table(spark, sf_dir, "labels")))
    return quality.score(docs, model).select(
        "doc_id",
        (doc_crc() % 5 == 0).alias("held_out"),
        F.col("quality_score").alias("score"),
        F.col("quality_predicted").alias("predicted"),
    )


def op2_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.col("license_score").alias("score")
    )


def op3_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.with_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op6_bounded_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_bpe_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokens.with_token_counts(docs, tokenizer_path()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_language_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = langid.folded(table(spark, sf_dir, "documents"))
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.identify(docs, model).select(
        "doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score")
    )


def op9_url_language_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"),
        F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"), F.round("url_score", 6).alias("score"),
    )


def op10_prefix_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_quality_nbsvm, op2_license_signatures, op3_bestfit_packing, op4_spaced_seed_decontamination, op5_simhash_components,
        op6_bounded_ring_shards, op7_bpe_token_counts, op8_language_backoff, op9_url_language_ratio,
        op10_prefix_forest_search,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """The other operators rest on hashes, tokenizers or learned models that SQL cannot express."""
    return {"op9_url_language_ratio": urls.oracle()}

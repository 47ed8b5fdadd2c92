"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but
the last return the columns of ``documents`` unchanged, and any others, whatever their names.
Null ids and repeated rows pass through like others up to the near-duplicate stage, which keeps one
row of each group; null and empty texts have no language and go with the second stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choicelake.llm import decontam, langid, neardup, packing, quality
from choicelake.llm.common import free_name, small_batches, stored, table
from choicelake.llm.queries import tokenizer_path

#: Texts whose best language is less sure than this go, as do those of no language.
LEAST_LANGUAGE_SCORE = 0.5
#: A few words in common are no leak: a benchmark answer such as "yes" is in most clean documents.
LEAST_ITEM_WORDS = 5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    small_batches(spark)
    model = quality.fit(quality.training_rows(docs, table(spark, sf_dir, "labels")))
    score, predicted = free_name(docs, "quality_score"), free_name(docs, "quality_predicted")
    return quality.score(docs, model, into=(score, predicted)).where(F.col(predicted) == 1).drop(score, predicted)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned, surely enough."""
    small_batches(spark)
    model = langid.fit(docs)
    name, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    sure = (F.col(name) != langid.UNDETERMINED) & (F.col(score) >= LEAST_LANGUAGE_SCORE)
    return langid.identify(docs, model, into=(name, score)).where(sure).drop(name, score)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    small_batches(spark)
    return neardup.deduplicated(docs, k=5, similarity=0.8)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item of ``LEAST_ITEM_WORDS`` words or more."""
    small_batches(spark)
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"), least_item=LEAST_ITEM_WORDS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its place in a sequence of 1024 tokens."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_path(), 1024)


STAGES = [
    ("quality", keep_quality),
    ("language", keep_languages),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: The stages learn models, hash and tokenize; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs

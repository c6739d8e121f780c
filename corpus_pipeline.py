"""A training-corpus pipeline: quality classifier, quality rules, near-duplicate removal, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and read again as the next one's docs. All but
the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm import compression_quality, ngram_join, packing, quality_rules, substring_dedup
from gaugework.llm.common import token_path, written
from gaugework.session import ship_package


def _with_rows(docs: DataFrame) -> DataFrame:
    """Id and text beside the whole row, so that no name of an operator's can clash with a column of documents."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts good, by a model fitted on labelled documents."""
    ship_package(spark)
    model = compression_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return compression_quality.score(_with_rows(docs), model, carry=["_row"]).filter("predicted = 1").select("_row.*")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules keep."""
    ship_package(spark)
    return quality_rules.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least id."""
    ship_package(spark)
    return ngram_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without what stands in another or again in the same; n_chars is counted anew."""
    ship_package(spark)
    cut = substring_dedup.remove_repeats(docs, as_text=True)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 1024 ids."""
    ship_package(spark)
    parts = packing.pieces(docs, token_path("byte_bpe_50k.json"))
    return packing.pack(written(spark, parts, "pieces"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(spark, docs, f"stage-{k}")
    return docs


#: The model fits, groups of similar texts and packing have no counterpart in SQL.
ORACLE_SQL: str | None = None

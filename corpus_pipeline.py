"""A corpus from raw documents: language, quality, near-duplicates, benchmark passages, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the docs of the next. All but the last return the columns of documents. Every stage judges rows, not ids:
rows that repeat a doc_id, or have none, are judged by their own text. An empty table passes through all
stages; columns that documents don't have by rule pass through too, whatever their names, but for the four
that the last stage adds, which it replaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odweave.llm import decontaminate, language_id, mixing, quality_pu, simhash_dedup
from odweave.plans.storage import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty ones among them), and those too far from every language, go.

    Learns from the known languages of its own input; where no text has one, no document can be told and all go.
    """
    model = language_id.train(docs)
    return docs.filter(~language_id.predict(F.col("text"), model)["rejected"])


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a score under the cut go. Learns from the labels 1 and its own input; without any, all stay. Null texts are scored as empty ones."""
    model = quality_pu.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return docs.filter(quality_pu.score(F.col("text"), model) >= quality_pu.CUT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row of the smallest doc_id stays (nulls last), of several such that of the smallest fingerprint. Texts without words are one group."""
    return simhash_dedup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null texts hold none."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target and taken (words, repeats counted). Null and wordless texts aren't taken; a null source is one of its own."""
    return mixing.mix_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("quality classifier", classify_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
]

#: Three stages are models or hashes that SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return docs

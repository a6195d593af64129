"""From documents to packed training sequences: stages that are each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.lines import deduplicate_lines
from plumbline.llm.mixing import mix_sources
from plumbline.llm.packing import pack_documents
from plumbline.llm.quality import accepted_documents
from plumbline.llm.resemblance import keep_first_of_similar
from plumbline.llm.tables import delete, materialize, recording

#: Words in a shingle of the near-duplicate stage.
SHINGLE_WORDS = 5

#: No SQL: the classifier is trained and the packing is a linear program.
ORACLE_SQL = None


_left: list[str] = []


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes the intermediate tables of the one before, whose result is written by then."""

    @wraps(function)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            delete(spark, _left.pop())
        with recording() as paths:
            done = function(spark, docs, sf_dir)
        _left.extend(paths)
        return done

    return staged


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return accepted_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those of which nothing is left go."""
    kept = deduplicate_lines(docs).where(~F.col("emptied"))
    length = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return kept.select(*[length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


@_stage
def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingle sets of a similarity of 0.8 or more, or near fingerprints."""
    return keep_first_of_similar(docs, width=SHINGLE_WORDS)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, so that sources come near their target shares, in random order."""
    return mix_sources(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in training sequences."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("lines", lines), ("simhash", simhash), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

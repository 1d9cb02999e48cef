"""Corpus pipeline: quality rules, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``.  ``run`` writes each stage's result to the shared folder
and reads it again as the next stage's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roadsift.llm.common import Stored, recorded, store
from roadsift.llm.exact_dedup import drop_exact_duplicates
from roadsift.llm.mixing import take
from roadsift.llm.near_dup import drop_near_duplicates
from roadsift.llm.packing import pack_documents
from roadsift.llm.quality import keep_good
from roadsift.session import ship

#: Tables that the stages so far needed for their results. A result is written before the next
#: stage begins, so the tables of all but the last stage can go when a stage begins.
_left: list[list[Stored]] = []


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        while len(_left) > 1:
            for table in _left.pop(0):
                if table.spark is spark:
                    table.drop()
        with recorded() as tables:
            out = work(spark, docs, sf_dir)
        _left.append(tables)
        return out

    stage.__name__, stage.__doc__ = work.__name__, work.__doc__
    return stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that are frequent on a host go from the others."""
    return keep_good(docs)


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return drop_exact_duplicates(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return drop_near_duplicates(docs)


@_stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last block of a shard may cut one."""
    return take(docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in training sequences."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("source_mixing", source_mixing), ("packing", packing)]

#: Packing's heuristic and the tokenizer are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""A cleaning pipeline over ``documents``: each stage takes (spark, docs, sf_dir) and returns a DataFrame.

1. quality_rules: rejected documents go, frequent lines leave the rest.
2. near_dedup: one document of each group of near copies stays.
3. substring_dedup: passages that an earlier document has are cut out; documents that were nothing else go.
4. secret_scan: secrets are masked; all documents stay.
5. packing: the token sequences.

All but the last return the columns of ``documents``.

Defined results: null and empty texts have no words, so the quality rules reject them; documents with a null id take no part in
near_dedup and substring_dedup and stay; of rows that repeat an id and text one stays; columns beyond those of ``documents`` are
carried along, whatever their names; an empty table gives no piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stateweave.llm import near_dedup, packing, quality_rules, secret_scan, substring_dedup
from stateweave.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.apply(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.apply(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.apply(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.apply(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality), ("near_dedup", near_duplicates), ("substring_dedup", passages), ("secret_scan", secrets), ("packing", pack),
]
#: Chosen paths, compression and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The driver's queries on text corpora.  None has SQL: tests hold them against other implementations."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, mixing, repetition, tokenize

VOCABULARY = os.environ.get("LEDGERLOG_VOCABULARY", bpe.DEFAULT_VOCABULARY)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.encode(_table(spark, folder, "documents"), vocabulary=VOCABULARY)


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Longer texts are likelier, by the root of their length, so that a source is not made of its shortest ones."""
    weight = F.sqrt(F.length("text"))
    return mixing.mix(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"), weight=weight, vocabulary=VOCABULARY)


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(p7_mix(spark, folder), _table(spark, folder, "mix_targets"))


def p7_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.corpus(_table(spark, folder, "documents"), p7_mix(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.repetitive(_table(spark, folder, "documents"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.repetition(_table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_corpus": p7_corpus, "p8_found": p8_found, "p8_shares": p8_shares}


def oracle_sql() -> dict[str, str]:
    return {}

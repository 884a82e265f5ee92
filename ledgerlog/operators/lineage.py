"""Cutting of lineage in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, on one machine, one of our own is set.

    A cluster must name one that all executors reach.
    """
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors reach")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="ledgerlog-checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder, so that it survives lost executors and is not computed again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

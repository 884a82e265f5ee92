"""Encoding of a corpus with the vocabulary of a public byte-level BPE tokenizer."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe


def _text_blocks(column: pa.Array):
    """(first, last + 1, bytes, byte lengths) of blocks of a string column; null counts as empty."""
    lengths = np.zeros(len(column), np.int64)
    if len(column):
        lengths = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for a, b in bpe.blocks(lengths):
        part = column.slice(a, b - a).fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + b - a + 1]
        data = part.buffers()[2]
        yield a, b, (b"" if data is None else memoryview(data)[offsets[0] : offsets[-1]].tobytes()), lengths[a:b]


_sent: set[tuple[str, str]] = set()


def sent(spark: SparkSession, vocabulary: str) -> None:
    """Has the executors get the vocabulary's file from the driver, once per application: they need not have it."""
    context = spark.sparkContext
    if os.path.exists(vocabulary) and (context.applicationId, vocabulary) not in _sent:
        context.addFile(vocabulary)
        _sent.add((context.applicationId, vocabulary))


def received(vocabulary: str) -> str:
    """In a task, where the vocabulary's file is."""
    there = SparkFiles.get(os.path.basename(vocabulary))
    return there if os.path.exists(there) else vocabulary


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` in as many tasks as there are cores, if they lie in fewer files than that and are cut into few pieces.

    A file of one row group is one task's work, however it is cut.  Large tables have more pieces than that, and stay
    as they are: nothing is moved.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows._jdf.rdd().getNumPartitions() <= 2 * cores and len(rows.inputFiles()) < cores:
        return rows.repartition(cores)
    return rows


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """(``id_col``, ids ARRAY<INT>): one row per input row, without special tokens.

    An empty or null text gives an empty list, and a text that spells a special token is ordinary text.  A null id
    stays null, repeated rows are encoded each, an empty table gives an empty one; other columns are not read, so
    their names can't clash.  Whole texts of any length: long ones make a block of their own.  No shuffle, unless the
    table lies in fewer pieces than there are cores.
    """
    id_type = documents.schema[id_col].dataType.simpleString()
    sent(documents.sparkSession, vocabulary)

    def run(batches):
        encoder = bpe.encoder(received(vocabulary))
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a, b, data, lengths in _text_blocks(texts):
                ids, counts = encoder.encode_block(data, lengths)
                offsets = np.zeros(b - a + 1, np.int32)
                np.cumsum(counts, out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), lists], names=["id", "ids"])

    picked = spread(documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    return picked.mapInArrow(run, f"id {id_type}, ids array<int>").select(F.col("id").alias(id_col), "ids")


def count_tokens(documents: DataFrame, text_col: str = "text", vocabulary: str = bpe.DEFAULT_VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` and tokens BIGINT, the number of tokens of each row's text (0 for null and empty)."""
    fields = ", ".join(f"`k{i}` {documents.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    sent(documents.sparkSession, vocabulary)

    def run(batches):
        encoder = bpe.encoder(received(vocabulary))
        for batch in batches:
            counts = [encoder.encode_block(data, lengths, ids=False)[1] for _, _, data, lengths in _text_blocks(batch.column(0))]
            total = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i + 1) for i in range(len(keep))), pa.array(total, pa.int64())], names=[*(f"k{i}" for i in range(len(keep))), "tokens"])

    picked = spread(documents.select(F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep))))
    schema = (fields + ", " if fields else "") + "tokens bigint"
    return picked.mapInArrow(run, schema).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "tokens")

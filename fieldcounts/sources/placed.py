"""Rows that stay where they were written, and are fetched there by their place.

Long values (texts, payloads) need not be shuffled to be chosen from: the
choice is made on digests, and only the places of the chosen rows travel.
``place`` writes a frame once, without a shuffle, under the shared checkpoint
folder; a row's place is the number of the task that wrote it and its position
there.  The files are buckets of the task number, so a join on the place reads
the written side as it lies and deals out the places alone.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

PART, AT = "_part", "_at"


@contextmanager
def _unsorted_buckets(spark: SparkSession):
    """A task's rows all go to one bucket, so writing them needs no sort (true for writes with few open files)."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "2")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def place(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once where its tasks are, with ``_part`` and ``_at``; a bucketed table of the session's catalog.

    Its files lie under the shared checkpoint folder.
    """
    spark = df.sparkSession
    part = F.spark_partition_id()
    at = F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)
    table = f"fieldcounts_{uuid.uuid4().hex}"
    with _unsorted_buckets(spark):
        (df.select("*", part.alias(PART), at.alias(AT)).write.format("parquet")
         .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), PART)
         .option("path", scratch_path(spark, name)).saveAsTable(table))
    return spark.table(table)


def _marks(places: DataFrame) -> DataFrame:
    """One row for each task number: a bit for each chosen position, in 64-bit words.

    A group holds the chosen positions of one task, so it is as bounded as the
    task's rows are; a million rows are 125 KB of bits.
    """
    def mark(group: pa.Table) -> pa.Table:
        at = group.column(AT).to_numpy()
        bits = np.zeros((int(at.max()) // 64 + 1) * 64, dtype=np.uint8)
        bits[at] = 1
        words = np.packbits(bits, bitorder="little").view(np.int64)
        return pa.table({"_task": group.column(PART).slice(0, 1), "_words": pa.array([words], pa.list_(pa.int64()))})

    return places.select(PART, AT).groupBy(PART).applyInArrow(mark, "_task int, _words array<long>")


def fetch(placed: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of ``placed`` at ``places(_part, _at)`` (not NULL); the placed rows are not shuffled."""
    word = F.get("_words", F.shiftright(AT, 6).cast("int"))
    chosen = F.coalesce(F.getbit(word, F.col(AT).bitwiseAND(63).cast("int")) == 1, F.lit(False))
    marks = _marks(places).hint("shuffle_hash")
    return placed.join(marks, placed[PART] == marks["_task"]).filter(chosen).drop(PART, AT, "_task", "_words")


def distinct_by_digest(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``df.select(*keys, text).distinct()``, grouping 128-bit digests of the text instead of the text.

    Texts are read, written and read again where they are; what is shuffled is
    the keys, a digest and a place for each different text of a task.  A NULL
    text is a value of its own.
    """
    digest = F.unhex(F.md5(F.col(text).cast("binary")))
    names = [f"__k{n}" for n in range(len(keys))]            # so that no column of ours meets one of the frame's
    placed = place(df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(text).alias("__text"),
                             digest.alias("__digest")), "texts")
    whole = F.shiftleft(F.col(PART).cast("long"), 33) + F.col(AT)         # one number, for a hash aggregation
    first = placed.groupBy(*names, "__digest").agg(F.min(whole).alias("__first")).select(
        F.shiftright("__first", 33).cast("int").alias(PART), F.col("__first").bitwiseAND((1 << 33) - 1).alias(AT))
    return fetch(placed, first).select(*[F.col(n).alias(k) for k, n in zip(keys, names)], F.col("__text").alias(text))

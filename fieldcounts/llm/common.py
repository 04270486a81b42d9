"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: Rows per Arrow batch for operators on texts, so that a batch of long texts fits a task's memory.
TEXT_BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark (the folder may be in a store that only Spark reaches)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Keep Arrow batches of texts small, and let Python workers of this machine import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared checkpoint folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_length(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with its length column, if it has one, set to the text's length."""
    if length_col not in docs.columns:
        return docs
    kind = docs.schema[length_col].dataType
    return docs.withColumn(length_col, F.length(text_col).cast(kind))


def crc_remainder(column, modulus: int):
    """crc32 of the column's decimal text modulo ``modulus`` (NULL for NULL)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def drawn_ids(rows: DataFrame, by: str, most: int) -> DataFrame:
    """(id, ``by``): up to ``most`` different ids of each value of ``by``, those with the smallest hash.

    A window over all rows of a frequent value would be one task.  Sketches of the ids of each value come first, and
    only ids whose hash lies below about twice the share that is needed go on; a value with few ids keeps them all.
    """
    sizes = rows.groupBy(by).agg(F.approx_count_distinct("id").alias("_ids"))
    # the hash's upper 63 bits as a share of their range
    share = F.shiftrightunsigned(F.xxhash64("id"), 1) / F.lit(float(1 << 63))
    few = (rows.select("id", by).join(F.broadcast(sizes), by)
           .filter((F.col("_ids") <= 2 * most) | (share < 2.0 * most / F.col("_ids")))
           .select("id", by).distinct())
    order = Window.partitionBy(by).orderBy(F.shiftrightunsigned(F.xxhash64("id"), 1), "id")
    return few.withColumn("_turn", F.row_number().over(order)).filter(F.col("_turn") <= most).select("id", by)


def chunks(texts: list, limit: int):
    """Yield (first, last) index ranges of texts with about ``limit`` characters each (at least one text)."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t)
        if i > first and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges(src long, dst long)`` as ``(id, component)``, component the smallest id.

    Every node takes the smallest label among its own and its neighbours',
    then labels are short-cut through the label's own label, until nothing
    changes.  Each round is written to the shared checkpoint folder.  Both
    joins are plain equi-joins, so the adaptive planner can split a hot hub;
    the aggregates combine before their shuffle.  Self-loops are allowed and
    keep isolated nodes.  Empty input gives an empty result.
    """
    both = cut(edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src")))
               .filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), f"{name}-edges")
    labels = cut(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("near"))
                 .select("id", F.least("id", "near").alias("component")), f"{name}-labels")
    while True:
        near = (both.join(labels.select(F.col("id").alias("dst"), "component"), "dst")
                .groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near")))
        hop = (labels.join(near, "id")
               .select("id", "component", F.least("component", "near").alias("low")))
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("lower"))
        step = cut(hop.join(jump, "low", "left")
                   .select("id", F.least("low", F.coalesce("lower", "low")).alias("component"),
                           (F.least("low", F.coalesce("lower", "low")) < F.col("component")).alias("moved")),
                   f"{name}-labels")
        labels = step.select("id", "component")
        if not step.filter("moved").limit(1).count():
            return labels

"""A global 1..N numbering over a total order, without one partition.

``row_number() OVER (ORDER BY ...)`` with no partition moves every row into
one task.  Here the rows are range-partitioned on the order (sampled bounds),
sorted inside each partition, and numbered locally; each partition's offset
is the running sum of the sizes of the partitions before it, computed on a
table with one row per partition and joined back (its size is the number
of partitions, a setting, not the data).

The order must be total (unique keys).  Range bounds come from sampling,
and a second evaluation of the same plan may sample differently, so the
numbered partitions are written once as a Parquet table in the shared
folder named by ``spark.checkpoint.dir`` (one job; an RDD checkpoint would
compute its input twice) and read back: both the sizes and the final rows
read the same materialized numbers, and a lost executor costs a re-read,
not a re-numbering.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def _orders(order: Sequence) -> list[Column]:
    out = []
    for o in order:
        if isinstance(o, str):
            out.append(F.col(o[1:]).desc_nulls_last() if o.startswith("-") else F.col(o).asc_nulls_last())
        else:
            out.append(o)
    return out


def global_sequence(df: DataFrame, order: Sequence, name: str = "seq",
                    num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1..N following ``order`` (strings, ``-col`` for descending, or Columns)."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = _orders(order)
    # explicit partition count: AQE leaves user-numbered repartitions uncoalesced,
    # so the partition id is the range index
    ranged = (df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
              .withColumn("__pid", F.spark_partition_id())
              .withColumn("__pos", F.monotonically_increasing_id()
                          - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    path = scratch_path(spark, "sequence")
    schema = ranged.schema
    ranged.write.parquet(path)
    ranged = spark.read.schema(schema).parquet(path)   # known schema: no footer-reading job
    sizes = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition: an unpartitioned window here touches n rows only
    offsets = sizes.select(
        "__pid", (F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("__off"))
    out = ranged.join(F.broadcast(offsets), "__pid", "left")
    return out.select(*df.columns, (F.coalesce(F.col("__off"), F.lit(0)) + F.col("__pos") + 1).alias(name))

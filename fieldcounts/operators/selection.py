"""Exact medians by selection.

No task holds a group's values.  Equal values are counted together first.  A
sketch of each group's different values gives bounds for about ``BUCKETS``
buckets; the buckets' counts, at most that many rows a group, tell in which one
(or two) the middle lies; and only the values in there are put in order.  The
bounds come from a sketch, but the counts are exact, so the result is.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nullsafe import natural_join

BUCKETS = 64


def medians(df: DataFrame, group: Sequence[str], value: str, name: str = "median", buckets: int = BUCKETS) -> DataFrame:
    """(group, ``name``): the median of the values that are not NULL, as a double; groups without any are left out.

    NULL is a group of its own.  The counts per value, the sketch and the last
    selection read one exchange.
    """
    group = list(group)
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("__v"))
              .agg(F.count(F.lit(1)).alias("__n")))
    bounds = counts.groupBy(*group).agg(
        F.array_distinct(F.percentile_approx("__v", [k / buckets for k in range(1, buckets)], 20 * buckets)).alias("__b"),
        F.sum("__n").alias("__all"))
    placed = natural_join(counts, bounds, group, "inner").withColumn(
        "__bucket", F.size(F.filter("__b", lambda b: b < F.col("__v"))))
    low, high = F.floor((F.col("__all") + 1) / 2), F.floor(F.col("__all") / 2) + 1      # the two middle ranks
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*group, "__bucket").agg(F.sum("__n").alias("__size"), F.first("__all").alias("__all"))
    middle = (sizes.withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0)))
              .filter((F.col("__before") < high) & (F.col("__before") + F.col("__size") >= low))
              .select(*group, "__bucket", "__before"))
    inside = natural_join(placed.select(*group, "__bucket", "__v", "__n", "__all"), middle, [*group, "__bucket"], "inner")
    upto = Window.partitionBy(*group, "__bucket").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("__last", F.col("__before") + F.sum("__n").over(upto))

    def at(rank):
        return F.max(F.when((F.col("__last") - F.col("__n") < rank) & (F.col("__last") >= rank),
                            F.col("__v").cast("double")))
    return ranked.groupBy(*group).agg(at(low).alias("__low"), at(high).alias("__high")).select(
        *group, ((F.col("__low") + F.col("__high")) / 2).alias(name))

"""One text for each key, written as lines and read back.

``write_joined`` puts the rows in order by a range partitioning and streams
each partition into a text file.  A line is a key, the number of the line among
those of the key in this file, and values with the separator between them.
Lines are ended at about ``PIECE`` characters, so a key may have any number of
values and no task holds more than a line and a batch of rows; a key goes on in
the next lines and files.  Range bounds are drawn from short prefixes of the
values, not from whole texts.

The three parts of a line stand between tabs.  Backslashes, line ends and tabs
in keys and values are escaped, a NULL key is ``\\N``, and a NULL value is
written as ``paste`` writes it, ``NA``.  ``read_joined`` puts the lines of a key
together again, in their order: one row for each key, as wide as its text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nullsafe import as_text

PIECE = 1 << 20            # characters of a line, about
PREFIX = 64                # characters of a value that range bounds are drawn from
# What stands for what in a line; the backslash comes first when writing and last when reading.
ESCAPES = [("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]


def _escaped(c: Column) -> Column:
    for plain, written in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def _plain(c: Column) -> Column:
    """Undo ``_escaped``: pairs of backslashes are set aside while the other escapes are undone."""
    parts = F.transform(F.split(c, r"\\\\", -1), lambda part: F.replace(F.replace(F.replace(
        part, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")), F.lit("\\t"), F.lit("\t")))
    return F.array_join(parts, "\\")


def write_joined(df: DataFrame, path: str, key: str, order: list[str], value: str, sep: str = " | ",
                 num_partitions: int | None = None) -> None:
    """Write a line for each ``key`` of ``df``: its values, in the order of ``order`` and then of themselves."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).alias("_sort"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)],
                     as_text(value).alias("_value"))
    keys = ["_sort", *[f"_o{k}" for k in range(len(order))]]
    # ties of the prefix stay in one partition, so the files are in the order of the whole values
    ranged = rows.repartitionByRange(n, *keys, F.substr("_value", F.lit(1), F.lit(PREFIX))).sortWithinPartitions(
        *keys, "_value")
    head = F.coalesce(_escaped(F.col("_sort").cast("string")), F.lit("\\N"))
    lines = ranged.select(head.alias("key"), _escaped(F.col("_value")).alias("value"))

    def stream(batches):
        key, number, held, size = None, 0, [], 0
        for batch in batches:
            out = []
            for k, v in zip(batch.column("key").to_pylist(), batch.column("value").to_pylist()):
                if held and (k != key or size >= PIECE):
                    out.append(f"{key}\t{number}\t{sep.join(held)}")
                    number, held, size = number + 1, [], 0
                if k != key:
                    key, number = k, 0
                held.append(v)
                size += len(v)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([f"{key}\t{number}\t{sep.join(held)}"], pa.string())], ["value"])

    lines.mapInArrow(stream, "value string").write.text(path)


def read_joined(spark: SparkSession, path: str, key: str, kind: str, text: str, sep: str = " | ") -> DataFrame:
    """(key, text): one row for each key of the files under ``path``; ``kind`` is the key's type."""
    parts = F.split("value", "\t")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias("file"),
        parts[0].alias("head"), parts[1].cast("int").alias("line"), parts[2].alias("rest"))
    joined = lines.groupBy("head").agg(
        F.array_sort(F.collect_list(F.struct("file", "line", "rest"))).alias("pieces"))
    value = F.when(F.col("head") != "\\N", _plain(F.col("head"))).cast(kind)
    return joined.select(value.alias(key), _plain(F.array_join(F.col("pieces.rest"), sep)).alias(text))

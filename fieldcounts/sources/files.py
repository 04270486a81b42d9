"""Sources and sinks.

S1 reads a folder of wide survey sheets exported to CSV, one file per survey
date (``YYYY-MM-DD.csv``, a second part of a day as ``YYYY-MM-DD_p2.csv``):
one header line, two rows to skip, then data lines.  A cell may hold line
breaks inside quotes.  Sheets are read by lines and in blocks, so a large sheet
is several tasks; records are put together by the parity of the quotes before
a line, and numbered in their file, so that the first ones can go.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nullsafe import natural_join, sort_keys
from ..session import scratch_path

SKIP_DATA_ROWS = 2
FILES_OF_A_YEAR = 8


def sheet_date(path_col) -> F.Column:
    """Survey date from a sheet's file name: folder, extension and part (``_p2``) removed.

    Files written by Spark with ``partitionBy("date")`` carry the date in
    their folder (``date=YYYY-MM-DD``); that is used when the name has none.
    """
    name = F.regexp_extract(path_col, r"([^/\\]+)$", 1)
    name = F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")
    name = F.regexp_replace(name, r"_p[0-9]+$", "")
    folder = F.regexp_extract(path_col, r"=([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})/[^/]*$", 1)
    return F.coalesce(F.try_to_date(name, "yyyy-M-d"), F.try_to_date(folder, "yyyy-M-d"))


def sheet_records(spark: SparkSession, path: str) -> DataFrame:
    """(__path, __record, __text): the CSV records of the files, numbered from 0 in their file.

    A line starts a record if the quotes before it in its file are even in
    number.  Quotes and starts are counted in each block (a file's split) and
    carried on from block to block on a table with a row for each block; only
    records of several lines are grouped.  The lines are written once, so that
    their numbers hold.  Line breaks inside a cell come back as ``\\n``.
    """
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__line"))
    raw = raw.withColumn("__quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    written = scratch_path(spark, "sheet-lines")
    raw.write.parquet(written)
    lines = spark.read.schema(raw.schema).parquet(written)

    def carried(df: DataFrame, what: str, name: str) -> DataFrame:
        """``name``: the sum of ``what`` over the lines before a line of its file."""
        earlier = Window.partitionBy("__path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        above = Window.partitionBy("__path", "__block").orderBy("__line").rowsBetween(Window.unboundedPreceding, -1)
        blocks = df.groupBy("__path", "__block").agg(F.sum(what).alias("__sum"))
        blocks = blocks.select("__path", "__block", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
        return (df.join(blocks, ["__path", "__block"])
                .withColumn(name, F.col("__base") + F.coalesce(F.sum(what).over(above), F.lit(0))).drop("__base"))

    counted = carried(lines, "__quotes", "__before").withColumn("__starts", (F.col("__before") % 2 == 0).cast("int"))
    counted = carried(counted, "__starts", "__records").withColumn(
        "__record", F.col("__records") + F.col("__starts") - 1)
    alone = (F.col("__starts") == 1) & (F.col("__quotes") % 2 == 0)
    whole = counted.filter(~alone).groupBy("__path", "__record").agg(
        F.array_sort(F.collect_list(F.struct("__block", "__line", "value"))).alias("__lines")).select(
        "__path", "__record", F.array_join("__lines.value", "\n").alias("__text"))
    return counted.filter(alone).select("__path", "__record", F.col("value").alias("__text")).unionByName(whole)


# S1
def read_wide_sheets(spark: SparkSession, path: str, columns: Sequence[str],
                     skip_rows: int = SKIP_DATA_ROWS) -> DataFrame:
    """All sheets of a folder as one wide DataFrame of strings plus ``date``.

    ``columns`` is the template's column list: sheet columns are renamed by
    position.
    """
    body = sheet_records(spark, path).filter(
        (F.col("__record") >= 1 + skip_rows) & (F.length(F.trim("__text")) > 0))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(columns))])
    parsed = body.select(sheet_date(F.col("__path")).alias("date"),
                         F.from_csv(F.col("__text"), schema.simpleString(), {"multiLine": "true", "escape": '"'}).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)], "date")


# S2
def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                   sep: str = ",") -> DataFrame:
    """A delimited file (or folder) with a header; typed by ``schema`` when given."""
    reader = spark.read.option("header", True).option("sep", sep)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


# S3
def write_analysis_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("study_year",),
                         mode: str = "overwrite") -> None:
    """Save the analysis table as Parquet, partitioned (by study year by default)."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def read_analysis_table(spark: SparkSession, path: str, study_years: Sequence[int] | None = None,
                        year: str = "study_year") -> DataFrame:
    """Read the saved analysis table; a year list prunes partitions at the scan."""
    df = spark.read.parquet(path)
    return df if study_years is None else df.filter(F.col(year).isin(list(study_years)))


def write_seasons(df: DataFrame, path: str, year: str = "study_year") -> None:
    """Write the years that ``df`` has into the saved table; all other years stay as they are.

    A manifest beside the data (``_manifest``, which readers of the table pass
    over) has the number of rows of each year.  The rows are dealt by year, and
    within it by their place, so a year's files are few.
    """
    spark = df.sparkSession
    spread = df.repartition(F.col(year), F.pmod(F.monotonically_increasing_id(), F.lit(FILES_OF_A_YEAR)))
    (spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(year).parquet(path))
    counts = df.groupBy(year).agg(F.count(F.lit(1)).alias("n_rows"))
    (counts.repartition(year).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(year).parquet(f"{path}/_manifest"))


def check_seasons(spark: SparkSession, path: str, year: str = "study_year") -> DataFrame:
    """(year, n_rows, n_manifest, whole): the rows found in each year against the manifest (a full join)."""
    found = spark.read.parquet(path).groupBy(year).agg(F.count(F.lit(1)).alias("n_rows"))
    noted = spark.read.parquet(f"{path}/_manifest").select(year, F.col("n_rows").alias("n_manifest"))
    return natural_join(found, noted, [year], "full").withColumn(
        "whole", F.coalesce(F.col("n_rows") == F.col("n_manifest"), F.lit(False)))


def read_seasons(spark: SparkSession, path: str, study_years: Sequence[int] | None = None,
                 year: str = "study_year") -> DataFrame:
    """The saved table (only some years, if given) after checking it against the manifest; fails if a year differs."""
    checked = check_seasons(spark, path, year)
    if study_years is not None:
        checked = checked.filter(F.col(year).isin(list(study_years)))
    wrong = checked.filter(~F.col("whole")).limit(10).collect()
    if wrong:
        raise ValueError(f"years that are not as the manifest says: {sorted(str(r[year]) for r in wrong)}")
    return read_analysis_table(spark, path, study_years, year)


# K1
def write_ordered(df: DataFrame, path: str, keys: Sequence[str], num_partitions: int | None = None) -> None:
    """Write ``df`` in the order of ``keys`` (``"-col"`` descending, NULLs last) as numbered files with their bounds.

    Rows are dealt by ranges of the keys and sorted in each range, so file k
    holds what comes before file k + 1.  ``_bounds`` beside the files has a row
    for each: its number, rows, and first and last key.  Keys must be unique
    for positions to mean something.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.spark_partition_id()
    order = sort_keys(*keys)
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order).select(
        "*", part.alias("__file"), (F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)).alias("__row"))
    rows.write.parquet(path)
    names = [k.lstrip("-") for k in keys]
    key = F.struct(*[F.col(c) for c in names])
    (spark.read.schema(rows.schema).parquet(path).groupBy("__file")
     .agg(F.count(F.lit(1)).alias("n_rows"), F.min_by(key, "__row").alias("first"), F.max_by(key, "__row").alias("last"))
     .coalesce(1).write.parquet(f"{path}/_bounds"))


def read_ordered(spark: SparkSession, path: str, position: str = "position") -> DataFrame:
    """The rows with their position 1..N in the written order."""
    rows = spark.read.parquet(path)
    # a row for each file; an unpartitioned window touches these only
    before = Window.partitionBy(F.lit(1)).orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    bounds = spark.read.parquet(f"{path}/_bounds").select(
        "__file", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(bounds), "__file").withColumn(
        position, F.col("__before") + F.col("__row") + 1).drop("__file", "__row", "__before")


def check_order(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """One row: number of files and rows, and are the files in order?  Reads the files' bounds only."""
    bounds = spark.read.parquet(f"{path}/_bounds")
    last = F.lag("last").over(Window.partitionBy(F.lit(1)).orderBy("__file"))
    ordered = F.lit(True)                              # equal keys are in order
    for k in reversed(list(keys)):
        a, b = F.col("__last")[k.lstrip("-")], F.col("first")[k.lstrip("-")]
        less = (a > b) if k.startswith("-") else (a < b)
        ordered = (F.when(a.eqNullSafe(b), ordered).when(a.isNull(), F.lit(False)).when(b.isNull(), F.lit(True))
                   .otherwise(less))
    pairs = bounds.withColumn("__last", last).withColumn("ok", F.col("__last").isNull() | ordered)
    return pairs.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
                     F.coalesce(F.min(F.col("ok").cast("int")) == 1, F.lit(True)).alias("in_order"))


# S4
def read_database_table(spark: SparkSession, url: str, table: str, properties: dict | None = None,
                        partition_column: str | None = None, lower_bound: int | None = None,
                        upper_bound: int | None = None, num_partitions: int | None = None,
                        trim: bool = True) -> DataFrame:
    """One table of a database over JDBC (the driver jar must be on the classpath).

    With ``partition_column`` and bounds the read is split into
    ``num_partitions`` parallel range queries; string columns are trimmed.
    """
    props = dict(properties or {})
    if partition_column is not None:
        df = spark.read.jdbc(url, table, column=partition_column, lowerBound=lower_bound,
                             upperBound=upper_bound, numPartitions=num_partitions, properties=props)
    else:
        df = spark.read.jdbc(url, table, properties=props)
    if not trim:
        return df
    return df.select(*[F.trim(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType)
                       else F.col(f.name) for f in df.schema.fields])


# S5
def write_csv_table(df: DataFrame, path: str, mode: str = "overwrite", sep: str = ",") -> None:
    """A summary export: CSV with a header, one folder per table (each its own path)."""
    df.write.mode(mode).option("header", True).option("sep", sep).csv(path)

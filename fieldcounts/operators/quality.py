"""Data checks: duplicates, value checks, frequency tables, coverage and
reconciliation between tables (SURVEY §2.5 A26/A29, §2.6 W8, §2.8 U4-U7,
§2.4 F8-F9).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nullsafe import in_set, natural_join


def one_row(*frames: DataFrame) -> DataFrame:
    """Put the single row of several one-row aggregates side by side.

    Each frame is turned into (metric, value) pairs, stacked and pivoted
    back; no join is needed.  Values become LongType.
    """
    names: list[str] = []
    parts = []
    for f in frames:
        cols = f.columns
        names += cols
        parts.append(f.select(*[F.col(c).cast("long").alias(c) for c in cols])
                     .unpivot([], cols, "__metric", "__value"))
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    return stacked.groupBy().pivot("__metric", names).agg(F.first("__value")).select(*names)


# W8
def duplicate_records(obs: DataFrame, keys: Sequence[str] = ("visit_date", "alpha_code", "section")) -> DataFrame:
    """Rows whose key occurs more than once, with the number of rows of that key.

    Counts are aggregated map-side, then only keys seen twice are joined
    back; a hot key is handled by AQE's skew-join split of the big side.
    """
    keys = list(keys)
    counts = obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_rec")).filter(F.col("num_rec") > 1)
    return natural_join(obs, counts, keys, "inner")


# F8
def negative_counts(records: DataFrame, value: str = "count") -> DataFrame:
    return records.filter(F.col(value) < 0)


def low_proof(records: DataFrame, level: str = "proof_level", below: int = 2) -> DataFrame:
    return records.filter(F.col(level) < below)


def spot_check(records: DataFrame, date, codes: Sequence[str], cols: Sequence[str],
               date_col: str = "visit_date", code: str = "species") -> DataFrame:
    """The records of one date and code set, selected columns."""
    return records.filter((F.col(date_col) == F.lit(date).cast("date")) & in_set(code, codes)).select(*cols)


# F9
def pooled_negatives(records: DataFrame, pooled: Sequence[str], value: str = "count", code: str = "species",
                     cols: Sequence[str] = ("visit_date", "block", "species", "count")) -> DataFrame:
    """Negative counts of pooled taxa, flagged (flag = membership in ``pooled``)."""
    neg = negative_counts(records, value).withColumn("pooled_spp", in_set(code, pooled).cast("int"))
    return neg.filter(F.col("pooled_spp") == 1).select(*cols, "pooled_spp")


# A26
def frequency(records: DataFrame, *cols: str) -> DataFrame:
    """One-way (or n-way, present combinations only) counts."""
    return records.groupBy(*cols).agg(F.count(F.lit(1)).alias("freq"))


def crosstab_full(records: DataFrame, row: str, col: str, values: Sequence | None = None) -> DataFrame:
    """Two-way table with zero cells: one row per ``row`` value, one column per ``col`` value.

    With ``values``, all other values are counted together as ``unlisted``.
    One aggregation pass, counted map-side, unlike ``DataFrame.crosstab``,
    which gathers the counts on the driver.
    """
    if values is None:
        piv = records.groupBy(row).pivot(col).agg(F.count(F.lit(1)))
        cells = [c for c in piv.columns if c != row]
        return piv.select(row, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long").alias(c) for c in cells])
    listed = F.coalesce(F.col(col).isin(list(values)), F.lit(False))
    return records.groupBy(row).agg(*[F.count(F.when(F.col(col) == v, 1)).alias(str(v)) for v in values],
                                    F.count(F.when(~listed, 1)).alias("unlisted"))


def crosstab_long(records: DataFrame, row: str, col: str, spread: int = 16) -> DataFrame:
    """Two-way table with zero cells as long rows: a row for each (``row`` value, ``col`` value), ``freq`` 0 or more.

    Neither list of values is gathered: the different ``col`` values are dealt
    into ``spread`` parts, every ``row`` value meets each part, and the grid's
    zeros are added to the counted cells.  NULL is a value on both sides.
    """
    cells = frequency(records, row, col)
    part = F.pmod(F.xxhash64(col), F.lit(spread)).cast("int")
    cols = cells.groupBy(col).agg(F.lit(0).alias("__z")).select(F.col(col).alias("__col"), part.alias("__part"))
    rows = cells.groupBy(row).agg(F.lit(0).alias("__z")).select(
        F.col(row).alias("__row"), F.explode(F.array(*[F.lit(k) for k in range(spread)])).alias("__part"))
    grid = rows.join(cols, "__part").select(F.col("__row").alias(row), F.col("__col").alias(col),
                                            F.lit(0).cast("long").alias("freq"))
    return grid.unionByName(cells).groupBy(row, col).agg(F.sum("freq").alias("freq"))


def frequency_over(records: DataFrame, cols: Sequence[str], more_than: int = 1) -> DataFrame:
    """Present combinations counted more than ``more_than`` times."""
    return frequency(records, *cols).filter(F.col("freq") > more_than)


# A29
def missed_by_block(status: DataFrame, block: str = "block", label: str = "not surveyed") -> DataFrame:
    return (status.filter(F.col("surveyed") == label).groupBy(block)
            .agg(F.count(F.lit(1)).alias("n_missed")))


def missed_rows(status: DataFrame, date: str = "visit_date", block: str = "block",
                label: str = "not surveyed") -> DataFrame:
    """The missed (date, block) pairs themselves; order by date and block at a sink."""
    return status.filter(F.col("surveyed") == label).select(date, block).distinct()


def exclude_dates(records: DataFrame, dates: Sequence[str], date: str = "visit_date") -> DataFrame:
    """Records of all but the given dates (records without a date stay)."""
    return records.filter(~in_set(date, [F.lit(d).cast("date") for d in dates]))


# U4
def row_count_invariants(surveys: DataFrame, transects: DataFrame, blocks: DataFrame, observations: DataFrame,
                         n_taxa: int, pairs: DataFrame) -> DataFrame:
    """Row-count identities of the relational model, as one row of counts and checks.

    ``pairs`` are the covered (survey date, block) pairs (``coverage_pairs``).
    The last check compares dates x blocks with the missed pairs and the rows
    of the block table, which come from different tables.
    """
    r = one_row(
        surveys.agg(F.count(F.lit(1)).alias("n_surveys")),
        transects.agg(F.count(F.lit(1)).alias("n_transects")),
        blocks.agg(F.count(F.lit(1)).alias("n_blocks"),
                   F.countDistinct("date_transect_key").alias("n_block_transect_keys")),
        observations.agg(F.count(F.lit(1)).alias("n_observations")),
        pairs.agg(F.countDistinct("survey_date").alias("n_dates"), F.countDistinct("temp_block").alias("n_coverage_blocks"),
                  F.count(F.lit(1)).alias("n_covered")))
    cells = F.col("n_dates") * F.col("n_coverage_blocks")
    r = r.withColumn("n_missed", cells - F.col("n_covered"))
    return r.select(
        "n_surveys", "n_transects", "n_blocks", "n_observations", "n_block_transect_keys", "n_dates",
        "n_coverage_blocks", "n_covered", "n_missed",
        (F.col("n_block_transect_keys") == F.col("n_transects")).alias("keys_match_transects"),
        (F.col("n_transects") == 3 * F.col("n_surveys")).alias("three_transects_per_survey"),
        (F.col("n_observations") == F.col("n_blocks") * n_taxa).alias("observations_are_blocks_x_taxa"),
        (cells == F.col("n_missed") + F.col("n_blocks")).alias("coverage_adds_up"))


# U5
def compare_status_matrix(new: DataFrame, old: DataFrame, blocks: Sequence[str] | None = None,
                          date: str = "visit_date") -> DataFrame:
    """Cells that differ between two date x block status tables (NULL-aware); all columns but the date, or ``blocks``."""
    every = list(blocks) if blocks is not None else list(dict.fromkeys(
        c for c in [*new.columns, *old.columns] if c != date))

    def long(df, name):
        present = [b for b in every if b in df.columns]
        return df.unpivot([date], [F.col(f"`{b}`").cast("string") for b in present], "block", name)
    j = natural_join(long(new, "new_status"), long(old, "old_status"), [date, "block"], "full")
    return j.filter(~F.col("new_status").eqNullSafe(F.col("old_status")))


# U6
def reconcile_presence(table_keys: DataFrame, query_rows: DataFrame, date: str = "visit_date",
                       block: str = "block") -> DataFrame:
    """Full join of (date, block) presence in two sources; mismatches only."""
    a = table_keys.select(date, block).distinct().withColumn("in_tbl_block", F.lit(1))
    b = query_rows.select(date, block).distinct().withColumn("in_query", F.lit(1))
    j = natural_join(a, b, [date, block], "full")
    j = j.select(date, block, F.coalesce("in_tbl_block", F.lit(0)).alias("in_tbl_block"),
                 F.coalesce("in_query", F.lit(0)).alias("in_query"))
    return j.filter(F.col("in_tbl_block") != F.col("in_query"))


# U7
def key_mismatch(df: DataFrame, key: str, lookup: str) -> DataFrame:
    """Rows whose ``lookup`` (a regex, "." matches anything) does not occur in ``key``."""
    trimmed = df.select(*[F.trim(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    match = F.regexp_like(F.col(key), F.col(lookup))
    return trimmed.withColumn("match", match).filter((F.col("match") == F.lit(False)) & F.col(key).isNotNull())

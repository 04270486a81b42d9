"""Reshaping, keys and the relational survey model.

Wide survey sheets and the old wide table become long tables with
``unpivot``; wide reports are built with ``pivot`` over an explicit value
list (one pass, stable schema) or, when no list is given, over the distinct
values Spark gathers itself (bounded by the pivot column's cardinality).
"""

from __future__ import annotations

import re
from itertools import zip_longest
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nullsafe import as_text, if_else, natural_join, paste, strict_sum
from .sequence import global_sequence

# Name repairs applied in this order before splitting sheet columns.
SHEET_NAME_REPAIRS = [("cypressgrove", "cypressgrove.a"), ("inverness", "inverness.a"),
                      ("walkercreek", "walkercreek.a"), ("bivalve", "bivalve.a")]

# The block dimension.  Boats 1-3 are the east, middle and west
# transects over boat sections 1-4; land sections 5-9 belong to a boat's shore.
BOAT_TRANSECTS = [(1, "east"), (2, "middle"), (3, "west")]
BOAT_SECTIONS = [1, 2, 3, 4]
LAND_BLOCKS = [(5, "walker_creek", "east", 1), (6, "cypress_grove", "east", 1),
               (7, "millerton_bivalve", "east", 1), (8, "bivalve", "east", 1),
               (9, "inverness", "west", 3)]

# The taxon columns of the old wide table, in its order.
OLD_TABLE_TAXA = ["COLO", "PALO", "PACOLO", "RTLO", "RTPALO", "LOON", "HOGR", "EAGR", "EAHOGR", "WEGR", "CLGR",
                  "WECLGR", "RNGR", "PBGR", "AWPE", "BRPE", "DCCO", "BRCO", "PECO", "CORM", "GBHE", "GREG", "SNEG",
                  "GRHE", "BCNH", "CAGO", "ROGO", "BRAN", "MALL", "GADW", "NOPI", "GWTE", "CITE", "AMWI", "EUWI",
                  "NOSH", "REHE", "CANV", "RNDU", "GRSC", "LESC", "SCAUP", "COGO", "BAGO", "BUFF", "HADU", "WWSC",
                  "SUSC", "SCOTER", "BLSC", "OLDS", "RUDU", "HOME", "RBME", "COME", "OSPR", "PEFA", "NOHA", "COMO",
                  "AMCO", "REPH", "BOGU", "FOTE", "COMU", "RHAU", "PIGU", "CAAU", "BEKI", "KAYAK", "WODU", "KIEI",
                  "GWFG", "AMCOGRSCLESCBUFF", "COMERBME", "MUSW"]

BLOCK_SCHEMA = T.StructType([
    T.StructField("transect", T.StringType()), T.StructField("BOAT", T.IntegerType()),
    T.StructField("SECTION", T.IntegerType()), T.StructField("survey_block", T.StringType()),
    T.StructField("survey_type", T.StringType())])


def sheet_name_parts(name: str) -> tuple:
    """(section, transect, field) of a sheet column name: the ordered repairs,
    then a split on runs of non-alphanumerics; missing pieces are None and
    pieces past the third are dropped (as ``separate`` does)."""
    for old, new in SHEET_NAME_REPAIRS:
        name = re.sub(old, new, name)
    parts = re.split(r"[^A-Za-z0-9]+", name)
    return tuple((parts + [None, None, None])[:3])


# R1
def wide_sheets_to_tally(wide: DataFrame, ids: Sequence[str] = ("index", "date")) -> DataFrame:
    """Unpivot ``<section>_<transect>_species|tally`` pairs to one row per tally line.

    The section / transect / field of a column depend on its name only, so
    they are parsed once from the schema.  Each section's species and tally
    columns are unpivoted together as one pair, so the rows come out whole:
    no re-pivot, no aggregation, no shuffle.  A line whose species and tally
    are both missing is dropped; one missing half stays missing.  Sections
    whose repaired names are equal stay pairs of their own: the first species
    column goes with the first tally column, and so on.
    """
    columns: dict[tuple, dict[str, list]] = {}
    for c in wide.columns:
        if c in ids or not ("species" in c or "tally" in c):
            continue
        sec, tr, fld = sheet_name_parts(c)
        if fld in ("species", "tally"):
            columns.setdefault((sec, tr), {"species": [], "tally": []})[fld].append(c)
    pairs = [(place, dict(zip(("species", "tally"), pair)))
             for place, found in columns.items() for pair in zip_longest(found["species"], found["tally"])]
    cell = "struct<section:string,transect:string,species:string,tally:string>"

    def val(name):
        return F.col(f"`{name}`").cast("string") if name is not None else F.lit(None).cast("string")

    vals = [F.struct(F.lit(sec).cast("string").alias("section"), F.lit(tr).cast("string").alias("transect"),
                     val(cols.get("species")).alias("species"), val(cols.get("tally")).alias("tally")).cast(cell)
            for (sec, tr), cols in pairs]
    long = wide.unpivot(list(ids), vals, "__name", "__cell")
    out = long.select(*ids, "__cell.section", "__cell.transect", "__cell.species", "__cell.tally")
    return out.filter(F.col("species").isNotNull() | F.col("tally").isNotNull())


# R2
def build_block_dimension(spark: SparkSession) -> DataFrame:
    """The 17 survey blocks: 3 boats x 4 sections, plus 5 land blocks."""
    rows = [(t, b, s, f"{t}.sec{s}", "boat") for s in BOAT_SECTIONS for b, t in BOAT_TRANSECTS]
    rows += [(t, b, s, f"{t}.{name}", "land") for s, name, t, b in LAND_BLOCKS]
    return spark.createDataFrame(rows, BLOCK_SCHEMA)


def _mdy_text(m="MONTH", d="DAY", y="YEAR") -> Column:
    return paste(m, d, y, sep="-")


def _fill(df: DataFrame, value, cols: Sequence[str] | None, kinds: tuple) -> DataFrame:
    """NULL -> ``value`` in ``cols`` (default: every column of a matching type); names may hold dots."""
    targets = set(cols) if cols is not None else {f.name for f in df.schema.fields
                                                  if isinstance(f.dataType, kinds)}
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(value).cast(df.schema[c].dataType)).alias(c)
                       if c in targets else F.col(f"`{c}`") for c in df.columns])


# R5
def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return _fill(df, 0, cols, (T.NumericType,))


# R6
def fill_label(df: DataFrame, label: str = "no record", cols: Sequence[str] | None = None) -> DataFrame:
    return _fill(df, label, cols, (T.StringType,))


# R3 (+ R4, R5)
def key_wide_table(wide: DataFrame, blocks: DataFrame, taxa_cols: Sequence[str] = OLD_TABLE_TAXA) -> DataFrame:
    """Full join with the block dimension, date key, sequence-prefixed composite keys.

    The full join is a left join against the block table plus the block rows
    no wide row matched; the planner measures the block table and broadcasts
    it if small, so the wide table is not shuffled for the join.  Rows are
    numbered by date, section, boat and, where it is there, ID.
    """
    keys = ["BOAT", "SECTION"]
    left = natural_join(wide, blocks, keys, "left")
    seen = wide.select(*keys).distinct()
    unmatched = natural_join(blocks, seen, keys, "left_anti")
    for c in wide.columns:
        if c not in unmatched.columns:
            unmatched = unmatched.withColumn(c, F.lit(None).cast(wide.schema[c].dataType))
    joined = left.unionByName(unmatched.select(*left.columns))
    joined = joined.withColumn("date_key", F.try_to_date(_mdy_text(), "M-d-yyyy"))
    order = ["date_key", "SECTION", "BOAT"] + [c for c in ("ID",) if c in joined.columns]
    seq = global_sequence(joined, order, "__seq")
    keyed = seq.select(
        F.concat_ws(".", F.col("__seq").cast("string"), _mdy_text(), as_text("survey_block"))
        .alias("date_transect_block_key"),
        F.concat_ws(".", _mdy_text(), as_text("transect")).alias("date_transect_key"),
        "date_key", "survey_block", "survey_type", "BOAT", "SECTION",
        *[c for c in joined.columns if c not in ("date_key", "survey_block", "survey_type", "BOAT", "SECTION")])
    return fill_zero(keyed, taxa_cols)


# R7
def derive_surveys(keyed: DataFrame) -> DataFrame:
    s = keyed.select("date_key", "MONTH", "DAY", "YEAR").distinct()
    m, y = F.col("MONTH"), F.col("YEAR")
    return s.withColumn("season", F.when(m > 6, y).when(m <= 6, y - 1)).withColumn("survey_notes", F.lit(""))


# R8
def derive_transects(keyed: DataFrame) -> DataFrame:
    return keyed.select("date_transect_key", "transect", "date_key").distinct()


# R9
def derive_blocks(keyed: DataFrame) -> DataFrame:
    """Block table: merged notes, proof level coded 0/1/2, blank observer count."""
    log, notes = F.col("WATERBIRDLOG"), F.col("NOTES")
    merged = if_else(log == "", notes, paste("NOTES", "WATERBIRDLOG", sep=". "))
    pl = F.lower(F.col("PROOF_LEVEL"))
    pl_num = if_else(pl == "", F.lit(0), if_else(pl == "ep", F.lit(1), F.lit(2)))
    return keyed.select(
        "date_transect_block_key", "date_transect_key", "survey_block", "survey_type", "BEAUFORT",
        F.lit(None).cast("double").alias("number_observers"), merged.alias("block_notes"),
        F.col("Initials").alias("entered_by"), pl_num.cast("int").alias("proof_level_num"))


def count_type(wide: DataFrame, cols: Sequence[str]) -> T.DataType:
    """The type that holds the counts of all columns: whole numbers as long, else decimals, else doubles."""
    kinds = [wide.schema[c].dataType for c in cols]
    if all(isinstance(k, T.IntegralType) for k in kinds):
        return T.LongType()
    decimals = [k for k in kinds if isinstance(k, T.DecimalType)]
    if len(decimals) + sum(isinstance(k, T.IntegralType) for k in kinds) < len(kinds):
        return T.DoubleType()
    scale = max(k.scale for k in decimals)
    whole = max([k.precision - k.scale for k in decimals] + [19] * (len(kinds) > len(decimals)))
    return T.DecimalType(min(38, whole + scale), scale)


# R10
def derive_observations(keyed: DataFrame, taxa_cols: Sequence[str] = OLD_TABLE_TAXA) -> DataFrame:
    """One row per (block, taxon) with a global observation id in (key, species) order.

    Every block has the same taxa, so the blocks alone are numbered by their
    key; a row's id is the block's number and the taxon's place in sorted
    order.  The long table is neither shuffled nor written.
    """
    key, taxa = "date_transect_block_key", sorted(taxa_cols)
    kind = count_type(keyed, taxa)
    ranked = global_sequence(keyed.select(key, *[F.col(f"`{t}`") for t in taxa]), [key], "__block")
    cells = [F.struct(F.lit(t).alias("species"), F.col(f"`{t}`").cast(kind).alias("count"),
                      F.lit(k + 1).alias("place")) for k, t in enumerate(taxa)]
    long = ranked.select(key, "__block", F.explode(F.array(*cells)).alias("c"))
    return long.select(key, "c.species", "c.count",
                       ((F.col("__block") - 1) * len(taxa) + F.col("c.place")).alias("observation_id"))


# R11
def rebuild_full_long(surveys: DataFrame, transects: DataFrame, blocks: DataFrame,
                      observations: DataFrame) -> DataFrame:
    st = natural_join(surveys, transects, ["date_key"], "full")
    stb = natural_join(st, blocks, ["date_transect_key"], "full")
    return stb.join(observations, "date_transect_block_key", "inner")


LONG_COLUMNS = ["date_transect_block_key", "date_transect_key", "date_key", "survey_block", "survey_type",
                "species", "count"]


# R12
def unpivot_keyed_wide(keyed: DataFrame, taxa_cols: Sequence[str] = OLD_TABLE_TAXA) -> DataFrame:
    ids = ["date_transect_block_key", "date_transect_key", "date_key", "survey_block", "survey_type"]
    long = keyed.unpivot(ids, list(taxa_cols), "species", "count")
    return long.withColumn("count", F.col("count").cast(count_type(keyed, taxa_cols))).select(*LONG_COLUMNS)


# R13
def parse_block_key(block_table: DataFrame, key: str = "date_transect_block_key") -> DataFrame:
    """Split ``n.M-D-YYYY.a.b`` keys; rebuild block names; parse the date.

    Output names follow the reference (``block`` is the transect part and
    ``transect`` the block part of the key).
    """
    parts = F.split(F.col(key), "\\.")
    b = block_table.filter(F.col(key).isNotNull()).withColumn(key, F.col(key).cast("string"))
    b = b.select(*[c for c in block_table.columns if c != key],
                 F.get(parts, 0).alias("znum"), F.get(parts, 1).alias("date"),
                 F.get(parts, 2).alias("block"), F.get(parts, 3).alias("transect"))
    sec = F.coalesce(F.col("transect").rlike("sec"), F.lit(False))
    return (b.withColumn("surveyblock", paste("block", "transect", sep="."))
            .withColumn("surveyblock2", F.when(sec, paste("block", "transect", sep=".")).otherwise(F.col("transect")))
            .withColumn("date", F.try_to_date(F.col("date"), "M-d-yyyy"))
            .withColumn("block_tbl", F.lit(1)))


# R14
def coverage_pairs(wide: DataFrame) -> DataFrame:
    """The different (survey date, ``BOAT.SECTION``) of the table."""
    return wide.select(F.try_to_date(_mdy_text(), "M-d-yyyy").alias("survey_date"),
                       paste("BOAT", "SECTION", sep=".").alias("temp_block")).distinct()


def coverage_matrix(wide: DataFrame, blocks: Sequence[str]) -> DataFrame:
    """Survey date x block: 1 when any row exists, else 0; ``unlisted`` counts blocks outside the list."""
    hit = [F.max(F.when(F.col("temp_block") == b, 1).otherwise(0)).alias(b) for b in blocks]
    other = F.sum(F.when(F.col("temp_block").isin(list(blocks)), 0).otherwise(1)).cast("int").alias("unlisted")
    return coverage_pairs(wide).groupBy("survey_date").agg(*hit, other)


# R15
def coverage_totals(wide: DataFrame) -> DataFrame:
    """Days surveyed per block (column sums of R14), as (block, total)."""
    return coverage_pairs(wide).groupBy(F.col("temp_block").alias("block")).agg(
        F.count(F.lit(1)).alias("days_surveyed"))


def coverage_long(wide: DataFrame, blocks: Sequence[str]) -> DataFrame:
    """R14 in long form: a row per survey date and listed block, and per unlisted block that occurs."""
    pairs = coverage_pairs(wide)
    per_date = pairs.groupBy("survey_date").agg(F.collect_set("temp_block").alias("seen"))   # blocks of one date
    every = F.array_distinct(F.concat(F.array(*[F.lit(b) for b in blocks]), F.col("seen")))
    return per_date.select("survey_date", "seen", F.explode(every).alias("b")).select(
        "survey_date", F.col("b").try_cast("double").alias("section"),
        F.array_contains("seen", F.col("b")).cast("int").alias("done"))


# R16
STATUS_LABELS = ["surveyed", "not surveyed", "surveyed, no birds obs", "conflicting records"]


def _status_label(code: Column) -> Column:
    out = None
    for i, lab in enumerate(STATUS_LABELS, start=1):
        out = F.when(code == i, F.lit(lab)) if out is None else out.when(code == i, F.lit(lab))
    return out


def _status_code() -> Column:
    """1 surveyed, 2 not surveyed, 3 surveyed with no birds (the second test overrides; NA stays NA)."""
    first = if_else(F.col("area_not_surveyed") == 0, F.lit(1), F.lit(2))
    return if_else(F.col("no_birds_observed") == 1, F.lit(3), first)


def status_matrix(status_rows: DataFrame, blocks: Sequence[str], date: str = "visit_date",
                  block: str = "block", boat_markers: Sequence[str] = ("east.sec", "middle.sec", "west.sec"),
                  label: str = "no record") -> DataFrame:
    """Date x block survey status; boat blocks first; no row -> ``label``.

    A (date, block) whose records disagree is labelled as conflicting, and
    ``unlisted`` counts the date's blocks outside the list.  Numeric status
    codes are aggregated (hash aggregation) and mapped to labels afterwards.
    """
    s = status_rows.select(date, block, "area_not_surveyed", "no_birds_observed").distinct()
    code = F.coalesce(_status_code(), F.lit(0))          # 0: a flag is missing
    s = s.groupBy(date, block).agg(F.min(code).alias("__low"), F.max(code).alias("__high")).withColumn(
        "__code", F.when(F.col("__low") == F.col("__high"), F.col("__high")).otherwise(len(STATUS_LABELS)))
    ordered = [b for m in boat_markers for b in blocks if m in b]
    ordered += [b for b in blocks if b not in ordered]
    wide = s.groupBy(date).agg(
        *[F.max(F.when(F.col(block) == b, F.col("__code"))).alias(b) for b in ordered],
        F.count(F.when(~F.coalesce(F.col(block).isin(list(blocks)), F.lit(False)), 1)).alias("unlisted"))
    cells = [_status_label(F.col(f"`{b}`")).alias(b) for b in ordered]
    return fill_label(wide.select(date, *cells, "unlisted"), label, ordered)


def status_long(status_rows: DataFrame, date: str = "visit_date", block: str = "block") -> DataFrame:
    """Long form of the R16 status (one row per visited date and block)."""
    s = status_rows.select(date, block, "area_not_surveyed", "no_birds_observed").distinct()
    return s.withColumn("surveyed", _status_label(_status_code()))


# R19
def mean_median_series(season_means: DataFrame, code_value: str, code: str = "alpha_code",
                       year: str = "study_year") -> DataFrame:
    one = season_means.filter(F.col(code) == code_value)
    long = one.unpivot([year, code], ["mean_abund", "med_abund"], "mean_median", "value")
    return long.withColumn("mean_median", F.when(F.col("mean_median") == "mean_abund", "Mean").otherwise("Median"))


# R20
def old_day_total(wide: DataFrame, taxon: str, month: int | None = None, day: int | None = None,
                  year: int | None = None, per_date: bool = False) -> DataFrame:
    """The selected rows with the taxon's total over all of them on every row (NULL if a count is missing).

    The total is one aggregate, read as a scalar subquery, so no row moves.
    ``per_date`` gives each date its own total instead: one aggregate by date,
    joined back.
    """
    w = wide
    for c, v in (("MONTH", month), ("DAY", day), ("YEAR", year)):
        if v is not None:
            w = w.filter(F.col(c) == v)
    if per_date:
        dates = ["YEAR", "MONTH", "DAY"]
        w = natural_join(w, w.groupBy(*dates).agg(strict_sum(taxon).alias("spp_total")), dates, "left")
        total = F.col("spp_total")
    else:
        total = w.agg(strict_sum(taxon).alias("spp_total")).scalar().alias("spp_total")
    return w.select("MONTH", "DAY", "YEAR", "SECTION", "BOAT", taxon, total)


# U3
def tables_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: same schema?, rows only in a, rows only in b, equal?  (One shuffle: +1 and -1 per row, summed.)"""
    same_schema = [(f.name, f.dataType) for f in a.schema.fields] == [(f.name, f.dataType) for f in b.schema.fields]
    both = a.withColumn("__d", F.lit(1)).unionByName(b.select(*a.columns).withColumn("__d", F.lit(-1)))
    rest = both.groupBy(*a.columns).agg(F.sum("__d").alias("d"))
    out = rest.agg(F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("only_in_a"),
                   F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("only_in_b"))
    return out.select(F.lit(same_schema).alias("same_schema"), "only_in_a", "only_in_b",
                      (F.lit(same_schema) & (F.col("only_in_a") == 0) & (F.col("only_in_b") == 0)).alias("equal"))


def numbering_check(numbered: DataFrame, name: str, group: str, per_group: int) -> DataFrame:
    """One row: are the numbers 1..N, each once, and does every group have ``per_group`` numbers in a row?"""
    groups = numbered.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("low"),
                                         F.max(name).alias("high"))
    out = groups.agg(F.sum("n").alias("n_rows"), F.min("low").alias("first_number"), F.max("high").alias("last_number"),
                     F.countDistinct("low").alias("n_starts"), F.count(F.lit(1)).alias("n_groups"),
                     F.min(((F.col("high") - F.col("low") + 1 == F.col("n")) & (F.col("n") == per_group))
                           .cast("int")).alias("whole"))
    good = ((F.col("first_number") == 1) & (F.col("last_number") == F.col("n_rows"))
            & (F.col("n_starts") == F.col("n_groups")) & (F.col("whole") == 1))
    return out.select("n_rows", "first_number", "last_number", good.alias("numbered_in_order"))

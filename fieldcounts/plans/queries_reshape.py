"""Bound queries: wide sheets, the relational survey model, coverage tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.nullsafe import arrange
from ..operators import reshape as RS
from ..operators import quality as Q
from ..operators.identity import tables_identical
from . import views as V
from .catalog import register

TAXA = V.TAXON_TYPES


def _blocks_values_sql():
    rows = [f"('{t}', {b}, {s}, '{t}.sec{s}', 'boat')" for s in RS.BOAT_SECTIONS for b, t in RS.BOAT_TRANSECTS]
    rows += [f"('{t}', {b}, {s}, '{t}.{n}', 'land')" for s, n, t, b in RS.LAND_BLOCKS]
    return ("blocks AS (SELECT transect, CAST(BOAT AS INTEGER) AS BOAT, CAST(SECTION AS INTEGER) AS SECTION, "
            "survey_block, survey_type FROM (VALUES " + ", ".join(rows) +
            ") t(transect, BOAT, SECTION, survey_block, survey_type))")


_MDY = ("coalesce(CAST(MONTH AS VARCHAR), 'NA') || '-' || coalesce(CAST(DAY AS VARCHAR), 'NA') || '-' || "
        "coalesce(CAST(YEAR AS VARCHAR), 'NA')")
_REST = ["ID", "MONTH", "DAY", "YEAR", "BEAUFORT", "NOTES", "WATERBIRDLOG", "PROOF_LEVEL", "Initials"]

SQL_KEYED = V.SQL_OLD_WIDE + ",\n" + _blocks_values_sql() + f""",
wj AS (SELECT w.*, b.transect, b.survey_block, b.survey_type FROM old_wide w
       LEFT JOIN blocks b ON w.BOAT = b.BOAT AND w.SECTION = b.SECTION
       UNION ALL BY NAME
       SELECT b.* FROM blocks b WHERE NOT EXISTS
         (SELECT 1 FROM old_wide w WHERE w.BOAT = b.BOAT AND w.SECTION = b.SECTION)),
wk AS (SELECT *, {_MDY} AS mdy, CAST(try_strptime({_MDY}, '%m-%d-%Y') AS DATE) AS date_key FROM wj),
keyed AS (
  SELECT CAST(row_number() OVER (ORDER BY date_key ASC NULLS LAST, SECTION, BOAT, ID) AS VARCHAR) || '.' || mdy
           || '.' || coalesce(survey_block, 'NA') AS date_transect_block_key,
         mdy || '.' || coalesce(transect, 'NA') AS date_transect_key,
         date_key, survey_block, survey_type, BOAT, SECTION, {", ".join(_REST)},
         {", ".join(f"coalesce({t}, 0) AS {t}" for t in TAXA)}, transect
  FROM wk),
surveys AS (SELECT DISTINCT date_key, MONTH, DAY, YEAR,
              CAST(CASE WHEN MONTH > 6 THEN YEAR WHEN MONTH <= 6 THEN YEAR - 1 END AS INTEGER) AS season,
              '' AS survey_notes FROM keyed),
transects AS (SELECT DISTINCT date_transect_key, transect, date_key FROM keyed),
blocktbl AS (
  SELECT date_transect_block_key, date_transect_key, survey_block, survey_type, BEAUFORT,
         CAST(NULL AS DOUBLE) AS number_observers,
         CASE WHEN WATERBIRDLOG = '' THEN NOTES
              WHEN NOT (WATERBIRDLOG = '') THEN coalesce(NOTES, 'NA') || '. ' || coalesce(WATERBIRDLOG, 'NA') END
           AS block_notes,
         Initials AS entered_by,
         CAST(CASE WHEN lower(PROOF_LEVEL) = '' THEN 0
                   WHEN NOT (lower(PROOF_LEVEL) = '') THEN
                     CASE WHEN lower(PROOF_LEVEL) = 'ep' THEN 1 WHEN NOT (lower(PROOF_LEVEL) = 'ep') THEN 2 END
              END AS INTEGER) AS proof_level_num
  FROM keyed),
obs_long AS (SELECT date_transect_block_key, species, CAST(count AS BIGINT) AS count,
                    row_number() OVER (ORDER BY date_transect_block_key, species) AS observation_id
             FROM (UNPIVOT (SELECT date_transect_block_key, {", ".join(TAXA)} FROM keyed)
                   ON {", ".join(TAXA)} INTO NAME species VALUE count)),
direct_long AS (SELECT date_transect_block_key, date_transect_key, date_key, survey_block, survey_type, species,
                       CAST(count AS BIGINT) AS count
                FROM (UNPIVOT (SELECT date_transect_block_key, date_transect_key, date_key, survey_block,
                                      survey_type, {", ".join(TAXA)} FROM keyed)
                      ON {", ".join(TAXA)} INTO NAME species VALUE count)),
rebuilt AS (
  SELECT b.date_transect_block_key, coalesce(st.date_transect_key, b.date_transect_key) AS date_transect_key,
         st.date_key, b.survey_block, b.survey_type, o.species, o.count
  FROM (SELECT coalesce(s.date_key, t.date_key) AS date_key, t.date_transect_key
        FROM surveys s FULL JOIN transects t ON s.date_key IS NOT DISTINCT FROM t.date_key) st
  FULL JOIN blocktbl b ON st.date_transect_key IS NOT DISTINCT FROM b.date_transect_key
  JOIN obs_long o ON b.date_transect_block_key = o.date_transect_block_key)"""


def keyed(spark, d):
    return RS.key_wide_table(V.old_wide(spark, d), RS.build_block_dimension(spark), TAXA)


def model(spark, d):
    k = keyed(spark, d)
    return k, RS.derive_surveys(k), RS.derive_transects(k), RS.derive_blocks(k), RS.derive_observations(k, TAXA)


@register("r1_wide_sheets_to_tally", V.ctes(V.SQL_SHEET_TALLY) + """
SELECT "index", date, section, transect, species, tally FROM sheet_tally""")
def r1_wide_sheets_to_tally(spark, d):
    """Wide survey sheets (species/tally pair per section) to one row per tally line."""
    return RS.wide_sheets_to_tally(V.wide_sheet(spark, d))


@register("r3_key_wide_table", V.ctes(SQL_KEYED) + "\nSELECT * FROM keyed")
def r3_key_wide_table(spark, d):
    """Block dimension joined, date key, sequence-prefixed keys, taxa filled with 0."""
    return keyed(spark, d)


@register("r5_fill_zero", V.ctes(V.SQL_OLD_WIDE) + "\nSELECT "
          + ", ".join(f"CAST(sum(CASE WHEN {t} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS filled_{t}" for t in TAXA)
          + ", " + ", ".join(f"CAST(sum(coalesce({t}, 0)) AS BIGINT) AS total_{t}" for t in TAXA)
          + " FROM old_wide")
def r5_fill_zero(spark, d):
    """Missing taxon cells of the old wide table become 0 (cells filled and totals per taxon)."""
    w = V.old_wide(spark, d)
    marked = w.select(*TAXA, *[F.col(t).isNull().cast("int").alias(f"filled_{t}") for t in TAXA])
    return RS.fill_zero(marked, TAXA).agg(
        *[F.sum(f"filled_{t}").cast("long").alias(f"filled_{t}") for t in TAXA],
        *[F.sum(t).cast("long").alias(f"total_{t}") for t in TAXA])


@register("r7_derive_surveys", V.ctes(SQL_KEYED) + "\nSELECT * FROM surveys")
def r7_derive_surveys(spark, d):
    """Survey table (one row per date, season by rule 2)."""
    return RS.derive_surveys(keyed(spark, d))


@register("r8_derive_transects", V.ctes(SQL_KEYED) + "\nSELECT * FROM transects")
def r8_derive_transects(spark, d):
    """Transect table."""
    return RS.derive_transects(keyed(spark, d))


@register("r9_derive_blocks", V.ctes(SQL_KEYED) + "\nSELECT * FROM blocktbl")
def r9_derive_blocks(spark, d):
    """Block table with merged notes and coded proof level."""
    return RS.derive_blocks(keyed(spark, d))


@register("r10_derive_observations", V.ctes(SQL_KEYED) + "\nSELECT * FROM obs_long")
def r10_derive_observations(spark, d):
    """R10 (+R4): observation table numbered 1..N in (key, species) order."""
    return RS.derive_observations(keyed(spark, d), TAXA)


@register("r11_rebuild_full_long", V.ctes(SQL_KEYED) + "\nSELECT * FROM rebuilt")
def r11_rebuild_full_long(spark, d):
    """Survey, transect, block and observation tables joined back to the long table."""
    _, s, t, b, o = model(spark, d)
    return RS.rebuild_full_long(s, t, b, o).select(*RS.LONG_COLUMNS)


@register("r12_unpivot_keyed_wide", V.ctes(SQL_KEYED) + "\nSELECT * FROM direct_long")
def r12_unpivot_keyed_wide(spark, d):
    """The same long table straight from the keyed wide table."""
    return RS.unpivot_keyed_wide(keyed(spark, d), TAXA)


@register("u3_tables_equal", V.ctes(SQL_KEYED) + """
SELECT true AS same_schema,
       (SELECT count(*) FROM (SELECT * FROM rebuilt EXCEPT ALL SELECT * FROM direct_long)) AS only_in_a,
       (SELECT count(*) FROM (SELECT * FROM direct_long EXCEPT ALL SELECT * FROM rebuilt)) AS only_in_b,
       (SELECT count(*) FROM (SELECT * FROM rebuilt EXCEPT ALL SELECT * FROM direct_long)) = 0 AND
       (SELECT count(*) FROM (SELECT * FROM direct_long EXCEPT ALL SELECT * FROM rebuilt)) = 0 AS equal""")
def u3_tables_equal(spark, d):
    """The rebuilt long table equals the direct one."""
    k, s, t, b, o = model(spark, d)
    rebuilt = RS.rebuild_full_long(s, t, b, o).select(*RS.LONG_COLUMNS)
    return RS.tables_equal(rebuilt, RS.unpivot_keyed_wide(k, TAXA))


_U3_ORDER = "date_transect_block_key ASC NULLS LAST, species ASC NULLS LAST"
_U3_OTHER = "species ASC NULLS LAST, date_transect_block_key ASC NULLS LAST"


def _identical_sql(name: str, order_b: str) -> str:
    """One row of u3_tables_identical: are both tables the same rows at the same positions?"""
    return f"""SELECT '{name}' AS compared, true AS same_schema, (SELECT count(*) FROM rebuilt) AS rows_a,
       (SELECT count(*) FROM direct_long) AS rows_b, NOT EXISTS (
         SELECT *, row_number() OVER (ORDER BY {_U3_ORDER}) FROM rebuilt
         EXCEPT SELECT *, row_number() OVER (ORDER BY {order_b}) FROM direct_long)
       AND (SELECT count(*) FROM rebuilt) = (SELECT count(*) FROM direct_long) AS identical"""


@register("u3_tables_identical", V.ctes(SQL_KEYED) + f"""
{_identical_sql('both by key', _U3_ORDER)}
UNION ALL {_identical_sql('one by species', _U3_OTHER)}""")
def u3_tables_identical(spark, d):
    """Are the rebuilt and the direct long table the same rows in the same order, and in another order?"""
    k, s, t, b, o = model(spark, d)
    order = ["date_transect_block_key", "species"]
    rebuilt = arrange(RS.rebuild_full_long(s, t, b, o).select(*RS.LONG_COLUMNS), *order)
    direct = RS.unpivot_keyed_wide(k, TAXA)
    return tables_identical(rebuilt, arrange(direct, *order)).select(F.lit("both by key").alias("compared"), "*").union(
        tables_identical(rebuilt, arrange(direct, *order[::-1])).select(F.lit("one by species"), "*"))


@register("u3_numbering_check", V.ctes(SQL_KEYED) + f"""
SELECT count(*) AS n_rows, min(observation_id) AS first_number, max(observation_id) AS last_number,
       min(observation_id) = 1 AND max(observation_id) = count(*) AND count(DISTINCT observation_id) = count(*)
         AND count(DISTINCT date_transect_block_key) * {len(TAXA)} = count(*) AS numbered_in_order
FROM obs_long""")
def u3_numbering_check(spark, d):
    """The observation ids are 1..N, each once, and each block's taxa are numbered in a row."""
    o = RS.derive_observations(keyed(spark, d), TAXA)
    return RS.numbering_check(o, "observation_id", "date_transect_block_key", len(TAXA))


@register("u4_row_count_invariants", V.ctes(SQL_KEYED, """
cov AS (SELECT DISTINCT CAST(try_strptime(coalesce(CAST(MONTH AS VARCHAR), 'NA') || '-' || coalesce(CAST(DAY AS VARCHAR), 'NA')
            || '-' || coalesce(CAST(YEAR AS VARCHAR), 'NA'), '%m-%d-%Y') AS DATE) AS survey_date,
            CAST(BOAT AS VARCHAR) || '.' || CAST(SECTION AS VARCHAR) AS temp_block FROM old_wide),
c AS (SELECT (SELECT count(*) FROM surveys) AS n_surveys, (SELECT count(*) FROM transects) AS n_transects,
             (SELECT count(*) FROM blocktbl) AS n_blocks, (SELECT count(*) FROM obs_long) AS n_observations,
             (SELECT count(DISTINCT date_transect_key) FROM blocktbl) AS n_block_transect_keys,
             (SELECT count(DISTINCT survey_date) FROM cov) AS n_dates,
             (SELECT count(DISTINCT temp_block) FROM cov) AS n_coverage_blocks,
             (SELECT count(*) FROM cov) AS n_covered)""") + f"""
SELECT n_surveys, n_transects, n_blocks, n_observations, n_block_transect_keys, n_dates, n_coverage_blocks,
       n_covered, n_dates * n_coverage_blocks - n_covered AS n_missed,
       n_block_transect_keys = n_transects AS keys_match_transects,
       n_transects = 3 * n_surveys AS three_transects_per_survey,
       n_observations = n_blocks * {len(TAXA)} AS observations_are_blocks_x_taxa,
       n_dates * n_coverage_blocks = (n_dates * n_coverage_blocks - n_covered) + n_blocks AS coverage_adds_up
FROM c""")
def u4_row_count_invariants(spark, d):
    """U4: row-count identities of the relational model, one row."""
    k, s, t, b, o = model(spark, d)
    return Q.row_count_invariants(s, t, b, o, len(TAXA), RS.coverage_pairs(V.old_wide(spark, d)))


@register("r13_parse_block_key", V.ctes(SQL_KEYED, """
p AS (SELECT survey_block, string_split(date_transect_block_key, '.') AS parts FROM blocktbl
      WHERE date_transect_block_key IS NOT NULL),
q AS (SELECT survey_block, parts[1] AS znum, parts[2] AS date_text, parts[3] AS block, parts[4] AS transect FROM p)""") + """
SELECT survey_block, znum, CAST(try_strptime(date_text, '%m-%d-%Y') AS DATE) AS date, block, transect,
       coalesce(block, 'NA') || '.' || coalesce(transect, 'NA') AS surveyblock,
       CASE WHEN coalesce(regexp_matches(transect, 'sec'), false)
            THEN coalesce(block, 'NA') || '.' || coalesce(transect, 'NA') ELSE transect END AS surveyblock2,
       1 AS block_tbl
FROM q""")
def r13_parse_block_key(spark, d):
    """Composite block keys split and block names rebuilt."""
    b = RS.derive_blocks(keyed(spark, d)).select("survey_block", "date_transect_block_key")
    return RS.parse_block_key(b).select("survey_block", "znum", "date", "block", "transect", "surveyblock",
                                        "surveyblock2", "block_tbl")


# every BOAT.SECTION of the survey plan
COVER_BLOCKS = [f"{b}.{s}" for b in (1, 2, 3) for s in range(1, 10)]

SQL_COV = V.SQL_OLD_WIDE + """,
cov AS (SELECT DISTINCT CAST(try_strptime(coalesce(CAST(MONTH AS VARCHAR), 'NA') || '-' || coalesce(CAST(DAY AS VARCHAR), 'NA')
            || '-' || coalesce(CAST(YEAR AS VARCHAR), 'NA'), '%m-%d-%Y') AS DATE) AS survey_date,
            coalesce(CAST(BOAT AS VARCHAR), 'NA') || '.' || coalesce(CAST(SECTION AS VARCHAR), 'NA') AS temp_block
        FROM old_wide)"""


@register("r14_coverage_matrix", V.ctes(SQL_COV) + """
SELECT survey_date, """ + ", ".join(f"CAST(count(*) FILTER (WHERE temp_block = '{b}') AS INTEGER) AS \"{b}\""
                                    for b in COVER_BLOCKS) + """,
       CAST(count(*) FILTER (WHERE temp_block NOT IN (""" + ", ".join(f"'{b}'" for b in COVER_BLOCKS) + """)) AS INTEGER)
         AS unlisted
FROM cov GROUP BY survey_date""")
def r14_coverage_matrix(spark, d):
    """Survey date x BOAT.SECTION coverage (1 surveyed, 0 not), a column per block."""
    return RS.coverage_matrix(V.old_wide(spark, d), COVER_BLOCKS)


@register("r15_coverage_totals", V.ctes(SQL_COV) + """
SELECT temp_block AS block, count(*) AS days_surveyed FROM cov GROUP BY temp_block""")
def r15_coverage_totals(spark, d):
    """Days surveyed per block (column sums of R14)."""
    return RS.coverage_totals(V.old_wide(spark, d))


@register("r15_coverage_long", V.ctes(SQL_COV) + """
SELECT g.survey_date, CAST(g.temp_block AS DOUBLE) AS section, CAST(count(c.temp_block) AS INTEGER) AS done
FROM (SELECT survey_date, unnest([""" + ", ".join(f"'{b}'" for b in COVER_BLOCKS) + """]) AS temp_block
      FROM (SELECT DISTINCT survey_date FROM cov)) g
LEFT JOIN cov c ON c.survey_date = g.survey_date AND c.temp_block = g.temp_block
GROUP BY g.survey_date, g.temp_block""")
def r15_coverage_long(spark, d):
    """R14 back in long form with the block as a number (1.3)."""
    return RS.coverage_long(V.old_wide(spark, d), COVER_BLOCKS)


R20_TAXON = "PROMO"


@register("r20_old_day_total", V.ctes(V.SQL_OLD_WIDE) + f"""
SELECT MONTH, DAY, YEAR, SECTION, BOAT, {R20_TAXON},
       CAST(CASE WHEN count({R20_TAXON}) OVER w = count(*) OVER w THEN sum({R20_TAXON}) OVER w END AS BIGINT)
         AS spp_total
FROM old_wide WINDOW w AS (PARTITION BY YEAR, MONTH, DAY)""")
def r20_old_day_total(spark, d):
    """Old wide rows with the taxon's total of the same date on every row (all dates)."""
    return RS.old_day_total(V.old_wide(spark, d), R20_TAXON, per_date=True)


@register("r20_selected_total", V.ctes(V.SQL_OLD_WIDE) + f"""
SELECT MONTH, DAY, YEAR, SECTION, BOAT, {R20_TAXON},
       CAST(CASE WHEN count({R20_TAXON}) OVER () = count(*) OVER () THEN sum({R20_TAXON}) OVER () END AS BIGINT)
         AS spp_total
FROM old_wide WHERE MONTH = 12""")
def r20_selected_total(spark, d):
    """The rows of one month with the taxon's total over all of them on every row."""
    return RS.old_day_total(V.old_wide(spark, d), R20_TAXON, month=12)


@register("s1_read_wide_sheets", V.ctes(V.SQL_SHEET_TALLY) + """
SELECT "index", date, section, transect, species, tally FROM sheet_tally""")
def s1_read_wide_sheets(spark, d):
    """S1 + R1: wide sheets written as one CSV folder per survey date, read back and tallied."""
    from ..session import scratch_path
    from ..sources import files
    wide = V.wide_sheet(spark, d)
    path = scratch_path(spark, "sheets")
    # one task per date, so each date's folder holds one sheet file
    wide.repartition("date").write.partitionBy("date").option("header", True).csv(path)
    cols = [c for c in wide.columns if c != "date"]
    return RS.wide_sheets_to_tally(files.read_wide_sheets(spark, path, cols, skip_rows=0))

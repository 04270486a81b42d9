"""Bound queries: status tables, duplicates, value checks, frequency tables,
table reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import reshape as RS
from . import views as V
from .catalog import register
from .queries_reshape import SQL_KEYED, keyed

POOLED = ["click", "view"]
SPOT_DATE = "2024-01-15"
EVENT_BLOCKS = ["b0", "b1", "b2", "b3"]


def status_matrix(spark, d, pick="max"):
    return RS.status_matrix(V.status_obs(spark, d, pick), V.STATUS_BLOCKS, boat_markers=V.STATUS_BOAT_MARKERS)


@register("r16_status_matrix", V.ctes(V.SQL_STATUS_OBS, V.sql_status_matrix()) + "\nSELECT * FROM smat")
def r16_status_matrix(spark, d):
    """R16 (+R6): date x block survey status, boat blocks first, no row -> 'no record'."""
    return status_matrix(spark, d)


@register("r16_status_long", V.ctes(V.SQL_STATUS_OBS, V.sql_status_matrix()) + "\nSELECT * FROM sl2")
def r16_status_long(spark, d):
    """R16 long form: status label per visited (date, block)."""
    return RS.status_long(V.status_obs(spark, d)).select("visit_date", "block", "surveyed")


@register("a29_missed_by_block", V.ctes(V.SQL_STATUS_OBS, V.sql_status_matrix()) + """
SELECT block, count(*) AS n_missed FROM sl2 WHERE surveyed = 'not surveyed' GROUP BY block""")
def a29_missed_by_block(spark, d):
    """Number of 'not surveyed' dates per block."""
    return Q.missed_by_block(RS.status_long(V.status_obs(spark, d)))


@register("a29_missed_rows", V.ctes(V.SQL_STATUS_OBS, V.sql_status_matrix()) + """
SELECT DISTINCT visit_date, block FROM sl2 WHERE surveyed = 'not surveyed'""")
def a29_missed_rows(spark, d):
    """The missed (date, block) pairs, in date and block order."""
    return Q.missed_rows(RS.status_long(V.status_obs(spark, d))).orderBy("visit_date", "block")


LEFT_OUT_DATES = ["1996-02-29", "1997-01-01"]


@register("f8_without_dates", V.ctes(V.SQL_OBS) + f"""
SELECT visit_date, count(*) AS n_records FROM obs
WHERE visit_date IS NULL OR visit_date NOT IN ({", ".join(f"DATE '{x}'" for x in LEFT_OUT_DATES)}) GROUP BY visit_date""")
def f8_without_dates(spark, d):
    """F8: records of all but two dates, counted per date."""
    kept = Q.exclude_dates(V.obs(spark, d), LEFT_OUT_DATES)
    return kept.groupBy("visit_date").agg(F.count(F.lit(1)).alias("n_records"))


_UNPIV = ", ".join(V.STATUS_BLOCKS)


@register("u5_compare_status_matrix", V.ctes(V.SQL_STATUS_OBS, V.sql_status_matrix(),
                                              V.sql_status_obs("min", "status_old"),
                                              V.sql_status_matrix("status_old", "old_")) + f"""
SELECT coalesce(n.visit_date, o.visit_date) AS visit_date, coalesce(n.block, o.block) AS block,
       n.new_status, o.old_status
FROM (UNPIVOT smat ON {_UNPIV} INTO NAME block VALUE new_status) n
FULL JOIN (UNPIVOT old_smat ON {_UNPIV} INTO NAME block VALUE old_status) o
  ON n.visit_date IS NOT DISTINCT FROM o.visit_date AND n.block IS NOT DISTINCT FROM o.block
WHERE n.new_status IS DISTINCT FROM o.old_status""")
def u5_compare_status_matrix(spark, d):
    """Cells that differ between the status table and an older version (min status)."""
    return Q.compare_status_matrix(status_matrix(spark, d), status_matrix(spark, d, "min"), V.STATUS_BLOCKS)


@register("u6_reconcile_presence", V.ctes(SQL_KEYED, """
p AS (SELECT string_split(date_transect_block_key, '.') AS parts FROM blocktbl WHERE date_transect_block_key IS NOT NULL),
t AS (SELECT DISTINCT CAST(try_strptime(parts[2], '%m-%d-%Y') AS DATE) AS visit_date,
             coalesce(parts[3], 'NA') || '.' || coalesce(parts[4], 'NA') AS block, 1 AS in_tbl_block FROM p),
q AS (SELECT DISTINCT date_key AS visit_date, survey_block AS block, 1 AS in_query FROM keyed)""") + """
SELECT coalesce(t.visit_date, q.visit_date) AS visit_date, coalesce(t.block, q.block) AS block,
       coalesce(t.in_tbl_block, 0) AS in_tbl_block, coalesce(q.in_query, 0) AS in_query
FROM t FULL JOIN q ON t.visit_date IS NOT DISTINCT FROM q.visit_date AND t.block IS NOT DISTINCT FROM q.block
WHERE coalesce(t.in_tbl_block, 0) <> coalesce(q.in_query, 0)""")
def u6_reconcile_presence(spark, d):
    """(date, block) present in the parsed block table but not in the keyed rows, or back."""
    k = keyed(spark, d)
    parsed = RS.parse_block_key(RS.derive_blocks(k).select("date_transect_block_key"))
    t = parsed.select(F.col("date").alias("visit_date"), F.col("surveyblock").alias("block"))
    q = k.select(F.col("date_key").alias("visit_date"), F.col("survey_block").alias("block"))
    return Q.reconcile_presence(t, q)


@register("u7_key_mismatch", V.ctes(SQL_KEYED) + """
SELECT trim(date_transect_block_key) AS date_transect_block_key, trim(lookup) AS lookup, false AS match
FROM (SELECT date_transect_block_key, transect || '.sec' || CAST(SECTION AS VARCHAR) AS lookup FROM keyed)
WHERE NOT regexp_matches(trim(date_transect_block_key), trim(lookup)) AND date_transect_block_key IS NOT NULL""")
def u7_key_mismatch(spark, d):
    """Keys that do not contain the boat-style block name (land blocks, by design)."""
    k = keyed(spark, d).select(
        "date_transect_block_key",
        F.concat(F.col("transect"), F.lit(".sec"), F.col("SECTION").cast("string")).alias("lookup"))
    return Q.key_mismatch(k, "date_transect_block_key", "lookup")


@register("w8_duplicate_records", V.ctes(V.SQL_OBS) + """
SELECT o.*, c.num_rec FROM obs o JOIN (
  SELECT visit_date, alpha_code, section, count(*) AS num_rec FROM obs GROUP BY ALL HAVING count(*) > 1) c
  ON o.visit_date = c.visit_date AND o.alpha_code = c.alpha_code AND o.section = c.section""")
def w8_duplicate_records(spark, d):
    """Records whose (date, code, section) occurs more than once, with the count."""
    return Q.duplicate_records(V.obs(spark, d))


@register("f8_negative_counts", V.ctes(V.SQL_EVENTS_VALUES) + "\nSELECT * FROM events_values WHERE count < 0")
def f8_negative_counts(spark, d):
    """F8: records with a negative count."""
    return Q.negative_counts(V.events_values(spark, d))


@register("f8_low_proof", V.ctes(V.SQL_EVENTS_VALUES) + "\nSELECT * FROM events_values WHERE proof_level < 2")
def f8_low_proof(spark, d):
    """F8: records below proof level 2."""
    return Q.low_proof(V.events_values(spark, d))


@register("f8_spot_check", V.ctes(V.SQL_EVENTS_VALUES) + f"""
SELECT visit_date, species, count, block FROM events_values
WHERE visit_date = DATE '{SPOT_DATE}' AND species IN ('click', 'view')""")
def f8_spot_check(spark, d):
    """F8: one date's records of a code set, chosen columns."""
    return Q.spot_check(V.events_values(spark, d), SPOT_DATE, ["click", "view"],
                        ["visit_date", "species", "count", "block"])


SQL_POOLED = V.SQL_EVENTS_VALUES + """,
pooled AS (SELECT visit_date, block, species, count, 1 AS pooled_spp FROM events_values
           WHERE count < 0 AND species IN ('click', 'view'))"""


@register("f9_pooled_negatives", V.ctes(SQL_POOLED) + "\nSELECT * FROM pooled")
def f9_pooled_negatives(spark, d):
    """negative counts of pooled taxa, flagged."""
    return Q.pooled_negatives(V.events_values(spark, d), POOLED)


@register("a26_proof_level_table", V.ctes(V.SQL_EVENTS_VALUES) + """
SELECT proof_level, count(*) AS freq FROM events_values GROUP BY proof_level""")
def a26_proof_level_table(spark, d):
    """One-way table of proof levels."""
    return Q.frequency(V.events_values(spark, d), "proof_level")


@register("a26_negative_codes", V.ctes(V.SQL_EVENTS_VALUES) + """
SELECT species, count(*) AS freq FROM events_values WHERE count < 0 GROUP BY species""")
def a26_negative_codes(spark, d):
    """One-way table of codes among negative counts."""
    return Q.frequency(Q.negative_counts(V.events_values(spark, d)), "species")


@register("a26_code_by_block", V.ctes(SQL_POOLED) + "\nSELECT species, " + ", ".join(
    f"count(*) FILTER (WHERE block = '{b}') AS {b}" for b in EVENT_BLOCKS)
    + ", count(*) FILTER (WHERE block IS NULL OR block NOT IN (" + ", ".join(f"'{b}'" for b in EVENT_BLOCKS)
    + ")) AS unlisted FROM pooled GROUP BY species")
def a26_code_by_block(spark, d):
    """Two-way code x block table of pooled negatives, zero cells included."""
    return Q.crosstab_full(Q.pooled_negatives(V.events_values(spark, d), POOLED), "species", "block",
                           EVENT_BLOCKS)


@register("a26_code_by_block_long", V.ctes(V.SQL_EVENTS_VALUES) + """
SELECT s.species, b.block, count(e.found) AS freq
FROM (SELECT DISTINCT species FROM events_values) s, (SELECT DISTINCT block FROM events_values) b
LEFT JOIN (SELECT species, block, true AS found FROM events_values) e
  ON e.species IS NOT DISTINCT FROM s.species AND e.block IS NOT DISTINCT FROM b.block
GROUP BY s.species, b.block""")
def a26_code_by_block_long(spark, d):
    """Two-way code x block table over all values of both, zero cells included, as long rows."""
    return Q.crosstab_long(V.events_values(spark, d), "species", "block")


@register("a26_date_section_repeats", V.ctes(V.SQL_OLD_WIDE) + """
SELECT make_date(YEAR, MONTH, DAY) AS survey_date, SECTION, count(*) AS freq FROM old_wide
GROUP BY 1, 2 HAVING count(*) > 1""")
def a26_date_section_repeats(spark, d):
    """Date x section combinations seen more than once in the old wide table."""
    w = V.old_wide(spark, d).withColumn("survey_date", F.make_date("YEAR", "MONTH", "DAY"))
    return Q.frequency_over(w, ["survey_date", "SECTION"], 1)

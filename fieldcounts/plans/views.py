"""Bindings of the survey data model onto the driver's Parquet tables.

Each view exists twice: as a DataFrame builder (what the queries run) and as
the same definition in DuckDB SQL (what the oracle runs).  Keeping both in
one module keeps them in step.  Column meanings are described in FIXTURES.md.

Views read whole tables and whole texts; no id subsets, prefixes or caps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import study_year

# Fixed values of the test binding (FIXTURES.md §2).
TAXON_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
TRANSECTS = ["east", "middle", "west"]
NOTES_EPOCH = "1995-01-01"
NOTES_DAYS = 2400
# survey days by study year modulo 5: four surveys; three with one in period 4; three without;
# five; three with a day outside all periods
SURVEY_DAYS = [["12-15", "01-10", "01-25", "02-10"], ["01-10", "01-25", "02-10"], ["12-15", "01-10", "01-25"],
               ["12-15", "12-28", "01-10", "01-25", "02-10"], ["01-10", "01-25", "03-05"]]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Test binding: notes and events whose key these numbers divide have no value there (the driver tables hold no NULLs).
NO_NOTE, NO_NOTE_DATE, NO_NOTE_BLOCK = 29, 31, 37
NO_EVENT_CODE, NO_EVENT_BLOCK, NO_EVENT_COUNT = 43, 41, 23


def _missing(key: str, every: int, value):
    return F.when(F.col(key) % every != 0, value)


def _missing_sql(key: str, every: int, value: str) -> str:
    return f"CASE WHEN {key} % {every} <> 0 THEN {value} END"


# ---------------------------------------------------------------- obs
def obs_with_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis table: one row per line item, the taxon code from the part."""
    li = _read(spark, sf_dir, "lineitem")
    od = _read(spark, sf_dir, "orders")
    pt = _read(spark, sf_dir, "part")
    sp = _read(spark, sf_dir, "supplier")
    j = (li.join(od, li.l_orderkey == od.o_orderkey)
         .join(pt, li.l_partkey == pt.p_partkey)
         .join(sp, li.l_suppkey == sp.s_suppkey))
    return j.select(
        F.col("o_orderdate").cast("date").alias("visit_date"),
        F.col("p_brand").alias("alpha_code"),
        F.col("s_nationkey").alias("section"),
        F.col("l_returnflag").alias("survey_type"),
        (F.floor((F.dayofmonth("o_orderdate") - 1) / 8) + 1).cast("int").alias("survey_num"),
        F.col("l_quantity").cast("long").alias("section_final"),
        F.col("o_orderstatus").alias("status"),
        F.col("p_type").alias("taxon_type"),
        F.col("o_orderkey").alias("order_key"),
        F.col("o_orderpriority").alias("priority"),
        F.col("l_linestatus").alias("line_status"),
        F.col("s_name").alias("observer"),
    )


OBS_COLUMNS = ["visit_date", "alpha_code", "section", "survey_type", "survey_num",
               "section_final", "status"]


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs_with_type(spark, sf_dir).select(*OBS_COLUMNS)


SQL_OBS_WITH_TYPE = """
obs_t AS (
  SELECT CAST(o.o_orderdate AS DATE) AS visit_date, p.p_brand AS alpha_code,
         s.s_nationkey AS section, l.l_returnflag AS survey_type,
         CAST(floor((day(o.o_orderdate) - 1) / 8) + 1 AS INTEGER) AS survey_num,
         CAST(l.l_quantity AS BIGINT) AS section_final, o.o_orderstatus AS status,
         p.p_type AS taxon_type, o.o_orderkey AS order_key, o.o_orderpriority AS priority,
         l.l_linestatus AS line_status, s.s_name AS observer
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey)"""

SQL_OBS = SQL_OBS_WITH_TYPE + """,
obs AS (SELECT visit_date, alpha_code, section, survey_type, survey_num, section_final, status FROM obs_t)"""


# --------------------------------------------------------- survey_obs
def survey_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs with every record's date folded onto one of its study year's survey days.

    A study year has the days of ``SURVEY_DAYS[study_year % 5]``; the record's
    day of the year picks one.  Together the years reach every numbering
    branch, and no record is left out.
    """
    return _on_survey_days(obs(spark, sf_dir))


def survey_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates of ``survey_obs``: those of the orders that have line items."""
    items = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = _read(spark, sf_dir, "orders").join(items, "o_orderkey", "left_semi")
    dates = orders.select(F.col("o_orderdate").cast("date").alias("visit_date")).distinct()
    return _on_survey_days(dates)


def _on_survey_days(o: DataFrame) -> DataFrame:
    year = study_year("visit_date")
    kinds = F.array(*[F.array(*[F.lit(x) for x in days]) for days in SURVEY_DAYS])
    days = F.get(kinds, F.pmod(year, F.lit(len(SURVEY_DAYS))))
    day = F.get(days, F.pmod(F.dayofyear("visit_date"), F.size(days)))
    calendar_year = F.when(day >= "06", year).otherwise(year + 1)
    return o.withColumn("visit_date", F.to_date(F.concat_ws("-", calendar_year.cast("string"), day)))


_SURVEY_DAYS_SQL = "[" + ", ".join("[" + ", ".join(f"'{x}'" for x in days) + "]" for days in SURVEY_DAYS) + "]"

SQL_SURVEY_OBS = SQL_OBS + f""",
survey_days AS (SELECT *, CASE WHEN month(visit_date) < 6 THEN year(visit_date) - 1 ELSE year(visit_date) END AS sy,
                  {_SURVEY_DAYS_SQL} AS kinds FROM obs),
survey_day AS (SELECT *, kinds[1 + sy % {len(SURVEY_DAYS)}] AS days FROM survey_days),
survey_md AS (SELECT *, days[1 + dayofyear(visit_date) % len(days)] AS md FROM survey_day),
survey_obs AS (
  SELECT CAST((CASE WHEN md >= '06' THEN sy ELSE sy + 1 END) || '-' || md AS DATE) AS visit_date,
         alpha_code, section, survey_type, survey_num, section_final, status FROM survey_md)"""


# ----------------------------------------------------------- old_wide
def old_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old wide table: one row per (date, section), one column per taxon.

    Text fields are built from numeric aggregates (priority digit, status
    and line-status ranks), so the grouping runs as a hash aggregation.
    """
    t = obs_with_type(spark, sf_dir)
    taxa = [F.sum(F.when(F.col("taxon_type") == v, F.col("section_final"))).cast("int").alias(v)
            for v in TAXON_TYPES]
    digit = F.substring("priority", 1, 1).cast("int")
    status_rank = F.when(F.col("status") == "F", 1).when(F.col("status") == "O", 2).otherwise(3)
    line_rank = F.when(F.col("line_status") == "F", 0).otherwise(1)
    g = t.groupBy("visit_date", "section").agg(
        F.min("order_key").alias("ID"), F.count(F.lit(1)).alias("__n"),
        F.min(digit).alias("__dmin"), F.max(digit).alias("__dmax"),
        F.max((F.col("survey_type") == "R").cast("int")).alias("__r"),
        F.max(status_rank).alias("__st"), F.min(line_rank).alias("__lmin"), F.max(line_rank).alias("__lmax"),
        *taxa)
    fo = F.array(F.lit("F"), F.lit("O"))
    return g.select(
        "ID",
        F.month("visit_date").alias("MONTH"), F.dayofmonth("visit_date").alias("DAY"),
        F.year("visit_date").alias("YEAR"),
        (F.floor(F.col("section") / 3) + 1).cast("int").alias("SECTION"),
        (F.col("section") % 3 + 1).cast("int").alias("BOAT"),
        (F.col("__n") % 6).cast("int").alias("BEAUFORT"),
        F.concat(F.lit("priority "), F.col("__dmin").cast("string")).alias("NOTES"),
        F.when(F.col("__r") == 1, F.concat(F.lit("priority "), F.col("__dmax").cast("string")))
         .otherwise(F.lit("")).alias("WATERBIRDLOG"),
        F.when(F.col("__st") == 1, F.lit("")).when(F.col("__st") == 2, F.lit("EP")).otherwise(F.lit("Pl"))
         .alias("PROOF_LEVEL"),
        F.concat(F.element_at(fo, F.col("__lmin") + 1), F.element_at(fo, F.col("__lmax") + 1)).alias("Initials"),
        *TAXON_TYPES)


SQL_OLD_WIDE = SQL_OBS_WITH_TYPE + """,
old_wide_g AS (
  SELECT visit_date, section, min(order_key) AS ID,
         CAST(count(*) % 6 AS INTEGER) AS BEAUFORT,
         'priority ' || CAST(min(CAST(substr(priority, 1, 1) AS INTEGER)) AS VARCHAR) AS NOTES,
         CASE WHEN max(survey_type) = 'R'
              THEN 'priority ' || CAST(max(CAST(substr(priority, 1, 1) AS INTEGER)) AS VARCHAR) ELSE '' END
           AS WATERBIRDLOG,
         CASE WHEN max(status) = 'F' THEN '' WHEN max(status) = 'O' THEN 'EP' ELSE 'Pl' END AS PROOF_LEVEL,
         min(line_status) || max(line_status) AS Initials,
         """ + ",\n         ".join(
    f"CAST(sum(CASE WHEN taxon_type = '{v}' THEN section_final END) AS INTEGER) AS {v}" for v in TAXON_TYPES) + """
  FROM obs_t GROUP BY visit_date, section),
old_wide AS (
  SELECT ID, CAST(month(visit_date) AS INTEGER) AS MONTH, CAST(day(visit_date) AS INTEGER) AS DAY,
         CAST(year(visit_date) AS INTEGER) AS YEAR,
         CAST(floor(section / 3) + 1 AS INTEGER) AS SECTION, CAST(section % 3 + 1 AS INTEGER) AS BOAT,
         BEAUFORT, NOTES, WATERBIRDLOG, PROOF_LEVEL, Initials, """ + ", ".join(TAXON_TYPES) + """
  FROM old_wide_g)"""


# --------------------------------------------------------- status_obs
def block_name(section_col: str = "section"):
    s = F.col(section_col)
    transect = F.element_at(F.array(*[F.lit(t) for t in TRANSECTS]), (s % 3 + 1).cast("int"))
    return F.concat(transect, F.lit("_sec"), (F.floor(s / 3) + 1).cast("string"))


SQL_BLOCK_NAME = ("(['" + "', '".join(TRANSECTS) + "'][CAST(section % 3 + 1 AS INTEGER)] || '_sec' || "
                  "CAST(CAST(floor(section / 3) + 1 AS BIGINT) AS VARCHAR))")


def status_obs(spark: SparkSession, sf_dir: str, pick: str = "max") -> DataFrame:
    """One row per visited (date, block) with the two survey flags.

    ``pick`` chooses which of the statuses met on a (date, block) decides:
    ``max`` (the current table) or ``min`` (an older version, for U5)."""
    agg = F.max if pick == "max" else F.min
    # statuses order F < O < P; a numeric rank keeps the grouping a hash aggregation
    rank = F.when(F.col("status") == "F", 1).when(F.col("status") == "O", 2).when(F.col("status") == "P", 3)
    g = obs(spark, sf_dir).groupBy("visit_date", "section").agg(agg(rank).alias("__rank"))
    return g.select(
        "visit_date", block_name().alias("block"),
        (F.col("__rank") == 3).cast("int").alias("area_not_surveyed"),
        (F.col("__rank") == 1).cast("int").alias("no_birds_observed"))


def sql_status_obs(pick: str = "max", name: str = "status_obs") -> str:
    return SQL_OBS + f""",
{name} AS (
  SELECT visit_date, {SQL_BLOCK_NAME} AS block,
         CAST(status = 'P' AS INTEGER) AS area_not_surveyed, CAST(status = 'F' AS INTEGER) AS no_birds_observed
  FROM (SELECT visit_date, section, {pick}(status) AS status FROM obs GROUP BY visit_date, section))"""


SQL_STATUS_OBS = sql_status_obs()
STATUS_BLOCKS = [f"{TRANSECTS[s % 3]}_sec{s // 3 + 1}" for s in range(25)]
STATUS_BOAT_MARKERS = [f"{t}_sec" for t in TRANSECTS]


# -------------------------------------------------- notes (documents, conversations)
def _note_date(id_col: str):
    return F.date_add(F.lit(NOTES_EPOCH).cast("date"), (F.col(id_col) % NOTES_DAYS).cast("int"))


def block_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block-level notes: every document is a note on (date, block)."""
    d = _read(spark, sf_dir, "documents")
    return d.select(_missing("doc_id", NO_NOTE_DATE, _note_date("doc_id")).alias("visit_date"),
                    _missing("doc_id", NO_NOTE_BLOCK, F.col("source")).alias("block"),
                    _missing("doc_id", NO_NOTE, F.col("text")).alias("block_notes"))


SQL_BLOCK_NOTES = f"""
block_notes AS (
  SELECT {_missing_sql('doc_id', NO_NOTE_DATE, f"DATE '{NOTES_EPOCH}' + CAST(doc_id % {NOTES_DAYS} AS INTEGER)")} AS visit_date,
         {_missing_sql('doc_id', NO_NOTE_BLOCK, 'source')} AS block,
         {_missing_sql('doc_id', NO_NOTE, 'text')} AS block_notes FROM documents)"""


def survey_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey-level notes: every conversation turn is a note on a date."""
    c = _read(spark, sf_dir, "conversations")
    return c.select(_missing("conv_id", NO_NOTE_DATE, _note_date("conv_id")).alias("visit_date"),
                    _missing("conv_id", NO_NOTE, F.col("text")).alias("survey_notes"))


SQL_SURVEY_NOTES = f"""
survey_notes AS (
  SELECT {_missing_sql('conv_id', NO_NOTE_DATE, f"DATE '{NOTES_EPOCH}' + CAST(conv_id % {NOTES_DAYS} AS INTEGER)")} AS visit_date,
         {_missing_sql('conv_id', NO_NOTE, 'text')} AS survey_notes FROM conversations)"""


def block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts keyed like the notes' blocks (for the hunter-presence jobs)."""
    return obs(spark, sf_dir).select(
        "visit_date", F.col("alpha_code").alias("species"), F.col("section_final").alias("count"),
        F.concat(F.lit("src"), (F.col("section") % 20).cast("string")).alias("block"))


SQL_BLOCK_COUNTS = SQL_OBS + """,
block_counts AS (
  SELECT visit_date, alpha_code AS species, section_final AS count,
         'src' || CAST(section % 20 AS VARCHAR) AS block FROM obs)"""


# ---------------------------------------------------------------- taxa
def taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxonomy lookup: code, unique common name, scientific name, order."""
    p = _read(spark, sf_dir, "part")
    g = p.groupBy("p_brand").agg(
        F.min("p_name").alias("n1"), F.max("p_name").alias("n2"))
    num = F.substring(F.col("p_brand"), 7, 10)
    return g.select(
        F.col("p_brand").alias("alpha_code"),
        F.concat_ws(" ", F.col("n1"), num).alias("common_name"),
        F.concat_ws(" ", F.col("n2"), num).alias("species"),
        num.cast("int").alias("species_number"))


SQL_TAXA = """
taxa AS (
  SELECT p_brand AS alpha_code, min(p_name) || ' ' || substr(p_brand, 7, 10) AS common_name,
         max(p_name) || ' ' || substr(p_brand, 7, 10) AS species,
         CAST(substr(p_brand, 7, 10) AS INTEGER) AS species_number
  FROM part GROUP BY p_brand)"""


# ------------------------------------------------------- events_values
def events_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw observation records with signed counts (for the value checks)."""
    e = _read(spark, sf_dir, "events")
    return e.select(
        F.col("ts").cast("date").alias("visit_date"),
        _missing("user_id", NO_EVENT_BLOCK, F.concat(F.lit("b"), (F.col("user_id") % 4).cast("string"))).alias("block"),
        _missing("user_id", NO_EVENT_CODE, F.col("event_type")).alias("species"),
        _missing("user_id", NO_EVENT_COUNT, F.col("value") - 100).alias("count"),
        (F.col("user_id") % 4).cast("int").alias("proof_level"))


SQL_EVENTS_VALUES = f"""
events_values AS (
  SELECT CAST(ts AS DATE) AS visit_date,
         {_missing_sql('user_id', NO_EVENT_BLOCK, "'b' || CAST(user_id % 4 AS VARCHAR)")} AS block,
         {_missing_sql('user_id', NO_EVENT_CODE, 'event_type')} AS species,
         {_missing_sql('user_id', NO_EVENT_COUNT, 'value - 100')} AS count, CAST(user_id % 4 AS INTEGER) AS proof_level
  FROM events)"""


# ----------------------------------------------------- new-year counts
def new_year_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A single-season tally by common name (names spelled several ways)."""
    p = _read(spark, sf_dir, "part")
    return p.select(
        F.concat_ws(" ", F.col("p_name"), F.substring(F.col("p_brand"), 7, 10)).alias("common_name"),
        F.when(F.col("p_size") != 50, F.col("p_size").cast("long")).alias("count"))


SQL_NEW_YEAR_COUNTS = """
new_year_counts AS (
  SELECT p_name || ' ' || substr(p_brand, 7, 10) AS common_name,
         CASE WHEN p_size <> 50 THEN CAST(p_size AS BIGINT) END AS count FROM part)"""


def ctes(*parts: str) -> str:
    """Join CTE bodies (deduplicating shared prefixes) into a WITH clause."""
    seen, out = set(), []
    for part in parts:
        for piece in _split_ctes(part):
            name = piece.strip().split(" ", 1)[0]
            if name not in seen:
                seen.add(name)
                out.append(piece.strip())
    return "WITH " + ",\n".join(out)


def _split_ctes(text: str) -> list[str]:
    """Split 'a AS (...), b AS (...)' at top-level commas."""
    pieces, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == "," and depth == 0:
            pieces.append(text[start:i])
            start = i + 1
    pieces.append(text[start:])
    return [p for p in pieces if p.strip()]


# ------------------------------------------------------- wide sheets
# Fixed values of the test binding: land sheet names for (SECTION, BOAT) pairs.
SHEET_LAND = {(5, 1): "walkercreek", (6, 1): "cypressgrove", (7, 1): "millertonbivalve",
              (8, 1): "bivalve", (9, 1): "inverness"}
SHEET_SECTIONS = range(25)


def sheet_prefix(s: int) -> str:
    sec, boat = s // 3 + 1, s % 3 + 1
    return SHEET_LAND.get((sec, boat), f"sec{sec}_{TRANSECTS[boat - 1]}")


def wide_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey sheets in wide form: a line per (date, code), a species/tally pair per section."""
    o = obs(spark, sf_dir)
    aggs = []
    for s in SHEET_SECTIONS:
        hit = F.col("section") == s
        aggs.append(F.sum(F.when(hit, F.col("section_final"))).alias(f"__t{s}"))
    g = o.groupBy(F.col("alpha_code").alias("index"), F.col("visit_date").alias("date")).agg(*aggs)
    # the line's code is the species wherever the section has a tally (numeric aggregates only)
    cells = []
    for s in SHEET_SECTIONS:
        p, t = sheet_prefix(s), F.col(f"__t{s}")
        cells += [F.when(t.isNotNull(), F.col("index")).alias(f"{p}_species"), t.cast("string").alias(f"{p}_tally")]
    return g.select("index", "date", *cells)


def _sheet_case(kind: str) -> str:
    whens = []
    for s in SHEET_SECTIONS:
        p = sheet_prefix(s)
        if kind == "section":
            v = p.split("_")[0]
        else:
            v = p.split("_")[1] if "_" in p else "a"
        whens.append(f"WHEN {s} THEN '{v}'")
    return "CASE section " + " ".join(whens) + " END"


SQL_SHEET_TALLY = SQL_OBS + f""",
sheet_tally AS (
  SELECT alpha_code AS "index", visit_date AS date, {_sheet_case('section')} AS section,
         {_sheet_case('transect')} AS transect, alpha_code AS species, CAST(sum(section_final) AS VARCHAR) AS tally
  FROM obs WHERE section BETWEEN 0 AND {max(SHEET_SECTIONS)} GROUP BY alpha_code, visit_date, obs.section)"""


def sql_status_matrix(src: str = "status_obs", prefix: str = "") -> str:
    """SQL of R16 over ``src``: CTEs ``{prefix}sl2`` (long) and ``{prefix}smat`` (wide)."""
    cells = ", ".join(f"coalesce(CASE WHEN min(surveyed) FILTER (WHERE block = '{b}') <> max(surveyed) FILTER "
                      f"(WHERE block = '{b}') THEN 'conflicting records' ELSE max(surveyed) FILTER (WHERE block = '{b}') "
                      f"END, 'no record') AS {b}" for b in STATUS_BLOCKS)
    listed = ", ".join(f"'{b}'" for b in STATUS_BLOCKS)
    cells += f", count(DISTINCT block) FILTER (WHERE block NOT IN ({listed})) AS unlisted"
    return f"""{prefix}sl2 AS (
  SELECT visit_date, block,
         CASE WHEN no_birds_observed = 1 THEN 'surveyed, no birds obs'
              WHEN NOT (no_birds_observed = 1) THEN
                CASE WHEN area_not_surveyed = 0 THEN 'surveyed' WHEN NOT (area_not_surveyed = 0) THEN 'not surveyed' END
         END AS surveyed
  FROM (SELECT DISTINCT visit_date, block, area_not_surveyed, no_birds_observed FROM {src})),
{prefix}smat AS (SELECT visit_date, {cells} FROM {prefix}sl2 GROUP BY visit_date)"""

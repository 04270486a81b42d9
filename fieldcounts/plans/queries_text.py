"""Bound queries: note search, note parts, per-date digests, hunter presence."""

from __future__ import annotations

from ..operators import notes as N
from ..operators import reshape as RS
from ..session import scratch_path
from . import views as V
from .catalog import r6, register

# Test binding (FIXTURES.md): search terms present in the invented prose.
TERMS = ["not", "and", "the", "data"]
HUNT_WORD = "the"
GAME = ["Brand#1", "Brand#12", "Brand#23"]


def _sql_str(x):
    return "'" + x.replace("'", "''") + "'"


def _x1_sql(terms, pad):
    pat = N.terms_pattern(terms, pad)
    return V.SQL_BLOCK_NOTES + f""",
low AS (SELECT visit_date, block, lower(block_notes) AS block_notes
        FROM (SELECT DISTINCT visit_date, block, block_notes FROM block_notes) WHERE block_notes IS NOT NULL),
x1 AS (SELECT *, coalesce(block, 'NA') || ': ' || coalesce(block_notes, 'NA') AS block_w_notes FROM low
       WHERE coalesce(regexp_matches(block_notes, {_sql_str(pat)}), false))"""


SQL_X1 = _x1_sql(TERMS, True)
SQL_X2 = V.SQL_SURVEY_NOTES + """,
x2 AS (SELECT visit_date, 'all survey:  ' || lower(survey_notes) AS survey_notes
       FROM (SELECT DISTINCT visit_date, survey_notes FROM survey_notes) WHERE survey_notes IS NOT NULL)"""
SQL_A27 = SQL_X1 + ",\n" + SQL_X2 + """,
a27 AS (SELECT visit_date, 0 AS src, block_w_notes AS notes FROM x1
        UNION ALL SELECT visit_date, 1, survey_notes FROM x2)"""


@register("x1_keyword_notes", V.ctes(SQL_X1) + "\nSELECT visit_date, block, block_notes, block_w_notes FROM x1")
def x1_keyword_notes(spark, d):
    """Lower-cased block notes matching padded terms ('not | and | the | data')."""
    return N.keyword_notes(V.block_notes(spark, d), TERMS)


@register("x1_keyword_notes_unpadded", V.ctes(_x1_sql(TERMS, False)) + "\nSELECT * FROM x1")
def x1_keyword_notes_unpadded(spark, d):
    """X1 with plain alternation of the terms."""
    return N.keyword_notes(V.block_notes(spark, d), TERMS, pad=False)


@register("x1_keyword_notes_reference_terms", V.ctes(_x1_sql(N.BLOCK_NOTE_TERMS, True)) + "\nSELECT * FROM x1")
def x1_keyword_notes_reference_terms(spark, d):
    """X1 with the reference's 21 terms and its padding."""
    return N.keyword_notes(V.block_notes(spark, d))


@register("x1_lowered_notes", V.ctes(SQL_X1) + "\nSELECT * FROM low")
def x1_lowered_notes(spark, d):
    """X1 input: the distinct lower-cased block notes."""
    return N.lowered_notes(V.block_notes(spark, d))


@register("x2_survey_notes", V.ctes(SQL_X2) + "\nSELECT * FROM x2")
def x2_survey_notes(spark, d):
    """Distinct survey notes per date, lower-cased and prefixed."""
    return N.survey_notes_lower(V.survey_notes(spark, d))


@register("x3_numeric_note_parts", V.ctes(V.SQL_BLOCK_NOTES) + r"""
SELECT visit_date, block, block_notes, extract_notes FROM (
  SELECT visit_date, block, block_notes, unnest(string_split_regex(block_notes, ',|\.')) AS extract_notes
  FROM (SELECT DISTINCT visit_date, block, block_notes FROM block_notes
        WHERE coalesce(regexp_matches(block_notes, '\d'), false)) WHERE block_notes IS NOT NULL)
WHERE extract_notes IS NOT NULL AND extract_notes <> ''""")
def x3_numeric_note_parts(spark, d):
    """Notes with a digit split on ',' or '.' into all its non-empty parts."""
    return N.numeric_note_parts(V.block_notes(spark, d))


SQL_X4 = _x1_sql(TERMS, True) + f""",
x4 AS (SELECT visit_date, block, count(*) AS n_notes, true AS hunters FROM low
       WHERE coalesce(regexp_matches(block_notes, '{HUNT_WORD}'), false) GROUP BY visit_date, block)"""


def hunt(spark, d):
    return N.hunter_presence(N.lowered_notes(V.block_notes(spark, d)), HUNT_WORD)


@register("x4_hunter_presence", V.ctes(SQL_X4) + "\nSELECT * FROM x4")
def x4_hunter_presence(spark, d):
    """(date, block) with a note that mentions the word, and the number of such notes."""
    return hunt(spark, d)


SQL_X5 = V.SQL_BLOCK_COUNTS + ",\n" + SQL_X4 + f""",
x5 AS (SELECT coalesce(c.visit_date, h.visit_date) AS visit_date, coalesce(c.block, h.block) AS block,
              c.species, c.count, h.n_notes,
              CASE WHEN h.hunters IS NULL THEN 'hunters not present' ELSE 'hunters present' END AS hunters,
              CASE WHEN coalesce(c.species IN ({", ".join(_sql_str(g) for g in GAME)}), false)
                   THEN 'game species' ELSE 'non-game species' END AS game_spp
       FROM block_counts c FULL JOIN x4 h
         ON c.visit_date IS NOT DISTINCT FROM h.visit_date AND c.block IS NOT DISTINCT FROM h.block
       WHERE EXISTS (SELECT 1 FROM x4 w WHERE w.block IS NOT DISTINCT FROM coalesce(c.block, h.block)))"""


def labelled(spark, d):
    return N.with_hunters(V.block_counts(spark, d), hunt(spark, d), GAME)


@register("x5_with_hunters", V.ctes(SQL_X5) + "\nSELECT * FROM x5")
def x5_with_hunters(spark, d):
    """Counts of hunted blocks labelled by hunter presence and game status."""
    return labelled(spark, d)


@register("a28_presence_effect", V.ctes(SQL_X5) + """
SELECT hunters, game_spp, round_even(avg(sum_count), 6) AS mean_count, round_even(stddev_samp(sum_count), 6) AS sd_count,
       count(*) AS num_rec, round_even(stddev_samp(sum_count) / sqrt(count(*)), 6) AS st_err
FROM (SELECT visit_date, hunters, game_spp, block,
             CASE WHEN count(count) = count(*) THEN CAST(sum(count) AS BIGINT) END AS sum_count
      FROM x5 GROUP BY visit_date, hunters, game_spp, block)
WHERE sum_count IS NOT NULL GROUP BY hunters, game_spp""")
def a28_presence_effect(spark, d):
    """Block totals by hunter presence and game status: mean, sd, n, standard error."""
    r = N.presence_effect(labelled(spark, d))
    return r.select("hunters", "game_spp", r6("mean_count").alias("mean_count"), r6("sd_count").alias("sd_count"),
                    "num_rec", r6("st_err").alias("st_err"))


def digests(spark, d):
    hits = N.keyword_notes(V.block_notes(spark, d), TERMS)
    return N.notes_per_date(hits, N.survey_notes_lower(V.survey_notes(spark, d)))


@register("a27_notes_per_date", V.ctes(SQL_A27) + "\nSELECT * FROM a27")
def a27_notes_per_date(spark, d):
    """Keyword block notes and survey notes of each date, a row per note in reading order (date, src, notes)."""
    return digests(spark, d)


SQL_A27_TEXT = SQL_A27 + """,
a27_text AS (SELECT visit_date, string_agg(notes, ' | ' ORDER BY src, notes) AS all_date_notes FROM a27
             GROUP BY visit_date)"""


def date_texts(spark, d):
    hits = N.keyword_notes(V.block_notes(spark, d), TERMS)
    return N.notes_text_per_date(hits, N.survey_notes_lower(V.survey_notes(spark, d)),
                                 scratch_path(spark, "date-notes"))


@register("a27_notes_text", V.ctes(SQL_A27_TEXT) + "\nSELECT visit_date, all_date_notes FROM a27_text")
def a27_notes_text(spark, d):
    """One text for each date, its keyword block notes and survey notes joined by ' | ', written and read back."""
    return date_texts(spark, d)


@register("x6_missed_notes_text", V.ctes(V.SQL_STATUS_OBS, V.sql_status_matrix(), SQL_A27_TEXT) + """
SELECT coalesce(m.visit_date, a.visit_date) AS visit_date, m.* EXCLUDE (visit_date), a.all_date_notes
FROM smat m FULL JOIN a27_text a ON m.visit_date IS NOT DISTINCT FROM a.visit_date""")
def x6_missed_notes_text(spark, d):
    """A row per date, the date x block status table beside the date's notes as one text."""
    m = RS.status_matrix(V.status_obs(spark, d), V.STATUS_BLOCKS, boat_markers=V.STATUS_BOAT_MARKERS)
    return N.missed_with_notes(m, date_texts(spark, d))


@register("x6_missed_with_notes", V.ctes(V.SQL_STATUS_OBS, V.sql_status_matrix(), SQL_A27) + """
SELECT coalesce(m.visit_date, a.visit_date) AS visit_date, m.* EXCLUDE (visit_date), a.src, a.notes
FROM smat m FULL JOIN a27 a ON m.visit_date IS NOT DISTINCT FROM a.visit_date""")
def x6_missed_with_notes(spark, d):
    """The date x block status table beside each of the date's notes (full join on date)."""
    m = RS.status_matrix(V.status_obs(spark, d), V.STATUS_BLOCKS, boat_markers=V.STATUS_BOAT_MARKERS)
    return N.missed_with_notes(m, digests(spark, d))

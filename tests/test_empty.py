"""Empty inputs give empty (or all-zero one-row) outputs, never errors."""

from fieldcounts.functions.calendar import with_study_day
from fieldcounts.operators import notes as N
from fieldcounts.operators import quality as Q
from fieldcounts.operators import reshape as RS
from fieldcounts.operators import shares as SH
from fieldcounts.operators import summaries as S
from fieldcounts.operators import surveys as SV
from fieldcounts.operators import trends as TR
from fieldcounts.operators.sequence import global_sequence

OBS = "visit_date date, alpha_code string, section int, survey_num int, section_final long"


def test_empty_inputs(spark):
    obs = with_study_day(spark.createDataFrame([], OBS))
    assert S.taxon_annual_mean(obs).count() == 0
    assert S.baywide_counts(obs).count() == 0
    assert SH.daily_shares(obs).count() == 0
    nums = SV.survey_numbers(obs)
    assert nums.count() == 0
    assert SV.survey_intervals(nums).count() == 0
    assert SV.effort_subsets(SV.attach_survey_numbers(obs, nums)).count() == 0
    assert Q.duplicate_records(obs).count() == 0
    assert global_sequence(obs, ["visit_date", "alpha_code"], "seq", 3).count() == 0
    assert TR.linear_trend(obs, ["alpha_code"], "study_year", "section_final").count() == 0
    assert TR.quadratic_trend(obs, ["alpha_code"], "study_day", "section_final").count() == 0
    assert TR.local_trend(obs, ["alpha_code"], "study_year", "section_final").count() == 0
    notes = spark.createDataFrame([], "visit_date date, block string, block_notes string")
    assert N.keyword_notes(notes).count() == 0
    assert N.numeric_note_parts(notes).count() == 0
    a, b = spark.createDataFrame([], "x long"), spark.createDataFrame([], "x long")
    r = RS.tables_equal(a, b).first()
    assert r.equal and r.only_in_a == 0 and r.only_in_b == 0

"""Small frames worked out by hand: fractions, missing years, overflow columns, repeated names."""

import datetime as dt
from decimal import Decimal

import pytest

from fieldcounts.operators import reshape as RS
from fieldcounts.operators import shares as SH
from fieldcounts.operators import summaries as S
from fieldcounts.operators import surveys as SV
from fieldcounts.sources import files
from conftest import rows

D = dt.date


def test_fractional_totals_are_not_truncated(spark):
    t = spark.createDataFrame([("A", 1, 1.5), ("A", 1, 2.5)], "alpha_code string, season int, summed_num double")
    assert [tuple(r) for r in S.taxon_season_summary(t).collect()] == [("A", 1, 2.0, 2.5, 1.5)]
    o = spark.createDataFrame([("A", 1, 1.5), ("A", 1, 1.5)], "alpha_code string, section int, section_final double")
    assert S.section_mean_and_records(o).first().spp_section_mean == 1.5


def test_decimal_means_round_half_to_even_exactly(spark):
    o = spark.createDataFrame([("A", 1, Decimal("0.25")), ("B", 1, Decimal("0.35"))],
                              "alpha_code string, section int, section_final decimal(10,2)")
    got = {r.alpha_code: r.spp_section_mean for r in S.section_mean_and_records(o).collect()}
    assert got == {"A": 0.2, "B": 0.4}


def test_long_term_mean_of_fractions(spark):
    o = spark.createDataFrame([("A", 1, 2000, 0.5), ("A", 1, 2001, 1.0)],
                              "alpha_code string, section int, study_year int, section_final double")
    assert {r.spp_section_mean for r in S.section_taxon_trend(o).collect()} == {0.8}


def test_value_summary_does_not_round_values_first(spark):
    r = spark.createDataFrame([("a", 0.004), ("a", 0.004)], "species string, count double")
    assert S.value_summary(r).first().mean_count == 0.0
    r = spark.createDataFrame([("a", 0.054), ("a", 0.054)], "species string, count double")
    assert S.value_summary(r).first().mean_count == 0.1


def test_years_detected_counts_a_missing_year(spark):
    o = spark.createDataFrame([("A", 2000, 1), ("A", None, 1), ("A", None, 2), ("B", 2000, 1)],
                              "alpha_code string, study_year int, section_final long")
    assert rows(S.years_detected(o)) == [("A", 2), ("B", 1)]


def test_remaining_lump_keeps_a_missing_year(spark):
    cum = spark.createDataFrame([(None, "A", 5, 0.5), (None, "B", 3, 0.8), (None, "C", 2, 1.0)],
                                "study_year int, alpha_code string, total long, year_cum_prop double")
    cut = SH.share_threshold(cum)
    taxa = spark.createDataFrame([("A", "Ay"), ("B", "Bee")], "alpha_code string, common_name string")
    out = SH.remaining_lump(cum, cut, taxa, ["Ay", "Bee"])
    assert rows(out, "study_year", "alpha_code", "total2") == [(None, "A", 5), (None, "B", 3), (None, "C", 2)]


def test_effort_comparison_sum_is_strict(spark):
    e = spark.createDataFrame([(2000, "all", 3.0), (2000, "all", None), (None, "all", 1.0)],
                              "study_year int, which_surveys string, mean_bay_survey_count double")
    y = spark.createDataFrame([(2000, 2), (None, 1)], "study_year int, survey_num int")
    assert rows(SV.effort_comparison(e, y), "study_year", "total_birds") == [(None, 1.0), (2000, None)]


def test_survey_dates_above_the_slots_and_shared_slots(spark):
    n = spark.createDataFrame([(2000, D(2000, 12, 1), 1), (2000, D(2000, 12, 9), 1), (2000, D(2001, 2, 1), 5),
                               (2000, D(2001, 2, 9), None)], "study_year int, visit_date date, cor_survey_num int")
    r = SV.survey_date_matrix(n).first()
    assert (r.s_1, r.s_2, r.s_over) == ("2000-12-01, 2000-12-09", None, "5: 2001-02-01")


def test_unlisted_survey_types_are_summed_apart(spark):
    raw = spark.createDataFrame([(D(2000, 1, 1), "A", 2), (D(2000, 2, 1), "X", 3), (D(2000, 3, 1), None, 4)],
                                "visit_date date, survey_type string, section_final long")
    assert rows(S.totals_by_type_matrix(raw, ["A"]), "year", "A", "unlisted") == [(2000, 2, 7)]


def test_sheets_with_one_repaired_name_keep_both_lines(spark):
    wide = spark.createDataFrame([("1", "BUFF", "3", "AMCO", "4")], "index string, sec1_east_species string, "
                                 "sec1_east_tally string, `sec1.east.species` string, `sec1.east.tally` string")
    out = RS.wide_sheets_to_tally(wide, ids=("index",))
    assert sorted((r.species, r.tally) for r in out.collect()) == [("AMCO", "4"), ("BUFF", "3")]


def test_third_part_of_a_sheet_has_its_date(spark):
    df = spark.createDataFrame([("/x/2000-01-05_p3.csv",), ("/x/2000-01-05.csv",)], "p string")
    assert {r.d for r in df.select(files.sheet_date(df.p).alias("d")).collect()} == {D(2000, 1, 5)}


def test_coverage_with_an_unlisted_block(spark):
    w = spark.createDataFrame([(1, 2, 2000, 1, 1), (1, 2, 2000, 3, 9), (1, 3, 2000, 1, 1)],
                              "MONTH int, DAY int, YEAR int, BOAT int, SECTION int")
    m = RS.coverage_matrix(w, ["1.1", "1.2"])
    assert sorted(tuple(r) for r in m.collect()) == [(D(2000, 1, 2), 1, 0, 1), (D(2000, 1, 3), 1, 0, 0)]
    assert rows(RS.coverage_totals(w)) == [("1.1", 2), ("3.9", 1)]
    assert len(rows(RS.coverage_long(w, ["1.1", "1.2"]))) == 5


def test_observation_numbers_follow_key_and_species(spark):
    keyed = spark.createDataFrame([("2.k", 1, 2), ("10.k", 3, 4), ("1.k", 5, 6)],
                                  "date_transect_block_key string, ZZ int, AA int")
    o = RS.derive_observations(keyed, ["ZZ", "AA"])
    got = {(r.date_transect_block_key, r.species): r.observation_id for r in o.collect()}
    want = {k: i for i, k in enumerate(sorted(got), start=1)}
    assert got == want
    check = RS.numbering_check(o, "observation_id", "date_transect_block_key", 2).first()
    assert check.numbered_in_order and check.n_rows == 6


def test_no_checkpoint_folder_is_invented_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from fieldcounts.session import ensure_checkpoint_dir
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    spark = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(spark)

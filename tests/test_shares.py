import datetime as dt

from pyspark.sql import functions as F

from fieldcounts.operators import shares as SH
from fieldcounts.operators import summaries as S
from fieldcounts.operators import taxa as TX
from conftest import rows

D = dt.date


def _obs(spark):
    data = [
        (2000, D(2000, 12, 1), "A", 1, 10), (2000, D(2000, 12, 1), "B", 1, 10), (2000, D(2000, 12, 1), "C", 2, 5),
        (2000, D(2001, 1, 5), "A", 1, 0), (2000, D(2001, 1, 5), "B", 1, 0),
        (2001, D(2001, 12, 1), "A", 1, 7), (2001, D(2001, 12, 1), "B", 2, None),
    ]
    return spark.createDataFrame(data, "study_year int, visit_date date, alpha_code string, section int, "
                                       "section_final long")


def test_daily_shares_sum_to_one_and_ties_break_by_code(spark):
    d = SH.daily_shares(_obs(spark))
    day = d.filter(F.col("visit_date") == D(2000, 12, 1))
    assert abs(sum(r.date_spp_proportion_all for r in day.collect()) - 1.0) < 1e-12
    assert rows(day, "alpha_code", "abund_rank") == [("A", 1), ("B", 2), ("C", 3)]
    zero_day = d.filter(F.col("visit_date") == D(2001, 1, 5))
    assert rows(zero_day, "alpha_code", "date_spp_proportion_all") == [("A", None), ("B", None)]  # 0/0
    # a missing count makes the code's survey total (and the day total) missing
    miss = d.filter(F.col("study_year") == 2001)
    assert rows(miss, "alpha_code", "baywide_count") == [("A", 7), ("B", None)]


def test_baywide_all_equals_sum_of_codes(spark):
    b = S.baywide_counts(_obs(spark).filter(F.col("study_year") == 2000))
    got = {(r.visit_date, r.alpha_code): r.baywide_count for r in b.collect()}
    assert got[(D(2000, 12, 1), "all")] == 25
    assert got[(D(2000, 12, 1), "A")] == 10


def test_rank_and_cumulative_share(spark):
    sm = spark.createDataFrame([(2000, "A", 5.0), (2000, "B", 5.0), (2000, "C", 10.0), (2000, "all", 20.0)],
                               "study_year int, alpha_code string, mean_abund double")
    r = SH.abundance_rank(sm)
    assert rows(r, "alpha_code", "abund_rank") == [("A", 2), ("B", 3), ("C", 1)]
    c = SH.cumulative_share(sm)
    got = {x.alpha_code: (x.cumu_sum, x.year_cum_prop) for x in c.collect()}
    assert got == {"C": (10.0, 0.5), "A": (15.0, 0.75), "B": (20.0, 1.0)}
    t = SH.share_threshold(c, cut=0.7)
    assert rows(t) == [(2000, 0.75)]


def test_lumping_keeps_grand_total_and_null_codes(spark):
    o = spark.createDataFrame(
        [(2000, D(2000, 12, 1), 1, 1, "GRSC", 3, None), (2000, D(2000, 12, 1), 1, 1, "LESC", 4, None),
         (2000, D(2000, 12, 1), 1, 1, None, 2, None), (2000, D(2000, 12, 1), 1, 2, "BUFF", 1, None)],
        "season int, visit_date date, survey_num int, section int, alpha_code string, section_final long, "
        "data_is string")
    out = TX.lump_taxa(o, TX.SCAUP_GROUP, "SCAUP", "lumped.scaup")
    assert out.agg(F.sum("section_final")).first()[0] == 10
    assert rows(out, "alpha_code", "section_final", "data_is") == [
        (None, 2, None), ("BUFF", 1, None), ("SCAUP", 7, "lumped.scaup")]


def test_classes(spark):
    df = spark.createDataFrame([(0.05,), (0.0500001,), (None,)], "mean_proportion double")
    assert rows(SH.share_class(df), "mean_proportion", "prop_group") == [
        (None, None), (0.05, "less"), (0.0500001, "more")]
    y = spark.createDataFrame([(10,), (11,), (20,), (21,)], "num_year_detected long")
    assert rows(SH.years_class(y), "num_year_detected", "abund_group") == [
        (10, "low"), (11, "middle"), (20, "middle"), (21, "high")]


def test_baywide_all_row_is_distinct_from_a_null_code(spark):
    o = spark.createDataFrame([(2000, D(2000, 12, 1), None, 1, 4), (2000, D(2000, 12, 1), "A", 1, 6)],
                              "study_year int, visit_date date, alpha_code string, section int, section_final long")
    got = rows(S.baywide_counts(o), "alpha_code", "baywide_count")
    assert got == [(None, 4), ("A", 6), ("all", 10)]


def test_normalise_names_reference_fixes(spark):
    counts = spark.createDataFrame(
        [("Scaup sp.", 10), ("Horned Grebe spX", 2), ("Pac/Com Loon", 3), ("Surf Scoter", None), ("Mallard", 4)],
        "common_name string, count long")
    taxa = spark.createDataFrame(
        [("SCAUP", "Scaup"), ("WCGR", "Western/Clark's Grebe"), ("PCLO", "Pacific/Common Loon"),
         ("SUSC", "Surf Scoter")], "alpha_code string, common_name string")
    out = TX.normalise_names(counts, taxa, 2021)
    # the grebe rule is a regex ("." matches any character); NA counts go; unknown names get no code
    assert rows(out, "alpha_code", "baywide_count", "season") == [
        (None, 4, 2021), ("PCLO", 3, 2021), ("SCAUP", 10, 2021), ("WCGR", 2, 2021)]


def test_remaining_lump_threshold_duck_and_names(spark):
    sm = spark.createDataFrame([(2000, "A", 60.0), (2000, "B", 30.0), (2000, "DUCK", 6.0), (2000, "C", 4.0)],
                               "study_year int, alpha_code string, mean_abund double")
    cum = SH.cumulative_share(sm)          # A 0.6, B 0.9, DUCK 0.96, C 1.0
    thr = SH.share_threshold(cum)          # smallest cumulative share >= 0.9 is 0.9
    taxa = spark.createDataFrame([("A", "Aname"), ("DUCK", "Duck sp.")], "alpha_code string, common_name string")
    out = SH.remaining_lump(cum, thr, taxa, ["Aname", "Remaining spp."])
    got = {r.alpha_code: (r.total2, r.common_name, r.common_name_order) for r in out.collect()}
    assert got == {"A": (60.0, "Aname", 1), "B": (30.0, "Remaining spp.", 2),
                   "Remaining spp": (10.0, "Remaining spp.", 2)}

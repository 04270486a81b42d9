"""Plan-shape checks: the scale properties the operators are written for."""

from fieldcounts.functions.calendar import with_study_day
from fieldcounts.operators import notes as N
from fieldcounts.operators import summaries as S
from fieldcounts.operators import surveys as SV
from fieldcounts.operators.sequence import global_sequence
from fieldcounts.plans import views as V
from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    df = S.taxon_annual_mean(with_study_day(V.obs(spark, SF_SMALL)))
    plan = _plan(df)
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_quantity:double>" in plan
    assert "l_extendedprice" not in plan


def test_aggregation_is_partial_before_shuffle(spark):
    df = S.taxon_survey_total(with_study_day(V.obs(spark, SF_SMALL)))
    plan = _plan(df)
    assert "partial_sum" in plan or "partial_count" in plan


def test_survey_calendar_join_is_broadcast(spark):
    o = with_study_day(V.obs(spark, SF_SMALL))
    j = SV.attach_survey_numbers(o, SV.survey_numbers(o))
    plan = _plan(j)
    assert "BroadcastHashJoin" in plan and "LeftOuter" in plan
    assert "SortMergeJoin" not in plan


def test_keyword_filter_runs_before_the_distinct(spark):
    df = N.keyword_notes(V.block_notes(spark, SF_SMALL), ["not", "the"])
    opt = _optimized(df)
    agg_at = opt.find("Aggregate")
    filt_at = opt.find("RLIKE")
    assert filt_at > agg_at   # printed below the aggregate = evaluated before it


def test_global_sequence_has_no_single_partition_exchange_on_rows(spark):
    df = spark.range(0, 1000).selectExpr("id * 7 % 1000 as k")
    s = global_sequence(df, ["k"], "seq", 4)
    plan = _plan(s)
    assert "BroadcastExchange" in plan
    # the only single-partition exchange is on the per-partition sizes (after the aggregate)
    assert plan.count("SinglePartition") <= 1


def test_record_level_aggregations_are_hash_based(spark):
    from fieldcounts.operators import reshape as RS
    for df in (V.old_wide(spark, SF_SMALL), V.status_obs(spark, SF_SMALL), V.wide_sheet(spark, SF_SMALL),
               RS.status_matrix(V.status_obs(spark, SF_SMALL), V.STATUS_BLOCKS,
                                boat_markers=V.STATUS_BOAT_MARKERS)):
        plan = _plan(df)
        assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_sheet_unpivot_adds_no_shuffle(spark):
    from fieldcounts.operators import reshape as RS
    wide = V.wide_sheet(spark, SF_SMALL)
    before = _plan(wide).count("Exchange hashpartitioning")
    after = _plan(RS.wide_sheets_to_tally(wide)).count("Exchange hashpartitioning")
    assert after == before

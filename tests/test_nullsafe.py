from pyspark.sql import functions as F

from fieldcounts.functions import nullsafe as N
from conftest import rows


def test_strict_sum_is_null_when_any_missing(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 3)], "k string, v long")
    out = df.groupBy("k").agg(N.strict_sum("v").alias("s"))
    assert rows(out) == [("a", None), ("b", 5)]


def test_natural_join_matches_null_keys(spark):
    left = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    right = spark.createDataFrame([(None, 10), ("y", 20)], "k string, b int")
    full = N.natural_join(left, right, ["k"], "full")
    assert rows(full) == [(None, 1, 10), ("x", 2, None), ("y", None, 20)]
    inner = N.natural_join(left, right, ["k"], "inner")
    assert rows(inner) == [(None, 1, 10)]


def test_in_set_treats_null_as_not_member(spark):
    df = spark.createDataFrame([("A",), (None,), ("B",)], "c string")
    kept = df.filter(N.not_in_set("c", ["A"]))
    assert rows(kept) == [(None,), ("B",)]


def test_if_else_null_condition_gives_null(spark):
    df = spark.createDataFrame([(1,), (None,), (0,)], "x int")
    out = df.select("x", N.if_else(F.col("x") == 1, "yes", "no").alias("r"))
    assert rows(out) == [(None, None), (0, "no"), (1, "yes")]


def test_paste_prints_na(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert df.select(N.paste("a", "b", sep="-")).first()[0] == "1-NA"


def test_safe_divide_zero_by_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 4)], "a long, b long")
    assert rows(df.select(N.safe_divide("a", "b").alias("r"))) == [(None,), (0.25,)]


def test_grepl_null_is_false(spark):
    df = spark.createDataFrame([("hunt here",), (None,)], "t string")
    assert rows(df.select(N.grepl("t", "hunt").alias("m"))) == [(False,), (True,)]


def test_round_half_even_ratio_exact_ties(spark):
    df = spark.createDataFrame([(1, 8), (107, 40), (-5, 2), (7, 2), (1, 3), (2, 3)], "n long, d long")
    out = df.select("n", "d", N.round_half_even_ratio("n", "d", 2).alias("r2"),
                    N.round_half_even_ratio("n", "d", 0).alias("r0"))
    got = {(r.n, r.d): (r.r2, r.r0) for r in out.collect()}
    assert got[(1, 8)] == (0.12, 0.0)       # 0.125 -> 0.12
    assert got[(107, 40)] == (2.68, 3.0)    # 2.675 exactly -> 2.68 (7 is odd)
    assert got[(-5, 2)] == (-2.5, -2.0)     # -2.5 -> -2
    assert got[(7, 2)] == (3.5, 4.0)        # 3.5 -> 4
    assert got[(1, 3)] == (0.33, 0.0)
    assert got[(2, 3)] == (0.67, 1.0)


def test_mean_rounded_strict(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", None)], "k string, v long")
    out = df.groupBy("k").agg(N.mean_rounded(df, "v", 1).alias("m"))
    assert rows(out) == [("a", 1.5), ("b", None)]


def test_arrange_puts_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(None, "b"), (2, "a"), (1, "c"), (2, "b")], "x int, y string")
    assert [tuple(r) for r in N.arrange(df, "x", "y").collect()] == [(1, "c"), (2, "a"), (2, "b"), (None, "b")]
    assert [tuple(r) for r in N.arrange(df, "-x", "y").collect()] == [(2, "a"), (2, "b"), (1, "c"), (None, "b")]

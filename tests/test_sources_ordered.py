"""S1 records by quote parity, S3 seasons with a manifest, K1 files in order, A26 long, counts that are no whole numbers."""

import csv
import decimal
import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fieldcounts.functions import nullsafe
from fieldcounts.operators import quality, reshape
from fieldcounts.sources import files


# ---------------------------------------------------------------- S1
def sheet(path, body):
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerows([["index", "a_species", "a_tally"], ["junk", "1\nstill junk", ""], ["junk", "2", ""], *body])


def test_cells_with_line_breaks(spark, tmp_path):
    sheet(tmp_path / "2001-02-03.csv", [["x", "line\none, \"two\"", "3"], ["y", "", "4"], ["z", "\n\n", "5"]])
    sheet(tmp_path / "2001-02-03_p2.csv", [["p", "q", "6"]])
    got = rows(files.read_wide_sheets(spark, str(tmp_path), ["index", "a_species", "a_tally"]),
               "index", "a_species", "a_tally")
    assert [(a, b, c) for a, b, c in got] == [("p", "q", "6"), ("x", "line\none, \"two\"", "3"), ("y", None, "4"),
                                              ("z", "\n\n", "5")]


def test_a_large_sheet_is_several_tasks(spark, tmp_path):
    body = [[str(k), f"bird\n{k}" if k % 5 == 0 else f"bird {k}", str(k)] for k in range(4000)]
    sheet(tmp_path / "2001-02-03.csv", body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = files.read_wide_sheets(spark, str(tmp_path), ["index", "s", "t"]).select("index", "s", "t").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in body)


# ---------------------------------------------------------------- S3
def listing(path):
    out = {}
    for folder, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                with open(os.path.join(folder, n), "rb") as f:
                    out[os.path.join(folder, n)] = f.read()
    return out


def test_a_season_is_replaced_alone(spark, tmp_path):
    path = f"{tmp_path}/table"
    obs = spark.range(300).select((F.col("id") % 3 + 2000).cast("int").alias("study_year"), "id")
    files.write_seasons(obs, path)
    before = {k: v for k, v in listing(path).items() if "study_year=2001" not in k}
    files.write_seasons(obs.filter("study_year = 2001 AND id < 100"), path)
    files.write_seasons(obs.filter("study_year = 2002").withColumn("study_year", F.lit(2003)), path)
    after = listing(path)
    assert {k: after[k] for k in before} == before                    # the other years' files, byte for byte
    assert {r.study_year: (r.n_rows, r.n_manifest, r.whole) for r in files.check_seasons(spark, path).collect()} == {
        2000: (100, 100, True), 2001: (33, 33, True), 2002: (100, 100, True), 2003: (100, 100, True)}
    assert files.read_seasons(spark, path, [2001]).count() == 33 and files.read_seasons(spark, path).count() == 333


def test_a_year_that_is_not_whole_is_found(spark, tmp_path):
    path = f"{tmp_path}/table"
    obs = spark.range(300).select((F.col("id") % 3 + 2000).cast("int").alias("study_year"), "id")
    files.write_seasons(obs, path)
    obs.filter("study_year = 2000").limit(5).write.mode("append").partitionBy("study_year").parquet(path)
    with pytest.raises(ValueError, match="2000"):
        files.read_seasons(spark, path)
    assert files.read_seasons(spark, path, [2001]).count() == 100


# ---------------------------------------------------------------- K1
def test_positions_follow_the_order(spark, tmp_path):
    data = [(k, None if k % 10 == 0 else k % 4, None if k % 15 == 0 else f"n{k % 6}") for k in range(500)]
    df = spark.createDataFrame(data, "k long, a int, b string").repartition(6)
    keys = ["a", "-b", "k"]
    files.write_ordered(df, f"{tmp_path}/t", keys, num_partitions=7)
    back = files.read_ordered(spark, f"{tmp_path}/t").orderBy("position").collect()
    assert [r.position for r in back] == list(range(1, 501))
    assert [r.k for r in back] == [r.k for r in nullsafe.arrange(df, *keys).collect()]
    check = files.check_order(spark, f"{tmp_path}/t", keys).first()
    assert check.n_rows == 500 and check.in_order and check.n_files > 1
    assert not files.check_order(spark, f"{tmp_path}/t", ["-k"]).first().in_order
    files.write_ordered(df.limit(0), f"{tmp_path}/e", keys)
    assert files.read_ordered(spark, f"{tmp_path}/e").count() == 0 and files.check_order(spark, f"{tmp_path}/e", keys).first().in_order


# ---------------------------------------------------------------- A26
def test_grid_has_every_cell(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 2), ("a", None)], "r string, c int")
    got = {(r.r, r.c): r.freq for r in quality.crosstab_long(df, "r", "c").collect()}
    assert got == {(r, c): sum(x == (r, c) for x in [("a", 1), ("a", 1), ("b", 2), (None, 2), ("a", None)])
                   for r in ("a", "b", None) for c in (1, 2, None)}
    wide = spark.range(50_000).select((F.col("id") % 3).alias("r"), F.col("id").alias("c"))
    n, total, zeros = quality.crosstab_long(wide, "r", "c").agg(
        F.count("*"), F.sum("freq"), F.count_if(F.col("freq") == 0)).first()
    assert (n, total, zeros) == (150_000, 50_000, 100_000)
    assert quality.crosstab_long(df.limit(0), "r", "c").count() == 0


# ---------------------------------------------------------------- counts that are no whole numbers
def test_fractions_stay(spark):
    keyed = spark.createDataFrame([("1.1-1-2000.a.b", "t", None, "s", "boat", 1.5, 2)],
                                  "date_transect_block_key string, date_transect_key string, date_key date, "
                                  "survey_block string, survey_type string, LOON double, COLO int")
    assert rows(reshape.derive_observations(keyed, ["LOON", "COLO"]), "species", "count") == [("COLO", 2.0), ("LOON", 1.5)]
    assert rows(reshape.unpivot_keyed_wide(keyed, ["LOON", "COLO"]), "species", "count") == [("COLO", 2.0), ("LOON", 1.5)]
    exact = keyed.withColumn("LOON", F.col("LOON").cast("decimal(10,2)"))
    assert rows(reshape.derive_observations(exact, ["LOON", "COLO"]), "species", "count") == [
        ("COLO", decimal.Decimal("2.00")), ("LOON", decimal.Decimal("1.50"))]
    wide = spark.createDataFrame([(1, 2, 2000, 5, 1, 1.5), (1, 2, 2000, 6, 1, 2.0), (2, 2, 2000, 6, 1, 9.0), (1, 3, 2000, 5, 1, 1.0)],
                                 "MONTH int, DAY int, YEAR int, SECTION int, BOAT int, BRCO double")
    assert {r.spp_total for r in reshape.old_day_total(wide, "BRCO", month=1).collect()} == {4.5}
    assert rows(reshape.old_day_total(wide, "BRCO", month=1, per_date=True), "DAY", "spp_total") == [(2, 3.5), (2, 3.5), (3, 1.0)]


def test_means_of_wide_decimals(spark):
    D = decimal.Decimal
    for kind, values, digits, want in [("decimal(38,18)", [D("12.5"), D("12.25")], 1, 12.4), ("decimal(38,18)", [D("12.5")], 1, 12.5),
                                       ("decimal(10,3)", [D("2.675"), D("2.675")], 2, 2.68), ("decimal(10,3)", [D("2.665")], 2, 2.66),
                                       ("decimal(38,30)", [D("0.5"), D("1.5")], 0, 1.0), ("decimal(38,18)", [D(10) ** 18] * 12, 1, 1e18)]:
        df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
        assert df.agg(nullsafe.mean_rounded(df, "v", digits).alias("m")).first().m == pytest.approx(want, abs=1e-12, rel=1e-12)

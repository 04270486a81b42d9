import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from fieldcounts.operators import reshape as RS
from fieldcounts.sources import files
from conftest import rows

D = dt.date


def test_block_dimension(spark):
    b = RS.build_block_dimension(spark)
    assert b.count() == 17
    got = {(r.BOAT, r.SECTION): (r.survey_block, r.survey_type) for r in b.collect()}
    assert got[(1, 1)] == ("east.sec1", "boat")
    assert got[(3, 9)] == ("west.inverness", "land")
    assert got[(1, 7)] == ("east.millerton_bivalve", "land")


def test_sheets_to_tally_repairs_names(spark):
    wide = spark.createDataFrame(
        [("1", D(2020, 1, 5), "BUFF", "3", "SUSC", "7", "AMCO", "2"),
         ("2", D(2020, 1, 5), None, None, "BRAN", "1", None, None)],
        "index string, date date, sec1_east_species string, sec1_east_tally string, "
        "cypressgrove_species string, cypressgrove_tally string, millertonbivalve_species string, "
        "millertonbivalve_tally string")
    out = RS.wide_sheets_to_tally(wide)
    assert rows(out, "index", "section", "transect", "species", "tally") == [
        ("1", "cypressgrove", "a", "SUSC", "7"), ("1", "millertonbivalve", "a", "AMCO", "2"),
        ("1", "sec1", "east", "BUFF", "3"), ("2", "cypressgrove", "a", "BRAN", "1")]


def test_read_wide_sheets_from_csv_files(spark):
    folder = tempfile.mkdtemp(prefix="sheets-")
    header = "index,sec1_east_species,sec1_east_tally\n"
    junk = "x,y,z\nx2,y2,z2\n"
    with open(os.path.join(folder, "2020-01-05.csv"), "w") as f:
        f.write(header + junk + "1,BUFF,3\n2,SUSC,4\n")
    with open(os.path.join(folder, "2020-01-05_p2.csv"), "w") as f:
        f.write(header + junk + "3,AMCO,5\n")
    with open(os.path.join(folder, "2020-02-10.csv"), "w") as f:
        f.write(header + junk + "1,\"BRAN, black\",1\n\n")
    w = files.read_wide_sheets(spark, folder, ["index", "sec1_east_species", "sec1_east_tally"])
    assert rows(w, "date", "index", "sec1_east_species", "sec1_east_tally") == [
        (D(2020, 1, 5), "1", "BUFF", "3"), (D(2020, 1, 5), "2", "SUSC", "4"), (D(2020, 1, 5), "3", "AMCO", "5"),
        (D(2020, 2, 10), "1", "BRAN, black", "1")]
    long = RS.wide_sheets_to_tally(w)
    assert long.count() == 4


def test_csv_roundtrip_and_parquet_pruning(spark):
    df = spark.createDataFrame([(1999, "A", 3), (2000, "B", 4)], "study_year int, alpha_code string, n long")
    base = tempfile.mkdtemp(prefix="tables-")
    files.write_csv_table(df, f"{base}/summary")
    back = files.read_csv_table(spark, f"{base}/summary", "study_year int, alpha_code string, n long")
    assert rows(back) == rows(df)
    files.write_analysis_table(df, f"{base}/analysis")
    pruned = files.read_analysis_table(spark, f"{base}/analysis", [2000])
    assert rows(pruned, "alpha_code") == [("B",)]
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2000" in plan


def test_key_wide_table_both_sides_of_full_join(spark):
    wide = spark.createDataFrame(
        [(1, 1, 5, 2000, 1, 1, 0, "n", "", "", "AB", 3),
         (2, 1, 5, 2000, 4, 2, 0, "n", "log", "EP", "AB", None),
         (3, 1, 6, 2000, 7, 3, 0, None, "x", "zz", "CD", 1)],
        "ID long, MONTH int, DAY int, YEAR int, SECTION int, BOAT int, BEAUFORT int, NOTES string, "
        "WATERBIRDLOG string, PROOF_LEVEL string, Initials string, BUFF int")
    k = RS.key_wide_table(wide, RS.build_block_dimension(spark), ["BUFF"])
    assert k.count() == 3 + 15   # 1 wide row has no block (7, 3); 15 blocks have no wide row
    got = {r.ID: (r.date_transect_block_key, r.BUFF) for r in k.filter(F.col("ID").isNotNull()).collect()}
    assert got[1] == ("1.1-5-2000.east.sec1", 3)
    assert got[2] == ("2.1-5-2000.middle.sec4", 0)     # NA -> 0
    assert got[3] == ("3.1-6-2000.NA", 1)
    blocks = RS.derive_blocks(k)
    notes = {r.date_transect_block_key: (r.block_notes, r.proof_level_num) for r in blocks.collect()}
    assert notes["1.1-5-2000.east.sec1"] == ("n", 0)
    assert notes["2.1-5-2000.middle.sec4"] == ("n. log", 1)
    assert notes["3.1-6-2000.NA"] == ("NA. x", 2)
    parsed = RS.parse_block_key(blocks.select("date_transect_block_key"))
    p = {r.znum: (r.date, r.surveyblock, r.surveyblock2) for r in parsed.collect()}
    assert p["1"] == (D(2000, 1, 5), "east.sec1", "east.sec1")
    assert p["4"] == (None, "middle.sec1", "middle.sec1")   # first block without a wide row
    obs = RS.derive_observations(k, ["BUFF"])
    rebuilt = RS.rebuild_full_long(RS.derive_surveys(k), RS.derive_transects(k), blocks, obs)
    eq = RS.tables_equal(rebuilt.select(*RS.LONG_COLUMNS), RS.unpivot_keyed_wide(k, ["BUFF"])).first()
    assert eq.equal and eq.only_in_a == 0 and eq.only_in_b == 0


def test_read_wide_sheets_crlf_and_date_folder(spark):
    base = tempfile.mkdtemp(prefix="sheets2-")
    os.makedirs(os.path.join(base, "date=2021-03-04"))
    with open(os.path.join(base, "date=2021-03-04", "part-00000.csv"), "w", newline="") as f:
        f.write("index,sec1_east_species,sec1_east_tally\r\n1,BUFF,3\r\n2,,\r\n")
    w = files.read_wide_sheets(spark, base, ["index", "sec1_east_species", "sec1_east_tally"], skip_rows=0)
    assert rows(w, "date", "index", "sec1_east_species", "sec1_east_tally") == [
        (D(2021, 3, 4), "1", "BUFF", "3"), (D(2021, 3, 4), "2", None, None)]
    assert rows(RS.wide_sheets_to_tally(w), "index", "species", "tally") == [("1", "BUFF", "3")]

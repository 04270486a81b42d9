import datetime as dt

from pyspark.sql import functions as F

from fieldcounts.operators import notes as N
from fieldcounts.operators import quality as Q
from fieldcounts.operators import reshape as RS
from conftest import rows

D = dt.date


def _notes(spark):
    return spark.createDataFrame(
        [(D(2000, 1, 1), "b1", "Hunters NOT seen"), (D(2000, 1, 1), "b1", "Hunters NOT seen"),
         (D(2000, 1, 1), "b2", "not here"), (D(2000, 1, 2), "b1", "saw 3 gulls, 2 terns. end"),
         (D(2000, 1, 2), "b2", None), (D(2000, 1, 3), "b3", "a hunt and a shot")],
        "visit_date date, block string, block_notes string")


def test_padded_terms_need_spaces(spark):
    hits = N.keyword_notes(_notes(spark), ["not", "hunt", "shot"])
    # "not here" starts with "not " -> first term only needs a space after;
    # "a hunt and a shot" has " hunt " and " shot" (last term needs a space before)
    assert rows(hits, "block", "block_notes") == [
        ("b1", "hunters not seen"), ("b2", "not here"), ("b3", "a hunt and a shot")]
    plain = N.keyword_notes(_notes(spark), ["hunt"], pad=False)
    assert rows(plain, "block") == [("b1",), ("b3",)]


def test_numeric_parts_split(spark):
    parts = N.numeric_note_parts(_notes(spark))
    assert rows(parts, "extract_notes") == [(" 2 terns",), (" end",), ("saw 3 gulls",)]
    many = spark.createDataFrame([(D(2000, 1, 1), "b", ",".join(str(i) for i in range(15)))],
                                 "visit_date date, block string, block_notes string")
    assert N.numeric_note_parts(many).count() == 15
    assert N.numeric_note_parts(many, parts=10).count() == 10


def test_hunters_join_and_effect(spark):
    low = N.lowered_notes(_notes(spark))
    hunt = N.hunter_presence(low)
    assert hunt.count() == 2   # distinct notes: b1 on Jan 1 and b3 on Jan 3
    counts = spark.createDataFrame(
        [(D(2000, 1, 1), "BUFF", 4, "b1"), (D(2000, 1, 2), "BUFF", 6, "b1"), (D(2000, 1, 2), "SUSC", 1, "b2")],
        "visit_date date, species string, count long, block string")
    lab = N.with_hunters(counts, hunt, ["BUFF"])
    got = rows(lab, "visit_date", "block", "species", "hunters")
    assert got == [(D(2000, 1, 1), "b1", "BUFF", "hunters present"),
                   (D(2000, 1, 2), "b1", "BUFF", "hunters not present"),
                   (D(2000, 1, 3), "b3", None, "hunters present")]
    eff = N.presence_effect(lab)
    assert rows(eff, "hunters", "game_spp", "num_rec") == [
        ("hunters not present", "game species", 1), ("hunters present", "game species", 1)]


def test_notes_per_date_order(spark):
    hits = N.keyword_notes(_notes(spark), ["not", "hunt"], pad=False)
    survey = spark.createDataFrame([(D(2000, 1, 1), "Fog"), (D(2000, 1, 5), "Calm")],
                                   "visit_date date, survey_notes string")
    notes = N.notes_per_date(hits, N.survey_notes_lower(survey))
    got = [tuple(r) for r in notes.orderBy("visit_date", "src", "notes").collect()]
    assert [x for x in got if x[0] == D(2000, 1, 1)] == [
        (D(2000, 1, 1), 0, "b1: hunters not seen"), (D(2000, 1, 1), 0, "b2: not here"),
        (D(2000, 1, 1), 1, "all survey:  fog")]
    assert (D(2000, 1, 5), 1, "all survey:  calm") in got


def test_duplicates_crosstab_and_reconcile(spark):
    obs = spark.createDataFrame([(D(2000, 1, 1), "A", 1, 2), (D(2000, 1, 1), "A", 1, 3), (D(2000, 1, 1), "B", 1, 1)],
                                "visit_date date, alpha_code string, section int, section_final long")
    dup = Q.duplicate_records(obs)
    assert rows(dup, "alpha_code", "section_final", "num_rec") == [("A", 2, 2), ("A", 3, 2)]
    recs = spark.createDataFrame([("x", "b1"), ("x", "b1"), ("y", "b2")], "species string, block string")
    ct = Q.crosstab_full(recs, "species", "block", ["b1", "b2", "b3"])
    assert rows(ct) == [("x", 2, 0, 0, 0), ("y", 0, 1, 0, 0)]
    a = spark.createDataFrame([(D(2000, 1, 1), "b1"), (D(2000, 1, 2), None)], "visit_date date, block string")
    b = spark.createDataFrame([(D(2000, 1, 1), "b1"), (D(2000, 1, 3), "b2")], "visit_date date, block string")
    rec = Q.reconcile_presence(a, b)
    assert rows(rec) == [(D(2000, 1, 2), None, 1, 0), (D(2000, 1, 3), "b2", 0, 1)]


def test_key_mismatch_pattern_from_column(spark):
    df = spark.createDataFrame([(" 1.1-5-2000.east.sec1 ", "east.sec1"), ("2.1-5-2000.eastXsec1", "east.sec1"),
                                ("3.1-5-2000.west.inverness", "west.sec9"), (None, "x")],
                               "k string, lookup string")
    out = Q.key_mismatch(df, "k", "lookup")
    assert rows(out, "k") == [("3.1-5-2000.west.inverness",)]   # "." in the lookup matches any character


def test_status_matrix_labels_and_missing_cells(spark):
    from fieldcounts.operators import reshape as RS
    rows_ = [(D(2000, 1, 1), "east.sec1", 0, 0), (D(2000, 1, 1), "west.sec2", 1, 0),
             (D(2000, 1, 2), "east.sec1", 1, 1), (D(2000, 1, 2), "bivalve", None, 0)]
    st = spark.createDataFrame(rows_, "visit_date date, block string, area_not_surveyed int, no_birds_observed int")
    m = RS.status_matrix(st, ["bivalve", "west.sec2", "east.sec1"])
    assert m.columns == ["visit_date", "east.sec1", "west.sec2", "bivalve", "unlisted"]   # boat blocks first
    got = {r.visit_date: tuple(r)[1:-1] for r in m.collect()}
    assert got[D(2000, 1, 1)] == ("surveyed", "not surveyed", "no record")
    assert got[D(2000, 1, 2)] == ("surveyed, no birds obs", "no record", "no record")   # NA flag -> NA -> no record


def test_two_hunting_notes_count_once(spark):
    notes = spark.createDataFrame(
        [(D(2000, 1, 1), "b1", "hunters at dawn"), (D(2000, 1, 1), "b1", "more hunting later")],
        "visit_date date, block string, block_notes string")
    counts = spark.createDataFrame([(D(2000, 1, 1), "BUFF", 5, "b1")],
                                   "visit_date date, species string, count long, block string")
    low = N.lowered_notes(notes)
    kept = N.with_hunters(counts, N.hunter_presence(low), ["BUFF"])
    assert [(r["count"], r.n_notes) for r in kept.collect()] == [(5, 2)]


def test_fifty_notes_on_one_block_leave_the_mean_alone(spark):
    notes = spark.createDataFrame([(D(2000, 1, 1), "b1", f"hunters {i}") for i in range(50)],
                                  "visit_date date, block string, block_notes string")
    counts = spark.createDataFrame([(D(2000, 1, 1), "BUFF", 10, "b1")],
                                   "visit_date date, species string, count long, block string")
    out = N.presence_effect(N.with_hunters(counts, N.hunter_presence(N.lowered_notes(notes)), ["BUFF"])).collect()
    assert [(r.hunters, r.mean_count, r.num_rec) for r in out] == [("hunters present", 10.0, 1)]


def test_missed_rows_and_left_out_dates(spark):
    s = spark.createDataFrame([(D(2000, 1, 2), "b", "not surveyed"), (D(2000, 1, 1), "b", "surveyed"),
                               (None, "c", "not surveyed")], "visit_date date, block string, surveyed string")
    assert rows(Q.missed_rows(s)) == [(None, "c"), (D(2000, 1, 2), "b")]
    assert rows(Q.exclude_dates(s, ["2000-01-02"]), "visit_date") == [(None,), (D(2000, 1, 1),)]


def test_conflicting_and_unlisted_blocks_show(spark):
    st = spark.createDataFrame([(D(2000, 1, 1), "a", 0, 0), (D(2000, 1, 1), "a", 1, 0), (D(2000, 1, 1), "z", 0, 0)],
                               "visit_date date, block string, area_not_surveyed int, no_birds_observed int")
    m = RS.status_matrix(st, ["a", "b"], boat_markers=[]).first()
    assert (m.a, m.b, m.unlisted) == ("conflicting records", "no record", 1)
    old = RS.status_matrix(st.filter("block = 'a' AND area_not_surveyed = 0"), ["a", "b"], boat_markers=[])
    diff = Q.compare_status_matrix(RS.status_matrix(st, ["a", "b"], boat_markers=[]), old)
    assert rows(diff, "block", "new_status", "old_status") == [("a", "conflicting records", "surveyed"),
                                                               ("unlisted", "1", "0")]

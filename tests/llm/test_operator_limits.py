"""Long inputs, clashing columns, and results that do not depend on batches, for operators 1, 4, 5, 6 and 10."""

import ipaddress

import pytest
from pyspark.sql import functions as F

from fieldcounts.llm import language, pii, quality, substring, warc
from fieldcounts.session import scratch_path


def masked(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.replace_entities(docs).orderBy("doc_id").collect()]


# ---------------------------------------------------------------- 4: personal data

def test_very_long_entities(spark):
    host, local, name = "b" + ".a" * 100_000, "x" * 1000, "M" + "a" * 500
    texts = [f"to a@{host} now", f"to {local}@mail.example.com now", f"Mr {name} came", f"Mr {name}-{name} came",
             "pwd=" + "q" * 1_000_000, "+33 " + "1" * 1_000_000, "1." * 500_000, "a." * 500_000 + "@", "1-" * 500_000,
             "x@y.z-"]
    out = masked(spark, texts)
    assert out[0].endswith(" now") and host not in out[0] and len(out[0]) == len(texts[0])
    assert local not in out[1] and out[1].endswith(".com now") and "xxx" not in out[1]
    assert "aaaaa" not in out[2] and out[2].endswith(" came") and "aaaaa" not in out[3]
    assert out[4].startswith("pwd=") and "qqqqq" not in out[4]
    assert out[5:9] == texts[5:9]                                  # nothing in there is an entity
    assert out[9].endswith("-") and not out[9].startswith("x@y.z")


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "mail a@b.example now", "mine", 5, "r")], "doc_id long, text string, _names string, _key long, _row string")
    got = pii.replace_entities(docs).collect()[0]
    assert (got["_names"], got["_key"], got["_row"], got["doc_id"]) == ("mine", 5, "r", 1) and "a@b.example" not in got["text"]


def test_a_name_has_one_surrogate(spark):
    out = masked(spark, ["Dr John Smith", "Mr John Smith", "Mrs Anna Smith", "Dr Anna Jones", "Prof Kim Smith"])
    given = [t.split()[1] for t in out]
    assert given[0] == given[1] and given[2] == given[3] and len({given[0], given[2], given[4]}) == 3
    assert given[0] in pii.GIVEN["m", "latin"].split() and given[2] in pii.GIVEN["f", "latin"].split()
    assert len({t.split()[2] for t in out if t is not out[3]}) == 1


def test_addresses_of_a_full_range(spark):
    """All addresses of 192.168/16 are real, so none of that range is free."""
    real = [f"192.168.{a}.{b}" for a in range(256) for b in range(256)]
    atoms = spark.createDataFrame([("ip", x) for x in real], "kind string, norm string")
    got = {r.norm: r.surrogate for r in pii.surrogates(atoms).collect()}
    assert got.keys() == set(real) and len(set(got.values())) == len(real) and not set(real) & set(got.values())
    assert all(ipaddress.ip_address(x) in ipaddress.ip_network("240.0.0.0/4") for x in got.values())


# ---------------------------------------------------------------- 1 and 5: scores

def test_equal_texts_have_equal_scores_in_any_batch(spark):
    texts = ["the house is old", "das Haus ist alt und gross", "la maison est vieille"]
    known = spark.createDataFrame([(i, texts[i % 3] + " x" * (i % 5), "edf"[i % 3]) for i in range(60)],
                                  "doc_id long, text string, lang string")
    model = language.train(known)
    whole = dict(zip(texts, language.predict(texts, model)[1].tolist()))
    for size in (1, 2, 3, 7, 50):
        for k, text in enumerate(texts):
            batch = [texts[(k + j) % 3] for j in range(size)]
            assert language.predict(batch, model)[1][0] == whole[text]
    labels = known.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("quality"))
    w, b, *_ = quality.train(known, labels)
    parsed = [quality.base_measures(t) for t in texts * 9]
    x = quality.features(texts * 9, parsed)
    alone = [quality.margins(x[k:k + 1], w, b)[0] for k in range(3)]
    for size in (2, 5, 27):
        assert quality.margins(x[:size], w, b).tolist() == (alone * 9)[:size]


def test_letters_are_letters(spark):
    docs = spark.createDataFrame([(1, "the house", "en"), (2, "das Haus", "de")], "doc_id long, text string, lang string")
    got, score = language.predict(["²½", "Ⅻ ① 12 _", "é", "ª"], language.train(docs))
    assert got[:2] == ["und", "und"] and score[:2].tolist() == [0, 0] and "und" not in got[2:]


def test_quality_stage_keeps_columns(spark, tmp_path):
    text = "some words that are not repeated here at all but make up one ordinary text of more than twenty words in total"
    docs = spark.createDataFrame([(1, text, "mine", 7)], "doc_id long, text string, quality string, N_words int")
    docs.select("doc_id", F.lit(1).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    assert [tuple(r) for r in quality.quality_stage(spark, docs, str(tmp_path)).collect()] == [(1, text, "mine", 7)]


# ---------------------------------------------------------------- 6: passages

def test_null_ids_are_documents_of_their_own(spark):
    shared = "one sentence that very many documents of this table hold in just the same words again."
    rows = [(None, f"{shared} Text number {k} has its own words {'abc' * k}.") for k in range(30)] + [(5, shared)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum("one sentence that" in r.text for r in got) == 1 and [r.text for r in got if r.doc_id == 5] == [shared]
    assert sum("has its own words" in r.text for r in got) == 30


def test_growth_has_no_reach(spark):
    long = " ".join(f"w{k}" for k in range(300))                     # no sentence ends in here
    unit = "A sentence that both of them hold as it is."
    rows = [(1, f"first alpha {long}. {unit} Beta one has words of its own"),
            (2, f"other gamma {long}. {unit} Delta two has words of its own")]
    got = {r.doc_id: r.text for r in substring.remove_repeats(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[2] == "other gamma Delta two has words of its own"


def test_scripts_without_blanks_and_columns(spark):
    line = "".join(chr(0x4E00 + k) for k in range(200))
    rows = [(1, f"{line}\nfirst", "mine"), (2, f"{line}\nsecond", "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed string")
    got = {r.doc_id: (r.text, r.removed) for r in substring.substring_stage(spark, docs, "").collect()}
    assert got == {1: (f"{line}\nfirst", "mine"), 2: ("second", "mine")}


# ---------------------------------------------------------------- 10: records

def _archive(spark, pages):
    path = scratch_path(spark, "warc-test")
    warc.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string"), path)
    return path


def test_payloads_come_from_rebuilt_records(spark, tmp_path):
    pages = [(1, "u", "x" * 150), (2, "é\r\n", "x" * 150), (3, None, "y"), (4, "v", "y"), (5, "w", None), (6, "z", "é" * 80)]
    folder = f"{tmp_path}/ok"
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    rows = warc.archive_pages(spark, folder)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan or "BroadcastHashJoin" in plan or "ShuffledHashJoin" in plan
    assert "payload" in plan and "ReadSchema: struct<digest:binary,payload:binary>" in plan
    assert {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in rows.collect()} == {
        (1, 150, "response", None), (2, 150, "revisit", 1), (3, 1, "response", None), (4, 1, "response", None),
        (5, 0, "response", None), (6, 160, "response", None)}


@pytest.mark.parametrize("harm", ["length", "payload"])
def test_wrong_records_fail(spark, monkeypatch, tmp_path, harm):
    folder = f"{tmp_path}/{harm}"
    spark.createDataFrame([(1, "u", "x" * 150), (2, "u", "y" * 150)], "page_id long, url string, html string").write.parquet(
        f"{folder}/pages.parquet")
    read = warc.read_archive

    def harmed(session, path):
        back = read(session, path)
        if harm == "length":
            return back.withColumn("head", F.regexp_replace("head", r"Content-Length: \d+", "Content-Length: 7"))
        other = F.when(F.col("record_id") == 1, F.lit("y" * 150)).otherwise(F.lit("x" * 150)).cast("binary")
        return back.withColumn("record", F.concat("head", other, F.lit(b"\r\n\r\n")))
    monkeypatch.setattr(warc, "read_archive", harmed)
    with pytest.raises(Exception, match="does not hold the payload"):
        warc.archive_pages(spark, folder).collect()

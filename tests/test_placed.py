"""Different texts by digest, fetched where they lie; texts joined into lines and read back."""

import random

from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from fieldcounts.operators import notes as N
from fieldcounts.sources import joined_text as J
from fieldcounts.sources import placed as P


def test_distinct_by_digest_is_distinct(spark):
    data = [(k % 5, None if k % 11 == 0 else "x" * (k % 13) + "é" * (k % 3)) for k in range(4000)] + [(None, "a"), (None, "a")]
    df = spark.createDataFrame(data, "k long, text string").withColumn("other", F.rand()).repartition(9)
    assert rows(P.distinct_by_digest(df, ["k"], "text")) == rows(df.select("k", "text").distinct())
    assert P.distinct_by_digest(df.limit(0), ["k"], "text").count() == 0
    clash = df.withColumnRenamed("k", "_task")
    assert rows(P.distinct_by_digest(clash, ["_task"], "text")) == rows(df.select("k", "text").distinct())


def test_texts_are_not_shuffled(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    notes = docs.select((F.col("doc_id") % 30).cast("string").alias("visit_date"),
                        F.lit("b").alias("block"), F.col("text").alias("block_notes"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (N.lowered_notes(notes), N.numeric_note_parts(notes),
                   N.survey_notes_lower(notes.withColumnRenamed("block_notes", "survey_notes"))):
            plan = df._jdf.queryExecution().executedPlan()
            shuffled = []

            def walk(node):
                if "Exchange" in node.nodeName():
                    out = node.output()
                    shuffled.append([out.apply(i).name() for i in range(out.size())])
                kids = node.children()
                for i in range(kids.size()):
                    walk(kids.apply(i))
                if node.nodeName() == "AdaptiveSparkPlan":
                    walk(node.initialPlan())
            walk(plan)
            assert shuffled and not any({"block_notes", "survey_notes"} & set(names) for names in shuffled), shuffled
            assert "Bucketed: true" in plan.toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_joined_texts_come_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(J, "PIECE", 500)
    random.seed(4)
    odd = ["a", "", "tab\there", "line\nend", "back\\slash", "\\n", "\\\\", "cr\rlf\r\n", "| bar | ", "é" * 100, None]
    data = [(None if k % 9 == 0 else f"d{k % 7}\t\\", k % 2, random.choice(odd) if k % 3 else f"p{'x' * 70}{k}")
            for k in range(600)]
    df = spark.createDataFrame(data, "d string, src int, note string").distinct()
    for n in (1, 5, 40):                     # keys that go on in the next files
        J.write_joined(df, f"{tmp_path}/{n}", "d", ["src"], "note", num_partitions=n)
        got = {r.d: r.all for r in J.read_joined(spark, f"{tmp_path}/{n}", "d", "string", "all").collect()}
        want = {}
        for d, src, note in sorted(df.collect(), key=lambda r: (r.src, r.note if r.note is not None else "NA")):
            want.setdefault(d, []).append("NA" if note is None else note)
        assert got == {d: " | ".join(v) for d, v in want.items()}
    J.write_joined(df.limit(0), f"{tmp_path}/empty", "d", [], "note")
    assert J.read_joined(spark, f"{tmp_path}/empty", "d", "string", "all").count() == 0

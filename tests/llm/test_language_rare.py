"""Language identification: rare languages and whole texts are learned."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from fieldcounts.llm import language
from fieldcounts.llm.common import drawn_ids


def texts(letters, n, seed):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choices(letters, k=5)) for _ in range(8)) for _ in range(n)]


def test_a_rare_language_among_many_rows_is_learned(spark):
    rows = [(t, "aa") for t in texts("abcdef", 6000, 1)] + [(t, "zz") for t in texts("uvwxyz", 6, 2)]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.train(docs, sample_rows=40)
    assert model[2] == ["aa", "zz"]
    new = spark.createDataFrame(list(enumerate(texts("uvwxyz", 20, 3))), "doc_id long, text string")
    assert {r.lang_pred for r in language.identify(new, model).collect()} == {"zz"}


def test_draws_are_bounded_for_each_value(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 1000 == 0, "rare").otherwise("often").alias("lang"))
    many = rows.union(spark.range(5000).select(F.lit(1).cast("long"), F.lit("often")))
    got = drawn_ids(many, "lang", 100).collect()
    assert sorted(r.id for r in got if r.lang == "rare") == list(range(0, 20_000, 1000))
    assert len({r.id for r in got if r.lang == "often"}) == sum(r.lang == "often" for r in got) == 100


def test_the_end_of_a_long_text_teaches_and_every_language_has_a_landmark(spark):
    seen = "0 " * 10_500
    docs = spark.createDataFrame([(k, seen + t, "aa") for k, t in enumerate(texts("abcdef", 8, 4))]
                                 + [(k + 8, seen + t, "zz") for k, t in enumerate(texts("uvwxyz", 8, 5))],
                                 "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model is not None and model[2] == ["aa", "zz"]
    out = language.identify(spark.createDataFrame(list(enumerate(texts("uvwxyz", 9, 6))), "doc_id long, text string"), model)
    assert {r.lang_pred for r in out.collect()} == {"zz"}
    bits = np.packbits(np.eye(200, 1 << language.BITS, dtype=bool), axis=1)
    assert len(language.fit(bits, [f"l{k:03d}" for k in range(200)])[0]) == 200

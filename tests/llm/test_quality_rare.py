"""Quality rules: a rare class is learned."""

from __future__ import annotations

import random

from fieldcounts.llm import quality


def test_a_rare_class_among_many_labels_is_learned(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choices("uvwxyz" if i % 500 == 7 else "abcdef", k=5)) for _ in range(30)),
             int(i % 500 != 7)) for i in range(3000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"),
                          sample_rows=60)
    assert model is not None
    out = {r.doc_id: r.quality for r in quality.measure(docs, model).collect()}
    assert max(out[i] for i, _, y in rows if not y) < min(out[i] for i, _, y in rows if y)

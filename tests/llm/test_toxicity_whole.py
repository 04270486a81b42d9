"""Toxicity: training reads whole texts."""

from __future__ import annotations

import random

import numpy as np

from fieldcounts.llm import toxicity


def test_toxic_passages_late_in_long_texts_are_learned(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("aeiou", k=2)) + rng.choice(["nd", "th", "er", "ing"]) for _ in range(200)]
    bad, rows = ["blorgish", "snuzzwort", "quafflehead"], []
    for i in range(120):
        text, toxic = rng.choices(words, k=4500), i % 4 == 0      # 20,000 characters end before word 4,200
        if toxic:
            for k in range(4300, 4500, 4):
                text[k] = rng.choice(bad)
        rows.append((i, " ".join(text), int(toxic)))
    assert min(t.find(b) for _, t, y in rows if y for b in bad if b in t) > 20_000
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 90], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert any(b.encode()[:6] in model[1][len(model[0]):] for b in bad)
    out = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert np.mean([(out[i] >= toxicity.THRESHOLD) == bool(y) for i, _, y in rows if i >= 90]) > 0.95

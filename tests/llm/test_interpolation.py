"""Interpolated scores against a plain version on dictionaries, and edge cases."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcounts.llm import interpolation as lm
from fieldcounts.llm.common import crc_remainder

SF = "/root/testdata/sf0.001"


def split(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [None]


def plain(rows, held, left_out):
    """(n_tokens, n_known, base, score) of each row by the formula of the module's docstring."""
    docs = [split(t) for _, t in rows]

    def counts(use):
        one, two = collections.Counter(), collections.Counter()
        for d, u in zip(docs, use):
            if u:
                one.update(d)
                two.update(zip([("s",), *d], d))
        return one, two
    every = counts([not h for h in held])
    kept = counts([not h and not x for h, x in zip(held, left_out)])

    def parts(model, d):
        one, two = model
        for k, w in enumerate(d):
            v = ("s",) if k == 0 else d[k - 1]
            context = one[None] if k == 0 else one[v]
            yield context.bit_length(), two[v, w] / max(context, 1), one[w]
    n_kept, v_kept = sum(kept[0].values()), len(kept[0])
    seen = [(b, p, c / max(n_kept, 1)) for d, h, x in zip(docs, held, left_out) if x and not h for b, p, c in parts(kept, d)]
    a, u, floor = np.full(65, 0.5), 0.5, 1 / (v_kept + 1)
    a[0] = 0
    found = set()
    if n_kept == 0:
        u = 0.0
    else:
        for _ in range(lm.STEPS):
            if not seen:
                break
            e, ones, rests, n = np.zeros(65), 0.0, 0.0, np.zeros(65)
            for b, p, c in seen:
                x, y, z = a[b] * p, (1 - a[b]) * u * c, (1 - a[b]) * (1 - u) * floor
                e[b] += x / (x + y + z)
                ones, rests, n[b] = ones + y / (x + y + z), rests + z / (x + y + z), n[b] + 1
            found |= set(np.flatnonzero(n))
            new = np.where(n > 0, e / (n + 1), a)
            new_u = ones / (ones + rests + 1)
            change = max(np.abs(new - a).max(), abs(new_u - u))
            a, u = new, new_u
            if change < lm.CLOSE:
                break
        a[0] = 0
        known = [k for k in range(1, 65) if k in found]
        for k in range(1, 65):
            if known and k not in found:
                a[k] = a[min(known, key=lambda j: (abs(j - k), j))]
    n, v = sum(every[0].values()), len(every[0])
    out = []
    for d in docs:
        base = sum(math.log10((every[0][w] + 1) / (n + v + 1)) for w in d)
        score = sum(math.log10(a[b] * p + (1 - a[b]) * (u * c / max(n, 1) + (1 - u) / (v + 1)))
                    for b, p, c in parts(every, d))
        out.append((len(d), sum(every[0][w] > 0 for w in d), n, base, score))
    return out


def check(spark, rows, frame=None, **small):
    frame = frame or spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.defaultdict(list)
    for r in lm.model_scores(frame, crc_remainder("doc_id", 7) == 2, **small).collect():
        got[r.id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    odd = {r.doc_id for r in spark.createDataFrame([(i,) for i, _ in rows], "doc_id long").filter(
        F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(lm.DELETED)) == 0).collect()}
    want = collections.defaultdict(list)
    for (i, _), h, line in zip(rows, held, plain(rows, held, [i in odd for i, _ in rows])):
        want[i].append((h, *line))
    assert got.keys() == want.keys()
    for i in want:
        for x, y in zip(sorted(got[i]), sorted(want[i])):
            assert x[:4] == y[:4]
            assert x[4:] == pytest.approx(y[4:], rel=1e-5, abs=1e-9)


def made(n, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(f"W{k}" for k in rng.zipf(1.4, rng.integers(1, 60)) % 200)) for i in range(n)]


def test_scores_against_plain_version(spark):
    check(spark, made(150))


def test_blocks_and_shards_of_any_size_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 50)          # texts continue in later blocks
    check(spark, made(60), block_tokens=17, shard_tokens=100)


def test_edges(spark):
    odd = [(1, None), (2, ""), (3, " \t\n"), (None, "a b a"), (None, "A B"), (4, "a b   x"), (5, "É é E"),
           (5, "É é E"), (5, "other text"), (6, "x " * 3000), (7, "y" * 100_000)] + made(40)
    check(spark, odd)
    check(spark, [(2, None), (3, "")])
    frame = spark.createDataFrame(odd, "doc_id long, text string").withColumns(
        {"block": F.lit("mine"), "score": F.lit(1), "id": F.lit(2)})
    check(spark, odd, frame)
    assert lm.model_scores(frame.limit(0)).count() == 0


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm.model_scores(frame, F.lit(True)).collect()
    assert {(r.id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {
        (1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)}


def test_condition_of_the_caller(spark):
    """Every word after one context, in texts that are only scored."""
    rows = made(80)
    words = sorted({w for _, t in rows for w in t.lower().split()})
    rows += [(10_000 + k, f"w1 {w}") for k, w in enumerate([*words, "never-seen"])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r for r in lm.model_scores(frame, F.col("doc_id") >= 10_000).collect()}
    odd = {r.doc_id for r in frame.filter(
        F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(lm.DELETED)) == 0).collect()}
    for (i, _), line in zip(rows, plain(rows, [i >= 10_000 for i, _ in rows], [i in odd for i, _ in rows])):
        assert got[i].score == pytest.approx(line[-1], rel=1e-5)
    assert got[10_000 + len(words)].n_known == 2          # w1 and the end


def test_query_on_whole_table(spark):
    got = lm.interpolation_query(spark, SF)
    assert got.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(spark, docs, spark.read.parquet(f"{SF}/documents.parquet"))
    rows = got.collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)          # better than the smoothed words alone

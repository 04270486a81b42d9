"""Near words, forms and roots against plain versions, and edge cases."""

import collections
import re
import zlib

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldcounts.llm import variants as V

SF = "/root/testdata/sf0.001"


def plain_words(rows):
    found = collections.Counter()
    for i, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def edits(word, letters):
    for k in range(len(word) + 1):
        if k < len(word):
            yield word[:k] + word[k + 1:]
            yield from (word[:k] + c + word[k + 1:] for c in letters)
        yield from (word[:k] + c + word[k:] for c in letters)


def plain_variants(words):
    letters, out, form = sorted(set("".join(words))), {}, {}
    for w, n in words.items():
        near = {e for e in edits(w, letters) if e in words and e != w}
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
        out[w] = (n, len(near))
    rows = set()
    for w, (n, near) in out.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n, near, words[form[w]] if form[w] else None))
    return rows


def rows_of(df):
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def made(n=400, seed=5):
    rng = np.random.default_rng(seed)
    base = ["".join(chr(97 + c) for c in rng.integers(0, 4, rng.integers(7, 11))) for _ in range(40)] + ["naïveté", "élégance×÷"]
    rows = []
    for i in range(n):
        words = []
        for k in rng.zipf(1.3, 30) % len(base):
            w = base[k]
            if rng.random() < 0.15:
                at, kind = rng.integers(len(w)), rng.integers(3)
                w = w[:at] + ("", "q" + w[at], "z")[kind] + w[at + 1:]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, " ".join(words)))
    return rows


def test_variants_against_plain_version(spark):
    rows = made()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    words = plain_words(rows)
    assert {(r.word, r.n) for r in V.word_counts(frame).collect()} == set(words.items())
    want = plain_variants(words)
    assert sum(r[1] is not None for r in want) > 10 and any(r[2] != r[1] for r in want if r[1])
    assert rows_of(V.spelling_variants(V.word_counts(frame))) == want
    assert rows_of(V.spelling_variants(V.word_counts(frame), tile_words=3)) == want          # hot blocks in tiles


def test_roots_follow_chains(spark):
    words = spark.createDataFrame([("aaaaaaa", 1), ("aaaaaab", 10), ("aaaaabb", 100), ("aaaabbb", 1000), ("bbbbbbb", 5)],
                                  "word string, n long")
    got = rows_of(V.spelling_variants(words))
    assert got == {("aaaaaaa", "aaaaaab", "aaaabbb", 1, 1, 10), ("aaaaaab", "aaaaabb", "aaaabbb", 10, 2, 100),
                   ("aaaaabb", "aaaabbb", "aaaabbb", 100, 2, 1000), ("aaaabbb", None, "aaaabbb", 1000, 1, None),
                   ("bbbbbbb", None, "bbbbbbb", 5, 0, None)}


def test_edges(spark):
    long = "ab" * 3000
    odd = [(1, None), (2, ""), (3, "12 ¿? short"), (None, "Variant variant"), (None, "variant"), (4, "varianT ÀÉÎÕÜßÿ"),
           (5, "ÀÉÎÕÜßÿ variantx"), (5, "variantx"), (5, "variantx"), (6, f"{long} {long}c"), (7, f"{long} {long}c"),
           (8, "x" * 200_000), (9, "x" * 200_000), (10, "x" * 199_999 + " " + "x" * 199_999)]
    frame = spark.createDataFrame(odd, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "word", "tile")})
    words = plain_words(odd)
    near = {w: {x for x in words if x != w and abs(len(x) - len(w)) <= 1 and edited(w, x)} for w in words}
    got = {r.word: r for r in V.spelling_variants(V.word_counts(frame)).collect()}
    assert {w: r.n for w, r in got.items()} == words
    assert {w: r.n_near for w, r in got.items()} == {w: len(x) for w, x in near.items()}
    empty = V.spelling_variants(V.word_counts(frame.limit(0)))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.count() == 0


def edited(a, b):
    a, b = sorted((a, b), key=len)
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abà", min_size=7, max_size=8), min_size=2, max_size=12, unique=True))
def test_pairs_of_blocks(words):
    for n in (7, 8):
        one = [w for w in words if len(w) == n]
        for m in (n, n + 1):
            two = [w for w in words if len(w) == m]
            if one and two:
                i, j = V.near_pairs(V.letters_of(one), V.letters_of(two), m == n)
                want = {(x, y) for x in one for y in two if edited(x, y) and x != y}
                got = {(one[a], two[b]) for a, b in zip(i, j)}
                assert (got | {(y, x) for x, y in got} if m == n else got) == want


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    rel = con.sql(V.VARIANTS_SQL)
    names = rel.columns
    want = {tuple(r[names.index(c)] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in rel.fetchall()}
    assert rows_of(V.variants_query(spark, SF)) == want and want

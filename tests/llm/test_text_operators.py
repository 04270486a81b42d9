"""Quality, toxicity, language and BPE against plain versions, and their edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcounts.llm import bpe, language, quality, toxicity
from fieldcounts.llm.common import chunks

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "  \n\n "), (4, "word"), (5, "a b c d e f g h " * 9), (6, "x " * 60_000), (7, "É ß 日本 😀"),
       (7, "É ß 日本 😀"), (None, "no id at all, but words")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, "s") for i, t in ODD],
                                 "doc_id long, text string, lang string, n_words string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
    covered = set()
    for k in range(len(words) - 7):
        if windows[tuple(words[k:k + 8])] > 1:
            covered.update(range(k, k + 8))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_measures_equal_a_plain_version(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for frame in (docs, odd):
        for r in quality.measure(frame).collect():
            want = plain_measures(r.text)
            assert tuple(r[n] for n in names) == want
            assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
            assert r.kept == (not r.base_failed) and r.quality is None      # no model: base rules alone


def test_quality_query_keeps_good_and_drops_bad(spark):
    got = {r.doc_id: r for r in quality.quality_query(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert not any(r.kept and r.base_failed for r in got.values())
    good = [got[r.doc_id] for r in labels if r.quality == 1]
    bad = [got[r.doc_id].kept for r in labels if r.quality == 0]
    assert np.mean([r.kept for r in good if not r.base_failed]) > 0.97 and np.mean(bad) < 0.1


def test_quality_without_labels_or_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (None, 0), (5, None)], "doc_id long, quality int")
    assert quality.train(odd, labels) is None
    assert quality.train(odd, labels.limit(0)) is None
    assert quality.measure(empty).count() == 0
    out = quality.measure(odd)                       # n_words of the input is replaced
    assert out.schema["n_words"].dataType.simpleString() == "bigint" and out.columns.count("n_words") == 1


def test_chunks_cover_all_texts():
    texts = ["ab", "", "c" * 50, "d", ""]
    assert [texts[a:b] for a, b in chunks(texts, 3)] == [["ab", ""], ["c" * 50], ["d", ""]]
    assert list(chunks([], 3)) == []


def test_toxicity_on_planted_words(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("aeiou", k=2)) + rng.choice(["nd", "th", "er", "ing"]) for _ in range(200)]
    rows = []
    for i in range(400):
        text = rng.choices(words, k=150)
        if i % 4 == 0:
            for k in range(0, 150, 15):
                text[k] = rng.choice(["blorgish", "snuzzwort", "quafflehead"])
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 300], "doc_id long, toxic int")
    out = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    right = [(out[i] >= toxicity.THRESHOLD) == bool(y) for i, _, y in rows if i >= 300]
    assert np.mean(right) > 0.95


def test_toxicity_query_contract(spark):
    out = toxicity.toxicity_query(spark, SF).collect()
    assert len({r.doc_id for r in out}) == len(out) == 1000
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r.predicted, label[r.doc_id]) for r in out if r.held_out and r.doc_id in label]
    assert np.mean([p == y for p, y in held]) > 0.85


def test_toxicity_edges(spark, odd, empty):
    assert toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert toxicity.train(odd, spark.createDataFrame([(4, 1), (5, 1)], "doc_id long, toxic int")) is None
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}
    few = toxicity.train(odd, spark.createDataFrame([(4, 1), (5, 0), (6, 0), (None, 1)], "doc_id long, toxic int"))
    got = toxicity.score(odd, few).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty, few).count() == 0


def test_language_held_out_accuracy_and_contract(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    out = language.language_query(spark, SF).collect()
    assert len(out) == len(truth)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in out if r.held_out]) > 0.97


def test_language_kernel_is_the_share_of_common_grams():
    x = language.presence(["abab", "ba", ""])
    k = language.kernel(x, x[:2])
    grams = [{t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in ("abab", "ba")]
    want = len(grams[0] & grams[1]) / np.sqrt(len(grams[0]) * len(grams[1]))
    assert np.allclose(k[:2], [[1, want], [want, 1]]) and not k[2].any()


def test_language_edges(spark, odd, empty):
    assert language.train(odd) is None                       # no language is known
    assert {r.lang_pred for r in language.identify(odd, None).collect()} == {"und"}
    model = language.train(spark.createDataFrame([(1, "the house", "en"), (2, "das haus", "de"), (3, "12", "en"),
                                                  (None, "x", "en"), (4, None, "de")],
                                                 "doc_id long, text string, lang string"))
    got = collections.defaultdict(set)
    for r in language.identify(odd, model).collect():
        got[r.doc_id].add((r.lang_pred, r.score))
    assert got[1] == got[2] == got[3] == {("und", 0.0)} and len(got[7]) == 1
    assert language.identify(empty, model).count() == 0


def test_automaton_against_merging_pair_by_pair():
    """A small vocabulary with doubled letters, against merging the first pair of lowest rank again and again."""
    letters = "ab"
    base = [*letters, *(c + "</w>" for c in letters)]
    rng = random.Random(1)
    for _ in range(30):
        vocab, merges = list(base), []
        while len(merges) < 12:
            u, v = rng.choice(vocab), rng.choice(vocab)
            if u.endswith("</w>") or u + v in vocab:
                continue
            plain = [c for c in (u + v).replace("</w>", "")]
            if (u + v).endswith("</w>"):
                plain[-1] += "</w>"
            if merged(plain, merges) != [u, v]:
                continue                              # a merge that never happens is no merge of a trained list
            merges.append((u, v))
            vocab.append(u + v)
        machine = bpe.Automaton(merges, {t: i for i, t in enumerate(vocab)}, "</w>")
        for _ in range(200):
            word = "".join(rng.choices(letters, k=rng.randint(1, 9)))
            want = merged([*word[:-1], word[-1] + "</w>"], merges)
            assert [vocab[i] for i in machine.encode(word)] == want, (word, merges)


def merged(parts, merges):
    parts = list(parts)
    rank = {pair: k for k, pair in enumerate(merges)}
    while True:
        found = [(rank[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in rank]
        if not found:
            return parts
        _, k = min(found)
        parts[k:k + 2] = [parts[k] + parts[k + 1]]


def test_bpe_equals_the_library(spark, odd, empty):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(bpe.default_tokenizer())
    lib.no_truncation()
    lib.no_padding()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(9_000 + k, t) for k, t in enumerate([
        "<|endoftext|>a<|startoftext|>", "don't DON'T it's", "ΑΣ Σ İx ½ ² 3४", "a\x1cb\x85c d", "aaaaaaaaa ssssssss",
        "é é", "......!!!", "﻿​"])], "doc_id long, text string")
    odd = odd.select((F.col("doc_id") + 8_000).alias("doc_id"), "text")
    frame = docs.unionByName(odd).unionByName(extra)
    texts = collections.defaultdict(list)
    for r in frame.collect():
        texts[r.doc_id].append(r.text)
    for r in bpe.digests(frame).collect():
        ids = lib.encode(texts[r.doc_id][0] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    one = bpe.encode_decode(extra).filter("doc_id = 9001").first()
    assert one.decoded == lib.decode(np.frombuffer(one.ids, "<u4").tolist(), skip_special_tokens=False)
    assert bpe.digests(empty).count() == 0


def test_workers_get_the_package_root(spark):
    quality.text_batches(spark)
    assert any(p.endswith("repo") for p in spark.sparkContext.environment["PYTHONPATH"].split(":"))
    assert spark.range(1).select(F.lit(1)).count() == 1

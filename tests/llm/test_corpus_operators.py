"""Deduplication, masking, packing and archiving against plain versions, and their edge cases."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldcounts.llm import embed_dedup, minhash, packing, pii, queries, substring, warc
from fieldcounts.llm.common import components
from fieldcounts.session import scratch_path

SF = "/root/testdata/sf0.001"


def words(n, seed=0, size=9):
    rng = np.random.default_rng(seed)
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, size)) for _ in range(n)]


# ---------------------------------------------------------------- components

def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (7, 8), (None, 3)], "src long, dst long")
    assert {tuple(r) for r in components(e, "t").collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (7, 7), (8, 7), (9, 7)}
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)], "src long, dst long")
    assert {r.component for r in components(chain, "t").collect()} == {0}
    assert components(e.limit(0), "t").count() == 0


# ---------------------------------------------------------------- near-dedup

def near(frame):
    return {r.id: r.component for r in minhash.near_duplicates(frame).collect()}


def test_near_duplicates_against_all_pairs(spark):
    base, rows = words(120, 1), []
    rng = np.random.default_rng(2)
    for i in range(60):                                   # copies of one text with more and more changes
        text = list(base)
        for k in rng.choice(120, size=i // 4, replace=False):
            text[k] = words(1, 1000 + 7 * i + k)[0]
        rows.append((i, " ".join(text)))
    rows += [(100 + i, " ".join(words(80, 50 + i))) for i in range(20)] + [(200, rows[5][1].upper() + " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near(docs)
    ids, sets = [r[0] for r in rows], minhash.shingles([r[1] for r in rows])
    cells = np.zeros(minhash.CELLS, dtype=np.int64)
    for s in sets:
        np.add.at(cells, minhash._cells(np.unique(s)), 1)
    rare = minhash.rarity(len(rows), cells)
    weighted = [minhash.weighted_set(s, rare) for s in sets]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if minhash.similarity(weighted[a], weighted[b]) >= 0.8:
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in ids}


def test_near_duplicates_edges(spark):
    long = " ".join(words(30_000, 3))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "two words"), (5, "TWO  words"), (6, long), (6, long), (None, "two words"),
            (8, long + " tail"), (9, "other words here")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component string")
    assert near(docs) == {4: 4, 5: 4, 6: 6, 8: 6, 9: 9}
    assert near(docs.limit(0)) == {}
    kept = [r.doc_id for r in minhash.dedup_stage(spark, docs, SF).collect()]
    assert sorted(kept, key=lambda x: (x is None, x)) == [1, 2, 3, 4, 6, 9, None]


def test_sampling_agrees_with_the_similarity():
    rng = np.random.default_rng(5)
    rare = np.full(minhash.CELLS, 0.3, dtype=np.float32)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = np.concatenate([a[:350], rng.integers(0, 1 << 63, 60, dtype=np.uint64)])
    wa, wb = minhash.weighted_set(a, rare), minhash.weighted_set(b, rare)
    want = minhash.similarity(wa, wb)
    tool, hits, n = minhash.Sampler(), 0, 0
    for seed in range(40):
        tool.turns = np.random.default_rng(seed).integers(1, 1 << 63, 56, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        hits += (tool.bands(*wa) == tool.bands(*wb)).sum()
        n += minhash.BANDS
    assert abs(hits / n - want ** minhash.ROWS) < 0.08


def test_word_hashes_across_the_seam_of_powers():
    text = " ".join(words(9000, 8)) + " " + "q" * 70_000 + " " + " ".join(words(20, 8))
    one, = minhash.shingles([text])
    shifted = minhash.shingles(["pad pad " + text])[0]
    assert len(set(one.tolist()) - set(shifted.tolist())) == 0


# ---------------------------------------------------------------- substring dedup

def cut_texts(frame, **how):
    return {r.doc_id: (r.text, [(x.start, x.end) for x in r.removed])
            for r in substring.remove_repeats(frame, **how).collect()}


def test_units_cover_the_text():
    for text in ("", "one", "A b c d e. F g.\nH!  i j k l m n? o\n\n\np", " \n x ", "...", "a.b.c d. e"):
        parts = substring.units(text)
        assert "".join(text[a:b] for a, b, _ in parts) == text
        assert [w for _, _, ws in parts for w in ws] == text.lower().split()


def test_a_passage_set_into_other_sentences_is_found_whole(spark):
    w = words(200, 11)
    passage = f"{' '.join(w[:14]).capitalize()}. {' '.join(w[14:30])}. {' '.join(w[30:55])}"
    docs = spark.createDataFrame([
        (1, f"{' '.join(w[60:70])} {passage} {' '.join(w[70:90])}."),
        (2, f"{' '.join(w[90:99])}. Then {passage} and {' '.join(w[99:110])}."),
        (3, f"{passage}\n{' '.join(w[110:120])}"),
        (4, f"{' '.join(w[120:140])}. Short one. {' '.join(w[140:150])}."), (5, "Short one. " + " ".join(w[150:170]))],
        "doc_id long, text string")
    got = cut_texts(docs)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert got[1] == (text[1], []) and got[4] == (text[4], []) and got[5] == (text[5], [])
    assert " ".join(got[2][0].split()) == f"{' '.join(w[90:99])}. Then and {' '.join(w[99:110])}."
    assert got[3][0].split() == w[110:120]
    for k in (2, 3):
        left, at = "", 0
        for a, b in got[k][1]:
            left, at = left + text[k][at:a], b
        assert left + text[k][at:] == got[k][0]           # the offsets are those of the original


def test_substring_edges(spark):
    line = " ".join(words(12, 5))
    long = ". ".join(" ".join(words(9, 900 + k)) for k in range(3000))
    rows = [(1, None), (2, ""), (3, line), (3, line), (4, line.upper()), (4, "other text"), (None, line), (6, long),
            (7, "x " + long), (8, f"{line}\n{line}")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, removed string")
    out = [(r.doc_id, r.text) for r in substring.remove_repeats(docs).collect()]
    assert out.count((3, line)) == 2                      # repeated rows are one document
    assert (4, "") in out and (4, "other text") in out and (None, "") in out and (8, "") in out
    assert (1, None) in out and (2, "") in out and (6, long) in out
    assert [t for i, t in out if i == 7][0].split()[:1] == ["x"] and len([t for i, t in out if i == 7][0]) < 100
    assert substring.remove_repeats(docs.limit(0)).count() == 0
    assert sorted({r.doc_id for r in substring.substring_stage(spark, docs.drop("removed"), SF).collect()
                   if r.doc_id}) == [1, 3, 4, 6, 7]


# ---------------------------------------------------------------- PII

def masked(spark, *texts):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, parts string")
    return [r.text for r in pii.replace_entities(docs).orderBy("doc_id").collect()]


def test_surrogates_keep_type_format_and_coreference(spark):
    a, b, c = masked(
        spark, "Mail JOHN.SMITH@Acme.com, john.smith@acme.com or jane@acme.com; call +1 (017) 555-7713 or +1-017-555-7713.",
        "IP 192.168.1.5, 8.8.8.8. Card 4111 1111 1111 1111 and 4111111111111111, no card 1234567.",
        "Mr. John Smith met Mrs Smith, Frau Anna Müller and Госпожа Анна Петрова. password=b7db7aa4a5fcc78305")
    m = re.fullmatch(r"Mail (\S+)@(\S+), (\S+)@(\S+) or (\S+)@(\S+); call (.+) or (.+)\.", a)
    assert m[1] == m[3].upper() and m[2] == m[4] == m[6] and m[5] != m[3] and m[2].endswith(".com") and "acme" not in a.lower()
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", m[7]) and re.sub(r"\D", "", m[7]) == re.sub(r"\D", "", m[8])
    assert re.search(r"IP 192\.168\.\d+\.\d+, ", b) and "8.8.8.8" not in b and "1234567" in b
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", b)
    assert cards[0].replace(" ", "") == cards[1] != "4111111111111111" and cards[1][0] == "4"
    digits = [int(x) for x in cards[1][::-1]]
    assert sum(digits[::2] + [d * 2 - 9 * (d > 4) for d in digits[1::2]]) % 10 == 0
    p = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+), Frau (\w+) (\w+) and Госпожа (\w+) (\w+)\. password=([0-9a-f]{18})", c)
    assert p[2] == p[3] and p[1] in pii.GIVEN[("m", "latin")] and p[4] in pii.GIVEN[("f", "latin")]
    assert p[6] in pii.GIVEN[("f", "cyrillic")] and re.fullmatch("[А-Яа-я]+", p[7]) and p[8] != "b7db7aa4a5fcc78305"


def test_surrogates_are_distinct_and_new(spark):
    atoms = spark.createDataFrame([("given_m_latin", f"name{k}") for k in range(60)]
                                  + [("secret", f"{k:02d}") for k in range(100)]
                                  + [("local", x) for x in "abcdefghijklmnopqrstuvwxyz"], "kind string, norm string")
    out = pii.surrogates(atoms).collect()
    assert len(out) == 186 and len({(r.kind, r.surrogate) for r in out}) == 186
    assert not {(r.kind, r.surrogate) for r in out} & {(r.kind, r.norm) for r in out}
    assert {tuple(r) for r in out} == {tuple(r) for r in pii.surrogates(atoms).collect()}
    other = {(r.kind, r.norm): r.surrogate for r in pii.surrogates(atoms, key="another").collect()}
    assert sum(other[(r.kind, r.norm)] != r.surrogate for r in out) > 100


def test_pii_edges_and_native_plan(spark):
    long = "word " * 40_000 + "a.b@c.de " * 300
    out = masked(spark, None, "", "no entity, version 2.0.", long, "x@y.zz", "x@y.zz")
    assert out[:3] == [None, "", "no entity, version 2.0."] and out[4] == out[5] != "x@y.zz"
    assert out[3].startswith("word word") and "a.b@c.de" not in out[3] and len(set(out[3].split()[-300:])) == 1
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.replace_entities(docs).count() == 0
    plan = pii.pii_query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------- packing

def test_packing_is_whole_gapless_and_tight(spark):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(packing.default_tokenizer())
    lib.no_truncation()
    lib.no_padding()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {}
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at:at + 2048], dtype="<u4")
            want[r.doc_id, piece] = (at, len(part), zlib.crc32(part.tobytes()))
    out = packing.packing_query(spark, "/root/testdata/sf0.01").toPandas()
    assert {(a, b): (c, d, e) for a, b, c, d, e in out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(
        index=False)} == want
    out = out.sort_values(["sequence_id", "offset"])
    assert (out.groupby("sequence_id").length.cumsum() - out.length == out.offset).all()
    assert out.groupby("sequence_id").length.sum().max() <= 2048
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 2048) * 1.01 + 1


def test_packing_edges(spark):
    docs = spark.createDataFrame([(1, None, 9), (1, None, 9), (2, "", 9), (None, "hello", 9), (3, "word " * 9000, 9)],
                                 "doc_id long, text string, offset int")
    from fieldcounts.llm.common import cut
    out = packing.pack(cut(packing.token_pieces(docs), "t")).collect()
    assert sorted(r.length for r in out if r.doc_id in (1, 2)) == [1, 1, 1] and len(out) == 4 + 5
    assert packing.pack(cut(packing.token_pieces(docs.limit(0)), "t")).count() == 0


def test_plans_cover_every_piece_once():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 900):
        lengths = np.clip(rng.lognormal(5, 1.2, n).astype(int) + 1, 1, 512)
        counts = np.bincount(lengths, minlength=513)
        plan = packing.make_plan(counts, 512)
        filled, seen = {}, np.zeros(513, dtype=int)
        for length, rank, number, first, offset in plan.tolist():
            assert rank == seen[length]
            seen[length] += number
            for s in range(first, first + number):
                filled.setdefault(s, []).append((offset, length))
        assert (seen == counts).all()
        for parts in filled.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= 512


# ---------------------------------------------------------------- vectors

def test_embedding_links_against_all_pairs_and_edges(spark):
    rng = np.random.default_rng(7)
    rows = []
    centres = rng.normal(size=(12, 16))
    for i in range(300):
        v = centres[i % 12] + 0.06 * rng.normal(size=16)
        rows.append((i, [float(np.float32(x)) for x in v], i % 2))
    rows += [(300 + k, rows[0][1], 0) for k in range(40)]                      # one common vector
    rows += [(900, rows[0][1], None), (901, None, 0), (902, [], 0), (903, [0.0] * 16, 0), (904, [float("nan")] * 16, 0),
             (905, [None] + rows[0][1][1:], 0), (906, [float("inf")] + rows[0][1][1:], 0), (None, rows[0][1], 0),
             (908, rows[0][1][:8], 0), (909, [1e-30 * x for x in rows[0][1]], 0), (910, [1e30 * x for x in rows[0][1]], 0)]
    frame = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "vec_id long, embedding array<double>, label int, links int")
    got = {r.id: (r.n_links, r.component) for r in embed_dedup.near_vectors(frame, block=32).collect()}
    good = [(i, np.array(v), c) for i, v, c in rows if i is not None and c is not None and v and None not in v
            and np.isfinite(v).all() and np.any(v)]
    unit = {i: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for i, v, _ in good}
    links = {i: {j for j, w, d in good if j != i and c == d and len(w) == len(v) and unit[i] @ unit[j] >= 0.98}
             for i, v, c in good}
    low = {i: i for i in links}
    for _ in links:
        new = {i: min([low[i], *(low[j] for j in links[i])]) for i in links}
        if new == low:
            break
        low = new
    for i, js in links.items():
        assert got.get(i, (0, i)) == (len(js), low[i])
    assert not set(got) & {900, 901, 902, 903, 904, 905, 906, None}
    assert embed_dedup.near_vectors(frame.limit(0)).count() == 0


# ---------------------------------------------------------------- archive

def test_archive_round_trip_and_edges(spark):
    big = "<p>" + "x" * 200 + "</p>"
    rows = [(5, "u5", big), (2, "u2", big), (9, None, big), (None, "un", big), (3, "u3\r\nX: y", "small"), (4, "u4", "small"),
            (6, "u6", None), (7, "u7", "é" * 60), (7, "u7", "é" * 60), (1, "u1", "é" * 49 + "a")]
    pages = spark.createDataFrame([(a, b, c, 0) for a, b, c in rows], "page_id long, url string, html string, digest int")
    path = scratch_path(spark, "test-archive")
    warc.write_archive(pages, path)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.select("digest").distinct().count() == 5
    back = warc.read_archive(spark, path).collect()
    assert len(back) == len(rows) and all(r.verified for r in back)
    kind = {r.record_id: (r.record_type, r.refers_to) for r in back}
    assert kind == {2: ("response", None), 5: ("revisit", 2), 9: ("revisit", 2), None: ("revisit", 2), 3: ("response", None),
                    4: ("response", None), 6: ("response", None), 7: ("response", None), 1: ("response", None)}
    for r in back:
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert len(block) - 4 == int(fields["Content-Length"]) and block.endswith(b"\r\n\r\n")
        assert fields["WARC-Payload-Digest"] == "sha256:" + r.payload_digest
        if r.record_type == "response":
            assert block[:-4].endswith(bytes(r.payload)) and r.payload_bytes == len(r.payload)
    empty = scratch_path(spark, "test-archive")
    warc.write_archive(pages.limit(0), empty)
    assert warc.read_archive(spark, empty).count() == 0


# ---------------------------------------------------------------- queries and pipeline

@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_with_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(queries.oracle_sql()[name])
    names = sorted(rel.columns)
    want = sorted(repr([row[rel.columns.index(c)] for c in names]) for row in rel.fetchall())
    frame = queries.queries()[name](spark, SF)
    assert sorted(frame.columns) == names
    assert sorted(repr([r[c] for c in names]) for r in frame.collect()) == want


def test_all_operators_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 14))


def test_pipeline_stage_by_stage(spark):
    """Each stage's rows against the operator's own verdicts, and the packed ids against the last texts."""
    from tokenizers import Tokenizer
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns
        kept.append({r.doc_id: r.text for r in docs.collect()})
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    quality, near_, sub, private = kept
    assert all(texts[i] == t for i, t in quality.items()) and 0 < len(quality) < len(texts)
    assert all(quality[i] == t for i, t in near_.items()) and set(near_) <= set(quality)
    groups = near(spark.createDataFrame(sorted(quality.items()), "doc_id long, text string"))
    assert set(near_) == {i for i in quality if groups.get(i, i) == i}
    assert set(sub) <= set(near_) and all(len(t) <= len(near_[i]) for i, t in sub.items())
    assert set(private) == set(sub)
    out = corpus_pipeline.run(spark, SF).toPandas()
    lib = Tokenizer.from_file(packing.default_tokenizer())
    lib.no_truncation()
    lib.no_padding()
    size = out.groupby("doc_id").length.sum().to_dict()
    assert size == {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in private.items()}
    assert corpus_pipeline.ORACLE_SQL is None and F is not None

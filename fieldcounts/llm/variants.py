"""Spelling variants: words at one edit, found by blocked Gram matrices of letter counts.

Two words are near if they differ by exactly one inserted, deleted or replaced
code point.  One edit changes the letter counts by a squared distance of 1 (a
letter more) or 2 (a letter for another), so near words lie within a squared
distance of 2, in blocks of equal or adjacent length.

* A block holds words of one length and one signature (the letters, dealt into
  ``GROUPS`` groups by code point, counted by group).  An edit moves at most
  one letter between two groups, so a block meets itself, the blocks of its
  length with one letter moved, and those of the next length with one more.
  Large blocks are dealt into tiles; every pair of tiles is a task of its own.
* In a task the squared distances come from one matrix product of the letter
  counts, |a|^2 + |b|^2 - 2ab.  Pairs at 2 or less are verified letter by letter.
* A task returns, for each word, how many near words it met there and the best
  of them, never the pairs.

Nothing is capped: hot blocks become more tiles.  The work grows with the
square of a signature's words, spread over tasks.

A word's form is its near word of the largest count (ties: the smallest in
code-point order), if that count is at least ``RATIO`` times its own.  The root
follows forms to the last one; counts grow at each step, so there are few.

Defined results: NULL, empty and letterless texts have no words; a NULL id
counts as an empty one; repeated rows count each; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, text_batches

LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
DROP_EVERY = 31            # of the (document, run) pairs, one in so many loses a letter (see ``slipped``)
GROUPS = 5
TILE_WORDS = 2048
TILE_LETTERS = 1 << 20     # letters of a tile, for very long words
VERIFY = 1 << 22           # letters compared at once
HELD_WORDS = 200_000       # different words a task holds before it hands them on
LETTERS = 26 + 64          # a-z and the code points from U+00C0 to U+00FF
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LETTERS)


# ---------------------------------------------------------------- words of the texts

def slipped(run: str, start: int) -> str:
    """The run, without one letter if the checksum says so; ``start`` is the crc32 of what precedes the run."""
    h = zlib.crc32(run.encode("utf-8"), start)
    if h % DROP_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of at least ``LEAST_LETTERS`` letters that occur ``LEAST_COUNT`` times or more."""
    text_batches(docs.sparkSession)

    def run(batches):
        found: Counter = Counter()

        def handed():
            batch = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())],
                                               ["word", "n"])
            found.clear()
            return batch
        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                # bytes.lower changes A-Z alone
                lowered = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for letters, n in Counter(_RUN.findall(lowered)).items():
                    word = slipped(letters, start)
                    if len(word) >= LEAST_LETTERS:
                        found[word] += n
                if len(found) > HELD_WORDS:
                    yield handed()
        if found:
            yield handed()

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return (texts.filter("text IS NOT NULL").mapInArrow(run, "word string, n long").groupBy("word")
            .agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT))


# ---------------------------------------------------------------- blocks of words

def _signature():
    """Letters of each group (by code point), counted in the word."""
    alphabet = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100))]
    return [F.length("word") - F.length(F.translate("word", "".join(c for c in alphabet if ord(c) % GROUPS == g), ""))
            for g in range(GROUPS)]


def word_blocks(words: DataFrame, tile_words: int = TILE_WORDS) -> DataFrame:
    """(length, key, tile, words, counts): the tiles of words of one length and signature."""
    keyed = words.select("word", "n", F.length("word").alias("length"), F.array(*_signature()).alias("groups"))
    keyed = cut(keyed, "variant-keys")
    tiles = keyed.groupBy("length", "groups").agg(F.ceil(F.count("*") / F.greatest(F.lit(1), F.least(
        F.lit(tile_words), F.floor(F.lit(TILE_LETTERS) / F.col("length"))))).cast("int").alias("tiles"))
    dealt = keyed.join(tiles, ["length", "groups"]).withColumn("tile", F.pmod(F.xxhash64("word"), "tiles").cast("int"))
    return (dealt.groupBy("length", "groups", "tile").agg(F.collect_list(F.struct("word", "n")).alias("held"))
            .select("length", "groups", "tile", F.col("held.word").alias("words"), F.col("held.n").alias("counts")))


def block_pairs(tiles: DataFrame) -> DataFrame:
    """(length, groups, tile, length_b, groups_b, tile_b): every pair of tiles that can hold near words, once."""
    def moved(more: int | None, less: int | None):
        step = [F.lit((g == more) - (g == less)) for g in range(GROUPS)]
        return F.struct((F.col("length") + F.lit(int(less is None and more is not None))).alias("length_b"),
                        F.array(*[F.col("groups")[g] + step[g] for g in range(GROUPS)]).alias("groups_b"))
    targets = [moved(None, None), *[moved(i, j) for j in range(GROUPS) for i in range(j)],
               *[moved(g, None) for g in range(GROUPS)]]
    asked = tiles.select("length", "groups", "tile", F.explode(F.array(*targets)).alias("t")).select(
        "length", "groups", "tile", "t.*")
    other = tiles.select(F.col("length").alias("length_b"), F.col("groups").alias("groups_b"),
                         F.col("tile").alias("tile_b"))
    same = (F.col("length") == F.col("length_b")) & (F.col("groups") == F.col("groups_b"))
    return asked.join(other, ["length_b", "groups_b"]).filter(~same | (F.col("tile") <= F.col("tile_b")))


def letters_of(words: list[str]) -> np.ndarray:
    """Words of one length as rows of letter numbers (0 to ``LETTERS`` - 1)."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int32)
    return np.where(codes < 128, codes - 97, codes - 0xC0 + 26).reshape(len(words), -1)


def close_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) whose letter counts lie within a squared distance of 2, by one Gram matrix."""
    kind = np.float32 if b.shape[1] <= 4096 else np.float64            # whole numbers, exact in both

    def counts(x):
        flat = np.arange(len(x))[:, None] * LETTERS + x
        return np.bincount(flat.ravel(), minlength=len(x) * LETTERS).reshape(len(x), LETTERS).astype(kind)
    x, y = counts(a), counts(b)
    gap = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    return np.nonzero(gap <= 2)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row, do the words differ by exactly one edit?  ``b`` is as long as ``a`` or one letter longer."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    unlike = a != b[:, :n]
    first = np.where(unlike.any(axis=1), unlike.argmax(axis=1), n)
    shifted = (a == b[:, 1:]) | (np.arange(n)[None, :] < first[:, None])
    return shifted.all(axis=1)


def near_pairs(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    i, j = close_pairs(a, b)
    if same:
        i, j = i[i < j], j[i < j]
    step = max(1, VERIFY // b.shape[1])
    good = [one_edit(a[i[k:k + step]], b[j[k:k + step]]) for k in range(0, len(i), step)]
    good = np.concatenate(good) if good else np.zeros(0, dtype=bool)
    return i[good], j[good]


def best_of(words: list, counts: list, i: np.ndarray, j: np.ndarray, other: list, other_counts: list) -> list[tuple]:
    """(word, near words, best count, best word) of the words ``i`` that are near ``other[j]``."""
    if not len(i):
        return []
    turn = np.empty(len(other), dtype=np.int64)
    ranked = sorted(range(len(other)), key=lambda k: (-other_counts[k], other[k]))
    turn[ranked] = np.arange(len(other))
    order = np.lexsort((turn[j], i))
    i, j = i[order], j[order]
    starts = np.flatnonzero(np.diff(i, prepend=-1))
    sizes = np.diff(starts, append=len(i))
    return [(words[i[s]], int(n), other_counts[j[s]], other[j[s]]) for s, n in zip(starts, sizes)]


def near_words(blocks: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have near words."""
    spark = blocks.sparkSession
    pairs = cut(block_pairs(blocks.select("length", "groups", "tile")), "variant-pairs")

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                same = row["same"]
                one, two = row["words"], row["words_b"]
                a = letters_of(one)
                b = a if same else letters_of(two)
                i, j = near_pairs(a, b, same)
                if same:
                    i, j = np.concatenate([i, j]), np.concatenate([j, i])
                else:
                    out += best_of(two, row["counts_b"], j, i, one, row["counts"])
                out += best_of(one, row["counts"], i, j, two, row["counts_b"])
            columns = list(zip(*out)) or [(), (), (), ()]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             ["word", "n_near", "best_n", "best"])

    key, key_b = ["length", "groups", "tile"], ["length_b", "groups_b", "tile_b"]
    right = blocks.select(*[F.col(c).alias(f"{c}_b") for c in (*key, "words", "counts")])
    same = (F.col("length") == F.col("length_b")) & (F.col("groups") == F.col("groups_b")) & (
        F.col("tile") == F.col("tile_b"))
    text_batches(spark)
    met = (pairs.join(blocks, key).join(right, key_b).select(same.alias("same"), "words", "counts", "words_b", "counts_b")
           .mapInArrow(run, "word string, n_near long, best_n long, best string"))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct(
        (-F.col("best_n")).alias("less"), "best")).alias("first")).select(
        "word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best"))


# ---------------------------------------------------------------- forms and roots

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)``, following forms to the last; a form's count is larger, so none comes back."""
    ahead = cut(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "variant-roots")
    while ahead.filter("moved").limit(1).count():
        jump = ahead.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = cut(ahead.join(jump, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "variant-roots")
    return ahead.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = RATIO, tile_words: int = TILE_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words(word, n)``; words are different, of the letters of this module."""
    words = cut(words.select("word", "n"), "variant-words")
    blocks = cut(word_blocks(words, tile_words), "variant-blocks")
    near = cut(words.join(near_words(blocks), "word").select(
        "word", "n_near", F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best")).alias("form"),
        F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best_n")).alias("form_n")), "variant-near")
    ends = roots(near.filter("form IS NOT NULL").select("word", "form"))
    return (words.join(near, "word", "left").join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))


def variants_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its near words, form and root."""
    return spelling_variants(word_counts(table(spark, sf_dir, "documents")))


def _crc_table() -> list[int]:
    """The checksum's table, by its rule: eight steps of the reflected polynomial for each byte."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


VARIANTS_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{7,}}')) AS run
  FROM documents WHERE text IS NOT NULL),
per AS (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY doc_id, run),
bytes AS (SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)) AS b
  FROM per),
crcs AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(b, lambda x: x::BIGINT)),
    lambda h, x: xor(h >> 8, list_extract({_crc_table()}::BIGINT[], (xor(h, x) & 255) + 1))), 4294967295) AS h FROM bytes),
slips AS (SELECT CASE WHEN h % {DROP_EVERY} = 0
    THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
    ELSE run END AS word, k FROM crcs),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM slips WHERE length(word) >= {LEAST_LETTERS} GROUP BY word
  HAVING sum(k) >= {LEAST_COUNT}),
cuts AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
links AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b
    ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM links GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
    CASE WHEN b.top >= {RATIO} * w.n THEN b.top END AS form_n,
    CASE WHEN b.top >= {RATIO} * w.n
      THEN (SELECT min(l.near) FROM links l WHERE l.word = w.word AND l.near_n = b.top) END AS form
  FROM words w LEFT JOIN best b ON b.word = w.word),
walk(word, place, step) AS (SELECT word, word, 0 FROM forms
  UNION ALL SELECT k.word, f.form, k.step + 1 FROM walk k JOIN forms f ON f.word = k.place WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(place, step) AS root FROM walk GROUP BY word)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON e.word = f.word
"""

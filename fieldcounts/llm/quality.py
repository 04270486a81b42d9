"""Quality rules: fixed base rules, and a calibrated logistic regression over hashed n-grams.

Base measures of a whole text (words are maximal runs of ``[^\\x20\\x09-\\x0D]``):
``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (characters
of ``[#*$%&|<>]``), ``n_dup_lines`` (lines with a word that equal an earlier
line) and ``n_repeat_words`` (words inside 8-word windows that occur twice or
more, the first occurrence included).

The classifier's features are hashed counts of word 1- and 2-grams and of
character 1- to 3-grams, each kind as a share of its total, so a text's length
does not move its score.  It is fitted on at most ``sample_rows`` labelled
rows, half of each class (those with the smallest hash of their id), calibrated
by Platt scaling on a held-out fifth weighted to the classes' frequency, and
then scores every text in Arrow batches.  Features and weights are rounded to
whole numbers of small units for the score's sum, which is then exact: equal
texts have equal scores, whatever batch they are in.

Defined results: a NULL or empty text has no words, fails the base rules and
is not kept; rows with a NULL label, NULL text or unknown id are not learned
from; with no labels of one of the classes no classifier is fitted and the
base rules alone decide (``quality`` is NULL); repeated rows are scored alike;
the columns of the input are returned with the measures appended (measures of
the same names in the input are replaced).
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, drawn_ids, table, text_batches

WINDOW = 8
DIM = 1 << 11              # buckets of each of the two kinds (words, characters)
SAMPLE_ROWS = 4000         # labelled rows learned from, at most
THRESHOLD = 0.3            # calibrated probability from which a text is kept
MIN_WORDS, MAX_REPEAT_SHARE = 20, 30
CHUNK_CHARS = 400_000      # characters whose n-grams are hashed at once
UNITS = 2.0 ** 16, 2.0 ** 20    # of features and weights; with weights below 2^10 all sums stay below 2^53
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_HAS_WORD = re.compile(r"[^\x20\x09-\x0d]")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


# ---------------------------------------------------------------- base rules

def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Words covered by windows of ``width`` words that occur twice or more (equality checked on the words)."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    key = _mix(ids.astype(np.uint64) * _M1)
    span = 1
    while span < width:               # widths 2, 4, 8: each key from the two halves of its window
        half = min(span, width - span)
        key = _mix(key[:len(key) - half] * _M1 + key[half:])
        span += half
    ordered = np.sort(key)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0        # equal windows have equal keys, so no window repeats
    values, counts = np.unique(key, return_counts=True)
    maybe = np.flatnonzero(np.isin(key, values[counts > 1]))
    rows = np.lib.stride_tricks.sliding_window_view(ids, width)[maybe]
    _, inverse, times = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    starts = maybe[times[inverse.ravel()] > 1]
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_measures(text: str | None) -> tuple[tuple[int, int, int, int, int], np.ndarray, list]:
    """The five measures, the text's word numbers and its different words (numbered by first appearance)."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()   # splits bytes at exactly \x20 \x09-\x0d
    seen = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(seen.__getitem__, words), dtype=np.int64, count=len(words))
    lines = text.split("\n")
    dup_lines = 0
    if len(lines) > 1:
        earlier: set = set()
        for line in lines:
            if line in earlier:
                dup_lines += _HAS_WORD.search(line) is not None
            else:
                earlier.add(line)
    measures = (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
                dup_lines, repeated_words(ids))
    return measures, ids, list(seen)


# ---------------------------------------------------------------- features

def _gram_counts(doc: np.ndarray, bucket: np.ndarray, n_docs: int) -> np.ndarray:
    return np.bincount(doc * DIM + bucket, minlength=n_docs * DIM).reshape(n_docs, DIM)


def _word_features(parsed: list) -> np.ndarray:
    out = np.zeros((len(parsed), DIM), dtype=np.float32)
    for row, (_, ids, words) in enumerate(parsed):
        if not len(ids):
            continue
        codes = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))[ids]
        one = _mix(codes * _M1)
        two = _mix(one[:-1] * _M1 + codes[1:])
        grams = np.concatenate([one, two]) >> np.uint64(53)          # 11 bits: DIM buckets
        out[row] = np.bincount(grams.astype(np.int64), minlength=DIM) / len(grams)
    return out


def _char_features(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), DIM), dtype=np.float32)
    for lo, hi in chunks(texts, CHUNK_CHARS):
        sizes = np.array([len(t) for t in texts[lo:hi]], dtype=np.int64)
        points = np.frombuffer("".join(texts[lo:hi]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if not len(points):
            continue
        doc = np.repeat(np.arange(hi - lo), sizes)
        counts = np.zeros((hi - lo, DIM), dtype=np.int64)
        key = np.zeros(len(points), dtype=np.uint64)
        for n in range(3):
            m = len(points) - n
            if m <= 0:
                break
            key = _mix(key[:m] * _M1 + points[n:] + np.uint64(1))
            whole = doc[:m] == doc[n:] if n else slice(None)
            counts += _gram_counts(doc[:m][whole], (key[whole] >> np.uint64(53)).astype(np.int64), hi - lo)
        out[lo:hi] = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return out


def features(texts: list[str], parsed: list) -> np.ndarray:
    """Square roots of the shares of hashed word and character n-grams (2 * DIM columns)."""
    return np.sqrt(np.hstack([_word_features(parsed), _char_features(texts)]))


# ---------------------------------------------------------------- model

def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def margins(x: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    """Weighted sums of feature rows, exact in whole units and so the same in any batch."""
    whole = np.rint(x.astype(np.float64) * UNITS[0]) @ np.rint(w * UNITS[1])
    return whole / (UNITS[0] * UNITS[1]) + b


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Class-balanced logistic regression by accelerated gradient descent; returns weights and intercept."""
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float64)
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb = w.copy(), b
    rate = 1.0 / (0.25 * max(float(weight @ np.einsum("ij,ij->i", x, x)) + 1, 1e-9) + ridge)
    for k in range(steps):
        err = weight * (sigmoid(x @ vw.astype(x.dtype) + vb) - y)
        nw, nb = vw - rate * (err.astype(x.dtype) @ x + ridge * vw), vb - rate * err.sum()
        push = k / (k + 3)
        vw, vb = nw + push * (nw - w), nb + push * (nb - b)
        w, b = nw, nb
    return w, float(b)


def fit_platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of Platt's sigmoid, by Newton steps on smoothed targets and weighted rows."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * margin + b)
        g, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-12)
        grad = np.array([g @ margin, g.sum()])
        hess = np.array([[h @ margin ** 2 + 1e-9, h @ margin], [h @ margin, h.sum() + 1e-9]])
        da, db = np.linalg.solve(hess, grad)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a), float(b)


def _sample_features(batches):
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        x = features(texts, [base_measures(t) for t in texts]).astype(np.float16)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary())],
            ["id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample_rows: int = SAMPLE_ROWS):
    """Weights, intercept and calibration learned from labelled rows, or None if a class is missing.

    The sample is, of each class, the ``sample_rows`` / 2 labelled documents with
    the smallest hash of their id, so it is the same whatever the partitioning.
    Its features are made on the executors; the driver gets ``sample_rows`` rows
    of 8 KB at most, and holds them once as packed bytes and once as numbers.
    """
    spark = docs.sparkSession
    text_batches(spark)
    known = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
             .filter("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label")))
    size = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}    # two rows
    if len(size) < 2:
        return None
    picked = drawn_ids(known, "label", sample_rows // 2)
    sample = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
              .filter("text IS NOT NULL").join(F.broadcast(picked), "id").select("id", "label", "text")
              .mapInArrow(_sample_features, "id long, label int, x binary").toArrow())
    # one row for each id, in the order of ids; ids with several texts take the first of equal rank
    first = {i: k for k, i in reversed(list(enumerate(sample.column("id").to_pylist())))}
    at = [first[i] for i in sorted(first)]
    labels_ = sample.column("label").to_pylist()
    y = np.array([labels_[k] for k in at], dtype=np.float64)
    if len(np.unique(y)) < 2:
        return None
    part = np.array([zlib.crc32(f"fold{i}".encode()) % 5 for i in sorted(first)])
    split = len(np.unique(y[part != 0])) == len(np.unique(y[part == 0])) == 2
    fit = part != 0 if split else np.ones(len(y), dtype=bool)
    held = ~fit if split else fit
    packed = sample.column("x")

    def rows(use: np.ndarray) -> np.ndarray:
        out = np.empty((int(use.sum()), 2 * DIM), dtype=np.float32)
        for to, k in enumerate(np.flatnonzero(use)):
            out[to] = np.frombuffer(packed[at[k]].as_buffer(), dtype=np.float16)
        return out

    w, b = fit_logistic(rows(fit), y[fit])
    good = y[held] == 1
    weight = np.where(good, size[1] / good.sum(), size[0] / (~good).sum()) * len(good) / (size[0] + size[1])
    return w.astype(np.float32), b, *fit_platt(margins(rows(held), w, b), y[held], weight)


def measure(docs: DataFrame, model=None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the base measures, ``base_failed``, ``quality`` (probability) and ``kept`` appended."""
    spark = docs.sparkSession
    text_batches(spark)
    added = T._parse_datatype_string(f"{MEASURES}, base_failed boolean, quality double, kept boolean")
    rest = docs.drop(*[c for c in docs.columns if c.lower() in {f.name for f in added}])
    held = spark.sparkContext.broadcast(model)   # 16 KB of weights

    def score(batches):
        fitted = held.value
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).cast(pa.string()).to_pylist()]
            parsed = [base_measures(t) for t in texts]
            m = np.array([p[0] for p in parsed], dtype=np.int64).reshape(-1, 5)
            failed = (m[:, 0] < MIN_WORDS) | (100 * m[:, 4] > MAX_REPEAT_SHARE * m[:, 0])
            if fitted is None:
                chance, kept = pa.nulls(len(texts), pa.float64()), ~failed
            else:
                w, b, slope, offset = fitted
                p = sigmoid(slope * margins(features(texts, parsed), w, b) + offset)
                chance, kept = pa.array(p), ~failed & (p >= threshold)
            columns = list(batch.columns) + [pa.array(m[:, k]) for k in range(5)] + [
                pa.array(failed), chance, pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names + added.names)

    return rest.mapInArrow(score, T.StructType(rest.schema.fields + added.fields))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return measure(docs.select("doc_id", "text"), model).drop("text")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the quality rules keep, with all their columns."""
    taken = {f.split()[0] for f in f"{MEASURES}, base_failed x, quality x, kept x".split(", ")}
    aside = {c: f"__input_{k}" for k, c in enumerate(docs.columns) if c.lower() in taken}
    scored = measure(docs.withColumnsRenamed(aside), train(docs, table(spark, sf_dir, "labels")))
    return scored.filter("kept").select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])

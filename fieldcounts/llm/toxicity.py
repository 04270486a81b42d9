"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary text, and
one on toxic text, namely on the passages of toxic documents made of byte
n-grams that occur in far more toxic than ordinary documents.  A window of a
text is compressed with the ordinary dictionary and with the ordinary and the
toxic dictionary together; what the second saves over the first is how much of
the window toxic text explains.  A whole text is cut into overlapping windows;
the savings' mean, the shares of windows that save a few bytes, the upper
decile and the maximum go through a logistic function that is calibrated on labelled rows the
dictionaries were not trained on, and weighted to the classes' frequency.

Learned from the whole texts of at most ``sample_rows`` labelled rows of each
class (smallest hash of the id first).  N-grams, passages and features are made
on the executors; the driver gets the sample's ids, labels and lengths, its
features, the marked n-grams and passages, and of the ordinary windows, if they
are twice ``ORDINARY_WINDOWS`` or more, every n-th of each text, so that about
one to two times as many are left.  Scoring reads whole texts.  Ids, languages,
sources and labels are not inputs of a score.

Defined results: NULL and empty texts are scored like a text without savings;
rows with a NULL label or id teach nothing; equal texts teach once, with the
smallest id's label; if a class has no labelled rows,
every score is 0; repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_remainder, cut, table, text_batches
from .quality import sigmoid

SAMPLE_ROWS = 3000
GRAM = 5                   # bytes of the n-grams that mark toxic passages
MIN_ODDS, ERRORS = 1.0, 1.645   # least log odds (toxic against ordinary documents), less so many standard errors
MIN_SHARE = 0.007          # share of the toxic documents that an n-gram must occur in
WINDOW, STEP = 64, 48      # bytes of a window, and from one window to the next
ORDINARY_BYTES, TOXIC_BYTES = 16_384, 4_096
ORDINARY_WINDOWS = 30_000
GRAM_BLOCK = 1_000_000     # n-grams that a task holds before it adds them up
THRESHOLD = 0.3


def prepared(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def windows(data: bytes) -> list[bytes]:
    return [data[i:i + WINDOW] for i in range(0, max(1, len(data) - (WINDOW - STEP)), STEP)]


def _grams(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    key = np.zeros(max(0, len(b) - GRAM + 1), dtype=np.uint64)
    for k in range(GRAM):
        key = key << np.uint64(8) | b[k:k + len(key)]
    return key


def _gram_counts(batches):
    """(gram, toxic, ordinary): in how many texts of each class an n-gram occurs, added up by blocks of texts."""
    def added(grams, labels):
        gram, at = np.unique(np.concatenate(grams), return_inverse=True)
        label = np.repeat(labels, [len(g) for g in grams])
        n = [np.bincount(at[label == k], minlength=len(gram)).astype(np.int64) for k in (1, 0)]
        return pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), *map(pa.array, n)],
                                          ["gram", "toxic", "ordinary"])

    grams, labels, size = [], [], 0
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            grams.append(np.unique(_grams(prepared(text))))
            labels.append(label)
            size += len(grams[-1])
            if size >= GRAM_BLOCK:
                yield added(grams, labels)
                grams, labels, size = [], [], 0
    if grams:
        yield added(grams, labels)


def marked_grams(sample: DataFrame, toxic: int, ordinary: int) -> np.ndarray:
    """N-grams whose share of the ``toxic`` toxic texts far exceeds that of the ordinary ones (sorted)."""
    n, m = F.col("toxic"), F.col("ordinary")
    odds = F.log((n + .5) / (toxic - n + .5)) - F.log((m + .5) / (ordinary - m + .5))
    found = (sample.select("label", "text").mapInArrow(_gram_counts, "gram long, toxic long, ordinary long")
             .groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
             .filter(n >= max(4, MIN_SHARE * toxic))
             .filter(odds - ERRORS * F.sqrt(1 / (n + .5) + 1 / (m + .5)) > MIN_ODDS).select("gram").collect())
    return np.sort(np.array([r["gram"] for r in found], dtype=np.uint64))


def marked_passages(docs: list[bytes], grams: np.ndarray) -> list[bytes]:
    """Runs of marked n-grams in the documents, with a byte before and three after."""
    out = []
    for data in docs:
        hits = np.flatnonzero(np.isin(_grams(data), grams))
        if len(hits):
            breaks = np.flatnonzero(np.diff(hits) > GRAM + 2)
            for a, b in zip(hits[np.r_[0, breaks + 1]], hits[np.r_[breaks, len(hits) - 1]]):
                out.append(data[max(0, a - 1):b + GRAM + 3])
    return out


def _trained(size: int, samples: list[bytes], **how) -> bytes | None:
    try:
        return zstd.train_dictionary(size, samples, **how).as_bytes()
    except zstd.ZstdError:      # zstandard refuses to train on very few samples
        return None


def _pieces(sample: DataFrame, pieces) -> list[bytes]:
    """What ``pieces(id, data)`` gives for every text, by id and place."""
    def run(batches):
        for batch in batches:
            row, at, found = [], [], []
            for k, (i, text) in enumerate(zip(batch.column("id").to_pylist(), batch.column("text").to_pylist())):
                own = pieces(i, prepared(text))
                row += [k] * len(own)
                at += range(len(own))
                found += own
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row, pa.int64())), pa.array(at, pa.int32()),
                 pa.array(found, pa.binary())], ["id", "at", "piece"])

    rows = sample.select("id", "text").mapInArrow(run, "id long, at int, piece binary").toPandas()
    return [bytes(p) for _, _, p in sorted(zip(rows["id"], rows["at"], rows["piece"]))]


def train_dictionaries(plain: list[bytes], passages: list[bytes]) -> tuple[bytes, bytes]:
    """The ordinary dictionary (of windows), and the ordinary followed by the toxic one (of passages).

    Samples too few to train on are used as they are, the most frequent last
    (nearest to the data).
    """
    base = _trained(ORDINARY_BYTES, plain, k=48, d=6)
    if base is None:
        base = b"".join(plain)[-ORDINARY_BYTES:]
    own = _trained(TOXIC_BYTES, passages, k=16, d=6)
    if own is None:
        kinds = sorted(set(passages), key=lambda p: (passages.count(p), p))
        own = b"".join(kinds)
    return base, base + own[-(TOXIC_BYTES - 256):]      # without the trained header: content only


class Meter:
    """Compresses windows with both dictionaries (greedy search for matches of six bytes or more)."""

    def __init__(self, ordinary: bytes, both: bytes):
        how = zstd.ZstdCompressionParameters(
            strategy=zstd.STRATEGY_GREEDY, min_match=6, hash_log=15, chain_log=15, search_log=4, window_log=17,
            write_content_size=False, write_checksum=False, write_dict_id=False)

        def tool(data):
            kind = zstd.ZstdCompressionDict(data) if data else None
            if kind:
                kind.precompute_compress(compression_params=how)
            return zstd.ZstdCompressor(dict_data=kind, compression_params=how).compress
        self.ordinary, self.both = tool(ordinary), tool(both)

    def features(self, text: str | None) -> tuple[float, ...]:
        """Mean saving, shares of windows that save 2 and 3 bytes, upper decile and maximum (none below 0)."""
        ordinary, both = self.ordinary, self.both
        saved = np.array([len(ordinary(w)) - len(both(w)) for w in windows(prepared(text))], dtype=np.float64)
        saved = np.sort(np.maximum(saved, 0))
        decile = saved[min(len(saved) - 1, int(0.9 * len(saved)))]
        return saved.mean(), (saved >= 2).mean(), (saved >= 3).mean(), decile, saved[-1]


@lru_cache(maxsize=2)
def meter(ordinary: bytes, both: bytes) -> Meter:
    """One meter per Python worker and pair of dictionaries."""
    return Meter(ordinary, both)


def fit_calibration(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 60):
    """Weighted logistic regression by Newton steps on scaled features; weights for (1, features)."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    z = np.hstack([np.ones((len(x), 1)), x / scale])
    w, weight = np.zeros(z.shape[1]), weight / weight.sum()
    keep = np.diag([0.0] + [ridge] * x.shape[1])
    for _ in range(steps):
        p = sigmoid(z @ w)
        h = (z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + keep + 1e-12 * np.eye(len(w))
        move = np.linalg.solve(h, z.T @ (weight * (p - y)) + keep @ w)
        w = w - np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return np.r_[w[0], w[1:] / scale]


def train(docs: DataFrame, labels: DataFrame, learn=None, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS):
    """Both dictionaries and the calibration, or None if a class has no rows.  ``learn``: condition on labelled rows."""
    text_batches(docs.sparkSession)
    known = labels if learn is None else labels.filter(learn)
    known = (known.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
             .filter("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label")))
    size = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}    # two rows
    if len(size) < 2:
        return None
    picked = [known.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(sample_rows) for k in (0, 1)]
    part = F.crc32(F.concat(F.lit("part"), F.col("id").cast("string")).cast("binary")) % 3
    sample = cut(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
                 .filter("text IS NOT NULL").join(F.broadcast(picked[0].union(picked[1])), "id")
                 .groupBy("text").agg(F.min(F.struct("id", "label")).alias("first"))
                 .select("first.id", "first.label", "text").withColumn("held", part == 0), "toxicity-sample")
    rows = sample.select("label", "held", F.octet_length("text").alias("bytes")).toPandas()
    if rows["label"].nunique() < 2:
        return None
    split = len(rows[["label", "held"]].drop_duplicates()) == 4
    teach, judge = (sample.filter("NOT held"), sample.filter("held")) if split else (sample, sample)
    taught = rows[~rows["held"]] if split else rows
    plain, toxic = taught[taught["label"] == 0], taught[taught["label"] == 1]
    grams = marked_grams(teach, len(toxic), len(plain))
    passages = _pieces(teach.filter("label = 1"), lambda _, data: marked_passages([data], grams))
    step = max(1, int(plain["bytes"].sum()) // STEP // ORDINARY_WINDOWS)
    spread = _pieces(teach.filter("label = 0"), lambda i, data: windows(data)[zlib.crc32(f"window{i}".encode()) % step::step])
    ordinary, both = train_dictionaries(spread, passages)

    def measured(batches):
        tool = meter(ordinary, both)
        for batch in batches:
            x = [tool.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"),
                                              pa.array(x, pa.list_(pa.float64()))], ["id", "label", "x"])

    found = judge.select("id", "label", "text").mapInArrow(measured, "id long, label int, x array<double>").collect()
    found.sort()
    x, target = np.array([r["x"] for r in found]), np.array([r["label"] for r in found], dtype=float)
    weight = np.where(target == 1, size[1] / max(target.sum(), 1), size[0] / max((1 - target).sum(), 1))
    return ordinary, both, fit_calibration(x, target, weight)


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``score``."""
    spark = docs.sparkSession
    text_batches(spark)
    held = spark.sparkContext.broadcast(model)      # two dictionaries of 16 and 20 KB

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if held.value is None or not texts:
                chance = np.zeros(len(texts))
            else:
                ordinary, both, w = held.value
                tool = meter(ordinary, both)
                chance = sigmoid(w[0] + np.array([tool.features(t) for t in texts]) @ w[1:])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(chance, pa.float64())], ["id", "score"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, score double")
            .withColumnRenamed("id", id_col))


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows with crc32(doc_id) mod 4 = 2 are held out from learning."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), crc_remainder("doc_id", 4) != 2)
    return score(docs, model).select(
        "doc_id", F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Language identification with a string kernel.

The kernel of two texts is the number of character n-grams (n = 1 to 3, lower
case, hashed) that occur in both, normalised to 1 for a text with itself: the
blended-spectrum presence kernel.  It is approximated by Nystroem landmarks,
and one ridge regression per language is fitted on the landmarks' features.
A batch of texts is scored by two matrix products: its presence matrix with
the landmarks' (numbers of shared n-grams), and these with the fitted weights,
which hold the landmarks' norms and are whole numbers of a small unit.  Both
products are exact, so a text's score does not depend on its batch.

Learned from the whole texts of at most ``sample_rows`` labelled rows of each
language (smallest hash of the id first), so a rare language is learned from
as many rows as a frequent one if it has them.  Their presence rows are made on
the executors; the driver gets 1 KB a row.  Every language has a landmark.
The score is the winning language's share of a softmax over the regressions.

Defined results: a NULL text and a text without any letter give ``und`` and
score 0; rows with a NULL language, text or id teach nothing,
repeated rows with one id teach once for each language; with nothing
learned every text gives ``und``; equal regressions are decided for the
language that sorts first; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, crc_remainder, drawn_ids, table, text_batches
from .quality import _M1, _mix

BITS = 13                   # log2 of the hashed n-grams
ORDERS = 3
LANDMARKS = 128            # more only for more languages
SAMPLE_ROWS = 1500         # of each language
FIT_ROWS = 4096            # presence rows unpacked at once
RIDGE, SHARPNESS = 1e-2, 8.0
CHUNK_CHARS = 400_000
_LETTER = re.compile(r"[^\W\d_]")       # letters, and some numbers that are no digits
UNIT_BITS = 30             # bits of a weight; counts have BITS, sums over the landmarks stay below 2^53
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    """Is there a character of a letter category (L*)?"""
    return bool(text) and any(m.group().isalpha() for m in _LETTER.finditer(text))


def presence(texts: list[str]) -> np.ndarray:
    """Rows of 0 and 1: which hashed n-grams occur in each text."""
    out = np.zeros((len(texts), 1 << BITS), dtype=np.float32)
    for lo, hi in chunks(texts, CHUNK_CHARS):
        lowered = [t.lower() for t in texts[lo:hi]]
        doc = np.repeat(np.arange(lo, hi), [len(t) for t in lowered])
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        key = np.zeros(len(points), dtype=np.uint64)
        for n in range(min(ORDERS, len(points))):
            m = len(points) - n
            key = _mix(key[:m] * _M1 + points[n:] + np.uint64(1))
            bucket = (key >> np.uint64(64 - BITS)).astype(np.int64)
            if n:
                whole = doc[:m] == doc[n:]
                out[doc[:m][whole], bucket[whole]] = 1
            else:
                out[doc, bucket] = 1
    return out


def kernel(x: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Normalised kernel values of presence rows with the landmarks' rows."""
    size = np.sqrt(np.maximum(x.sum(axis=1), 1))
    return (x @ marks.T) / size[:, None] / np.sqrt(np.maximum(marks.sum(axis=1), 1))[None, :]


def fit(bits: np.ndarray, langs: list[str]):
    """Landmark rows, whole weights (landmarks x languages), the sorted languages and the weights' unit.

    ``bits`` are packed presence rows.
    """
    names = sorted(set(langs))

    def rows(picked):
        return np.unpackbits(bits[picked], axis=1).astype(np.float32)

    turn = {name: [] for name in names}
    for k, lang in enumerate(langs):
        turn[lang].append(k)
    most = max(LANDMARKS, len(names))
    picked = [own[k] for k in range(most) for own in turn.values() if k < len(own)][:most]
    marks = rows(sorted(picked))
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])                  # landmarks' kernel to the power -1/2
    z = np.concatenate([kernel(rows(slice(k, k + FIT_ROWS)), marks).astype(np.float64) @ root
                        for k in range(0, len(bits), FIT_ROWS)])
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weight = 1.0 / np.array([len(turn[lang]) for lang in langs])     # languages count alike
    left = (z * weight[:, None]).T @ z + RIDGE * np.eye(z.shape[1])
    weights = (root @ np.linalg.solve(left, (z * weight[:, None]).T @ y)
               / np.sqrt(np.maximum(marks.sum(axis=1), 1))[:, None])
    # kernels are at most 1 and landmarks LANDMARKS or more: fewer bits for more of them, so that sums stay exact
    bits_left = min(UNIT_BITS, 52 - BITS - int(np.ceil(np.log2(len(marks)))))
    unit = float(np.abs(weights).max() or 1.0) / 2.0 ** bits_left
    return marks, np.rint(weights / unit), names, unit


def _sample_presence(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        known = [k for k, t in enumerate(texts) if has_letter(t)]
        for lo in range(0, len(known), 64):
            rows = known[lo:lo + 64]
            bits = np.packbits(presence([texts[k] for k in rows]).astype(bool), axis=1)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("lang").take(at),
                                              pa.array([r.tobytes() for r in bits], pa.binary())], ["id", "lang", "bits"])


def predict(texts: list[str | None], model) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    known = np.array([has_letter(t) for t in texts], dtype=bool)
    langs, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model is not None and known.any():
        marks, weights, names, unit = model
        x = presence([t for t, k in zip(texts, known) if k])
        shared = (x @ marks.T).astype(np.float64)                    # whole numbers below 2^24: exact
        margin = (shared @ weights) * (unit / np.sqrt(x.sum(axis=1)))[:, None]
        share = np.exp(SHARPNESS * (margin - margin.max(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        best = margin.argmax(axis=1)
        for row, b in zip(np.flatnonzero(known), best):
            langs[row] = names[b]
        score[known] = share[np.arange(len(best)), best]
    return langs, score


def train(docs: DataFrame, learn=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_rows: int = SAMPLE_ROWS):
    """The fitted model, or None if nothing can be learned.  ``learn``: condition on rows to learn from."""
    text_batches(docs.sparkSession)
    known = docs if learn is None else docs.filter(learn)
    sample = (known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
                           F.col(text_col).cast("string").alias("text"))
              .filter("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL"))
    kind = sample.schema["id"].dataType.simpleString()
    # by number of rows bounded: sample_rows a language
    rows = (sample.join(F.broadcast(drawn_ids(sample, "lang", sample_rows)), ["id", "lang"])
            .select("id", "lang", "text").mapInArrow(_sample_presence, f"id {kind}, lang string, bits binary").toPandas()
            .sort_values(["id", "lang", "bits"]).drop_duplicates(["id", "lang"]))
    if not len(rows):
        return None
    return fit(np.stack([np.frombuffer(b, dtype=np.uint8) for b in rows["bits"]]), rows["lang"].tolist())


def identify(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``lang_pred`` and ``score``."""
    spark = docs.sparkSession
    text_batches(spark)
    held = spark.sparkContext.broadcast(model)      # LANDMARKS presence rows: 4 MB

    def run(batches):
        for batch in batches:
            langs, score = predict(batch.column("text").to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(langs, pa.string()), pa.array(score, pa.float64())],
                ["id", "lang_pred", "score"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")
            .withColumnRenamed("id", id_col))


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows with crc32(doc_id) mod 3 = 1 are held out from learning."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, crc_remainder("doc_id", 3) != 1)
    return identify(docs, model).select(
        "doc_id", F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")

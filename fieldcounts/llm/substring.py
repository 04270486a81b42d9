"""Removing repeated passages by hashing normalised units.

A text is cut into units that together are the whole text: lines, and inside a
line sentences, where a sentence of fewer than ``SHORT_WORDS`` words goes with
the sentence before it.  A unit's digest is taken over its words in lower case
with single blanks.  Digests are grouped over all documents; the first
occurrence (smallest id, then position) of a digest is kept, all others are
repeats.  Repeats that follow each other in a text form a passage.  A passage
grows at both ends, into the units beside it, by the words that also stand
there in the document where its kept copy is, so a copy set into other
sentences is found whole.  Passages of at least ``min_words`` words are
removed; shorter ones (stock phrases) stay.  In scripts without blanks between
words two characters count as a word.

Results carry the shortened text and the removed ranges, in characters of the
original text.

Defined results: NULL and empty texts stay as they are, with no range removed;
NULL ids rank after all others (ids below 2^62), each text of them as a document
of its own; rows with one id and one text are the same document and are treated
alike (they do not remove each other); rows with one id and different texts are
searched as one document, and only what stands in a row is removed from it; all
columns are kept (``remove_repeats`` replaces a column ``removed``, the stage
keeps it).
"""

from __future__ import annotations

import re
from hashlib import blake2b

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table, text_batches, with_length

SHORT_WORDS = 5
MIN_WORDS = 10
_BREAK = re.compile(r"[.!?]+[^\S\n]+|[^\S\n]*\n\s*")
LAST = 1 << 62             # ranks of NULL ids start here
# scripts written without blanks: Thai, Lao, Burmese, Khmer, kana, Han
_UNSPACED = re.compile("[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF]")


def units(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-case words) of the units; they cover the text without gaps."""
    out: list[tuple[int, int, list[str]]] = []
    start, new_line = 0, True
    ends = [m.end() for m in _BREAK.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    for end in ends:
        piece = text[start:end]
        words = piece.lower().split()
        if out and not new_line and len(words) < SHORT_WORDS:
            first, _, before = out[-1]
            out[-1] = (first, end, before + words)
        elif words or not out:
            out.append((start, end, words))
        else:
            out[-1] = (out[-1][0], end, out[-1][2])
        new_line = "\n" in piece
        start = end
    return out


def digest(words: list[str]) -> bytes:
    return blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def unit_table(docs: DataFrame) -> DataFrame:
    """(digest, rank, pos) of every unit with a word of ``docs(rank, text)``."""
    def run(batches):
        for batch in batches:
            keys, pos, row = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                for at, (_, _, words) in enumerate(units(text or "")):
                    if words:
                        keys.append(digest(words))
                        pos.append(at)
                        row.append(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), batch.column("rank").take(pa.array(row, pa.int64())),
                 pa.array(pos, pa.int32())], ["digest", "rank", "pos"])

    return docs.mapInArrow(run, "digest binary, rank long, pos int")


def repeated_units(docs: DataFrame) -> DataFrame:
    """(rank, pos, check, kept_rank, kept_pos) of every unit whose digest occurs earlier."""
    every = unit_table(docs)
    kept = (every.groupBy("digest").agg(F.min(F.struct("rank", "pos")).alias("first"), F.count("*").alias("n"))
            .filter("n > 1").select("digest", F.col("first.rank").alias("kept_rank"),
                                    F.col("first.pos").alias("kept_pos")))
    # written, so that both sides of the join are plain exchanges and a hot digest can be split
    kept = cut(kept, "units-kept")
    return (every.join(kept, "digest").filter("rank != kept_rank OR pos != kept_pos")
            .select("rank", "pos", F.expr("substring(digest, 1, 8)").alias("check"), "kept_rank", "kept_pos"))


def _runs(hits: list[dict]) -> list[tuple[int, int]]:
    """Ranges (first, last index) of hits that follow each other in the text."""
    edges = [k for k in range(1, len(hits)) if hits[k]["pos"] != hits[k - 1]["pos"] + 1]
    return list(zip([0, *edges], [e - 1 for e in [*edges, len(hits)]])) if hits else []


def _true_hits(parts, hits: list[dict]) -> list[dict]:
    """The hits that belong to this text (rows with one id may have other texts)."""
    return [h for h in sorted(hits, key=lambda h: h["pos"])
            if h["pos"] < len(parts) and digest(parts[h["pos"]][2])[:8] == bytes(h["check"])]


def _around(parts, first: int, last: int) -> tuple[list[str], list[str]]:
    """The words of the units before ``first`` and after ``last``."""
    return parts[first - 1][2] if first else [], parts[last + 1][2] if last + 1 < len(parts) else []


def _weight(words: list[str]) -> int:
    """Number of words; two characters of a script without blanks count as one."""
    return sum(max(1, len(_UNSPACED.findall(w)) // 2) if not w.isascii() else 1 for w in words)


def _shared(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


_WORD = re.compile(r"\S+")


def removed_ranges(text: str, hits: list[dict], context: dict, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Ranges to remove, merged and ascending.

    ``context`` has, for a kept unit's (rank, pos), the words before and after it.
    """
    parts = units(text)
    hits = _true_hits(parts, hits)
    out: list[list[int]] = []
    for a, b in _runs(hits):
        first, last = hits[a]["pos"], hits[b]["pos"]
        start, end = parts[first][0], parts[last][1]
        size = sum(_weight(parts[k][2]) for k in range(first, last + 1))
        before, after = _around(parts, first, last)
        there_before = context.get((hits[a]["kept_rank"], hits[a]["kept_pos"]), ((), ()))[0]
        there_after = context.get((hits[b]["kept_rank"], hits[b]["kept_pos"]), ((), ()))[1]
        left, right = _shared(before[::-1], there_before[::-1]), _shared(after, there_after)
        if size + _weight(before[len(before) - left:]) + _weight(after[:right]) < min_words:
            continue
        if left:
            spots = [m.start() for m in _WORD.finditer(text, parts[first - 1][0], start)]
            start = spots[-left]
        if right:
            spots = []
            for m in _WORD.finditer(text, end):
                spots.append(m.end())
                if len(spots) == right:
                    break
            end = spots[-1]
            while end < len(text) and text[end].isspace():
                end += 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def kept_contexts(rows: DataFrame, ends: DataFrame, text_col: str) -> DataFrame:
    """Words around the kept units that ``ends(kept_rank, kept_pos)`` asks for."""
    asked = (ends.select("kept_rank", "kept_pos").distinct().groupBy(F.col("kept_rank").alias("_rank"))
             .agg(F.collect_list("kept_pos").alias("wanted")))

    def run(batches):
        for batch in batches:
            rank, pos, before, after = [], [], [], []
            texts = pa.compute.struct_field(batch.column("_row"), text_col).to_pylist()
            for r, text, wanted in zip(batch.column("_rank").to_pylist(), texts, batch.column("wanted").to_pylist()):
                parts = units(text or "")
                for p in wanted:
                    if p < len(parts):
                        b, a = _around(parts, p, p)
                        rank.append(r)
                        pos.append(p)
                        before.append(b)
                        after.append(a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rank, pa.int64()), pa.array(pos, pa.int32()), pa.array(before, pa.list_(pa.string())),
                 pa.array(after, pa.list_(pa.string()))], ["kept_rank", "kept_pos", "before", "after"])

    return (rows.join(asked, "_rank").select("_rank", "_row", "wanted")
            .mapInArrow(run, "kept_rank long, kept_pos int, before array<string>, after array<string>")
            .groupBy("kept_rank", "kept_pos").agg(F.first("before").alias("before"), F.first("after").alias("after")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut out of the text and ``removed`` (array of start, end) appended."""
    text_batches(docs.sparkSession)
    docs = docs.drop("removed").withColumn(text_col, F.col(text_col).cast("string"))
    rank = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST) + F.pmod(F.xxhash64(text_col), F.lit(LAST)))
    repeats = cut(repeated_units(docs.select(rank.alias("rank"), F.col(text_col).alias("text"))), "units-repeats")

    # first and last units of passages: the next unit on one side is no repeat
    near = repeats.select("rank", F.explode(F.array(F.col("pos") - 1, F.col("pos") + 1)).alias("pos"), "kept_rank",
                          "kept_pos")
    ends = (near.join(repeats.select("rank", "pos"), ["rank", "pos"], "left_anti").filter("pos >= 0")
            .select("rank", "kept_rank", "kept_pos").distinct())
    # whole rows dealt by rank once; both uses read the same exchange
    rows = docs.select(rank.alias("_rank"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = rows.repartition("_rank")
    contexts = (ends.join(kept_contexts(rows, ends, text_col), ["kept_rank", "kept_pos"])
                .groupBy(F.col("rank").alias("_rank"))
                .agg(F.collect_list(F.struct("kept_rank", "kept_pos", "before", "after")).alias("_contexts")))
    hits = (repeats.groupBy(F.col("rank").alias("_rank"))
            .agg(F.collect_list(F.struct("pos", "check", "kept_rank", "kept_pos")).alias("_hits")))
    names, at = docs.columns, docs.columns.index(text_col)
    ranges_type = T._parse_datatype_string("array<struct<start:int,end:int>>")
    out = T.StructType(docs.schema.fields + [T.StructField("removed", ranges_type)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            columns = batch.column("_row").flatten()
            texts, removed = [], []
            for text, found, ctx in zip(columns[at].to_pylist(), batch.column("_hits").to_pylist(),
                                        batch.column("_contexts").to_pylist()):
                ranges = []
                if text and found:
                    context = {(c["kept_rank"], c["kept_pos"]): (c["before"], c["after"]) for c in ctx or ()}
                    ranges = removed_ranges(text, found, context, min_words)
                    if ranges:
                        keep = [0, *(x for r in ranges for x in r), len(text)]
                        text = "".join(text[keep[k]:keep[k + 1]] for k in range(0, len(keep), 2))
                texts.append(text)
                removed.append([{"start": a, "end": b} for a, b in ranges])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns + [pa.array(removed, kind)], names + ["removed"])

    return (rows.join(hits, "_rank", "left").join(contexts, "_rank", "left")
            .select("_row", "_hits", "_contexts").mapInArrow(run, out))


def substring_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without passages that an earlier document has, and the removed ranges."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without repeated passages; those left without a word go."""
    aside = {c: "__input_removed" for c in docs.columns if c.lower() == "removed"}
    left = remove_repeats(docs.withColumnsRenamed(aside)).filter(F.col("text").isNull() | F.col("text").rlike(r"\S"))
    return with_length(left).select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])

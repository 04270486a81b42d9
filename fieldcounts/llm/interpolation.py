"""Language-model scores by deleted interpolation of bigram and unigram estimates.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z in lower case,
then one end token.  The probability of a token w after v is

    p(w|v) = a[b] c(vw)/c(v) + (1 - a[b]) (u c(w)/N + (1 - u)/(V + 1)),

maximum-likelihood estimates of both orders and a uniform floor for unknown
words.  The mixture weights ``a`` depend on the bucket b of the context's
frequency (the bits of c(v); a context never seen has weight 0).  All weights
are learned by expectation-maximisation on deleted text: one learned document
in ``DELETED`` (by a hash of its id) is left out of the counts, and its tokens
are predicted from the others.  Scores then use the counts of all learned
documents, the deleted ones included.

How the counts meet the texts:

* Every task packs its documents into blocks of about ``BLOCK_TOKENS`` tokens
  (words numbered within the block; a longer document continues in the next
  block).  Blocks are written once.
* A block sends each different n-gram once, with its counts, to the shard of
  the n-gram's hash.  Shards hold about ``SHARD_TOKENS`` n-grams whatever the
  input, and a frequent n-gram adds one entry for each block, not for each
  occurrence.
* A shard adds up and returns to each block the corpus counts in the order of
  the block's n-grams.  A block's group is one block and its counts.

Nothing is sampled or cut: all texts are counted and scored whole.  Words and
bigrams are known by 62 bits of a hash; among a billion different n-grams, two
are expected to share one with a chance of about one in nine.

Defined results: NULL and empty texts are one end token; rows with a NULL id
are not held out; repeated rows are counted and scored each; with nothing to
learn from, all known counts are 0 and every token has probability 1 / (V + 1)
= 1; with no deleted text the weights are one half; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_remainder, cut, table, text_batches

BLOCK_TOKENS = 1_500_000
SHARD_TOKENS = 1_000_000
DELETED = 16               # one learned document in so many teaches the weights
CHUNK_BYTES = 4_000_000    # bytes of one text that are split into words at once
STEPS, CLOSE = 30, 1e-4    # expectation-maximisation: most rounds, and the change of a weight that ends them
BUCKETS = 65
HELD_OUT, LEARNED, LEFT_OUT = 0, 1, 2
END, START = 0, -1         # token numbers in every block; a piece that goes on has the token before it instead of START
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_END_HASH, _START_HASH = xxhash.xxh3_64_intdigest(b" end"), xxhash.xxh3_64_intdigest(b" start")   # no word has a blank

BLOCK = ("block long, left_out boolean, n_tokens long, n_learned long, ids array<long>, docs binary, pieces binary, "
         "folds binary, sizes binary, leads binary, words binary, tokens binary")
GRAMS = "shard int, block long, grams binary, learned binary, left_out binary"
COUNTS = "block long, shard int, every binary, kept binary, n_words long, n_kept_words long"


def _pack(x: np.ndarray) -> bytes:
    """The bytes of an array, lowest bytes of all numbers first, compressed."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize) if len(x) else np.zeros((0, 1), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).ravel()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


# ---------------------------------------------------------------- texts to blocks

def word_lists(text: str | None):
    """Lists of a text's words as bytes, A-Z in lower case; a very long text gives several lists."""
    data = (text or "").encode("utf-8", "surrogatepass")
    at = 0
    while at < len(data):
        end = min(at + CHUNK_BYTES, len(data))
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end].lower().split()
        at = end


class _Block:
    """Documents of one kind that a task is packing."""

    def __init__(self, left_out: bool):
        self.left_out, self.made = left_out, 0
        self.clear()

    def clear(self):
        self.words = {b" ": END}
        self.tokens, self.rows, self.size, self.learned = [], [], 0, 0

    def numbers(self, words: list) -> np.ndarray:
        known = self.words
        return np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)

    def add(self, doc: int, doc_id, piece: int, fold: int, lead: bytes | None, words: list, last: bool):
        """One piece of a document: the word before it (None: the start), its words, and the end after the last one."""
        lead = START if lead is None else int(self.numbers([lead])[0])
        tokens = self.numbers(words)
        if last:
            tokens = np.append(tokens, END)
        self.rows.append((doc_id, doc, piece, fold, len(tokens), lead))
        self.tokens.append(tokens.astype(np.uint32))
        self.size += len(tokens)
        self.learned += len(tokens) if fold != HELD_OUT else 0

    def record(self, task: int) -> pa.RecordBatch:
        ids, docs, pieces, folds, sizes, leads = zip(*self.rows)
        hashes = np.array([_END_HASH, *map(xxhash.xxh3_64_intdigest, list(self.words)[1:])], dtype=np.uint64)
        row = [(task << 32) | (self.made << 1) | self.left_out, self.left_out, self.size, self.learned, list(ids),
               _pack(np.array(docs, np.int64)), _pack(np.array(pieces, np.int32)), _pack(np.array(folds, np.int8)),
               _pack(np.array(sizes, np.int64)), _pack(np.array(leads, np.int64)), hashes.tobytes(),
               _pack(np.concatenate(self.tokens))]
        self.made += 1
        self.clear()
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())] + [pa.binary()] * 7
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)],
                                          [f.split()[0] for f in BLOCK.split(", ")])


def text_blocks(texts: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of ``texts(id long, text string, fold int)``; numbers of blocks and documents hold once it is written."""
    def run(batches):
        task = TaskContext.get().partitionId()
        doc = task << 33
        open_blocks = {False: _Block(False), True: _Block(True)}
        for batch in batches:
            for doc_id, text, fold in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "fold"))):
                block = open_blocks[fold == LEFT_OUT]
                lists, piece, lead = word_lists(text), 0, None
                words = next(lists, [])
                while True:
                    more = next(lists, None)
                    room = max(block_tokens - block.size, 1)
                    for lo in [0, *range(room, len(words), block_tokens)]:      # to the block's end, then whole blocks
                        part = words[lo:room if lo == 0 else lo + block_tokens]
                        last = more is None and lo + len(part) == len(words)
                        block.add(doc, doc_id, piece, fold, lead, part, last)
                        piece, lead = piece + 1, part[-1] if part else lead
                        if block.size >= block_tokens:
                            yield block.record(task)
                    if more is None:
                        break
                    words = more
                doc += 1
        for block in open_blocks.values():
            if block.rows:
                yield block.record(task)

    return texts.select("id", "text", "fold").mapInArrow(run, BLOCK)


class Grams:
    """The n-grams of a block: words (by number), then different bigrams, and where each token's bigram is."""

    def __init__(self, row: dict, n_shards: int):
        self.tokens = _unpack(row["tokens"], np.uint32).astype(np.int64)
        self.sizes, self.folds = _unpack(row["sizes"], np.int64), _unpack(row["folds"], np.int8)
        hashes = np.append(np.frombuffer(row["words"], np.uint64), np.uint64(_START_HASH))
        self.n_words = len(hashes) - 1
        leads = _unpack(row["leads"], np.int64)
        starts = np.cumsum(self.sizes) - self.sizes
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        some = self.sizes > 0
        self.before[starts[some]] = np.where(leads[some] == START, self.n_words, leads[some])
        pairs, self.pair = np.unique(self.before * (self.n_words + 1) + self.tokens, return_inverse=True)
        first, second = pairs // (self.n_words + 1), pairs % (self.n_words + 1)
        words = (np.uint64(1) << np.uint64(62)) | (_mix(hashes[:-1] * _M1) >> np.uint64(2))
        bigrams = (np.uint64(2) << np.uint64(62)) | (_mix(_mix(hashes[first] * _M1) * _M1 + hashes[second]) >> np.uint64(2))
        self.keys = np.concatenate([words, bigrams])
        self.shards = (self.keys % np.uint64(n_shards)).astype(np.int32)
        self.order = np.lexsort((self.keys, self.shards))

    def counted(self, fold: int) -> np.ndarray:
        """Occurrences of each n-gram in the documents of a fold."""
        here = np.repeat(self.folds == fold, self.sizes)
        return np.concatenate([np.bincount(self.tokens[here], minlength=self.n_words),
                               np.bincount(self.pair[here], minlength=len(self.keys) - self.n_words)])

    def looked_up(self, shards: list, packed: list) -> np.ndarray:
        """The counts that the shards sent, for the n-grams in their own order."""
        parts = [_unpack(packed[k], np.int64) for k in np.argsort(np.array(shards))]
        out = np.zeros(len(self.keys), dtype=np.int64)
        out[self.order] = np.concatenate(parts)
        return out


# ---------------------------------------------------------------- counts of the corpus

def block_grams(blocks: DataFrame, n_shards: int) -> DataFrame:
    """Each block's different n-grams and their counts there, a row for each shard."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                g = Grams(row, n_shards)
                keys, shards = g.keys[g.order], g.shards[g.order]
                learned, left = g.counted(LEARNED)[g.order], g.counted(LEFT_OUT)[g.order]
                edges = np.flatnonzero(np.diff(shards, prepend=-1, append=n_shards))
                out: list = [[], [], [], [], []]
                for lo, hi in zip(edges[:-1], edges[1:]):
                    if hi > lo:
                        for part, v in zip(out, (int(shards[lo]), row["block"], _pack(np.diff(
                                keys[lo:hi], prepend=np.uint64(0))), _pack(learned[lo:hi]), _pack(left[lo:hi]))):
                            part.append(v)
                kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)],
                                                 ["shard", "block", "grams", "learned", "left_out"])

    return blocks.select("block", "folds", "sizes", "leads", "words", "tokens").mapInArrow(run, GRAMS)


def corpus_counts(grams: DataFrame) -> DataFrame:
    """For each block and shard the corpus counts of the block's n-grams: of all learned documents, and without the
    deleted ones; and, in one row of each shard, its numbers of different words."""
    def add_up(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["block"])
        keys = [np.cumsum(_unpack(r["grams"], np.uint64), dtype=np.uint64) for r in rows]
        kept = np.concatenate([_unpack(r["learned"], np.int64) for r in rows])
        left = np.concatenate([_unpack(r["left_out"], np.int64) for r in rows])
        different, place = np.unique(np.concatenate(keys), return_inverse=True)
        every, without = np.zeros(len(different), np.int64), np.zeros(len(different), np.int64)
        np.add.at(without, place, kept)
        np.add.at(every, place, kept + left)
        word = (different >> np.uint64(62)) == 1
        n_words = [int((word & (every > 0)).sum())] + [0] * (len(rows) - 1)
        n_kept = [int((word & (without > 0)).sum())] + [0] * (len(rows) - 1)
        ends = np.cumsum([len(k) for k in keys])[:-1]
        return pa.table({
            "block": pa.array([r["block"] for r in rows], pa.int64()),
            "shard": pa.array([r["shard"] for r in rows], pa.int32()),
            "every": pa.array([_pack(p) for p in np.split(every[place], ends)], pa.binary()),
            "kept": pa.array([_pack(p) for p in np.split(without[place], ends)], pa.binary()),
            "n_words": pa.array(n_words, pa.int64()), "n_kept_words": pa.array(n_kept, pa.int64())})

    return grams.groupBy("shard").applyInArrow(add_up, COUNTS)


# ---------------------------------------------------------------- mixture weights

def bucket_of(count: np.ndarray) -> np.ndarray:
    """The number of bits of a context's frequency (0 for none)."""
    return np.frexp(count.astype(np.float64))[1].astype(np.int64)


def learned_weights(blocks: DataFrame, counts: DataFrame, n_kept: int, n_words: int):
    """(weights of the bigram estimate by bucket, weight of the unigram estimate)."""
    shape = "context binary, pair binary, single binary"

    def predict(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"context": [], "pair": [], "single": []}
        for row in left.to_pylist():
            g = Grams(row, row["n_shards"])
            c = g.looked_up(right.column("shard").to_pylist(), right.column("kept").to_pylist())
            context = np.append(c[:g.n_words], c[END])[g.before]        # a start is as frequent as an end
            pair, single = c[g.n_words:][g.pair], c[g.tokens]
            out["context"].append(_pack(bucket_of(context).astype(np.int8)))
            out["pair"].append(_pack((pair / np.maximum(context, 1)).astype(np.float32)))
            out["single"].append(_pack((single / max(n_kept, 1)).astype(np.float32)))
        return pa.table({k: pa.array(v, pa.binary()) for k, v in out.items()})

    seen = cut(blocks.filter("left_out").groupBy("block").cogroup(
        counts.filter(F.col("block").bitwiseAND(1) == 1).groupBy("block"))          # the numbers of left-out blocks are odd
        .applyInArrow(predict, shape), "lm-deleted")
    floor = 1.0 / (n_words + 1)
    weights, single_weight = np.full(BUCKETS, 0.5), 0.5
    weights[0] = 0.0
    if n_kept == 0:
        return weights, 0.0

    def expect(a: np.ndarray, u: float):
        def run(batches):
            total = np.zeros((BUCKETS, 4))
            for batch in batches:
                for row in batch.to_pylist():
                    b = _unpack(row["context"], np.int8)
                    pair = _unpack(row["pair"], np.float32).astype(np.float64)
                    single = _unpack(row["single"], np.float32).astype(np.float64)
                    two, one, rest = a[b] * pair, (1 - a[b]) * u * single, (1 - a[b]) * (1 - u) * floor
                    whole = two + one + rest
                    for k, part in enumerate((two / whole, one / whole, rest / whole, np.ones(len(b)))):
                        total[:, k] += np.bincount(b, part, BUCKETS)
            used = np.flatnonzero(total[:, 3])
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32())] + [pa.array(total[used, k]) for k in range(4)],
                ["bucket", "two", "one", "rest", "n"])
        return run

    found = np.zeros(BUCKETS, dtype=bool)
    for _ in range(STEPS):
        sums = (seen.mapInArrow(expect(weights.copy(), single_weight),
                                "bucket int, two double, one double, rest double, n double")
                .groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("two", "one", "rest", "n")]).collect())  # <= 65 rows
        if not sums:
            break
        new = weights.copy()
        for r in sums:
            found[r["bucket"]] = True
            new[r["bucket"]] = r["two"] / (r["n"] + 1)          # below 1, so that nothing gets probability 0
        one, rest = sum(r["one"] for r in sums), sum(r["rest"] for r in sums)
        new_single = one / (one + rest + 1)
        change = max(float(np.abs(new - weights).max()), abs(new_single - single_weight))
        weights, single_weight = new, new_single
        if change < CLOSE:
            break
    weights[0] = 0.0
    known = [k for k in range(1, BUCKETS) if found[k]]
    for k in range(1, BUCKETS):
        if known and not found[k]:                              # a bucket without deleted text: the nearest one's weight
            weights[k] = weights[min(known, key=lambda j: (abs(j - k), j))]
    return weights, single_weight


# ---------------------------------------------------------------- scores

SCORES = ("doc long, id long, piece int, fold int, n_tokens long, n_known long, base_score double, score double")


def block_scores(blocks: DataFrame, counts: DataFrame, n_learned: int, n_words: int, weights: np.ndarray,
                 single_weight: float) -> DataFrame:
    """A row for each piece of a document."""
    spread, floor = math.log10(n_learned + n_words + 1), 1.0 / (n_words + 1)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for row in left.to_pylist():
            g = Grams(row, row["n_shards"])
            c = g.looked_up(right.column("shard").to_pylist(), right.column("every").to_pylist())
            context = np.append(c[:g.n_words], c[END])[g.before]
            single = c[g.tokens]
            a = weights[bucket_of(context)]
            p = (a * c[g.n_words:][g.pair] / np.maximum(context, 1)
                 + (1 - a) * (single_weight * single / max(n_learned, 1) + (1 - single_weight) * floor))
            n = len(g.sizes)
            doc = np.repeat(np.arange(n), g.sizes)
            parts.append(pa.table({
                "doc": pa.array(_unpack(row["docs"], np.int64)), "id": pa.array(row["ids"], pa.int64()),
                "piece": pa.array(_unpack(row["pieces"], np.int32)), "fold": pa.array(g.folds.astype(np.int32)),
                "n_tokens": pa.array(g.sizes),
                "n_known": pa.array(np.bincount(doc, single > 0, n).astype(np.int64)),
                "base_score": pa.array(np.bincount(doc, np.log10(single + 1.0) - spread, n)),
                "score": pa.array(np.bincount(doc, np.log10(p), n))}))
        names = [f.split() for f in SCORES.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
        return pa.concat_tables(parts) if parts else pa.table({k: pa.array([], kinds[t]) for k, t in names})

    return blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(run, SCORES)


def model_scores(docs: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text",
                 block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    ``held_out`` is a boolean Column; its rows are scored but not learned from (default: none).
    """
    text_batches(docs.sparkSession)
    held = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    left_out = F.coalesce(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(DELETED)) == 0, F.lit(False))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                        F.when(held, HELD_OUT).when(left_out, LEFT_OUT).otherwise(LEARNED).alias("fold"))
    blocks = cut(text_blocks(texts, block_tokens), "lm-blocks")
    size = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("every"),
                      F.coalesce(F.sum("n_learned"), F.lit(0)).alias("learned"),
                      F.coalesce(F.sum(F.when(F.col("left_out"), F.col("n_learned"))), F.lit(0)).alias("deleted")).first()
    n_shards = max(1, -(-size["every"] // shard_tokens))
    counts = cut(corpus_counts(block_grams(blocks, n_shards)), "lm-counts")
    words = counts.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("every"),
                       F.coalesce(F.sum("n_kept_words"), F.lit(0)).alias("kept")).first()
    counts = counts.select("block", "shard", "every", "kept")
    blocks = blocks.withColumn("n_shards", F.lit(n_shards))
    weights, single_weight = learned_weights(
        blocks.select("block", "left_out", "n_shards", "folds", "sizes", "leads", "words", "tokens"),
        counts.select("block", "shard", "kept"), size["learned"] - size["deleted"], words["kept"])
    scored = block_scores(blocks.drop("left_out", "n_tokens", "n_learned"), counts.select("block", "shard", "every"),
                          size["learned"], words["every"], weights, single_weight)

    def in_order(c):           # the pieces of a very long document, added in their order
        return F.aggregate(F.array_sort(F.collect_list(F.struct("piece", c))), F.lit(0.0), lambda t, x: t + x[c])
    whole = scored.groupBy("doc").agg(
        F.first("id").alias("id"), F.first("fold").alias("fold"), F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), in_order("base_score").alias("base_score"), in_order("score").alias("score"))
    return whole.select("id", (F.col("fold") == HELD_OUT).alias("held_out"), "n_tokens", "n_known",
                        F.lit(size["learned"]).cast("long").alias("train_tokens"), "base_score", "score")


def interpolation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, learned from those whose crc32 remainder by 7 is not 2."""
    docs = table(spark, sf_dir, "documents")
    return model_scores(docs, crc_remainder("doc_id", 7) == 2).withColumnRenamed("id", "doc_id")

"""Near-duplicate documents by improved consistent weighted sampling.

A text is a weighted set of shingles of five words (lower case; a shorter text
is one shingle).  A shingle weighs its count times 1 + log(1 + N / df) /
log(1 + N), N being the number of documents and df the documents that hold it,
rounded to a grid of factors exp(1/16).  Document frequencies are counted over
all documents in a hashed table of ``CELLS`` cells, whose size does not depend
on the corpus: a cell holds the sum of its shingles' frequencies, which lifts
rare shingles to a common background and leaves frequent ones apart.

Improved consistent weighted sampling draws, for each of ``BANDS * ROWS``
hashes, one shingle and one position within its weight, so that two texts
agree with the probability of their weighted Jaccard similarity.  Its gamma
and uniform variates come from a table of ``DRAWS`` draws that a hash of the
shingle points into.  Texts that agree on all rows of a band share a bucket;
with 14 bands of 4 rows a pair of similarity 0.8 does with probability 0.9994.

Buckets are not paired out.  Equal texts first become one class.  Then every
member of a bucket is compared with the bucket's hub only, the member that
shares the most buckets with others (in a group of copies, most likely what
they were copied from), exactly, by weighted Jaccard similarity of the whole
texts; verified links give components.  Only where the members of a hub's
buckets still are several components are those outside the largest compared
with the others, in blocks of texts whose pairs never leave their task.  So
each candidate pair is either verified or already in one component.

Defined results: a NULL text and a text without words resemble nothing; a NULL
id is never a duplicate (component NULL, kept); rows with one id are one
document; equal texts (up to case and white space) are duplicates; extra
columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, components, cut, table, text_batches
from .quality import _M1, _mix

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 4
CELLS, BLOCKS, LANES = 1 << 20, 16, 8
DRAWS_BITS = 15
BLOCK = 64
GRID = 16.0
CHUNK_CHARS = 1_000_000
SEED = 20240229
_BLANKS = bytes(32 if b < 32 else b for b in range(256))     # controls part words like blanks


# ---------------------------------------------------------------- shingles

@lru_cache(maxsize=1)
def _powers():
    """Random numbers for bytes, and powers of an odd number and of its inverse modulo 2**64."""
    rng = np.random.default_rng(SEED)
    letters = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = 0xD1342543DE82EF95
    inverse = pow(base, -1, 1 << 64)

    def powers(x, n=1 << 16):
        steps = np.ones(n, dtype=np.uint64)
        steps[1:] = np.uint64(x)
        return np.multiply.accumulate(steps)
    return letters, powers(base), powers(inverse)


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first positions of the words (runs of bytes above blank) of a byte array."""
    letters, up, down = _powers()
    solid = np.concatenate([[False], data > 32, [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    # the powers repeat every 65536 bytes; a word that spans the seam is summed in two parts
    n = len(up)
    at = np.arange(len(data)) % n
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters[data] * up[at], dtype=np.uint64)])
    first = (sums[ends] - sums[starts]) * down[starts % n]
    seam = np.flatnonzero(starts // n != (ends - 1) // n)
    for k in seam:
        h, power = np.uint64(0), np.uint64(1)
        piece = data[starts[k]:ends[k]]
        with np.errstate(over="ignore"):
            for lo in range(0, len(piece), n):
                part = letters[piece[lo:lo + n]] * up[:len(piece[lo:lo + n])]
                h = h + power * part.sum(dtype=np.uint64)
                power = power * up[n - 1] * up[1]
        first[k] = h
    return _mix(first ^ (ends - starts).astype(np.uint64) * _M1), starts


def shingles(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of each text's shingles, with repeats, in order."""
    out: list[np.ndarray] = []
    texts = [t or "" for t in texts]
    for lo, hi in chunks(texts, CHUNK_CHARS):
        raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts[lo:hi]]
        size = np.array([len(r) + 1 for r in raw])
        words, starts = _word_hashes(np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8))
        bound = np.searchsorted(starts, np.concatenate([[0], np.cumsum(size)]))
        m = max(0, len(words) - WIDTH + 1)
        wide = np.zeros(m, dtype=np.uint64)
        for k in range(WIDTH):
            wide = _mix(wide * _M1 + words[k:k + m])
        for a, b in zip(bound[:-1], bound[1:]):
            if b - a >= WIDTH:
                out.append(wide[a:b - WIDTH + 1])
            else:
                one = np.full(min(1, b - a), b - a, dtype=np.uint64)
                for w in words[a:b]:
                    one = _mix(one * _M1 + w)
                out.append(one)
    return out


def plain_words(text: str) -> bytes:
    """The text's words in lower case, one blank between them."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_BLANKS).split())


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)        # 20 bits: CELLS cells


# ---------------------------------------------------------------- document frequencies

def _merge_blocks(batches):
    """Adds up the counts of equal blocks as they stream by."""
    total: dict[int, np.ndarray] = {}
    lane: dict[int, int] = {}
    for batch in batches:
        for block, row_lane, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "lane", "counts"))):
            numbers = np.frombuffer(counts, dtype={1: np.uint8, 2: np.uint16, 8: np.int64}[
                len(counts) // (CELLS // BLOCKS)] if block >= 0 else np.int64)
            if block in total:
                total[block] += numbers
            else:
                total[block], lane[block] = numbers.astype(np.int64), row_lane
    yield _block_rows([(b, lane[b], total[b]) for b in sorted(total)])


def _block_rows(rows):
    def packed(block, counts):
        if block < 0:
            return counts.astype(np.int64).tobytes()
        top = int(counts.max(initial=0))
        return counts.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.int64).tobytes()
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
         pa.array([packed(r[0], r[2]) for r in rows], pa.binary())], ["block", "lane", "counts"])


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and for each cell the texts that hold a shingle of it, over all rows of ``texts(text)``.

    Each task counts into one table of CELLS cells; blocks of it are added up
    in two steps as they stream through, and the driver gets CELLS numbers.
    """
    def count(batches):
        cells, n = np.zeros(CELLS, dtype=np.int64), 0
        for batch in batches:
            for hashes in shingles(batch.column("text").to_pylist()):
                n += 1
                np.add.at(cells, _cells(np.unique(hashes)), 1)
        lane = TaskContext.get().partitionId() % LANES
        rows = [(b, lane, part) for b, part in enumerate(np.split(cells, BLOCKS)) if part.any()]
        yield _block_rows([(-1, lane, np.array([n]))] + rows)

    shape = "block int, lane int, counts binary"
    merged = texts.select("text").mapInArrow(count, shape).repartition("block", "lane").mapInArrow(
        _merge_blocks, shape).repartition("block").mapInArrow(_merge_blocks, shape)
    out, n = np.zeros((BLOCKS, CELLS // BLOCKS), dtype=np.int64), 0
    for row in merged.collect():                    # BLOCKS + 1 rows
        if row["block"] < 0:
            n += int(np.frombuffer(row["counts"], dtype=np.int64).sum())
        else:
            size = len(row["counts"]) // (CELLS // BLOCKS)
            out[row["block"]] += np.frombuffer(row["counts"], dtype={1: np.uint8, 2: np.uint16, 8: np.int64}[size])
    return n, out.ravel()


def rarity(n: int, frequency: np.ndarray) -> np.ndarray:
    """Logarithm of a shingle's weight per occurrence, for each cell (float32)."""
    n = max(n, 1)
    return np.log(1 + np.log1p(n / np.maximum(frequency, 1)) / np.log1p(n)).astype(np.float32)


def weighted_set(hashes: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles (ascending) and the grid steps of their weights."""
    kinds, count = np.unique(hashes, return_counts=True)
    return kinds, np.rint(GRID * (np.log(count) + rare[_cells(kinds)])).astype(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets."""
    wa, wb = np.exp(a[1] / GRID), np.exp(b[1] / GRID)
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(wa[ia], wb[ib]).sum()
    total = wa.sum() + wb.sum() - both
    return float(both / total) if total else 0.0


# ---------------------------------------------------------------- consistent weighted sampling

class Sampler:
    """Band keys of weighted sets."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        n = 1 << DRAWS_BITS
        self.r = rng.gamma(2.0, 1.0, n)
        self.log_c = np.log(rng.gamma(2.0, 1.0, n))
        self.beta = rng.random(n)
        self.turns = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.values = np.zeros((0, n), dtype=np.float32)

    def _position(self, step, entry):
        return np.floor(step / GRID / self.r[entry] + self.beta[entry])

    def _table(self, steps: int) -> np.ndarray:
        """log a of every draw for each grid step below ``steps`` (made when first needed)."""
        every = np.arange(len(self.r))
        for step in range(len(self.values), steps):
            log_y = self.r * (self._position(np.float64(step), every) - self.beta)
            self.values = np.vstack([self.values, (self.log_c - log_y - self.r).astype(np.float32)[None]])
        return self.values

    def bands(self, kinds: np.ndarray, steps: np.ndarray) -> np.ndarray:
        values = self._table(int(steps.max()) + 1).ravel()
        hashes = len(self.turns)
        best = np.full(hashes, np.inf, dtype=np.float32)
        pick = np.zeros(hashes, dtype=np.int64)
        for lo in range(0, len(kinds), 4096):          # blocks of shingles, so that long texts need little memory
            entry = (kinds[None, lo:lo + 4096] * self.turns[:, None]) >> np.uint64(64 - DRAWS_BITS)
            drawn = values[entry.astype(np.int64) + (steps[lo:lo + 4096] << DRAWS_BITS)[None]]
            first = drawn.argmin(axis=1)
            low = drawn[np.arange(hashes), first]
            better = low < best
            best[better], pick[better] = low[better], first[better] + lo
        chosen, entry = kinds[pick], (kinds[pick] * self.turns >> np.uint64(64 - DRAWS_BITS)).astype(np.int64)
        place = self._position(steps[pick], entry).astype(np.int64).astype(np.uint64)
        sample = _mix(chosen * _M1 + place).reshape(BANDS, ROWS)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for k in range(ROWS):
            key = _mix(key * _M1 + sample[:, k])
        return key.view(np.int64)


@lru_cache(maxsize=1)
def sampler() -> Sampler:
    return Sampler()


# ---------------------------------------------------------------- candidates and links

def signatures(docs: DataFrame, rare) -> DataFrame:
    """(id, digest, bands) of ``docs(id, text)``; texts without words are left out.  ``rare``: broadcast rarity."""
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows, keys, bands = [], [], []
            for k, (text, hashes) in enumerate(zip(texts, shingles(texts))):
                if len(hashes):
                    rows.append(k)
                    keys.append(blake2b(plain_words(text), digest_size=16).digest())
                    bands.append(sampler().bands(*weighted_set(hashes, rare.value)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows, pa.int64())), pa.array(keys, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], ["id", "digest", "bands"])

    return docs.mapInArrow(run, "id long, digest binary, bands array<long>")


def texts_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, text) of the ids in ``pairs(hub, id)``, as a written table.

    The ids grow with the corpus, so they are merged with the texts at every
    size; a broadcast that holds for small inputs only would change the plan.
    """
    asked = pairs.select(F.col("hub").alias("id")).union(pairs.select("id")).distinct()
    return cut(texts.join(asked.hint("merge"), "id"), "near-texts")


def verified(pairs: DataFrame, used: DataFrame, rare, threshold: float = SIMILARITY) -> DataFrame:
    """The ``pairs(hub, id)`` whose texts ``used(id, text)`` reach the threshold, as (src, dst)."""
    left = pairs.join(used.hint("merge"), "id").select("hub", "id", "text")
    hubs = used.select(F.col("id").alias("hub"), F.col("text").alias("hub_text"))

    def run(batches):
        last, known = None, None
        for batch in batches:
            hub, ids = batch.column("hub").to_pylist(), batch.column("id").to_pylist()
            keep = []
            sets = shingles(batch.column("text").to_pylist())
            hub_texts = batch.column("hub_text")
            for k, h in enumerate(hub):
                if h != last:
                    last, known = h, weighted_set(shingles([hub_texts[k].as_py()])[0], rare.value)
                if similarity(known, weighted_set(sets[k], rare.value)) >= threshold:
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([hub[k] for k in keep], pa.int64()),
                                              pa.array([ids[k] for k in keep], pa.int64())], ["src", "dst"])

    return cut(left.join(hubs.hint("merge"), "hub").select("hub", "id", "text", "hub_text")
               .mapInArrow(run, "src long, dst long"), "near-links")


def links_between(left: list, right: list, threshold: float) -> list[tuple[int, int]]:
    """Pairs of ids of other components whose sets reach the threshold; items are (id, component, set)."""
    hashes = np.concatenate([kinds for _, _, (kinds, _) in right])
    order = np.argsort(hashes, kind="stable")
    owner = np.repeat(np.arange(len(right)), [len(kinds) for _, _, (kinds, _) in right])[order]
    weight = np.exp(np.concatenate([steps for _, _, (_, steps) in right]) / GRID)[order]
    hashes, total = hashes[order], np.bincount(owner, weights=weight, minlength=len(right))
    part = np.array([c for _, c, _ in right])
    out = []
    for own, component, (kinds, steps) in left:
        mine = np.exp(steps / GRID)
        lo, hi = np.searchsorted(hashes, kinds, "left"), np.searchsorted(hashes, kinds, "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], weights=np.minimum(np.repeat(mine, n), weight[at]), minlength=len(right))
        alike = both / (mine.sum() + total - both) >= threshold
        out += [(own, right[k][0]) for k in np.flatnonzero(alike & (part != component))]
    return out


def linked_within(placed: DataFrame, used: DataFrame, rare, threshold: float) -> DataFrame:
    """Links across components among the members ``placed(hub, rep, component)`` of each hub's buckets.

    Members outside their group's largest component are compared with all
    others of the group.  Groups are dealt into blocks of about BLOCK texts; a
    task compares two blocks exactly and returns the links alone, so a group
    of any size is spread over tasks and no pair that is no link leaves one.
    """
    sizes = placed.groupBy("hub", "component").agg(F.count("*").alias("n"))
    mixed = cut(sizes.groupBy("hub").agg(F.max_by("component", F.struct("n", "component")).alias("largest"),
                                         F.sum("n").alias("n"), F.count("*").alias("kinds"))
                .filter("kinds > 1").select("hub", "largest", "n"), "near-mixed")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    members = cut(placed.join(mixed, "hub").select(
        "hub", "rep", "component", (F.col("component") != F.col("largest")).alias("outside"),
        F.pmod(F.xxhash64("rep"), parts).cast("int").alias("block")), "near-mixed-members")
    blocks = cut(members.join(used.withColumnRenamed("id", "rep").hint("merge"), "rep").groupBy("hub", "block").agg(
        F.collect_list(F.struct("rep", "component", "outside", "text")).alias("docs"),
        F.max("outside").alias("outside")), "near-blocks")
    one = blocks.select("hub", "block", "outside")
    tasks = cut(one.filter("outside").select("hub", F.col("block").alias("a"))
                .join(one.select("hub", F.col("block").alias("b")), "hub"), "near-block-pairs")

    def run(batches):
        for batch in batches:
            src, dst = [], []
            for left, right in zip(batch.column("left"), batch.column("right")):
                def sets(docs):
                    made = [weighted_set(h, rare.value) for h in shingles([d["text"] for d in docs])]
                    return [(d["rep"], d["component"], s) for d, s in zip(docs, made)]
                left, right = left.as_py(), right.as_py()
                for x, y in links_between(sets([d for d in left if d["outside"]]), sets(right), threshold):
                    src.append(min(x, y))
                    dst.append(max(x, y))
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    body = blocks.select("hub", "block", "docs")
    pairs = (tasks.join(body.select("hub", F.col("block").alias("a"), F.col("docs").alias("left")), ["hub", "a"])
             .join(body.select("hub", F.col("block").alias("b"), F.col("docs").alias("right")), ["hub", "b"]))
    text_batches(used.sparkSession, 8)           # rows hold two blocks of texts
    out = cut(pairs.select("left", "right").mapInArrow(run, "src long, dst long"), "near-2-links")
    text_batches(used.sparkSession)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = SIMILARITY) -> DataFrame:
    """(id, component, kept) for every row with an id: component is the smallest id of the row's group."""
    spark = docs.sparkSession
    text_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rare = spark.sparkContext.broadcast(rarity(*document_frequencies(texts)))      # CELLS numbers of 4 bytes
    signed = cut(signatures(texts.filter("id IS NOT NULL"), rare), "near-signatures")
    classes = cut(signed.groupBy("digest").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")),
                  "near-classes")

    members = cut(classes.select("rep", F.explode("bands").alias("key"))
                  .groupBy("rep", "key").agg(F.lit(1).alias("one")).select("rep", "key"), "near-members")
    shared = cut(members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "near-shared")
    inside = cut(members.join(shared, "key"), "near-inside")
    degree = cut(inside.groupBy("rep").agg(F.sum(F.col("n") - 1).alias("degree")), "near-degrees")
    central = inside.join(degree, "rep").groupBy("key").agg(
        F.max(F.struct("degree", (-F.col("rep")).alias("low"))).alias("top")).select("key", (-F.col("top.low")).alias("hub"))
    grouped = cut(inside.join(cut(central, "near-hubs"), "key").filter("rep != hub").select("hub", "rep").distinct(),
                  "near-grouped")
    pairs = grouped.select("hub", F.col("rep").alias("id"))
    used = texts_of(pairs, texts)
    links = verified(pairs, used, rare, threshold)

    found = components(links, "near-a")
    placed = cut(grouped.join(found.withColumnRenamed("id", "rep"), "rep", "left")
                 .select("hub", "rep", F.coalesce("component", "rep").alias("component")), "near-placed")
    more = linked_within(placed, used, rare, threshold)

    reps = components(links.union(more), "near-b")
    own = classes.select("digest", "rep").join(reps.withColumnRenamed("id", "rep"), "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("component"))
    groups = signed.select("id", "digest").join(cut(own, "near-own"), "digest").groupBy("id").agg(
        F.min("component").alias("component"))
    return cut(groups, "near-groups")


def dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest id of its near-duplicate group, and whether it stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = near_duplicates(docs).withColumnRenamed("id", "doc_id")
    out = docs.select("doc_id").join(groups, "doc_id", "left").withColumn(
        "component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate group (the smallest id; repeated rows of it once)."""
    groups = near_duplicates(docs)
    gone = cut(groups.filter("id != component").select(F.col("id").alias("doc_id")), "near-gone")
    kept = docs.join(gone, "doc_id", "left_anti")
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    return kept.dropDuplicates() if repeated.limit(1).count() else kept

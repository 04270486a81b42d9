"""Packing documents into sequences of fixed length by linear grouping and best fit.

A document is its token ids and one closing id; only longer ones are cut, into
pieces of ``capacity`` tokens and a rest.  How pieces are packed depends on
their lengths alone, and there are at most ``capacity`` different lengths, so
the plan is made on the histogram of lengths (on the driver, whatever the
number of documents):

1. Large lengths (over ``capacity / share``) are split into ``groups`` groups
   of equal cardinality and rounded up to the longest of their group.
2. Configurations of these few sizes are optimised: a linear program over all
   of them, solved by column generation (the next configuration is a knapsack
   over the current prices); its whole part is taken.
3. The real lengths are put in place of the rounded ones, longest first, which
   shows the room that is really left in each sequence.
4. The rest, longest first, goes to the fullest sequences it still fits (best
   fit), new sequences being opened where none fits.

This is done for a few bounds of large lengths and numbers of groups; the plan
with the fewest sequences is taken.

The plan speaks of runs ("the next n pieces of length l lie in the n sequences
from s on, at offset o"), so its size depends on the lengths and not on the
number of pieces.  Pieces get their place by their rank among the pieces of
their length; ranks come from salted groups of bounded size.

Defined results: a NULL text is an empty one (the closing id alone); rows with
a repeated or NULL id are documents of their own; an empty table packs into
nothing; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .bpe import Encoder, default_tokenizer
from .common import cut, table, text_batches

CAPACITY = 2048
CLOSING_ID = 0
GROUPS = (8, 32)        # numbers of groups of equal cardinality that large lengths are rounded to
SMALL_SHARES = (4, 3, 2)   # lengths up to capacity / share are small
RANK_GROUP = 256        # pieces of one length ranked together, at least
RANK_GROUPS = 100_000   # groups of ranked pieces, about, at most (more pieces make larger groups)


# ---------------------------------------------------------------- the plan, on the histogram of lengths

def equal_groups(counts: np.ndarray, smallest: int, groups: int) -> np.ndarray:
    """For each length from ``smallest`` on: the group (by equal cardinality) that it belongs to, else -1."""
    total = counts[smallest:].sum()
    of = np.full(len(counts), -1)
    if total:
        before = np.cumsum(counts[smallest:]) - counts[smallest:]
        of[smallest:] = np.minimum(before * groups // total, groups - 1)
        of[counts == 0] = -1
        _, dense = np.unique(of[of >= 0], return_inverse=True)
        of[of >= 0] = dense
    return of


def best_configuration(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity (unbounded knapsack, layer by layer)."""
    most = capacity // int(sizes.min())
    value, choice = [np.zeros(capacity + 1)], []
    for _ in range(most):
        last, new, pick = value[-1], value[-1].copy(), np.full(capacity + 1, -1)
        for g, s in enumerate(sizes):
            with_g = last[:capacity + 1 - s] + prices[g]
            better = with_g > new[s:] + 1e-12
            new[s:][better] = with_g[better]
            pick[s:][better] = g
        value.append(new)
        choice.append(pick)
    room, config = capacity, np.zeros(len(sizes), dtype=np.int64)
    for pick in reversed(choice):
        g = pick[room]
        if g >= 0:
            config[g] += 1
            room -= int(sizes[g])
    return float(config @ prices), config


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, steps: int = 2000):
    """Configurations and their (fractional) numbers that cover the demand in few sequences."""
    basis = np.diag(capacity // sizes).astype(float)
    x = demand / np.diag(basis)
    for _ in range(steps):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        worth, config = best_configuration(sizes, prices, capacity)
        if worth <= 1 + 1e-9:
            break
        share = np.linalg.solve(basis, config.astype(float))
        leave = np.where(share > 1e-12, x / np.where(share > 1e-12, share, 1), np.inf)
        out = int(np.argmin(leave))
        basis[:, out] = config
        x = np.maximum(np.linalg.solve(basis, demand.astype(float)), 0)
    return basis.T.astype(np.int64), x


class Runs:
    """Sequences with equal room kept as runs (first sequence, number); remembers where pieces go."""

    def __init__(self, capacity: int):
        self.capacity, self.next = capacity, 0
        self.rooms: list[int] = []                     # rooms that some sequence has, ascending
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.rows: list[tuple[int, int, int, int]] = []   # length, number of pieces, first sequence, offset

    def open(self, n: int) -> int:
        first, self.next = self.next, self.next + n
        return first

    def leave(self, room: int, first: int, n: int) -> None:
        if room and n:
            if room not in self.runs:
                self.runs[room] = []
                insort(self.rooms, room)
            self.runs[room].append((first, n))

    def put(self, length: int, count: int) -> None:
        """Best fit for ``count`` pieces of one length."""
        while count:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                n = -(-count // (self.capacity // length))
                self.leave(self.capacity, self.open(n), n)
                continue
            room = self.rooms[at]
            first, n = self.runs[room].pop()
            if not self.runs[room]:
                del self.runs[room]
                del self.rooms[at]
            take = min(n, count)
            self.rows.append((length, take, first, self.capacity - room))
            self.leave(room - length, first, take)
            self.leave(room, first + take, n - take)
            count -= take


def make_plan(counts: np.ndarray, capacity: int = CAPACITY, groups=GROUPS, shares=SMALL_SHARES) -> np.ndarray:
    """Rows (length, first rank, number, first sequence, offset), ranks ascending for each length.

    ``counts[l]`` is the number of pieces of length l, for l up to the
    capacity.  Of the plans for the given numbers of groups and bounds of
    small lengths, the first with the fewest sequences is taken.
    """
    plans = [plan_once(counts, capacity, g, share) for share in shares for g in groups]
    return min(plans, key=lambda p: p[0])[1]


def plan_once(counts: np.ndarray, capacity: int, groups: int, share: int) -> tuple[int, np.ndarray]:
    """Number of sequences and rows of the plan for one number of groups and one bound of small lengths."""
    left = counts.astype(np.int64).copy()
    runs = Runs(capacity)
    if left[capacity]:
        runs.rows.append((capacity, int(left[capacity]), runs.open(int(left[capacity])), 0))
        left[capacity] = 0
    of = equal_groups(left, capacity // share + 1, groups)
    n_groups = int(of.max(initial=-1)) + 1
    if n_groups:
        sizes = np.array([np.flatnonzero(of == g).max() for g in range(n_groups)])
        demand = np.array([left[of == g].sum() for g in range(n_groups)])
        pool = [[(int(l), int(left[l])) for l in np.flatnonzero(of == g)] for g in range(n_groups)]
        for config, x in zip(*configurations(sizes, demand, capacity)):
            n = int(x + 1e-9)
            slots = [g for g in range(n_groups - 1, -1, -1) for _ in range(int(config[g]))]
            n = min([n, *(sum(c for _, c in pool[g]) // slots.count(g) for g in set(slots))])
            if not n:
                continue
            parts = [(runs.open(n), n, capacity)]       # first sequence, number, room
            for g in slots:
                filled = []
                for first, m, room in parts:
                    while m:
                        length, have = pool[g][-1]
                        take = min(have, m)
                        pool[g].pop()
                        if have > take:
                            pool[g].append((length, have - take))
                        left[length] -= take
                        runs.rows.append((length, take, first, capacity - room))
                        filled.append((first, take, room - length))
                        first, m = first + take, m - take
                parts = filled
            for first, m, room in parts:
                runs.leave(room, first, m)
    for length in range(capacity, 0, -1):
        runs.put(length, int(left[length]))
    rows = np.array(runs.rows, dtype=np.int64).reshape(-1, 4)
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    before = np.cumsum(rows[:, 1]) - rows[:, 1]
    start = np.searchsorted(rows[:, 0], rows[:, 0])     # first row of the same length
    return runs.next, np.column_stack([rows[:, 0], before - before[start] if len(rows) else before, rows[:, 1:]])


# ---------------------------------------------------------------- the work on the pieces

class LibraryEncoder(Encoder):
    """An encoder whose words are merged by the tokenizers library itself."""

    def build(self, path: str, model: dict) -> None:
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path).model

    def word_ids(self, letters: str) -> list[int]:
        return [t.id for t in self.model.tokenize(letters)]


@lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    """One encoder per Python worker and file."""
    return LibraryEncoder(path)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None,
                 closing_id: int = CLOSING_ID, id_col: str = "doc_id", text_col: str = "text",
                 with_ids: bool = False) -> DataFrame:
    """One row per piece: document, piece, start, length and CRC-32 of the ids (and the ids if asked for)."""
    path = tokenizer or default_tokenizer()
    text_batches(docs.sparkSession)
    closing, width = np.array([closing_id], dtype="<u4").tobytes(), 4 * capacity
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            rows = []
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = enc.encode(text) + closing
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at:at + width]
                    rows.append((row, piece, at // 4, len(part) // 4, zlib.crc32(part), part))
            row, piece, start, length, crc, ids = zip(*rows) if rows else ((),) * 6
            columns = [batch.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                       *(pa.array(v, pa.int64()) for v in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names)

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long"
                             + ", ids binary" * with_ids))


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups=GROUPS, shares=SMALL_SHARES) -> DataFrame:
    """``pieces`` (a written table with ``length``, ``doc_id``, ``piece``) with ``sequence_id`` and ``offset`` appended."""
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():     # at most ``capacity`` rows
        counts[length] = n
    size = max(RANK_GROUP, -(-int(counts.sum()) // RANK_GROUPS))
    plan = make_plan(counts, capacity, groups, shares)

    salts = F.array(*[F.lit(int(max(1, -(-int(n) // size)))) for n in counts])
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"),
                                              F.get(salts, F.col("length").cast("int"))).cast("int"))
    groups_of = salted.groupBy("length", "salt").count().toPandas().sort_values(["length", "salt"])
    groups_of["before"] = groups_of.groupby("length")["count"].cumsum() - groups_of["count"]
    # both tables depend on the lengths and on RANK_GROUPS, not on the number of pieces
    held = spark.sparkContext.broadcast((
        plan, groups_of["length"].to_numpy(np.int64) << 32 | groups_of["salt"].to_numpy(np.int64),
        groups_of["before"].to_numpy(np.int64), np.searchsorted(plan[:, 0], np.arange(capacity + 2))))
    ranked = salted.withColumn("rank", F.row_number().over(
        Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
    out = pieces.schema.simpleString()[7:-1] + ", sequence_id:long, offset:long"
    keep = pieces.columns

    def place(batches):
        rows, keys, before, first_row = held.value
        for batch in batches:
            length, salt, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                                  for c in ("length", "salt", "rank"))
            rank = rank - 1 + before[np.searchsorted(keys, length << 32 | salt)]
            lo, hi = first_row[length], first_row[length + 1]
            while (lo + 1 < hi).any():                 # last plan row of the length that starts at or before the rank
                mid = (lo + hi) // 2
                right = (rows[np.minimum(mid, len(rows) - 1), 1] <= rank) & (lo + 1 < hi)
                lo, hi = np.where(right, mid, lo), np.where(right, hi, np.maximum(mid, lo + 1))
            at = rows[lo]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(at[:, 3] + rank - at[:, 1]), pa.array(at[:, 4])],
                keep + ["sequence_id", "offset"])

    return ranked.mapInArrow(place, out.replace(":", " "))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents packed into sequences."""
    return pack(cut(token_pieces(docs), "pieces"))


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 2048 tokens."""
    return packing_stage(spark, table(spark, sf_dir, "documents"), sf_dir)

"""Exact near-duplicate vectors by dual traversal of cover trees.

Vectors link when their labels are equal and not NULL and their cosine is at
least the threshold.  On unit vectors that is a distance of at most
sqrt(2 - 2 * threshold), so metric trees apply.

* Equal vectors of a label become one representative with a multiplicity, so a
  vector that very many rows share is compared once.
* The top of each label's tree is made by Spark: every representative goes to
  the nearest of a few pivots of its label, and a pivot's cell is dealt into
  blocks of at most about ``BLOCK`` rows.  A block has a centre and a covering
  radius.
* Pairs of blocks of a label are pruned by their covering radii (centres
  further apart than both radii and the threshold distance cannot link); the
  rest become tasks.
* In a task each block is a cover tree: nested levels with halving radii, each
  node covering its points within the level's radius.  Both trees are
  traversed together; node pairs are pruned by the covering radii they really
  have, and pairs of points that remain are decided by their cosine in double
  precision.

A task returns, for each vector, how many others it links to there, and a
spanning forest of its links, never the pairs themselves.  Every linking pair
is found: nothing is sampled or capped.  In spaces where all distances are
alike the radii prune little, and the work of a label grows with the square of
its different vectors, as for any exact method; it is then done in blocks.

Defined results: a vector that is NULL, empty, zero or has NULL or non-finite
components links with nothing, as do rows with a NULL label or NULL id;
vectors of different lengths do not link; repeated rows are vectors of their
own that share an id; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, table, text_batches

THRESHOLD = 0.98
PIVOTS = 8
BLOCK = 1024
TILE = 2048


# ---------------------------------------------------------------- trees inside a task

class CoverTree:
    """Nested levels over unit vectors; ``children`` of a node lie within the node's level radius."""

    def __init__(self, unit: np.ndarray, leaf_radius: float):
        self.unit = unit
        gaps = np.sqrt(np.maximum(2 - 2 * (unit @ unit.T), 0))
        self.centre, self.reach, self.children, self.points = [], [], [], []
        self.root = self._node(np.arange(len(unit)), 0, 2.0, gaps, leaf_radius)

    def _node(self, members: np.ndarray, centre: int, radius: float, gaps, leaf_radius) -> int:
        at = len(self.centre)
        self.centre.append(centre)
        self.reach.append(float(gaps[centre, members].max()))       # the radius the node really covers
        self.children.append(None)
        self.points.append(members)
        if len(members) > 1 and radius > leaf_radius and self.reach[at] > 0:
            radius /= 2
            kids, left, own = [], members, centre                   # the node's centre is a centre below, too
            while len(left):
                near = gaps[own, left] <= radius
                kids.append((own, left[near]))
                left = left[~near]
                own = int(left[0]) if len(left) else -1
            if len(kids) == 1:
                return self._only(at, kids[0], radius, gaps, leaf_radius)
            self.children[at] = np.array([self._node(m, c, radius, gaps, leaf_radius) for c, m in kids])
        return at

    def _only(self, at, kid, radius, gaps, leaf_radius) -> int:
        """A level with one node adds nothing: go on with the next level in place."""
        while radius > leaf_radius and self.reach[at] > 0:
            radius /= 2
            kids, left, own = [], kid[1], kid[0]
            while len(left):
                near = gaps[own, left] <= radius
                kids.append((own, left[near]))
                left = left[~near]
                own = int(left[0]) if len(left) else -1
            if len(kids) > 1:
                self.children[at] = np.array([self._node(m, c, radius, gaps, leaf_radius) for c, m in kids])
                break
        return at


def linked_pairs(a: CoverTree, b: CoverTree, threshold: float, slack: float = 1e-7):
    """Yield (points of a, points of b) whose cosine reaches the threshold, by dual traversal."""
    limit = np.sqrt(2 - 2 * threshold) + slack
    centres_a, centres_b = a.unit[np.array(a.centre)], b.unit[np.array(b.centre)]
    reach_a, reach_b = np.array(a.reach), np.array(b.reach)
    stack = [(a.root, b.root)]
    while stack:
        p, q = stack.pop()
        kids_p, kids_q = a.children[p], b.children[q]
        if kids_p is None and kids_q is None:
            rows, cols = a.points[p], b.points[q]
            for lo in range(0, len(rows), TILE):
                x, y = np.nonzero(a.unit[rows[lo:lo + TILE]] @ b.unit[cols].T >= threshold)
                if len(x):
                    yield rows[lo:lo + TILE][x], cols[y]
            continue
        kids_p = np.array([p]) if kids_p is None else kids_p
        kids_q = np.array([q]) if kids_q is None else kids_q
        for lo in range(0, len(kids_p), TILE):
            part = kids_p[lo:lo + TILE]
            gap = np.sqrt(np.maximum(2 - 2 * (centres_a[part] @ centres_b[kids_q].T), 0))
            x, y = np.nonzero(gap <= reach_a[part][:, None] + reach_b[kids_q][None, :] + limit)
            single = (reach_a[part][x] == 0) & (reach_b[kids_q][y] == 0)      # nodes of equal points only
            stack.extend(zip(part[x[~single]].tolist(), kids_q[y[~single]].tolist()))
            if single.any():
                rows, cols = part[x[single]], kids_q[y[single]]
                one = np.array([len(a.points[r]) * len(b.points[c]) for r, c in zip(rows, cols)]) == 1
                i = np.array([a.points[r][0] for r in rows[one]], dtype=np.int64)
                j = np.array([b.points[c][0] for c in cols[one]], dtype=np.int64)
                good = np.einsum("ij,ij->i", a.unit[i], b.unit[j]) >= threshold
                if good.any():
                    yield i[good], j[good]
                stack.extend(zip(rows[~one].tolist(), cols[~one].tolist()))


def block_links(ids_a, unit_a, many_a, ids_b, unit_b, many_b, same: bool, threshold: float):
    """(id, links, root) of the vectors that link within a pair of blocks."""
    leaf = np.sqrt(2 - 2 * threshold) / 2
    tree_a = CoverTree(unit_a, leaf)
    tree_b = tree_a if same else CoverTree(unit_b, leaf)
    n = len(ids_a)
    ids = ids_a if same else np.concatenate([ids_a, ids_b])
    many = many_a if same else np.concatenate([many_a, many_b])
    links, parent = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for i, j in linked_pairs(tree_a, tree_b, threshold):
        if same:
            i, j = i[i < j], j[i < j]
        else:
            j = j + n
        np.add.at(links, i, many[j])
        np.add.at(links, j, many[i])
        for x, y in zip(i.tolist(), j.tolist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y, key=lambda k: ids[k])] = min(x, y, key=lambda k: ids[k])
    linked = np.flatnonzero(links)
    return ids[linked], links[linked], ids[[find(k) for k in linked]] if len(linked) else ids[linked]


# ---------------------------------------------------------------- the top of the trees, in Spark

def _matrix(column) -> np.ndarray:
    """Rows of a list column of equal lengths, as doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)               # scaled first, so that no square over- or underflows
    x = x / top
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vector) of the rows that can link."""
    v = F.col("vector")
    good = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(
        v, lambda x: x != 0)
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
                           F.col(vector_col).cast("array<double>").alias("vector"))
            .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & good))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component) of every vector that links with another one."""
    text_batches(vectors.sparkSession)
    usable = usable_vectors(vectors, id_col, vector_col, label_col)
    width = F.size("vector").alias("width")
    reps = cut(usable.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("many"))
               .select("rep", "many", "label", width, "vector"), "vec-reps")
    same = cut(usable.join(reps.filter("many > 1").select("label", "vector", "rep", "many"), ["label", "vector"])
               .select("id", "rep", "many"), "vec-same")

    pivots = cut(reps.groupBy("label", "width").agg(F.array(*[
        F.min_by("vector", F.xxhash64("rep", F.lit(k))) for k in range(PIVOTS)]).alias("pivots")), "vec-pivots")

    def nearest(batches):
        for batch in batches:
            cell = np.zeros(batch.num_rows, dtype=np.int32)
            for k in range(batch.num_rows):
                points = _unit(np.array(batch.column("pivots")[k].as_py(), dtype=np.float64))
                cell[k] = int((points @ _unit(_matrix(batch.column("vector").slice(k, 1)))[0]).argmax())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("rep", "many", "label", "width", "vector")] + [pa.array(cell)],
                ["rep", "many", "label", "width", "vector", "cell"])

    label = reps.schema["label"].dataType.simpleString()
    celled = cut(reps.join(pivots, ["label", "width"]).select("rep", "many", "label", "width", "vector", "pivots")
                 .mapInArrow(nearest, f"rep long, many long, label {label}, width int, vector array<double>, cell int"),
                 "vec-cells")
    sizes = cut(celled.groupBy("label", "width", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")),
                "vec-sizes")
    dealt = celled.join(sizes, ["label", "width", "cell"]).withColumn(
        "part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    keys = ["label", "width", "cell", "part"]

    def pack(frame):
        unit = _unit(np.stack([np.asarray(v, dtype=np.float64) for v in frame["vector"]]))
        middle = unit.mean(axis=0)
        radius = float(np.sqrt(((unit - middle) ** 2).sum(axis=1)).max())
        out = frame[keys].head(1).copy()
        out["centre"], out["radius"] = [middle.tolist()], radius
        out["ids"], out["many"] = [frame["rep"].to_numpy().tobytes()], [frame["many"].to_numpy().tobytes()]
        out["data"] = [unit.tobytes()]
        return out

    shape = (f"label {label}, width int, cell int, part int, centre array<double>, radius double, ids binary, "
             "many binary, data binary")
    blocks = cut(dealt.select("rep", "many", "vector", *keys).groupBy(*keys).applyInPandas(pack, shape)
                 .withColumn("block", F.concat_ws(":", "cell", "part")), "vec-blocks")

    meta = blocks.select("label", "width", "block", "centre", "radius")
    other = meta.select("label", "width", *[F.col(c).alias(f"{c}_b") for c in ("block", "centre", "radius")])
    apart = F.sqrt(F.aggregate(F.zip_with("centre", "centre_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                               lambda t, x: t + x))
    limit = float(np.sqrt(2 - 2 * threshold)) + 1e-7
    tasks = cut(meta.join(other, ["label", "width"]).filter(F.col("block") <= F.col("block_b"))
                .filter((F.col("block") == F.col("block_b")) | (apart <= F.col("radius") + F.col("radius_b") + limit))
                .select("label", "width", "block", "block_b"), "vec-tasks")
    body = blocks.select("label", "width", "block", "ids", "many", "data")
    body_b = body.select("label", "width", *[F.col(c).alias(f"{c}_b") for c in ("block", "ids", "many", "data")])

    def compare(batches):
        for batch in batches:
            out: list = [[], [], []]
            for row in range(batch.num_rows):
                def numbers(name, kind, shape=-1):
                    return np.frombuffer(batch.column(name)[row].as_py(), dtype=kind).reshape(shape)
                wide = (-1, batch.column("width")[row].as_py())
                equal = batch.column("block")[row].as_py() == batch.column("block_b")[row].as_py()
                found = block_links(numbers("ids", np.int64), numbers("data", np.float64, wide),
                                    numbers("many", np.int64), numbers("ids_b", np.int64),
                                    numbers("data_b", np.float64, wide), numbers("many_b", np.int64), equal, threshold)
                for part, values in zip(out, found):
                    part.append(values)
            columns = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in out]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "links", "root"])

    text_batches(vectors.sparkSession, 8)         # rows hold two blocks of vectors
    pairs = tasks.join(body, ["label", "width", "block"]).join(body_b, ["label", "width", "block_b"])
    found = cut(pairs.select("width", "block", "block_b", "ids", "many", "data", "ids_b", "many_b", "data_b")
                .repartition(F.xxhash64("label", "block", "block_b"))
                .mapInArrow(compare, "id long, links long, root long"), "vec-found")
    text_batches(vectors.sparkSession)
    links = cut(found.groupBy("id").agg(F.sum("links").alias("links")), "vec-links")
    groups = components(found.select(F.col("id").alias("src"), F.col("root").alias("dst")), "vec-groups")
    near = links.join(groups, "id").select(F.col("id").alias("rep"), "links", "component")
    # every row of a shared vector, and the vectors that stand alone
    shared = same.join(near, "rep", "left").select(
        "id", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component"))
    single = near.join(reps.filter("many = 1").select("rep"), "rep").select(
        F.col("rep").alias("id"), F.col("links").alias("n_links"), "component")
    return shared.unionByName(single)


def embedding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its number of links and its component."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    near = near_vectors(vectors)
    near = near.groupBy(F.col("id").alias("vec_id")).agg(F.max("n_links").alias("n_links"),
                                                        F.min("component").alias("component"))
    return (vectors.select("vec_id").join(near, "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "vec_id").cast("long").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS l FROM v),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.98),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
c AS (SELECT x, min(y) AS low FROM reach GROUP BY x),
d AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id,
       coalesce(e.vec_id = least(e.vec_id, coalesce(c.low, e.vec_id)), true) AS kept
FROM embeddings e LEFT JOIN c ON c.x = e.vec_id LEFT JOIN d ON d.x = e.vec_id
"""

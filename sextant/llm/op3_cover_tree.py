"""Exact top-k inner products by dual-tree cover-tree search.

Queries and data are indexed alike. The upper two levels of the tree are nets of pivots
from a bounded sample, as many as the data need (cells of about ``CELL_ROWS`` rows, at
most ``MOST_CELLS``): a vector goes to its nearest pivot of the first net, then to the
nearest of the second net below it, whose cell it joins. A cell is a block, or blocks cut
by hash where it is too large; each block is a cover tree of its own (every child covers
its points within half of the parent's radius, children's centres are further apart than
that). The largest inner product between a group of queries and a node is at most
``<cq, cp> + rq |cp| + rp |cq| + rq rp``; a pair below the group's worst kth score is
pruned. A first search in the near block gives every query group that score; then pairs
of groups and upper nodes, of groups and cells, of groups and blocks, and of nodes inside
blocks are pruned by it.

Defined results: vectors null or with null or non-finite components take no part; a
component whose floor, or a score that, leaves 64 bits is an error; missing trailing
components count as 0; equal rows (id and vector) are one row; rows that share an id
never answer each other; ties go to the smaller id; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table
from .vectors import dimension, finite, matrix

K = 5
QUERY_EVERY = 50
SCALE = 256
CELL_ROWS, MOST_CELLS = 1_024, 4_096
#: Vectors drawn per cell to choose pivots from; with MOST_CELLS this bounds the sample.
SAMPLE_PER_CELL = 16
BLOCK_ROWS, GROUP_ROWS, LEAF_ROWS, QUERY_LEAF = 4_096, 256, 128, 32
#: Query groups that travel together to a block.
CHUNK_GROUPS = 32
#: Rounding of bounds, as a share of the product of the lengths.
ROUNDING = 1e-11
LOWEST = np.iinfo(np.int64).min

Tree = dict[str, np.ndarray]


def pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first net of a sample, beginning with its first vector."""
    if not len(sample):
        return sample
    chosen, gap = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


class Net:
    """Two levels of pivots: ``upper`` and, for each, those below it."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.fan = max(1, math.ceil(math.sqrt(cells)))
        self.upper = pivots(sample, self.fan)
        near = nearest(sample, self.upper)
        self.lower = [pivots(sample[near == i], self.fan) for i in range(len(self.upper))]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Cell of every row of x: upper pivot times ``fan`` plus lower pivot."""
        top = nearest(x, self.upper)
        out = top * self.fan
        for i in np.unique(top):
            out[top == i] += nearest(x[top == i], self.lower[i])
        return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of every row; 0 if there is none."""
    if not len(x) or not len(centres):
        return np.zeros(len(x), np.int64)
    return ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def build(x: np.ndarray, leaf: int) -> Tree:
    """Cover tree over the rows of x as flat arrays.

    ``order`` lists rows so that each node owns ``order[begin:end]``; the children of a
    node are nodes ``first`` to ``last``; a leaf has none.
    """
    n = len(x)
    order = np.arange(n)
    begin, end, centre, radius, first, last = [0], [n], [0], [float(np.sqrt(((x - x[0]) ** 2).sum(axis=1).max()))], [0], [0]
    todo = [0]
    while todo:
        node = todo.pop()
        b, e, r = begin[node], end[node], radius[node]
        if e - b <= leaf or r == 0:
            continue
        left, parts = order[b:e].copy(), []
        c = centre[node]
        while len(left):
            gap = np.sqrt(((x[left] - x[c]) ** 2).sum(axis=1))
            near = gap <= r / 2
            parts.append((c, left[near], float(gap[near].max())))
            left, gap = left[~near], gap[~near]
            if len(parts) >= leaf and len(left):  # scattered points: the rest are leaves by position
                for i in range(0, len(left), leaf):
                    some = left[i : i + leaf]
                    parts.append((some[0], some, float(np.sqrt(((x[some] - x[some[0]]) ** 2).sum(axis=1)).max())))
                break
            if len(left):
                c = left[gap.argmax()]
        # Tiny children next to each other share a leaf: fewer, fuller nodes prune alike.
        merged: list[tuple[int, np.ndarray, float]] = []
        for c, rows, r_own in parts:
            if merged and len(rows) + len(merged[-1][1]) <= leaf // 2:
                c0, rows0, _ = merged[-1]
                both = np.concatenate((rows0, rows))
                merged[-1] = (c0, both, float(np.sqrt(((x[both] - x[c0]) ** 2).sum(axis=1)).max()))
            else:
                merged.append((c, rows, r_own))
        if len(merged) == 1:
            continue
        first[node], last[node] = len(begin), len(begin) + len(merged)
        at = b
        for c, rows, r_own in merged:
            order[at : at + len(rows)] = rows
            todo.append(len(begin))
            begin.append(at)
            at += len(rows)
            end.append(at)
            centre.append(int(c))
            radius.append(r_own)
            first.append(0)
            last.append(0)
    return {"order": order, "begin": np.array(begin), "end": np.array(end), "centre": np.array(centre), "radius": np.array(radius) * (1 + 1e-9), "first": np.array(first), "last": np.array(last)}


class Side:
    """Rows in tree order with their nodes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, tree: Tree):
        self.ids, self.x, self.tree = ids[tree["order"]], x[tree["order"]], tree
        self.centres = x[tree["centre"]].astype(np.float64)
        self.norms, self.radius = np.sqrt((self.centres**2).sum(axis=1)), tree["radius"]
        self.leaf = tree["first"] == tree["last"]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of integer rows; through doubles while every partial sum is exact."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return np.einsum("ik,jk->ij", a, b)
    exact = a.astype(object) @ b.T.astype(object)  # Python's integers
    if exact.size and max(abs(exact.max()), abs(exact.min())) >= 2**63:
        raise OverflowError("a score leaves 64 bits")
    return exact.astype(np.int64)


class Best:
    """The k best (score, id) per query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), LOWEST, np.int64)
        self.ids = np.full((n, k), np.iinfo(np.int64).max, np.int64)

    def add(self, rows: slice, score: np.ndarray, ids: np.ndarray) -> None:
        s = np.concatenate((self.score[rows], score), axis=1)
        i = np.concatenate((self.ids[rows], np.where(score == LOWEST, np.iinfo(np.int64).max, ids[None, :])), axis=1)
        pick = np.lexsort((i, np.where(s == LOWEST, np.iinfo(np.int64).max, -np.maximum(s, LOWEST + 1))), axis=1)[:, : self.k]
        self.score[rows], self.ids[rows] = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)


def search(q: Side, d: Side, best: Best, floor: np.ndarray) -> None:
    """Dual traversal. floor: per query (tree order) a kth score known from elsewhere."""
    qt, dt = q.tree, d.tree

    def worst(node: int) -> float:
        rows = slice(qt["begin"][node], qt["end"][node])
        return float(np.maximum(best.score[rows, -1], floor[rows]).min())

    def bounds(node: int, nodes: np.ndarray) -> np.ndarray:
        rq, rp = q.radius[node], d.radius[nodes]
        top = d.centres[nodes] @ q.centres[node] + rq * d.norms[nodes] + rp * q.norms[node] + rq * rp
        return top + ROUNDING * (d.norms[nodes] + rp) * (q.norms[node] + rq) + 1e-6

    todo = [(0, np.array([0]))]
    while todo:
        node, nodes = todo.pop()
        inner = ~d.leaf[nodes]
        if inner.any():
            nodes = np.concatenate([nodes[~inner], *(np.arange(dt["first"][x], dt["last"][x]) for x in nodes[inner])])
        top = bounds(node, nodes)
        keep = top >= worst(node)
        nodes, top = nodes[keep], top[keep]
        if not len(nodes):
            continue
        if not q.leaf[node]:
            todo += [(child, nodes) for child in range(qt["first"][node], qt["last"][node])]
        elif not d.leaf[nodes].all():
            todo.append((node, nodes))
        else:
            rows = slice(qt["begin"][node], qt["end"][node])
            for x, most in sorted(zip(nodes.tolist(), top.tolist()), key=lambda p: -p[1]):
                if most < worst(node):
                    break
                own = slice(dt["begin"][x], dt["end"][x])
                score = products(q.x[rows], d.x[own])
                score[q.ids[rows][:, None] == d.ids[own][None, :]] = LOWEST
                best.add(rows, score, d.ids[own])


NODE_FIELDS = ("order", "begin", "end", "centre", "first", "last")
PACKED = "ids binary, x binary, radius binary, nodes binary, sizes array<int>, c array<double>, r double, norm double"


def pack(keys: dict[str, int], ids: np.ndarray, x: np.ndarray, leaf: int) -> pa.Table:
    """One row for a bounded group: rows, tree, and the root's centre, radius and norm."""
    t = build(x.astype(np.float64), leaf)
    root = x[t["centre"][0]].astype(np.float64)
    nodes = np.concatenate([t[f].astype(np.int32) for f in NODE_FIELDS])
    row = {k: [v] for k, v in keys.items()} | {
        "ids": [ids.astype(np.int64).tobytes()], "x": [x.astype(np.int64).tobytes()], "radius": [t["radius"].tobytes()], "nodes": [nodes.tobytes()],
        "sizes": [[len(t[f]) for f in NODE_FIELDS]], "c": [root.tolist()], "r": [float(t["radius"][0])], "norm": [float(np.sqrt((root**2).sum()))],
    }
    return pa.table({k: pa.array(v, pa.int64()) if k in keys else pa.array(v, pa.list_(pa.int32())) if k == "sizes" else pa.array(v) for k, v in row.items()})


def unpack(row: dict, dim: int) -> Side:
    nodes, tree, at = np.frombuffer(row["nodes"], np.int32).astype(np.int64), {"radius": np.frombuffer(row["radius"], np.float64)}, 0
    for name, n in zip(NODE_FIELDS, row["sizes"]):
        tree[name] = nodes[at : at + n]
        at += n
    return Side(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["x"], np.int64).reshape(-1, dim), tree)


def top_k(data: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for every row of ``queries`` against ``data``.

    Both hold vec_id and v, an array of integers; a query's own id never answers it.
    """
    spark = data.sparkSession
    dim = max(dimension(data, "v"), dimension(queries, "v"))
    cells = max(1, min(MOST_CELLS, -(-data.count() // CELL_ROWS)))
    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_PER_CELL * cells).select("v").toArrow()
    shared = Net(matrix(sample.column("v"), dim, np.float64), cells)
    fan, net = shared.fan, spark.sparkContext.broadcast(shared)  # at most MOST_CELLS vectors and their upper pivots

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = net.value.cells(matrix(batch.column("v"), dim, np.float64))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell.astype(np.int64))], names=["vec_id", "v", "cell"])

    def packed(rows: DataFrame, name: str, most: int, leaf: int) -> DataFrame:
        rows = stored(rows.select("vec_id", "v").mapInArrow(assign, "vec_id long, v array<long>, cell long"))
        parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / most).alias("parts"))  # a row per cell
        rows = rows.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts"))

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            cell, part = (x.as_py() for x in key)
            return pack({"cell": cell, name: part * fan * fan + cell}, rows.column("vec_id").to_numpy(), matrix(rows.column("v"), dim, np.int64), leaf)

        return stored(rows.select("cell", "part", "vec_id", "v").groupBy("cell", "part").applyInArrow(run, f"cell long, {name} long, {PACKED}"))

    blocks, groups = packed(data, "block", BLOCK_ROWS, LEAF_ROWS), packed(queries, "grp", GROUP_ROWS, QUERY_LEAF)
    chunks = max(1, -(-groups.count() // CHUNK_GROUPS))
    found_schema = "grp long, query_id long, query_key long, vec_id long, score long"

    def evaluate(pairs: DataFrame) -> DataFrame:
        """pairs: grp, block, floor. A block is read once for some ``CHUNK_GROUPS`` of its query groups."""
        own = groups.select("grp", "ids", "x", "radius", "nodes", "sizes")
        asked = pairs.join(own, "grp").groupBy("block", F.pmod(F.xxhash64("grp"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("grp", "floor", "ids", "x", "radius", "nodes", "sizes")).alias("asked"))
        both = asked.join(blocks.select("block", "ids", "x", "radius", "nodes", "sizes"), "block")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    (row,) = batch.slice(i, 1).to_pylist()
                    d = unpack(row, dim)
                    for head in row["asked"]:
                        q = unpack(head, dim)
                        best = Best(len(q.ids), k)
                        search(q, d, best, np.full(len(q.ids), head["floor"], np.int64))
                        keep = best.score > LOWEST
                        at = np.repeat(np.arange(len(q.ids)), keep.sum(axis=1))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), head["grp"], np.int64)), pa.array(q.ids[at]), pa.array(q.tree["order"][at]), pa.array(best.ids[keep]), pa.array(best.score[keep])], names=["grp", "query_id", "query_key", "vec_id", "score"])

        return both.select("asked", "ids", "x", "radius", "nodes", "sizes").mapInArrow(run, found_schema)

    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    heads = groups.select("grp", "cell", F.col("c").alias("qc"), F.col("r").alias("qr"), F.col("norm").alias("qn"))
    tails = blocks.select("block", "cell", F.floor(F.col("cell") / fan).alias("top"), "c", "r", "norm")
    home = heads.join(tails, "cell").groupBy("grp").agg(F.max_by("block", F.struct(dot("qc", "c"), "block")).alias("block"))
    first = stored(evaluate(home.select("grp", "block", F.lit(LOWEST).alias("floor"))))
    kth = first.groupBy("grp", "query_id", "query_key").agg(F.count("*").alias("n"), F.min("score").alias("s"))
    kth = kth.groupBy("grp").agg(F.min(F.when(F.col("n") >= k, F.col("s")).otherwise(F.lit(LOWEST))).alias("kth"))
    kth = heads.select("grp").join(kth, "grp", "left").select("grp", F.coalesce("kth", F.lit(LOWEST)).alias("floor"))
    bound = dot("qc", "c") + F.col("qr") * F.col("norm") + F.col("r") * F.col("qn") + F.col("qr") * F.col("r")
    reach = bound + ROUNDING * (F.col("qn") + F.col("qr")) * (F.col("norm") + F.col("r")) + 1e-6 >= F.col("floor")

    def above(nodes: DataFrame, key: str, *more: str) -> DataFrame:
        """The node over all ``nodes`` of a key: the centre of one of them, with a radius over all."""
        lead = nodes.groupBy(key).agg(F.min_by(F.struct("c", "norm"), F.struct("norm", "c")).alias("lead"))
        far = F.sqrt(F.aggregate(F.zip_with("c", F.col("lead.c"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        joined = nodes.join(lead, key).groupBy(key, *more)
        return joined.agg(F.first("lead.c").alias("c"), F.first("lead.norm").alias("norm"), (F.max(F.col("r") + far) * (1 + 1e-9)).alias("r"))

    lower = stored(above(tails, "cell", "top"))
    upper = stored(above(lower, "top"))
    none = ("c", "norm", "r")
    near = heads.drop("cell").join(kth, "grp").withColumn("top", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(fan - 1).cast("long"))))
    near = near.join(F.broadcast(upper), "top").where(reach).drop(*none)  # fan rows
    near = near.join(F.broadcast(lower), "top").where(reach).drop("top", *none)  # MOST_CELLS rows
    pairs = near.join(tails.drop("top"), "cell").where(reach).join(home.withColumnRenamed("block", "home"), "grp", "left").where(~F.col("block").eqNullSafe(F.col("home")))
    found = first.unionByName(evaluate(pairs.select("grp", "block", "floor")))
    order = Window.partitionBy("grp", "query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(rows: DataFrame) -> DataFrame:
    """vec_id and v = floor(256 x) of the rows that take part, equal rows once."""

    def whole(x: Column) -> Column:
        scaled = x.cast("double") * SCALE
        return F.when(F.abs(scaled) < 2.0**63, F.floor(scaled)).otherwise(F.raise_error(F.lit("a component leaves 64 bits")).cast("long"))

    good = rows.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")))
    return good.select(F.col("vec_id").cast("long"), F.transform("embedding", whole).alias("v")).distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = stored(integer_vectors(table(spark, sf_dir, "embeddings")))
    return top_k(data, data.where(F.col("vec_id") % QUERY_EVERY == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

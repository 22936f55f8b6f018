"""Approximate nearest neighbours: an HNSW graph per shard, shard results merged.

Vectors are dealt to shards by a hash; a shard holds about ``SHARD_ROWS`` of them. Inside,
equal vectors are one node. Nodes get geometric levels. Each level is built by insertion:
the first ``BATCH`` nodes find their neighbours among themselves, then batch after batch
finds its candidates by a beam search in the graph so far and among the batch itself. A
node is joined to diverse near ones (a candidate is kept if it is nearer to the node than
to every kept one); a node that a new edge reaches chooses anew among its old and new
neighbours. The graph is stored as flat arrays: one neighbour matrix a level, -1 for none.
Nearness is the largest inner product. A shard's vectors are split into bands of lengths
within a factor of two, each with its graph; inside, one more component gives all the same
length, so that the product orders nodes as distance does, and one very long vector does
not blur the others. A band of ``EXACT_ROWS`` or fewer is scanned. Queries go down the levels
and through the bottom one with a beam, many in step. The beam is measured when the graph
is built: the smallest from ``BEAM`` on that finds ``RECALL`` of the nearest of some of its own
vectors; a band where even a quarter of its size does not (vectors without any structure)
is scanned. Scores are inner products in double precision on the original vectors. Every
row is indexed.

Defined results: vectors null, zero, or with null or non-finite components take no part;
missing trailing components count as 0; equal rows are one row; rows that share an id
never answer each other; ties go to the smaller id; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table
from .vectors import dimension, finite, matrix

K = 20
QUERY_EVERY = 20
SHARD_ROWS = 16_384
LINKS, CANDIDATES, BEAM = 16, 48, 160
BATCH, QUERY_ROWS = 1_024, 256
#: Vectors of a band that are scanned instead of searched; of those that measure its beam; what the beam must find.
EXACT_ROWS, SAMPLE, RECALL = 1_024, 64, 0.95
#: Nodes of the beam that are opened in one step.
OPENED = 4


def _dots(vectors: np.ndarray, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner product of each row of q with the vectors its row of ``rows`` names."""
    return np.einsum("ijk,ik->ij", vectors[rows], q)


def diverse(vectors: np.ndarray, q: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` diverse neighbours per row of q among its candidates (-1 for none), then the nearest passed over."""
    out = np.full((len(q), most), -1, np.int32)
    for at in range(0, len(q), 256):
        c = cand[at : at + 256]
        v = vectors[c]
        near = np.where(c >= 0, np.einsum("ijk,ik->ij", v, q[at : at + 256]), -np.inf)
        order = np.argsort(-near, axis=1, kind="stable")
        c, near, v = np.take_along_axis(c, order, 1), np.take_along_axis(near, order, 1), np.take_along_axis(v, order[:, :, None], 1)
        between = v @ v.transpose(0, 2, 1)
        kept = np.zeros(c.shape, bool)
        for j in range(c.shape[1]):
            rival = np.where(kept, between[:, j], -np.inf).max(axis=1)
            kept[:, j] = (near[:, j] > -np.inf) & (rival < near[:, j]) & (kept.sum(axis=1) < most)
        rank = np.argsort(np.where(kept, 0, 1) + np.where(near > -np.inf, 0, 2), axis=1, kind="stable")[:, :most]
        some = np.where(np.take_along_axis(near, rank, 1) > -np.inf, np.take_along_axis(c, rank, 1), -1)
        out[at : at + 256, : some.shape[1]] = some
    return out


def beam_search(vectors: np.ndarray, near: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes found for every row of q, best first (-1 for none), and their inner products."""
    rows, beam = np.arange(len(q)), max(1, min(beam, len(near)))
    seen = np.zeros((len(q), len(near) + 1), bool)
    seen[rows, start] = True
    seen[:, -1] = True  # the place of -1
    found, value, done = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), -np.inf, np.float32), np.ones((len(q), beam), bool)
    found[:, 0], value[:, 0], done[:, 0] = start, np.einsum("ij,ij->i", vectors[start], q), False
    moving, step = rows, min(OPENED, beam)
    while len(moving):
        todo = np.where(done[moving], -np.inf, value[moving])
        j = np.argpartition(-todo, step - 1, axis=1)[:, :step]
        open_ = np.take_along_axis(todo, j, 1) > -np.inf
        some = open_.any(axis=1)
        moving, j, open_ = moving[some], j[some], open_[some]
        if not len(moving):
            break
        done[moving[:, None], j] = True
        cand = np.where(open_[:, :, None], near[np.take_along_axis(found[moving], j, 1)], -1).reshape(len(moving), -1)
        cand.sort(axis=1)
        new = ~seen[moving[:, None], cand]
        new[:, 1:] &= cand[:, 1:] != cand[:, :-1]
        seen[moving[:, None], cand] = True
        s = np.where(new, _dots(vectors, cand, q[moving]), -np.inf).astype(np.float32)
        all_s = np.concatenate((value[moving], s), axis=1)
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        value[moving] = np.take_along_axis(all_s, top, 1)
        found[moving] = np.take_along_axis(np.concatenate((found[moving], cand), axis=1), top, 1)
        done[moving] = np.take_along_axis(np.concatenate((done[moving], ~new), axis=1), top, 1)
    order = np.argsort(-value, axis=1, kind="stable")
    value = np.take_along_axis(value, order, 1)
    return np.where(value > -np.inf, np.take_along_axis(found, order, 1), -1), value


def level_graph(vectors: np.ndarray, room: int) -> np.ndarray:
    """Neighbour matrix of a level whose nodes are the rows of ``vectors``, inserted in order."""
    n = len(vectors)
    near = np.full((n, room), -1, np.int32)
    hubs = vectors[: min(n, 256)]
    for at in range(0, n, BATCH):
        q = vectors[at : at + BATCH]
        own = q @ q.T
        np.fill_diagonal(own, -np.inf)
        m = min(CANDIDATES, len(q))
        cand = np.argpartition(-own, m - 1, axis=1)[:, :m]
        cand = np.where(np.take_along_axis(own, cand, 1) > -np.inf, cand + at, -1)
        if at:
            size = max(32, (1 << 25) // at)  # rows at once: what each has seen is a row of flags
            older = [beam_search(vectors, near[:at], q[i : i + size], (q[i : i + size] @ hubs.T).argmax(axis=1), CANDIDATES)[0] for i in range(0, len(q), size)]
            cand = np.concatenate((np.concatenate(older), cand[:, : CANDIDATES // 2]), axis=1)
        near[at : at + len(q), :LINKS] = diverse(vectors, q, cand, LINKS)
        # Reverse edges: nodes that new edges reach choose among old and new neighbours.
        a, j = np.nonzero(near[at : at + len(q), :LINKS] >= 0)
        b, a = near[at + a, j].astype(np.int64), a + at
        order = np.lexsort((-np.einsum("ij,ij->i", vectors[a], vectors[b]), b))
        a, b = a[order], b[order]
        place = np.arange(len(b)) - np.searchsorted(b, b)
        a, b, place = a[place < room], b[place < room], place[place < room]
        reached = np.unique(b)
        fresh = np.full((len(reached), room), -1, np.int64)
        fresh[np.searchsorted(reached, b), place] = a
        both = np.sort(np.concatenate((near[reached].astype(np.int64), fresh), axis=1), axis=1)
        both[:, 1:] = np.where(both[:, 1:] == both[:, :-1], -1, both[:, 1:])
        near[reached] = diverse(vectors, vectors[reached], both, room)
    return near


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths of rows, without overflow on the way (infinite where they are beyond doubles)."""
    most = np.abs(x).max(axis=1, initial=0)
    safe = np.where(most > 0, most, 1)
    return safe * np.sqrt(((x / safe[:, None]) ** 2).sum(axis=1)) * (most > 0)


class Band:
    """Vectors whose lengths are within a factor of two: a graph over them, or none if they are few.

    They are scaled by the longest, and one more component gives all the same length; so
    single precision tells them apart however long vectors of other bands are.
    """

    def __init__(self, x: np.ndarray, longest: float, levels: list[tuple[np.ndarray, np.ndarray]], beam: int):
        self.x, self.longest, self.levels, self.beam = x, longest, levels, beam
        if levels:
            unit = x / longest
            extra = np.sqrt(np.maximum(1 - (unit**2).sum(axis=1), 0))
            self.wide = np.concatenate((unit, extra[:, None]), axis=1).astype(np.float32)

    @classmethod
    def build(cls, x: np.ndarray, longest: float, draw: np.random.Generator, least_beam: int, k: int) -> Band:
        if len(x) <= EXACT_ROWS:
            return cls(x, longest, [], 0)
        level = np.floor(-np.log(1 - draw.random(len(x))) / math.log(LINKS)).astype(int)
        band, turn = cls(x, longest, [(np.zeros(0, np.int32), np.zeros((0, 1), np.int32))], 0), draw.permutation(len(x))
        band.levels = []
        for at in range(level.max() + 1):
            nodes = turn[level[turn] >= at]
            near = level_graph(band.wide[nodes], 2 * LINKS if at == 0 else LINKS)
            near = np.where(near >= 0, nodes[near], -1)
            back = np.argsort(nodes)  # bottom level: rows in order of nodes
            band.levels.append((nodes[back].astype(np.int32), near[back].astype(np.int32)))
        band.beam = band.measured(draw, least_beam, k)
        return band

    def measured(self, draw: np.random.Generator, beam: int, k: int) -> int:
        """The smallest beam, doubled from ``beam``, that finds ``RECALL`` of the nearest of some of the band's own vectors; 0 for a scan if none of less than a quarter of the band does."""
        some = draw.permutation(len(self.x))[:SAMPLE]
        q = self.x[some] / self.longest
        fast = np.concatenate((q, np.zeros((len(q), 1))), axis=1).astype(np.float32)
        exact = np.argpartition(-(fast @ self.wide.T), k, axis=1)[:, : k + 1]
        while beam < len(self.x) // 4:
            found = self.walk(fast, beam)[:, : k + 1]
            if np.mean([len(np.intersect1d(a, b)) / (k + 1) for a, b in zip(found, exact)]) >= RECALL:
                return beam
            beam *= 2
        return 0

    def walk(self, fast: np.ndarray, beam: int) -> np.ndarray:
        """Nodes found for every row of ``fast``, best first, -1 for none."""
        at = np.full(len(fast), self.levels[-1][0][0], np.int64)
        sim = np.einsum("ij,ij->i", self.wide[at], fast)
        for nodes, near in reversed(self.levels[1:]):
            where = np.full(len(self.x), -1, np.int64)
            where[nodes] = np.arange(len(nodes))
            moving = np.arange(len(fast))
            while len(moving):
                cand = near[where[at[moving]]]
                s = np.where(cand >= 0, _dots(self.wide, cand, fast[moving]), -np.inf)
                j = s.argmax(axis=1)
                top = s[np.arange(len(moving)), j]
                better = top > sim[moving]
                moving, j, cand, top = moving[better], j[better], cand[better], top[better]
                at[moving], sim[moving] = cand[np.arange(len(moving)), j], top
        size = max(16, (1 << 25) // len(self.x))
        return np.concatenate([beam_search(self.wide, self.levels[0][1], fast[i : i + size], at[i : i + size], beam)[0] for i in range(0, len(fast), size)])

    def search(self, unit: np.ndarray, most: int) -> np.ndarray:
        """``most`` nodes for every row of unit vectors (fewer are filled with -1): those found, or by a scan of all the nearest."""
        if not self.beam:
            near = unit @ (self.x / self.longest).T
            m = min(most, len(self.x))
            out = np.argpartition(-near, m - 1, axis=1)[:, :m]
            return np.pad(out, ((0, 0), (0, most - m)), constant_values=-1)
        found = self.walk(np.concatenate((unit, np.zeros((len(unit), 1))), axis=1).astype(np.float32), max(self.beam, most))[:, :most]
        found = np.pad(found, ((0, 0), (0, most - found.shape[1])), constant_values=-1)
        short = np.flatnonzero((found < 0).any(axis=1))
        if len(short):  # a graph that falls apart
            near = unit[short] @ (self.x / self.longest).T
            m = min(most, len(self.x))
            found[short, :m] = np.argpartition(-near, m - 1, axis=1)[:, :m]
        return found


class Graph:
    """Unique vectors, the ids of each, and bands of them by length, the longest first."""

    def __init__(self, x, first, ids, bands: list[tuple[np.ndarray, Band]]):
        self.x, self.first, self.ids, self.bands = x, first, ids, bands

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, seed: int, beam: int = BEAM, k: int = K) -> Graph:
        order = np.lexsort((ids, *x.T[::-1]))
        x, ids = x[order], ids[order]
        new = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]).any(axis=1))))
        first, x = np.append(new, len(ids)), x[new]
        draw, length = np.random.default_rng(seed), _norms(x)
        size = np.frexp(np.where(np.isfinite(length), length, np.finfo(float).max))[1]
        bands = []
        for e in np.unique(size)[::-1]:
            rows = np.flatnonzero(size == e)
            bands.append((rows.astype(np.int32), Band.build(x[rows], min(float(length[rows].max()), np.finfo(float).max), draw, beam, k)))
        return cls(x, first, ids, bands)

    def flat(self) -> dict[str, list]:
        return {
            "x": [self.x.tobytes()], "first": [self.first.astype(np.int64).tobytes()], "ids": [self.ids.astype(np.int64).tobytes()],
            "bands": [[{"rows": r.tobytes(), "longest": b.longest, "beam": b.beam, "nodes": [n.tobytes() for n, _ in b.levels], "near": [m.tobytes() for _, m in b.levels]} for r, b in self.bands]],
        }

    @classmethod
    def of(cls, row: dict, dim: int) -> Graph:
        x, bands = np.frombuffer(row["x"]).reshape(-1, dim), []
        for b in row["bands"]:
            nodes, rows = [np.frombuffer(n, np.int32) for n in b["nodes"]], np.frombuffer(b["rows"], np.int32)
            bands.append((rows, Band(x[rows], b["longest"], [(n, np.frombuffer(m, np.int32).reshape(len(n), -1)) for n, m in zip(nodes, b["near"])], b["beam"])))
        return cls(x, np.frombuffer(row["first"], np.int64), np.frombuffer(row["ids"], np.int64), bands)

    def search(self, q: np.ndarray, most: int) -> np.ndarray:
        """The best ``most`` nodes found for every row of q, -1 for none.

        A band is passed over for queries whose worst node so far no vector of its length can beat.
        """
        length = _norms(q)
        unit = q / np.where(length > 0, length, 1)[:, None]
        nodes, score = np.full((len(q), most), -1, np.int64), np.full((len(q), most), -np.inf)
        for rows, band in self.bands:
            on = np.flatnonzero(score[:, -1] <= band.longest * (1 + 1e-9))
            if not len(on):
                continue
            local = band.search(unit[on], most)
            found = np.where(local >= 0, rows[local], -1)
            s = np.where(local >= 0, np.einsum("ijk,ik->ij", self.x[found], unit[on]), -np.inf)
            s, found = np.concatenate((score[on], s), axis=1), np.concatenate((nodes[on], found), axis=1)
            top = np.argsort(-s, axis=1, kind="stable")[:, :most]
            score[on], nodes[on] = np.take_along_axis(s, top, 1), np.take_along_axis(found, top, 1)
        return nodes


BANDS = "array<struct<rows:binary,longest:double,beam:int,nodes:array<binary>,near:array<binary>>>"
FLAT = f"x binary, first binary, ids binary, bands {BANDS}"


def index(rows: DataFrame, dim: int, shard_rows: int = SHARD_ROWS, beam: int = BEAM, k: int = K) -> tuple[DataFrame, int]:
    """The stored index of rows (vec_id, v): a row per shard; and the number of shards."""
    shards = max(1, -(-rows.count() // shard_rows))

    def build(key: tuple, part: pa.Table) -> pa.Table:
        g = Graph.build(part.column("vec_id").to_numpy(), matrix(part.column("v"), dim, np.float64), key[0].as_py(), beam, k)
        kinds = {"bands": pa.list_(pa.struct([("rows", pa.binary()), ("longest", pa.float64()), ("beam", pa.int32()), ("nodes", pa.list_(pa.binary())), ("near", pa.list_(pa.binary()))]))}
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32())} | {k: pa.array(v, kinds.get(k)) for k, v in g.flat().items()})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))
    return stored(dealt.groupBy("shard").applyInArrow(build, f"shard int, {FLAT}")), shards


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, beam: int = BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score. Both frames hold vec_id and v (array of double)."""
    dim = max(dimension(rows, "v"), 1)
    graphs, shards = index(rows, dim, shard_rows, beam, k)
    blocks = max(1, -(-queries.count() // QUERY_ROWS))

    def pack(key: tuple, part: pa.Table) -> pa.Table:
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "q_ids": [part.column("vec_id").to_numpy().tobytes()], "q": [matrix(part.column("v"), dim, np.float64).tobytes()]})

    asked = stored(
        queries.withColumn("part", F.pmod(F.xxhash64("v", "vec_id"), F.lit(blocks)).cast("int"))
        .groupBy("part").applyInArrow(pack, "part int, q_ids binary, q binary")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                graph, q_ids, q = Graph.of(row, dim), np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q"]).reshape(-1, dim)
                out = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
                for i, nodes in enumerate(graph.search(q, k + 1)):
                    nodes = nodes[nodes >= 0]
                    score = (graph.x[nodes] * q[i]).sum(axis=1)
                    sizes = np.minimum(graph.first[nodes + 1] - graph.first[nodes], k + 1)  # of equal vectors the smallest ids
                    ids = graph.ids[np.repeat(graph.first[nodes], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
                    score = np.repeat(score, sizes)
                    ids, score = ids[ids != q_ids[i]], score[ids != q_ids[i]]
                    top = np.lexsort((ids, -score))[:k]
                    out.append((np.full(len(top), q_ids[i]), np.full(len(top), i), ids[top], score[top]))
                a, b, c, d = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), row["part"], np.int32)), pa.array(a), pa.array(b), pa.array(c), pa.array(d)], names=["part", "query_id", "row", "vec_id", "score"])

    pairs = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).repartition("shard")
    found = pairs.join(graphs.hint("shuffle_merge"), "shard").select("part", "q_ids", "q", "x", "first", "ids", "bands")
    found = found.mapInArrow(run, "part int, query_id long, row long, vec_id long, score double")
    order = Window.partitionBy("part", "query_id", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def vectors(rows: DataFrame) -> DataFrame:
    """vec_id and v of the rows that take part, equal rows once."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = rows.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    return good.select(F.col("vec_id").cast("long"), v.alias("v")).distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(vectors(table(spark, sf_dir, "embeddings")))
    return nearest(rows, rows.where(F.col("vec_id") % QUERY_EVERY == 0))

"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its components.

A text is the set of its distinct five-word shingles (64-bit hashes); equal sets are one
node. Shingles are ordered by hash. Of a node with n shingles a similar one shares at
least t = ceil(0.75 n), so the two share at least l shingles within the first
``n - t + l`` of each, for any l: a longer prefix asks for more matches. Every node sends
the prefix of its longest l, ``REACH`` of its size.

1. Shingles that only one node's prefix holds match nothing. A node drops out as soon as,
   for some l, fewer than l of its first ``n - t + l`` shingles are left.
2. A shingle that more than ``HEAVY`` remaining nodes hold is costly. A node takes the l
   with the smallest estimated candidates per match needed, where the heavy shingles in
   its prefix (fewer than l) are not looked up and the light ones must match
   ``l - heavy`` times.
3. Stars first: each node is verified against the central node (whose shingles are the
   most frequent) that most of its shingles lead to, so that groups of near copies become
   components without their pairs. Rounds with other hubs repeat while they join nodes;
   afterwards only pairs in different components are generated and verified.
4. These come from light shingles as in 2. Nodes for which every l has too many heavy
   shingles among hashes in order take their prefix over the whole set instead, rarest
   shingle first: a node whose shared shingles are fewer than t drops out, one with h heavy
   ones must share t - h light ones with a partner, so that it looks up all but t - h of
   its light ones, lengthened by l for l matches, whichever l costs least. Only nodes whose
   heavy shingles could suffice (h >= t) meet through heavy ones: shingles of the same
   holders become one weighted atom, and prefixes over atoms are lengthened, match by
   match, wherever the pairs of a prefix outnumber the longer prefixes (``rich_pairs``).

So no pair of different components that could link stays unverified, and no group is
listed pair by pair once it hangs together. Verification counts the exact intersection.

Defined results: a text with fewer than five words is one shingle; null and empty texts
have none and link with nothing; equal rows and rows that share an id are nodes by their
text; component_id is the smallest doc_id of the component; other columns, whatever
their names, are carried through ``deduplicate``.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, frugal, row_hash, scratch, stored, table
from .graph import components
from .words import BASE, hashes, mix, runs, spans, text_bytes

log = logging.getLogger(__name__)
SHINGLE = 5
PERCENT = 75
REACH = 0.08  # longest l as a share of the set; partners are at least 0.75 as large
HEAVY = 32
TEXT_BYTES = 2 << 20
#: Nodes whose keys and components (at most 40 bytes each) may be broadcast; more are joined by shuffle.
BROADCAST_NODES = 500_000
ROUNDS = 4
SHORT = 256  # atoms of a node that travel with each of its states, at most
BAND = 1.06  # rich nodes are met by bands of sizes, each so many times as wide as the one before
PAIRS = 8  # pairs a state up to which no more matches are asked for
DEEP = 6  # matches asked for at most; what is left meets by how it differs
WIDE = 8  # states one atom longer, a state, up to which groups are asked for one more match


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every distinct shingle, by text and hash."""
    data, offsets = text_bytes(column)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    starts, ends = spans(data, offsets)
    h = hashes(data, starts, ends)
    text = np.searchsorted(offsets, starts, "right") - 1
    n = len(h) - SHINGLE + 1
    run = runs(h, SHINGLE)
    whole = text[: max(n, 0)] == text[SHINGLE - 1 :] if n > 0 else np.zeros(0, bool)
    text_of, value = text[: max(n, 0)][whole], run[whole]
    count = np.bincount(text, minlength=len(column))
    few = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(few):
        first = np.cumsum(count) - count
        short = np.full(len(few), BASE, np.uint64)
        for j in range(SHINGLE - 1):
            more = count[few] > j
            short[more] = mix(short[more] * BASE + h[first[few[more]] + j] + np.uint64(j))
        text_of, value = np.concatenate((text_of, few)), np.concatenate((value, short))
        order = np.argsort(text_of, kind="stable")
        text_of, value = text_of[order], value[order]
    cut = np.searchsorted(text_of, np.arange(len(column) + 1)).tolist()
    for a, b in zip(cut[:-1], cut[1:]):
        value[a:b].sort()
    new = np.concatenate(([True], (text_of[1:] != text_of[:-1]) | (value[1:] != value[:-1]))) if len(value) else np.zeros(0, bool)
    return text_of[new], value[new]


class Sets:
    """The shingle sets of a batch: size and set hash per text, rank per shingle."""

    def __init__(self, column: pa.Array):
        self.text, self.value = shingles(column)
        self.n = np.bincount(self.text, minlength=len(column)).astype(np.int64)
        self.first = np.cumsum(self.n) - self.n
        held = np.flatnonzero(self.n)
        self.s = np.zeros(len(column), np.uint64)
        if len(held):
            self.s[held] = mix(np.add.reduceat(mix(self.value + BASE), self.first[held]) + self.n[held].astype(np.uint64))
        self.rank = np.arange(len(self.value)) - self.first[self.text]


def spare(n: np.ndarray) -> np.ndarray:
    """n - ceil(0.75 n): shingles that a similar node may lack."""
    return n - -(-n * PERCENT // 100)


def longest(n: np.ndarray) -> np.ndarray:
    return np.maximum(1, np.ceil(REACH * n)).astype(np.int64)


def _map(docs: DataFrame, f, schema: str, *columns: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", TEXT_BYTES):
                yield f(part)

    return docs.select(*columns, "text").mapInArrow(frugal(run), schema)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, t (a hash of the text), n (set size), s (node) of every row; s is null for an empty set."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = Sets(part.column("text"))
        empty = sets.n == 0
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t"), pa.array(sets.n), pa.array(sets.s.view(np.int64), mask=empty)], names=["doc_id", "t", "n", "s"])

    return stored(_map(_identified(docs), run, "doc_id long, t long, n long, s long", "doc_id", "t"))


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), "text")


def prefixes(docs: DataFrame) -> DataFrame:
    """tok, s, nr: the first shingles of each node, with n * 2**32 + rank; a node once per chunk of text."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = Sets(part.column("text"))
        _, one = np.unique(sets.s, return_index=True)
        chosen = np.zeros(len(sets.s), bool)
        chosen[one] = True
        n = sets.n[sets.text]
        keep = chosen[sets.text] & (sets.rank < spare(n) + longest(n))
        return pa.RecordBatch.from_arrays([_signed(sets.value[keep]), _signed(sets.s[sets.text[keep]]), pa.array((n[keep] << 32) + sets.rank[keep])], names=["tok", "s", "nr"])

    return _map(docs, run, "tok long, s long, nr long")


def _lists(rows: DataFrame) -> DataFrame:
    """s, n and held (rank, tok) of every node."""
    return rows.groupBy("s").agg(
        F.shiftright(F.first("nr"), 32).alias("n"), F.array_sort(F.collect_set(F.struct(F.expr("nr & 4294967295L").cast("int").alias("r"), "tok"))).alias("held")
    )


def _enough(lists: DataFrame) -> DataFrame:
    """Nodes with at least l held shingles among their first n - t + l, for every l up to the longest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, held = batch.column("n").to_numpy(), batch.column("held")
            ranks, sizes = held.flatten().field(0).to_numpy(), held.value_lengths().to_numpy()
            cut = np.concatenate(([0], np.cumsum(sizes)))
            p, top = spare(n), longest(n)
            good = np.zeros(len(n), bool)
            for i in range(len(n)):
                steps = np.arange(1, top[i] + 1)
                good[i] = (np.searchsorted(ranks[cut[i] : cut[i + 1]], p[i] + steps) >= steps).all()
            yield batch.filter(pa.array(good))

    return lists.mapInArrow(frugal(run), "s long, n long, held array<struct<r:int,tok:long>>")


def remaining(docs: DataFrame) -> DataFrame:
    """tok, s, n, r of the nodes that step 1 leaves, df (remaining nodes with tok) above 1."""
    rows = prefixes(docs)
    # Equal sets in different chunks come several times: min and max tell two nodes from one.
    twice = stored(rows.groupBy("tok").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a <> b").select("tok"))
    alive = stored(_enough(_lists(rows.join(twice, "tok"))))
    for _ in range(2):  # counted again among those left
        rows = alive.select("s", "n", F.inline("held"))
        df = rows.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
        rows = rows.join(df, "tok")
        alive = stored(_enough(rows.groupBy("s").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("r", "tok"))).alias("held"))))
    rows = alive.select("s", "n", F.inline("held"))
    df = rows.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    return stored(rows.join(df, "tok"))


def demands(rows: DataFrame) -> DataFrame:
    """s, l, need: per node the chosen l and light matches needed; l = 0 if heavy shingles leave none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, held = batch.column("n").to_numpy(), batch.column("held")
            ranks, df = (held.flatten().field(f).to_numpy() for f in range(2))
            cut = np.concatenate(([0], np.cumsum(held.value_lengths().to_numpy())))
            chosen, need = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for i in range(len(n)):
                r, d = ranks[cut[i] : cut[i + 1]], df[cut[i] : cut[i + 1]]
                # A partner is at least 0.75 as large: its prefix reaches this far for certain.
                steps = np.arange(1, max(1, int(REACH * n[i] * PERCENT / 100)) + 1)
                end = np.searchsorted(r, spare(n[i]) + steps)
                heavy = np.concatenate(([0], np.cumsum(d > HEAVY)))[end]
                cost = np.concatenate(([0], np.cumsum(np.where(d > HEAVY, 0, d - 1))))[end] / np.maximum(steps - heavy, 1)
                cost = np.where(heavy < steps, cost, np.inf)
                best = int(cost.argmin())
                if np.isfinite(cost[best]):
                    chosen[i], need[i] = steps[best], steps[best] - heavy[best]
            yield pa.RecordBatch.from_arrays([batch.column("s"), pa.array(chosen), pa.array(need)], names=["s", "l", "need"])

    lists = rows.groupBy("s").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("r", "df"))).alias("held"))
    return lists.mapInArrow(frugal(run), "s long, l long, need long")


def texts(docs: DataFrame, node: DataFrame, rows: DataFrame) -> DataFrame:
    """s and the compressed text of every remaining node, from one document that has it."""
    keys = node.join(rows.select("s").distinct(), "s").groupBy("s").agg(F.min(F.struct("doc_id", "t")).alias("k"))
    keys = stored(keys.select("s", F.col("k.doc_id").alias("_d"), F.col("k.t").alias("_t")))
    few = keys.count() <= BROADCAST_NODES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("s"), pa.array([z.compress(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())], names=["s", "z"])

    found = _identified(docs).join(F.broadcast(keys) if few else keys, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t")))
    return stored(found.select("s", "text").mapInArrow(frugal(run), "s long, z binary").groupBy("s").agg(F.min("z").alias("z")))


def verify(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets have a Jaccard similarity of 0.75 or more."""
    both = pairs.join(full.select(F.col("s").alias("u"), F.col("z").alias("zu")), "u").join(full.select(F.col("s").alias("v"), F.col("z").alias("zv")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, held = zstandard.ZstdDecompressor(), {}

        def unzip(s: int, data: bytes) -> np.ndarray:
            if (found := held.get(s)) is None:
                if len(held) > 2_000:
                    held.clear()
                found = held[s] = shingles(pa.array([z.decompress(data).decode()]))[1]
            return found

        for batch in batches:
            good = []
            for u, v, zu, zv in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "zu", "zv"))):
                a, b = unzip(u, zu), unzip(v, zv)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * shared >= PERCENT * (len(a) + len(b) - shared))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return both.select("u", "v", "zu", "zv").mapInArrow(frugal(run), "u long, v long")


def _comparable(a: str, b: str):
    """Set sizes that allow the similarity."""
    return (F.col(a) * 100 >= F.col(b) * PERCENT) & (F.col(b) * 100 >= F.col(a) * PERCENT)


def _token_rows(full: DataFrame) -> DataFrame:
    """s, tok: the whole sets of compressed texts, about ``TEXT_BYTES`` of text at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()

        def rows(keys: list[int], texts: list[str]) -> pa.RecordBatch:
            row, tok = shingles(pa.array(texts, pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()).take(pa.array(row)), _signed(tok)], names=["s", "tok"])

        for batch in batches:
            keys, texts, size = [], [], 0
            for s, packed in zip(batch.column("s").to_pylist(), batch.column("z").to_pylist()):
                keys.append(s)
                texts.append(z.decompress(packed).decode())
                size += len(texts[-1])
                if size >= TEXT_BYTES:
                    yield rows(keys, texts)
                    keys, texts, size = [], [], 0
            yield rows(keys, texts)

    return full.mapInArrow(frugal(run), "s long, tok long")


def whole_demands(rows: DataFrame) -> DataFrame:
    """Per node of rows (s, n, c, tok, df) its shared shingles, rarest first, and its prefix of them.

    toks: all of them; light: how many have ``HEAVY`` holders at most; width and need: the
    prefix and the matches in it that a partner must reach. Heavy shingles cannot supply
    the whole overlap unless they are 0.75 of the set, so that ``ceil(0.75 n) - heavy``
    light ones are shared and the prefix may be all but so many of them, plus ``need``.
    need = 0: a rich node, whose heavy shingles could suffice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, held = batch.column("n").to_numpy(), batch.column("held")
            df, tok = (held.flatten().field(f) for f in range(2))
            d = df.to_numpy()
            cut = np.concatenate(([0], np.cumsum(held.value_lengths().to_numpy())))
            least = -(-n * PERCENT // 100)
            out = np.zeros((3, len(n)), np.int64)
            for i in range(len(n)):
                mine = d[cut[i] : cut[i + 1]]
                light = int(np.searchsorted(mine, HEAVY, "right"))
                k = int(least[i]) - (len(mine) - light)
                if k < 1:
                    out[:, i] = light, 0, 0
                    continue
                if k > light:  # too few shared shingles for any partner
                    out[:, i] = light, 0, 1
                    continue
                steps = np.arange(1, k + 1)
                end = light - k + steps
                cost = np.concatenate(([0], np.cumsum(mine[:light] - 1)))[end] / steps
                best = int(cost.argmin())
                out[:, i] = light, end[best], steps[best]
            toks = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), tok)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("s", "n", "c")), toks, *map(pa.array, out)], names=["s", "n", "c", "toks", "light", "width", "need"])

    lists = rows.groupBy("s").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("held"))
    return lists.mapInArrow(frugal(run), "s long, n long, c long, toks array<long>, light long, width long, need long")


def atoms(rows: DataFrame, rich: DataFrame) -> DataFrame:
    """Rich nodes as sets of atoms: s, n, c, ids, cum (weights summed, from 0) and left; stored.

    Shingles of the same holders are one atom, whose weight is their number: two nodes
    share it whole or not at all. What one component alone holds is left out. Atoms are
    in one order for all nodes, the weightiest first; left is the weight that a node may
    lack in common with a similar one.
    """
    held = rows.join(rich, "s")
    same = F.xxhash64(F.bit_xor(F.xxhash64("s")), F.bit_xor(F.xxhash64("s", F.lit(1))), F.count("*"))
    tok = held.groupBy("tok").agg(same.alias("id"), F.count("*").alias("df"), F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("tok", "id", "df")
    parts = held.join(tok, "tok").groupBy("s", "id").agg(F.count("*").alias("w"), F.first("df").alias("df"), F.first("n").alias("n"), F.first("c").alias("c"))
    lists = parts.groupBy("s").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), "df", "id"))).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("held")
            cut = np.concatenate(([0], np.cumsum(held.value_lengths().to_numpy())))
            weight = -held.flatten().field(0).to_numpy()
            cum = [np.concatenate(([0], np.cumsum(weight[a:b]))) for a, b in zip(cut[:-1], cut[1:])]
            left = np.array([x[-1] for x in cum], np.int64) + (-batch.column("n").to_numpy() * PERCENT // 100)
            ids = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), held.flatten().field(2))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("s", "n", "c")), ids, pa.array(cum, pa.list_(pa.int64())), pa.array(left)], names=["s", "n", "c", "ids", "cum", "left"]).filter(pa.array(left >= 0))

    return stored(lists.mapInArrow(frugal(run), "s long, n long, c long, ids array<long>, cum array<long>, left long"))


def _apart(state: DataFrame, node: DataFrame) -> DataFrame:
    """s, v: pairs of states (key, s, side, at, room) that are many a key, by how they differ from one of them.

    Beside the key's hub (the node with the most weight left) a node lacks D and adds E, of
    the atoms after the state. Two nodes have |hub| - |D1| - |D2| + |D1 & D2| + |E1 & E2| of
    these in common, so that a similar pair shares f1 + f2 of what its nodes differ by (f
    in 14ths, to stay whole). Where f1 + f2 <= 0 the two are similar, and both are similar
    to the node of the smallest f: they meet in a star and are of its component from there
    on. All others share an atom within prefixes of E and D, and one of the two is of
    another component than the star.
    """
    if state.isEmpty():
        return state.select("s", F.col("s").alias("v"))
    member = state.join(node.select("s", "n", "c", "ids", "cum"), "s")
    after = lambda c, at: F.slice(c, F.col(at) + 1, F.size(c)).alias(c)
    upto = lambda i: F.element_at("cum", i)
    hub = member.groupBy("key").agg(F.max(F.struct((upto(-1) - upto(F.col("at") + 1)).alias("rest"), "s", "at")).alias("h"))
    hub = hub.select("key", F.col("h.s").alias("s"), F.col("h.at").alias("hat")).join(node.select("s", F.col("ids").alias("hids"), F.col("cum").alias("hcum")), "s")
    hub = stored(hub.select("key", after("hids", "hat"), after("hcum", "hat")))
    common = upto(F.col("at") + 1) - upto(-1) + F.col("room")  # what the states have in common so far
    member = member.select("key", "s", "n", "c", "side", common.alias("common"), after("ids", "at"), after("cum", "at"))
    kept = ["key", "s", "n", "c", "side"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, common = (batch.column(x).to_numpy() for x in ("n", "common"))
            arrays = [(batch.column(x).flatten().to_numpy(), np.concatenate(([0], np.cumsum(batch.column(x).value_lengths().to_numpy())))) for x in ("ids", "cum", "hids", "hcum")]
            f, g, toks, before = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), [], []
            for i in range(len(n)):
                ids, cum, hids, hcum = (x[cut[i] : cut[i + 1]] for x, cut in arrays)
                added, lacked = ~np.isin(ids, hids), ~np.isin(hids, ids)
                more, less = np.diff(cum)[added], np.diff(hcum)[lacked]
                f[i] = 6 * n[i] - 7 * common[i] + 14 * less.sum() - 7 * (hcum[-1] - hcum[0])
                # One order for all nodes of a key: what is added, then what is lacked.
                orders = [np.argsort(x) for x in (ids[added], hids[lacked])]
                weight = np.concatenate((more[orders[0]], less[orders[1]]))
                toks.append(np.concatenate((ids[added][orders[0]], hids[lacked][orders[1]])))
                before.append(np.cumsum(weight) - weight)
                g[i] = weight.sum()
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (toks, before)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(f), pa.array(g), *lists], names=[*kept, "f", "g", "toks", "before"])

    own = stored(member.join(_small(hub), "key").mapInArrow(frugal(run), "key long, s long, n long, c long, side int, f long, g long, toks array<long>, before array<long>"))
    able = 14 * F.col("g") - F.col("f")  # a partner's f is no larger
    star = own.groupBy("key").agg(F.min(F.struct("f", "s", "c")).alias("z"), F.max(able).alias("most"))
    star = stored(star.select("key", F.col("z.f").alias("zf"), F.col("z.s").alias("z"), F.col("z.c").alias("zc"), "most"))
    known, near = own.join(_small(star), "key"), F.col("f") + F.col("zf") <= 0
    met = known.where(near & (F.col("c") != F.col("zc"))).select("s", F.col("z").alias("v"))
    known = known.withColumn("c", F.when(near, F.col("zc")).otherwise(F.col("c")))
    other = stored(known.where((F.col("c") != F.col("zc")) & (F.col("f") <= F.col("most")) & (able >= F.col("zf"))))
    least = stored(other.groupBy("key").agg(F.min("f").alias("least")))

    def prefix(rows: DataFrame, low: str) -> DataFrame:
        """A row per atom of which, with those after it, a partner of f ``low`` shares enough."""
        rows = rows.withColumn("x", F.explode(F.arrays_zip("toks", "before"))).withColumn("room", 14 * (F.col("g") - F.col("x.before")))
        return rows.where(F.col("room") >= F.col("f") + F.col(low)).select("key", F.col("x.toks").alias("tok"), "s", "n", "c", "side", "f", "room", "zc")

    every = prefix(known.join(_small(least), "key").where(able >= F.col("least")), "least").drop("zc")
    every = every.withColumnsRenamed({"s": "v", "n": "m", "c": "d", "side": "side2", "f": "f2", "room": "room2"})
    once = (F.col("c") != F.col("d")) & ((F.col("d") == F.col("zc")) | (F.col("s") < F.col("v"))) & ((F.col("side") == 0) | (F.col("side") != F.col("side2")))
    enough = _comparable("n", "m") & (F.least("room", "room2") >= F.col("f") + F.col("f2"))
    return met.unionByName(prefix(other, "zf").join(every, ["key", "tok"]).where(once & enough).select("s", "v")).distinct()


def rich_pairs(node: DataFrame) -> DataFrame:
    """s, v: pairs in different components of the frame ``atoms``, by prefixes lengthened where they cost.

    Two nodes of n and m shingles must share (n + m) * 75 / 175 of them, so that a node may
    lack far less beside one of its own size than beside a smaller one: it starts once for
    every band of sizes that holds a possible partner, with what it may lack beside the
    least of the band.
    A state is a node and the first atoms that it may have in common with another, what
    lies between them being lacked (``left`` is what may still be). Similar nodes have the
    state of their first common atoms, at every length. States of one key are paired if
    their pairs across components are few. Otherwise each asks for one more match, or, if
    states one atom longer are many a node (light atoms) and after ``DEEP`` atoms, they
    meet by how they differ (``_apart``). A node
    whose remaining atoms may all be lacked ends there: of nodes that end alike any two
    similar ones are similar to the smallest, so that they meet in a star.
    """
    none = node.select("s", F.col("s").alias("v")).limit(0)
    if node.isEmpty():
        return none
    at, j, left, need = (F.col(x) for x in ("at", "j", "left", "need"))
    total = F.size("ids")
    upto = lambda i: F.element_at("cum", i + 1)
    reach = lambda start, spare: F.filter(F.sequence(start, total), lambda i: upto(i) <= upto(start) + spare)
    overlap = lambda n, m: F.ceil((F.col(n) + F.col(m)) * PERCENT / (100 + PERCENT))
    node = node.drop("left").withColumn("band", F.floor(F.log("n") / math.log(BAND)).cast("int"))
    span = math.ceil(math.log(100 / PERCENT) / math.log(BAND))
    # Bands are as many as a logarithm of the sizes.
    bands = node.select(F.col("band").alias("other"), F.floor(F.pow(F.lit(BAND), "band") * (1 - 1e-9)).alias("low")).distinct()
    wide = node.withColumn("other", F.explode(F.sequence(F.col("band") - span, F.col("band") + span))).join(F.broadcast(bands), "other")
    wide = wide.withColumn("need", F.greatest(F.ceil(F.col("n") * PERCENT / 100), overlap("n", "low"))).withColumn("left", F.element_at("cum", -1) - need).where("left >= 0")
    # side: 0 of a band beside itself, otherwise 1 for the lower one of two and 2 for the upper.
    side = F.when(F.col("band") == F.col("other"), 0).when(F.col("band") < F.col("other"), 1).otherwise(2)
    wide = wide.select("s", "n", "c", "ids", "cum", F.xxhash64(F.least("band", "other"), F.greatest("band", "other")).alias("key"), side.alias("side"), F.lit(0).alias("at"), "left", "need")
    node = node.select("s", "n", "c", "ids", "cum")
    pairs, level = [], 0
    while True:
        level += 1
        steps = wide.withColumn("j", F.explode(reach(at, left)))
        steps = steps.withColumn("left", left - upto(j) + upto(at)).withColumn("over", j == total)
        going = ~F.col("over")
        atom = F.when(going, F.element_at("ids", F.least(j + 1, total)))
        more = F.when(going, F.size(reach(F.least(j + 1, total), left))).otherwise(0)
        state = stored(
            steps.select(
                "s", "n", "c", "side", "over", F.xxhash64("key", atom).alias("key"), (j + 1).alias("at"), "left", "need", atom.alias("last"), more.alias("more"),
                F.slice("ids", F.lit(1), F.least(j + 1, F.lit(SHORT))).alias("head"),
            )
        )
        ends = state.where("over").select("key", "s", "n", "c")
        star = ends.groupBy("key").agg(F.min(F.struct("n", "s", "c")).alias("h"), F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b")
        star = star.select("key", F.col("h.s").alias("v"), F.col("h.n").alias("m"), F.col("h.c").alias("d"))
        pairs.append(ends.join(star, "key").where((F.col("c") != F.col("d")) & _comparable("n", "m")).select("s", "v"))
        one = state.where(going).groupBy("key", "c").agg(F.count("*").alias("g"), F.sum("more").alias("e"))
        group = one.groupBy("key").agg(F.sum("g").cast("double").alias("g"), F.sum(F.col("g").cast("double") * F.col("g")).alias("q"), F.sum("e").alias("e"), F.count("*").alias("k"))
        many = F.col("g") * F.col("g") - F.col("q") > 2 * PAIRS * F.col("g")
        longer = many & (F.col("e") <= WIDE * F.col("g")) & F.lit(level < DEEP)
        group = stored(group.where("k > 1").select("key", longer.alias("longer"), (many & ~longer).alias("apart")))
        live = stored(state.where(going).join(_small(group), "key"))
        pairs.append(_apart(live.where("apart").select("key", "s", "side", "at", (left + need).alias("room")), node))
        direct = live.where("not longer and not apart").select("key", "s", "n", "c", "side", (left + need).alias("room"), "last", "head")
        other = direct.select("key", F.col("s").alias("v"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("side").alias("side2"), F.col("room").alias("room2"), F.col("head").alias("head2"))
        # Components meet before nodes, so that one of very many nodes is not held against itself.
        held = direct.select("key", "c", "side").distinct()
        across = ((F.col("side") == 0) & (F.col("c") < F.col("d"))) | ((F.col("side") == 1) & (F.col("side2") == 2) & (F.col("c") != F.col("d")))
        meets = held.join(held.select("key", F.col("c").alias("d"), F.col("side").alias("side2")), "key").where(across)
        early = _comparable("n", "m") & (F.least("room", "room2") >= overlap("n", "m"))
        first = F.try_element_at(F.array_intersect("head", "head2"), F.lit(level))  # the pair's last common atom here
        both = meets.join(direct, ["key", "c", "side"]).join(other, ["key", "d", "side2"]).where(early & (first.isNull() | (first == F.col("last"))))
        pairs.append(both.select("s", "v"))
        wide = live.where("longer").select("s", "key", "side", "at", "left", "need").join(node, "s")
        if wide.isEmpty():
            break
    for more in pairs:
        none = none.unionByName(more)
    return none.distinct()


def stuck_pairs(demand: DataFrame, comp: DataFrame, full: DataFrame) -> DataFrame:
    """s, v: pairs in different components of nodes whose prefixes are too heavy (step 4)."""
    stuck = stored(demand.where("l = 0").join(comp.select("s", "n", "c"), "s").select("s", "n", "c"))
    if stuck.isEmpty():
        return stuck.select("s", F.col("s").alias("v"))
    rows = stored(_token_rows(full.join(stuck, "s", "left_semi")))
    # What one node alone holds matches nothing; who lacks too much drops out, and no longer counts.
    shared = rows.join(rows.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1"), "tok")
    alive = shared.groupBy("s").agg(F.count("*").alias("k")).join(stuck, "s").where(F.col("k") * 100 >= F.col("n") * PERCENT)
    rows = stored(shared.select("s", "tok").join(alive.select("s", "n", "c"), "s"))
    df = rows.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    node = stored(whole_demands(rows.join(df, "tok")).where(F.size("toks") * 100 >= F.col("n") * PERCENT))
    node = node.withColumn("most", F.size("toks"))
    least = F.ceil((F.col("n") + F.col("m")) * PERCENT / (100 + PERCENT))  # the overlap that the two need
    alike = _comparable("n", "m") & (F.least("most", "most2") >= least)
    second = (F.col("s").alias("v"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("most").alias("most2"))
    # Poor nodes: enough matches in the prefix. Two poor ones meet once. The first matches
    # come before all but so many of the light shingles as both must share.
    light = lambda width: F.posexplode(F.slice("toks", F.lit(1), F.col(width).cast("int")))
    left = node.where("need > 0").select("s", "n", "c", "most", "light", "need", light("width").alias("q", "tok"))
    other = node.select(*second, (F.col("need") > 0).alias("poor"), F.col("light").alias("light2"), light("light").alias("q2", "tok"))
    common = least - F.least(F.col("most") - F.col("light"), F.col("most2") - F.col("light2"))
    early = (F.col("q") < F.col("light") - common + F.col("need")) & (F.col("q2") < F.col("light2") - common + F.col("need"))
    meets = (F.col("c") != F.col("d")) & (~F.col("poor") | (F.col("c") < F.col("d")))
    poor = left.join(other, "tok").where(meets & alike & early)
    poor = poor.groupBy("s", "v").agg(F.count("*").alias("k"), F.first("need").alias("need")).where("k >= need").select("s", "v")
    rich = node.where("need = 0").select("s", "n", "c")
    return poor.unionByName(rich_pairs(atoms(rows.select("s", "tok"), rich)))


def links(docs: DataFrame, node: DataFrame) -> DataFrame:
    """u, v: links between nodes (of the frame ``nodes``) that connect every component; stored."""
    with scratch(docs.sparkSession):
        return stored(_links(docs, node), keep=True)


def _links(docs: DataFrame, node: DataFrame) -> DataFrame:
    rows = remaining(docs)
    full = texts(docs, node, rows)
    node = rows.select("s", "n").distinct()
    found = rows.sparkSession.createDataFrame([], "u long, v long")
    # How much of a node's prefix others hold, by the logarithm of how many.
    centre = rows.groupBy("s").agg((F.sum(F.log2("df")) / F.first("n")).alias("centre"))
    comp = stored(node.join(centre, "s").select("s", "n", "centre", F.col("s").alias("c")))
    few = F.broadcast if comp.count() <= BROADCAST_NODES else lambda frame: frame
    tried = None
    # Stars: tokens that lead to several components, each node's most frequent untried hub.
    for turn in range(ROUNDS):
        live = rows.select("tok", "s").join(few(comp), "s")
        first = F.struct((-F.col("centre") if not turn else F.xxhash64("s", F.lit(turn))).alias("p"), "s", "n", "c")
        hubs = live.groupBy("tok").agg(F.min(first).alias("h"), F.min("c").alias("a"), F.max("c").alias("b"))
        hubs = hubs.where("a <> b").select("tok", F.col("h.s").alias("v"), F.col("h.n").alias("m"), F.col("h.c").alias("d"))
        votes = live.join(hubs, "tok").where((F.col("c") != F.col("d")) & _comparable("n", "m")).groupBy("s", "v").agg(F.count("*").alias("k"))
        if tried is not None:
            votes = votes.join(tried, (votes.s == tried.u) & (votes.v == tried.w), "left_anti")
        best = votes.groupBy("s").agg(F.max_by("v", F.struct("k", "v")).alias("v")).select(F.col("s").alias("u"), "v")
        best = stored(best)
        asked = best.count()
        if not asked:
            break
        new = stored(verify(best, full))
        found, n_new = found.unionByName(new), new.count()
        fresh = best.select("u", F.col("v").alias("w"))
        tried = fresh if tried is None else tried.unionByName(fresh)
        log.info("star round %d: %d verified, %d links", turn, asked, n_new)
        if n_new:
            root = components(found)
            comp = stored(comp.drop("c").join(root.select(F.col("node").alias("s"), "root"), "s", "left").withColumn("c", F.coalesce("root", "s")).drop("root"))
        if n_new * 20 < asked:
            break
    # What is left: pairs across components.
    demand = stored(demands(rows))
    live = rows.join(few(comp.select("s", "c")), "s")
    mixed = live.groupBy("tok").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("tok")
    live = stored(live.join(mixed, "tok", "left_semi").join(few(demand), "s"))
    left = live.where((F.col("df") <= HEAVY) & (F.col("l") > 0) & (F.col("r") < F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + F.col("l")))
    other = live.select("tok", F.col("s").alias("v"), F.col("n").alias("m"), F.col("c").alias("d"))
    light = (
        left.join(other, "tok").where((F.col("c") != F.col("d")) & _comparable("n", "m"))
        .groupBy("s", "v").agg(F.count("*").alias("k"), F.first("need").alias("need")).where("k >= need")
    )
    whole = stuck_pairs(demand, comp, full)
    rest = stored(light.select("s", "v").unionByName(whole).select(F.least("s", "v").alias("u"), F.greatest("s", "v").alias("v")).distinct())
    log.info("%d pairs across components", rest.count())
    if tried is not None:
        again = tried.select(F.least("u", "w").alias("u"), F.greatest("u", "w").alias("v")).distinct()
        rest = rest.join(again, ["u", "v"], "left_anti")
    return found.unionByName(verify(rest, full))


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, t, n and s (node; null for an empty set) of every row; s and root of the linked nodes."""
    node = nodes(docs)
    return node, components(links(docs, node)).select(F.col("node").alias("s"), "root")


def _small(frame: DataFrame) -> DataFrame:
    """With a broadcast hint, if the (stored) frame has few rows."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_NODES else frame


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    node, root = _grouped(docs)
    # A node first, then its component; a row alone needs neither, and a stored side of a
    # join lets Spark split the other where a third of the rows have one key.
    sets = node.where("s is not null").groupBy("s").agg(F.min("doc_id").alias("least"), F.count("*").alias("times"))
    least = stored(sets.join(_small(root), "s").groupBy("root").agg(F.min("least").alias("lowest")))
    known = sets.join(_small(root), "s", "left").where("times > 1 or root is not null").join(_small(least), "root", "left")
    known = stored(known.select("s", F.coalesce("lowest", "least").alias("component_id")))
    return node.join(_small(known), "s", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each component stays, that with the smallest doc_id; columns unchanged.

    A null id comes after all others. Of several texts with that id the first by hash
    stays, of several rows with that id and text the first by a hash of the row. Rows
    without shingles all stay.
    """
    # Rows are told apart by id and text: unrelated texts may share an id, or have none.
    node, root = _grouped(docs.select("doc_id", "text"))
    rows = node.where("s is not null").join(_small(root), "s", "left").groupBy(F.coalesce("root", "s").alias("c"), "doc_id", "t").agg(F.count("*").alias("times"))
    keep = rows.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "times")).alias("k"))
    keep = stored(keep.select(F.col("k.doc_id").alias("_d"), F.col("k.t").alias("_t"), F.col("k.times").alias("times")))
    size = keep.agg(F.count("*").alias("n"), F.coalesce(F.max("times"), F.lit(0)).alias("most")).first()
    blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), blank.alias("blank"), F.struct(*docs.columns).alias("row"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t"))
    found = read.join(F.broadcast(keep) if size.n <= BROADCAST_NODES else keep, same, "left")
    out = found.where("blank or times = 1").select("row.*")
    if size.most > 1:  # equal texts under one id: a partial aggregate, as they may be many
        again = found.where("not blank and times > 1").withColumn("h", row_hash(docs, "row"))
        out = out.unionByName(again.groupBy("doc_id", "t").agg(F.min_by("row", "h").alias("row")).select("row.*"))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
pairs AS (SELECT a.r AS u, b.r AS v, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
links AS (SELECT u, v FROM pairs JOIN n a ON a.r = u JOIN n b ON b.r = v WHERE 100 * k >= 75 * (a.n + b.n - k)),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT r, r AS x FROM w UNION SELECT reach.r, v FROM reach JOIN both_ways ON u = x),
least_id AS (SELECT reach.r, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r = reach.x GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM w LEFT JOIN n USING (r) JOIN least_id USING (r)
"""

"""Packs of whole texts, and one question about their keys: which occur often enough over all packs.

A pack holds the texts of some documents, about 2 MB, compressed, as one row of a stored
table. Its keys (64-bit hashes of whatever an operator looks for) are sent to buckets by
hash, those of a pack and bucket as one packed row; a bucket adds up what it got and
answers every pack with a bit a key. So a key costs about nine bytes on the way there and
a bit on the way back, one that half of all documents hold costs no more than one row a
pack, and no list of keys is ever broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, stored

PACK_BYTES = 2 << 20
#: Bytes of text whose keys one bucket gets, about.
BUCKET_BYTES = 32 << 20
PACK = "pack long, ids array<long>, ts array<int>, langs array<string>, sizes array<long>, z binary"


class Pack:
    """The documents of a pack, ordered by id (nulls first) and text hash, and their bytes."""

    def __init__(self, row: dict):
        self.pack, self.ids, self.ts, self.langs = row["pack"], row["ids"], row["ts"], row["langs"]
        self.offsets = np.concatenate(([0], np.cumsum(row["sizes"], dtype=np.int64)))
        self.bytes = zstandard.ZstdDecompressor().decompress(row["z"])
        self.data = np.frombuffer(self.bytes, np.uint8)


def packed(docs: DataFrame, size: int = PACK_BYTES) -> DataFrame:
    """A stored table of packs of ``docs``: doc_id long, lang string (if there is one), text; null texts are empty."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId() << 32, 0
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in chunks(batch, "text", size):
                order = pc.sort_indices(pa.table([part.column("doc_id"), part.column("t")], names=["doc_id", "t"]), sort_keys=[("doc_id", "ascending"), ("t", "ascending")], null_placement="at_start")
                part = part.take(order)
                texts = [(t or "").encode() for t in part.column("text").to_pylist()]
                row = [task + n, part.column("doc_id").to_pylist(), part.column("t").to_pylist(), part.column("lang").to_pylist(), [len(t) for t in texts], z.compress(b"".join(texts))]
                n += 1
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["pack", "ids", "ts", "langs", "sizes", "z"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return stored(docs.select(F.col("doc_id").cast("long"), F.hash("text").alias("t"), lang.alias("lang"), "text").mapInArrow(pack, PACK))


def each(f: Callable[[dict], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f of every row, as a dict with numpy arrays for flat lists; one row in memory at a time."""

    def value(x: pa.Scalar):
        if isinstance(x, pa.ListScalar) and x.is_valid and pa.types.is_integer(x.values.type) and not x.values.null_count:
            return x.values.to_numpy()
        return x.as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from f({name: value(batch.column(name)[i]) for name in batch.schema.names})

    return run


def buckets_for(packs: DataFrame, each: int = BUCKET_BYTES) -> int:
    """A number of buckets by the bytes of text, the session's number of shuffle partitions at least."""
    size = packs.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    return max(int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of distinct sorted keys by bucket, and the bounds of the buckets in it."""
    at = ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    return np.argsort(at, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(at, minlength=buckets))))


def _answers(packs: DataFrame, keys: Callable[[Pack], tuple[np.ndarray, np.ndarray]], least: int, buckets: int, totals: bool) -> DataFrame:
    """What the buckets answer; with ``totals``, also a row a partition without a pack: its frequent keys and how often each occurs."""
    count = np.dtype("<u4") if totals else np.dtype("u1")

    def send(row: dict) -> Iterator[pa.RecordBatch]:
        own, n = keys(Pack(row))
        order, bounds = by_bucket(own, buckets)
        own, n = own[order], (n[order] if totals else np.minimum(n[order], least)).astype(count)
        full = np.flatnonzero(np.diff(bounds))
        bodies = [own[bounds[b] : bounds[b + 1]].tobytes() + n[bounds[b] : bounds[b + 1]].tobytes() for b in full]
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), row["pack"])), pa.array(bodies, pa.binary())], names=["bucket", "pack", "body"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        bodies = [np.frombuffer(x.as_py(), np.uint8) for b in got for x in b.column("body")]
        sizes = np.array([len(x) // (8 + count.itemsize) for x in bodies])
        own = np.concatenate([x[: 8 * k].view(np.uint64) for x, k in zip(bodies, sizes)])
        n = np.concatenate([x[8 * k :].view(count) for x, k in zip(bodies, sizes)])
        del bodies
        order = np.argsort(own).astype(np.int32 if len(own) < 1 << 31 else np.int64)
        own, n = own[order], n[order]
        head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        often, total = np.empty(len(own), bool), np.add.reduceat(n, head, dtype=np.int64)
        often[order] = np.repeat(total >= least, np.diff(np.append(head, len(own))))
        names = np.zeros(len(own), bool)
        names[order[head]] = total >= least  # one of the packs that hold a frequent key
        ends = np.cumsum(sizes)
        planes = (often, names) if totals else (often,)
        bits = pa.array([b"".join(np.packbits(x[e - k : e]).tobytes() for x in planes) for e, k in zip(ends, sizes)], pa.binary())
        whole = pa.Table.from_batches([b.select(["bucket", "pack"]) for b in got]).combine_chunks().to_batches()[0]
        hits = pa.array([int(often[e - k : e].sum()) for e, k in zip(ends, sizes)], pa.int64())
        yield pa.RecordBatch.from_arrays([*whole.columns, bits, hits, pa.nulls(len(sizes), pa.binary())], names=["bucket", "pack", "bits", "n", "totals"])
        if totals:
            found = own[head][total >= least].tobytes() + total[total >= least].tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([found], pa.binary())], names=["bucket", "pack", "bits", "n", "totals"])

    rows = packs.mapInArrow(each(send), "bucket int, pack long, body binary").repartition(buckets, "bucket")
    return rows.mapInArrow(answer, "bucket int, pack long, bits binary, n long, totals binary")


def _by_pack(answers: DataFrame) -> DataFrame:
    return answers.groupBy("pack").agg(F.collect_list(F.struct("bucket", "bits")).alias("marks"), F.sum("n").alias("n"))


def frequent(packs: DataFrame, keys: Callable[[Pack], tuple[np.ndarray, np.ndarray]], least: int, buckets: int) -> DataFrame:
    """pack, marks (bucket, bits), n: of every key of a pack, whether it occurs ``least`` times over all packs (255 at most), and how many do.

    ``keys`` gives a pack's distinct keys in order and how often each occurs.
    """
    return _by_pack(_answers(packs, keys, least, buckets, False))


def frequent_totals(packs: DataFrame, keys: Callable[[Pack], tuple[np.ndarray, np.ndarray]], least: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """What ``frequent`` gives, and key, f of all frequent keys; both read a stored table.

    Of each frequent key one of its packs is told so, that its text can be given once: ``marked`` with ``plane`` 1.
    """
    answers = stored(_answers(packs, keys, least, buckets, True))

    def split(row: dict) -> Iterator[pa.RecordBatch]:
        k = len(row["totals"]) // 16
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(part, np.int64)) for part in (row["totals"][: 8 * k], row["totals"][8 * k :])], names=["key", "f"])

    return _by_pack(answers.where("pack IS NOT NULL")), answers.where("pack IS NULL").select("totals").mapInArrow(each(split), "key long, f long")


def marked(keys: np.ndarray, marks: list[dict] | None, buckets: int, plane: int = 0) -> np.ndarray:
    """The bits of a pack's distinct sorted keys: whether each is frequent (plane 0), whether this pack gives its text (1)."""
    order, bounds = by_bucket(keys, buckets)
    out = np.zeros(len(keys), bool)
    for m in marks or ():
        a, b = bounds[m["bucket"]], bounds[m["bucket"] + 1]
        out[order[a:b]] = np.unpackbits(np.frombuffer(m["bits"], np.uint8)[plane * -(-(b - a) // 8) :], count=b - a).view(bool)
    return out

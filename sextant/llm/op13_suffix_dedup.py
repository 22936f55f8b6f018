"""Suffix-array deduplication: bytes of 100-byte strings that start earlier too are removed.

Texts are cut into blocks of strings with one anchor: a string's anchor is its smallest run
of ``GRAM`` bytes by hash, and consecutive strings with the same anchor are a block. Equal
strings have equal anchors, so sending every block to the shard of its anchor brings equal
strings together, wherever they stand. Blocks whose anchor no other block has hold nothing
that repeats and are not sent. Each shard sorts the suffixes of its blocks by external
induced sorting (``induced``); suffixes whose common prefix reaches 100 bytes are one
string, and all but its earliest place are removed.

A block's text is in a shard once: blocks that are equal byte by byte are merged in the
pack and in the shard, before the sort, and stand at their earliest place; a block at a
later place is removed whole. So a passage that a third of all documents share is one block
a pack on the way and one in the sort. A shard has about ``SHARD_BYTES`` of text; one that
an unusual anchor makes larger is sorted with its queues and arrays on disk.

Order: by doc_id (nulls first), of one id by the hash of the text, of one text by place.
Defined results: null text is empty; documents of fewer than 100 bytes keep all; rows equal
in id and text are one document, kept or cut alike; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored, table
from .induced import BUDGET, STEP, array, suffixes
from .packs import Pack, buckets_for, each, frequent, marked, packed
from .words import BASE, mix

LENGTH = 100
#: Bytes of an anchor; shorter ones occur by chance in texts that share nothing.
GRAM = 32
SPREAD = LENGTH - GRAM + 1  # anchors to choose from in a string, and most strings in a block
MASK_BYTES = -(-SPREAD // 8)
SHARD_BYTES = 4 << 20
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of every run of GRAM bytes, eight at a time."""
    n = len(data) - GRAM + 1
    eight = np.ndarray((n + GRAM - 8,), "<u8", np.ascontiguousarray(data), strides=(1,))
    h = np.zeros(n, np.uint64)
    for i in range(0, GRAM, 8):
        h = mix(h * BASE + eight[i : i + n])
    return h


def blocks(pack: Pack) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First string, number of strings and anchor hash of every block of a pack."""
    data, none = pack.data, np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, np.zeros(0, np.uint64)
    grams = _grams(data)
    n, count = len(grams), len(data) - LENGTH + 1
    # Leftmost smallest of every SPREAD grams: least from the left and from the right within tiles.
    tiles = np.full(-(-n // SPREAD) * SPREAD, _FULL)
    tiles[:n] = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    tiles = tiles.reshape(-1, SPREAD)
    left = np.minimum.accumulate(tiles, axis=1).reshape(-1)
    right = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    place = (np.minimum(right[:count], left[SPREAD - 1 : SPREAD - 1 + count]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # A string ends in the document in which it starts.
    doc = np.repeat(np.arange(len(pack.offsets) - 1), np.diff(pack.offsets))
    inside = doc[:count] == doc[LENGTH - 1 :]
    valid = np.flatnonzero(inside)
    if not len(valid):
        return none, none, np.zeros(0, np.uint64)
    at = place[valid]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1))))
    return valid[new], np.diff(np.append(new, len(valid))), grams[at[new]]


def _keys(pack: Pack) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(blocks(pack)[2], return_counts=True)


class Shared:
    """The blocks of a pack whose anchor occurs elsewhere, equal ones once."""

    def __init__(self, pack: Pack, marks: list[dict] | None, buckets: int):
        first, n, anchor = blocks(pack)
        own, which = np.unique(anchor, return_inverse=True)
        keep = np.flatnonzero(marked(own, marks, buckets)[which]) if len(own) else np.zeros(0, np.int64)
        self.first, self.n, self.anchor = first[keep], n[keep], anchor[keep]
        self.text = _slices(pack.data, self.first, self.n + LENGTH - 1)
        self.doc = np.searchsorted(pack.offsets, self.first, "right") - 1
        self.at = self.first - pack.offsets[self.doc]
        code = self.text.dictionary_encode().indices.to_numpy()
        self.distinct, self.code = np.unique(code, return_index=True)[1], code


def _slices(data: np.ndarray, first: np.ndarray, n: np.ndarray) -> pa.Array:
    """Stretches of bytes as a binary array."""
    ends = np.cumsum(n)
    take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - n), n)
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[take]))])


def _ids(values: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([v is not None for v in values], bool), np.array([v or 0 for v in values], np.int64)


def repeated_strings(text: np.ndarray, first: np.ndarray, n: np.ndarray, place: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """Of every byte of joined blocks whether a string starts there that starts at an earlier place too.

    ``first``, ``n``, ``place``: where each block begins, its number of strings, and the rank of
    its document in the upper bits of a long, the place of its first string in the lower ones.
    """
    order, common = suffixes(text, 256, LENGTH, budget)
    n_bytes, never = len(text), np.iinfo(np.int64).max
    where, out = array(n_bytes, np.int64, budget), np.zeros(n_bytes, bool)
    where[:] = never
    for i in range(0, len(n), STEP // SPREAD):
        part = slice(i, i + STEP // SPREAD)
        row = np.repeat(np.arange(len(n[part])), n[part])
        step = np.arange(len(row)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
        where[first[part][row] + step] = place[part][row] + step
    i = 0
    while i < n_bytes:  # whole groups of suffixes with one string
        end = min(i + STEP, n_bytes)
        while end < n_bytes and common[end] >= LENGTH:
            end += 1
        some = np.asarray(order[i:end])
        ranked, head = where[some], np.flatnonzero(common[i:end] < LENGTH)  # the first suffix has nothing before it
        least = np.repeat(np.minimum.reduceat(ranked, head), np.diff(np.append(head, len(some))))
        out[some] = (ranked > least) & (ranked < never)
        i = end
    return out


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masks of removed strings of all blocks that a shard got, a row for each row it got."""
    rows = [r for b in batches for r in b.to_pylist()]
    if not rows:
        return
    get = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows])
    sizes = np.array([len(r["n"]) for r in rows])
    n, at, t, number = get("n", np.uint8).astype(np.int64), get("at", np.int64), get("t", np.int32), get("number", np.int32)
    known, doc_id, anchor = get("known", bool), get("doc_id", np.int64), get("anchor", np.uint64)
    lengths = n + LENGTH - 1
    data = get("text", np.uint8)
    for r in rows:
        del r["text"]
    text = _slices(data, np.cumsum(lengths) - lengths, lengths)
    code = text.dictionary_encode().indices.to_numpy()
    # Documents by rank, then places, then the earliest block of each text.
    order = np.lexsort((t, doc_id, known))
    new = np.concatenate(([0], (np.diff(known[order].astype(np.int8)) != 0) | (np.diff(doc_id[order]) != 0) | (np.diff(t[order]) != 0)))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    place = (rank << 36) | at
    by_place = np.lexsort((place, code))
    head = np.flatnonzero(np.concatenate(([True], code[by_place][1:] != code[by_place][:-1])))
    earliest = by_place[head]  # by code
    # Texts whose anchor has one text only repeat nothing.
    _, which, count = np.unique(anchor[earliest], return_inverse=True, return_counts=True)
    chosen = earliest[count[which] > 1]
    chosen_lengths = lengths[chosen]
    joined = np.frombuffer(_slices(data, (np.cumsum(lengths) - lengths)[chosen], chosen_lengths).buffers()[2], np.uint8)
    begin = np.cumsum(chosen_lengths) - chosen_lengths
    hit = repeated_strings(joined, begin, n[chosen], place[chosen])
    bits = np.zeros((len(earliest), 8 * MASK_BYTES), bool)
    row = np.repeat(np.arange(len(chosen)), n[chosen])
    step = np.arange(len(row)) - np.repeat(np.cumsum(n[chosen]) - n[chosen], n[chosen])
    bits[code[chosen][row], step] = hit[begin[row] + step]
    masks = np.packbits(bits, axis=1)[code]
    masks[place != place[earliest][code]] = 255
    ends = np.cumsum(sizes)
    for r, e, k in zip(rows, ends, sizes):
        part = slice(e - k, e)
        some = masks[part].any(axis=1)
        if some.any():
            body = number[part][some].tobytes() + masks[part][some].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([r["pack"]], pa.int64()), pa.array([body], pa.binary())], names=["pack", "body"])


def _covered(pack: Pack, shared: Shared, replies: list[bytes] | None) -> np.ndarray:
    """Of every byte of a pack whether a removed string covers it."""
    masks = np.zeros((len(shared.first), MASK_BYTES), np.uint8)
    for body in replies or ():
        k = len(body) // (4 + MASK_BYTES)
        masks[np.frombuffer(body[: 4 * k], np.int32)] = np.frombuffer(body[4 * k :], np.uint8).reshape(k, MASK_BYTES)
    if len(shared.first):
        first = shared.distinct[shared.code]  # the block of this text that was sent
        row_ids = [(pack.ids[d], pack.ts[d]) for d in range(len(pack.ids))]
        key = np.concatenate(([0], np.cumsum([a != b for a, b in zip(row_ids[1:], row_ids)]))).astype(np.int64) if row_ids else np.zeros(0, np.int64)
        same = (key[shared.doc] == key[shared.doc[first]]) & (shared.at == shared.at[first])
        masks = masks[first]
        masks[~same] = 255
    bits = np.unpackbits(masks, axis=1).view(bool)[:, :SPREAD] & (np.arange(SPREAD) < shared.n[:, None])
    row, step = np.nonzero(bits)
    start = shared.first[row] + step
    change = np.bincount(start, minlength=len(pack.data) + LENGTH) - np.bincount(start + LENGTH, minlength=len(pack.data) + LENGTH)[: len(pack.data) + LENGTH]
    return np.cumsum(change)[: len(pack.data)] > 0


def cut_packs(docs: DataFrame, f, schema: str) -> DataFrame:
    """f(pack, covered) in record batches of ``schema`` for packs of ``docs``. The result reads tables of the innermost scratch block."""
    packs = packed(docs)
    buckets = buckets_for(packs)
    marks = stored(frequent(packs, _keys, 2, buckets))
    both = packs.join(marks.drop("n"), "pack", "left")

    def send(row: dict) -> Iterator[pa.RecordBatch]:
        pack = Pack(row)
        shared = Shared(pack, row["marks"], buckets)
        pick = shared.distinct
        if not len(pick):
            return
        shard = ((shared.anchor[pick] >> np.uint64(8)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        pick, shard = pick[order], shard[order]
        known, ids = _ids(list(pack.ids))
        ts = np.asarray(pack.ts, np.int32)
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(pick)]
        doc = shared.doc[pick]
        columns = {"number": pick.astype(np.int32), "n": shared.n[pick].astype(np.uint8), "at": shared.at[pick], "t": ts[doc], "known": known[doc], "doc_id": ids[doc], "anchor": shared.anchor[pick]}
        text = shared.text.take(pa.array(pick)).to_pylist()
        bodies = {**{c: [v[a:b].tobytes() for a, b in zip(cuts, cuts[1:])] for c, v in columns.items()}, "text": [b"".join(text[a:b]) for a, b in zip(cuts, cuts[1:])]}
        yield pa.RecordBatch.from_arrays(
            [pa.array(shard[cuts[:-1]].astype(np.int32)), pa.array(np.full(len(cuts) - 1, row["pack"])), *(pa.array(v, pa.binary()) for v in bodies.values())], names=["shard", "pack", *bodies],
        )

    sent_bytes = (marks.agg(F.sum("n")).first()[0] or 0) * (LENGTH + SPREAD // 2)
    shards = max(buckets, -(-sent_bytes // SHARD_BYTES))
    names = ["number", "n", "at", "t", "known", "doc_id", "anchor", "text"]
    sent = both.mapInArrow(each(send), "shard int, pack long, " + ", ".join(f"{c} binary" for c in names)).repartition(shards, "shard")
    replies = stored(sent.mapInArrow(_shard, "pack long, body binary").groupBy("pack").agg(F.collect_list("body").alias("replies")))

    def cut(row: dict) -> Iterator[pa.RecordBatch]:
        pack = Pack(row)
        yield from f(pack, _covered(pack, Shared(pack, row["marks"], buckets), row["replies"]))

    return both.join(replies, "pack", "left").mapInArrow(each(cut), schema)


def _digests(pack: Pack, covered: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.concatenate(([0], np.cumsum(covered)))
    a, b = pack.offsets[:-1], pack.offsets[1:]
    start = covered & ~np.concatenate(([False], covered[:-1])) if len(covered) else covered
    edge = a[a < b]
    start[edge] = covered[edge]
    spans = np.concatenate(([0], np.cumsum(start)))
    kept = [hashlib.sha256(pack.data[x:y][~covered[x:y]].tobytes()).hexdigest() for x, y in zip(a, b)]
    yield pa.RecordBatch.from_arrays([pa.array(list(pack.ids), pa.int64()), pa.array(b - a), pa.array(total[b] - total[a]), pa.array(spans[b] - spans[a]), pa.array(kept, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removed_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``."""
    with scratch(docs.sparkSession):
        return stored(cut_packs(docs, _digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), keep=True)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, the bytes that stay of every row; a character that was cut in two is replaced by U+FFFD."""

    def texts(pack: Pack, covered: np.ndarray) -> Iterator[pa.RecordBatch]:
        kept = [pack.data[x:y][~covered[x:y]].tobytes().decode(errors="replace") for x, y in zip(pack.offsets, pack.offsets[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(list(pack.ids), pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "text"])

    with scratch(docs.sparkSession):
        return stored(cut_packs(docs, texts, "doc_id long, text string"), keep=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), s AS (
  SELECT doc_id, h, unnest(range(1, strlen(h) // 2 - 98)) AS i FROM d WHERE strlen(h) >= 200
), w AS (
  SELECT doc_id, i, md5_number(substr(h, 2 * i - 1, 200)) AS k FROM s
), r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS place FROM w
), m AS (
  SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r WHERE place > 1
), g AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM m
), c AS (
  SELECT doc_id, span, min(i) AS a, max(i) + 99 AS b FROM g GROUP BY doc_id, span
), l AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a + 1) AS n_removed, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM c GROUP BY doc_id
)
SELECT d.doc_id, (strlen(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(1, n_spans + 2),
    lambda k: substr(h, 2 * coalesce(ends[k - 1], 0) + 1, 2 * (coalesce(starts[k], strlen(h) // 2 + 1) - coalesce(ends[k - 1], 0) - 1))), '') END)) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)
"""

"""Substring deduplication by relative Lempel-Ziv parsing.

A window is ``WINDOW`` consecutive words of a document; the words of a window whose word
sequence starts anywhere else too are removed. Documents are factored against reference
blocks that their own content cuts out: the anchor of a window is its smallest run of
``ANCHOR`` words by hash, and the consecutive windows with one anchor span a block. Equal
text is cut alike wherever it occurs, so a block that is indexed more than once is a
factor as a whole, and a long repeat is a sequence of such factors. Greedy parsing leaves
the places where a factor ends inside a block; those are blocks whose anchor is indexed
with other blocks but which are not repeated themselves. At these factor boundaries each
window is looked up on its own among the blocks of the anchor. Both steps together find
every repeated window: equal windows have equal anchors.

A plain greedy parse, which follows one reference at a time, would miss a window that is
repeated elsewhere than in the reference it follows; the parse is therefore one against
all references at once, by hashes, and its factors are the maximal runs of windows found.

Scale: a document sends one row per block (about one per fifteen words); rows equal
within a chunk of text are merged before the shuffle, so a passage that a third of all
documents share sends one row per chunk. A repeated block is one index row however often
it occurs; nothing lists the pairs of its occurrences, and no anchor's blocks meet in one
task: that an anchor has several is a partial aggregate. Texts travel compressed.

Defined results: null text has no words; documents shorter than a window keep all; equal
rows are two occurrences; rows of one id with different texts are told apart; other
columns, whatever their names, are carried through ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, frugal, scratch, stored, table
from .words import BASE, hashes, mix, runs, spans, text_bytes

WINDOW = 35
ANCHOR = 8
SPREAD = WINDOW - ANCHOR + 1  # anchors to choose from in a window, and most windows in a block
TEXT_BYTES = 2 << 20
#: Rows (of at most 40 bytes) that may be broadcast; more are joined by shuffle, where Spark may split hot keys.
BROADCAST_ROWS = 500_000


def _small(frame: DataFrame) -> DataFrame:
    """A stored frame, with a broadcast hint if it has few rows."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


class Words:
    """Words of a batch of texts: byte spans, text number, place in the text, window hashes."""

    def __init__(self, column: pa.Array):
        self.data, offsets = text_bytes(column)
        self.starts, self.ends = spans(self.data, offsets)
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        self.first = np.searchsorted(self.text, np.arange(len(column) + 1))
        self.hash = hashes(self.data, self.starts, self.ends)
        self.window = runs(self.hash, WINDOW)
        n = len(self.window)
        self.valid = self.text[:n] == self.text[WINDOW - 1 :] if n else np.zeros(0, bool)

    def blocks(self) -> tuple[np.ndarray, ...]:
        """First window, number of windows, anchor hash and block hash of every block."""
        v = np.flatnonzero(self.valid)
        if not len(v):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
        value = grams = runs(self.hash, ANCHOR)
        place = np.arange(len(value))
        width = 1
        while width < SPREAD:  # sliding minimum by doubling, the leftmost of equals
            step = min(width, SPREAD - width)
            left = value[:-step] <= value[step:]
            value, place = np.where(left, value[:-step], value[step:]), np.where(left, place[:-step], place[step:])
            width += step
        place = place[v]
        new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (v[1:] != v[:-1] + 1))))
        first, n = v[new], np.diff(np.append(new, len(v)))
        block = mix(self.window[first] * BASE + self.window[first + n - 1]) + n.astype(np.uint64)
        return first, n, grams[place[new]], mix(block)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


BLOCK = "a long, p long, doc_id long, t int, at long"


def _block_rows(part: pa.RecordBatch, merge: bool) -> pa.RecordBatch:
    """Rows of BLOCK of a batch (doc_id, t, text), with their number; ``merge``: equal blocks once.

    ``at`` is the place of the first window in its document times 256, plus the number of windows.
    """
    words = Words(part.column("text"))
    first, n, a, p = words.blocks()
    text = words.text[first] if len(first) else np.zeros(0, np.int64)
    at = (first - words.first[text]) * 256 + n
    count = np.ones(len(first), np.int64)
    if merge and len(first):
        order = np.lexsort((p, a))
        new = np.flatnonzero(np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (p[order][1:] != p[order][:-1]))))
        count, keep = np.diff(np.append(new, len(order))), order[new]
        text, at, a, p = text[keep], at[keep], a[keep], p[keep]
    pick = pa.array(text)
    return pa.RecordBatch.from_arrays([_signed(a), _signed(p), part.column("doc_id").take(pick), part.column("t").take(pick), pa.array(at), pa.array(count)], names=["a", "p", "doc_id", "t", "at", "n"])


def _over_chunks(f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", TEXT_BYTES):
                yield f(part)

    return frugal(run)


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, t (a hash that tells texts of one id apart) and text."""
    return docs.select(F.col("doc_id").cast("long"), F.hash("text").alias("t"), "text")


def _packed(part: pa.RecordBatch) -> pa.Array:
    z = zstandard.ZstdCompressor(level=3)
    return pa.array([None if t is None else z.compress(t.encode()) for t in part.column("text").to_pylist()], pa.binary())


def _unpacked(column: pa.Array) -> pa.Array:
    z = zstandard.ZstdDecompressor()
    return pa.array([None if b is None else z.decompress(b).decode() for b in column.to_pylist()], pa.large_string())


def _compressed(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with text replaced by z, its compressed form."""
    keep = [c for c in docs.columns if c != "text"]
    names, kinds = [f"_{i}" for i in range(len(keep))], dict(docs.dtypes)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(part.column(x) for x in names), _packed(part)], names=[*names, "z"])

    out = docs.select(*(F.col(c).alias(x) for c, x in zip(keep, names)), "text").mapInArrow(_over_chunks(run), ", ".join([*(f"{x} {kinds[c]}" for c, x in zip(keep, names)), "z binary"]))
    return out.select(*(F.col(x).alias(c) for c, x in zip(keep, names)), "z")


def reference_index(docs: DataFrame) -> DataFrame:
    """Blocks that matter: repeated, or sharing their anchor with another block.

    One row per anchor and block: occurrences n, one occurrence, and whether the anchor
    has other blocks.
    """
    rows = _identified(docs).mapInArrow(_over_chunks(lambda part: _block_rows(part, True)), BLOCK + ", n long")
    blocks = rows.groupBy("a", "p").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "t", "at")).alias("one"))
    several = stored(blocks.groupBy("a").agg(F.min("p").alias("low"), F.max("p").alias("high")).where("low <> high").select("a", F.lit(True).alias("shared")))
    found = blocks.join(_small(several), "a", "left").where("n > 1 or shared")
    return stored(found.select("a", "p", "n", F.coalesce("shared", F.lit(False)).alias("shared"), "one.*"))


def boundary_windows(docs: DataFrame, index: DataFrame) -> DataFrame:
    """a, p and the bit mask of windows that other blocks of the anchor have too.

    Only for blocks that are not repeated themselves; every block of the anchor is looked at,
    through one occurrence each.
    """
    wanted = index.where("shared").groupBy("doc_id", "t").agg(F.collect_list(F.struct("a", "p", "at", "n")).alias("blocks"))
    texts = _compressed(_identified(docs))
    both = texts.join(wanted.select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), "blocks"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                words, lists = Words(_unpacked(part.column("z"))), part.column("blocks")
                sizes = lists.value_lengths().to_numpy()
                a, p, at, n = (lists.flatten().field(f).to_numpy() for f in range(4))
                first, count = at // 256 + words.first[np.repeat(np.arange(len(sizes)), sizes)], at % 256
                row = np.repeat(np.arange(len(at)), count)
                j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                yield pa.RecordBatch.from_arrays([pa.array(a[row]), pa.array(p[row]), _signed(words.window[first[row] + j]), pa.array(j.astype(np.int32)), pa.array(n[row] > 1)], names=["a", "p", "w", "j", "whole"])

    # Equal rows of documents give equal windows: a block counts once.
    windows = stored(both.select("z", "blocks").mapInArrow(frugal(run), "a long, p long, w long, j int, whole boolean"))
    again = stored(windows.groupBy("a", "w").agg(F.min("p").alias("low"), F.max("p").alias("high")).where("low <> high").select("a", "w"))
    single = windows.where("not whole")
    return single.join(_small(again), ["a", "w"]).groupBy("a", "p").agg(F.bit_or(F.expr("shiftleft(1, j)")).alias("mask"))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, t and factors (at, mask): the windows of each document that are repeated."""
    with scratch(docs.sparkSession):
        index = reference_index(docs)
        whole = index.where("n > 1").select("a", "p", F.lit((1 << SPREAD) - 1).alias("mask"))
        known = stored(whole.unionByName(boundary_windows(docs, index)), keep=True)
    rows = _identified(docs).mapInArrow(_over_chunks(lambda part: _block_rows(part, False)), BLOCK + ", n long").drop("n")
    found = rows.join(_small(known), ["a", "p"])
    return found.groupBy("doc_id", "t").agg(F.collect_set(F.struct("at", "mask")).alias("factors"))


def _covered(words: Words, lists: pa.Array) -> np.ndarray:
    """Per word whether a repeated window covers it."""
    sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy()
    at, mask = (lists.flatten().field(f).to_numpy() for f in range(2))
    first, n = at // 256 + words.first[np.repeat(np.arange(len(sizes)), sizes)], at % 256
    row = np.repeat(np.arange(len(at)), n)
    j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    window = (first[row] + j)[(mask[row] >> j) & 1 == 1]
    change = np.bincount(window, minlength=len(words.starts) + 1) - np.bincount(window + WINDOW, minlength=len(words.starts) + 1)[: len(words.starts) + 1]
    return np.cumsum(change)[: len(words.starts)] > 0


def _parsed(docs: DataFrame, f: Callable, schema: str, keep: list[str]) -> DataFrame:
    """f(words, covered, texts) in Arrow columns for every row of docs, with the ``keep`` columns."""
    names, kinds = [f"_{i}" for i in range(len(keep))], dict(docs.dtypes)
    rows = docs.select(*(F.col(c).alias(x) for c, x in zip(keep, names)), F.col("doc_id").cast("long").alias("_id"), F.hash("text").alias("_h"), "text")
    found = repeats(docs).select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), "factors")
    both = _compressed(rows).join(found, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_t")), "left").select(*names, "z", "factors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = _unpacked(part.column("z"))
                words = Words(texts)
                added = f(words, _covered(words, part.column("factors")), texts)
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), *added], names=[*names, *(x.split(" ")[0] for x in schema.split(", "))])

    out = both.mapInArrow(frugal(run), ", ".join([*(f"{x} {kinds[c]}" for c, x in zip(keep, names)), schema]))
    return out.select(*(F.col(x).alias(c) for c, x in zip(keep, names)), *(x.split(" ")[0] for x in schema.split(", ")))


def _kept(words: Words, covered: np.ndarray) -> Iterator[bytes]:
    """The words of each text that stay, joined by one space."""
    data = words.data.tobytes()
    starts, ends, bounds = words.starts.tolist(), words.ends.tolist(), words.first.tolist()
    for a, b in zip(bounds[:-1], bounds[1:]):
        stay = np.flatnonzero(~covered[a:b]) + a
        yield b" ".join([data[starts[i] : ends[i]] for i in stay.tolist()])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated words removed from text (and n_chars, if there is one, corrected).

    A text that keeps all its words is unchanged; another is its kept words joined by one space.
    """
    columns = docs.columns

    def cut(words: Words, covered: np.ndarray, texts: pa.Array) -> list[pa.Array]:
        out, old = [], texts.to_pylist()
        hit = np.add.reduceat(np.append(covered, False), np.minimum(words.first[:-1], len(covered))) if len(covered) else np.zeros(len(old))
        for text, new, a, b, h in zip(old, _kept(words, covered), words.first[:-1], words.first[1:], hit):
            out.append(new.decode() if b > a and h else text)
        return [pa.array(out, pa.string())]

    parsed = _parsed(docs, cut, "text string", [c for c in columns if c != "text"])
    if "n_chars" in columns:
        parsed = parsed.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return parsed.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(words: Words, covered: np.ndarray, texts: pa.Array) -> list[pa.Array]:
        n = np.diff(words.first)
        total = np.concatenate(([0], np.cumsum(covered)))
        removed = total[words.first[1:]] - total[words.first[:-1]]
        return [pa.array(n), pa.array(removed), pa.array([hashlib.sha256(k).hexdigest() for k in _kept(words, covered)], pa.string())]

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _parsed(docs, digest, "n_words long, n_removed long, kept_sha256 string", ["doc_id"])


ORACLE = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), s AS (
  SELECT r, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35
), h AS (
  SELECT r, i, sha256(array_to_string(words[i:i + 34], ' ')) AS h FROM s
), d AS (
  SELECT r, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)
), c AS (
  SELECT r, list(DISTINCT k) AS cut FROM (SELECT r, unnest(range(i, i + 35)) AS k FROM d) GROUP BY r
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(cut), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_transform(list_filter(range(1, len(words) + 1), lambda k: NOT list_contains(coalesce(cut, []), k)), lambda k: words[k]), ' ')) AS kept_sha256
FROM w LEFT JOIN c USING (r)
"""

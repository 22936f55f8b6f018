"""Phrase collocations by multikey three-way quicksort of suffix pointers.

A suffix pointer is a place in a piece of text (pieces end at punctuation and line breaks)
with the words that follow, four at most. Sorting pointers by three-way partitions, word
after word, makes every group of equal prefixes one partition, whose size is the count of
its phrase; partitions below ``LEAST`` are abandoned, as no longer phrase in them can occur
often enough. Pointers are routed by language and leading words, so a partition is whole.

Most pointers are abandoned before they travel: a phrase occurs ``LEAST`` times only if its
words and its pairs of neighbours do, so words and pairs are counted over all packs first
(``packs.frequent_totals``), by hash, and a pointer is cut where a pair is not frequent.
That counts pairs as well, and one pack gives the text of each; pointers of three words or
more are merged in the pack, summed over packs, and only then routed and sorted. A phrase
that stands in a third of all documents is a row a pack at most, and one row when sorted.

Scoring is relational: each candidate is cut at every place, its parts are joined with their
counts, and candidates within a longer one of nearly their count go, by a maximum over the
longer ones' parts.

Defined results: null text is empty, null language ``und``; repeated rows count as often as
they occur; columns beside lang and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, stored, table
from .packs import Pack, buckets_for, each, frequent_totals, marked, packed
from .words import BASE, hashes, mix

LONGEST, LEAST, TOP, NESTED = 4, 30, 2000, 80
#: Smaller than elsewhere: nearly every word and pair is a key.
PACK_BYTES, BUCKET_BYTES = 1 << 20, 8 << 20
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLANK, _END = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_PAIR = np.uint64(0xA24BAED4963EE407)


def _language(lang: str | None) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(("und" if lang is None else lang).encode(), digest_size=8).digest(), "little"))


class Pointers:
    """Words of a pack: bytes, document, key, and whether the next word follows in the same piece."""

    def __init__(self, pack: Pack):
        self.bytes = pack.bytes.translate(_LOWER)
        data = np.frombuffer(self.bytes, np.uint8)
        ink = ~(_BLANK | _END)[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[pack.offsets] = True
        before = np.concatenate(([False], ink[:-1])) & ~edge[:-1] if len(data) else ink
        after = np.concatenate((ink[1:], [False])) & ~edge[1:] if len(data) else ink
        self.starts, self.ends = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
        self.doc = np.searchsorted(pack.offsets, self.starts, "right") - 1
        self.key = mix(hashes(data, self.starts, self.ends) + np.array([_language(x) for x in pack.langs], np.uint64)[self.doc]) if len(self.starts) else np.zeros(0, np.uint64)
        piece = np.concatenate(([0], np.cumsum(_END[data])))[self.starts]
        self.next = np.zeros(len(self.starts), bool)
        if len(self.starts) > 1:
            self.next[:-1] = (piece[1:] == piece[:-1]) & (self.doc[1:] == self.doc[:-1])
        self.pair = np.zeros(len(self.starts), np.uint64)
        if len(self.starts) > 1:
            self.pair[:-1] = mix(self.key[:-1] * BASE + self.key[1:]) ^ _PAIR

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate((self.key, self.pair[self.next])), return_counts=True)


def _texts(at: Pointers, first: np.ndarray, length: np.ndarray) -> list[list[str | None]]:
    """The words of pointers, a list for each of LONGEST places; None beyond a pointer's length."""
    out = []
    for d in range(LONGEST):
        on = np.where(length > d, first + d, 0)
        out.append([at.bytes[x:y].decode() if ok else None for x, y, ok in zip(at.starts[on].tolist(), at.ends[on].tolist(), (length > d).tolist())] if len(first) else [])
    return out


def _pointer_rows(pack: Pack, marks: list[dict] | None, buckets: int) -> pa.RecordBatch:
    """What a pack tells of its words, in rows of lang, four words, key and n.

    With a key: the text of a frequent word or pair that this pack is to give. Without: a
    distinct pointer of three words or more whose pairs are all frequent, and its number;
    or, without words, the number of words of a language.
    """
    at = Pointers(pack)
    own, _ = at.keys()
    often, gives = (marked(own, marks, buckets, plane) for plane in (0, 1))
    place, pairs = np.searchsorted(own, at.key), np.flatnonzero(at.next)
    pair_place = np.searchsorted(own, at.pair[pairs])
    follows = np.zeros(len(at.key), bool)
    follows[pairs] = often[pair_place]
    # Words and pairs to give, each at one of its places.
    where = np.full(len(own), -1)
    where[place], where[pair_place] = np.arange(len(at.key)), pairs
    is_pair = np.zeros(len(own), bool)
    is_pair[pair_place] = True
    named = np.flatnonzero(gives)
    # Pointers of three words or more.
    pad = np.concatenate((follows, np.zeros(LONGEST, bool)))
    length, reach = np.ones(len(follows), np.int64), follows.copy()
    for d in range(1, LONGEST):
        length += reach
        reach &= pad[d : d + len(reach)]
    on = np.flatnonzero(length > 2)
    name = at.key[on].copy()
    for d in range(1, LONGEST):
        name = mix(name * BASE + np.where(length[on] > d, at.key[np.minimum(on + d, len(at.key) - 1)], np.uint64(d)))
    _, first, n = np.unique(name, return_index=True, return_counts=True)
    first = on[first]
    langs = ["und" if x is None else x for x in pack.langs]
    total: dict[str, int] = {}
    for lang, k in zip(langs, np.bincount(at.doc, minlength=len(langs)).tolist()):
        total[lang] = total.get(lang, 0) + k
    start = np.concatenate((where[named], first)).astype(np.int64)
    words = _texts(at, start, np.concatenate((np.where(is_pair[named], 2, 1), length[first])))
    rest = [None] * len(total)
    keys = own[named].view(np.int64).tolist() + [None] * len(first) + rest
    return pa.RecordBatch.from_arrays(
        [pa.array([langs[i] for i in at.doc[start].tolist()] + list(total), pa.string()), *(pa.array(c + rest, pa.string()) for c in words), pa.array(keys, pa.int64()), pa.array([0] * len(named) + n.tolist() + list(total.values()), pa.int64())],
        names=["lang", *(f"w{d}" for d in range(LONGEST)), "key", "n"],
    )


def quicksorted(symbols: list[np.ndarray], weight: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Equal partitions of rows by multikey three-way quicksort: number of leading symbols, a row of each, sum of its weights.

    All partitions of one round are split at once, each around the symbol in its middle.
    Those that weigh less than ``least`` are abandoned; symbols below 0 end a row.
    """
    depth_of = np.zeros(1, np.int64)  # by partition
    rows, part = np.arange(len(weight)), np.zeros(len(weight), np.int64)
    matrix = np.stack(symbols) if symbols else np.zeros((0, 0), np.int64)
    while len(rows):
        bounds = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
        n = np.diff(bounds)
        depth = depth_of[part]
        symbol = matrix[depth, rows]
        pivot = np.repeat(symbol[bounds[:-1] + n // 2], n)
        side = np.sign(symbol - pivot) + 1
        order = np.argsort(part * 3 + side, kind="stable")
        rows, key, depth = rows[order], (part * 3 + side)[order], depth[order]
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(head, len(rows)))
        total = np.add.reduceat(weight[rows], head)
        equal = key[head] % 3 == 1
        depth_of = depth[head] + equal
        keep = total >= least
        for d in np.unique(depth_of[keep & equal]):
            on = keep & equal & (depth_of == d)
            yield int(d), rows[head[on]], total[on]
        stay = np.repeat(keep & (depth_of < len(matrix)), size)
        part = np.repeat(np.arange(len(head)), size)[stay]
        rows = rows[stay]
        alive = matrix[depth_of[part], rows] >= 0
        rows, part = rows[alive], part[alive]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases of three words or more with their counts, of pointers with their numbers."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    rows = pa.Table.from_batches(got).combine_chunks()
    columns = [rows.column(c).combine_chunks() for c in ("lang", *(f"w{d}" for d in range(LONGEST)))]
    codes = pa.concat_arrays(columns).dictionary_encode()
    symbols = np.split(codes.indices.fill_null(-1).to_numpy().astype(np.int64), LONGEST + 1)
    names = codes.dictionary.to_pylist()
    for depth, row, n in quicksorted(symbols, rows.column("n").to_numpy(), LEAST):
        if depth > 3:  # the language and three words
            words = [[names[i] for i in symbols[d][row]] for d in range(1, depth)]
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in symbols[0][row]], pa.string()), pa.array(list(map(list, zip(*words))), pa.list_(pa.string())), pa.array(n, pa.int64())], names=["lang", "words", "f"])


def phrase_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored tables of the innermost scratch block: lang, words, f of every phrase that may be scored and of its words; and lang, n."""
    packs = packed(docs, PACK_BYTES)
    buckets = buckets_for(packs, BUCKET_BYTES)
    marks, totals = frequent_totals(packs, lambda pack: Pointers(pack).keys(), LEAST, buckets)
    both = packs.join(marks, "pack", "left")
    words = [f"w{d}" for d in range(LONGEST)]

    def send(row: dict) -> Iterator[pa.RecordBatch]:
        yield _pointer_rows(Pack(row), row["marks"], buckets)

    rows = both.mapInArrow(each(send), "lang string, " + ", ".join(f"{w} string" for w in words) + ", key long, n long")
    pointers = stored(rows.groupBy("lang", *words, "key").agg(F.sum("n").alias("n")))
    n = pointers.where("w0 IS NULL").select("lang", "n")
    named = pointers.where("key IS NOT NULL").join(totals, "key").select("lang", F.array_compact(F.array("w0", "w1")).alias("words"), "f")
    routed = pointers.where("key IS NULL AND w0 IS NOT NULL").repartition(buckets, "lang", "w0", "w1")
    return stored(routed.mapInArrow(_counted, "lang string, words array<string>, f long").unionByName(named)), n


def scored(counts: DataFrame, n: DataFrame, top: int = TOP) -> DataFrame:
    """The best ``top`` phrases of each language."""
    size, part = F.size("words"), lambda a, k: F.slice("words", a, k)
    phrases = counts.where(size > 1)
    parts = counts.select("lang", F.col("words").alias("part"), F.col("f").alias("part_f"))
    cut = phrases.select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.select("*", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, size - F.col("k")).alias("rest"))
    side = lambda name, f: parts.select("lang", F.col("part").alias(name), F.col("part_f").alias(f))
    cut = cut.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    score = F.expr("(CAST(a AS DECIMAL(20,0)) * CAST(2000000 AS DECIMAL(7,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    best = cut.withColumn("score", score).groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inner = phrases.where(size > 2).select("lang", "words", "f", F.explode(F.sequence(F.lit(2), size - 1)).alias("k"))
    inner = inner.select("lang", "words", "f", "k", F.explode(F.sequence(F.lit(1), size - F.col("k") + 1)).alias("i"))
    inner = inner.select("lang", F.slice("words", F.col("i"), F.col("k")).alias("words"), "f").groupBy("lang", "words").agg(F.max("f").alias("longer"))
    kept = best.join(inner, ["lang", "words"], "left").where(F.expr(f"longer IS NULL OR CAST(longer AS DECIMAL(20,0)) * 100 < CAST(a AS DECIMAL(20,0)) * {NESTED}"))
    kept = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", "best.l", "best.r", "best.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: phrases whose words occur together more than apart."""
    with scratch(docs.sparkSession):
        return stored(scored(*phrase_counts(docs), top), keep=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS words FROM w, range(1, 5) t(k) WHERE len(w) >= k
), c AS (
  SELECT lang, k, words, count(*) AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang
), q AS (
  SELECT lang, k, words, f AS a FROM c WHERE k > 1 AND f >= 30
), x AS (
  SELECT lang, k, words, a, unnest(range(1, k)) AS i FROM q
), s AS (
  SELECT x.lang, x.k, x.words, a, i, l.f AS l, r.f AS r, (2000000::HUGEINT * a // (l.f::HUGEINT + r.f))::BIGINT AS score
  FROM x JOIN c l ON l.lang = x.lang AND l.words = x.words[1:i] JOIN c r ON r.lang = x.lang AND r.words = x.words[i + 1:x.k]
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, i) = 1
), d AS (
  SELECT lang, words[i:i + j - 1] AS words, max(a) AS longer FROM (SELECT lang, k, words, a, j, unnest(range(1, k - j + 2)) AS i FROM q, range(2, 4) t(j) WHERE j < k) GROUP BY ALL
), e AS (
  SELECT b.lang, array_to_string(b.words, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN d ON d.lang = b.lang AND d.words = b.words WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM e JOIN n USING (lang) QUALIFY rank <= 2000
"""

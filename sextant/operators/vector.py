"""Hashed embeddings, exact vector search and reranking over parquet indexes."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from ..functions.digest import PREFIX, composed_revision, frame, framed_sha256_of, point_id, tree_revision
from ..sources.tables import stored
from ..functions.text import nfc

TOKEN_DOMAIN = "sextant-token-v1"
REVISION_DOMAIN = "sextant-provider-v1"
POINT_BLOCK, QUERY_BLOCK = 4_096, 256
#: Rows whose bucket counts are held at once in a task.
COUNT_ROWS = 1_024
#: Characters that are no token of their own: spaces, marks, full-width punctuation, bullets.
IGNORED = (
    "\u00a0\u2002\u2003\u2009\u200b\u200c\u200d\u3000\ufeff"
    "、。，．·；：？！…‥—―～－"
    "「」『』（）〈〉《》【】〔〕〖〗“”‘’"
    "•‣‧⁃・･‐‑‒–"
)
TOKEN = "[a-z0-9]+|[^\\x00-\\x7f" + IGNORED + "]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: Column, exact: bool = True) -> Column:
    return F.regexp_extract_all(F.translate(nfc(text) if exact else text, UPPER, LOWER), F.lit(f"({TOKEN})"), F.lit(1))


def bucket(token: Column, dimension: int, domain: str = TOKEN_DOMAIN) -> Column:
    """The first eight digest bytes as an unsigned number, modulo the dimension."""
    first = F.substring(F.sha2(F.concat(F.lit(domain), token), 256), 1, 16)
    return (F.conv(first, 16, 10).cast("decimal(20,0)") % dimension).cast("int")


#: Tokens whose buckets a task remembers.
REMEMBERED = 200_000


class _Buckets(dict):
    """The bucket of each token, hashed once while it is remembered."""

    def __init__(self, dimension: int, domain: str):
        self.dimension, self.domain = dimension, domain.encode()

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        digest = hashlib.sha256(self.domain + (token.lower() if token.isascii() else token).encode()).digest()
        found = self[token] = int.from_bytes(digest[:8], "big") % self.dimension
        return found


def _counted(docs: DataFrame, key: str, text: str, dimension: int, exact: bool, domain: str) -> DataFrame:
    """key, bucket, n of every bucket, 0 as well, of keys with a token: texts are counted where they are read, counts move by key."""
    kind = docs.select(key).schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, buckets = re.compile(TOKEN.replace("a-z", "A-Za-z", 1)).findall, _Buckets(dimension, domain)
        for batch in batches:
            for at in range(0, batch.num_rows, COUNT_ROWS):
                part = batch.slice(at, COUNT_ROWS)
                keys = part.column(0).dictionary_encode(null_encoding="encode")
                counts = np.zeros((len(keys.dictionary), dimension), np.int64)
                for i, t in zip(keys.indices.to_pylist(), part.column(1).to_pylist()):
                    if t:
                        t = t if not exact or t.isascii() else unicodedata.normalize("NFC", t)
                        counts[i] += np.bincount(np.array([buckets[x] for x in find(t)], np.int64), minlength=dimension)
                held = counts.any(axis=1)
                cut = pa.array(np.arange(held.sum() + 1) * dimension, pa.int32())
                yield pa.RecordBatch.from_arrays([keys.dictionary.filter(pa.array(held)), pa.ListArray.from_arrays(cut, pa.array(counts[held].ravel()))], names=[key, "c"])

    schema = StructType([StructField(key, kind), StructField("c", ArrayType(LongType()))])
    rows = docs.select(key, text).mapInArrow(run, schema).repartition(key).select(key, F.posexplode("c").alias("bucket", "c"))
    return rows.groupBy(key, "bucket").agg(F.sum("c").alias("n"))


def bucket_counts(docs: DataFrame, key: str, text: str, dimension: int, exact: bool = True, domain: str = TOKEN_DOMAIN) -> DataFrame:
    """key, bucket, n of the buckets that a key's tokens fall into."""
    return _counted(docs, key, text, dimension, exact, domain).where("n > 0")


def embed(text: Column, dimension: int) -> Column:
    """Unit vector of bucket counts of a short composed text (see ``nfc``); null for text without a token."""
    hashed = F.transform(tokens(text, exact=False), lambda t: bucket(t, dimension))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.size(F.filter(hashed, lambda b: b == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(counts, lambda x: x / norm))


def embed_rows(docs: DataFrame, key: str, text: str, dimension: int, exact: bool = True) -> DataFrame:
    """key, vector: the same vectors by one pass over bucket counts, for long texts."""
    n = F.col("n").cast("double")
    counts = _counted(docs, key, text, dimension, exact, TOKEN_DOMAIN).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("bucket", n.alias("n")))).alias("m"), F.sqrt(F.sum(n * n)).alias("_norm"))
    return counts.select(key, F.transform("m", lambda x: x["n"] / F.col("_norm")).alias("vector"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


@F.pandas_udf(DoubleType())
def exact_dot(a: pd.Series, b: pd.Series) -> pd.Series:
    """Inner products with exactly rounded sums."""
    return pd.Series([math.fsum(x * y for x, y in zip(u, v)) for u, v in zip(a, b)])


def search(points: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, top_k: int, store: bool = False) -> DataFrame:
    """query_key, rank (from 0), key, score: exact search of a stated query set over all points.

    Points and queries are packed in hashed blocks of bounded size. Every query block
    meets every point block (an equi-join on the point block), and only the best
    ``top_k`` per query and point block are shuffled to the final ranking. ``store``: points
    that cost more than a table are stored first, as they are counted, then packed.
    """
    if top_k < 1:
        raise ValueError("top_k is at least 1")
    points = stored(points.select(key, vector)) if store else points
    kinds, asked_kinds = dict(points.dtypes), dict(queries.dtypes)
    schema = f"{query_key} {asked_kinds[query_key]}, {key} {kinds[key]}, score double"
    parts, asked_parts = max(1, -(-points.count() // POINT_BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))

    def packed(rows: DataFrame, n: int, k: str, v: str, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64(k), F.lit(n)).cast("int").alias(f"{name}_part")
        return rows.groupBy(block).agg(F.collect_list(k).alias(f"{name}_keys"), F.collect_list(F.col(v).cast("array<double>")).alias(f"{name}_vectors"))

    asked = packed(queries, asked_parts, query_key, query_vector, "q").withColumn("p_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pairs = asked.join(packed(points, parts, key, vector, "p"), "p_part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for q_keys, q_vectors, p_keys, p_vectors in zip(*(pdf[c] for c in ("q_keys", "q_vectors", "p_keys", "p_vectors"))):
                x, keys = np.array(p_vectors.tolist(), dtype=np.float64), np.asarray(p_keys)
                for name, v in zip(q_keys, q_vectors):
                    s = (x * np.asarray(v)).sum(axis=1)
                    top = np.lexsort((keys, -s))[:top_k]
                    yield pd.DataFrame({query_key: [name] * len(top), key: keys[top], "score": s[top]})

    found = pairs.select("q_keys", "q_vectors", "p_keys", "p_vectors").mapInPandas(run, schema)
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < top_k).select(query_key, "rank", key, "score")


def rerank(candidates: DataFrame, query_key: str, key: str, vector: str, query_vector: str, top_k: int, cosine: bool = False) -> DataFrame:
    """query_key, rank, key, score of candidates that come with their query's vector; ``cosine``: by angle alone, 0 for a zero vector."""
    a, b = F.col(vector), F.col(query_vector)
    score = dot(a, b) if not cosine else F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))
    scored = candidates.select(query_key, key, score.alias("score"))
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < top_k)


def ranks_are_sound(ranked: DataFrame, query_key: str, key: str) -> DataFrame:
    """Queries whose ranks have gaps, repeats or a wrong order: empty for a sound result."""
    w = Window.partitionBy(query_key).orderBy("rank")
    before, before_key = F.lag("score").over(w), F.lag(key).over(w)
    bad = (F.col("rank") != F.row_number().over(w) - 1) | (F.col("score") > before) | ((F.col("score") == before) & (F.col(key) <= before_key))
    return ranked.withColumn("_bad", F.coalesce(bad, F.col("rank") != 0)).groupBy(query_key).agg(F.max("_bad").alias("bad")).where("bad")


@dataclass(frozen=True)
class Descriptor:
    """What an embedding provider states about itself; its digest is the embedding's revision."""

    provider_id: str
    version: str
    dimension: int
    metric: str = "cosine"
    deterministic: bool = True
    network: bool = False
    normalised: bool = True
    semantic: bool = False
    contract: str = "embedding-v1"
    kind: str = "embedding"

    def revision(self, domain: str = REVISION_DOMAIN) -> str:
        """Digest over every field: providers that could give different vectors have different revisions."""
        return framed_sha256_of(domain.encode(), *(f"{f.name}={getattr(self, f.name)}".encode() for f in sorted(fields(self), key=lambda f: f.name)))


@dataclass(frozen=True)
class Stack:
    """An embedding and a reranker chosen by name, of one dimension and metric."""

    embedding: Descriptor
    embed: Callable[[Column, int], Column]
    reranker: Descriptor

    def __post_init__(self) -> None:
        if self.embedding.kind != "embedding" or self.reranker.kind != "reranker":
            raise ValueError("a stack has one embedding and one reranker")
        if self.embedding.metric != self.reranker.metric:
            raise ValueError("embedding and reranker differ in metric")

    @property
    def revision(self) -> str:
        return self.embedding.revision()

    def vectors(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        return docs.select(key, self.embed(nfc(F.col(text)), self.embedding.dimension).alias("vector"))


class ProviderRegistry:
    """Providers by explicit names: no default, no override, deterministic and offline only."""

    def __init__(self) -> None:
        self._held: dict[str, tuple[Descriptor, object]] = {}

    def register(self, name: str, descriptor: Descriptor, embed_column) -> None:
        if name in self._held:
            raise ValueError(f"provider {name} is registered")
        if descriptor.network or not descriptor.deterministic or not descriptor.normalised:
            raise ValueError(f"provider {name} is not admissible")
        self._held[name] = (descriptor, embed_column)

    def get(self, name: str):
        if name not in self._held:
            raise KeyError(name)
        return self._held[name]


def deterministic_registry(dimension: int, embedding: str, reranker: str) -> ProviderRegistry:
    """The two offline providers, hashed token counts and the cosine of their vectors, under names of the caller's."""
    registry = ProviderRegistry()
    registry.register(embedding, Descriptor("hash-embedding", "1", dimension), embed)
    registry.register(reranker, Descriptor("cosine-reranker", "1", dimension, kind="reranker"), None)
    return registry


def deterministic_stack(dimension: int, embedding: str, reranker: str) -> Stack:
    """Both providers as the registry gives them back."""
    registry = deterministic_registry(dimension, embedding, reranker)
    (first, column), (second, _) = registry.get(embedding), registry.get(reranker)
    return Stack(first, column, second)


#: What anything that stands for an index must offer.
INDEX_METHODS = ("rebuild", "search", "snapshot", "restore", "wipe")


def require_index(index: object) -> None:
    """Refuse, before it is used, what is no index."""
    missing = [name for name in INDEX_METHODS if not callable(getattr(index, name, None))]
    if missing or not hasattr(index, "revision"):
        raise TypeError(f"no index: {', '.join(missing or ['revision'])} missing")


def point_uuid(point: Column) -> Column:
    """A point's id as a UUID, for stores that take no other: the first 32 of its hex digits."""
    return F.regexp_replace(F.lower(F.substring(point, 1, 32)), "\\A(.{8})(.{4})(.{4})(.{4})(.{12})\\z", "$1-$2-$3-$4-$5")


def as_float32(v: Column) -> Column:
    """A vector as a store of single precision gives it back."""
    return F.transform(v, lambda x: x.cast("float").cast("double"))


@F.pandas_udf(BinaryType())
def _packed(v: pd.Series) -> pd.Series:
    return v.map(lambda x: struct.pack(f">{len(x)}d", *x))


def points(notes: DataFrame, vectors: DataFrame, domain: str) -> DataFrame:
    """Index points of admitted notes (path, digest_key, content_sha256) and their vectors (path, vector)."""
    rows = notes.join(vectors.where("vector is not null"), "path")
    return rows.select(point_id(F.col("digest_key"), domain).alias("point_id"), "digest_key", "path", "content_sha256", "vector")


def payload_digest(rows: DataFrame) -> DataFrame:
    """revision: tree digest over every stored field of every point, vectors bit by bit."""
    content = F.sha2(F.concat(*(frame(F.col(c)) for c in ("point_id", "digest_key", "path", "content_sha256")), frame(_packed(F.col("vector")))), 256)
    return tree_revision(rows.select(F.col("point_id").alias("key"), content.alias("content_sha256")), "payload")


def differing(held: DataFrame, plan: DataFrame) -> DataFrame:
    """point_id, s and p: digests of the vectors of points that are not equal, bit by bit, in both frames."""
    digest = lambda rows, name: rows.select("point_id", F.sha2(_packed(F.col("vector")), 256).alias(name))
    return digest(held, "s").join(digest(plan, "p"), "point_id", "full_outer").where(~F.col("s").eqNullSafe(F.col("p")))


#: What a snapshot states of its points.
SEAL = ("payload", "bundle", "embedding", "schema", "composed", "indexed")


class ParquetIndex:
    """A vector index in a parquet folder: rebuild, search, verify, wipe. Searching before a rebuild is an error."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.revision = spark, path, None

    def rebuild(self, rows: DataFrame) -> str:
        """Write the points, read them back, and compare digests."""
        bad = rows.agg(F.count_if(~F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))).alias("n"), F.count_distinct(F.size("vector")).alias("d"), F.count("*").alias("all"), F.count_distinct("point_id").alias("ids")).first()
        if bad.n or bad.d > 1 or bad["all"] != bad.ids:
            raise ValueError("points have non-finite or uneven vectors or repeated ids")
        rows.write.mode("overwrite").parquet(self.path)
        self.revision = payload_digest(self.points()).first().revision or PREFIX
        return self.revision

    def points(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def snapshot(self, path: str, bundle: str, embedding: str, schema: str, domain: str) -> None:
        """Write the points and, beside them, what they were built from; ``reopen`` reads both."""
        if self.revision is None:
            raise RuntimeError("the index is not built")
        sealed = (self.revision, bundle, embedding, schema, composed_revision(bundle, embedding, schema, domain), self.points().count())
        self.points().write.parquet(f"{path}/points")
        self.spark.createDataFrame([sealed], f"{', '.join(f'{c} string' for c in SEAL[:-1])}, {SEAL[-1]} long").coalesce(1).write.json(f"{path}/seal")

    @classmethod
    def reopen(cls, spark: SparkSession, path: str, domain: str, point_domain: str) -> ParquetIndex:
        """The index of a snapshot; an error if its points or what it states of them were changed."""
        seal = spark.read.schema(f"{', '.join(f'{c} string' for c in SEAL[:-1])}, {SEAL[-1]} long").json(f"{path}/seal").collect()
        index = cls(spark, f"{path}/points")
        rows = index.points()
        bad = rows.agg(
            F.count("*").alias("n"), F.count_if(F.col("point_id") != point_id(F.col("digest_key"), point_domain)).alias("ids"), F.count_distinct(F.size("vector")).alias("widths"),
            F.count_if(~F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))).alias("odd"),
        ).first()
        if len(seal) != 1 or bad.n != seal[0].indexed or bad.ids or bad.odd or bad.widths > 1:
            raise ValueError("the snapshot is damaged")
        (s,) = seal
        if (payload_digest(rows).first().revision or PREFIX) != s.payload or composed_revision(s.bundle, s.embedding, s.schema, domain) != s.composed:
            raise ValueError("the snapshot was changed")
        index.revision = s.payload
        return index

    def restore(self, other: ParquetIndex) -> str:
        """Replace the points by those of another index."""
        return self.rebuild(stored(other.points()))

    def search(self, queries: DataFrame, query_key: str, query_vector: str, top_k: int) -> DataFrame:
        if self.revision is None:
            raise RuntimeError("the index is not built")
        width = self.points().select(F.size("vector").alias("n")).limit(1).collect()
        good = F.forall(query_vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(query_vector) == (width[0].n if width else F.size(query_vector)))
        if queries.where(~F.coalesce(good, F.lit(False))).limit(1).count():
            raise ValueError("a query vector is not finite or of another width")
        return search(self.points(), "path", "vector", queries, query_key, query_vector, top_k)

    def differences(self, plan: DataFrame) -> DataFrame:
        """Points of the plan and of the store that are not equal: empty if the store holds the plan."""
        return differing(self.points(), plan)

    def wipe(self) -> None:
        self.spark.createDataFrame([], self.points().schema).write.mode("overwrite").parquet(self.path)
        self.revision = None

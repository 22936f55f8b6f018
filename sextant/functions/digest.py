"""Content digests: the same input gives the same identifier on any host."""

from __future__ import annotations

import hashlib
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = "sha256:"


def frame(c: Column) -> Column:
    """A value's bytes behind their number as eight bytes, most significant first."""
    raw = c.cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw)), 16, "0")), raw)


def framed_sha256(*values: Column) -> Column:
    return F.concat(F.lit(PREFIX), F.sha2(F.concat(*map(frame, values)), 256))


def framed_sha256_of(*values: bytes) -> str:
    """The same digest over a few known values, on the driver."""
    return PREFIX + hashlib.sha256(b"".join(len(v).to_bytes(8, "big") + v for v in values)).hexdigest()


def point_id(key: Column, domain: str) -> Column:
    return F.sha2(F.concat(frame(F.lit(domain)), frame(key)), 256)


def _ordered(domain: str, key: str, content: str) -> Column:
    """Digest of the group's (key, content hash) pairs in order of key."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(content).alias("h")))), lambda x: F.concat(x["k"], F.lit("\0"), x["h"], F.lit("\n")))
    return F.sha2(F.concat(F.lit(f"{domain}\n"), F.array_join(rows, "")), 256)


def flat_revision(members: DataFrame, domain: str, key: str = "key", content: str = "content_sha256") -> DataFrame:
    """revision: one digest over all members in order. One task reads all keys: for bundles, not for corpora."""
    return members.groupBy().agg(F.when(F.count("*") > 0, F.concat(F.lit(PREFIX), _ordered(domain, key, content))).alias("revision"))


#: Members that a range of a tree digest may hold on average.
RANGE_MEMBERS = 4_096


def tree_revision(members: DataFrame, domain: str, key: str = "key", content: str = "content_sha256", by: tuple[str, ...] = ()) -> DataFrame:
    """revision and n of all members (of each group ``by``): digests over the digests of ranges.

    Ranges are cut by the leading hex digits of the key's hash: two, and two more for every
    256 times ``RANGE_MEMBERS`` members. Each level digests at most 256 of the level below
    on average, so no task orders more than a few thousand rows, whichever group is hot.
    """
    total, digits = members.count(), 2
    while total > RANGE_MEMBERS * 256 ** (digits // 2):
        digits += 2
    level = members.withColumn("range", F.substring(F.sha2(F.col(key), 256), 1, digits)).groupBy(*by, "range").agg(_ordered(domain, key, content).alias("digest"), F.count("*").alias("n"))
    while digits > 2:
        digits -= 2
        upper = level.groupBy(*by, F.substring("range", 1, digits).alias("upper"))
        level = upper.agg(_ordered(domain, "range", "digest").alias("digest"), F.sum("n").alias("n")).withColumnRenamed("upper", "range")
    return level.groupBy(*by).agg(F.when(F.count("*") > 0, F.concat(F.lit(PREFIX), _ordered(domain, "range", "digest"))).alias("revision"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def composed_revision(bundle: str, embedding: str, schema: str, domain: str) -> str:
    for value in (bundle, embedding):
        if not value.startswith(PREFIX) or len(value) != len(PREFIX) + 64:
            raise ValueError("revisions are sha256:<64 hex digits>")
    if not schema:
        raise ValueError("the index schema version is empty")
    return framed_sha256_of(domain.encode(), bundle.encode(), embedding.encode(), schema.encode())

"""Paths as another index spells them, and its hits brought back to the members they mean.

The other index drops one leading underscore of each directory's name, so a member has up
to two spellings. A hit counts for a member only if its spelling can mean no other: where
two members, or a member and another file that is there, share one, both are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible(path: Column) -> Column:
    """A path as the other index shows it; the file's own name is left as it is."""
    parts = F.split(path, "/")
    return F.array_join(F.transform(parts, lambda x, i: F.when((i < F.size(parts) - 1) & x.startswith("_"), F.substring(x, 2, 1 << 30)).otherwise(x)), "/")


def plain_hit(raw: Column, scheme: str) -> Column:
    """The path in a hit: ``./path``, ``scheme://collection/path?query``, or the text as it is."""
    text = F.trim(raw)
    rest = F.substring_index(F.substring(text, len(scheme) + 4, 1 << 30), "?", 1)
    inner = F.substring(rest, F.instr(rest, "/") + 1, F.lit(1 << 30))
    return F.when(text.startswith("./"), F.substring(text, 3, 1 << 30)).when(text.startswith(f"{scheme}://") & F.contains(rest, F.lit("/")), inner).otherwise(text)


def spellings(members: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """spelling, path, refused of every spelling of every distinct ``path`` of members.

    ``present``: the files that are there (path), members or not. A member that shares one
    of its spellings is refused in all of them.
    """
    own = members.select("path").distinct()
    every = own.select(F.explode(F.array_distinct(F.array("path", visible(F.col("path"))))).alias("spelling"), "path")
    shared = every.groupBy("spelling").agg(F.min("path").alias("_a"), F.max("path").alias("_b")).where("_a <> _b").select("spelling")
    if present is not None:
        others = present.select(F.col("path").alias("spelling")).distinct().join(own.withColumnRenamed("path", "spelling"), "spelling", "left_anti")
        shared = shared.unionByName(others.join(every.select("spelling").distinct(), "spelling", "left_semi")).distinct()
    bad = every.join(shared, "spelling", "left_semi").select("path").distinct().withColumn("_bad", F.lit(True))
    return every.join(bad, "path", "left").select("spelling", "path", F.coalesce("_bad", F.lit(False)).alias("refused"))


def attributed(hits: DataFrame, spelled: DataFrame, scheme: str) -> DataFrame:
    """query, path, rank: the members that hits (query, rank, raw) mean, each at its first rank."""
    known = spelled.where("NOT refused").select("spelling", "path")
    return hits.withColumn("spelling", plain_hit(F.col("raw"), scheme)).join(known, "spelling").groupBy("query", "path").agg(F.min("rank").alias("rank"))

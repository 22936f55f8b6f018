"""The catalog: projection of admitted notes, filter, facets, pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from ..functions.text import body, frontmatter, heading

#: The scalar fields that a note's metadata is projected to.
SCALARS = ("id", "title", "type", "description", "status", "content_category", "topic_id", "module_id", "candidate_status")
_META = StructType([*(StructField(s, StringType()) for s in SCALARS), StructField("tags", ArrayType(StringType())), StructField("ok", BooleanType())])


def strict_loader():
    import yaml

    class Unique(yaml.SafeLoader):
        """Refuses mappings with repeated or unhashable keys."""

    def mapping(loader, node, deep=False):
        out = {}
        for key_node, value_node in node.value:
            key = loader.construct_object(key_node, deep=True)
            if not isinstance(key, (str, int, float, bool, type(None))) or key in out:
                raise yaml.YAMLError("repeated or unhashable key")
            out[key] = loader.construct_object(value_node, deep=True)
        return out

    Unique.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    return yaml, Unique


@F.pandas_udf(_META)
def metadata(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Fields of a frontmatter given as lines; a wrongly typed value is null, an unreadable map is not ok."""
    yaml, loader = strict_loader()
    for series in batches:
        rows = []
        for lines in series:
            try:
                data = yaml.load("\n".join(lines), loader) if lines is not None else None
                ok = isinstance(data, dict) and all(isinstance(k, str) for k in data)
            except (yaml.YAMLError, ValueError, RecursionError):
                ok = False
            data = data if ok else {}
            tags = data.get("tags")
            row = {s: data.get(s) if isinstance(data.get(s), str) else None for s in SCALARS}
            rows.append(row | {"tags": tags if isinstance(tags, list) and all(isinstance(t, str) for t in tags) else None, "ok": ok})
        yield pd.DataFrame(rows, columns=[*SCALARS, "tags", "ok"])


def public_commit(c: Column) -> Column:
    return F.when(F.regexp_like(c, F.lit(r"\A[0-9a-f]{7,64}\z")), c)


def project(notes: DataFrame, index_revision: str, bundle_commit: str | None = None) -> DataFrame:
    """Catalog entries of admitted notes (path, text); notes whose metadata cannot be read are left out."""
    commit = bundle_commit if bundle_commit and re.fullmatch(r"[0-9a-f]{7,64}", bundle_commit) else None
    concept = F.regexp_replace("path", r"\.md\z", "")
    rows = notes.withColumn("_m", metadata(frontmatter(F.col("text"))["lines"])).where("_m.ok")
    citation = F.struct(concept.alias("concept_id"), F.col("path"), F.lit(index_revision).alias("index_revision"), F.lit(commit).cast("string").alias("bundle_commit"))
    return rows.select(concept.alias("concept_id"), *(F.col(f"_m.{s}").alias(s) for s in SCALARS), F.col("_m.tags").alias("tags"), heading(body(F.col("text"))).alias("heading_title"), body(F.col("text")).alias("body"), citation.alias("citation"))


def of_type(entries: DataFrame, type_: str | None) -> DataFrame:
    return entries if type_ is None else entries.where(F.col("type") == type_)


def facet(entries: DataFrame, column: str) -> DataFrame:
    """value, n of every non-null value."""
    return entries.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def page(entries: DataFrame, limit: int = 20, offset: int = 0, type_: str | None = None, key: str = "concept_id") -> DataFrame:
    """The entries of one page in order, with total and next_offset (null on the last page)."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1 to 100 and offset not negative")
    chosen = of_type(entries, type_)
    total = chosen.count()
    following = offset + limit if offset + limit < total else None
    rows = chosen.orderBy(key).offset(offset).limit(limit)
    return rows.withColumns({"total": F.lit(total).cast("long"), "next_offset": F.lit(following).cast("long")})

"""Files as tables: notes, exports, queue records; and what is set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import nfc
from ..schemas import EXPORT, EXPORT_ZONES
from .tables import placed


def read_notes(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """path (relative), digest_key, content, content_sha256 of the files below ``root``; unsafe paths are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.substring_index("path", f"{base}/", -1)
    good = (path != "") & ~path.startswith("/") & ~F.contains(path, F.lit("\0")) & ~F.regexp_like(path, F.lit(r"(\A|/)\.{1,2}(/|\z)"))
    return rows.where(good).select(path.alias("path"), nfc(path).alias("digest_key"), "content", F.sha2("content", 256).alias("content_sha256"))


def member_order(notes: DataFrame) -> DataFrame:
    """Notes with their place in the order in which a bundle lists its members: by digest key, then path."""
    return placed(notes, "digest_key", "path")


def read_members(spark: SparkSession, root: str, wanted: DataFrame, glob: str = "*.md") -> DataFrame:
    """wanted (path, and sha256 if it is to be verified) with content, or why it is refused: path, missing or changed.

    A path may be given below ``root`` or in full; one that is neither, or that steps out of
    the folder, is refused before anything is looked up.
    """
    base = root.rstrip("/").split(":", 1)[-1]
    base = "/" + base.lstrip("/")
    inner = F.when(F.col("path").startswith(base + "/"), F.substring("path", len(base) + 2, 1 << 30)).otherwise(F.col("path"))
    unsafe = inner.isNull() | (inner == "") | inner.startswith("/") | F.contains(inner, F.lit("\0")) | F.regexp_like(inner, F.lit(r"(\A|/)\.{0,2}(/|\z)"))
    rows = wanted.withColumn("_inner", F.when(~unsafe, inner))
    notes = read_notes(spark, root, glob).select(F.col("path").alias("_inner"), "content", "content_sha256")
    refusal = F.when(F.col("_inner").isNull(), "path").when(F.col("content").isNull(), "missing")
    if "sha256" in wanted.columns:
        refusal = refusal.when(F.col("sha256") != F.col("content_sha256"), "changed")
    found = rows.join(notes, "_inner", "left").withColumn("refusal", refusal)
    return found.select(*wanted.columns, F.when(F.col("refusal").isNull(), F.col("content")).alias("content"), "refusal")


def probe(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """path, length, modified without reading contents: a change of the bundle shows here first."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return rows.select("path", "length", F.col("modificationTime").alias("modified"))


def read_export(spark: SparkSession, path: str, schema_tag: str) -> DataFrame:
    """zone, zone_no, path, title, status of every export item that names a path; another schema is an error."""
    rows = spark.read.schema(EXPORT).option("multiLine", True).json(path)
    checked = rows.withColumn("zones", F.when((F.col("schema") == schema_tag) & F.col("zones").isNotNull(), F.col("zones")).otherwise(F.raise_error(F.lit("not an export of this schema")).cast(rows.schema["zones"].dataType)))
    items = [checked.select(F.lit(z).alias("zone"), F.lit(i).alias("zone_no"), F.explode(F.col(f"zones.{z}")).alias("x")) for i, z in enumerate(EXPORT_ZONES)]
    out = items[0]
    for more in items[1:]:
        out = out.unionByName(more)
    return out.select("zone", "zone_no", "x.*").where(F.coalesce("path", F.lit("")) != "")


def read_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Queue records in JSON lines, and the lines that are none, to be set aside."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    bad = F.col("_corrupt").isNotNull() | F.col("operation_id").isNull()
    return rows.where(~bad).drop("_corrupt"), rows.where(bad).select(F.coalesce("_corrupt", F.to_json(F.struct("*"))).alias("line"))


def write_aside(rows: DataFrame, path: str) -> None:
    """Append to the quarantine folder; nothing there is overwritten."""
    rows.write.mode("append").text(path)

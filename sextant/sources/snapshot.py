"""Snapshots of a note folder, frozen manifests, and the plan's binding to live files."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digest import tree_revision
from ..functions.text import frontmatter
from .notes import probe, read_notes
from .tables import stored

_SHA = re.compile(r"[0-9a-f]{64}")


@dataclass
class SnapshotCache:
    """Notes of a folder as a stored table, kept while neither names, lengths nor times of its files change.

    ``get`` looks before and after reading and tries again if they differ; equal content
    under a new probe keeps the held frame.
    """

    spark: SparkSession
    root: str
    domain: str = "sextant-index-v1"
    attempts: int = 3
    _held: tuple | None = field(default=None, repr=False)

    def _look(self) -> tuple:
        seen = probe(self.spark, self.root).agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "length", "modified").cast("decimal(38,0)")).alias("h")).first()
        return (seen.n, seen.h)

    def get(self) -> tuple[DataFrame, str | None]:
        """The notes and their revision (None for an empty folder)."""
        for _ in range(self.attempts):
            before = self._look()
            if self._held and self._held[0] == before:
                return self._held[1:]
            notes = stored(read_notes(self.spark, self.root))
            revision = tree_revision(notes.select(F.col("digest_key").alias("key"), "content_sha256"), self.domain).first().revision
            if self._look() == before:
                same = self._held and self._held[2] == revision
                self._held = (before, *self._held[1:]) if same else (before, notes, revision)
                return self._held[1:]
        raise RuntimeError("the folder keeps changing")

    def peek(self) -> tuple[DataFrame, str | None] | None:
        return self._held[1:] if self._held else None

    def invalidate(self) -> None:
        self._held = None


def read_manifest(spark: SparkSession, text: str) -> DataFrame:
    """path, sha256, type of a manifest in TOML: ``[[notes]]`` with exactly these keys, paths in order and once."""
    notes = tomllib.loads(text).get("notes")
    if not isinstance(notes, list) or not notes:
        raise ValueError("the manifest lists no notes")
    for note in notes:
        if set(note) != {"path", "sha256", "type"} or not _SHA.fullmatch(str(note["sha256"])):
            raise ValueError("a manifest entry has other keys or no digest")
    paths = [n["path"] for n in notes]
    if paths != sorted(set(paths)):
        raise ValueError("manifest paths are repeated or out of order")
    return spark.createDataFrame([(n["path"], n["sha256"], n["type"]) for n in notes], "path string, sha256 string, type string")


def bind(manifest: DataFrame, notes: DataFrame) -> DataFrame:
    """The manifest's notes; an error if one is missing, differs or is not public.

    notes: path, content, content_sha256, privacy, type.
    """
    rows = manifest.select("path", "sha256", F.col("type").alias("wanted")).join(notes, "path", "left")
    good = F.coalesce((F.col("sha256") == F.col("content_sha256")) & (F.col("privacy") == "public") & (F.col("type") == F.col("wanted")), F.lit(False))
    bad = [r.path for r in rows.where(~good).select("path").orderBy("path").limit(5).collect()]
    if bad:
        raise ValueError(f"the manifest does not hold for {', '.join(bad)}")
    return rows.drop("sha256", "wanted")


def enforce_allowlist(manifest: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """The manifest, if it lists exactly the allowed paths in their order; else an error."""
    found = tuple(r.path for r in manifest.select("path").limit(len(allowed) + 1).collect())
    if found != tuple(allowed):
        raise ValueError("the manifest lists other paths than are allowed")
    return manifest


#: Fixed value: note types that no manifest may bind.
FORBIDDEN_TYPES = ("Student Reference",)


def forbidden(notes: DataFrame) -> DataFrame:
    """Notes (path, text) whose frontmatter declares a forbidden type, whatever their privacy class."""
    lines = F.coalesce(frontmatter(F.col("text"))["lines"], F.array().cast("array<string>"))
    value = lambda x: F.regexp_replace(F.regexp_extract(x, r"^type:\s*(.*?)\s*$", 1), r"^(['\"])(.*)\1$", "$2")
    return notes.where(F.exists(lines, lambda x: value(x).isin(*FORBIDDEN_TYPES)))


def read_descriptor(text: str | None) -> dict:
    """The bundle's descriptor in TOML; empty if there is none or it cannot be read."""
    try:
        return tomllib.loads(text) if text is not None else {}
    except tomllib.TOMLDecodeError:
        return {}


def revision_row(spark: SparkSession, cache: SnapshotCache, api: str, expected_profile: str | None, descriptor: dict) -> DataFrame:
    """profile_version, api_version, index_revision and where each comes from; a folder that keeps changing has unknown ones."""
    try:
        revision = cache.get()[1]
    except RuntimeError:
        revision, descriptor = None, {}
    stated = descriptor.get("profile_version")
    profile, source = (str(stated), "bundle") if stated else (expected_profile, "config") if expected_profile else (None, "unknown")
    row = (profile, source, api, "code", revision, "computed" if revision else "unknown")
    return spark.createDataFrame([row], "profile_version string, profile_source string, api_version string, api_source string, index_revision string, index_source string")

"""The engine's front: catalog, query and context over one gated snapshot, with and without a grant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import query_tokens, snippet
from .operators import access, catalog, context, lexical, privacy
from .sources.snapshot import SnapshotCache


class KnowledgeGateway:
    """Reads one note folder through one gate; every answer names the revision that it comes from."""

    def __init__(self, snapshots: SnapshotCache, admissible: tuple[str, ...] = ("public",), bundle_commit: str | None = None):
        self.snapshots, self.admissible, self.bundle_commit = snapshots, admissible, bundle_commit

    def entries(self) -> DataFrame:
        notes, revision = self.snapshots.get()
        if revision is None:
            raise RuntimeError("the catalog is unavailable: the folder has no notes")
        return catalog.project(privacy.admitted(privacy.classify(notes), self.admissible), revision, self.bundle_commit)

    def catalog(self, limit: int = 20, offset: int = 0, type_: str | None = None) -> DataFrame:
        return catalog.page(self.entries(), limit, offset, type_).drop("body")

    def facets(self, type_: str | None = None) -> DataFrame:
        chosen = catalog.of_type(self.entries(), type_)
        return catalog.facet(chosen, "type").withColumn("facet", F.lit("type")).unionByName(catalog.facet(chosen, "content_category").withColumn("facet", F.lit("content_category")))

    def query(self, text: str, limit: int = 10) -> DataFrame:
        """rank, concept_id, id, title, type, score, snippet, citation, total."""
        return _ranked(self.entries(), text, limit)


def _ranked(entries: DataFrame, text: str, limit: int) -> DataFrame:
    text = text.strip()
    if not 1 <= len(text) <= 256:
        raise ValueError("a query has 1 to 256 characters")
    ranked = lexical.search(lexical.entry_fields(entries), "concept_id", [("q", text)], limit)
    tokens = F.array(*map(F.lit, query_tokens(text)))
    rows = ranked.join(entries, "concept_id").withColumn("snippet", snippet("body", tokens))
    return rows.select("rank", "concept_id", "id", "title", "type", "score", "snippet", "citation", "total").orderBy("rank")


class ScopedGateway:
    """The same under a resolved grant (a row of ``access.resolve`` without a denial)."""

    def __init__(self, gateway: KnowledgeGateway, bindings: DataFrame, grant, domain: str):
        if gateway.bundle_commit is None:
            raise ValueError("scoped reads need a bundle commit")
        if grant is None or domain not in grant.domains:
            raise PermissionError("domain-denied")
        self.gateway, self.bindings, self.grant, self.domain = gateway, bindings, grant, domain

    def _entries(self, capability: str) -> DataFrame:
        if capability not in self.grant.capabilities:
            raise PermissionError("capability-denied")
        scoped = KnowledgeGateway(self.gateway.snapshots, tuple(self.grant.privacy_classes), self.gateway.bundle_commit)
        return access.in_domain(scoped.entries(), self.bindings, self.domain)

    def catalog(self, limit: int = 20, offset: int = 0, type_: str | None = None) -> DataFrame:
        return catalog.page(self._entries("read"), limit, offset, type_).drop("body")

    def query(self, text: str, limit: int = 10) -> DataFrame:
        return _ranked(self._entries("read"), text, limit)

    def allowed_paths(self) -> DataFrame:
        """For offline readers: the paths of this scope and when it ends."""
        return self._entries("read").select("citation.path", F.lit(self.grant.expires_at).alias("expires_at")).orderBy("path")

    def context(self, text: str) -> DataFrame:
        ranked = _ranked(self._entries("read"), text, context.MOST_ITEMS)
        rows = ranked.select(F.lit("q").alias("qid"), "rank", "concept_id", "title", "snippet", "citation.path", "citation.index_revision", "citation.bundle_commit", "total")
        return context.pack(rows, self.grant.max_items, self.grant.max_bytes)

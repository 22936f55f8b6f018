"""Snapshots, manifests, and the gateway over a folder of notes."""

from __future__ import annotations

import datetime as dt
import hashlib
from types import SimpleNamespace

import pytest

from sextant.gateway import KnowledgeGateway, ScopedGateway
from sextant.operators import privacy
from sextant.sources.notes import read_notes
from sextant.sources.snapshot import SnapshotCache, bind, read_manifest


def _note(privacy_, title, body, id_):
    return f"---\nprivacy: {privacy_}\ntitle: {title}\ntype: Concept\nid: {id_}\n---\n{body}\n"


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "notes"
    root.mkdir()
    (root / "kettle.md").write_text(_note("public", "Kettle", "kettle kettle", "n1"))
    (root / "secret.md").write_text(_note("sensitive", "Kettle", "kettle " * 50, "n2"))
    (root / "tea.md").write_text(_note("public", "Tea", "a long note on tea " * 40 + "kettle", "n3"))
    return root


def test_gateway_serves_admitted_notes_only(spark, folder):
    gateway = KnowledgeGateway(SnapshotCache(spark, str(folder)))
    got = gateway.query("Kettle").collect()
    assert [r.concept_id for r in got] == ["kettle"] or [r.concept_id for r in got] == ["kettle", "tea"]
    assert got[0].citation.path == "kettle.md" and got[0].citation.index_revision.startswith("sha256:")
    assert [r.concept_id for r in gateway.catalog(1).collect()] == ["kettle"] and "body" not in gateway.catalog().columns
    assert {(r.facet, r.value, r.n) for r in gateway.facets().collect()} == {("type", "Concept", 2)}
    with pytest.raises(ValueError):
        gateway.query("   ")
    score = got[0].score
    (folder / "other.md").write_text(_note("internal", "Kettle", "kettle " * 500, "n4"))
    again = KnowledgeGateway(SnapshotCache(spark, str(folder))).query("Kettle").first()
    assert again.score == score and again.citation.index_revision != got[0].citation.index_revision  # refused rows change no statistic


def test_snapshot_follows_the_folder(spark, folder):
    cache = SnapshotCache(spark, str(folder))
    assert cache.peek() is None
    first = cache.get()
    assert cache.get() == first == cache.peek()
    (folder / "new.md").write_text("x")
    assert cache.get()[1] != first[1] and cache.get()[0].count() == 4
    cache.invalidate()
    assert cache.peek() is None
    (folder / "empty").mkdir()
    with pytest.raises(RuntimeError):
        KnowledgeGateway(SnapshotCache(spark, str(folder / "empty"))).entries()


def test_scope_limits_what_is_read(spark, folder):
    bindings = spark.createDataFrame([("n1", "finance"), ("n2", "finance"), ("n3", "social-circle")], "note_id string, domain string")
    grant = SimpleNamespace(domains=["finance"], capabilities=["read"], privacy_classes=["public", "sensitive"], max_items=2, max_bytes=600, expires_at=dt.datetime(2030, 1, 1))
    gateway = KnowledgeGateway(SnapshotCache(spark, str(folder)), bundle_commit="0123abc")
    scoped = ScopedGateway(gateway, bindings, grant, "finance")
    assert [r.path for r in scoped.allowed_paths().collect()] == ["kettle.md", "secret.md"]
    assert {r.concept_id for r in scoped.query("kettle").collect()} <= {"kettle", "secret"}
    row = scoped.context("kettle").first()
    assert row.used <= 600 and "bundle_commit=0123abc" in row.context
    with pytest.raises(PermissionError):
        ScopedGateway(gateway, bindings, grant, "social-circle")
    grant.capabilities = []
    with pytest.raises(PermissionError):
        scoped.catalog()
    with pytest.raises(ValueError):
        ScopedGateway(KnowledgeGateway(gateway.snapshots), bindings, grant, "finance")


def test_manifest_binds_or_fails(spark, folder):
    sha = hashlib.sha256((folder / "kettle.md").read_bytes()).hexdigest()
    text = f'[[notes]]\npath = "kettle.md"\nsha256 = "{sha}"\ntype = "Concept"\n'
    from pyspark.sql import functions as F

    notes = privacy.classify(read_notes(spark, str(folder))).withColumn("type", F.lit("Concept"))
    assert bind(read_manifest(spark, text), notes).count() == 1
    with pytest.raises(ValueError, match=r"kettle\.md"):
        bind(read_manifest(spark, text.replace(sha, "0" * 64)), notes)
    for bad in ("", text + text, text.replace("type", "kind"), text.replace(sha, "xyz")):
        with pytest.raises(ValueError):
            read_manifest(spark, bad)

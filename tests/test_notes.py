"""Privacy, text framing, catalog and sources on hand-written notes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sextant.functions.text import body, compact, fold, heading, snippet, strip_frontmatter, word_count
from sextant.operators import catalog, privacy
from sextant.sources.notes import read_export, read_notes, read_records, write_aside

CASES = {
    "plain": ("---\nprivacy: internal\n---\nx", "internal"), "quoted": ('---\nprivacy: "internal"\n---\n', "internal"), "crlf": ("---\r\nprivacy: public\r\n---\r\n", "public"),
    "none": ("no frontmatter", "frontmatter-missing"), "long": ("----\nprivacy: public\n---\n", "frontmatter-missing"), "open": ("---\nprivacy: public\n", "frontmatter-unterminated"),
    "absent": ("---\ntitle: x\n---\nprivacy: public", "privacy-missing"), "nested": ("---\na:\n  privacy: public\n---\n", "privacy-missing"), "twice": ("---\nprivacy: sensitive\nprivacy: public\n---\n", "privacy-duplicate"),
    "case": ("---\nprivacy: Public\n---\n", "privacy-invalid"), "list": ("---\nprivacy: [public]\n---\n", "privacy-invalid"), "comment": ("---\nprivacy: public # x\n---\n", "privacy-invalid"),
    "tight": ("---\nprivacy:public\n---\n", "privacy-invalid"), "mixed": ("---\nprivacy: 'public\"\n---\n", "privacy-invalid"), "separator": ("---\nprivacy: public \n---\n", "privacy-invalid"),
}


def test_declared_classes(spark):
    rows = spark.createDataFrame([(k, v.encode()) for k, (v, _) in CASES.items()] + [("bytes", b"---\nprivacy: public\n---\n\xff")], "path string, content binary")
    got = {r.path: r.privacy or r.reason for r in privacy.classify(rows).collect()}
    assert got == {k: want for k, (_, want) in CASES.items()} | {"bytes": "note-unreadable"}


def test_gate_refuses_and_counts_everything(spark):
    rows = spark.createDataFrame([(c, None) for c in privacy.CLASSES] + [(None, "privacy-missing")], "privacy string, reason string")
    got = {r.privacy: (r.admitted, r.reason) for r in privacy.gate(rows, ("public", "internal")).collect()}
    assert got == {"public": (True, None), "internal": (True, None), "sensitive": (False, "privacy-not-admissible"), "student-private": (False, "student-private-sink"), None: (False, "privacy-missing")}
    with pytest.raises(ValueError):
        privacy.gate(rows, ("public", "student-private"))
    assert [r.x for r in rows.select(privacy.is_at_least(F.col("privacy"), "internal").alias("x")).collect()][:4] == [False, True, True, True]


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(fold(F.lit("Straße ﬁ"))) == "strasse fi" and value(compact(F.lit(" a \n b\x1f "))) == "a b"
    assert value(word_count(F.lit(" a b  c\x1cd "))) == 4
    assert value(body(F.lit("---\na: b\n---\nrest\n---\nmore"))) == "rest\n---\nmore" and value(body(F.lit("---\nopen"))) == "" and value(body(F.lit("plain"))) == "plain"
    assert value(strip_frontmatter(F.lit("---\na\n---\n\n\ntext"))) == "text" and value(strip_frontmatter(F.lit("---x\n---y"))) == "y" and value(strip_frontmatter(F.lit("---\nopen"))) == "---\nopen"
    assert value(heading(F.lit("x\n# Title  \n# Second"))) == "Title" and value(heading(F.lit("## no"))) is None
    text = "ß" * 400 + " needle " + "x" * 400
    found = value(snippet(F.lit(text), F.array(F.lit("needle"))))
    assert "needle" in found and len(found) == 320 and found[0] == found[-1] == "…"


def test_notes_from_files_to_catalog(spark, tmp_path):
    notes = {
        "a.md": "---\nprivacy: public\ntitle: One\ntype: Concept\ntags: [x, y]\nid: 7\n---\n# Head\ntext", "b/c.md": "---\nprivacy: public\ntitle: Two\ntags: [1]\n---\n", "d.md": "---\nprivacy: internal\n---\n",
        "e.md": "---\nprivacy: public\ntitle: a\ntitle: b\n---\n", "f.txt": "no note",
    }
    for name, text in notes.items():
        path = tmp_path / "bundle" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    rows = read_notes(spark, str(tmp_path / "bundle"))
    assert sorted(r.path for r in rows.collect()) == ["a.md", "b/c.md", "d.md", "e.md"]
    entries = catalog.project(privacy.admitted(privacy.classify(rows)), "r1", "not a commit")
    got = {r.concept_id: r for r in entries.collect()}
    assert set(got) == {"a", "b/c"}  # an internal note, and one with a repeated key, are left out
    assert (got["a"].title, got["a"].tags, got["a"].id, got["a"].heading_title, got["a"].body) == ("One", ["x", "y"], None, "Head", "# Head\ntext")
    assert got["b/c"].tags is None and got["a"].citation.bundle_commit is None and got["a"].citation.index_revision == "r1"
    assert {(r.value, r.n) for r in catalog.facet(entries, "type").collect()} == {("Concept", 1)}
    page = catalog.page(entries, limit=1, offset=0).collect()
    assert (page[0].concept_id, page[0].total, page[0].next_offset) == ("a", 2, 1)
    assert catalog.page(entries, limit=1, offset=1).first().next_offset is None
    with pytest.raises(ValueError):
        catalog.page(entries, limit=0)


def test_exports_and_records(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"schema": "v1", "zones": {"topics": [{"path": "a.md", "title": "t"}, {"path": ""}, {"title": "x"}], "projects": [{"path": "b.md"}]}}')
    got = {(r.zone, r.path, r.title) for r in read_export(spark, str(tmp_path / "e.json"), "v1").collect()}
    assert got == {("topics", "a.md", "t"), ("projects", "b.md", None)}
    with pytest.raises(Exception, match="not an export"):
        read_export(spark, str(tmp_path / "e.json"), "v2").collect()
    (tmp_path / "r.json").write_text('{"operation_id": "o1", "attempts": 2}\nnot json\n{"attempts": 1}\n')
    good, bad = read_records(spark, str(tmp_path / "r.json"), "operation_id string, attempts int")
    assert [r.operation_id for r in good.collect()] == ["o1"] and bad.count() == 2
    write_aside(bad, str(tmp_path / "aside"))
    assert spark.read.text(str(tmp_path / "aside")).count() == 2

"""The end-to-end evaluation, the stored queue, index snapshots, and the rules that guard writes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sextant.operators import access, context, convert, evaluate, outbox, shadow, vector
from sextant.sources import snapshot

ENGINES = ("lexical", "vector")


def _report(spark, failed=None):
    questions = spark.createDataFrame([("q1", "lookup", "real", ["a.md"]), ("q2", "lookup", "synthetic", ["b.md", "c.md"]), ("q3", "no-answer", "synthetic", [])], "qid string, category string, provenance string, expected array<string>")
    rows = [("q1", "lexical", "a.md", True), ("q1", "lexical", "x.md", True), ("q1", "vector", "b.md", True), ("q2", "lexical", "b.md", True), ("q2", "lexical", "c.md", False), ("q3", "vector", "c.md", True)]
    returned = spark.createDataFrame(rows, "qid string, engine string, path string, cited boolean")
    paths = spark.createDataFrame([("a.md",), ("b.md",), ("c.md",)], "path string")
    tokens = spark.createDataFrame([("a.md", 5), ("b.md", 7)], "path string, tokens long")
    return shadow.report(questions, returned, ENGINES, paths, tokens, spark.createDataFrame([("b.md",)], "path string"), failed)


def test_report_by_question_and_engine(spark):
    got = {(r.qid, r.engine): (r.results, r.hit, r.leaks, r.token_cost, r.stale_returned, r.citations_correct) for r in _report(spark).collect()}
    assert got == {
        ("q1", "lexical"): (1, True, 1, 5, False, True), ("q1", "vector"): (1, False, 0, 7, True, True), ("q2", "lexical"): (2, True, 0, None, True, False), ("q2", "vector"): (0, False, 0, 0, False, True),
        ("q3", "lexical"): (0, None, 0, 0, False, True), ("q3", "vector"): (1, None, 0, None, False, True),
    }


def test_summary_has_empty_groups_and_unknowns(spark):
    got = {(r.engine, r.provenance): r.asDict() for r in shadow.summary(_report(spark), ("real", "synthetic", "imported")).collect()}
    assert len(got) == 8
    pooled = got["lexical", None]
    assert (pooled["questions"], pooled["scored"], pooled["hits"], pooled["hit_rate"], pooled["token_total"], pooled["unmeasured"], pooled["leaks"], pooled["stale_excluded"], pooled["no_answer_correct"]) == (3, 2, 2, 1.0, 5, 1, 1, 2, True)
    assert got["vector", "synthetic"]["no_answer_correct"] is False and got["lexical", "real"]["no_answer_correct"] is None
    empty = got["vector", "imported"]
    assert (empty["questions"], empty["hit_rate"], empty["stale_excluded_rate"], empty["token_total"]) == (0, None, None, 0)


def test_gate_from_a_report(spark):
    late = spark.createDataFrame([("lexical", 2.0), ("vector", 1.0)], "engine string, value double")
    one = shadow.gate_summary(_report(spark), "lexical", "vector", "real", late).first()
    assert (one.citation_correct, one.total_questions, one.false_negatives, one.compared, one.scope_overlap) == (2, 3, 1, True, True)
    assert (one.lexical_rate, one.baseline_rate, one.lexical_tokens, one.tokens_unmeasured) == (1.0, 0.0, None, 0)
    items = {r.item: r.status for r in evaluate.gate(shadow.gate_summary(_report(spark), "lexical", "vector", "real", late)).collect()}
    assert items["degenerate_baseline"] == "fail" and items["privacy_false_negative"] == "fail"
    # All or nothing: one question the baseline could not be asked, and none of its measures counts.
    failed = spark.createDataFrame([("q3", "vector")], "qid string, engine string")
    rows = _report(spark, failed)
    assert all(r.results is None and r.hit is None and r.token_cost is None for r in rows.where("engine = 'vector'").collect())
    one = shadow.gate_summary(rows, "lexical", "vector", "real", late).first()
    assert not one.compared and one.baseline_rate is None and one.scope_overlap is None
    assert "lexical_p95" not in shadow.without_latency(shadow.gate_summary(rows, "lexical", "vector", "real", late)).columns


def _ask(spark, rows):
    return spark.createDataFrame(rows, "operation_id string, idempotency_hash string, actor string, created_at int").withColumns({c: F.lit("-") for c in ("task_hash", "target_path", "request_hash")})


def _one_by_one(rows):
    held, out = [], {}
    for op, key, actor, at in sorted(rows, key=lambda r: r[3]):
        met = [h for h in held if h[0] == op or h[1] == key]
        out[at] = "accepted" if not met else "duplicate" if (op, key, actor) in met else "conflict"
        if not met:
            held.append((op, key, actor))
    return out


def test_refused_requests_bind_nothing(spark):
    import random

    rows = [("op1", "k1", "a", 1), ("op2", "k1", "b", 2), ("op2", "k2", "b", 3)]
    assert {r.created_at: r.outcome for r in outbox.enqueue(_ask(spark, rows)).collect()} == {1: "accepted", 2: "conflict", 3: "accepted"}
    rng = random.Random(1)
    rows = [(f"o{rng.randint(0, 12)}", f"k{rng.randint(0, 12)}", rng.choice("ab"), i) for i in range(80)]
    assert {r.created_at: r.outcome for r in outbox.enqueue(_ask(spark, rows)).collect()} == _one_by_one(rows)
    assert outbox.enqueue(_ask(spark, rows).limit(0)).count() == 0


def test_the_stored_queue_keeps_versions(spark, tmp_path):
    schema = "operation_id string, idempotency_hash string, actor string, task_hash string, target_path string, request_hash string, created_at int, state string, attempts int, envelope binary"
    queue = outbox.StoredQueue(spark, str(tmp_path / "queue"), schema)
    first = [("o1", "k1", "a", 1), ("o2", "k2", "a", 2)]
    assert {r.created_at: r.outcome for r in queue.enqueue(_ask(spark, first)).collect()} == {1: "accepted", 2: "accepted"}
    again = queue.enqueue(_ask(spark, [("o1", "k1", "a", 3), ("o3", "k2", "a", 4), ("o3", "k3", "a", 5)]))
    assert {r.created_at: r.outcome for r in again.collect()} == {3: "duplicate", 4: "conflict", 5: "accepted"}
    queue.rewrite(queue.records().where("operation_id = 'o1'").withColumn("state", F.lit("committed")))
    assert {r.operation_id: (r.state, r.version) for r in queue.records().collect()} == {"o1": ("committed", 1), "o2": ("queued", 0), "o3": ("queued", 0)}
    assert [r.outcome for r in queue.find("o1", "k1").collect()] == ["found"] and [r.outcome for r in queue.find("o9", "k2").collect()] == ["conflict"]
    with pytest.raises(ValueError):
        queue.rewrite(queue.records().withColumn("operation_id", F.lit("none")))


def test_stored_records_are_trusted_only_whole(spark):
    base = spark.range(3).withColumns({c: F.lit(c) for c in outbox.BOUND if not c.endswith("_at")}).withColumns({c: F.lit("2024-01-01").cast("timestamp") for c in outbox.BOUND if c.endswith("_at")})
    base = base.withColumns({"record_version": F.lit("1"), "writer_contract": F.lit("w1")}).withColumn("binding_hash", outbox.binding_hash("d"))
    bad = base.withColumn("record_version", F.when(F.col("id") == 1, "9").otherwise(F.col("record_version"))).withColumn("actor", F.when(F.col("id") == 2, "other").otherwise(F.col("actor")))
    assert [r.x for r in bad.orderBy("id").select(outbox.fault("1", "w1", "d").alias("x")).collect()] == [None, "version-unknown", "record-corrupt"]
    codes = spark.createDataFrame([("lint-failed",), ("base-moved",), (None,)], "c string")
    assert [r.x for r in codes.select(outbox.admission_code(F.col("c")).alias("x")).collect()] == ["lint-failed", "internal-error", None]


def test_index_snapshots_reopen_only_unchanged(spark, tmp_path):
    rows = spark.createDataFrame([(f"n{i}", f"n{i}", f"{i:064x}") for i in range(9)], "path string, digest_key string, content_sha256 string")
    vectors = spark.createDataFrame([(f"n{i}", [float(i), 1.0]) for i in range(9)], "path string, vector array<double>")
    index = vector.ParquetIndex(spark, str(tmp_path / "index"))
    index.rebuild(vector.points(rows, vectors, "p"))
    good = "sha256:" + "0" * 64
    index.snapshot(str(tmp_path / "snap"), good, good, "s1", "c")
    again = vector.ParquetIndex.reopen(spark, str(tmp_path / "snap"), "c", "p")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, v array<double>")
    assert again.search(asked, "qid", "v", 1).first().path == "n8" and again.revision == index.revision
    other = vector.ParquetIndex(spark, str(tmp_path / "other"))
    assert other.restore(again) == index.revision
    for bad in ([float("nan"), 0.0], [1.0]):
        with pytest.raises(ValueError):
            again.search(spark.createDataFrame([("q", bad)], "qid string, v array<double>"), "qid", "v", 1)
    for domain, point in (("other", "p"), ("c", "other")):
        with pytest.raises(ValueError):
            vector.ParquetIndex.reopen(spark, str(tmp_path / "snap"), domain, point)
    index.points().limit(5).write.mode("overwrite").parquet(str(tmp_path / "snap/points2"))
    a, b = vector.Descriptor("hash", "1", 16), vector.Descriptor("cosine", "1", 16, kind="reranker")
    assert vector.Stack(a, vector.embed, b).revision == a.revision() != vector.Descriptor("hash", "1", 17).revision()
    with pytest.raises(ValueError):
        vector.Stack(b, vector.embed, a)


def test_paths_facts_and_comparison(spark):
    import posixpath

    raw = ["a/../b", "./a//b/./c", "../x/../../y", "/../a", "//a/b", "///a", "a/..", ".", "", " x ", "a/b/../../..", "./..", "/"]
    want = {p: (lambda v: v if not v else posixpath.normpath(v))((lambda s: s[2:] if s.startswith("./") else s)(p.strip())) for p in raw}
    got = {r.p: r.x for r in spark.createDataFrame([(p,) for p in raw], "p string").select("p", evaluate.plain_path(F.col("p")).alias("x")).collect()}
    assert got == want
    text = "---\nstatus:  'active' \nstatus: done\nlibrary_id: \"\"\ndevelopment_candidate: TRUE\n  privacy: public\nnot a line\n---\nstatus: no"
    one = spark.createDataFrame([(text,)], "t string").select(evaluate.note_facts(F.col("t")).alias("f")).first().f
    assert (one.status, one.candidate, one.library_id, one.privacy) == ("done", True, None, "public")
    assert evaluate.compare_export(spark.range(1), None) == (False, None, None)


def test_writers_and_targets(spark):
    import hashlib

    digest = lambda c: "sha256:" + hashlib.sha256(c.encode()).hexdigest()
    actors = spark.createDataFrame([(digest("A"), "agent:a", True, False), (digest("H"), "human:h", True, True)], "credential_sha256 string, actor string, generated boolean, captured boolean")
    cases = [("A", "r", "t", "generated", "m1", None, "agent:a/m1"), ("A", "r", "t", "generated", None, "model-identity-missing", None), ("A", "r", "t", "generated", "unknown", "model-identity-missing", None), ("A", "r", "t", "captured", None, "actor-denied", None),
             ("H", "r", "t", "captured", None, None, "human:h"), ("H", "r", "t", "generated", "m1", "actor-denied", None), ("", "r", "t", "generated", None, "identity-missing", None), ("A", " ", "t", "generated", "m1", "identity-missing", None), ("X", "r", "t", "generated", "m1", "actor-denied", None), ("A", "r", "t", "both", "m1", "identity-missing", None)]
    rows = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], "i int, credential string, request_id string, task_id string, mode string, model_id string")
    assert {r.i: (r.refusal, r.rendered) for r in access.writers(rows, actors).collect()} == {i: c[5:] for i, c in enumerate(cases)}
    tree = spark.createDataFrame([("a", "folder"), ("a/b", "folder"), ("a/b/x.md", "file"), ("l", "link"), ("a/f", "file")], "path string, kind string")
    targets = spark.createDataFrame([("a/b/new.md",), ("a/b/x.md",), ("l/new.md",), ("a/f/new.md",), ("a/none/new.md",)], "path string")
    assert {r.path: r.refusal for r in convert.create_targets(targets, tree).collect()} == {"a/b/new.md": None, "a/b/x.md": "path-conflict", "l/new.md": "symlink-denied", "a/f/new.md": "path-conflict", "a/none/new.md": "target-denied"}
    changes = spark.createDataFrame([("o1", "p.md", "untracked"), ("o2", "p.md", "untracked"), ("o2", "q.md", "untracked"), ("o3", "p.md", "staged")], "operation_id string, path string, state string")
    asked = spark.createDataFrame([(f"o{i}", "p.md") for i in range(1, 5)], "operation_id string, path string")
    assert sorted(r.operation_id for r in convert.unexpected_changes(changes, asked).collect()) == ["o2", "o3", "o4"]
    checked = convert.validated(spark.createDataFrame([(True, False), (None, False), (True, True)], "a boolean, b boolean"), ("profile", F.col("a")), ("lint", F.col("b")))
    assert [r.refusal for r in checked.collect()] == ["lint", "profile", None]


def test_manifests_and_revisions(spark, tmp_path):
    manifest = spark.createDataFrame([("a.md",), ("b.md",)], "path string")
    assert snapshot.enforce_allowlist(manifest, ("a.md", "b.md")).count() == 2
    for allowed in (("a.md",), ("b.md", "a.md")):
        with pytest.raises(ValueError):
            snapshot.enforce_allowlist(manifest, allowed)
    notes = spark.createDataFrame([("a", "---\ntype: Student Reference\n---\n"), ("b", "---\ntype: 'Student Reference'  \n---\n"), ("c", "---\ntitle: x\n---\ntype: Student Reference"), ("d", None)], "path string, text string")
    assert sorted(r.path for r in snapshot.forbidden(notes).collect()) == ["a", "b"]
    assert snapshot.read_descriptor("profile_version = '2'") == {"profile_version": "2"} and snapshot.read_descriptor("= broken") == snapshot.read_descriptor(None) == {}
    (tmp_path / "bundle").mkdir()
    (tmp_path / "bundle" / "a.md").write_text("x")
    row = snapshot.revision_row(spark, snapshot.SnapshotCache(spark, str(tmp_path / "bundle")), "v1", "9", {}).first()
    assert row.profile_source == "config" and row.index_revision.startswith("sha256:") and row.index_source == "computed"


def test_packing_equals_a_plain_fold(spark):
    def plain(rows, most_bytes):
        out, used, cut = [], "", False
        for r in rows:
            head = ("\n\n" if out else "") + f"[{len(out) + 1}] {r['title'] or r['id']}\n"
            tail = f"\ncitation: concept_id={r['id']}; path={r['id']}.md; bundle_commit=0123abc; index_revision=r"
            room = most_bytes - len((used + head + tail).encode())
            if room < 0:
                break
            text = r["text"]
            if len(text.encode()) > room:
                cut = True
                text = max((text[:n].rstrip() + "…" for n in range(len(text)) if len(text[:n].rstrip().encode()) + 3 <= room), key=len, default="")
            used += head + text + tail
            out.append(text)
        return out, used, cut

    items = [{"id": f"c{i}", "title": "" if i == 1 else f"Täg {i}", "text": " ".join(["wörd", "本本"][j % 2] for j in range(5 * i + 3))} for i in range(5)]
    rows = [("q", i + 1, x["id"], x["title"], x["text"], f"{x['id']}.md", "r", "0123abc", 5) for i, x in enumerate(items)]
    results = spark.createDataFrame(rows, "qid string, rank int, concept_id string, title string, snippet string, path string, index_revision string, bundle_commit string, total long")
    for budget in (1, 95, 100, 104, 130, 220, 333, 420, 1_000):
        row = context.pack(results, 10, budget).first()
        texts, whole, cut = plain(items, budget)
        assert ([x.snippet for x in row["items"]], row.context, row.truncated) == (texts, whole, cut or len(texts) < 5), budget
    with pytest.raises(Exception, match="several revisions"):
        context.pack(results.withColumn("bundle_commit", F.lit(None).cast("string")), 10, 100).collect()


def test_whole_notes_are_converted(spark):
    notes = [
        (1, "---\ntitle: Ä\ntimestamp: 2025-05-01T09:30:00Z\ncitations: [x, y]\nodd: 1\n---\nbody\n---\nmore"), (2, "---\ntimestamp: 2025-05-01\ngenerated: {by: a}\nmetadata_gaps: [id]\n---\n\nkept"), (3, "no front"), (4, "---\nopen"),
        (5, "---\n- a\n---\n"), (6, "---\na: 1\na: 2\n---\n"), (7, "---\ncitations: [x]\nCitations: [y]\n---\n"), (8, None),
    ]
    got = {r.id: r for r in convert.convert_notes(spark.createDataFrame(notes, "id int, text string")).collect()}
    assert got[1].document == "---\ncreated_at: '2025-05-01T09:30:00+00:00'\nlegacy: true\nmetadata_gaps:\n- generated\nodd: 1\nsources:\n- x\n- y\ntitle: Ä\n---\n\nbody\n---\nmore" and got[1].unmapped == ["odd"]
    assert got[2].document == "---\ngenerated:\n  by: a\nlegacy: true\nmetadata_gaps:\n- created_at\n- id\n---\n\n\nkept" and got[2].dropped == ["timestamp"]
    assert {i: got[i].error for i in range(3, 9)} == {3: "no-frontmatter", 4: "unterminated", 5: "not-a-mapping", 6: "not-a-mapping", 7: "conflicting-citations", 8: "no-frontmatter"}
    assert all(got[i].document is None for i in range(3, 9))


def test_the_vector_engine_of_the_report_moves_no_tokens(spark, tmp_path, monkeypatch):
    """What is searched comes by one exchange of counts; that of the gate is the same report."""
    from sextant.plans import queries

    class Seen(Exception):
        pass

    def search(points, *rest):
        raise Seen(points._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(vector, "search", search)
    spark.createDataFrame([(1, "title\napache license", "en", "s", 20)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "view", 1.0)], "event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    for query in (queries.shadow_report, queries.gate_from_report):
        with pytest.raises(Seen) as seen:
            query(spark, str(tmp_path))
        assert str(seen.value).count("Exchange") == 1


def test_the_vector_engine_of_the_report_embeds_once(spark, tmp_path, monkeypatch):
    """Vectors are stored before they are counted and packed, so that texts are not embedded anew for each."""
    from sextant.plans import queries

    spark.createDataFrame([(i, "apache license version", "en", "s", 22) for i in range(1, 5)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(1, 5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    written, store = [], vector.stored
    monkeypatch.setattr(vector, "stored", lambda rows: written.append(rows.columns) or store(rows))
    assert len(queries.shadow_report(spark, str(tmp_path)).collect()) == 10
    assert written == [["doc_id", "vector"]]

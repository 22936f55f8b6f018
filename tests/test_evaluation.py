"""Evaluation, export comparison, queue, conversion, streaming, and the registered queries."""

from __future__ import annotations

import hashlib
import importlib
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from sextant.operators import convert, evaluate, outbox
from sextant.plans import queries
from sextant.streaming.queue import accepted, expired, note_verdicts


def test_percentiles_are_measured_values(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 100)], "k string, v double")
    got = evaluate.latency(rows, "v").first()
    assert (got.total, got.p50, got.p95) == (110.0, 3.0, 100.0)
    empty = evaluate.latency(rows.limit(0), "v").first()
    assert (empty.total, empty.p50, empty.p95) == (0.0, 0.0, 0.0)


def test_rates_keep_unknown_apart_from_zero(spark):
    rows = spark.createDataFrame([("x", ["a"], ["a", "b"]), ("x", ["a", "c"], ["a"]), ("y", [], ["a"])], "p string, e array<string>, r array<string>")
    got = {(r.p, r.pooled): (r.questions, r.scored, r.hits, r.rate) for r in evaluate.hit_rates(rows.withColumn("hit", evaluate.hit(F.col("e"), F.col("r"))), "p").collect()}
    assert got == {("x", False): (2, 2, 1, 0.5), ("y", False): (1, 0, 0, None), (None, True): (3, 2, 1, 0.5)}
    returned = spark.createDataFrame([("q1", "a"), ("q1", "b"), ("q2", "a"), ("q2", "z")], "q string, path string")
    tokens = spark.createDataFrame([("a", 3), ("b", 4)], "path string, tokens long")
    assert {r.q: r.token_cost for r in evaluate.token_cost(returned, tokens, "q", "path").collect()} == {"q1": 7, "q2": None}
    assert evaluate.leaks(returned, tokens, "path").count() == 1 and evaluate.false_positives(tokens, returned, "path").count() == 0
    flags = spark.createDataFrame([(None, None, "a"), ("p", "a", None), ("p", "a", "a"), ("p", "a", "b")], "p string, x string, y string")
    assert [r.f for r in flags.select(evaluate.stale_flag(F.col("p"), F.col("x"), F.col("y")).alias("f")).collect()] == [False, None, False, True]


SUMMARY = {"citation_correct": 10, "total_questions": 10, "false_negatives": 0, "compared": True, "scope_overlap": True, "lexical_rate": 0.9, "baseline_rate": 0.8, "baseline_scored": 5, "baseline_hits": 4, "lexical_tokens": 90, "baseline_tokens": 100, "tokens_unmeasured": 0, "lexical_p95": 20.0, "baseline_p95": 10.0}
TYPES = "citation_correct long, total_questions long, false_negatives long, compared boolean, scope_overlap boolean, lexical_rate double, baseline_rate double, baseline_scored long, baseline_hits long, lexical_tokens long, baseline_tokens long, tokens_unmeasured long, lexical_p95 double, baseline_p95 double"


@pytest.mark.parametrize(("change", "item", "status", "verdict"), [
    ({}, "answerable_hit_rate", "pass", "pass"), ({"citation_correct": 9}, "citation_correctness", "fail", "fail"), ({"false_negatives": 1}, "privacy_false_negative", "fail", "fail"), ({"compared": False}, "baseline_compared", "fail", "fail"),
    ({"compared": False}, "latency_p95", "not_evaluable", "fail"), ({"scope_overlap": None}, "baseline_scope_overlap", "pass", "pass"), ({"scope_overlap": False}, "baseline_scope_overlap", "fail", "fail"), ({"lexical_rate": 0.7}, "answerable_hit_rate", "fail", "fail"),
    ({"tokens_unmeasured": 1}, "context_token_total", "not_evaluable", "pass"), ({"lexical_p95": 20.1}, "latency_p95", "fail", "fail"), ({"baseline_hits": 0}, "degenerate_baseline", "fail", "fail"), ({"baseline_hits": 0}, "answerable_hit_rate", "not_evaluable", "fail"),
    ({}, "stale_exclusion", "not_evaluable", "pass"), ({}, "privacy_false_positive", "recorded", "pass"),
])
def test_gate(spark, change, item, status, verdict):
    items = evaluate.gate(spark.createDataFrame([tuple({**SUMMARY, **change}.values())], TYPES))
    assert {r.item: r.status for r in items.collect()}[item] == status and evaluate.verdict(items).first().verdict == verdict


def test_zones_paths_and_freshness(spark):
    rows = spark.createDataFrame([("Private/_inbox/info-collect/a.md", None, False, None, "public"), ("Private/Life/x/reports/a.md", None, False, None, None), ("Core/project-a.md", "active", False, "l", "internal"), ("Core/project-a.md", "done", False, "", "internal"), ("Core/_inbox/x/a.md", None, True, "l", "other")], "p string, s string, c boolean, l string, v string")
    got = [r.z for r in rows.select(evaluate.zones(*map(F.col, "pscl"), F.col("v")).alias("z")).collect()]
    assert got == [["knowledge_feed"], ["life_domains"], ["projects", "topics"], [], ["development_candidates"]]
    plain = spark.createDataFrame([("./a//b/./c.md",), ("a/b/c.md",), (" a ",)], "p string").select(evaluate.plain_path(F.col("p")).alias("x"))
    assert [r.x for r in plain.collect()] == ["a/b/c.md", "a/b/c.md", "a"]
    cases = [(None, "a", True, False), ("a", "a", True, True), ("a", "b", True, False), ("a", "b", False, True), ("a", "b", False, False), ("a", "b", None, False)]
    got = [r.v for r in spark.createDataFrame(cases, "e string, l string, x boolean, y boolean").select(evaluate.freshness(*map(F.col, "elxy")).alias("v")).collect()]
    assert got == ["unknown", "current", "stale", "current", "unknown", "unknown"]


def test_export_differences(spark):
    cat = spark.createDataFrame([("a.md", "A", "s", None, ["topics"], "stale"), ("b.md", "B", "s", "cand", ["topics"], "current"), ("c.md", "C", "s", None, [], "stale"), ("d.md", "D", None, None, ["topics"], "unknown"), ("e.md", "E", "s", None, ["topics"], "stale")], "path string, title string, status string, candidate_status string, eligible array<string>, fresh string")
    shown = spark.createDataFrame([("development_candidates", 3, "b.md", "B", "cand"), ("topics", 4, "./d.md", "other", ""), ("topics", 4, "e.md", "E", "s"), ("projects", 2, "e.md", None, None), ("topics", 4, "stray.md", "x", "y")], "zone string, zone_no int, path string, title string, status string")
    got = {r.path: (r.categories, r.reason, r.fields) for r in evaluate.export_diff(cat, shown).collect()}
    assert got == {"a.md": (["missing_from_export"], "freshness", []), "b.md": (["matched_clean"], None, []), "c.md": (["missing_from_export"], "structural", []), "d.md": (["path_mismatch", "metadata_mismatch"], None, ["title"]), "e.md": (["extra_in_export"], None, [])}


def test_queue_dispositions(spark):
    cases = [("base-moved", 4, "retry-transient"), ("base-moved", 5, "quarantine"), ("leader-unavailable", 99, "retry-free"), ("path-conflict", 0, "conflict"), ("idempotency-conflict", 0, "conflict"), ("anything", 0, "quarantine")]
    rows = spark.createDataFrame([(c, a) for c, a, _ in cases], "code string, attempts int")
    assert [r.x for r in rows.select(outbox.disposition(F.col("code"), F.col("attempts"), 5).alias("x")).collect()] == [w for _, _, w in cases]


def test_queue_replay_enqueue_and_binding(spark):
    rows = spark.sql("""SELECT * FROM VALUES ('a', 'committed', 0, null, timestamp'2024-02-01', null), ('b', 'leased', 1, timestamp'2024-01-02', timestamp'2024-02-01', null), ('c', 'leased', 1, timestamp'2024-01-01', timestamp'2024-02-01', 'base-moved'),
      ('d', 'queued', 0, null, timestamp'2024-01-01', null), ('e', 'queued', 0, null, timestamp'2024-02-01', null), ('f', 'queued', 5, null, timestamp'2024-02-01', 'base-moved') AS t(operation_id, state, attempts, lease_until, expires_at, writer_code)""").withColumn("envelope", F.lit(b"x"))
    got = {r.operation_id: (r.step, r.new_state, r.new_attempts, r.new_code, r.envelope is not None) for r in outbox.replay(rows, F.lit("2024-01-01 12:00:00").cast("timestamp")).collect()}
    assert got == {"a": ("skip", "committed", 0, None, False), "b": ("skip", "leased", 1, None, True), "c": ("replay", "queued", 2, "base-moved", True), "d": ("expire", "expired", 0, "record-expired", False), "e": ("replay", "committed", 0, None, False), "f": ("replay", "quarantined", 5, "base-moved", False)}
    ask = spark.createDataFrame([("o1", "k1", "x", 1), ("o1", "k1", "x", 2), ("o1", "k1", "y", 3), ("o2", "k1", "x", 4), ("o3", "k3", "x", 5)], "operation_id string, idempotency_hash string, actor string, created_at int").withColumns({c: F.lit("-") for c in ("task_hash", "target_path", "request_hash")})
    assert {r.created_at: r.outcome for r in outbox.enqueue(ask).collect()} == {1: "accepted", 2: "duplicate", 3: "conflict", 4: "conflict", 5: "accepted"}
    bound = spark.range(2).withColumns({c: F.lit(c) for c in outbox.BOUND if not c.endswith("_at")}).withColumns({c: F.lit("2024-01-01").cast("timestamp") for c in outbox.BOUND if c.endswith("_at")})
    bound = bound.withColumn("binding_hash", outbox.binding_hash("d")).withColumn("actor", F.when(F.col("id") == 0, "other").otherwise(F.col("actor")))
    assert {r.id: r.intact for r in outbox.rebound(bound, "d").collect()} == {0: False, 1: True}


def test_times_need_a_real_offset(spark):
    cases = {"2025-05-01T09:30:00Z": True, "2025-05-01 09:30:00+08:00": True, "2025-05-01T09:30:00+0800": True, "2025-05-01T09:30:00+08": True, "2025-05-01": False, "2025-05-01T09:30:00": False, "2025-05-01x09:30:00Z": False, "2025-02-30T00:00:00Z": False, "2025-05-01T09:30:00+14:00": True, "2025-05-01T09:30:00-14:00": False, "2025-05-01T09:30:00-12:00": True, "2025-99-01T00:00:00Z": False, None: False}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.x for r in rows.select("t", convert.aware(F.col("t")).alias("x")).collect()} == cases


def test_write_targets(spark):
    routes = {"Core/_inbox/": ("public", "internal"), "Private/_inbox/": ("sensitive",)}
    cases = [("Core/_inbox/a.md", "public", None), ("Core/_inbox/a.md", "sensitive", "cross-zone-denied"), ("Private/_inbox/a-b.md", "sensitive", None), ("Core/_inbox/a.md", "student-private", "student-private-denied"), ("Core/_inbox/../a.md", "public", "target-denied"), ("/Core/_inbox/a.md", "public", "target-denied"), ("Core/_inbox/x/a.md", "public", "target-denied"), ("Core/_inbox/a.txt", "public", "target-denied"), ("Core/_inbox/" + "a" * 240 + ".md", "public", "target-denied"), (None, "public", "target-denied"), ("Other/a.md", "public", "target-denied"), ("Core/_inbox/a\\b.md", "public", "target-denied")]
    rows = spark.createDataFrame([(i, p, v) for i, (p, v, _) in enumerate(cases)], "i int, p string, v string")
    assert {r.i: r.x for r in rows.select("i", convert.target_refusal(F.col("p"), F.col("v"), routes).alias("x")).collect()} == {i: w for i, (_, _, w) in enumerate(cases)}


def test_streams(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    for name, text in (("a.md", "---\nprivacy: public\n---\n"), ("b.md", "none"), ("c.md", "---\nprivacy: sensitive\n---\n")):
        (tmp_path / "notes" / name).write_text(text)
    query = note_verdicts(spark, str(tmp_path / "notes")).writeStream.format("memory").queryName("verdicts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp1")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {(r.privacy, r.reason, r.admitted) for r in spark.table("verdicts").collect()} == {("public", None, True), (None, "frontmatter-missing", False), ("sensitive", "privacy-not-admissible", False)}
    spark.createDataFrame([("o1", 0), ("o1", 60), ("o2", 30)], "operation_id string, s int").select("operation_id", F.timestamp_seconds("s").alias("created_at"), F.lit("x").alias("event_type")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("operation_id string, created_at timestamp, event_type string").parquet(str(tmp_path / "in"))
    query = accepted(stream).writeStream.format("memory").queryName("accepted").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.operation_id for r in spark.table("accepted").collect()) == ["o1", "o2"]
    query = expired(stream).writeStream.format("memory").queryName("expired").outputMode("update").option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sum(r.n for r in spark.table("expired").collect()) == 3


def test_every_oracle_has_a_query():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 35


def test_library_does_not_import_the_text_subpackage():
    code = "import sys; import sextant.plans.oracles, sextant.streaming.queue, sextant.sources.notes, sextant.operators.context; assert not [m for m in sys.modules if m.startswith('sextant.llm')]"
    assert subprocess.run([sys.executable, "-c", code], check=False).returncode == 0


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_source_revisions_are_trees_of_hash_ranges(spark, tmp_path, monkeypatch):
    from sextant.functions import digest

    rows = [(3, "c", "a"), (1, "a", "a"), (2, "b", "a"), (2, "a", "a"), (4, "x", "b"), (5, None, "b"), (6, None, "n"), (7, "y", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    head = queries.REVISION_DOMAIN + "\n"

    def tree(members, digits):
        level = {}
        for key, content in sorted(members, key=str):
            level.setdefault(sha(key)[:digits], []).append("" if content is None else f"{key}\0{content}\n")
        level = {k: sha(head + "".join(v)) for k, v in level.items()}
        while digits:
            digits = digits - 2 if digits > 2 else 0
            upper = {}
            for k in sorted(level):
                upper.setdefault(k[:digits], []).append(f"{k}\0{level[k]}\n")
            level = {k: sha(head + "".join(v)) for k, v in upper.items()}
        return "sha256:" + level[""]

    members = lambda s: [(f"{r[0]:012d}", None if r[1] is None else sha(r[1])) for r in rows if r[2] == s]
    for most, digits in ((4_096, 2), (0.01, 4)):  # a second level, as a larger table has it
        monkeypatch.setattr(digest, "RANGE_MEMBERS", most)
        got = queries.source_revisions(spark, str(tmp_path))
        assert {r.source: (r.n, r.revision) for r in got.collect()} == {s: (len(members(s)), tree(members(s), digits)) for s in ("a", "b", "n", None)} and got.columns == ["source", "n", "revision"]


def test_first_seen_types_collect_no_events(spark, tmp_path):
    rows = [(1, 10, "2024-01-02", "view"), (1, 11, "2024-01-01", "click"), (1, 12, "2024-01-01", "view"), (1, 9, "2024-01-01", "error"), (1, 1, None, "signup"), (1, 2, "2024-01-03", None), (2, 5, None, "view"), (2, 6, "2024-01-01", "view"), (2, None, "2024-01-01", "click")]
    spark.createDataFrame(rows, "user_id long, event_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    got = queries.dedup_first_seen(spark, str(tmp_path))
    assert {r.user_id: r.first_seen for r in got.collect()} == {1: "error,click,view,signup", 2: "view,click"}
    assert _plan(got).count("Aggregate [user_id") == 2

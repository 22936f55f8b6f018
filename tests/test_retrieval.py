"""Scorer, cutoff, vectors, access, packing."""

from __future__ import annotations

import math
import struct

import pytest
from pyspark.sql import functions as F

from sextant.functions.digest import composed_revision, flat_revision, framed_sha256, framed_sha256_of, tree_revision
from sextant.functions.text import nfc
from sextant.operators import access, context, lexical, vector

ENTRY = "concept_id string, title string, description string, type string, content_category string, tags array<string>, body string"


def _search(spark, rows, query, limit=10):
    entries = spark.createDataFrame([(i, t, None, None, None, None, b) for i, t, b in rows], ENTRY)
    got = lexical.search(lexical.entry_fields(entries), "concept_id", [("q", query)], limit).orderBy("rank").collect()
    return [r.concept_id for r in got]


def test_compact_notes_win_and_weak_matches_are_cut(spark):
    assert _search(spark, [("b", "Kettle", "kettle " + "pad " * 200), ("a", "Kettle", "kettle"), ("c", "Other", "nothing")], "KETTLE") == ["a", "b"]
    rows = [("target", "Umbra logistics manifest", "umbra logistics manifest"), ("x", "Umbra", "umbra " + "filler " * 400 + "logistics"), ("y", "Note", "filler " * 300 + "umbra logistics"), ("z", "Note", "logistics umbra " + "filler " * 500)]
    assert _search(spark, rows, "umbra logistics manifest") == ["target"]
    assert _search(spark, [("a", "x", "sentinel"), ("b", "y", "nothing")], "sentinel missingword") == []
    assert _search(spark, [("only", "x", "quokka")], "quokka") == ["only"]


def test_repeated_tokens_count_once(spark):
    rows = [("only", "x", "needle"), ("other", "y", "z")]
    assert _search(spark, rows, "needle needle missing") == [] and _search(spark, rows, "needle needle") == ["only"]
    with pytest.raises(ValueError):
        _search(spark, rows, "  ")


def test_statistics_and_scores_by_hand(spark):
    entries = spark.createDataFrame([("a", "ab", None, "t", None, ["u"], "xx needle needle"), ("b", None, None, None, None, None, "")], ENTRY)
    fields = lexical.entry_fields(entries)
    mean = lexical.averages(fields).first()
    assert (mean.title, mean.description, mean.metadata, mean.body) == (1.0, 0.0, 1.5, 8.0)
    row = lexical.scores(fields, "concept_id", [("q", "needle")]).first()
    tf = 1.0 * 2 * 8.0 / 16
    assert (row.concept_id, row.coverage) == ("a", 1) and math.isclose(row.score, tf * 4 / (tf + 3))
    assert lexical.averages(fields.limit(0)).first().body == 0.0


@pytest.mark.parametrize(("scores", "kept"), [([1.0, 0.34], 2), ([1.0, 0.33], 1), ([1.0, 0.75, 0.74], 2), ([1.0, 0.84, 0.60], 2)])
def test_cutoff_depends_on_how_many_compete(spark, scores, kept):
    rows = spark.createDataFrame([("q", i, s) for i, s in enumerate(scores)], "qid string, id int, score double")
    got = lexical.cutoff(rows).collect()
    assert len(got) == kept and all(r.total == kept for r in got)


def test_embeddings_by_the_definition(spark):
    import hashlib

    text = "Café café 日本。a1 a1"
    words = ["caf", "é", "caf", "é", "日", "本", "a1", "a1"]
    counts = [0] * 16
    for w in words:
        counts[int.from_bytes(hashlib.sha256((vector.TOKEN_DOMAIN + w).encode()).digest()[:8], "big") % 16] += 1
    want = [c / math.sqrt(sum(x * x for x in counts)) for c in counts]
    docs = spark.createDataFrame([("d", text), ("e", "。 。")], "path string, text string")
    got = {r.path: r.v for r in docs.withColumn("text", nfc("text")).select("path", vector.embed(F.col("text"), 16).alias("v")).collect()}
    assert got["d"] == want and got["e"] is None
    assert vector.embed_rows(docs, "path", "text", 16).first().vector == want


def test_index_rebuild_search_and_wipe(spark, tmp_path):
    notes = spark.createDataFrame([(f"n{i}", f"n{i}", f"{i:064x}") for i in range(30)], "path string, digest_key string, content_sha256 string")
    vectors = spark.createDataFrame([(f"n{i}", [float(i % 7), float(i % 5), 1.0]) for i in range(29)] + [("n29", None)], "path string, vector array<double>")
    plan = vector.points(notes, vectors, "point-v1")
    index = vector.ParquetIndex(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([("q", [1.0, 0.5, 0.0])], "qid string, v array<double>")
    with pytest.raises(RuntimeError):
        index.search(asked, "qid", "v", 3)
    assert plan.count() == 29 and index.rebuild(plan) == index.rebuild(plan) and index.differences(plan).count() == 0
    got = index.search(asked, "qid", "v", 3).orderBy("rank").collect()
    want = sorted(((-(i % 7 + (i % 5) * 0.5), f"n{i}") for i in range(29)))[:3]
    assert [(-r.score, r.path) for r in got] == want and [r["rank"] for r in got] == [0, 1, 2]
    assert vector.ranks_are_sound(index.search(asked, "qid", "v", 3), "qid", "path").count() == 0
    assert index.differences(plan.limit(5)).count() == 24
    index.wipe()
    assert index.points().count() == 0
    with pytest.raises(ValueError):
        index.rebuild(plan.unionByName(plan))


def test_registry_admits_only_sound_providers():
    registry = vector.ProviderRegistry()
    registry.register("hash", vector.Descriptor("hash", "1", 16), vector.embed)
    for bad in (("hash", vector.Descriptor("hash", "1", 16)), ("net", vector.Descriptor("n", "1", 16, network=True)), ("raw", vector.Descriptor("r", "1", 16, normalised=False))):
        with pytest.raises(ValueError):
            registry.register(*bad, vector.embed)
    with pytest.raises(KeyError):
        registry.get("none")


def test_digests(spark):
    import hashlib

    members = [("a.md", "1" * 64), ("b.md", "2" * 64), ("ä.md", "3" * 64)]
    rows = spark.createDataFrame(members[::-1], "key string, content_sha256 string")
    want = hashlib.sha256(b"v1\n" + b"".join(k.encode() + b"\0" + h.encode() + b"\n" for k, h in sorted(members))).hexdigest()
    assert flat_revision(rows, "v1").first().revision == f"sha256:{want}" and flat_revision(rows.limit(0), "v1").first().revision is None
    assert tree_revision(rows, "v1").first().revision == tree_revision(rows.orderBy("key"), "v1").first().revision != tree_revision(rows.where("key <> 'a.md'"), "v1").first().revision
    many = spark.range(20).selectExpr("cast(id as string) AS key", "sha2(cast(id as string), 256) AS content_sha256", "id % 2 AS g")
    apart = {r.g: (r.n, r.revision) for r in tree_revision(many, "v1", by=("g",)).collect()}
    assert apart == {g: (10, tree_revision(many.where(f"g = {g}"), "v1").first().revision) for g in range(2)}
    assert tree_revision(many.limit(0), "v1").first() == (None, 0)
    one = spark.range(1).select(framed_sha256(F.lit("a"), F.lit("é")).alias("x")).first().x
    assert one == framed_sha256_of(b"a", "é".encode())
    good = "sha256:" + "0" * 64
    assert composed_revision(good, good, "s1", "d").startswith("sha256:")
    with pytest.raises(ValueError):
        composed_revision("sha1:0", good, "s1", "d")


def _grant(**changes):
    base = {"grant_id": "g", "actor": "one", "task_id": "t", "domains": ["finance"], "capabilities": ["read"], "privacy_classes": ["public"], "issued_by": "owner", "issued_at": "2024-01-01", "expires_at": "2024-02-01", "max_items": 5, "max_bytes": 500, "credential_sha256": "c"}
    return {**base, **changes}


def test_grants(spark):
    matrix = spark.createDataFrame([("one", "finance", ["read", "report-generation"]), ("one", "core-engineering", ["read"])], "actor string, domain string, capabilities array<string>")
    cases = [
        ({}, None), ({"issued_by": "x"}, "owner-trust-required"), ({"capabilities": ["publication"]}, "capability-not-served"), ({"capabilities": ["report-generation"]}, "report-requires-read"), ({"privacy_classes": ["student-private"]}, "student-private-scope-denied"),
        ({"domains": ["social-circle"]}, "agent-domain-capability-denied"), ({"domains": ["core-engineering"], "privacy_classes": ["sensitive"]}, "sensitive-core-routing-denied"), ({"max_items": 21}, "grant-malformed"),
    ]
    schema = "grant_id string, actor string, task_id string, domains array<string>, capabilities array<string>, privacy_classes array<string>, issued_by string, issued_at string, expires_at string, max_items int, max_bytes int, credential_sha256 string"
    rows = spark.createDataFrame([tuple(_grant(**c, grant_id=str(i)).values()) for i, (c, _) in enumerate(cases)], schema)
    got = {int(r.grant_id): r.refusal for r in access.validate(rows, matrix, "owner").collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    assert access.eligibility(matrix).count() == 2


def test_first_denial_wins(spark):
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    actors = spark.createDataFrame([(sha("A"), "one"), (sha("B"), "two")], "credential_sha256 string, actor string")
    grants = spark.sql(f"SELECT 'g' AS grant_id, 'one' AS actor, array('finance') AS domains, array('read') AS capabilities, timestamp'2024-01-01' AS issued_at, timestamp'2024-02-01' AS expires_at, '{sha('G')}' AS credential_sha256")
    cases = [("A", "G", "finance", "read", "2024-01-15", None), ("", "G", "finance", "read", "2024-01-15", "missing-credential"), ("X", "G", "finance", "read", "2024-01-15", "invalid-credential"), ("B", "G", "finance", "read", "2024-01-15", "wrong-actor"),
             ("A", "G", "finance", "read", "2023-12-31", "scope-not-active"), ("A", "G", "finance", "read", "2024-02-01", "scope-expired"), ("A", "G", "social-circle", "read", "2024-01-15", "domain-denied"), ("A", "G", "finance", "publication", "2024-01-15", "capability-denied")]
    rows = spark.createDataFrame([(i, a, g, d, [r], t) for i, (a, g, d, r, t, _) in enumerate(cases)], "i int, actor_credential string, grant_credential string, domain string, required array<string>, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = {r.i: (r.denial, r.grant is not None) for r in access.resolve(rows, actors, grants).collect()}
    assert got == {i: (c[-1], c[-1] is None) for i, c in enumerate(cases)}


def test_domains(spark):
    entries = spark.createDataFrame([("a",), (None,), ("b",)], "id string")
    bindings = spark.createDataFrame([("a", "finance"), ("b", "social-circle")], "note_id string, domain string")
    assert [r.id for r in access.in_domain(entries, bindings, "finance").collect()] == ["a"]
    with pytest.raises(ValueError):
        access.in_domain(entries, bindings.unionByName(bindings), "finance")


def test_context_stays_in_its_budget(spark):
    rows = [("q", i + 1, f"c{i}", f"T{i}", "本" * 150 if i == 1 else "word " * 30, f"c{i}.md", "r", "0123abc", 7) for i in range(4)]
    results = spark.createDataFrame(rows, "qid string, rank int, concept_id string, title string, snippet string, path string, index_revision string, bundle_commit string, total long")
    for budget, items in ((900, 4), (520, 3), (64, 0)):
        row = context.pack(results, 10, budget).first()
        assert row.used == len(row.context.encode()) <= budget and row.truncated and len(row["items"]) <= items
        assert all(f"concept_id={x.concept_id};" in row.context for x in row["items"])
    everything = context.pack(results.withColumn("total", F.lit(4).cast("long")), 10, 10_000).first()
    assert len(everything["items"]) == 4 and not everything.truncated
    assert struct.calcsize(">d") == 8
    with pytest.raises(ValueError):
        context.pack(results, 0, 10)


def test_buckets_are_counted_where_texts_are_read(spark):
    """Rows of one key (null as well) count together, keys without a token have none, and no token is a row of a shuffle."""
    texts = [(1, "A b a é É 0x　中文 b"), (1, "a b"), (2, None), (3, ""), (4, "。 - "), (None, "a"), (None, "Z" * 50), (5, "é a"), *((7, "a b") for _ in range(3_000))]
    docs = spark.createDataFrame(texts, "k long, text string")
    for exact in (True, False):
        got = {(r.k, r.bucket): r.n for r in vector.bucket_counts(docs, "k", "text", 16, exact).collect()}
        tokens = docs.select("k", F.explode(vector.tokens(F.col("text"), exact)).alias("t"))
        assert got == {(r.k, r.b): r.n for r in tokens.groupBy("k", vector.bucket(F.col("t"), 16).alias("b")).agg(F.count("*").alias("n")).collect()}
        rows = {r.k: r.vector for r in vector.embed_rows(docs, "k", "text", 16, exact).collect()}
        norm = {k: math.sqrt(sum(n * n for (j, _), n in got.items() if j == k)) for k in rows}
        assert rows == {k: [got.get((k, b), 0) / norm[k] for b in range(16)] for k, _ in got}
    plan = vector.embed_rows(docs, "k", "text", 16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_texts_are_searched_once_a_token(spark):
    """Counts come from one pass over the texts, which are in no expression of a query; overlaps, nulls and wide characters as before."""
    rows = [(1, "aaaa ab", "", "é", "aa\U0001F600aaa"), (2, None, "x", None, "ab ab"), (3, "", "", "", ""), (4, "zz", "q", "ab", "nothing")]
    frame = spark.createDataFrame(rows, "id long, title string, description string, metadata string, body string")
    requests = [("q1", "aa ab"), ("q2", "ab \U0001F600"), ("q3", "missing")]
    found = lexical.scores(frame, "id", requests, exact=False)
    mean = [sum(len(r[i]) for r in rows if r[i] is not None) / sum(r[i] is not None for r in rows) for i in range(1, 5)]
    expected = {}
    for qid, words in requests:
        for key, *texts in rows:
            tf = [0.0 + sum(w * t.count(word) * m / len(t) for t, w, m in zip(texts, lexical.WEIGHTS, mean) if t) for word in words.split()]
            coverage, score = sum(x > 0 for x in tf), sum(x * (lexical.K1 + 1.0) / (x + lexical.K1) for x in tf)
            if score > 0 and coverage >= min(lexical.LEAST_COVERAGE, len(words.split())):
                expected[qid, key] = (pytest.approx(score, rel=1e-12), coverage)
    assert {(r.qid, r.id): (r.score, r.coverage) for r in found.collect()} == expected and expected
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "replace(" not in plan

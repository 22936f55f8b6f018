"""Canonical values, the JSON rule, receipts, spellings, settings and the writer."""

from __future__ import annotations

import hashlib
import json
import random
import struct
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant import settings
from sextant.functions import receipt, values
from sextant.operators import outbox, spelling, vector, writer
from sextant.sources import notes

NUMBERS = [0.0, -0.0, 1.0, 1.5, -2.25, 1e7, 1.2345e10, 1e15, 123456789012345680.0, 1e16, 1.5e16, 1e22, 1e-3, 1e-4, -1.5e-4, 1e-5, 2.5e-7, 1e100, 1.7976931348623157e308, 12345678.9, 99999999.0]


def test_canonical_text_is_that_of_sorted_compact_json(spark):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice('a"\\\n\t\r\b\f\x01\x1fé /<>😀\x7f') for _ in range(8))
    rows = [(i, text(), i % 2 == 0, NUMBERS[i % len(NUMBERS)], {text(): [i, None], "zé": [], "a": None}, ("x" if i % 3 else None, {"y": 1})) for i in range(42)]
    df = spark.createDataFrame(rows, "i long, s string, b boolean, d double, m map<string,array<long>>, st struct<q:string,p:map<string,int>>")
    one = df.select(F.struct("s", "b", "d", "m", "st", "i").alias("x"))
    other = df.select(F.struct("i", "st", "m", "d", "b", "s").alias("x"))
    kind = one.schema["x"].dataType
    digests = []
    for r in one.select("x", values.canonical_json(F.col("x"), kind).alias("c"), values.value_digest(F.col("x"), kind).alias("h")).collect():
        expected = json.dumps(r.x.asDict(True), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        assert r.c == expected and r.h == "sha256:" + hashlib.sha256(expected.encode()).hexdigest()
        digests.append(r.h)
    assert [r.h for r in other.select(values.value_digest(F.col("x"), other.schema["x"].dataType).alias("h")).collect()] == digests
    with pytest.raises(TypeError):
        values.canonical_json(F.col("x"), T.DateType())


def test_values_without_a_text(spark):
    df = spark.createDataFrame([(1.0, [1.0]), (float("nan"), [1.0]), (1.0, [1.0, float("inf")]), (None, None)], "a double, b array<double>")
    kind = df.select(F.struct("a", "b").alias("x")).schema["x"].dataType
    got = df.select(values.value_digest(F.struct("a", "b"), kind).isNull().alias("none"), values.is_json_value(F.struct("a", "b"), kind).alias("ok")).collect()
    assert [(r.none, r.ok) for r in got] == [(False, True), (True, False), (True, False), (False, True)]
    odd = spark.createDataFrame([({1: "a"}, None), ({}, bytearray(b"x")), (None, None)], "m map<int,string>, b binary")
    assert [tuple(r) for r in odd.select(values.is_json_value(F.col("m"), odd.schema["m"].dataType), values.is_json_value(F.col("b"), T.BinaryType())).collect()] == [(False, True), (True, False), (True, True)]


def test_json_faults(spark):
    cases = {
        '{"a":1}': None, "[1,2": "not-json", "{} x": "not-json", "NaN": "not-json", "1e999": "not-finite", '{"a":[-1e400]}': "not-finite", '"1e999"': None, "[" * 60 + "]" * 60: "too-deep", "null": None,
        '{"a":1,"a":2}': "not-json", "": "not-json", '{"a":"[[[["}': None, "{'a':1}": "not-json", "[1,]": "not-json", "01": "not-json", "1.5e3": None, "1]": "not-json", "1,2": "not-json", " 7 ": None, "{}{}": "not-json", '"\\""': None,
    }
    rows = spark.createDataFrame([(t,) for t in cases] + [(None,)], "t string")
    got = {r.t: r.f for r in rows.select("t", values.json_fault(F.col("t"), 50).alias("f")).collect()}
    assert got == {**cases, None: "not-json"}


ID = "01890a5d-ac96-774b-bcce-b302099a8057"
PATH = "Core/_inbox/agent-captures/2024-01-31-my-note.md"
BASE = ["capture_path=" + PATH, "capture_status=created", "capture_surface=core", "capture_git_mode=direct"]
FULL = [*BASE, "capture_contract=3", "capture_concept_id=" + PATH[:-3], "capture_id=" + ID]
PLAN = ["capture_path=" + PATH, "capture_status=planned", "capture_surface=core", "capture_git_mode=isolated", "capture_contract=3", "capture_concept_id=" + PATH[:-3]]


@pytest.mark.parametrize(
    ("lines", "dry", "fault"),
    [
        (BASE, False, None), (FULL, False, None), (PLAN, True, None), (["log: capture_path", *BASE, "done"], False, None), (FULL, True, "status"), (PLAN, False, "status"), (BASE, True, "status"), ([*BASE, "capture_x"], False, "line"),
        ([*BASE, "capture_x=1"], False, "key"), ([*BASE, BASE[0]], False, "repeated"), (BASE[1:], False, "keys"), ([*BASE, "capture_request_id=1"], False, "keys"), ([x.replace("=3", "=2") for x in FULL], False, "contract"),
        ([x.replace("core", "other") for x in BASE], False, "surface"), ([x.replace("direct", "none") for x in BASE], False, "mode"), ([x.replace("my-note", "your-note") for x in BASE], False, "path"),
        ([x.replace("-774b", "-474b") for x in FULL], False, "id"), ([x.upper() if "_id=" in x and "concept" not in x else x for x in FULL], False, "line"), ([x + ".md" if "concept" in x else x for x in FULL], False, "path"), ([], False, "keys"),
    ],
)
def test_receipts(spark, lines, dry, fault):
    lines = [x.replace("CAPTURE_ID", "capture_i d") for x in lines] if fault == "line" and "CAPTURE_ID=" + ID.upper() in lines else lines
    df = spark.createDataFrame([("\r\n".join(lines), "my-note", dry)], "o string, s string, d boolean")
    got = df.select(receipt.receipt(F.col("o"), F.col("s"), F.col("d")).alias("r")).first().r
    if lines and "capture_i d" in " ".join(lines):
        fault = "key"
    assert got.fault == fault and got.path == (PATH if fault is None else None)


def test_spellings_that_mean_two_things_are_refused(spark):
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    members = paths("Core/_inbox/a.md", "Core/_inbox/b.md", "Core/inbox/b.md", "Core/_x/_c.md", "_top.md", "Core/_y/d.md", "Core/_inbox/a.md")
    got = {(r.spelling, r.path): r.refused for r in spelling.spellings(members, paths("Core/y/d.md", "Core/_x/_c.md")).collect()}
    assert got == {
        ("Core/_inbox/a.md", "Core/_inbox/a.md"): False, ("Core/inbox/a.md", "Core/_inbox/a.md"): False, ("Core/_inbox/b.md", "Core/_inbox/b.md"): True, ("Core/inbox/b.md", "Core/_inbox/b.md"): True, ("Core/inbox/b.md", "Core/inbox/b.md"): True,
        ("Core/_x/_c.md", "Core/_x/_c.md"): False, ("Core/x/_c.md", "Core/_x/_c.md"): False, ("_top.md", "_top.md"): False, ("Core/_y/d.md", "Core/_y/d.md"): True, ("Core/y/d.md", "Core/_y/d.md"): True,
    }
    hits = spark.createDataFrame([("q", 1, " ./Core/_inbox/a.md"), ("q", 2, "idx://notes/Core/inbox/a.md?index=n"), ("q", 3, "Core/inbox/b.md"), ("q", 4, "idx://notes"), ("p", 1, "Core/x/_c.md")], "query string, rank int, raw string")
    found = {(r.query, r.path, r.rank) for r in spelling.attributed(hits, spelling.spellings(members), "idx").collect()}
    assert found == {("q", "Core/_inbox/a.md", 1), ("p", "Core/_x/_c.md", 1)}


def test_settings_in_layers(tmp_path):
    defaults = {"index": {"dimension": 64, "name": "main", "rate": 0.5, "strict": True}, "spark": {"sql.shuffle.partitions": 200}}
    one, two = tmp_path / "one.toml", tmp_path / "two.toml"
    one.write_text('[index]\ndimension = 32\nname = "file"\nrate = 1\n')
    two.write_text('[index]\ndimension = "16"\n')
    got = settings.load(defaults, [one, two], {"SEXTANT_INDEX_NAME": "env", "SEXTANT_INDEX_STRICT": "false", "SEXTANT_TOKEN": "x", "HOME": "/"}, reserved=["SEXTANT_TOKEN"])
    assert [got["index", k] for k in ("dimension", "name", "rate", "strict")] == [16, "env", 1.0, False]
    assert [got.origin("index", k) for k in ("dimension", "name", "rate")] == [str(two), "SEXTANT_INDEX_NAME", str(one)] and got.origin("spark", "sql.shuffle.partitions") == "defaults"
    assert got.spark_conf() == {"spark.sql.shuffle.partitions": "200"}
    for text in ("[other]\na = 1\n", "[index]\nother = 1\n", "[index]\ndimension = true\n", "[index]\nname = 1\n", '[index]\ndimension = "x"\n', "index = 1\n", "[index\n"):
        one.write_text(text)
        with pytest.raises(settings.SettingError):
            settings.load(defaults, [one])
    for env in ({"SEXTANT_INDEX_OTHER": "1"}, {"SEXTANT_INDEX_DIMENSION": "1.5"}, {"SEXTANT_INDEX_STRICT": "maybe"}):
        with pytest.raises(settings.SettingError):
            settings.load(defaults, env=env)
    with pytest.raises(settings.SettingError):
        settings.load(defaults, ["a\0b"])


REQUEST = "operation_id string, idempotency_key string, target_path string, frontmatter map<string,string>, body string, actor string, task_id string, provenance_mode string, created_at timestamp, class string"
STORED = "operation_id string, idempotency_hash string, actor string, task_hash string, target_path string, request_hash string, content_hash string, created_at timestamp, state string, attempts int"


def test_the_writer_judges_renders_and_publishes(spark, tmp_path):
    good = ("op-1", "k" * 16, "Core/_inbox/a.md", {"title": 'A "b"', "alpha": None}, "text", "ann", "t1", "generated", "2024-01-02 03:04:05", "public")
    change = lambda **new: tuple(new.get(c.split(" ")[0], v) for c, v in zip(REQUEST.split(", "), good))
    rows = [
        good, change(created_at="2024-01-02 03:04:06"), change(created_at="2024-01-02 03:04:07", body="other"), change(operation_id="Op"), change(operation_id="op-2", idempotency_key="short"), change(operation_id="op-3", task_id=None),
        change(operation_id="op-4", frontmatter={"by": "me"}), change(operation_id="op-5", **{"class": None}), change(operation_id="op-6", **{"class": "sensitive"}), change(operation_id="op-7", target_path="../a.md"),
        change(operation_id="op-8", body="AKIA secret"), change(operation_id="op-9", created_at="2024-01-02 03:04:09"),
    ]
    text = spark.createDataFrame([tuple(str(x) if c.startswith("created_at") else x for c, x in zip(REQUEST.split(", "), r)) for r in rows], REQUEST.replace("created_at timestamp", "created_at string"))
    asked = text.withColumn("created_at", F.col("created_at").cast("timestamp"))
    judged = writer.judged(asked, {"Core/_inbox/": ("public", "internal")}, F.col("class"), ("public", "internal"), ["AKIA"])
    first = judged.where("operation_id = 'op-1'").orderBy("created_at").first()
    assert first.content == '---\nalpha: null\ngenerated:\n  at: "2024-01-02T03:04:05.000000Z"\n  by: "ann"\ntitle: "A \\"b\\""\n---\n\ntext\n'
    body = json.dumps({"operation_id": "op-1", "target_path": "Core/_inbox/a.md", "frontmatter": {"title": 'A "b"', "alpha": None}, "body": "text", "provenance_mode": "generated"}, sort_keys=True, separators=(",", ":"))
    assert first.request_hash == "sha256:" + hashlib.sha256(body.encode()).hexdigest() and first.content_hash == "sha256:" + hashlib.sha256(first.content.encode()).hexdigest()
    queue = outbox.StoredQueue(spark, str(tmp_path / "q"), STORED)
    got = sorted((r.operation_id, str(r.created_at)[-2:], r.status, r.code) for r in writer.execute(queue, judged).collect())
    assert got == sorted([
        ("op-1", "05", "accepted", None), ("op-1", "06", "duplicate", None), ("op-1", "07", "refused", "idempotency-conflict"), ("Op", "05", "refused", "request-invalid"), ("op-2", "05", "refused", "request-invalid"), ("op-3", "05", "refused", "identity-missing"),
        ("op-4", "05", "refused", "provenance-forbidden"), ("op-5", "05", "refused", "privacy-unclassified"), ("op-6", "05", "refused", "privacy-denied"), ("op-7", "05", "refused", "target-denied"), ("op-8", "05", "refused", "secret-detected"), ("op-9", "09", "refused", "idempotency-conflict"),
    ])
    assert [(r.operation_id, r.state) for r in queue.records().collect()] == [("op-1", "queued")]
    again = writer.execute(queue, judged.where("operation_id = 'op-1' AND body = 'text'"))
    assert {r.status for r in again.collect()} == {"duplicate"}


def test_members_are_read_by_safe_paths_and_verified(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("a/x.md", "y.md", "é.md"):
        (tmp_path / name).write_text(name)
    digest = hashlib.sha256(b"y.md").hexdigest()
    root = str(tmp_path)
    wanted = [("a/x.md", None), (f"{root}/y.md", digest), ("y.md", "0"), ("../y.md", None), ("/etc/hosts", None), ("a/./x.md", None), ("none.md", None), (None, None), (root + "/", None)]
    got = notes.read_members(spark, root, spark.createDataFrame(wanted, "path string, sha256 string")).collect()
    assert {(r.path, r.sha256): (r.content and r.content.decode(), r.refusal) for r in got} == {
        ("a/x.md", None): ("a/x.md", None), (f"{root}/y.md", digest): ("y.md", None), ("y.md", "0"): (None, "changed"), ("../y.md", None): (None, "path"), ("/etc/hosts", None): (None, "path"),
        ("a/./x.md", None): (None, "path"), ("none.md", None): (None, "missing"), (None, None): (None, "path"), (root + "/", None): (None, "path"),
    }
    assert [(r.path, r.place) for r in notes.member_order(notes.read_notes(spark, root)).orderBy("place").collect()] == [("a/x.md", 1), ("y.md", 2), ("é.md", 3)]


def test_providers_by_name_and_points_for_other_stores(spark, tmp_path):
    stack = vector.deterministic_stack(8, "e", "r")
    assert stack.embedding.dimension == 8 and stack.revision == vector.deterministic_registry(8, "e", "r").get("e")[0].revision()
    with pytest.raises(ValueError):
        vector.deterministic_stack(8, "same", "same")
    vector.require_index(vector.ParquetIndex(spark, str(tmp_path)))
    with pytest.raises(TypeError):
        vector.require_index(object())
    row = spark.range(1).select(vector.point_uuid(F.lit("0123456789abcdef" * 4)).alias("u"), vector.as_float32(F.array(F.lit(0.1), F.lit(1.0))).alias("v")).first()
    assert row.u == str(uuid.UUID("0123456789abcdef0123456789abcdef")) and row.v == [struct.unpack(">f", struct.pack(">f", 0.1))[0], 1.0]

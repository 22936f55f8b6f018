"""Ancestry over a commit table, and versions published by compare-and-swap."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sextant.operators import history, outbox
from sextant.sources.versions import Versions

EDGES = "id string, n int, parent string"


def _sha(i) -> str:
    return hashlib.sha1(str(i).encode()).hexdigest()


def _commits(spark, parents: dict[int, list[int]]):
    rows = [(_sha(i), j, _sha(p)) for i, ps in parents.items() for j, p in enumerate(ps)] + [(_sha(i), 0, None) for i, ps in parents.items() if not ps]
    return spark.createDataFrame(rows, EDGES)


def _ancestors(parents, b):
    seen, todo = set(), [b]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += parents.get(x, [])
    return seen


@pytest.mark.parametrize("few_edges", [history.FEW_EDGES, -1])
def test_ancestry_equals_a_walk(spark, monkeypatch, few_edges):
    """Merges of several parents, several roots; walked in tasks and by rounds of the frontier."""
    monkeypatch.setattr(history, "FEW_EDGES", few_edges)
    rng = random.Random(5)
    parents = {i: rng.sample(range(max(0, i - 5), i), min(i, rng.choice([0, 1, 1, 1, 2, 3]))) for i in range(45)}
    pairs = [(_sha(a), _sha(b)) for a in range(45) for b in range(45)]
    got = history.ancestry(spark.createDataFrame(pairs, "ancestor string, descendant string"), _commits(spark, parents)).collect()
    expected = {(_sha(a), _sha(b)): a in _ancestors(parents, b) for a in range(45) for b in range(45)}
    assert {(r.ancestor, r.descendant): r.is_ancestor for r in got} == expected


def test_ten_thousand_commits_deep(spark):
    parents = {i: [i - 1] if i else [] for i in range(10_000)} | {20_000: [7_000], 20_001: [20_000, 9_000]}
    commits = _commits(spark, parents)
    per = history.chains(commits).groupBy("chain").agg(F.count("*").alias("n"), F.count_distinct("place").alias("places"), F.max("place").alias("top")).collect()
    assert len(per) == 2 and all(r.n == r.places == r.top + 1 for r in per)
    asked = {(0, 9_999): True, (9_999, 0): False, (8_999, 20_001): True, (9_001, 20_001): False, (7_000, 20_000): True, (7_001, 20_000): False}
    pairs = spark.createDataFrame([(_sha(a), _sha(b)) for a, b in asked], "ancestor string, descendant string")
    assert {(r.ancestor, r.descendant): r.is_ancestor for r in history.ancestry(pairs, commits).collect()} == {(_sha(a), _sha(b)): x for (a, b), x in asked.items()}


def test_prefixes_and_what_is_not_known(spark):
    rows = [("abcd1" + "0" * 35, 0, None), ("abcd2" + "0" * 35, 0, "abcd1" + "0" * 35), ("ffff" + "0" * 36, 0, "eeee" + "0" * 36)]
    commits = spark.createDataFrame(rows, EDGES)
    refs = spark.createDataFrame([("abcd",), ("abcd1",), ("ABCD2",), ("abc",), ("1234",), ("ffff",), (rows[0][0],), (rows[0][0] + "0",), ("ab%d",)], "ref string")
    got = {r.ref: r.commit for r in history.resolve(refs, commits).collect()}
    assert got == {"abcd": None, "abcd1": rows[0][0], "ABCD2": rows[1][0], "abc": None, "1234": None, "ffff": rows[2][0], rows[0][0]: rows[0][0], rows[0][0] + "0": None, "ab%d": None}
    pairs = spark.createDataFrame([(rows[0][0], rows[2][0]), (rows[2][0], rows[2][0]), ("none", rows[0][0]), (rows[2][0], rows[0][0])], "ancestor string, descendant string")
    known = {(r.ancestor[:4], r.descendant[:4]): r.is_ancestor for r in history.ancestry(pairs, commits).collect()}
    assert known == {("abcd", "ffff"): None, ("ffff", "ffff"): True, ("none", "abcd"): None, ("ffff", "abcd"): False}
    notes = [("a", "abcd1", rows[1][0]), ("b", "abcd2", "abcd1"), ("c", "abcd", rows[1][0]), ("d", None, "abcd1"), ("e", "abcd1", "abcd1000"), ("f", "ffff", "abcd1")]
    verdicts = {r.path: r.verdict for r in history.freshness_of(spark.createDataFrame(notes, "path string, export_commit string, last_touch string"), commits).collect()}
    assert verdicts == {"a": "stale", "b": "current", "c": "unknown", "d": "unknown", "e": "current", "f": "unknown"}
    touches = spark.createDataFrame([("x", "c1", 1), ("x", "c2", 2), ("y", "c3", 1)], "path string, commit string, at int")
    assert {r.path: r.last_touch for r in history.last_touch(touches).collect()} == {"x": "c2", "y": "c3"}


def test_one_of_two_writers_publishes(spark, tmp_path):
    table, other = (Versions(spark, str(tmp_path / "t"), "a int") for _ in range(2))
    rows = lambda *values: spark.createDataFrame([(v,) for v in values], "a int")
    assert table.head() == -1 and table.read().count() == 0
    assert table.publish(-1, rows(1)) and not other.publish(-1, rows(2)) and other.publish(0, rows(3))
    assert sorted(r.a for r in table.read().collect()) == [1, 3]
    assert table.publish(1, rows(9), whole=True) and table.publish(2, rows(10))
    assert sorted(r.a for r in other.read().collect()) == [9, 10] and sorted(r.a for r in other.read(1).collect()) == [1, 3]
    assert len(list((tmp_path / "t").glob("rows-*"))) == 4  # the loser's rows are gone


QUEUE = "operation_id string, idempotency_hash string, actor string, task_hash string, target_path string, request_hash string, created_at int, state string, attempts int, envelope binary"


def _asked(spark, rows):
    return spark.createDataFrame([(o, k, a, "t", "p", "r", at) for o, k, a, at in rows], "operation_id string, idempotency_hash string, actor string, task_hash string, target_path string, request_hash string, created_at int")


def test_a_base_that_moves_once_is_taken_anew_and_twice_refused(spark, tmp_path, monkeypatch):
    queue, other = (outbox.StoredQueue(spark, str(tmp_path / "q"), QUEUE) for _ in range(2))
    queue.enqueue(_asked(spark, [("o1", "k1", "a", 1), ("o2", "k2", "a", 2)]))
    read = queue.records().withColumn("state", F.lit("leased"))
    other.rewrite(other.records().where("operation_id = 'o1'").withColumn("state", F.lit("committed")))
    assert {r.operation_id: r.outcome for r in queue.rewrite(read).collect()} == {"o1": "base-moved", "o2": "committed"}
    assert {r.operation_id: (r.state, r.version) for r in queue.records().collect()} == {"o1": ("committed", 1), "o2": ("leased", 1)}

    publish, moves = Versions.publish, []

    def late(self, base, rows, whole=False):
        if self is queue.table and len(moves) < wanted:
            moves.append(base)
            other.enqueue(_asked(spark, [(f"x{len(moves)}-{wanted}", f"x{len(moves)}-{wanted}", "b", 10)]))
        return publish(self, base, rows, whole)

    monkeypatch.setattr(Versions, "publish", late)
    wanted = 1
    assert [r.outcome for r in queue.enqueue(_asked(spark, [("o3", "k3", "a", 3)])).collect()] == ["accepted"]
    moves.clear()
    wanted = 2
    assert {r.operation_id: r.outcome for r in queue.enqueue(_asked(spark, [("o4", "k4", "a", 4), ("o3", "k3", "a", 5)])).collect()} == {"o4": "base-moved", "o3": "duplicate"}
    monkeypatch.setattr(Versions, "publish", publish)
    before = sorted(map(str, queue.records().collect()))
    assert queue.compact() and sorted(map(str, other.records().collect())) == before
    assert [r.operation_id for r in outbox.holders(queue.records(), "k1").collect()] == ["o1"]  # committed, and still its key's


@pytest.mark.parametrize(("one_task", "rounds"), [(500_000, 4), (0, 2), (0, 0)])
def test_enqueue_in_one_task_by_rounds_and_by_groups(spark, monkeypatch, one_task, rounds):
    monkeypatch.setattr(outbox, "ONE_TASK", one_task)
    monkeypatch.setattr(outbox, "ROUNDS", rounds)
    rng = random.Random(8)
    chain = [(f"c{i}", f"d{i}", "a", i * 3 + 1) for i in range(30)] + [(f"c{i + 1}", f"d{i}", "a", i * 3 + 2) for i in range(30)]
    rows = chain + [(f"o{rng.randint(0, 20)}", f"k{rng.randint(0, 20)}", rng.choice("ab"), 3 * i) for i in range(150)]
    held, expected = [("o1", "k2", "a"), ("c5", "zz", "a")], {}
    ops, keys = {o: (o, k, a) for o, k, a in held}, {k for _, k, _ in held}
    for o, k, a, at in sorted(rows, key=lambda r: r[3]):
        if o not in ops and k not in keys:
            ops[o], expected[at] = (o, k, a), "accepted"
            keys.add(k)
        else:
            expected[at] = "duplicate" if ops.get(o) == (o, k, a) else "conflict"
    got = outbox.enqueue(_asked(spark, rows), held=_asked(spark, [(*h, 0) for h in held]))
    assert {r.created_at: r.outcome for r in got.collect()} == expected


def test_the_key_index_is_made_whole_from_records(spark):
    name = lambda c: c * 64
    records = spark.createDataFrame([(name("a"), "k1"), (name("b"), "k2"), (name("c"), "k2"), (name("d"), "k4"), ("stray", "k5"), (name("e"), "k6")], "name string, key string")
    index = spark.createDataFrame([("k1", name("a")), ("k2", "torn"), ("k3", name("f")), ("k5", "stray"), ("k6", name("a")), ("k7", None)], "key string, name string")
    got = sorted((r.key, r.action, r.name and r.name[0]) for r in outbox.recovered_index(index, records).collect())
    assert got == [("k1", "kept", "a"), ("k2", "rebuilt", "b"), ("k2", "torn", "t"), ("k3", "lost", "f"), ("k4", "rebuilt", "d"), ("k5", "torn", "s"), ("k6", "kept", "a"), ("k7", "torn", None)]
    assert [(r.name[0], r.place) for r in outbox.scan_order(records).orderBy("place").collect()] == [("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5)]


@pytest.mark.parametrize("few_edges", [history.FEW_EDGES, -1])
def test_serials_bound_the_walk_and_change_no_answer(spark, monkeypatch, few_edges):
    """Only what is not older than the ancestor asked for is walked; a serial that falls is not used; ends of the history count as before."""
    monkeypatch.setattr(history, "FEW_EDGES", few_edges)
    reached = []
    reach = history.reach
    monkeypatch.setattr(history, "reach", lambda *a: reached.append(reach(*a)) or reached[-1])
    rng = random.Random(8)
    parents = {i: sorted(rng.sample(range(max(0, i - 6), i), min(i, rng.choice([1, 1, 2]))), reverse=True) for i in range(60)} | {60: [], 61: [60, 999]}
    order = F.when(F.col("id") == _sha(61), 61)
    for i in range(61):
        order = order.when(F.col("id") == _sha(i), i)
    plain = _commits(spark, parents)
    pairs = [(a, b) for a in range(40, 60) for b in range(40, 60)] + [(59, 61), (61, 61), (60, 61)]
    asked = spark.createDataFrame([(_sha(a), _sha(b)) for a, b in pairs], "ancestor string, descendant string")
    expected = {(_sha(a), _sha(b)): True if a in _ancestors(parents, b) else None if b == 61 else False for a, b in pairs}
    for commits in (plain, plain.withColumn("serial", order), plain.withColumn("serial", -order)):
        assert {(r.ancestor, r.descendant): r.is_ancestor for r in history.ancestry(asked, commits).collect()} == expected
    everything, bounded, falling = (r.count() for r in reached)
    assert bounded < everything == falling

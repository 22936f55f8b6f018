"""Substring deduplication and the Jaccard join against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import subprocess
import sys
from collections import Counter

from pyspark.sql import functions as F

from sextant.llm import op2_substring as sub
from sextant.llm import op9_jaccard as jac

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, h string"


def _frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), "r", "h") for d, t in rows], DOCS)


def _corpus(seed: int, n: int = 70):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(150)]
    rows = []
    for i in range(n):
        kind = i % 7
        words = [word() for _ in range(rng.randint(0, 120))]
        if kind == 1:
            at = rng.randint(0, len(words))
            words[at:at] = passage[rng.randint(0, 20) : rng.randint(45, 60)]
        elif kind == 2:
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = word()
        elif kind == 3:
            words = ["x"] * rng.randint(30, 80)
        elif kind == 4:
            words = words[: rng.randint(0, 6)]
        rows.append((i, rng.choice([" ", "\n", "  ", "\t"]).join(words)))
    rows += [(500, None), (501, ""), (502, " \n "), (9, rows[9][1]), (9, rows[10][1]), (503, rows[2][1].upper()), (504, "é" * 5_000), (None, "no id here")]
    return rows


def _brute_substring(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for (d, _), w in zip(rows, words):
        cut = {k for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in cut)
        out.append((d, len(w), len(cut), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def _substring_digests(spark, rows, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    _frame(spark, rows).write.parquet(path)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in sub.query(spark, str(tmp_path)).collect()), key=str)


def test_substring_equals_brute_force(spark, tmp_path):
    for seed in (1, 2):
        rows = _corpus(seed)
        assert _substring_digests(spark, rows, tmp_path / str(seed)) == _brute_substring(rows)


def test_substring_boundaries_at_every_length(spark, tmp_path):
    shared = [f"s{i}" for i in range(50)]
    rows, n = [], 0
    for length in range(33, 45):
        for side in range(2):
            rows.append((n, " ".join([f"a{n}x{i}" for i in range(7)] + shared[:length] + [f"b{n}x{i}" for i in range(5)])))
            n += 1
    assert _substring_digests(spark, rows, tmp_path) == _brute_substring(rows)


def test_removing_keeps_other_texts_and_columns(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = _frame(spark, [(1, f"intro one\n{long}"), (2, f"{long} other  end"), (3, "kept   as it is\n"), (4, None)])
    got = {r.doc_id: r for r in sub.remove_repeats(docs).collect()}
    assert sub.remove_repeats(docs).columns == docs.columns
    assert got[1].text == "intro one" and got[2].text == "other end" and got[3].text == "kept   as it is\n" and got[4].text is None
    assert got[1].n_chars == 9 and got[1].row == "r"
    assert sub.remove_repeats(docs.limit(0)).count() == 0


def _brute_components(rows):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least.get(root(i), d)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def test_components_equal_brute_force(spark):
    for seed in (3, 4):
        rows = _corpus(seed)
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jac.classes(_frame(spark, rows)).collect()), key=str)
        assert got == _brute_components(rows)


def test_large_groups_of_near_copies(spark):
    """More near copies than a light shingle may have, with edits that put some beyond the threshold."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 30)}"
        rows.append((i, " ".join(words[: rng.randint(100, 120)])))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jac.classes(_frame(spark, rows)).collect()), key=str)
    assert got == _brute_components(rows)


def test_deduplicating_keeps_one_of_each_group_and_every_blank(spark):
    base = " ".join(f"b{i}" for i in range(100))
    docs = _frame(spark, [(5, base), (3, base + " tail"), (9, base), (9, base), (11, None), (12, ""), (12, ""), (13, "alone")])
    kept = jac.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 11, 12, 12, 13]
    assert jac.deduplicate(docs.limit(0)).count() == 0


def test_deduplicating_drops_only_rows_near_one_that_stays(spark):
    """Unrelated texts that share an id, or have none, all stay; a third of the rows may be one row."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(100)) for x in "abcd")
    rows = [(9, a), (9, b), (3, c), (9, c), (None, a + " tail"), (None, d), (None, d), (None, d + " tail"), (None, "one text"), (None, "another text"), (None, None), (None, " \n")]
    kept = sorted(((r.doc_id, r.text) for r in jac.deduplicate(_frame(spark, rows)).collect()), key=str)
    texts = [t for _, t in kept if t not in (d, d + " tail")]
    assert sorted(texts, key=str) == sorted([a, b, c, "one text", "another text", None, " \n"], key=str)
    assert len(kept) == len(texts) + 1 and {(9, a), (9, b), (3, c), (None, "one text"), (None, "another text")} <= set(kept)


def test_deduplicating_copies_under_one_id_keeps_one_row(spark):
    docs = _frame(spark, [(1, "x y z")] * 3 + [(2, "other words")] * 2).withColumn("row", F.concat("row", F.monotonically_increasing_id()))
    assert sorted((r.doc_id, r.text) for r in jac.deduplicate(docs).collect()) == [(1, "x y z"), (2, "other words")]


def test_documents_around_one_template(spark, monkeypatch):
    """500 documents at 60 to 74 % similarity to one another, a few near copies among them: what is verified is counted."""
    rng = random.Random(8)
    base = [f"t{i}" for i in range(400)]
    rows = []
    for i in range(500):
        words = list(base)
        for at in rng.sample(range(400), 14):  # each edit takes five shingles
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[i][1] + f" tail{i}") for i in range(20)]
    verified, real = [], jac.verify

    def counted(pairs, full):
        verified.append(pairs.count())
        return real(pairs, full)

    monkeypatch.setattr(jac, "verify", counted)
    got = {r.doc_id: r.component_id for r in jac.classes(_frame(spark, rows)).collect()}
    assert all(got[i] == i for i in range(500)) and all(got[1000 + i] == i for i in range(20))
    assert sum(verified) <= 40 * len(rows)


def _of_passages(n: int, seed: int = 11):
    """Documents of 6 of 14 passages each and a few words of their own; passages are all that two of them share."""
    rng = random.Random(seed)
    passages = [[f"p{k}w{i}" for i in range(40)] for k in range(14)]
    return [(i, " ".join(w for k in sorted(rng.sample(range(14), 6)) for w in [*passages[k], *(f"o{i}x{k}y{j}" for j in range(2))])) for i in range(n)]


def test_documents_of_shared_passages(spark, monkeypatch):
    """What is verified grows with the documents, not with their pairs, though every shingle but a few has many holders."""
    verified, real = [], jac.verify

    def counted(pairs, full):
        verified.append(pairs.count())
        return real(pairs, full)

    monkeypatch.setattr(jac, "verify", counted)
    for n in (200, 400, 800):
        rows = _of_passages(n)
        verified.clear()
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jac.classes(_frame(spark, rows)).collect()), key=str)
        assert got == _brute_components(rows)
        assert sum(verified) <= 40 * n


def test_atoms_of_unlike_weights_and_noise(spark):
    """Passages of many lengths, some with words changed: the longer prefixes lose no link."""
    rng = random.Random(12)
    passages = [[f"p{k}w{i}" for i in range(rng.randint(8, 70))] for k in range(9)]
    rows = []
    for i in range(150):
        words = [w for k in sorted(rng.sample(range(9), rng.randint(3, 6))) for w in passages[k]]
        for _ in range(rng.choice([0, 0, 1, 3])):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 40)}"
        rows.append((i, " ".join(words)))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jac.classes(_frame(spark, rows)).collect()), key=str)
    assert got == _brute_components(rows)


def test_map_columns_and_one_third_of_all_rows_in_one_component(spark):
    base = " ".join(f"b{i}" for i in range(100))
    docs = _frame(spark, [(i, f"{base} t{i % 3}") for i in range(60)] + [(100 + i, f"text number {i} alone") for i in range(60)])
    docs = docs.withColumn("extra", F.create_map(F.lit("a"), F.col("doc_id")))
    kept = jac.deduplicate(docs.unionByName(docs.where("doc_id = 100")))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, *range(100, 160)]


def test_near_copies_of_one_base_meet_by_what_they_differ_in(spark, tmp_path):
    """Sets that lack runs of one base and share some of what they add: fewer than half as many pairs as links, and none lost."""
    rng, n = random.Random(21), 150
    sets = []
    for _ in range(n):
        shift, mine = rng.randrange(5), set(range(120))
        for at in rng.sample(range(shift, 115, 5), rng.randint(0, 5)):
            mine = mine - set(range(at, at + 5)) | {1_000 + 5 * rng.randrange(40) + i for i in range(5)}
        sets.append(mine)
    node = [(s, len(mine), s, sorted(mine), list(range(len(mine) + 1))) for s, mine in enumerate(sets)]
    spark.createDataFrame(node, "s long, n long, c long, ids array<long>, cum array<long>").write.parquet(f"{tmp_path}/node")
    node = spark.read.parquet(f"{tmp_path}/node")
    state = node.select(F.lit(0).cast("long").alias("key"), "s", F.lit(0).alias("side"), F.lit(0).alias("at"), F.col("n").alias("room"))
    pairs = {(r.s, r.v) for r in jac._apart(state, node).collect()}
    alike = lambda u, v: 100 * len(sets[u] & sets[v]) >= 75 * len(sets[u] | sets[v])

    def classes(links):
        root = list(range(n))
        for u, v in links:
            a, b = root[u], root[v]
            root = [min(a, b) if x in (a, b) else x for x in root]
        return root

    true = [(u, v) for u in range(n) for v in range(u) if alike(u, v)]
    assert classes([p for p in pairs if alike(*p)]) == classes(true)
    assert len(true) > 10 * n and 2 * len(pairs) < len(true), (len(true), len(pairs))


_REMAINS = '''
import ctypes, random, re
import pyarrow as pa
from sextant.llm import op9_jaccard

class Rows:  # gives the function that a worker would run
    select = lambda self, *columns: self
    mapInArrow = lambda self, run, schema: run

op9_jaccard._identified = lambda docs: docs
task = op9_jaccard.prefixes(Rows())
rng = random.Random(3)
words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3_000)]
texts = [" ".join(rng.choices(words, k=1_000)) for _ in range(600)]
batches = lambda: (pa.record_batch({"text": texts[i : i + 300]}) for i in (0, 300))
held = lambda: sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
for _ in task(batches()):
    pass
before = held()
pa.default_memory_pool().release_unused()
ctypes.CDLL(None).malloc_trim(0)
print(before - held())
'''


def test_a_worker_keeps_no_memory_of_an_ended_task():
    """What a worker could still give back after a task over 4 MB of text, in MB: Spark keeps it for later tasks."""
    out = subprocess.run([sys.executable, "-c", _REMAINS], capture_output=True, text=True, check=True, timeout=120)
    assert float(out.stdout) < 8, out.stdout

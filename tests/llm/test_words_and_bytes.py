"""Spelling variants, collocations and suffix-array deduplication against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sextant.llm import induced, op11_variants, op12_collocations, op13_suffix_dedup
from sextant.llm.op12_collocations import quicksorted

DOCS = "doc_id long, text string, lang string, word string, n long, node long, pack long, key string"
_A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _frame(spark, rows):
    """Documents with columns whose names the operators use for their own."""
    return spark.createDataFrame([(d, t, lang, "w", 1, 2, 3, "k") for d, t, lang in rows], DOCS)


def _variants(rows):
    total = Counter()
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(_A_TO_Z)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in total.items() if n >= 3 and len(w) >= 5}
    holes, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :], len(w)].add(w)
            if (x := w[:i] + w[i + 1 :]) in words:
                near[w].add(x), near[x].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {w: best for w in words if near[w] for best in [min(near[w], key=lambda x: (-words[x], x))] if words[best] >= 2 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def _words_corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    long = "".join(rng.choice("abc") for _ in range(700))
    rows = []
    for i in range(80):
        words = []
        for _ in range(rng.randint(0, 120)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = rng.choice(["", "b", "É", "x", "ÿ"])
            words.append("".join(w))
        if i % 8 == 0:
            words += [long, long[:350] + "z" + long[351:], long[1:], "w" * 40, "w" * 41]
        rows.append((i, rng.choice([" ", "1", ", "]).join(words), "en"))
    return [*rows, (None, "alpha beta gamma " * 3, None), (200, None, "en"), (201, "", "en"), (0, rows[0][1], "en"), (0, rows[0][1], "en")]


def test_variants_equal_brute_force(spark):
    rows = _words_corpus(3)
    got = op11_variants.variants(_frame(spark, rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in got.collect()]
    assert set(got) == _variants(rows) and len(got) == len(set(got))


def test_variants_follow_a_chain_and_break_ties(spark):
    words = {"apples": 3, "applesx": 6, "applesxy": 12, "applesxyz": 24, "banana": 3, "bananas": 6, "banane": 6}
    plain = lambda w: [d for d in range(1000) if zlib.crc32(f"{d}:{w}".encode()) % 97]
    rows = [(d, w, "en") for w, n in words.items() for d in plain(w)[:n]]
    got = {r.word: r for r in op11_variants.variants(_frame(spark, rows)).collect()}
    assert got["apples"].root == "applesxyz" and got["apples"].form == "applesx" and got["applesxyz"].form is None
    assert got["banana"].form == "bananas" and got["banana"].n_near == 2


def _collocations(rows, least=30, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(_A_TO_Z)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = set()
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        kept = []
        for p, a in candidates.items():
            if 100 * longer[p] < 80 * a or not longer[p]:
                score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def _phrases_corpus(seed):
    rng = random.Random(seed)
    names = ["north sea", "new york city", "to be or not", "Über das", "a a a a a"]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 90)):
            words.append(rng.choice(names) if rng.random() < 0.3 else rng.choice("abcdefghij") * rng.randint(1, 2))
            if rng.random() < 0.2:
                words.append(rng.choice([".", ",", "\n", "!", "\t", "\x0b"]))
        rows.append((i, " ".join(words), rng.choice(["en", "de", None, "und"])))
    return [*rows, (500, None, "en"), (501, "", None), (502, "...", "fr"), (503, "x " * 40000, "en"), (0, rows[0][1], "en"), (0, rows[0][1], "en")]


def test_collocations_equal_brute_force(spark):
    rows = _phrases_corpus(5)
    got = op12_collocations.collocations(_frame(spark, rows))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = [tuple(r) for r in got.collect()]
    assert set(got) == _collocations(rows) and len(got) == len(set(got)) > 20
    few = {tuple(r) for r in op12_collocations.collocations(_frame(spark, rows), top=3).collect()}
    assert few == _collocations(rows, top=3)


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 7 * 10**15 + 3, 9 * 10**15, 8 * 10**15 + 1
    counts = spark.createDataFrame([("en", ["x"], left), ("en", ["y"], right), ("en", ["x", "y"], a)], "lang string, words array<string>, f long")
    got = op12_collocations.scored(counts, spark.createDataFrame([("en", 10**18)], "lang string, n long")).first()
    assert got.score == 2000000 * a // (left + right)


def test_quicksort_counts_equal_prefixes():
    rng = np.random.default_rng(1)
    matrix = rng.integers(0, 4, (5, 3000))
    matrix[3:, ::3] = -1
    weight = rng.integers(1, 4, 3000)
    expected = Counter()
    for i in range(3000):
        for d in range(1, 6):
            if matrix[d - 1, i] < 0:
                break
            expected[tuple(matrix[:d, i].tolist())] += int(weight[i])
    got = {tuple(matrix[:d, r].tolist()): int(n) for d, rows, ns in quicksorted(list(matrix), weight, 20) for r, n in zip(rows, ns)}
    assert got == {k: n for k, n in expected.items() if n >= 20}


@pytest.mark.parametrize(("budget", "base", "ranges", "step"), [(1 << 20, 1 << 20, 4096, 1 << 20), (0, 0, 4096, 7), (100, 0, 4, 1 << 20)])
def test_suffixes_equal_brute_force(monkeypatch, budget, base, ranges, step):
    """In memory; with every queue and array on disk and all levels of the recursion; with few ranges of letters."""
    monkeypatch.setattr(induced, "STEP", step)
    rng = random.Random(budget)
    for _ in range(150):
        text = [rng.randrange(rng.choice([1, 2, 4, 256])) for _ in range(rng.randint(0, 50))]
        text = text * rng.choice([1, 1, 3]) + [0] * rng.choice([0, 0, 9])
        order = sorted(range(len(text)), key=lambda i: text[i:])
        monkeypatch.setattr(induced, "RANGES", ranges)
        assert induced.suffixes(np.array(text, np.int64), 256, 0, budget, base)[0].tolist() == order
        monkeypatch.setattr(induced, "RANGES", 4096)
        got, common = induced.suffixes(np.array(text, np.uint8), 256, 20, budget, base)
        assert got.tolist() == order
        for k in range(1, len(order)):
            a, b = text[order[k - 1] :], text[order[k] :]
            assert common[k] == min(20, next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))


def _removed(rows):
    texts = sorted({(d is not None, d or 0, t or "") for d, t, _ in rows}, key=lambda x: x[:2])
    seen, cut = set(), {}
    for known, d, text in texts:
        data = text.encode()
        cover = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                cover[i : i + 100] = b"\1" * 100
            seen.add(data[i : i + 100])
        kept = bytes(x for x, c in zip(data, cover) if not c)
        cut[d if known else None, text] = (len(data), sum(cover), len(re.findall(b"\1+", cover)), hashlib.sha256(kept).hexdigest())
    return sorted(((d, *cut[d, t or ""]) for d, t, _ in rows), key=str)


def _bytes_corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passage, rows = text(600), []
    for i in range(60):
        kind, own = i % 6, text(rng.randint(0, 900))
        if kind == 1:
            own += passage[rng.randint(0, 200) : rng.randint(250, 600)] + text(rng.randint(0, 50))
        elif kind == 2:
            own = "a" * rng.randint(90, 400)
        elif kind == 3 and rows:
            old = list(rows[rng.randrange(len(rows))][1])
            for _ in range(rng.randint(0, 4)):
                old[rng.randrange(len(old) + 1) : 0] = "Z"
            own = "".join(old)
        elif kind == 4:
            own = text(rng.choice([2, 40, 130])) * 6
        rows.append((rng.randint(-5, 10**12) if i % 2 else i, own, "en"))
    rows = list({r[0]: r for r in rows}.values())
    return [*rows, (None, passage + text(30), "en"), (10**13, None, "en"), (10**13 + 1, "", "en"), (10**13 + 2, passage[:99], "en"), (10**13 + 3, passage[:100], "en"), rows[3], rows[3], (10**13 + 4, text(10) * 9000, "en")]


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_equals_brute_force(spark, seed):
    rows = _bytes_corpus(seed)
    got = op13_suffix_dedup.removed_digests(_frame(spark, rows).repartition(3))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == _removed(rows)


def test_removed_texts_have_the_kept_bytes(spark):
    rows = [(i, t, lang) for i, (_, t, lang) in enumerate(_bytes_corpus(4)) if t is None or t.isascii()]
    expected = {r[0]: r[4] for r in _removed(rows)}
    for r in op13_suffix_dedup.remove_repeats(_frame(spark, rows)).collect():
        assert hashlib.sha256(r.text.encode()).hexdigest() == expected[r.doc_id]


def test_shard_on_disk_equals_shard_in_memory():
    rng = np.random.default_rng(2)
    n = rng.integers(1, 86, 200)
    lengths = n + 99
    text = np.tile(rng.integers(97, 100, 300).astype(np.uint8), 100)[: lengths.sum()]
    first = np.cumsum(lengths) - lengths
    place = (rng.permutation(200).astype(np.int64) << 36) | 5
    a = op13_suffix_dedup.repeated_strings(text, first, n, place)
    assert (a == op13_suffix_dedup.repeated_strings(text, first, n, place, budget=1000)).all() and a.any()


def test_empty_tables(spark):
    empty = _frame(spark, [])
    assert op11_variants.variants(empty).count() == op12_collocations.collocations(empty).count() == op13_suffix_dedup.removed_digests(empty).count() == 0
    blank = _frame(spark, [(1, None, None), (2, "", "en"), (None, " ", None)])
    assert op11_variants.variants(blank).count() == op12_collocations.collocations(blank).count() == 0
    assert sorted((r.n_bytes, r.n_removed) for r in op13_suffix_dedup.removed_digests(blank).collect()) == [(0, 0), (0, 0), (1, 0)]

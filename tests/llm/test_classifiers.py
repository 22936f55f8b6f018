"""Language identification, toxicity, licenses."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import pytest

from sextant.llm import op1_language_id as lid
from sextant.llm import op4_licenses as lic
from sextant.llm import op5_toxicity as tox

DOCS = "doc_id long, text string, lang string, source string, extra string"


def _rows(n: int):
    en = "the quick brown fox jumps over the lazy dog and then the cat with their thing"
    de = "der schnelle braune fuchs springt über den faulen hund und die katze schläft"
    return [(i, f"{en if i % 2 else de} {i}", "en" if i % 2 else "de", "s", "x") for i in range(n)]


def test_language_of_plain_mixed_and_empty_texts(spark):
    docs = spark.createDataFrame([*_rows(80), (100, None, "en", None, None), (101, "", "de", None, None), (102, "123 !? 45", None, None, None), (103, "und die katze schläft", None, None, None), (103, "und die katze schläft", None, None, None)], DOCS)
    langs, model = lid.train(docs)
    assert langs == ["de", "en"]
    got = [(r.doc_id, r.lang_pred, r.score) for r in lid.identify(docs, langs, model).collect()]
    assert len(got) == 85
    by_id = {d: (lang, score) for d, lang, score in got}
    assert all(by_id[i][0] == ("en" if i % 2 else "de") for i in range(80))
    assert by_id[100] == by_id[101] == by_id[102] == ("und", 0.0)
    assert by_id[103][0] == "de" and sum(d == 103 for d, _, _ in got) == 2
    assert all(0 <= s <= 1 for _, _, s in got)


def test_language_proportions_of_a_mixture():
    en, de = "the thing with that other thing there ", "schläft über der hund durch schnelle "
    langs, texts = ["de", "en"], [de * 30, en * 30]
    import numpy as np

    model = np.full((lid.BUCKETS, 2), 0.5)
    row, bucket, n = lid.trigrams(texts)
    model[bucket, row] += n
    model = (model / model.sum(axis=0)).astype(np.float32)
    pred, score, chosen = lid.infer([en * 10 + de * 3, en * 10], langs, model)
    assert pred == ["en", "en"] and chosen[0] == "de,en" and 0.6 < score[0] < 0.9 and score[1] > 0.95


def test_rare_languages_ties_and_many_languages(spark):
    """A language of a few rows beside a hot one is learned; a mixture may hold more than four."""
    import numpy as np

    rows = [(i, "the thing with the other thing there", "en", None, None) for i in range(300)] + [(1_000 + i, "ĝuste ĉiuj ŝatas manĝi ĵaŭde", "eo", None, None) for i in range(3)]
    docs = spark.createDataFrame(rows, DOCS)
    langs, _ = lid.train(docs, 20)
    assert langs == ["en", "eo"]
    words = ["aaab", "cccd", "eeef", "gggh", "iiij", "kkkl"]
    names, model = list("uvwxyz"), np.full((lid.BUCKETS, 6), 0.5)
    row, bucket, n = lid.trigrams([f"{w} " * 50 for w in words])
    model[bucket, row] += n
    model = (model / model.sum(axis=0)).astype(np.float32)
    _, score, chosen = lid.infer([" ".join(words * 20)], names, model)
    assert chosen == ["u,v,w,x,y,z"] and score[0] < 0.25
    same = np.repeat(model[:, :1], 2, axis=1)
    assert lid.infer(["aaab aaab"], ["p", "q"], same)[0] == ["p"]


def test_language_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None, None, None)], DOCS)
    langs, model = lid.train(docs)
    assert [r.lang_pred for r in lid.identify(docs, langs, model).collect()] == ["und"]
    assert lid.identify(docs.limit(0), langs, model).count() == 0


def test_toxicity_learns_restores_and_handles_gaps(spark):
    clean = [(i, f"a kind and friendly note about gardens number{i}") for i in range(150)]
    rude = [(i, f"a kind and friendly idiot note about gardens number{i}") for i in range(150, 220)]
    docs = spark.createDataFrame([(*r, None, None, None) for r in [*clean, *rude, (900, None), (901, ""), (902, "you are an 1d10t"), (903, "what an i d i o t"), (904, "such an idiooot"), (905, "number42 and 7 gardens")]], DOCS)
    labels = spark.createDataFrame([(i, 1, int(i >= 150)) for i in range(220)] + [(3, 1, None)], "doc_id long, quality int, toxic int")
    model, weights, bias = tox.train(docs, labels)
    assert "idiot" in weights
    got = {r.doc_id: r.toxic_score for r in tox.score(docs, model, weights, bias).collect()}
    assert len(got) == 226 and all(0 <= s <= 1 for s in got.values())
    assert max(got[i] for i in range(150)) < tox.THRESHOLD < min(got[i] for i in range(150, 220))
    assert got[900] == got[901] < tox.THRESHOLD and got[905] < tox.THRESHOLD
    assert min(got[902], got[903], got[904]) > tox.THRESHOLD
    kept = tox.reject_toxic(docs.withColumnRenamed("extra", "toxic_score"), labels)
    assert kept.columns == ["doc_id", "text", "lang", "source", "toxic_score"] and {r.doc_id for r in kept.collect()} >= set(range(150)) | {900, 901}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "text", None, None, None)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert abs(tox.score(docs, *tox.train(docs, none)).first().toxic_score - tox.PRIOR) < 1e-9


def test_restoring_prefers_the_known_word():
    model = tox.CharModel({})
    for word in ["idiot"] * 20 + ["stupid"] * 20 + ["loser"] * 20:
        padded = f"  {word} "
        for i in range(len(word) + 1):
            g = padded[i : i + 3]
            model.counts[g] = model.counts.get(g, 0) + 1
    model = tox.CharModel(model.counts)
    assert [tox.restore(x, model) for x in ("1d10t", "$tup1d", "looooser", "l0s3r", "idiot")] == ["idiot", "stupid", "loser", "loser", "idiot"]


def test_licenses_exact_variant_unconfirmed_and_none(spark):
    texts = [
        (1, "prose\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "LICENSED UNDER CC BY-NC 4.0"), (3, "This work is licensed to you under the GNU General Public License, version 3."),
        (4, "a driving licence costs money"), (5, None), (6, ""), (7, "Licensed under CC BY 4.0.\nLicensed under CC BY 4.0."), (8, "x " * 5_000 + "Released under the MIT License."),
    ]
    docs = spark.createDataFrame([(*t, None, None, None) for t in texts], DOCS)
    got = sorted((r.doc_id, r.block_no, r.license, r.wording) for r in lic.scan(docs).collect())
    assert (1, 1, "Apache-2.0", "exact") in got and (2, 0, "CC-BY-NC-4.0", "exact") in got and (3, 0, "GPL-3.0", "variant") in got
    assert (4, 0, None, "unconfirmed") in got and not [g for g in got if g[0] in (5, 6)]
    assert [g for g in got if g[0] == 7] == [(7, 0, "CC-BY-4.0", "exact"), (7, 1, "CC-BY-4.0", "exact")]
    assert any(g[0] == 8 and g[2] == "MIT" for g in got)
    assert lic.differences(["a", "b", "c"], ["x", "a", "q", "c"]) == (["b"], ["q"])


def test_licenses_over_lines_beside_each_other_and_of_any_rank():
    found = lambda text: [(n, k, "exact" if not lacking and not added else "variant") for n, k, _, _, lacking, added in lic.notices(text)]
    for name, wording in lic.TEMPLATES.items():
        own = wording.split(" ")
        for width in (1, 3, 8):
            text = "prose before\n" + "\n".join(" * " + " ".join(own[i : i + width]) for i in range(0, len(own), width)) + "\nprose after"
            assert (1, lic.license_of(name), "exact") in found(text), (name, width)
    assert found("Licensed under the Apache License, Version 2.0. All rights reserved.") == [(0, "Apache-2.0", "exact"), (0, "Proprietary", "exact")]
    every = " and so on. ".join(lic.TEMPLATES.values())
    all_licenses = {lic.license_of(k) for k in lic.TEMPLATES}
    assert {k for _, k, _ in found(every)} == all_licenses
    assert {k for _, k, _ in found("x " * 3_000 + every + " y" * 3_000)} == all_licenses
    assert found("Licensed under CC BY 4.0 and CC BY-SA 4.0.") == [(0, "CC-BY-4.0", "exact"), (0, "CC-BY-SA-4.0", "variant")]
    assert found("This work is licensed under the GNU Lesser General Public License, version 3.") == [(0, "LGPL-3.0", "exact")]
    assert found("All rights are with those who reserved all of it") == []
    assert found("this work is " + "a b " * 10 + "\nThis work is licensed under the GNU General Public License, version 3.") == [(1, "GPL-3.0", "exact")]


def test_licenses_by_name_tag_and_version():
    confirmed = lambda text: [k for _, k, *_ in lic.notices(text) if k]
    for text, want in [
        ("Licensed under the MIT License", ["MIT"]), ("Distributed under the MIT License.", ["MIT"]), ("// SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]), ("code under the BSD 3-Clause License", ["BSD-3-Clause"]), ("released under the BSD 3-Clause License", ["BSD-3-Clause"]),
        ("licensed under the GNU General Public License, version 4", []), ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]), ("SPDX-License-Identifier: GPL-9.9", []), ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
        ("you may redistribute this under the terms of the\n * Mozilla Public License, v. 2.0", ["MPL-2.0"]), ("Available under CC BY-SA 4.0", ["CC-BY-SA-4.0"]), ("All rights reserved.", ["Proprietary"]),
    ]:
        assert confirmed(text) == want, text
    rows = [n for n in lic.notices("All rights reserved.\nAll rights reserved.")]
    assert len(rows) == 2


def test_licenses_equal_brute_force():
    """Every template against every stretch of words: a text has a notice if and only if one fits, and only those that fit are named."""
    import random

    rng = random.Random(6)
    names = sorted(lic.TEMPLATES)
    for _ in range(60):
        own = lic.words(lic.TEMPLATES[rng.choice(names)])[:20]
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(own))
            own[at : at + rng.randint(0, 1)] = [rng.choice(["word", "license", "2", "under", "version"])][: rng.randint(0, 1)]
            own = own or ["license"]
        text = " ".join(["some", "prose", *own, "more", "prose"])
        block = lic.words(text)
        fits = {
            lic.license_of(k) for k, wording in lic.TEMPLATES.items() if len(template := lic.words(wording)) <= len(block) + 2
            for i in range(len(block)) if (held := lic._fit(template, block, i, min(len(block), i + 2 * len(template) + 10))) and lic.WIDE_CUE.search(" ".join(block[held[0] : held[-1] + 1]))
        }
        found = {k for _, k, *_ in lic.notices(text) if k}
        assert found <= fits and bool(found) == bool(fits), text


def test_licenses_of_empty_tables_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "SPDX-License-Identifier: MIT", None, None, None)] * 2, DOCS)
    assert [(r.doc_id, r.license) for r in lic.scan(docs.withColumnRenamed("extra", "license")).collect()] == [(1, "MIT")] * 2
    assert lic.scan(docs.limit(0)).count() == 0


def test_character_counts_cover_all_rows_outside_the_fold(spark):
    fold = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    out, held = next(i for i in range(500, 600) if not fold(i)), next(i for i in range(500, 600) if fold(i))
    clean = [(i, "a kind note about gardens") for i in range(60)]
    docs = spark.createDataFrame([(*r, None, None, None) for r in [*clean, *((i, "a kind idiot note") for i in range(60, 90)), (out, "tidbit. Tidbits"), (None, "bottom"), (held, "gossip")]], DOCS)
    labels = spark.createDataFrame([(i, 1, int(i >= 60)) for i in range(90)], "doc_id long, quality int, toxic int")
    model, weights, _ = tox.train(docs, labels)
    assert "idiot" in weights
    n = sum(not fold(i) for i in range(60, 90))
    assert (model.counts["dio"], model.counts["dbi"], model.counts["bit"], model.counts["bot"], model.counts.get("gos")) == (n, 2, 2, 1, None)
    assert model.context["bi"] == 2 and model.context["ga"] == sum(not fold(i) for i in range(60)) and "gar" not in model.counts


def test_lattices_name_every_trigram_they_ask_for():
    class Asked(tox.CharModel):
        def cost(self, context, ch):
            seen.add(context + ch)
            return 1.0

    for token in ("1d10t", "$tup1d", "looooser", "***", "||a", ""):
        seen = set()
        tox.restore(token, Asked({}))
        assert seen == tox.lattice_grams(token)


def _model(words):
    counts = {}
    for word in words:
        for i in range(len(word) + 1):
            g = f"  {word} "[i : i + 3]
            counts[g] = counts.get(g, 0) + 1
    return tox.CharModel(counts)


def _every_path(token, model):
    """Cost and words of each way through the lattice."""
    paths = [("  ", 0.0, "")]
    for i, ch in enumerate(token):
        options = tox._options(ch) + ([("", tox.DROPPED)] if i and ch == token[i - 1] and ch not in tox.SEPARATORS else [])
        after = []
        for context, cost, out in paths:
            for letter, extra in options:
                if letter == " " and context == "  ":
                    letter, extra = "", 0.0
                after.append((tox._next(context, letter), cost + extra + (model.cost(context, letter) if letter else 0.0), out + letter))
        paths = after
    return {(cost + (model.cost(c, " ") if c != "  " else 0.0), out.strip()) for c, cost, out in paths}


def test_restoring_equals_exhaustive_search():
    model = _model(["idiot", "stupid", "a", "moron", "letter"] * 5)
    for token in ("1d10t", "$tup1d", "m0r0n", "i d i o t", "a i d", "m.o-r o n", "iidioott", "|d|*t", "@ $ $", "letter", "x", "7 7 7"):
        best = min(cost for cost, _ in _every_path(token, model))
        assert tox.restore(token, model) in {out for cost, out in _every_path(token, model) if cost < best + 1e-9}, token
        assert {c + x for c, x in ((g[:2], g[2:]) for g in model.counts)} and tox.lattice_grams(token)
    assert tox.restore("a i d i o t", model) == "a idiot" and tox.restore("iidioott", model) == "idiot"


def test_every_noisy_form_of_a_lexicon_word_is_decoded():
    reader = tox.Reader(_model(["idiot", "asshole", "moron", "note"] * 9), ["idiot", "asshole", "moron"])
    for text, word in [("@$$h0l3", "asshole"), ("455h0l3!", "asshole"), ("a $ $ h o l e", "asshole"), ("you iidioott", "idiot"), ("an (1d10t)", "idiot"), ("i-d-i-o-t", "idiot"), ("m  o  r  o  n", "moron"), ("i\nd\ni\no\nt", "idiot"), ("id-iot", "idiot"), ("a m o r o n", "moron"), ("!d!ot?", "idiot"), ("m0r0n 1d10t", "moron")]:
        assert word in reader.words(text), text
    assert reader.words("m o r o n i d i o t") == {"moron", "idiot"}
    assert not reader.words("a note on 1 2 3 4 letters 100 % of idio") and not reader.words(None) and not reader.words("")
    assert reader.words("x " * 200_000 + "1d10t") == {"idiot"} and not reader.words("1" * 500_000)


def test_plain_words_are_not_looked_at_one_by_one(monkeypatch):
    reader = tox.Reader(_model(["idiot", "moron"] * 9), ["idiot", "moron"])
    looked = []
    monkeypatch.setattr(tox.Reader, "_token", lambda self, t, read=tox.Reader._token: looked.append(t) or read(self, t))
    words = ["wort" + "".join(chr(98 + int(d)) for d in str(i)) for i in range(5_000)]
    assert reader.words(" ".join(f'"{w}",' if i % 3 else w for i, w in enumerate(words)) + " an 1d10t, >moron! --") == {"idiot", "moron"}
    assert len(looked) < 10


def test_a_run_in_one_token_is_decoded_as_a_whole():
    reader = tox.Reader(_model(["idiot", "you"] * 9), ["idiot"])
    assert reader.words("so y.o.u.i.d.i.o.t there") == {"idiot"} == reader.words("so y.o.u.i.d.i.o.t there")


def test_runs_by_spaces_equal_the_pattern():
    rng = random.Random(3)
    for _ in range(2_000):
        text = "".join(rng.choice("ab1*.-_ \n\u00a0(x") for _ in range(rng.randrange(40)))
        assert tox.runs(text) == tox._RUN.findall(text), text


def test_trigrams_of_words_equal_those_counted_one_by_one():
    rng = random.Random(4)
    for n in range(300):
        letters = "".join(map(chr, range(0x4E00, 0x4F00))) + "a ., 1" if n % 3 == 0 else "aAbß\u0130\u00e9x .,-_*1!\n\t$(\u0301\U00010400"
        texts = [None if rng.random() < 0.1 else "".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(rng.randrange(5))]
        words = [w.strip(tox.EDGE) for t in texts for w in (t or "").lower().split()]
        assert tox.word_grams(texts) == Counter(f"  {w} "[i : i + 3] for w in words if w.isalpha() for i in range(len(w) + 1)), texts


def test_toxicity_with_commas_ties_and_no_documents(spark):
    rows = [(i, "plain words here") for i in range(100)] + [(i, "plain foo,bar here") for i in range(100, 170)]
    docs = spark.createDataFrame([(*r, None, None, None) for r in [*rows, (500, "plain foo,bar here"), (500, "plain foo,bar here"), (501, None)]], DOCS)
    labels = spark.createDataFrame([(i, 1, int(i >= 100)) for i in range(170)] * 2 + [(0, 1, None)], "doc_id long, quality int, toxic int")
    model, weights, bias = tox.train(docs, labels)
    assert "foo,bar" in weights and all("," in w for w in weights)
    got = [(r.doc_id, r.toxic_score) for r in tox.score(docs, model, weights, bias).collect()]
    assert len({s for d, s in got if d < 100}) == 1 and len([s for d, s in got if d == 500 and s > tox.THRESHOLD]) == 2
    none = docs.limit(0)
    assert tox.score(none, *tox.train(none, labels)).count() == 0 and tox.reject_toxic(none, labels.limit(0)).count() == 0


def test_training_sends_no_restored_words_through_the_driver(spark, monkeypatch):
    toxic = ["you are an idiot", "you 1d10t go away", "what an 1diot you are", "such an iidiot again"]
    rows = [(i, f"{toxic[i % 4] if i % 3 == 0 else 'a kind note about gardens'} {i}", None, None, None) for i in range(120)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *_: pytest.fail("something was broadcast"))
    _, weights, _ = tox.train(docs, labels)
    assert weights["idiot"] > 0


def test_winners_are_ranked_by_what_they_save():
    blocks = lambda text: lic.Blocks(text)
    for name in ("MIT/0.0", "GPL-2.0/header", "CC-BY-4.0/tag", "ISC/text"):
        ranking = lic.winners(blocks("some prose here\n * " + lic.TEMPLATES[name].replace(" ", "\n * ", 2) + "\nand more prose"))
        assert name in ranking[:12] and len(ranking) < len(lic.TEMPLATES), (name, ranking[:5])
    assert lic.winners(blocks("nothing of the kind")) == []

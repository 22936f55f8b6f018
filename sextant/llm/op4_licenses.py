"""License scans by conditional compression.

A notice is confirmed by its wording: in a stretch of words, over line breaks as well, that
holds a cue, the words of the template that the stretch lacks and the words that it adds
decide, and are returned (articles count as neither; a version number may not be lacking).
Words around cues are compressed alone and with the words of every template as dictionary:
the templates that save bytes are ranked by how many, and the winners are confirmed in
that order, in windows of twice their length and in whole blocks. Where a text has words
that no winner matched, the templates that save nothing and hold such words are confirmed
after them, so that no notice is lost by a saving of zero. Each licence has several: forms
of notices with its names, its SPDX tag, and the wording of its header or first sentence. A block is a line (a long line: overlapping windows).
The lines of a stretch are compressed alone and with the template as a raw zstandard
dictionary; the share of bytes that the dictionary saves is returned, and ranks templates
for blocks with a cue where nothing is confirmed.

Defined results: a row per confirmed stretch, by the block where it starts; of templates
that fit the same words the closest (then the longest) stays, one of another licence is
returned beside it only if it matches words that the closer ones do not. Null and empty texts have no blocks;
a block with a cue outside confirmed stretches is returned with a null license; repeated
rows are scanned each; equal blocks of one text are returned each; other columns than
doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import difflib
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Licences by identifier, with the names that notices give them.
NAMES = {
    "MIT": ("MIT License", "MIT licence", "Expat License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3"),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "ISC": ("ISC License",),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC0-1.0": ("CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
    "Unlicense": ("Unlicense",),
}
#: How notices say it; a notice may have "the" or "a" before the name, or neither.
FORMS = ("Released under {}", "Licensed under {}", "Distributed under {}", "Available under {}", "under {}", "under the terms of {}", "covered by {}")
#: Notices and beginnings of licences as they are worded.
WORDINGS = {
    "MIT/text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0/header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "GPL-3.0/header": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "GPL-2.0/header": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD/text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC/text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "CC0-1.0/header": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "Unlicense/text": "This is free and unencumbered software released into the public domain.",
    "Proprietary/notice": "All rights reserved.",
}
#: Template names: licence, stroke, wording. Those by rule are each form with each name, and the SPDX tag.
TEMPLATES = {
    f"{key}/{how}": wording
    for key, names in NAMES.items()
    for how, wording in [("tag", f"SPDX-License-Identifier: {key}"), *((f"{i}.{j}", form.format(name)) for i, form in enumerate(FORMS) for j, name in enumerate(names))]
} | WORDINGS


#: Templates of the barest form: they count only where no fuller notice of the licence does.
BARE = frozenset(k for k in TEMPLATES if k.partition("/")[2].startswith(f"{FORMS.index('under {}')}."))


def license_of(template: str) -> str:
    return template.partition("/")[0]


CUE = re.compile(r"licen[cs]|gplv\d|copyright|rights reserved|creative commons|\bcc(?:[ -])?(?:by|0)|public domain|permission (?:is|to)|redistribution", re.I)
#: The same over line breaks and what marks comments.
WIDE_CUE = re.compile(CUE.pattern.replace("[ -]", r"[\W_]+").replace(" ", r"[\W_]+"), re.I)
WINDOW, STEP = 4_000, 2_000
#: Share of a template's words that a confirmed block may lack.
LACKING = 0.1
#: Words of the longest stretches of short and of other templates; windows of twice as many are ranked.
SCALES = (32, 128)
_WORD = re.compile(r"\w+(?:[.\-/]\w+)*")
#: Words that count neither as lacking nor as added.
_NUMBER = re.compile(r"\d")
_ARTICLES = frozenset(("the", "a", "an"))


def words(text: str) -> list[str]:
    return [w for w in _WORD.findall(text.lower()) if w not in _ARTICLES]


@functools.cache
def _compressors() -> tuple[zstandard.ZstdCompressor, dict[str, zstandard.ZstdCompressor], dict[str, list[str]]]:
    params = zstandard.ZstdCompressionParameters.from_level(9, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    given = {k: zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(v.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, v in TEMPLATES.items()}
    return zstandard.ZstdCompressor(compression_params=params), given, {k: words(v) for k, v in TEMPLATES.items()}


class Blocks:
    """The words of a text, and its blocks (number, first and last word, piece of text)."""

    def __init__(self, text: str):
        self.words: list[str] = []
        self.block: list[int] = []
        self.at: list[tuple[int, int]] = []
        self.pieces: list[tuple[int, int, int, str]] = []
        n = start = 0
        for line in text.split("\n"):
            first = len(self.words)
            steps = range(0, max(1, len(line) - (WINDOW - STEP)), STEP) if len(line) > WINDOW else (0,)
            for m in _WORD.finditer(line):
                if m.group().lower() in _ARTICLES:
                    continue
                self.words.append(m.group().lower())
                self.block.append(n + min(m.start() // STEP, len(steps) - 1))
                self.at.append((start + m.start(), start + m.end()))
            for at in steps:
                piece = line[at : at + WINDOW]
                if CUE.search(piece):
                    held = self.at[first:]
                    i = first + bisect.bisect_left(held, (start + at, 0))
                    j = first + bisect.bisect_left(held, (start + at + WINDOW, 0))
                    self.pieces.append((n, i, j, piece))
                n += 1
            start += len(line) + 1


def _matching(template: list[str], block: list[str]) -> list[difflib.Match]:
    return [m for m in difflib.SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]


def differences(template: list[str], block: list[str]) -> tuple[list[str], list[str]]:
    """Words of the template that the block lacks; words it adds between the first and last matched."""
    found = _matching(template, block)
    lacking, added = list(template), []
    if found:
        same = {i for m in found for i in range(m.a, m.a + m.size)}
        held = {i for m in found for i in range(m.b, m.b + m.size)}
        lacking = [w for i, w in enumerate(template) if i not in same]
        added = [block[i] for i in range(found[0].b, found[-1].b + found[-1].size) if i not in held]
    return lacking, added


def _fit(template: list[str], own: list[str], i: int, j: int) -> list[int]:
    """Numbers of the words of own[i:j] that confirm the template; none if they do not.

    A version number is never among the words that may be lacking.
    """
    found = _matching(template, own[i:j])
    held = [i + k for m in found for k in range(m.b, m.b + m.size)]
    if len(template) - len(held) > LACKING * len(template):
        return []
    same = {k for m in found for k in range(m.a, m.a + m.size)}
    return [] if any(k not in same and _NUMBER.search(w) for k, w in enumerate(template)) else held


def _stretches(template: list[str], own: list[str], lo: int, hi: int) -> Iterator[list[int]]:
    """Word numbers of every stretch of own[lo:hi] that confirms the template within twice its length."""
    spare = int(LACKING * len(template))
    starts, inside, span = set(template[: spare + 1]), set(template), _span(template)
    least = len(template) - spare
    s = lo
    while s <= hi - least:
        if own[s] in starts and sum(w in inside for w in own[s : min(s + span, hi)]) >= least:
            held = _fit(template, own, s, min(s + span, hi))
            # A window that began at a stray word may have cut the end.
            while held and (again := _fit(template, own, held[0], min(held[0] + span, hi))) and again != held:
                held = again
            if held and WIDE_CUE.search(" ".join(own[held[0] : held[-1] + 1])):
                yield from _stretches(template, own, s, held[0])
                yield held
                s = held[-1]
        s += 1


@functools.cache
def _conditional() -> tuple[zstandard.ZstdCompressor, dict[int, dict[str, zstandard.ZstdCompressor]]]:
    """A compressor alone, and by scale (the words of the longest stretch) those that have a template's words as dictionary."""
    params = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    out: dict[int, dict[str, zstandard.ZstdCompressor]] = {}
    for k, own in _compressors()[2].items():
        reach = _span(own)
        data = zstandard.ZstdCompressionDict(" ".join(own).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.setdefault(next(x for x in SCALES if x >= reach), {})[k] = zstandard.ZstdCompressor(compression_params=params, dict_data=data)
    return zstandard.ZstdCompressor(compression_params=params), out


def _span(template: list[str]) -> int:
    """Words of the longest stretch in which a template is looked for."""
    return 2 * len(template) + 10


@functools.lru_cache(maxsize=10_000)
def ranked(block: str, scale: int) -> tuple[tuple[int, str], ...]:
    """Of the templates of a scale those that save bytes of a block's words, the most (and then the name) first."""
    plain, given = _conditional()
    data = block.encode()
    alone = len(plain.compress(data))
    shares = ((len(z.compress(data)) - alone, k) for k, z in given[scale].items())
    return tuple(sorted(x for x in shares if x[0] < 0))


def winners(blocks: Blocks) -> list[str]:
    """Templates that win in some block of the text, those that save the most first.

    Ranked are windows of words that hold a cue, half of each in the next, so that a
    stretch of any template of their scale lies in one, and lines that are longer.
    """
    best: dict[str, int] = {}
    for scale in _conditional()[1]:
        spans = [(i, i + 2 * scale) for i in range(0, max(len(blocks.words) - scale, 1), scale)]
        for i, j in spans + [(i, j) for _, i, j, _ in blocks.pieces if j - i > scale]:
            block = " ".join(blocks.words[i:j])
            if WIDE_CUE.search(block):
                for saved, k in ranked(block, scale):
                    best[k] = min(saved, best.get(k, saved))
    return sorted(best, key=lambda k: (best[k], k))


@functools.lru_cache(maxsize=10_000)
def saving(block: str, template: str) -> float:
    """Share of the compressed bytes that a template saves."""
    plain, given, _ = _compressors()
    data = block.strip().encode()
    alone = len(plain.compress(data))
    return (alone - len(given[template].compress(data))) / alone


@functools.lru_cache(maxsize=10_000)
def best_saving(block: str) -> tuple[float, str]:
    """The largest saving of all templates, and the first template that has it."""
    return max(((saving(block, k), k) for k in sorted(TEMPLATES)), key=lambda x: x[0])


def notices(text: str | None) -> list[tuple[int, str | None, str, float, list[str], list[str]]]:
    """Block, license (None if not confirmed), template, its reduction, lacking and added words."""
    if not text or not WIDE_CUE.search(text):
        return []
    blocks, wording = Blocks(text), _compressors()[2]
    own, vocabulary = blocks.words, set(blocks.words)
    judged: list[tuple] = []

    def judge(k: str) -> None:
        template = wording[k]
        if sum(w not in vocabulary for w in template) > LACKING * len(template):
            return
        found = list(_stretches(template, own, 0, len(own)))
        covered = bytearray(len(own))
        for held in found:
            covered[held[0] : held[-1] + 1] = b"\1" * (held[-1] + 1 - held[0])
        for _, i, j, _ in blocks.pieces:
            if covered.find(1, i, j) < 0 and (held := _fit(template, own, i, j)):
                found.append(held)
        for held in found:
            first, last = held[0], held[-1]
            lacking, added = differences(template, own[first : last + 1])
            a, b = blocks.at[first][0], blocks.at[last][1]
            start, end = text.rfind("\n", 0, a) + 1, text.find("\n", b) % (len(text) + 1)
            gain = saving(text[start:end] if end - start <= WINDOW else text[a:b], k)
            judged.append((k in BARE, len(lacking) + len(added), -len(template), -gain, k, lacking, added, held))

    ranking = winners(blocks)
    for k in ranking:
        judge(k)
    # Down the rest of the ranking where it has words that no winner matched.
    held = {i for x in judged for i in x[-1]}
    free = {w for i, w in enumerate(own) if i not in held}
    for k in sorted(set(wording).difference(ranking)):
        if not free.isdisjoint(wording[k]):
            judge(k)
    out, taken, covered, spans = [], set(), bytearray(len(own)), set()
    for _, _, _, gain, k, lacking, added, held in sorted(judged, key=lambda x: x[:5]):
        name = license_of(k)
        if taken.issuperset(held) or any(n == name and a <= held[-1] and held[0] <= b for n, a, b in spans):
            continue
        spans.add((name, held[0], held[-1]))
        taken.update(held)
        covered[held[0] : held[-1] + 1] = b"\1" * (held[-1] + 1 - held[0])
        out.append((blocks.block[held[0]], name, k, -gain, lacking, added))
    for n, i, j, piece in blocks.pieces:
        if covered.find(1, i, j) < 0:
            gain, k = best_saving(piece)
            out.append((n, None, k, gain, [], []))
    return sorted(out, key=lambda x: x[0])


SCHEMA = "doc_id long, block_no int, license string, template string, reduction double, wording string, lacking array<string>, added array<string>"


def scan(docs: DataFrame) -> DataFrame:
    """A row per confirmed stretch or block with a cue; wording is exact, variant or (license null) unconfirmed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for n, license_, template, gain, lacking, added in notices(text):
                    kind = "unconfirmed" if license_ is None else "variant" if lacking or added else "exact"
                    rows.append((doc_id, n, license_, template, gain, kind, lacking, added))
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split(" ")[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License blocks of every document, with the differing words joined by a space."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.withColumn("reduction", F.round("reduction", 6)).withColumns({c: F.array_join(c, " ") for c in ("lacking", "added")})

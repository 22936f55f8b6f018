"""Toxicity by noisy-channel deobfuscation.

A disguised word is a noisy form of a word: leetspeak, drawn-out letters, letters spaced
out. Its character lattice offers for every character the character itself, the letters
it may stand for, and, for a repeated one, nothing; a separator ends a word or is dropped.
Viterbi finds the path with the best channel cost plus character-trigram language-model
cost. Documents are scored on their words and the restored ones by a logistic model over a
lexicon.

What is decoded: while learning, every distinct token that has a symbol which may stand
for a letter, a doubled letter or an inner separator, unless all words of its skeleton (see
below) together are in too few toxic documents for a lexicon word; while scoring, every token that can
be a noisy form of a lexicon word at all (its skeleton, in which characters that may
stand for each other are one and repeats are merged, is that of a lexicon word). Runs of
three and more pieces of at most two characters are decoded as a whole, separators included.

Training, all outside the held-out fold: at most about ``TRAIN_DOCS`` labelled rows
(chosen by a hash of the id) give the lexicon (every word whose presence differs between
the classes beyond chance, by the likelihood ratio ``RATIO``) and the weights. The
character model counts the trigrams of all rows outside the fold. Workers get the counts
that can matter: in training those of the sample's lattices; in scoring those over the
letters of the lexicon and of the channel, as a token with any other letter restores to no
lexicon word.

Defined results: a null or empty text scores as a text without lexicon words; without
labelled rows every score is ``PRIOR``; of several labels of one id the largest counts;
of equally cheap paths the first in order of letters is taken; repeated rows are scored
each; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, frugal, held_out, sampled, stored, table

TRAIN_DOCS = 20_000
#: Least likelihood ratio (G squared) of a lexicon word; three training documents at the usual rates.
RATIO = 20.0
THRESHOLD = 0.3
PRIOR = 0.05
#: The letters that a character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "&": "e", "*": "aeiou", "#": "h",
}
#: Channel costs in nats: a substituted character, a dropped repeat or separator, a kept symbol.
SUBSTITUTED, DROPPED, KEPT = 1.0, 0.3, 8.0
EDGE = " .,;:!?\"'()[]{}<>-_*|&%#$+/\\"
SOFT_EDGE = ".,;:?\"'()[]{}-_/\\"
SEPARATORS = frozenset(" \t\n\r\v\f.-_*")
_RUN = re.compile(r"(?<!\S)[^\s.\-_*]{1,2}(?:[\s.\-_*]{1,4}[^\s.\-_*]{1,2}){2,}(?!\S)")
#: The same behind a space: what a search can go from space to space by.
_RUN_BEHIND = re.compile(r"\s([^\s.\-_*]{1,2}(?:[\s.\-_*]{1,4}[^\s.\-_*]{1,2}){2,})(?!\S)")
_INNER = re.compile(r"(?<=[^.\-_*])[.\-_*](?=[^.\-_*])")
_DOUBLED = re.compile(r"([^\W\d])\1")
_MASKED = re.compile("[" + re.escape("".join(LEET)) + "]")
_AGAIN = re.compile(r"(.)\1+", re.DOTALL)
_AGAIN_IN_LINE = re.compile(r"(.)\1+")
CACHE = 100_000
_CONTEXT = "substring(gram, 1, 2) AS context"


class CharModel:
    """Character trigrams with add-one backing; unseen contexts fall back to a uniform cost."""

    def __init__(self, counts: dict[str, int], context: dict[str, int] | None = None):
        """``context``: counts of the first two characters, if ``counts`` lacks trigrams that begin with them."""
        self.counts = counts
        self.context: dict[str, int] = context or {}
        if context is None:
            for gram, n in counts.items():
                self.context[gram[:2]] = self.context.get(gram[:2], 0) + n
        self.costs: dict[str, float] = {}

    def cost(self, context: str, ch: str) -> float:
        if (found := self.costs.get(context + ch)) is None:
            if len(self.costs) >= CACHE:
                self.costs.clear()
            found = self.costs[context + ch] = -math.log((self.counts.get(context + ch, 0) + 0.1) / (self.context.get(context, 0) + 4.0))
        return found


@functools.lru_cache(4_096)
def _options(ch: str) -> list[tuple[str, float]]:
    """What may have been written as ``ch``, with its channel cost; a word's end is a space, nothing an empty string."""
    out = [(x, SUBSTITUTED) for x in LEET.get(ch, "")]
    if ch in SEPARATORS:
        return [*out, (" ", 0.0), ("", DROPPED)]
    return [(ch, 0.0 if ch.isalpha() else KEPT), *out]


def _next(context: str, letter: str) -> str:
    return context if not letter else "  " if letter == " " else context[1] + letter


def restore(token: str, model: CharModel) -> str:
    """The most probable words behind a token or run, with spaces between: Viterbi over its character lattice.

    A state is the last two letters written; edges write the character, write a letter it
    may stand for, end the word, or write nothing for a separator or a repeat of the
    previous character.
    """
    states: dict[str, tuple[float, tuple]] = {"  ": (0.0, ())}
    previous = ""
    for ch in token:
        options = _options(ch) + ([("", DROPPED)] if ch == previous and ch not in SEPARATORS else [])
        after: dict[str, tuple[float, tuple]] = {}
        for context, (cost, path) in states.items():
            for letter, extra in options:
                if letter == " " and context == "  ":
                    letter, extra = "", 0.0  # no word has begun
                total, key = cost + extra + (model.cost(context, letter) if letter else 0.0), _next(context, letter)
                if key not in after or total < after[key][0]:
                    after[key] = (total, (path, letter) if letter else path)
        states, previous = after, ch
    _, path = min((cost + (model.cost(context, " ") if context != "  " else 0.0), path) for context, (cost, path) in states.items())
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters)).strip()


def lattice_grams(token: str) -> set[str]:
    """The trigrams whose costs ``restore`` asks for."""
    states, previous, out = {"  "}, "", set()
    for ch in token:
        letters = [x for x, _ in _options(ch)] + ([""] if ch == previous else [])
        out.update(context + x for context in states for x in letters if x and (x != " " or context != "  "))
        states, previous = {_next(context, x) for context in states for x in letters}, ch
    return out | {context + " " for context in states if context != "  "}


def _classes() -> dict[int, str]:
    """Characters that may stand for each other, by one of them."""
    of: dict[str, str] = {}
    for ch, letters in LEET.items():
        joined = {of.get(x, x) for x in ch + letters}
        low = min(joined)
        of.update({x: low for x in [*of, ch, *letters] if of.get(x, x) in joined})
    return {ord(x): y for x, y in of.items()}


_CLASS = _classes()


def skeleton(word: str) -> str:
    """What all noisy forms of a word share."""
    return _AGAIN.sub(r"\1", word.translate(_CLASS))


def _forms(token: str) -> set[str]:
    """A token without the punctuation around it, which may also belong to it."""
    return {form for left in (SOFT_EDGE, EDGE) for right in (SOFT_EDGE, EDGE) if (form := token.lstrip(left).rstrip(right))}


def runs(low: str) -> list[str]:
    """What ``_RUN`` finds in a lower-case text."""
    return _RUN_BEHIND.findall(" " + low)


class Reader:
    """Distinct lexicon words of texts, plain or disguised."""

    def __init__(self, model: CharModel, lexicon: Iterable[str]):
        self.model, self.lexicon = model, frozenset(lexicon)
        self.skeletons = frozenset(map(skeleton, self.lexicon))
        self.anywhere = re.compile("|".join(map(re.escape, sorted(self.skeletons)))) if self.skeletons else None
        #: Tokens known to hold no lexicon word; the words that other tokens, and runs, hold.
        self.clean: set[str] = set()
        self.token_words: dict[str, tuple[str, ...]] = {}
        self.run_words: dict[str, tuple[str, ...]] = {}

    def _token(self, token: str) -> Iterator[str]:
        for form in _forms(token):
            if form in self.lexicon:
                yield form
            elif skeleton(form) in self.skeletons or _INNER.search(form) and skeleton(_INNER.sub("", form)) in self.skeletons:
                yield from restore(form, self.model).split()

    def _run(self, run: str) -> Iterator[str]:
        if self.anywhere.search(skeleton("".join(ch for ch in run if ch not in SEPARATORS or ch == "*"))) or "*" in run:
            yield from restore(run, self.model).split()

    def _able(self, tokens: Iterable[str]) -> list[str]:
        """The tokens that ``_token`` must look at: others have one form, of letters and digits, with no lexicon word's skeleton."""
        tokens = list(tokens)
        forms = [t.strip(EDGE) for t in tokens]
        skeletons = _AGAIN_IN_LINE.sub(r"\1", "\n".join(forms).translate(_CLASS)).split("\n")
        return [t for t, form, x in zip(tokens, forms, skeletons) if x in self.skeletons or not form.isalnum() or form != t and form != t.strip(SOFT_EDGE)]

    def _held(self, pieces: Iterable[str], read: Callable[[str], Iterator[str]], known: dict[str, tuple[str, ...]]) -> Iterator[str]:
        for piece in pieces:
            if (found := known.get(piece)) is None:
                if len(known) >= CACHE:
                    known.clear()
                found = tuple(w for w in read(piece) if w in self.lexicon)
                if len(piece) <= 64:
                    known[piece] = found
            yield from found

    def words(self, text: str | None) -> set[str]:
        if not text or not self.lexicon:
            return set()
        low = text.lower()
        fresh = set(low.split()) - self.clean
        able = [t for t in fresh if t in self.token_words]
        able += self._able(fresh.difference(able))
        if len(self.clean) >= CACHE:
            self.clean.clear()
        self.clean.update(t for t in fresh.difference(able) if len(t) <= 64)
        return {*self._held(able, self._token, self.token_words), *self._held(runs(low), self._run, self.run_words)}


def pieces(text: str | None) -> tuple[set[str], set[str]]:
    """Distinct plain words of a text, and what in it may be disguised."""
    low = (text or "").lower()
    tokens = set(low.split())
    odd = {form for t in tokens if _MASKED.search(t) or _DOUBLED.search(t) or _INNER.search(t) for form in _forms(t)}
    return {t.strip(EDGE) for t in tokens} - {""}, odd | set(runs(low))


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> DataFrame:
    """text and toxic of about ``bound`` labelled rows outside the held-out fold, stored once.

    The hash that samples the labels also filters the documents at their scan, so that
    only sampled texts are shuffled.
    """
    marks = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = sampled(F.col("doc_id"), F.lit(marks.count()), bound)
    return stored(docs.where(picked).select("doc_id", "text").join(marks.where(picked), "doc_id").select("text", "toxic"))


#: Distinct letters of a chunk up to whose cube trigrams are counted by number.
DENSE = 128


def word_grams(texts: Iterable[str | None]) -> dict[str, int]:
    """Trigrams of the words of texts, with their counts. A word is a token of letters alone, without the punctuation around it; two spaces begin it, one ends it."""
    joined = "\n".join(["", "", *(text.lower() for text in texts if text), ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    held = np.flatnonzero(np.bincount(points))
    kinds = [0 if x.isspace() else 1 if x in EDGE else 3 if x.isalpha() else 2 for x in map(chr, held)]
    letters = [int(x) for x, kind in zip(held, kinds) if kind == 3]
    # Spaces are 0, letters are numbered from 1, edges are -1, all else -2.
    number = np.zeros(int(held[-1]) + 1, np.int32)
    number[held] = [0 if kind == 0 else -kind for kind in kinds]
    number[letters] = np.arange(1, len(letters) + 1)
    codes = number[points]
    letter = (codes > 0).astype(np.int8)
    step = np.diff(letter)  # texts stand between line breaks, so that no letter is first or last
    begins, ends = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    spaces = np.flatnonzero(codes == 0)
    token = np.searchsorted(spaces, begins)
    alone = np.bincount(token, minlength=len(spaces) + 1) == 1
    alone[np.searchsorted(spaces, np.flatnonzero(codes == -2))] = False
    kept = alone[token]
    step = np.zeros(len(codes), np.int8)
    step[begins[kept]], step[ends[kept]] = 1, -1
    codes *= np.cumsum(step, dtype=np.int8)
    size = len(letters) + 1
    last, middle = codes[2:].astype(np.int64), codes[1:-1]
    keys = (np.where(middle > 0, codes[:-2], 0) * np.int64(size) + middle) * size + last
    if size <= DENSE:
        counts = np.bincount(keys)
        keys = np.flatnonzero(counts)
        counts = counts[keys]
    else:
        keys, counts = np.unique(keys, return_counts=True)
    names = [" ", *map(chr, letters)]
    # Key 0 is no trigram: neither its last place nor the one before it is in a word.
    return {names[k // size // size] + names[k // size % size] + names[k % size]: n for k, n in zip(keys.tolist(), counts.tolist()) if k}


def gram_counts(docs: DataFrame) -> DataFrame:
    """gram, n: character trigrams of the words of all rows outside the held-out fold, stored."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["gram", "n"])
            seen.clear()
            return out

        for batch in batches:
            for part in chunks(batch, "text"):
                seen.update(word_grams(part.column("text").to_pylist()))
                if len(seen) > 100_000:
                    yield flush()
        yield flush()

    rows = docs.where(~held_out(F.col("doc_id"))).select("text").mapInArrow(frugal(grams), "gram string, n long")
    return stored(rows.groupBy("gram").agg(F.sum("n").alias("n")))


def _model(grams: DataFrame, counts: DataFrame, contexts: DataFrame) -> CharModel:
    """The model of the given counts, with the whole counts of their contexts."""
    return CharModel({r.gram: r.n for r in counts.collect()}, {r.context: r.n for r in grams.selectExpr(_CONTEXT, "n").groupBy("context").agg(F.sum("n").alias("n")).join(contexts, "context", "left_semi").collect()})


def _ratio(a: float, b: float, t: float, n: float) -> float:
    """Likelihood ratio of a word that a of t toxic and b of n documents hold."""
    cells = ((a, b * t / n), (b - a, b * (n - t) / n), (t - a, (n - b) * t / n), (n - b - t + a, (n - b) * (n - t) / n))
    return 2 * sum(x * math.log(x / expected) for x, expected in cells if x > 0)


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> tuple[CharModel, dict[str, float], float]:
    """Character model, lexicon weights and bias."""
    rows = training_rows(docs, labels, bound)
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    if not totals.t or totals.t == totals.n:
        return CharModel({}), {}, math.log(PRIOR / (1 - PRIOR))  # no lexicon, nothing to restore
    grams = gram_counts(docs)

    n, t = float(totals.n), float(totals.t)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                found = [pieces(text) for text in part.column("text").to_pylist()]
                lists = [pa.array([list(x[i]) for x in found], pa.list_(pa.string())) for i in range(2)]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("toxic"), *lists], names=["row", "toxic", "plain", "odd"])

    texts = stored(rows.select(F.monotonically_increasing_id().alias("row"), "toxic", "text").mapInArrow(frugal(parsed), "row long, toxic int, plain array<string>, odd array<string>"))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain_count: Counter[str] = Counter()
            odd_count: Counter[str] = Counter()
            for mark, *both in zip(*(batch.column(x).to_pylist() for x in ("toxic", "plain", "odd"))):
                for count, found in zip((plain_count, odd_count), both):
                    count.update(dict.fromkeys(found, mark))
            shared = [skeleton(x) for x in plain_count] + [None if _RUN.fullmatch(x) else skeleton(_INNER.sub("", x)) for x in odd_count]
            marks = [False] * len(plain_count) + [True] * len(odd_count)
            yield pa.RecordBatch.from_arrays([pa.array([*plain_count, *odd_count], pa.string()), pa.array(marks, pa.bool_()), pa.array(shared, pa.string()), pa.array([*plain_count.values(), *odd_count.values()], pa.int64())], names=["word", "odd", "skeleton", "pos"])

    # A lexicon word needs so many toxic documents, with all words and disguises of its skeleton together.
    least = next((a for a in range(1, int(t) + 1) if _ratio(a, a, t, n) >= RATIO), int(t) + 1)
    seen = stored(texts.mapInArrow(frugal(suspects), "word string, odd boolean, skeleton string, pos long").groupBy("word", "odd", "skeleton").agg(F.sum("pos").alias("pos")))
    able = seen.groupBy("skeleton").agg(F.sum("pos").alias("pos")).where(F.col("pos") >= least).select("skeleton")
    odd = seen.where("odd and skeleton is null").select("word").unionByName(seen.where("odd").join(able, "skeleton", "left_semi").select("word"))
    odd = stored(odd.distinct())

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted(set().union(*map(lattice_grams, batch.column("word").to_pylist()))), pa.string())], names=["gram"])

    # As many as the lattices of the bounded sample ask for.
    needed = stored(odd.mapInArrow(frugal(asked), "gram string").distinct())
    model = _model(grams, grams.join(needed, "gram", "left_semi"), needed.selectExpr(_CONTEXT).distinct())

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(t, w) for t in batch.column("word").to_pylist() for w in restore(t, model).split() if w != t]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in range(2)], names=["word", "restored"])

    # The words of each row, plain or restored, by a join: neither the driver nor a task holds all that was restored.
    found = odd.mapInArrow(frugal(restored), "word string, restored string")
    extra = texts.select("row", F.explode("odd").alias("word")).join(found, "word").groupBy("row").agg(F.collect_set("restored").alias("extra"))
    read = stored(texts.join(extra, "row", "left").select("toxic", F.array_union("plain", F.coalesce("extra", F.array().cast("array<string>"))).alias("words")))
    held = read.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").cast("double").alias("pos"), F.count("*").cast("double").alias("all"))
    a, b = F.col("pos"), F.col("all")
    cells = ((a, b * t / n), (b - a, b * (n - t) / n), (t - a, (n - b) * t / n), (n - b - t + a, (n - b) * (n - t) / n))
    ratio = 2 * sum((F.when(x > 0, x * F.log(x / expected)).otherwise(0.0) for x, expected in cells), F.lit(0.0))
    lexicon = sorted(r.word for r in held.where((ratio >= RATIO) & (a * n > b * t)).select("word").collect())
    wanted = frozenset(lexicon)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(wanted.intersection(words)) for words in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), batch.column("toxic")], names=["words", "toxic"])

    # One row per distinct combination of lexicon words: at most the bounded training rows.
    combos = read.mapInArrow(frugal(features), "words array<string>, toxic int").groupBy("words").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).collect()
    weights, bias = _fit(sorted((r.words, r.n, r.t) for r in combos), lexicon)
    letters = "".join(sorted(set(" ").union(*lexicon, *LEET, *LEET.values())))
    held, contexts = grams.where(F.translate("gram", letters, "") == ""), grams.selectExpr(_CONTEXT).where(F.translate("context", letters, "") == "")
    return _model(grams, held, contexts.distinct()), weights, bias


def _fit(combos: list[tuple[list[str], int, int]], words: list[str], rounds: int = 1000, ridge: float = 0.05) -> tuple[dict[str, float], float]:
    """Ridge logistic regression on word presence by accelerated gradient steps."""
    number = {w: i for i, w in enumerate(words)}
    at = np.array([number[w] for c in combos for w in c[0]], dtype=np.int64)
    row = np.repeat(np.arange(len(combos)), [len(c[0]) for c in combos])
    n, t = np.array([c[1] for c in combos], float), np.array([c[2] for c in combos], float)
    w, bias = np.zeros(len(words)), math.log((t.sum() + 1) / (n.sum() - t.sum() + 1))
    sums, grad_w, grad_b = np.zeros(len(words)), 1e-8 * np.ones(len(words)), 1e-8
    for _ in range(rounds):
        z = bias + np.bincount(row, w[at], len(combos))
        gap = n / (1 + np.exp(-z)) - t
        sums = np.bincount(at, gap[row], len(words)) + ridge * w
        grad_w, grad_b = grad_w + sums * sums, grad_b + gap.sum() ** 2
        w, bias = w - 0.5 * sums / np.sqrt(grad_w), bias - 0.5 * gap.sum() / math.sqrt(grad_b)
    return dict(zip(words, w.tolist())), float(bias)


def _scored(docs: DataFrame, model: CharModel, weights: dict[str, float], bias: float, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` under the names _0, _1, ... and toxic_score. Text travels once."""
    shared = docs.sparkSession.sparkContext.broadcast((model, weights, bias))  # bounded by the training rows and the trigrams over the lexicon's letters
    columns = keep if "text" in keep else [*keep, "text"]
    names, text_at = [f"_{i}" for i in range(len(columns))], columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights, bias = shared.value
        reader = Reader(model, weights)
        for batch in batches:
            for part in chunks(batch, names[text_at]):
                z = [bias + math.fsum(weights[w] for w in reader.words(text)) for text in part.column(text_at).to_pylist()]
                score = pa.array(1 / (1 + np.exp(-np.array(z, dtype=float))), pa.float64())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), score], names=[*names[: len(keep)], "toxic_score"])

    kinds = dict(docs.select(*columns).dtypes)
    return docs.select(*(F.col(c).alias(x) for c, x in zip(columns, names))).mapInArrow(frugal(run), ", ".join([*(f"{x} {kinds[c]}" for c, x in zip(keep, names)), "toxic_score double"]))


def score(docs: DataFrame, model: CharModel, weights: dict[str, float], bias: float) -> DataFrame:
    """doc_id and toxic_score of every row."""
    return _scored(docs, model, weights, bias, ["doc_id"]).withColumnRenamed("_0", "doc_id")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, columns unchanged."""
    kept = _scored(docs, *train(docs, labels), docs.columns).where(F.col("toxic_score") < threshold)
    return kept.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, *train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"))

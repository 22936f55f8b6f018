"""Language identification by multilingual mixture inference.

Every document is a mixture of languages. Character trigrams (hashed to buckets) have a
smoothed likelihood under each language; expectation-maximisation estimates the
document's language proportions, and the set of languages is the one with the best
penalised likelihood among the nested sets of the most probable ones.

Training: trigram counts per language from at most ``LANGUAGE_DOCS`` rows of each (about
that many, chosen by a hash of the id; all of a rarer language) with a non-null ``lang``
outside the held-out fold. The model has ``BUCKETS`` numbers per language, whatever the
corpus.

Defined results: text null or without a letter gives ``und`` with score 0; without
training rows everything is ``und``; repeated rows are scored each; columns other than
doc_id, text and lang are ignored; ties go to the language first by code point.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, held_out, sampled, table

LANGUAGE_DOCS = 5_000
BITS = 16
BUCKETS = 1 << BITS
SMOOTH = 0.5
FULL_ROUNDS, SET_ROUNDS = 10, 8
#: A further language must raise the log likelihood by this times log(trigrams).
PENALTY = 2.0
LEAST_SHARE = 0.03


@functools.cache
def _letters() -> np.ndarray:
    """Lower-case code point of every letter; 0 for what is not a letter."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = ord(chr(c).lower()[0])
    return out


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, bucket and count of every distinct trigram of each text, in row order.

    Runs of other characters than letters count as one space; every letter of a text is
    the middle of one trigram, as a text begins and ends with a space.
    """
    joined = "\0 ".join(f"{t or ''} " for t in texts)
    joined = f" {joined}"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t or "") + 3 for t in texts])[: len(codes)]
    c = _letters()[codes]
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0) | (row[1:] != row[:-1])
    c, row = c[keep].astype(np.uint64), row[keep]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[2:] * np.uint64(0x165667B19E3779F9))
    h = (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)
    good = (row[:-2] == row[2:]) & (c[1:-1] != 0)
    key = (row[:-2][good].astype(np.int64) << BITS) | h[good].astype(np.int64)
    key.sort()
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[at] >> BITS, key[at] & (BUCKETS - 1), np.diff(np.append(at, len(key)))


def train(docs: DataFrame, bound: int = LANGUAGE_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and the trigram probabilities, one row per bucket."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    known = F.broadcast(rows.groupBy("lang").agg(F.count("*").alias("docs")))  # a row per language, as in the model
    rows = rows.join(known, "lang").where(sampled(F.col("doc_id"), F.col("docs"), bound))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in chunks(batch, "text"):
                langs = np.array(part.column("lang").to_pylist(), dtype=object)
                row, bucket, n = trigrams(part.column("text").to_pylist())
                for lang in set(langs):
                    own = (langs == lang)[row]
                    held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    held[lang] += np.bincount(bucket[own], n[own], BUCKETS).astype(np.int64)
        for lang, counts in held.items():
            b = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(b), pa.string()), pa.array(b.astype(np.int32)), pa.array(counts[b])], names=["lang", "bucket", "n"])

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toArrow()  # at most BUCKETS rows a language
    langs = sorted(set(got.column("lang").to_pylist()))
    model = np.full((BUCKETS, len(langs)), SMOOTH)
    if langs:
        number = {lang: i for i, lang in enumerate(langs)}
        model[got.column("bucket").to_numpy(), [number[x] for x in got.column("lang").to_pylist()]] += got.column("n").to_numpy()
        model /= model.sum(axis=0)
    return langs, model.astype(np.float32)


def _em(p: np.ndarray, n: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood per document; p: trigram likelihoods, documents one after another."""
    total = np.add.reduceat(n, starts)[:, None]
    for _ in range(rounds):
        r = p * np.repeat(pi, sizes, axis=0)
        s = r.sum(axis=1)
        r *= (n / s)[:, None]
        pi = (np.add.reduceat(r, starts, axis=0) / total).astype(np.float32)
    s = np.einsum("ij,ij->i", p, np.repeat(pi, sizes, axis=0))
    return pi, np.add.reduceat(n * np.log(np.maximum(s, 1e-30)), starts)


def infer(texts: list[str | None], langs: list[str], model: np.ndarray) -> tuple[list[str], np.ndarray, list[str]]:
    """Predicted language, its proportion, and the selected set as text, per text."""
    pred, score, chosen = ["und"] * len(texts), np.zeros(len(texts)), [""] * len(texts)
    row, bucket, n = trigrams(texts)
    if not len(row) or not langs:
        return pred, score, chosen
    starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    sizes, docs = np.diff(np.append(starts, len(row))), row[starts]
    p, n = model[bucket], n.astype(np.float32)
    pi, _ = _em(p, n, starts, sizes, np.full((len(docs), len(langs)), 1 / len(langs), np.float32), FULL_ROUNDS)
    order = np.argsort(-pi, axis=1, kind="stable")
    best = np.zeros_like(pi)
    best[np.arange(len(docs)), order[:, 0]] = 1
    mixed = np.flatnonzero(np.take_along_axis(pi, order, 1)[:, min(1, len(langs) - 1)] >= LEAST_SHARE) if len(langs) > 1 else np.zeros(0, int)
    if len(mixed):
        inside = np.zeros(len(docs), dtype=bool)
        inside[mixed] = True
        grams = np.repeat(inside, sizes)
        p2, n2, sizes2 = p[grams], n[grams], sizes[mixed]
        starts2 = np.concatenate(([0], np.cumsum(sizes2)[:-1]))
        count = np.log(np.add.reduceat(n2, starts2) + 1)
        value = np.full(len(mixed), -np.inf)
        for k in range(1, len(langs) + 1):  # until a further language helps no document
            start = np.zeros((len(mixed), len(langs)), np.float32)
            top = order[mixed, :k]
            np.put_along_axis(start, top, np.maximum(np.take_along_axis(pi[mixed], top, 1), 1e-6), 1)
            start /= start.sum(axis=1, keepdims=True)
            found, ll = _em(p2, n2, starts2, sizes2, start, 0 if k == 1 else SET_ROUNDS)
            ll = ll - PENALTY * (k - 1) * count
            better = ll > value
            if not better.any():
                break
            value[better] = ll[better]
            best[mixed[better]] = found[better]
    top = best.argmax(axis=1)
    for i, d in enumerate(docs):
        pred[d], score[d] = langs[top[i]], best[i, top[i]]
        chosen[d] = ",".join(langs[j] for j in np.flatnonzero(best[i] >= LEAST_SHARE))
    return pred, np.clip(score, 0, 1), chosen


def identify(docs: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score and languages (the selected set) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))  # BUCKETS x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, model = shared.value
        for batch in batches:
            for part in chunks(batch, "text", 1 << 18):
                pred, score, chosen = infer(part.column("text").to_pylist(), langs, model)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred), pa.array(score), pa.array(chosen)], names=["doc_id", "lang_pred", "score", "languages"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, languages string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, model = train(docs)
    return identify(docs, langs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")

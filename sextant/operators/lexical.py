"""Field-weighted lexical retrieval with a relevance cutoff.

Queries are requests: a short list that the caller states. They travel with the plan as
literals, so every document is read once for all of them and nothing is joined. Corpus
statistics come from admitted entries only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.text import normalise, query_tokens
from ..sources.tables import stored

#: Fixed values of the scorer: field weights in order, saturation, least coverage, cutoff ratios.
WEIGHTS = (4.0, 2.0, 2.0, 1.0)
K1 = 3.0
LEAST_COVERAGE = 2
SPARSE, SPARSE_RATIO, CROWDED_RATIO = 2, (1, 3), (3, 4)
FIELDS = ("title", "description", "metadata", "body")


def fields(entries: DataFrame, key: str, columns: tuple[Column, ...], exact: bool = True) -> DataFrame:
    """key and the four scored fields, normalised; null fields are empty."""
    return entries.select(key, *(normalise(F.coalesce(c, F.lit("")), exact).alias(f) for f, c in zip(FIELDS, columns)))


def entry_fields(entries: DataFrame, exact: bool = True) -> DataFrame:
    meta = F.array_join(F.filter(F.concat(F.array("type", "content_category"), F.coalesce("tags", F.array().cast("array<string>"))), lambda x: x.isNotNull()), " ")
    return fields(entries, "concept_id", (F.col("title"), F.col("description"), meta, F.col("body")), exact)


def averages(scored_fields: DataFrame) -> DataFrame:
    """Mean length of every field; 0 without entries."""
    return scored_fields.agg(*(F.coalesce(F.avg(F.length(f)), F.lit(0.0)).alias(f) for f in FIELDS))


#: Entries whose counts are held at once in a task.
COUNT_ROWS = 1_024


def _counted(scored_fields: DataFrame, key: str, tokens: list[str]) -> DataFrame:
    """key, lengths (characters of each field) and counts (of each token, field by field) of entries that hold a token.

    Occurrences do not overlap. Each text is read once, and searched once for a token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, COUNT_ROWS):
                part = batch.slice(at, COUNT_ROWS)
                texts = [[x or "" for x in part.column(f).to_pylist()] for f in FIELDS]
                lengths = np.array([[len(x) for x in column] for column in texts], np.int32).T
                counts = np.array([[x.count(token) for x in column] for token in tokens for column in texts], np.int32).T
                held = counts.any(axis=1)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(held.sum() + 1) * x.shape[1], pa.int32()), pa.array(x[held].ravel())) for x in (lengths, counts)]
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(held)), *lists], names=[key, "lengths", "counts"])

    schema = StructType([StructField(key, scored_fields.schema[key].dataType), *(StructField(x, ArrayType(IntegerType())) for x in ("lengths", "counts"))])
    return scored_fields.select(key, *FIELDS).mapInArrow(run, schema)


def scores(scored_fields: DataFrame, key: str, queries: Iterable[tuple[str, str]], exact: bool = True) -> DataFrame:
    """qid, key, score, coverage of entries above zero that reach the least coverage."""
    mean = averages(scored_fields).first()
    asked = [(qid, query_tokens(q, exact)) for qid, q in queries]
    if any(not tokens for _, tokens in asked):
        raise ValueError("a query is blank")
    number = {token: i for i, token in enumerate(dict.fromkeys(t for _, tokens in asked for t in tokens))}

    def weighted(token: Column) -> Column:
        parts = []
        for i, (f, w) in enumerate(zip(FIELDS, WEIGHTS)):
            length, n = F.get("lengths", F.lit(i)), F.get("counts", token * len(FIELDS) + i)
            parts.append(F.when(length > 0, w * n * mean[f] / length).otherwise(0.0))
        return parts[0] + parts[1] + parts[2] + parts[3]

    literal = F.array(*(F.struct(F.lit(qid).alias("qid"), F.array(*(F.lit(number[t]) for t in tokens)).alias("tokens")) for qid, tokens in asked))
    rows = _counted(scored_fields, key, list(number)).select(key, "lengths", "counts", F.explode(literal).alias("q"))
    rows = rows.select(F.col("q.qid").alias("qid"), key, F.size("q.tokens").alias("n"), F.transform("q.tokens", weighted).alias("tf"))
    found = rows.select(
        "qid", key, "n", F.aggregate("tf", F.lit(0.0), lambda s, x: s + x * (K1 + 1.0) / (x + K1)).alias("score"), F.size(F.filter("tf", lambda x: x > 0)).alias("coverage")
    )
    return found.where((F.col("score") > 0) & (F.col("coverage") >= F.least(F.lit(LEAST_COVERAGE), F.col("n")))).drop("n")


def cutoff(scored: DataFrame) -> DataFrame:
    """Rows that reach the query's share of its top score, with ``total``, the survivors of the query.

    The scored rows (without texts) are stored first, as they are read three times. Per query
    a count and a maximum are partial aggregates; the few rows they leave are joined back.
    """
    scored = stored(scored)
    top = scored.groupBy("qid").agg(F.count("*").alias("_n"), F.max("score").alias("_top"))
    sparse = F.col("_n") <= SPARSE
    num, den = (F.when(sparse, SPARSE_RATIO[i]).otherwise(CROWDED_RATIO[i]) for i in range(2))
    kept = scored.join(top, "qid").where(den * F.col("score") >= num * F.col("_top")).drop("_n", "_top")
    return kept.join(kept.groupBy("qid").agg(F.count("*").alias("total")), "qid")


def search(scored_fields: DataFrame, key: str, queries: Iterable[tuple[str, str]], limit: int = 10, exact: bool = True) -> DataFrame:
    """qid, rank (from 1), key, score, total."""
    if not 1 <= limit <= 20:
        raise ValueError("limit is 1 to 20")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), key)
    return cutoff(scores(scored_fields, key, queries, exact)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("coverage")

"""End-to-end evaluation: what engines return for stated questions, measured, summed, and put to the gate.

questions: qid, category, provenance, expected (array of paths). returned: qid, engine,
path, cited (whether the citation names this concept and the revision that was searched).
A question's answer is what it returned of the indexed paths; anything else is a leak.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import hit, nearest_rank, rate

NO_ANSWER = "no-answer"


def cited(concept: str, path: str, revision: str, searched: str):
    """Whether a citation names the concept's own note and the revision that was searched."""
    named = F.concat(F.col(concept), F.lit(".md")).eqNullSafe(F.col(path))
    return named & F.col(revision).isNotNull() & F.col(revision).eqNullSafe(F.col(searched))


def report(questions: DataFrame, returned: DataFrame, engines: tuple[str, ...], indexed: DataFrame, tokens: DataFrame, superseded: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """A row per question and engine, also for those that returned nothing.

    failed (qid, engine): questions that an engine could not be asked. All or nothing: one
    of them, and no measure of that engine counts (null for every question).

    results, hit (null if nothing is expected), leaks, token_cost (null as soon as one
    path is unmeasured), stale_returned, citations_correct. Answers are at most a result
    list, so that a question's paths fit a row.
    """
    flagged = (
        returned.join(indexed.select("path", F.lit(True).alias("_in")).distinct(), "path", "left")
        .join(tokens.select("path", F.col("tokens").alias("_tokens")), "path", "left").join(superseded.select("path", F.lit(True).alias("_old")).distinct(), "path", "left")
    )
    kept = F.col("_in").isNotNull()
    per = flagged.groupBy("qid", "engine").agg(
        F.collect_list(F.when(kept, F.col("path"))).alias("_paths"), F.count_if(~kept).alias("leaks"), F.sum(F.when(kept, F.col("_tokens"))).alias("_sum"),
        F.count_if(kept & F.col("_tokens").isNull()).alias("_unmeasured"), F.count_if(kept & F.col("_old").isNotNull()).alias("_stale"), F.count_if(~F.coalesce("cited", F.lit(False))).alias("_wrong"),
    )
    asked = questions.withColumn("engine", F.explode(F.array(*map(F.lit, engines))))
    rows = asked.join(per, ["qid", "engine"], "left")
    if failed is None:
        rows = rows.withColumn("_ok", F.lit(True))
    else:
        rows = rows.join(failed.select("engine", F.lit(False).alias("_ok")).distinct(), "engine", "left").withColumn("_ok", F.coalesce("_ok", F.lit(True)))
    known = lambda c: F.when(F.col("_ok"), c)
    paths, none = F.coalesce("_paths", F.array().cast("array<string>")), F.lit(0).cast("long")
    return rows.select(
        "qid", "engine", "category", "provenance", F.size("expected").alias("expected"), known(F.size(paths)).alias("results"), known(hit(F.col("expected"), paths)).alias("hit"),
        known(F.coalesce("leaks", none)).alias("leaks"), known(F.when(F.coalesce("_unmeasured", none) == 0, F.coalesce("_sum", none))).alias("token_cost"),
        known(F.coalesce("_stale", none) > 0).alias("stale_returned"), known(F.coalesce("_wrong", none) == 0).alias("citations_correct"),
    )


def summary(rows: DataFrame, provenances: tuple[str, ...]) -> DataFrame:
    """Sums of a report per engine: pooled (provenance null) and for each of ``provenances``, empty ones included.

    Rates are null, not zero, where nothing was asked; token totals are over measured
    questions, the others are counted; abstention is null without a no-answer question.
    """
    measures = [
        F.count("*").alias("questions"), F.count("hit").alias("scored"), F.count_if(F.col("hit")).alias("hits"), F.coalesce(F.sum("token_cost"), F.lit(0)).alias("token_total"), F.count_if(F.col("results").isNotNull() & F.col("token_cost").isNull()).alias("unmeasured"),
        F.coalesce(F.sum("leaks"), F.lit(0)).alias("leaks"), F.count_if(~F.col("stale_returned")).alias("stale_excluded"), F.count_if(F.col("citations_correct")).alias("citations_correct"),
        F.count_if((F.col("category") == NO_ANSWER) & (F.col("expected") == 0)).alias("_silent"), F.count_if((F.col("category") == NO_ANSWER) & (F.col("expected") == 0) & (F.col("results") > 0)).alias("_spoken"),
    ]
    sums = rows.groupingSets([["engine"], ["engine", "provenance"]], "engine", "provenance").agg(*measures, F.grouping("provenance").alias("_pooled"))
    names = [m for m in sums.columns if m not in ("engine", "provenance", "_pooled")]
    groups = F.array(F.lit(None).cast("string"), *map(F.lit, provenances))
    wanted = rows.select("engine").distinct().withColumn("provenance", F.explode(groups))
    of = sums.where((F.col("_pooled") == 1) | F.col("provenance").isNotNull()).withColumnsRenamed({"engine": "_e", "provenance": "_p"})
    full = wanted.join(of, (F.col("engine") == F.col("_e")) & F.col("provenance").eqNullSafe(F.col("_p")), "left").withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in names})
    return full.select(
        "engine", "provenance", "questions", "scored", "hits", rate(F.col("hits"), F.col("scored")).alias("hit_rate"), "token_total", "unmeasured", "leaks", "stale_excluded",
        rate(F.col("stale_excluded"), F.col("questions")).alias("stale_excluded_rate"), "citations_correct", F.when(F.col("_silent") > 0, F.col("_spoken") == 0).alias("no_answer_correct"),
    )


def gate_summary(rows: DataFrame, candidate: str, baseline: str, provenance: str, latencies: DataFrame) -> DataFrame:
    """The one row that ``evaluate.gate`` judges, from a report and latencies (engine, value).

    Hit rates are those of one provenance. Tokens are compared over the same work: the
    questions that the baseline hit; null where there is none. A baseline counts as
    compared only if it could be asked every question.
    """
    of = lambda engine, c: F.max(F.when(F.col("engine") == engine, F.col(c)))
    real = F.first("provenance") == provenance
    wide = rows.groupBy("qid").agg(
        real.alias("real"), F.min("citations_correct").alias("cited"), F.sum("leaks").alias("leaks"), of(candidate, "hit").alias("c_hit"), of(baseline, "hit").alias("b_hit"),
        of(candidate, "token_cost").alias("c_cost"), of(baseline, "token_cost").alias("b_cost"), of(baseline, "results").alias("b_kept"),
        F.max(F.when(F.col("engine") == baseline, F.col("results") + F.col("leaks"))).alias("b_raw"), F.count_if((F.col("engine") == baseline) & F.col("results").isNotNull()).alias("b_rows"),
    )
    work = F.col("real") & F.coalesce("b_hit", F.lit(False))
    hits = lambda c: F.count_if(F.col("real") & F.col(c))
    scored = lambda c: F.count_if(F.col("real") & F.col(c).isNotNull())
    total = lambda c: F.sum(F.when(work, F.coalesce(c, F.lit(0))))
    sums = wide.agg(
        F.count_if("cited").alias("citation_correct"), F.count("*").alias("total_questions"), F.coalesce(F.sum("leaks"), F.lit(0)).alias("false_negatives"), (F.count_if(F.col("b_rows") > 0) == F.count("*")).alias("compared"),
        F.when(F.count_if(F.col("b_raw") > 0) > 0, F.count_if(F.col("b_kept") > 0) > 0).alias("scope_overlap"), rate(hits("c_hit"), scored("c_hit")).alias("lexical_rate"), rate(hits("b_hit"), scored("b_hit")).alias("baseline_rate"),
        scored("b_hit").alias("baseline_scored"), hits("b_hit").alias("baseline_hits"), total("c_cost").alias("lexical_tokens"), total("b_cost").alias("baseline_tokens"),
        F.count_if(work & (F.col("c_cost").isNull() | F.col("b_cost").isNull())).alias("tokens_unmeasured"),
    )
    late = latencies.groupBy("engine").agg(nearest_rank("value", 0.95).alias("p95")).agg(of(candidate, "p95").alias("lexical_p95"), of(baseline, "p95").alias("baseline_p95"))
    return sums.join(late)  # one row each


def without_latency(rows: DataFrame) -> DataFrame:
    """A summary for comparison between runs: the columns that time does not change."""
    return rows.drop(*(c for c in rows.columns if c.endswith("_p95") or c.startswith("latency")))

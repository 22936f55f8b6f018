"""Evaluation: hit rates, percentiles, token cost, leaks, staleness, gate, export comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, frontmatter


def rate(hits: Column, of: Column, digits: int = 4) -> Column:
    """Null, not zero, where nothing was scored."""
    return F.bround(hits / F.nullif(of, F.lit(0)), digits)


def hit(expected: Column, returned: Column) -> Column:
    """Whether all expected paths were returned; null if none is expected."""
    return F.when(F.size(expected) > 0, F.size(F.array_except(expected, returned)) == 0)


def hit_rates(questions: DataFrame, by: str) -> DataFrame:
    """questions, scored, hits, rate: pooled (``by`` null, pooled true) and per value of ``by``."""
    measures = [F.count("*").alias("questions"), F.count("hit").alias("scored"), F.count_if(F.col("hit")).alias("hits")]
    rows = questions.groupingSets([[], [by]], by).agg(*measures, F.grouping(by).alias("g"))
    return rows.select(by, (F.col("g") == 1).alias("pooled"), "questions", "scored", "hits", rate(F.col("hits"), F.col("scored")).alias("rate"))


def nearest_rank(value: str, share: float) -> Column:
    """A measured value of a column or SQL expression, never an interpolation; 0 without values."""
    return F.coalesce(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})"), F.lit(0.0))


def latency(samples: DataFrame, value: str, *by: str, digits: int = 3) -> DataFrame:
    return samples.groupBy(*by).agg(*(F.bround(c, digits).alias(n) for n, c in (("total", F.coalesce(F.sum(value), F.lit(0.0))), ("p50", nearest_rank(value, 0.5)), ("p95", nearest_rank(value, 0.95)))))


def token_cost(returned: DataFrame, tokens: DataFrame, question: str, path: str) -> DataFrame:
    """Per question the tokens of the returned paths; null as soon as one path is unmeasured."""
    rows = returned.join(tokens.select(F.col(path), "tokens"), path, "left")
    return rows.groupBy(question).agg(F.when(F.count("tokens") == F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).alias("token_cost"))


def leaks(returned: DataFrame, allowed: DataFrame, path: str) -> DataFrame:
    """Returned items (each counts) outside the allowed paths."""
    return returned.join(allowed.select(path), path, "left_anti")


def false_positives(public: DataFrame, indexed: DataFrame, path: str) -> DataFrame:
    """Paths that are public and not indexed."""
    return public.select(path).distinct().join(indexed.select(path), path, "left_anti")


def stale_flag(previous: Column, before: Column, after: Column) -> Column:
    """Whether a revision changed; null if unknown, false at the first look."""
    return F.when(previous.isNull(), False).when(before.isNull() | after.isNull(), F.lit(None)).otherwise(before != after)


#: Items of the gate with their kind, in order.
GATE_ITEMS = (
    ("citation_correctness", "absolute"), ("privacy_false_negative", "absolute"), ("baseline_compared", "precondition"), ("baseline_scope_overlap", "precondition"),
    ("answerable_hit_rate", "relative"), ("context_token_total", "relative"), ("latency_p95", "relative"), ("stale_exclusion", "relative"), ("privacy_false_positive", "quality"),
)


def gate(summary: DataFrame) -> DataFrame:
    """item, kind, status per row of GATE_ITEMS from a one-row summary.

    Columns: citation_correct, total_questions, false_negatives, compared, scope_overlap,
    lexical_rate, baseline_rate, baseline_scored, baseline_hits, lexical_tokens,
    baseline_tokens, tokens_unmeasured, lexical_p95, baseline_p95. A baseline that hits
    nothing makes every relative item not evaluable and fails the gate.
    """
    ok = lambda c: F.when(c, "pass").otherwise("fail")
    compared = F.coalesce("compared", F.lit(False))
    degenerate = compared & (F.col("baseline_scored") > 0) & (F.col("baseline_hits") == 0)
    relative = lambda missing, good: F.when(degenerate | ~compared | missing, "not_evaluable").otherwise(ok(good))
    status = {
        "citation_correctness": F.when(F.col("total_questions") == 0, "not_evaluable").otherwise(ok(F.col("citation_correct") == F.col("total_questions"))),
        "privacy_false_negative": ok(F.col("false_negatives") == 0),
        "baseline_compared": ok(compared),
        "baseline_scope_overlap": F.when(F.col("scope_overlap").eqNullSafe(F.lit(False)), "fail").otherwise("pass"),
        "answerable_hit_rate": relative(F.col("baseline_rate").isNull() | F.col("lexical_rate").isNull(), F.col("lexical_rate") >= F.col("baseline_rate")),
        "context_token_total": relative(F.col("lexical_tokens").isNull() | F.col("baseline_tokens").isNull() | (F.col("tokens_unmeasured") > 0), F.col("lexical_tokens") <= F.col("baseline_tokens")),
        "latency_p95": relative(F.col("baseline_p95").isNull(), F.col("lexical_p95") <= 2 * F.col("baseline_p95")),
        "stale_exclusion": F.lit("not_evaluable"),
        "privacy_false_positive": F.lit("recorded"),
    }
    items = F.array(*(F.struct(F.lit(n).alias("item"), F.lit(k).alias("kind"), status[n].alias("status")) for n, k in GATE_ITEMS))
    extra = F.when(degenerate, F.array(F.struct(F.lit("degenerate_baseline").alias("item"), F.lit("absolute").alias("kind"), F.lit("fail").alias("status"))))
    return summary.select(F.explode(F.concat(items, F.coalesce(extra, F.expr("array()").cast("array<struct<item:string,kind:string,status:string>>")))).alias("x")).select("x.*")


def verdict(items: DataFrame) -> DataFrame:
    return items.agg(F.when(F.count_if(F.col("status") == "fail") > 0, "fail").otherwise("pass").alias("verdict"))


def zones(path: Column, status: Column, candidate: Column, library_id: Column, privacy: Column) -> Column:
    """The export zones that a note may be in, by the shape of its path and its metadata."""
    p = F.split(path, "/")
    n, at = F.size(p), lambda i: F.try_element_at(p, F.lit(i))
    found = F.array(
        F.when((n == 4) & (at(1) == "Private") & (at(2) == "_inbox") & (at(3) == "info-collect"), "knowledge_feed"),
        F.when((n == 5) & (at(1) == "Private") & (at(2) == "Life") & (at(4) == "reports"), "life_domains"),
        F.when((n == 2) & (at(1) == "Core") & at(2).startswith("project-") & (status == "active"), "projects"),
        F.when((n >= 3) & (at(1) == "Core") & (at(2) == "_inbox") & candidate, "development_candidates"),
        F.when((F.coalesce(library_id, F.lit("")) != "") & privacy.isin("public", "internal", "sensitive", "student-private"), "topics"),
    )
    return F.array_compact(found)


def plain_path(path: Column) -> Column:
    """For matching only: without outer space, doubled slashes, ``.`` segments, and with ``..`` taken back.

    ``..`` beyond the beginning stays in a relative path; a path that ends where it began is ``.``.
    """
    p = F.regexp_replace(F.regexp_replace(path, f"^{SPACE}+|{SPACE}+\\z", ""), r"\A\./", "")
    root = F.regexp_extract(p, r"\A(//(?!/)|/)?", 1)
    start = F.array().cast("array<string>")

    def add(done: Column, step: Column) -> Column:
        back = F.coalesce(F.try_element_at(done, F.lit(-1)) != "..", F.lit(False))
        up = F.when(back, F.slice(done, F.lit(1), F.size(done) - 1)).when(root != "", done).otherwise(F.array_append(done, step))
        return F.when(step.isin("", "."), done).when(step == "..", up).otherwise(F.array_append(done, step))

    joined = F.concat(root, F.array_join(F.aggregate(F.split(p, "/"), start, add), "/"))
    return F.when(p == "", p).when(joined == "", ".").otherwise(joined)


def note_facts(text: Column) -> Column:
    """status, candidate, library_id and privacy as a note's frontmatter states them (the last of equal keys)."""
    line = r"^([A-Za-z0-9_]+):[ \t]*(.*)$"
    trimmed = F.transform(F.coalesce(frontmatter(text)["lines"], F.array().cast("array<string>")), lambda x: F.regexp_replace(x, f"^{SPACE}+|{SPACE}+\\z", ""))
    pairs = F.transform(F.filter(trimmed, lambda x: F.regexp_like(x, F.lit(line))), lambda x: F.struct(F.regexp_extract(x, line, 1).alias("k"), F.regexp_extract(x, line, 2).alias("v")))
    plain = lambda v: F.regexp_replace(F.regexp_replace(v, f"{SPACE}+\\z", ""), r"^['\"]+|['\"]+\z", "")
    of = lambda k: plain(F.try_element_at(F.filter(pairs, lambda p: p["k"] == k), F.lit(-1))["v"])
    return F.struct(
        of("status").alias("status"), (F.lower(F.coalesce(of("development_candidate"), F.lit(""))) == "true").alias("candidate"),
        F.nullif(of("library_id"), F.lit("")).alias("library_id"), of("privacy").alias("privacy"),
    )


def pilot_catalog(notes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Catalog rows for ``export_diff`` of bound notes (path, text, title, status, candidate_status) and fresh (path, verdict)."""
    facts = note_facts(F.col("text"))
    rows = notes.withColumn("_f", facts).join(fresh.select("path", F.col("verdict").alias("fresh")), "path", "left")
    eligible = zones(F.col("path"), F.col("_f.status"), F.col("_f.candidate"), F.col("_f.library_id"), F.col("_f.privacy"))
    return rows.select("path", "title", "status", "candidate_status", eligible.alias("eligible"), F.coalesce("fresh", F.lit("unknown")).alias("fresh"))


def compare_export(catalog: DataFrame, export: DataFrame | None) -> tuple[bool, DataFrame | None, DataFrame | None]:
    """Whether there was an export to compare with, and the differences and their counts: none, rather than no rows, without one."""
    if export is None:
        return False, None, None
    diff = export_diff(catalog, export)
    return True, diff, diff_counts(diff)


def freshness(export_commit: Column, last_touch: Column, export_first: Column, note_first: Column) -> Column:
    """current, stale or unknown from two resolved commits and the two ancestor answers (null: undetermined)."""
    return (
        F.when(export_commit.isNull() | last_touch.isNull(), "unknown").when(export_commit == last_touch, "current")
        .when(export_first & ~note_first, "stale").when(note_first & ~export_first, "current").otherwise("unknown")
    )


def export_diff(catalog: DataFrame, export: DataFrame) -> DataFrame:
    """path, categories, reason, fields: how each catalog row differs from an export.

    catalog: path, title, status, candidate_status, eligible (array), fresh. export: zone,
    zone_no, path, title, status. Several rows of one path are several representations;
    the one in the first zone is compared.
    """
    shown = export.withColumn("_p", plain_path(F.col("path"))).groupBy("_p").agg(F.count("*").alias("_n"), F.min(F.struct("zone_no", "path", "zone", "title", "status")).alias("_first"))
    rows = catalog.withColumn("_p", plain_path(F.col("path"))).join(shown, "_p", "left")
    first = F.col("_first")
    none_if_empty = lambda c: F.nullif(c, F.lit(""))
    reference = F.when(first["zone"] == "development_candidates", F.col("candidate_status")).otherwise(F.col("status"))
    fields = F.array_compact(F.array(
        F.when(first["title"].isNotNull() & ~first["title"].eqNullSafe(F.col("title")), "title"),
        F.when(first["status"].isNotNull() & ~none_if_empty(first["status"]).eqNullSafe(none_if_empty(reference)), "status"),
    ))
    missing = F.col("_n").isNull()
    reason = F.when(missing, F.when(F.size("eligible") == 0, "structural").when(F.col("fresh") == "stale", "freshness").otherwise("unknown"))
    found = F.array_compact(F.array(F.when(F.col("_n") > 1, "extra_in_export"), F.when(first["path"] != F.col("path"), "path_mismatch"), F.when(F.size(fields) > 0, "metadata_mismatch")))
    categories = F.when(missing, F.array(F.lit("missing_from_export"))).when(F.size(found) == 0, F.array(F.lit("matched_clean"))).otherwise(found)
    return rows.select("path", categories.alias("categories"), reason.alias("reason"), F.when(missing, F.array().cast("array<string>")).otherwise(fields).alias("fields"))


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.select(F.explode("categories").alias("category"), "reason").groupBy("category", "reason").agg(F.count("*").alias("n"))

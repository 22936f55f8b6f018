"""Metadata conversion and write targets."""

from __future__ import annotations

import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from .catalog import strict_loader
from .privacy import NEVER

_OFFSET = r"\A\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}(:?\d{2})?)\z"
#: Fields that the target profile knows.
PROFILE = (
    "type", "title", "description", "resource", "tags", "sources", "generated", "verified", "status", "stale_after", "okf_version", "id", "created_at", "privacy",
    "content_category", "workflow_status", "category_id", "topic_id", "module_id", "allowed_sinks", "legacy", "metadata_gaps", "series_id", "created", "updated", "url",
)


def aware(value: Column) -> Column:
    """Whether text is a real time with a time of day and an offset from UTC-12 to UTC+14."""
    offset = F.regexp_extract(value, r"(Z|[+-]\d{2}:?\d{0,2})\z", 1)
    digits = F.rpad(F.regexp_replace(F.substring(offset, 2, 5), ":", ""), 4, "0")
    minutes = F.when(offset == "Z", 0).otherwise(F.try_to_number(F.substring(digits, 1, 2), F.lit("99")) * 60 + F.try_to_number(F.substring(digits, 3, 2), F.lit("99"))) * F.when(offset.startswith("-"), -1).otherwise(1)
    plain = F.regexp_replace(F.regexp_replace(value, r"(Z|[+-]\d{2}:?\d{0,2})\z", ""), " ", "T")
    return F.coalesce(F.regexp_like(value, F.lit(_OFFSET)) & F.try_to_timestamp(plain).isNotNull() & minutes.between(-720, 840), F.lit(False))


def convert(rows: DataFrame) -> DataFrame:
    """metadata (map of JSON texts or plain strings) to created_at, sources, gaps, dropped and unmapped.

    Columns read: timestamp, created_at (text), citations, citations_capital (the other
    spelling), sources (arrays of text), has_generated (boolean), keys (all keys of the source). Two different citation
    fields are an error of the row.
    """
    good = F.col("created_at").isNull() & aware(F.col("timestamp"))
    cites = F.coalesce("citations", "citations_capital")
    conflict = F.col("citations").isNotNull() & F.col("citations_capital").isNotNull() & ~F.col("citations").eqNullSafe(F.col("citations_capital"))
    usable = (F.size(cites) > 0) & F.forall(cites, lambda x: x.isNotNull() & (F.trim(x) != ""))
    gaps = F.array_compact(F.array(
        F.when(F.col("timestamp").isNotNull() & F.col("created_at").isNull() & ~good, "created_at"), F.when(~F.col("has_generated"), "generated"),
    ))
    dropped = F.array_compact(F.array(
        F.when(F.col("citations").isNotNull() & F.col("citations_capital").isNotNull(), "Citations"),
        F.when(cites.isNotNull() & (F.col("sources").isNotNull() | ~usable), F.when(F.col("citations").isNotNull(), "citations").otherwise("Citations")),
        F.when(F.col("timestamp").isNotNull() & ~good, "timestamp"),
    ))
    known = F.array(*(F.lit(x) for x in (*PROFILE, "timestamp", "citations", "Citations")))
    return rows.withColumns({
        "error": F.when(conflict, "conflicting-citations"),
        "out_created_at": F.coalesce("created_at", F.when(good, F.col("timestamp"))),
        "out_sources": F.coalesce("sources", F.when(usable, cites)),
        "gaps": F.array_sort(gaps), "dropped": dropped, "legacy": F.size(gaps) > 0,
        "unmapped": F.array_sort(F.array_except("keys", known)),
    })


def target_refusal(path: Column, privacy: Column, routes: dict[str, tuple[str, ...]]) -> Column:
    """The first rule that a write target breaks. routes: prefix to the privacy classes that it takes."""
    shape = path.isNull() | (F.length(path) > 240) | (path == "") | F.contains(path, F.lit("\0")) | F.contains(path, F.lit("\\")) | path.startswith("/") | ~path.endswith(".md")
    dots = F.regexp_like(path, F.lit(r"(\A|/)(\.{0,2})(/|\z)"))
    zone = F.coalesce(*(F.when(path.startswith(p), F.lit(p)) for p in routes))
    leaf = F.substr(path, F.length(zone) + F.lit(1))
    taken = F.coalesce(*(F.when(zone == p, privacy.isin(*classes)) for p, classes in routes.items()))
    return (
        F.when(shape | dots | zone.isNull() | ~F.regexp_like(leaf, F.lit(r"\A[a-z0-9][a-z0-9._-]*\.md\z")), "target-denied")
        .when(privacy == NEVER, "student-private-denied").when(~F.coalesce(taken, F.lit(False)), "cross-zone-denied")
    )


def first_marker(content: Column, markers: list[str]) -> Column:
    """The first forbidden marker that the content holds."""
    return F.coalesce(*(F.when(F.contains(content, F.lit(m)), F.lit(m)) for m in markers))


def create_targets(targets: DataFrame, tree: DataFrame) -> DataFrame:
    """``targets`` (path) with ``refusal``: whether a new file may be made there, given a tree (path, kind: folder, file or link).

    Every folder above must exist and be one; the path itself must be free. The first
    obstacle from the top decides.
    """
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("at")))
    rows = targets.select("path").distinct().select("path", F.size(parts).alias("n"), F.inline(steps))
    seen = rows.join(tree.select(F.col("path").alias("at"), "kind"), "at", "left")
    leaf = F.col("depth") == F.col("n")
    found = (
        F.when(F.col("kind").isNull(), F.when(~leaf, "target-denied").otherwise("free")).when(F.col("kind") == "link", "symlink-denied")
        .when(leaf | (F.col("kind") != "folder"), "path-conflict")
    )
    first = seen.withColumn("found", found).where("found is not null").groupBy("path").agg(F.min_by("found", "depth").alias("refusal"))
    return targets.join(first.withColumn("refusal", F.nullif("refusal", F.lit("free"))), "path", "left")


def unexpected_changes(changes: DataFrame, targets: DataFrame) -> DataFrame:
    """Operations whose changes (operation_id, path, state) are not exactly their new, unstaged target."""
    rows = targets.select("operation_id", F.col("path").alias("target")).join(changes, "operation_id", "left")
    right = (F.col("path") == F.col("target")) & (F.col("state") == "untracked")
    per = rows.groupBy("operation_id").agg(F.count("path").alias("n"), F.count_if(F.coalesce(right, F.lit(False))).alias("good"))
    return per.where("n <> 1 or good <> 1").select("operation_id")


def validated(rows: DataFrame, *checks: tuple[str, Column]) -> DataFrame:
    """``rows`` with ``refusal``: the code of the first check, in the given order, that is not true."""
    return rows.withColumn("refusal", F.coalesce(*(F.when(~F.coalesce(good, F.lit(False)), F.lit(code)) for code, good in checks)))


_TEXTS = ArrayType(StringType())
_NOTE = StructType([StructField(*x) for x in (
    ("ok", BooleanType()), ("timestamp", StringType()), ("created_at", StringType()), ("citations", _TEXTS), ("citations_capital", _TEXTS), ("sources", _TEXTS),
    ("has_generated", BooleanType()), ("keys", _TEXTS), ("held", _TEXTS),
)])


@F.pandas_udf(_NOTE)
def note_metadata(series: pd.Series) -> pd.DataFrame:
    """What ``convert`` asks of a note's YAML. Unquoted times become ISO text; lists that are not of texts count as absent."""
    yaml, loader = strict_loader()
    texts = lambda v: [v] if isinstance(v, str) else v if isinstance(v, list) and all(isinstance(x, str) for x in v) else None
    stamp = lambda v: v.isoformat() if isinstance(v, (datetime.datetime, datetime.date)) else v if isinstance(v, str) else None
    rows = []
    for text in series:
        try:
            data = yaml.load(text, loader) if text is not None else None
        except (yaml.YAMLError, ValueError, RecursionError):
            data = None
        ok, data = isinstance(data, dict) and all(isinstance(k, str) for k in data), data if isinstance(data, dict) else {}
        held = [g for g in data.get("metadata_gaps") or () if isinstance(g, str)]
        rows.append((ok, stamp(data.get("timestamp")), stamp(data.get("created_at")), texts(data.get("citations")), texts(data.get("Citations")), texts(data.get("sources")), "generated" in data, [str(k) for k in data], held))
    return pd.DataFrame(rows, columns=_NOTE.names)


@F.pandas_udf(StringType())
def rendered_metadata(text: pd.Series, created_at: pd.Series, sources: pd.Series, gaps: pd.Series) -> pd.Series:
    """The converted metadata as YAML with sorted keys."""
    yaml, loader = strict_loader()
    out = []
    for raw, created, cites, missing in zip(text, created_at, sources, gaps):
        if raw is None:
            out.append(None)
            continue
        data = {k: v for k, v in yaml.load(raw, loader).items() if k not in ("timestamp", "citations", "Citations")}
        if created is not None and "created_at" not in data:
            data["created_at"] = created
        if cites is not None and "sources" not in data:
            data["sources"] = list(cites)
        if len(missing):
            data |= {"legacy": True, "metadata_gaps": list(missing)}
        out.append(yaml.safe_dump(data, sort_keys=True, allow_unicode=True, default_flow_style=False))
    return pd.Series(out)


def convert_notes(notes: DataFrame, text: str = "text") -> DataFrame:
    """``notes`` with ``document`` (the note with converted metadata, its body unchanged), ``error``, gaps, dropped and unmapped.

    error: no-frontmatter, unterminated, not-a-mapping or conflicting-citations; such a note has no document.
    """
    c = F.col(text)
    rest = F.substring(c, 4, 2**31 - 1)
    end = F.instr(rest, "\n---")
    front, tail = F.left(rest, end - 1), F.substr(rest, end + F.lit(4))
    rows = notes.withColumns({"_front": F.when(c.startswith("---") & (end > 0), front), "_body": F.when(tail.startswith("\n"), F.substr(tail, F.lit(2))).otherwise(tail)})
    rows = rows.withColumn("_m", note_metadata("_front"))
    own = [x for x in notes.columns]
    out = convert(rows.select(F.struct(*own).alias("_own"), "_front", "_body", "_m.*"))
    error = (
        F.when(F.col("_own")[text].isNull() | ~F.col("_own")[text].startswith("---"), "no-frontmatter").when(F.col("_front").isNull(), "unterminated")
        .when(~F.col("ok"), "not-a-mapping").otherwise(F.col("error"))
    )
    out = out.withColumn("error", error).withColumn("_gaps", F.array_sort(F.array_distinct(F.concat("gaps", "held"))))
    yaml = rendered_metadata(F.when(F.col("error").isNull(), F.col("_front")), "out_created_at", "out_sources", "_gaps")
    return out.withColumn("document", F.concat(F.lit("---\n"), yaml, F.lit("---\n\n"), "_body")).select("_own.*", "document", "error", "gaps", "dropped", "unmapped")

"""Privacy classification and admission. What is undetermined is refused, never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import frontmatter

#: Fixed values, from open to strict.
CLASSES = ("public", "internal", "sensitive", "student-private")
NEVER = "student-private"
NEVER_REASON, REFUSED_REASON = "student-private-sink", "privacy-not-admissible"


def strictness(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CLASSES)), c) - 1


def is_at_least(c: Column, floor: str) -> Column:
    return strictness(c) >= CLASSES.index(floor)


def declared(text: Column) -> Column:
    """struct(privacy, reason) of a note's text (null: unreadable), exactly one of them set."""
    front = frontmatter(text)
    found = F.filter(front["lines"], lambda x: x.startswith("privacy:"))
    value = F.regexp_extract(F.element_at(found, 1), r"\Aprivacy:[ \t]+(['\"]?)([a-z-]+)\1[ \t]*\z", 2)
    return (
        F.when(front["reason"].isNotNull(), _refuse(front["reason"]))
        .when(F.size(found) == 0, _refuse(F.lit("privacy-missing")))
        .when(F.size(found) > 1, _refuse(F.lit("privacy-duplicate")))
        .when(value.isin(*CLASSES), F.struct(value.alias("privacy"), F.lit(None).cast("string").alias("reason")))
        .otherwise(_refuse(F.lit("privacy-invalid")))
    )


def _refuse(reason: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("privacy"), reason.alias("reason"))


def classify(notes: DataFrame) -> DataFrame:
    """``notes`` (path, content) with text, privacy and reason; undecodable content has null text."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return notes.withColumn("text", text).withColumn("_c", declared(F.col("text"))).withColumns({"privacy": F.col("_c.privacy"), "reason": F.col("_c.reason")}).drop("_c")


def gate(classified: DataFrame, admissible: tuple[str, ...] = ("public",)) -> DataFrame:
    """``classified`` with ``admitted`` and the reason of every refusal; no row is dropped."""
    if NEVER in admissible or not set(admissible) <= set(CLASSES):
        raise ValueError("this set of privacy classes cannot be admitted")
    reason = (
        F.when(F.col("privacy").isNull(), F.coalesce("reason", F.lit("privacy-missing")))
        .when(F.col("privacy") == NEVER, F.lit(NEVER_REASON))
        .when(~F.col("privacy").isin(*admissible), F.lit(REFUSED_REASON))
    )
    return classified.withColumn("reason", reason).withColumn("admitted", F.col("reason").isNull())


def admitted(classified: DataFrame, admissible: tuple[str, ...] = ("public",)) -> DataFrame:
    return gate(classified, admissible).where("admitted").drop("admitted", "reason")


def partition_counts(classified: DataFrame, admissible: tuple[str, ...] = ("public",)) -> DataFrame:
    return gate(classified, admissible).groupBy("privacy", "reason", "admitted").agg(F.count("*").alias("n"))

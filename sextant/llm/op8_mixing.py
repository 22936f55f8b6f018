"""Mixing sources to target weights as a time-varying curriculum.

Each source has a weight, which fixes how many words of it the mix takes, and a
weight schedule over training time, which fixes when. The schedule is linear,
``1 + slope * (2u - 1)`` for u from 0 to 1; its integral is the source's cumulative
demand, and a document that begins at share q of its source's demand is placed where
the integral reaches q. The mix is range-sorted by that position.

Defined results: a null or empty text has size 0 and takes 0 words; a null source is a
source of its own, ranked last; repeated rows are separate documents; an empty table
gives an empty mix; other columns, whatever their names and kinds, are carried through
``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, row_hash, scratch, stored, table

WEIGHTS = (5, 2, 1)
SLOPES = (-0.5, 0.0, 0.5)
LIMIT = 3
#: How often documents past the one at the border are taken as they fit.
PASSES = 2
#: How often what is left of a source's target is filled with one more document.
FILLS = 5
#: Hex digits of the order key that split a source into ranges: 4096 of them, so that a
#: source with a third of all documents is summed by many tasks.
RANGE_DIGITS = 3
#: Rows of sources (about 100 bytes each) that may be broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def running(rows: DataFrame, order: list, **sums: str) -> DataFrame:
    """``rows`` with, per name in ``sums``, the sum of that column over the rows before in a total order.

    Rows are dealt by ranges of the order; a sum is that of the earlier ranges (a row per
    range, as many as there are shuffle partitions) plus that inside the range.
    """
    dealt = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part").agg(*(F.sum(c).alias(f"_all_{name}") for name, c in sums.items()))
    parts = parts.select("_part", *(F.coalesce(F.sum(f"_all_{name}").over(earlier), F.lit(0)).alias(f"_base_{name}") for name in sums))
    added = {name: F.col(f"_base_{name}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in sums.items()}
    return dealt.join(F.broadcast(parts), "_part").withColumns(added).drop("_part", *(f"_base_{name}" for name in sums))


def source_targets(sizes: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """One row per source: rank, source_size, weight and target; stored.

    Targets share the total by weight; one above ``limit`` times its source stops there
    and its excess goes to the others by weight. Sorted by limit per weight, the sources
    that stop are a prefix, so the water level is found with running sums. Sources may be
    as many as web hosts: ranks and sums are taken by ranges.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    ranked = running(by_source, [F.col("source").asc_nulls_last()], src_no="one").withColumn("src_no", F.col("src_no") + 1).drop("one")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("src_no") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * limit)
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    level = stored(running(ranked, [F.col("ratio"), F.col("src_no")], caps="cap", weights="weight"))
    total = level.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    height = (F.lit(total.size) - F.col("caps")) / (F.lit(total.weight) - F.col("weights"))
    water = level.select("ratio", "src_no", height.alias("level")).where("ratio >= level").agg(F.min(F.struct("ratio", "src_no", "level")).alias("w")).first().w
    share = F.lit(water.level if water else None).cast("double") * F.col("weight")
    return stored(level.select("source", "src_no", "source_size", "weight", F.least(F.col("cap").cast("double"), share).alias("target")), keep=True)


def _fills(rows: DataFrame) -> DataFrame:
    """src_no and _at of the documents that fill what the last pass leaves of a remainder: each the largest that fits, the last one that which comes nearest.

    Documents of one source with words in them are told apart by ``_at``. Each choice is a
    partial aggregate; one that would miss the remainder by more than it is is none.
    """
    left = F.max("_rest") - F.coalesce(F.sum(F.when(F.col("_last"), F.col("size"))), F.lit(0))
    gaps = stored(rows.groupBy("src_no").agg(left.alias("gap")).withColumn("chosen", F.array().cast("array<bigint>")))
    few, free = gaps.count() <= BROADCAST_SOURCES, rows.where(F.col("_more") & ~F.col("_last")).select("src_no", "size", "_key", "_at")
    for i in range(1, FILLS + 1):
        fits = free.join(F.broadcast(gaps) if few else gaps, "src_no").where((F.col("size") <= F.col("gap") if i < FILLS else F.col("size") < 2 * F.col("gap")) & ~F.array_contains("chosen", F.col("_at")))
        place = F.struct(F.abs(F.col("gap") - F.col("size")).alias("miss"), F.col("_key").alias("key"), F.col("_at").alias("pos"), F.col("size").alias("size"))
        pick = fits.groupBy("src_no").agg(F.min(place).alias("pick"))
        found = F.col("pick").isNotNull()
        gaps = gaps.join(pick, "src_no", "left")
        gaps = stored(gaps.select("src_no", F.when(found, F.col("gap") - F.col("pick.size")).otherwise(F.col("gap")).alias("gap"), F.when(found, F.array_append("chosen", F.col("pick.pos"))).otherwise(F.col("chosen")).alias("chosen")))
    return gaps.select("src_no", F.explode("chosen").alias("_at"))


def _summed(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the words of their source that come before them in hashed order: the sum over earlier hash ranges and that inside the range."""
    by_range = Window.partitionBy("src_no").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        rows.groupBy("src_no", "_range").agg(F.sum("size").alias("_in"))
        .select("src_no", "_range", F.coalesce(F.sum("_in").over(by_range), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("src_no", "_range").orderBy("_key", "doc_id", "size", "h").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(ranges, ["src_no", "_range"]).withColumn(name, F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))).drop("_before")


def plan(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, limit: int = LIMIT) -> DataFrame:
    """Per row of ``sizes`` (doc_id, source, h, size): copies, taken and positions.

    A source is passed over ``floor(target / source_size)`` times in a hashed order; in
    the last, partial pass its documents are taken as long as they lie wholly within the
    remainder, then ``PASSES`` times those behind it that fit. What is then left is filled up
    to ``FILLS`` times with the largest document not taken that fits, at last with the one that
    comes nearest, so that a source misses its target by little even where that document is large. The running sum over a source is
    two sums: over its hash ranges, then inside each range.
    """
    with scratch(sizes.sparkSession):
        sources = source_targets(sizes, weights, limit)
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.col("h").cast("string")))  # rows without an id: by their text
    rows = (
        sizes.withColumn("_key", F.md5(named.cast("binary")))
        .withColumn("_range", F.substring("_key", 1, RANGE_DIGITS))
        .join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
    )
    rows = _summed(rows, "_at")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - F.col("_whole") * F.col("source_size")
    slope = F.element_at(F.array(*map(F.lit, slopes)), ((F.col("src_no") - 1) % len(slopes) + 1).cast("int"))
    rows = rows.withColumn("_whole", whole).withColumn("_more", (F.col("_whole") < limit) & (F.col("size") > 0))
    rows = stored(rows.withColumn("_last", F.col("_more") & (F.col("_at") + F.col("size") <= rest)).withColumn("_rest", rest))
    for _ in range(PASSES):
        # Past the document at the border, in the same order, what fits.
        left = rows.groupBy("src_no").agg((F.max("_rest") - F.coalesce(F.sum(F.when(F.col("_last"), F.col("size"))), F.lit(0))).alias("_left"))
        next_ = _summed(rows.where(F.col("_more") & ~F.col("_last")).join(left, "src_no").where("size <= _left"), "_place").where(F.col("_place") + F.col("size") <= F.col("_left"))
        rows = stored(rows.join(next_.select("src_no", "_at", F.lit(True).alias("_fits")), ["src_no", "_at"], "left").withColumn("_last", F.col("_last") | (F.coalesce("_fits", F.lit(False)) & F.col("_more"))).drop("_fits"))
    filled = _fills(rows).withColumn("_filled", F.lit(True))
    rows = rows.join(filled, ["src_no", "_at"], "left").withColumn("_last", F.col("_last") | (F.coalesce("_filled", F.lit(False)) & F.col("_more")))
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.col("_whole") + F.col("_last").cast("long")).otherwise(F.lit(0)).cast("int"))
    q = lambda n: F.least(F.lit(1.0), (n * F.col("source_size") + F.col("_at")) / F.col("target"))
    at = lambda n: 2 * q(n) / ((1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * q(n)))
    return rows.withColumn("taken", F.col("copies") * F.col("size")).withColumn(
        "positions", F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), at))
    ).drop("_key", "_range", "_at", "_whole", "_more", "_last", "_rest", "_filled", "src_no", "weight")


def sizes_of(docs: DataFrame, h: Column | None = None) -> DataFrame:
    """doc_id, source, h (a hash that tells rows of one id apart; by default of the text) and size."""
    h = F.xxhash64("text") if h is None else h
    return docs.select("doc_id", "source", h.alias("h"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, a row per copy, range-sorted by position.

    Equal rows are planned one by one and travel as one: any of them may stand for another.
    """
    keyed = docs.select(F.col("doc_id").alias("id"), row_hash(docs).alias("h"), F.struct(*docs.columns).alias("row")).groupBy("id", "h").agg(F.first("row").alias("row"))
    planned = plan(stored(sizes_of(docs, row_hash(docs)))).where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.explode("positions").alias("position"))
    mixed = keyed.join(planned, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
    return mixed.select("row", "position", "id").orderBy("position", "id").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stored(sizes_of(table(spark, sf_dir, "documents")))
    return plan(sizes).select(
        "doc_id", "size", "source_size", "target", "taken", "copies",
        F.round(F.element_at("positions", 1), 9).alias("first_position"),
    ).orderBy("first_position", "doc_id")


_NEXT = "".join(
    f"""
), l{i} AS (
  SELECT src_no, max(rest) - coalesce(sum(size) FILTER (last_pass), 0)::BIGINT AS rest_left FROM base{i - 1 or ''} GROUP BY src_no
), n{i} AS (
  SELECT src_no, placed_at, size, rest_left, coalesce(sum(size) OVER (PARTITION BY src_no ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM base{i - 1 or ''} JOIN l{i} USING (src_no) WHERE more AND NOT last_pass AND size <= rest_left
), base{i} AS (
  SELECT b.* REPLACE (last_pass OR more AND n.src_no IS NOT NULL AS last_pass) FROM base{i - 1 or ''} b LEFT JOIN (SELECT * FROM n{i} WHERE place + size <= rest_left) n ON n.src_no = b.src_no AND n.placed_at = b.placed_at"""
    for i in range(1, PASSES + 1)
)
_CHAIN = "".join(
    f"""
), p{i} AS (
  SELECT g.src_no, min(struct_pack(miss := abs(gap - size), key := key, pos := placed_at, size := size)) AS pick FROM g{i - 1} g JOIN base{PASSES} b ON b.src_no = g.src_no
  WHERE more AND NOT last_pass AND {'size <= gap' if i < FILLS else 'size < 2 * gap'} AND NOT list_contains(chosen, placed_at) GROUP BY g.src_no
), g{i} AS (
  SELECT src_no, CASE WHEN pick IS NULL THEN gap ELSE gap - (pick).size END AS gap, CASE WHEN pick IS NULL THEN chosen ELSE list_append(chosen, (pick).pos) END AS chosen FROM g{i - 1} LEFT JOIN p{i} USING (src_no)"""
    for i in range(1, FILLS + 1)
)
ORACLE = rf"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS src_no FROM by_source
), weighted AS (
  SELECT *, [5, 2, 1][(src_no - 1) % 3 + 1] AS weight, [-0.5, 0.0, 0.5][(src_no - 1) % 3 + 1]::DOUBLE AS slope FROM ranked
), levels AS (
  SELECT *, ((sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / weight, src_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY source_size * 3 / weight, src_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE) AS level FROM weighted
), lam AS (
  SELECT arg_min(level, struct_pack(a := source_size * 3 / weight, b := src_no)) AS lam FROM levels WHERE source_size * 3 / weight >= level
), sources AS (
  SELECT source, src_no, source_size, slope, least((source_size * 3)::DOUBLE, lam * weight) AS target FROM levels, lam
), placed AS (
  SELECT s.doc_id, s.size, t.src_no, t.source_size, t.target, t.slope, md5(coalesce(s.doc_id::VARCHAR, '')) AS key,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
    coalesce(sum(s.size) OVER (PARTITION BY t.src_no ORDER BY md5(coalesce(s.doc_id::VARCHAR, '')), s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS placed_at
  FROM sizes s JOIN sources t ON s.source IS NOT DISTINCT FROM t.source
), base AS (
  SELECT *, whole < 3 AND size > 0 AS more, whole < 3 AND size > 0 AND placed_at + size <= target - whole * source_size AS last_pass, target - whole * source_size AS rest, least(1.0, placed_at / target) AS q FROM placed{_NEXT}
), g0 AS (
  SELECT src_no, max(rest) - coalesce(sum(size) FILTER (last_pass), 0)::BIGINT AS gap, []::BIGINT[] AS chosen FROM base{PASSES} GROUP BY src_no{_CHAIN}
), filled AS (
  SELECT src_no, unnest(chosen) AS placed_at FROM g{FILLS}
), taken AS (
  SELECT b.*, CASE WHEN size > 0 THEN whole + (last_pass OR more AND f.src_no IS NOT NULL)::BIGINT ELSE 0 END AS n FROM base{PASSES} b LEFT JOIN filled f ON f.src_no = b.src_no AND f.placed_at = b.placed_at AND b.more
)
SELECT doc_id, size, source_size, target, n * size AS taken, n::INTEGER AS copies,
  CASE WHEN n > 0 THEN round(2 * q / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * q)), 9) END AS first_position
FROM taken
"""

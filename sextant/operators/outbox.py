"""The durable work queue as state transitions: enqueue, lease, expiry, retry, quarantine."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digest import framed_sha256
from ..sources.tables import placed, stored
from ..sources.versions import Versions
from .graph import components

#: Fixed values.
TERMINAL = ("committed", "conflict", "quarantined", "expired")
IDENTITY = ("operation_id", "idempotency_hash", "actor", "task_hash", "target_path", "request_hash")
BOUND = ("record_version", "writer_contract", "operation_id", "idempotency_hash", "actor", "task_hash", "target_path", "request_hash", "content_hash", "base_commit", "created_at", "expires_at")
#: Dispositions of refusals on replay; anything else is quarantined.
DISPOSITIONS = {"base-moved": "retry-transient", "leader-unavailable": "retry-free", "path-conflict": "conflict", "idempotency-conflict": "conflict"}


def timestamp_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def binding_hash(domain: str) -> Column:
    """Length-framed digest of every bound column of a record."""
    text = lambda c: timestamp_text(F.col(c)) if c.endswith("_at") else F.col(c)
    return framed_sha256(F.lit(domain), *(text(c) for c in BOUND))


def rebound(records: DataFrame, domain: str) -> DataFrame:
    """Records with ``intact``: whether their binding hash still covers their columns."""
    return records.withColumn("intact", F.col("binding_hash").eqNullSafe(binding_hash(domain)))


#: Pairs of operation and key that one task may decide, at about 100 bytes each.
ONE_TASK = 500_000
#: Rounds by which more pairs are thinned out before they are split into connected groups.
ROUNDS = 4


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (operation, key), in the order of their rows, of which neither was in a pair taken before."""
    operations, keys = set(), set()
    for batch in batches:
        taken = []
        for i, (operation, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if operation not in operations and key not in keys:
                operations.add(operation), keys.add(key)
                taken.append(i)
        yield batch.select([0, 1]).take(pa.array(taken, pa.int64()))


def _accepted(pairs: DataFrame) -> DataFrame:
    """operation_id, idempotency_hash of the pairs (with _at) that come before all others of their operation and of their key, as the earlier ones are taken."""
    kind, taken = "operation_id string, idempotency_hash string", []
    left = pairs.select("operation_id", "idempotency_hash", "_at")
    for _ in range(ROUNDS):
        if left.count() <= ONE_TASK:
            break
        # First by operation and by key at once: taken. What shares either with one taken: decided.
        ahead = [left.groupBy(c).agg(F.min("_at").alias(f"_{c}")) for c in ("operation_id", "idempotency_hash")]
        first = stored(left.join(ahead[0], "operation_id").join(ahead[1], "idempotency_hash").where("_at = _operation_id AND _at = _idempotency_hash").select("operation_id", "idempotency_hash"))
        taken.append(first)
        left = stored(left.join(first.select("operation_id"), "operation_id", "left_anti").join(first.select("idempotency_hash"), "idempotency_hash", "left_anti"))
    if left.count() <= ONE_TASK:
        rest = left.repartition(1).sortWithinPartitions("_at").select("operation_id", "idempotency_hash").mapInArrow(_in_order, kind)
    else:
        # Pairs of different connected groups do not meet; a task streams its groups in order and holds their names only.
        left = left.withColumns({"_u": F.xxhash64(F.lit("operation"), "operation_id"), "_v": F.xxhash64(F.lit("key"), "idempotency_hash")})
        group = components(left.select(F.col("_u").alias("u"), F.col("_v").alias("v"))).select(F.col("node").alias("_u"), "root")
        rest = left.join(group, "_u").repartition("root").sortWithinPartitions("_at").select("operation_id", "idempotency_hash").mapInArrow(_in_order, kind)
    return stored(reduce(DataFrame.unionByName, taken, rest))


def enqueue(requests: DataFrame, order: str = "created_at", held: DataFrame | None = None) -> DataFrame:
    """``requests`` with ``outcome``: accepted, duplicate (of an accepted one, in every identity column) or conflict.

    As if one after another in ``order`` (which tells all requests apart): a request is
    accepted if no accepted one before has its operation or its key; a refused one binds
    nothing. ``held``: the records accepted earlier, with the identity columns.

    Only the first request of each operation and key can be accepted, so requests become
    distinct pairs with a place in the order, by a partial aggregate; what chains of pairs
    decide is worked out in order: in one task while there are ``ONE_TASK`` pairs or fewer,
    else by connected groups.
    """
    both = ["operation_id", "idempotency_hash"]
    who = F.struct(*IDENTITY)
    pairs = requests.groupBy(*both).agg(F.min(F.struct(F.col(order).alias("at"), who.alias("who"))).alias("_first")).select(*both, F.col("_first.at").alias("_at"), F.col("_first.who").alias("_who"))
    free = pairs
    if held is not None:
        of = lambda key, name: held.groupBy(key).agg(F.min(who).alias(name))  # noqa: E731  one accepted record a key
        pairs = stored(pairs.join(of("operation_id", "_op"), "operation_id", "left").join(of("idempotency_hash", "_key"), "idempotency_hash", "left"))
        free = pairs.where("_op IS NULL AND _key IS NULL")
    else:
        pairs = free = stored(pairs)
    decided = pairs.join(_accepted(free).withColumn("_new", F.lit(True)), both, "left")
    decided = decided.select(*(F.col(c).alias(f"_{c}") for c in both), F.col("_at").alias("_when"), F.coalesce("_new", F.lit(False)).alias("_new"), "_who", *([F.col("_op")] if held is not None else []))
    same = F.col("_who").eqNullSafe(who) & F.col("_new")
    if held is not None:
        same = same | F.col("_op").eqNullSafe(who)
    outcome = F.when(F.col("_new") & (F.col(order) == F.col("_when")), "accepted").when(same, "duplicate").otherwise("conflict")
    met = F.col("operation_id").eqNullSafe(F.col("_operation_id")) & F.col("idempotency_hash").eqNullSafe(F.col("_idempotency_hash"))
    return requests.join(decided, met).select(*requests.columns, outcome.alias("outcome"))


def due(records: DataFrame, now: Column) -> Column:
    """skip (terminal or under a live lease), expire, or replay."""
    live = (F.col("state") == "leased") & (F.col("lease_until") > now)
    return F.when(F.col("state").isin(*TERMINAL) | F.coalesce(live, F.lit(False)), "skip").when(now >= F.col("expires_at"), "expire").otherwise("replay")


def disposition(code: Column, attempts: Column, most_attempts: int) -> Column:
    kind = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in DISPOSITIONS.items() for x in kv)), code), F.lit("quarantine"))
    return F.when((kind == "retry-transient") & (attempts >= most_attempts), "quarantine").otherwise(kind)


def replay(records: DataFrame, now: Column, most_attempts: int = 5) -> DataFrame:
    """One pass over records (state, attempts, lease_until, expires_at, envelope, writer_code: null for success).

    Returns them with new_state, new_attempts, new_code and the payload kept only by live states.
    """
    step = due(records, now)
    kind = F.when(F.col("writer_code").isNull(), "commit").otherwise(disposition(F.col("writer_code"), F.col("attempts"), most_attempts))
    state = (
        F.when(step == "skip", F.col("state")).when(step == "expire", "expired").when(kind == "commit", "committed")
        .when(kind.isin("retry-transient", "retry-free"), "queued").when(kind == "conflict", "conflict").otherwise("quarantined")
    )
    out = records.withColumns({
        "step": step, "new_state": state,
        "new_attempts": F.col("attempts") + F.when((step == "replay") & (kind == "retry-transient"), 1).otherwise(0),
        "new_code": F.when(step == "expire", "record-expired").when((step == "replay") & (kind == "commit"), F.lit(None)).when(step == "replay", F.col("writer_code")),
    })
    return out.withColumn("envelope", F.when(~F.col("new_state").isin(*TERMINAL), F.col("envelope"))) if "envelope" in records.columns else out


def orphans(index: DataFrame, records: DataFrame) -> DataFrame:
    """Index entries whose record is gone."""
    return index.join(records.select("operation_id"), "operation_id", "left_anti")


def holders(records: DataFrame, idempotency_hash: str) -> DataFrame:
    """Records that hold a key: any that can be read, in whatever state; a committed one keeps its key."""
    return records.where(F.col("idempotency_hash") == idempotency_hash)


#: Fixed value: the shape of a record's name.
RECORD_NAME = r"\A[0-9a-f]{64}\z"


def recovered_index(index: DataFrame, records: DataFrame) -> DataFrame:
    """The key index made whole: key, name, action (kept, torn, lost, rebuilt) of every entry that was or will be.

    index: key, name. records: name, key, the truth; of several that hold one key the first by
    name counts. An entry whose name has no record name's shape is torn, one whose record
    is gone is lost: both go, and a key that records still hold gets an entry anew. An
    entry that names a record of another key stays: it binds the key until that record goes.
    """
    truth = records.where(F.regexp_like("name", F.lit(RECORD_NAME)))
    found = index.join(truth.select("name", F.lit(True).alias("_there")).distinct(), "name", "left")
    action = F.when(~F.coalesce(F.regexp_like("name", F.lit(RECORD_NAME)), F.lit(False)), "torn").when(F.col("_there").isNull(), "lost").otherwise("kept")
    entries = stored(found.select("key", "name", action.alias("action")))
    holder = truth.where("key IS NOT NULL").groupBy("key").agg(F.min("name").alias("name"))
    rebuilt = holder.join(entries.where("action = 'kept'").select("key"), "key", "left_anti").withColumn("action", F.lit("rebuilt"))
    return entries.unionByName(rebuilt.select("key", "name", "action"))


def scan_order(records: DataFrame) -> DataFrame:
    """Records whose names have the shape of one, in name order, with their place."""
    return placed(records.where(F.regexp_like("name", F.lit(RECORD_NAME))), "name")


#: Refusals of the writer that an enqueue may pass on; any other is an internal error.
ADMISSION = (
    "request-invalid", "identity-missing", "actor-denied", "model-identity-missing", "provenance-forbidden", "privacy-unclassified", "privacy-denied", "student-private-denied",
    "secret-detected", "target-denied", "cross-zone-denied", "symlink-denied", "profile-validation-failed", "lint-failed", "privacy-scan-failed",
)


def admission_code(code: Column) -> Column:
    return F.when(code.isin(*ADMISSION), code).when(code.isNotNull(), "internal-error")


def fault(version: int, contract: str, domain: str) -> Column:
    """Why a stored record is not to be trusted: another version, or columns that its binding hash does not cover."""
    known = F.col("record_version").eqNullSafe(F.lit(version)) & F.col("writer_contract").eqNullSafe(F.lit(contract))
    whole = F.forall(F.array(*(F.col(c).isNotNull() for c in BOUND)), lambda x: x) & F.col("binding_hash").eqNullSafe(binding_hash(domain))
    return F.when(~known, "version-unknown").when(~whole, "record-corrupt")


#: Fixed value: how often a writer starts anew from a base that moved.
MOST_ATTEMPTS = 2


class StoredQueue:
    """Records as published versions; the last version of an operation is its record.

    Writers compare and swap: each works from the last commit that it has read and publishes
    the next one, which only one of several can. Who loses looks again, ``MOST_ATTEMPTS``
    times in all; what still cannot be published is refused as base-moved.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.schema = spark, schema
        self.table = Versions(spark, path, f"{schema}, version long")

    def records(self, at: int | None = None) -> DataFrame:
        """The records as of commit ``at``, the last one unless stated."""
        rows = self.table.read(at)
        whole = F.struct("version", *[c for c in rows.columns if c != "version"])
        return rows.groupBy("operation_id").agg(F.max_by(whole, "version").alias("r")).select("r.*")

    def _shaped(self, rows: DataFrame) -> DataFrame:
        kinds = self.spark.createDataFrame([], self.schema).dtypes
        return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds), "version")

    def enqueue(self, requests: DataFrame, order: str = "created_at") -> DataFrame:
        """``requests`` with their outcome against the stored records; accepted ones are published as queued.

        If other writers publish first every time, none is: what would be accepted is base-moved.
        """
        for _ in range(MOST_ATTEMPTS):
            base = self.table.head()
            judged = stored(enqueue(requests, order, held=self.records(base)))
            new = judged.where("outcome = 'accepted'").withColumns({"state": F.lit("queued"), "attempts": F.lit(0), "version": F.lit(0).cast("long")})
            if self.table.publish(base, self._shaped(new)):
                return judged
        return judged.withColumn("outcome", F.when(F.col("outcome") == "accepted", "base-moved").otherwise(F.col("outcome")))

    def rewrite(self, changed: DataFrame) -> DataFrame:
        """Publish the next version of records as they were read; operation_id and outcome: committed or base-moved.

        ``changed`` has the version that each record was read at, once an operation; a record
        that has moved on since is refused. An operation that is not stored is an error.
        """
        changed = stored(changed)
        for _ in range(MOST_ATTEMPTS):
            base = self.table.head()
            known = self.records(base).select("operation_id", F.col("version").alias("_v"))
            met = stored(changed.join(known, "operation_id", "left"))
            if not met.where("_v IS NULL").isEmpty():
                raise ValueError("an operation is not stored")
            current = F.col("version") == F.col("_v")
            if self.table.publish(base, self._shaped(met.where(current).withColumn("version", F.col("_v") + 1))):
                return met.select("operation_id", F.when(current, "committed").otherwise("base-moved").alias("outcome"))
        return met.select("operation_id", F.lit("base-moved").alias("outcome"))

    def compact(self) -> bool:
        """Publish the records as one commit that stands for all before; false if another writer came first."""
        base = self.table.head()
        return self.table.publish(base, self._shaped(self.records(base)), whole=True)

    def find(self, operation_id: str, idempotency_hash: str) -> DataFrame:
        """The record of an operation, with ``outcome``: conflict if its key differs or another operation holds the key."""
        mine = (F.col("operation_id") == operation_id) & (F.col("idempotency_hash") == idempotency_hash)
        either = (F.col("operation_id") == operation_id) | (F.col("idempotency_hash") == idempotency_hash)
        return self.records().where(either).withColumn("outcome", F.when(mine, "found").otherwise("conflict"))

"""Streaming twins: facets of a growing note folder, and the queue over an event stream.

Extensions of the batch operators; the semantics are those of their batch forms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.outbox import IDENTITY
from ..operators.privacy import declared, gate


def note_verdicts(spark: SparkSession, root: str, admissible: tuple[str, ...] = ("public",)) -> DataFrame:
    """Running counts of privacy verdicts over a folder to which notes are added."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    rows = rows.select("path", declared(text).alias("c")).select("path", "c.privacy", "c.reason")
    return gate(rows, admissible).groupBy("privacy", "reason", "admitted").count()


def accepted(requests: DataFrame, at: str = "created_at", delay: str = "1 hour") -> DataFrame:
    """The first request of every operation; repeats within the watermark are dropped."""
    return requests.withWatermark(at, delay).dropDuplicatesWithinWatermark(["operation_id"])


def expired(records: DataFrame, at: str = "created_at", retention: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Per window of the retention period, records by type, once the watermark has passed it."""
    return records.withWatermark(at, delay).groupBy(F.window(at, retention), "event_type").agg(F.count("*").alias("n"))


#: What the queue decides about a request, and when a record that it holds expires.
DECISIONS = "operation_id string, idempotency_hash string, micros long, outcome string"
_WAITING = "operation_id string, idempotency_hash string, identity string, micros long, ends long"


class _Lane(StatefulProcessor):
    """Requests of one lane in order of their time, whatever order they came in.

    A request waits until the watermark has passed its time; then it is decided against the
    records by operation and the operations by key, as the batch ``enqueue`` decides it. A
    timer at a record's end reports it expired; its operation and key stay bound.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.records = handle.getMapState("records", "operation_id string", "identity string, idempotency_hash string, ends long, expired boolean")
        self.keys = handle.getMapState("keys", "idempotency_hash string", "operation_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for at in {_due(x) for x in part["micros"]}:
                self.handle.registerTimer(at)
            self.waiting.appendList([(r.operation_id, r.idempotency_hash, r.identity, int(r.micros), int(r.ends)) for r in part.itertuples(index=False)])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), []
        rows = [tuple(r) for r in self.waiting.get()]
        ripe = sorted((r for r in rows if _due(r[3]) <= now), key=lambda r: (r[3], r[0], r[1], r[2]))
        if ripe:
            self.waiting.clear()
            if rest := [r for r in rows if _due(r[3]) > now]:
                self.waiting.put(rest)
        for operation, held_key, identity, at, ends in ripe:
            record = self.records.getValue((operation,)) if self.records.containsKey((operation,)) else None
            bound = self.keys.containsKey((held_key,))
            if record is None and not bound:
                self.records.updateValue((operation,), (identity, held_key, ends, False))
                self.keys.updateValue((held_key,), (operation,))
                if ends >= 0:
                    self.handle.registerTimer(_due(ends))
                outcome = "accepted"
            else:
                outcome = "duplicate" if record is not None and record[0] == identity and record[1] == held_key else "conflict"
            out.append((operation, held_key, at, outcome))
        ended = [(k[0], v) for k, v in self.records.iterator() if v[2] >= 0 and not v[3] and _due(v[2]) <= now]
        for operation, (identity, held_key, ends, _) in ended:
            self.records.updateValue((operation,), (identity, held_key, ends, True))
            out.append((operation, held_key, ends, "expired"))
        if out:
            yield pd.DataFrame(out, columns=["operation_id", "idempotency_hash", "micros", "outcome"])

    def close(self) -> None:
        pass


def _due(micros: int) -> int:
    """The first whole millisecond after a time, when all requests of that time have come."""
    return int(micros) // 1000 + 1


def decided(requests: DataFrame, lane: str, at: str = "created_at", delay: str = "1 hour") -> DataFrame:
    """A stream of decisions (accepted, duplicate, conflict, expired) over a stream of requests.

    Requests have the identity columns, ``at``, expires_at and a ``lane``: requests of two
    lanes share no operation and no key, so lanes are decided apart. A request later than
    ``delay`` behind the newest is dropped, as by any watermark. State needs the RocksDB
    provider (``spark.sql.streaming.stateStore.providerClass``).
    """
    rest = [c for c in IDENTITY if c not in ("operation_id", "idempotency_hash")]
    rows = requests.withWatermark(at, delay).select(F.col(lane).alias("lane"), "operation_id", "idempotency_hash", F.to_json(F.array(*(F.col(c).cast("string") for c in rest))).alias("identity"), F.col(at).alias("at"), F.unix_micros(at).alias("micros"), F.coalesce(F.unix_micros("expires_at"), F.lit(-1)).alias("ends"))
    out = rows.groupBy("lane").transformWithStateInPandas(_Lane(), outputStructType=DECISIONS, outputMode="Append", timeMode="EventTime")
    return out.select("operation_id", "idempotency_hash", F.timestamp_micros("micros").alias("at"), "outcome")

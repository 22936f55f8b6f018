"""The stateful stream queue against the batch one."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sextant.operators import outbox
from sextant.streaming import queue

SCHEMA = "lane string, operation_id string, idempotency_hash string, actor string, task_hash string, target_path string, request_hash string, created_at timestamp, expires_at timestamp"
START = datetime(2024, 1, 1)


def _requests(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lane = rng.choice("ab")
        at = START + timedelta(seconds=i, microseconds=rng.randrange(1000))
        rows.append((lane, f"{lane}-o{rng.randint(0, 6)}", f"{lane}-k{rng.randint(0, 6)}", rng.choice("xy"), "t", "p", "r", at, at + timedelta(seconds=20) if i % 3 else None))
    return rows


@pytest.mark.parametrize("shuffled", [False, True])
def test_decisions_equal_the_batch_queue(spark, tmp_path, shuffled):
    """In order, and in micro-batches that are out of order within the watermark's delay; a record that ends is reported by its timer."""
    rows = _requests(60, 4)
    batches = [rows[i : i + 15] for i in range(0, 60, 15)]
    if shuffled:
        rng = random.Random(9)
        mixed = rng.sample(rows[:30], 30) + rng.sample(rows[30:], 30)
        batches = [mixed[i : i + 15] for i in range(0, 60, 15)]
    end = ("z", "z", "z", "z", "t", "p", "r", START + timedelta(days=1), None)
    for i, part in enumerate([*batches, [end], [end]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    key, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, kind)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        query = queue.decided(stream, "lane", delay="1 minute").writeStream.format("memory").queryName(f"decided_{shuffled}").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    got = spark.table(f"decided_{shuffled}").where("operation_id <> 'z'")
    batch = outbox.enqueue(spark.createDataFrame(rows, SCHEMA))
    expected = {(r.operation_id, r.idempotency_hash, r.created_at, r.outcome) for r in batch.collect()}
    assert {tuple(r) for r in got.where("outcome <> 'expired'").collect()} == expected
    ends = batch.where((F.col("outcome") == "accepted") & F.col("expires_at").isNotNull())
    assert {(r.operation_id, r.at) for r in got.where("outcome = 'expired'").collect()} == {(r.operation_id, r.expires_at) for r in ends.collect()}

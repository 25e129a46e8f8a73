"""Timers and heartbeats of the stream of checks."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

from anchorage.streaming import state_stream

START = datetime(2024, 5, 1)
SCHEMA = "id bigint, link_id bigint, checked_at timestamp, http_status int, error_type string"


def test_links_come_out_when_they_are_due(spark, tmp_path):
    batches = [
        [(1, 7, START, 404, None), (2, 8, START, 200, None), (3, 9, START, None, "timeout")],
        # The first link is checked again before it is due; time moves on by a week.
        [(4, 7, START + timedelta(minutes=30), 404, None), (5, 99, START + timedelta(days=8), 200, None)],
        [(6, 99, START + timedelta(days=9), 200, None)],
    ]
    spark.conf.set(*state_stream.ROCKSDB)
    said = []
    heartbeat = state_stream.Heartbeat(said.append)
    spark.streams.addListener(heartbeat)
    try:
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={k}"))
            time.sleep(0.1)  # files are taken in the order of their times
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        due = state_stream.due_links(state_stream.counted(stream))
        q = due.writeStream.outputMode("update").format("memory").queryName("due").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(180)
        deadline = time.time() + 30
        while "stream ended" not in said and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(heartbeat)
    got = {(r.link_id, r.due_at, r.status) for r in spark.sql("select * from due").collect()}
    assert got == {
        (9, START + timedelta(minutes=60), "pending"),
        (7, START + timedelta(minutes=30 + 1440), "pending"),
        (8, START + timedelta(days=7), "ok"),
    }
    assert said[-1] == "stream ended" and sum(int(s.split()[2]) for s in said[:-1]) == 6
    assert sum(int(s.split()[4]) for s in said[:-1]) == 3


def test_waits():
    assert [state_stream.wait(n).total_seconds() for n in range(5)] == [7 * 86400, 3600, 86400, 86400, 86400]

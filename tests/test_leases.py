"""Leases step by step, and the stream's timers."""

import datetime as dt

from quarry.streaming import leases

DAY = leases.HOLDS


def run(*steps):
    lease, out = leases.Lease(), []
    for action, now, *done in steps:
        lease, outcome = leases.step(lease, action, now, *(done or [0]))
        out.append((outcome, lease.state, lease.epoch, lease.done))
    return out


def test_renewal_resets_progress_once_the_lease_is_over():
    got = run(("renew", 0), ("begin", 0), ("begin", 1), ("progress", 5, 3), ("renew", 9), ("progress", DAY, 1), ("renew", DAY), ("progress", DAY + 1, 2), ("prepared", DAY + 2), ("progress", DAY + 3, 1), ("publish", DAY + 4), ("publish", 9 * DAY), ("renew", 9 * DAY), ("release", 9 * DAY))
    assert got == [("not_found", "none", 0, 0), ("applied", "building", 1, 0), ("unchanged", "building", 1, 0), ("applied", "building", 1, 3), ("active", "building", 1, 3), ("expired", "building", 1, 3), ("applied", "building", 2, 0), ("applied", "building", 2, 2), ("applied", "prepared", 2, 2), ("refused", "prepared", 2, 2), ("applied", "published", 2, 2), ("unchanged", "published", 2, 2), ("closed", "published", 2, 2), ("closed", "published", 2, 2)]
    assert run(("begin", 0), ("publish", 1), ("release", 2 * DAY), ("release", 2 * DAY), ("other", 0), ("renew", 9 * DAY))[1:] == [("refused", "building", 1, 0), ("applied", "released", 1, 0), ("unchanged", "released", 1, 0), ("refused", "released", 1, 0), ("closed", "released", 1, 0)]


def test_pages_of_leases_that_are_over(spark):
    log = spark.createDataFrame([(g, dt.datetime(2024, 1, 1 + g % 3), g, "begin", 0) for g in range(9)], "group_id long, ts timestamp_ntz, event_id long, action string, done long")
    over = leases.over_at(leases.outcomes(log), int(dt.datetime(2024, 1, 3, tzinfo=dt.UTC).timestamp() * 1000))
    first = [r["group_id"] for r in leases.release_page(over, None, 4).collect()]
    assert first == [0, 1, 3, 4] and [r["group_id"] for r in leases.release_page(over, 4, 4).collect()] == [6, 7]


def test_the_stream_tells_when_a_lease_is_over(spark, tmp_path):
    schema = "group_id long, ts timestamp, event_id long, action string, done long"
    day = lambda n, h=0: dt.datetime(2024, 1, n, h)
    batches = [[(1, day(1), 1, "begin", 0), (2, day(1), 2, "begin", 0), (2, day(1, 1), 3, "progress", 4)], [(2, day(2, 2), 4, "renew", 0), (3, day(4), 5, "begin", 0)], [(3, day(4, 1), 6, "prepared", 0), (3, day(4, 2), 7, "publish", 0)], [(4, day(9), 8, "begin", 0)], [(4, day(9, 1), 9, "progress", 1)]]
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            out = leases.watch(stream).writeStream.foreachBatch(lambda df, n, i=i: df.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "at")).outputMode("update").trigger(availableNow=True).start()
            out.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    told = sorted((r["group_id"], r["outcome"], r["epoch"]) for r in rows if r["event_id"] is None)
    assert told == [(1, "over", 1), (2, "over", 2)]
    seen = {r["event_id"]: (r["outcome"], r["state"], r["epoch"], r["done"]) for r in rows if r["event_id"] is not None}
    assert seen[3] == ("applied", "building", 1, 4) and seen[4] == ("applied", "building", 2, 0) and seen[7] == ("applied", "published", 1, 0) and len(seen) == 9

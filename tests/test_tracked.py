"""The stream with timers over one, three and ten batches, with late rows, and its state after expiry."""

import time

import pytest
from pyspark.sql import functions as F

from pitengine.session import new_path
from pitengine.streaming import streams as S
from pitengine.streaming import tracked as T


@pytest.fixture
def rocks(spark):
    spark.conf.set(T.STORE, T.PROVIDER)
    yield spark
    spark.conf.unset(T.STORE)


def changes(spark, events, batches, name):
    """The changes of events dealt over files in the order of time, a file per batch."""
    folder = new_path(spark, name)
    low, high = events.agg(F.unix_seconds(F.min("ts").cast("timestamp")), F.unix_seconds(F.max("ts").cast("timestamp"))).first()
    step = (high - low) // batches + 1
    at = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - low) / step)
    for k in range(batches):
        events.where(at == k).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are read in the order of their times
    return S.run_to_table(T.tracked_changes(S.event_stream(spark, folder, 1)), name=name), folder


def test_batches_do_not_change_the_result(rocks, sf):
    events = rocks.read.parquet(f"{sf}/events.parquet").where("user_id < 12").cache()
    want = None
    for n in (1, 3):
        got = sorted(map(str, changes(rocks, events, n, f"tracked_{n}")[0].collect()))
        want = want or got
        assert got == want and any("EXPIRED" in r for r in got)


def test_late_rows_change_nothing_and_state_goes(rocks):
    row = lambda k, day, user, status, price: (k, f"2024-01-{day:02d} 00:00:00", user, status, price, "{}")
    first = [row(1, 1, 7, "a", 1.0), row(2, 2, 7, "b", 1.0), row(3, 2, 8, "a", 5.0)]
    late = [row(4, 1, 7, "z", 9.0), row(5, 10, 9, "a", 1.0)]
    folder = new_path(rocks, "late")
    for rows in (first, late):
        df = rocks.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    out = S.run_to_table(T.tracked_changes(S.event_stream(rocks, folder, 1)), name="late").collect()
    kinds = sorted((r.key, r.change) for r in out if r.change != "LATE")
    assert kinds == [(7, "EXPIRED"), (7, "REGISTERED"), (7, "STATUS"), (8, "EXPIRED"), (8, "REGISTERED"), (9, "REGISTERED")]
    assert not any(r.new == "z" for r in out if r.change != "LATE")

"""Streams of files against the batch operators on the same rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from flowlark.operators import flows, history
from flowlark.operators.order import with_sequence
from flowlark.streaming import connections

SCHEMA = "flow_id long, ts timestamp, src string, dst string, service string, dport int, flag string, src_bytes double"
START = datetime.datetime(2026, 1, 1)


def made(n, seed):
    rng = random.Random(seed)
    t, rows = 0, []
    for i in range(n):
        t += rng.choice([0, 1, 30, 900, 4000])
        rows.append((i, START + datetime.timedelta(seconds=t), rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), rng.choice(["h", "f"]), 80, rng.choice(["S0", "REJ", "SF", None]), float(rng.randrange(9))))
    return rows


@pytest.fixture
def streamed(spark, tmp_path):
    """Rows in files that come one a batch, out of order by less than the delay, then one far in the future that closes all."""

    def run(rows, work, name):
        rng = random.Random(7)
        parts = [rows[i : i + 40] for i in range(0, len(rows), 40)]
        for i, part in enumerate(parts):
            rng.shuffle(part)
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{i:03}")
        closing = [(10**9 + i, rows[-1][1] + datetime.timedelta(days=10 + i), "end", "end", "h", 1, "SF", 0.0) for i in range(3)]
        for i, row in enumerate(closing):
            spark.createDataFrame([row], SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/in/{len(parts) + i:03}")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
        query = work(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/state-{name}").trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
        return spark.table(name)

    return run


def test_sessions_equal_the_batch(spark, streamed):
    rows = made(160, 1)
    got = streamed([*rows], lambda s: connections.sessions(s), "sessions")
    batch = spark.createDataFrame(rows, SCHEMA).withColumn("start_us", F.unix_micros("ts"))
    want = sorted(tuple(r) for r in flows.sessions(batch, 7_200_000_000).select(F.coalesce("src", F.lit("-")), "first_us", "last_us", "n", "bytes").collect())
    found = got.filter("src is null or src <> 'end'").select(F.coalesce("src", F.lit("-")), F.unix_micros("first_ts"), F.unix_micros("last_ts"), "n", "bytes").collect()
    assert sorted(map(tuple, found)) == want and len(want) > 10


def test_trailing_counts_equal_the_batch(spark, streamed):
    rows = made(160, 2)
    window = 3_600_000_000
    got = streamed([*rows], lambda s: connections.trailing_counts(s, window), "counts")
    batch = with_sequence(spark.createDataFrame(rows, SCHEMA).withColumn("start_us", F.unix_micros("ts")), "start_us", "flow_id")
    want = {r.flow_id: (r.dst, r.h_n, r.h_e, r.h_r) for r in history.with_counts(batch, window).collect()}
    found = got.filter("flow_id < 1000000000").collect()
    assert len(found) == len(want) and {r.flow_id: (r.key, r.n, r.e, r.r) for r in found} == want


def test_late_rows_are_dropped(spark, tmp_path):
    """A row a day older than the watermark changes nothing."""
    day = datetime.timedelta(days=1)
    batches = [[(1, START, "a", "x", "h", 1, "SF", 1.0)], [(2, START + 2 * day, "a", "x", "h", 1, "SF", 1.0)], [(6, START + 2 * day, "b", "x", "h", 1, "SF", 1.0)], [(3, START + day, "a", "x", "h", 1, "SF", 1.0)], [(4, START + 9 * day, "end", "e", "h", 1, "SF", 0.0)]]
    for i, rows in enumerate([*batches, [(5, START + 19 * day, "end", "e", "h", 1, "SF", 0.0)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    query = connections.sessions(stream).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/s").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.first_ts for r in spark.table("late").filter("src = 'a'").collect()) == [START, START + 2 * day]

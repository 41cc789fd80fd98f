"""Streams with late rows, timers and maintained tables against plain Python and batch operators."""

import random
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from episodica.operators import episodes as E
from episodica.operators import risk as R
from episodica.queries.domain import rocksdb, shared_folder
from episodica.streaming import maintain as M
from episodica.streaming import settled as L
from episodica.streaming.live import policy_step

HOUR = 3_600_000_000
START = 1_704_067_200_000_000


def feed(spark, batches, shape, build):
    """Run a stream over batches of rows, one run after the other from one checkpoint."""
    path = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
    with rocksdb(spark):
        for rows in batches:
            frame = spark.createDataFrame(rows, shape).withColumn("read_time", F.timestamp_micros("at"))
            frame.write.mode("append").parquet(f"{path}/in")
            stream = build(spark.readStream.schema(frame.schema).parquet(f"{path}/in"))
            stream.writeStream.option("checkpointLocation", f"{path}/c").trigger(availableNow=True).format("parquet").option("path", f"{path}/out").start().awaitTermination()
    return [tuple(r) for r in spark.read.schema(stream.schema).parquet(f"{path}/out").collect()]


def late_batches(rng, rows, most_late, n):
    """Rows dealt into batches by arrival: up to ``most_late`` after their time, out of order inside a batch."""
    arrived = sorted(rows, key=lambda r: r[1] + rng.randrange(most_late))
    cut = [arrived[i * len(arrived) // n : (i + 1) * len(arrived) // n] for i in range(n)]
    for part in cut:
        rng.shuffle(part)
    return cut


@pytest.fixture(scope="module")
def readings():
    rng = random.Random(4)
    rows = [(c, START + rng.randrange(240 * HOUR), k, rng.choice(["error", "error", "ok", "view"])) for k, c in enumerate(rng.choices(range(4), k=300))]
    # ties in time go by id; the last row, far ahead, lets the watermark pass all others
    rows += [(1, rows[0][1], 1000 + i, w) for i, w in enumerate(["ok", "error"])]
    return [*rows, (9, START + 400 * HOUR, 5000, "ok")]


def test_late_rows_give_the_ordered_episodes(spark, readings):
    batches = [*late_batches(random.Random(1), readings[:-1], 20 * HOUR, 3), [readings[-1]]]
    # a row sent twice is one row
    batches[1].append(batches[0][0])
    got = feed(spark, batches, "channel_id long, at long, journal_id long, value_text string", lambda s: L.late_episodes(s, ("error",), "1 day"))
    j = spark.createDataFrame(readings, "channel_id long, at long, journal_id long, value_text string").withColumn("read_time", F.timestamp_micros("at"))
    want = E.episodes(j, {"error": F.col("value_text") == "error"}, section=None).where("ended_at is not null")
    want = want.select("channel_id", F.unix_micros("started_at"), F.unix_micros("ended_at"), F.col("rows_cnt").cast("long"), "fault_value", "closed_by")
    assert sorted(got) == sorted(tuple(r) for r in want.collect()) and len(got) > 40


def plain_heartbeats(rows, policy, forget, mark):
    """Decisions and heartbeats of one key's rows (time, probability) up to the mark."""
    state, last, out = None, None, []
    beat = int(policy["heartbeat_min"] * 6e7)

    def until(t, at_end):
        nonlocal state
        while state:
            due = min(state[3] + beat, last[0] + forget)
            if due > t or due == t and not at_end:
                return
            if due == last[0] + forget:
                state = None
            else:
                out.append((due, last[1], state[0], "heartbeat"))
                state = (*state[:2], last[1], due)

    for t, p in rows:
        until(t, False)
        state, cls, why = policy_step(state, t, p, policy)
        last = (t, p)
        out.append((t, p, cls, why))
    until(mark, True)
    return out


def test_heartbeats_without_rows(spark):
    rng = random.Random(8)
    rows = [(str(k % 3), START + rng.randrange(200 * HOUR), k, rng.random()) for k in range(60)]
    end = ("9", START + 500 * HOUR, 999, 0.5)
    policy = R.POLICY | {"threshold": 0.5, "heartbeat_min": 300.0}
    batches = [*late_batches(rng, rows, 20 * HOUR, 2), [end]]
    got = feed(spark, batches, "key string, at long, journal_id long, probability double", lambda s: L.live_heartbeats(s, policy, "1 day", 40 * 60.0))
    mark = end[1] - 24 * HOUR
    want = [(k, *r) for k in "012" for r in plain_heartbeats([(t, p) for key, t, _, p in sorted(rows, key=lambda r: r[1:3]) if key == k], policy, 40 * HOUR, mark)]
    assert sorted(got, key=str) == sorted(want, key=str)
    # heartbeats go on after a key's last row until the key is forgotten
    ends = {k: max(t for key, t, *_ in rows if key == k) for k in "012"}
    assert all(sum(g[0] == k and g[4] == "heartbeat" and g[1] > ends[k] for g in got) == 7 for k in "012")


def test_a_silent_source_raises_its_alert(spark):
    """No row of the source comes any more: others move the watermark, and the timer fires."""
    first = [("a", START, 1), ("a", START + HOUR, 2), ("b", START, 3), ("c", START, 4)]
    later = [("b", START + 30 * HOUR, 5)], [("b", START + 60 * HOUR, 6)], [("a", START + 50 * HOUR, 7), ("b", START + 200 * HOUR, 8)]
    norms = spark.createDataFrame([("a", 10 * 3600), ("b", 40 * 3600)], "source string, norm_seconds int")
    got = feed(spark, [first, *later], "name string, at long, journal_id long", lambda s: L.silence_alerts(s, "name", norms, "1 hour", "100 hours"))
    at = lambda h: START + h * HOUR
    # "a" at hour 50 comes after the watermark (59) and is dropped as late
    assert sorted(got) == [("a", "gone", at(101), at(1)), ("a", "silent", at(11) + 1, at(1)), ("b", "gone", at(160), at(60)), ("b", "silent", at(100) + 1, at(60)), ("c", "gone", at(100), at(0))]


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_rollup_changes_touched_days_alone(spark):
    """Late rows of two days rewrite just those partitions; a batch run again leaves the same rows."""
    path = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
    frame = lambda rows: spark.createDataFrame(rows, "journal_id long, at long, section_id int, n int").withColumn("read_time", F.timestamp_micros("at"))
    put = M.maintained_rollup(f"{path}/raw", f"{path}/days", lambda r: r.groupBy("section_id", "day").agg(F.count("*").alias("total"), F.max("n").alias("most")))
    rows = [(k, START + k * 5 * HOUR, k % 3, k) for k in range(60)]
    put(frame(rows), 0)
    before = files(f"{path}/days")
    late = [(100, START + 30 * HOUR, 1, 100), (101, START + 80 * HOUR, 0, 101), rows[7]]
    for _ in range(2):
        put(frame(late), 1)
    after = files(f"{path}/days")
    changed = {k.split("/")[0] for k in before.keys() | after.keys() if before.get(k) != after.get(k)}
    assert changed == {"day=2024-01-02", "day=2024-01-04"}
    want = frame([*rows, *late[:2]]).groupBy("section_id", F.to_date("read_time").alias("day")).agg(F.count("*").alias("total"), F.max("n").alias("most"))
    got = spark.read.parquet(f"{path}/days").select("section_id", "day", "total", "most")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    put(frame([]), 2)
    assert files(f"{path}/days") == after


def test_touched_days_prune_the_raw_table(spark):
    path = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
    spark.range(100).select("id", F.date_add(F.lit("2024-01-01"), (F.col("id") % 9).cast("int")).alias("day")).write.partitionBy("day").parquet(path)
    from datetime import date

    plan = M.of_days(spark.read.parquet(path), [date(2024, 1, 3)])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "2024-01-03" in plan

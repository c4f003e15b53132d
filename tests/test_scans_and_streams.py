"""Running values of one large log, byte ranges of files, and streams cut into any batches."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import logs as L
from quarry.operators.scans import Scan, running
from quarry.sources import files
from quarry.streaming import ingest, stateful

LINES = "log_id long, line_no long, line string"


def a_log(rng, n, log=1, gaps=False):
    kinds = ["2024-01-01 10:00:00 INFO x", "ERROR failed", "plain", "Caused by: y", "  at z", "2024-02-03 11:22:33 WARN w", "", None]
    weights = [2, 1, 12, 1, 8, 1, 2, 1]
    at, lines = 0, []
    for _ in range(n):
        at += rng.choice([1, 1, 1, 7]) if gaps else 1
        lines.append((log, at, rng.choices(kinds, weights)[0]))
    return lines


@pytest.fixture(scope="module")
def lines(spark):
    """One log with nearly all lines, a short one, one without a marker, and lines of no log."""
    rng = random.Random(4)
    rows = a_log(rng, 1500) + a_log(rng, 40, 2, gaps=True) + [(3, k, "quiet") for k in range(1, 130)] + [(None, k, x) for _, k, x in a_log(rng, 60)]
    return spark.createDataFrame(rows, LINES).repartition(5)


def test_running_values_equal_windows(lines):
    order = Window.partitionBy("log_id").orderBy("line_no")
    so_far, to_come = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    v = F.when(F.col("line_no") % 11 == 0, F.col("line_no") * 7 % 100)
    expected = lines.select("*", F.coalesce(F.sum(v).over(so_far), F.lit(0)).alias("a"), F.max(v).over(so_far).alias("b"), F.last(v, True).over(so_far).alias("c"), F.min(v).over(to_come).alias("d"))
    for span in (10, 64, 100_000):
        got = running(lines, {"a": Scan("sum", v), "b": Scan("max", v), "c": Scan("last", v), "d": Scan("next", v)}, span=span)
        assert got.columns == expected.columns and sorted(map(repr, got.collect())) == sorted(map(repr, expected.collect()))


def test_log_operators_do_not_depend_on_spans(lines):
    for make in (lambda s: L.segments(lines, 20, span=s), lambda s: L.carried_times(lines, span=s), lambda s: L.around_markers(lines, span=s), lambda s: L.excerpt(lines, 6000, span=s)):
        assert sorted(map(repr, make(7).collect())) == sorted(map(repr, make(1_000_000).collect()))


def test_segments_and_markers_by_hand(lines):
    rows = sorted((r for r in lines.collect() if r.log_id == 1), key=lambda r: r.line_no)
    begins = [bool(r.line) and (r.line[:4] == "2024" or r.line.startswith("ERROR")) for r in rows]
    segment, place, expected = 0, 0, {}
    for r, new in zip(rows, begins):
        segment, place = (segment + 1, 0) if new else (segment, place)
        expected[r.line_no] = (segment, place // 20)
        place += 1
    assert {r.line_no: (r.segment, r.part) for r in L.segments(lines, 20, span=50).filter("log_id = 1").collect()} == expected
    marked = [k for k, r in enumerate(rows) if r.line and any(x in r.line for x in ("ERROR", "WARN", "Caused by"))]
    near = {rows[k].line_no for m in marked for k in range(max(m - 1, 0), min(m + 6, len(rows)))}
    assert {r.line_no for r in L.around_markers(lines, span=50).filter("log_id = 1").collect()} == near


def test_one_log_is_many_tasks_work(spark, lines):
    """Of the log with nearly all lines each task gets a part."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shares = L.segments(lines, span=100).filter("log_id = 1").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(shares) == 4 and max(r.n for r in shares) < 800


def test_logs_are_read_in_byte_ranges(spark, tmp_path):
    rng = random.Random(6)
    told = ["".join(rng.choice("ab é한") for _ in range(rng.randrange(60))) for _ in range(3000)]
    (tmp_path / "a.log").write_bytes(b"\xef\xbb\xbf" + "\n".join(told).encode() + b"\n")
    (tmp_path / "b.log").write_bytes(b"one\r\ntwo\xff\r\n\r\nlast")
    (tmp_path / "c.log").write_bytes(b"")
    (tmp_path / "d.txt").write_bytes(b"no log")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = files.log_lines(spark, str(tmp_path))
        assert found.select(F.col("log_id"), F.spark_partition_id()).count() == len(told) + 4
        assert spark.read.option("pathGlobFilter", "*.log").text(str(tmp_path)).rdd.getNumPartitions() > 10
        rows = found.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    of = lambda name: [x for _, x in sorted((r.line_no, r.line) for r in rows if r.log_id.endswith(name))]
    assert of("a.log") == told and sorted(r.line_no for r in rows if r.log_id.endswith("a.log")) == list(range(1, 3001))
    assert of("b.log") == ["one", "two�", "", "last"] and not of("c.log")


def test_segments_of_batches_cut_anywhere(spark, tmp_path):
    rng = random.Random(9)
    rows = [(log, at, line or "") for k in (1, 2, 3) for log, at, line in a_log(rng, 150, k)]
    whole = {(r.log_id, r.line_no): (r.segment, r.part) for r in L.segments(spark.createDataFrame(rows, LINES), 6).collect()}
    cuts = sorted(rng.sample(range(1, 150), 2))
    schema = spark.createDataFrame([], LINES).schema
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, 151])):
        part = [r for r in rows if a < r[1] <= b]
        spark.createDataFrame(part, LINES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.segments_once(ingest.uploads(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/check", 6)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(got) == len(rows) and {(r.log_id, r.line_no): (r.segment, r.part) for r in got} == whole


def test_silent_logs_are_closed(spark, tmp_path):
    """What a log left open is forgotten when event time has passed its silence; a busy one goes on."""
    schema = T.StructType.fromDDL("log_id long, line_no long, line string, at timestamp")
    rows = [[(1, 1, "ERROR a", 0), (2, 1, "ERROR b", 0)], [(2, 2, "ERROR c", 100)], [(1, 2, "ERROR d", 130), (2, 3, "e", 130)]]
    for part in rows:
        df = spark.createDataFrame([(a, b, c, f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}") for a, b, c, s in part], "log_id long, line_no long, line string, at string")
        df.withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        made = stateful.segmented(ingest.uploads(spark, f"{tmp_path}/in", schema), time="at", idle_seconds=60)
        made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    got = {(r.log_id, r.line_no): r.segment for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    # log 2 goes on before the watermark has passed its silence; log 1 does not
    assert got == {(1, 1): 1, (2, 1): 1, (2, 2): 2, (1, 2): 1, (2, 3): 2}


def test_leases_end_by_timers(spark, tmp_path):
    """A silent worker's job is queued again when event time passes its lease, and failed after the last attempt."""
    schema = T.StructType.fromDDL("job_id long, worker_id string, action string, at timestamp")
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    batches = [
        [(1, "a", "claim", 0), (1, "b", "claim", 5), (2, "a", "claim", 0), (3, "c", "claim", 0)],
        [(2, "a", "heartbeat", 20), (3, "c", "finish", 20), (9, "z", "claim", 45)],
        [(1, "b", "claim", 50), (9, "z", "heartbeat", 90)],
        [(9, "z", "finish", 200)],
        [(8, "z", "claim", 400)],
    ]
    for rows in batches:
        spark.createDataFrame([(j, w, a, at(s)) for j, w, a, s in rows], "job_id long, worker_id string, action string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        moves = stateful.leased(ingest.uploads(spark, f"{tmp_path}/in", schema), lease_seconds=30, max_attempts=2)
        moves.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    got = {}
    for r in sorted(spark.read.parquet(f"{tmp_path}/out").collect(), key=lambda r: (r.job_id, r.at, r.status)):
        got.setdefault(r.job_id, []).append((r.worker_id, r.status, r.attempts, r.at.minute * 60 + r.at.second))
    assert got[1] == [("a", "processing", 1, 0), ("a", "queued", 1, 30), ("b", "processing", 2, 50), ("b", "failed", 2, 80)]
    assert got[2][:2] == [("a", "processing", 1, 0), ("a", "queued", 1, 50)] and got[3] == [("c", "processing", 1, 0), ("c", "completed", 1, 20)]

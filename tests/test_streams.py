"""Streams: restarts, late rows, named pipelines and detectors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tablecare.streaming import ingest as ig
from tablecare.streaming import windows as ws
from tablecare.streaming.intime import FINITE, drained_in_time
from tablecare.streaming.learning import OnlineLogistic
from tablecare.streaming.stateful import ddm_step, error_drift_stream, zscore_stream


def _rows(spark, rows):
    return spark.createDataFrame(rows, "at string, m string, v double").select(F.col("at").cast("timestamp").alias("ts"), "m", "v")


def test_window_values(spark):
    df = _rows(spark, [("2024-01-01 12:00:00", "metric1", float(v)) for v in (10, 12, 11, 13, 9)])
    row = ws.tumbling(df, "ts", "m", "v").first()
    assert (row["count"], row["sum"], row["mean"], row["min"], row["max"]) == (5, 55.0, 11.0, 9.0, 13.0)


def test_text_values_go_to_the_rejects(spark):
    df = spark.createDataFrame([("1.5",), ("word",), (None,)], "v string")
    good, bad = ws.split_values(df, "v")
    assert [r["v"] for r in good.collect()] == [1.5] and bad.count() == 2


def test_restart_reads_only_new_files_and_late_rows_drop(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    _rows(spark, [("2024-01-01 12:00:01", "a", 1.0), ("2024-01-01 12:10:00", "a", 2.0)]).coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema

    def run():
        stream = ws.tumbling(ig.file_stream(spark, src, schema), "ts", "m", "v", keep="60 seconds")
        ig.drain(stream, out, "update")
        return ig.newest_update(spark.read.parquet(out), ["window_start", "metric"])

    assert run().count() == 2
    # The first window is far behind the watermark by now: its late row is dropped, the new row counts.
    _rows(spark, [("2024-01-01 12:00:02", "a", 5.0), ("2024-01-01 12:10:01", "a", 3.0)]).coalesce(1).write.mode("append").parquet(src)
    rows = {str(r["window_start"]): (r["count"], r["sum"]) for r in run().collect()}
    assert rows == {"2024-01-01 12:00:00": (1, 1.0), "2024-01-01 12:10:00": (2, 5.0)}
    before = spark.read.parquet(out).count()
    run()
    assert spark.read.parquet(out).count() == before


def test_pipelines_by_name(spark, tmp_path):
    src = str(tmp_path / "in")
    _rows(spark, [("2024-01-01 12:00:01", "a", 1.0)]).write.parquet(src)
    schema = spark.read.parquet(src).schema
    pipes = ig.Pipelines(spark)
    pipes.add("copy", lambda: ig.start(ig.file_stream(spark, src, schema), str(tmp_path / "copy"), "1 second", name="copy"))
    pipes.start("copy")
    assert pipes.active() == ["copy"]
    pipes.running["copy"].processAllAvailable()
    pipes.stop_all()
    assert pipes.active() == [] and spark.read.parquet(str(tmp_path / "copy")).count() == 1


def test_ddm_finds_a_rise():
    state, marks = (0, 0.0, math.inf, math.inf), []
    for i in range(400):
        state, mark = ddm_step(state, 1.0 if (i % 10 == 0 if i < 200 else i % 2 == 0) else 0.0)
        marks.append(mark)
    assert "drift" not in marks[:200] and "drift" in marks[200:]


def test_kafka_options():
    out = ig.kafka_options("h:9092", "t", group="g", batch=10)
    assert out["subscribe"] == "t" and out["maxOffsetsPerTrigger"] == "10"


@pytest.fixture
def chunked(spark):
    """Arrow chunks of 20 rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    yield spark
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _stamped(spark, rows, folder, files):
    """Rows (id, k, seconds or None, v) dealt to ``files`` files."""
    df = spark.createDataFrame(rows, "id long, k string, t double, v double").select("id", "k", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts"), "v")
    df.repartition(files).write.parquet(folder)
    return df.schema


@pytest.mark.parametrize("slice_seconds", [50, 5000])
def test_state_streams_go_by_time_whatever_the_files_and_chunks(chunked, tmp_path, slice_seconds):
    random.seed(6)
    rows = [(i, "a" if i % 3 else "b", 1000.0 + i // 2, None if i % 50 == 7 else random.gauss(0, 1) + 9 * (i % 97 == 0)) for i in range(600)]
    errors = [(i, k, t, float(random.random() < (0.1 if i < 300 else 0.6))) for i, k, t, _ in rows]
    order = {"delay": "1 hour", "slice_seconds": slice_seconds}  # no row is later than the delay
    found = []
    for n, files in enumerate((1, 4)):
        random.shuffle(rows)
        random.shuffle(errors)
        zs, es = (ig.file_stream(chunked, f"{tmp_path}/{x}{n}", _stamped(chunked, part, f"{tmp_path}/{x}{n}", files), files_per_batch=1) for x, part in (("v", rows), ("e", errors)))
        z = drained_in_time(zs, "ts", lambda s: zscore_stream(s, "k", "ts", "v", "id", **order), f"{tmp_path}/z{n}")
        d = drained_in_time(es, "ts", lambda s: error_drift_stream(s, "k", "ts", "v", "id", **order), f"{tmp_path}/d{n}")
        found.append(({r.id: (r.anomaly_score, r.is_anomaly) for r in z.collect()}, sorted((r.id, r.state) for r in d.collect())))
    assert found[0] == found[1] and found[0][1] and len(found[0][0]) == len(rows)
    values: dict[str, list] = {}
    for i, k, _, v in sorted(rows):
        values[k] = [*values.get(k, []), v][-100:]
        seen = [x for x in values[k] if x is not None]
        mean = sum(seen) / len(seen)
        std = math.sqrt(sum((x - mean) ** 2 for x in seen) / len(seen))
        want = None if v is None else abs(v - mean) / std if len(seen) > 2 and std > 0 else 0.0
        got = found[0][0][i][0]
        assert got is None if want is None else abs(got - want) < 1e-9
    state, marks = {}, []
    for i, k, _, e in sorted(errors):
        state[k], mark = ddm_step(state.get(k, (0, 0.0, math.inf, math.inf)), e)
        marks += [(i, mark)] if mark != "stable" else []
    assert found[0][1] == sorted(marks)


def test_keys_of_a_bucket_share_state_calls(chunked, tmp_path):
    """Forty keys and rows without one, in three buckets: the state is asked once a bucket and slice, and each key keeps its own memory."""
    big = 2**60  # neighbours of such a number are one as doubles
    rows = [(i, None if i % 41 == 40 else big + i % 41, 1000.0 + i, float((i * 37) % 11)) for i in range(900)]
    df = chunked.createDataFrame(rows, "id long, k long, t double, v double")
    df = df.select("id", "k", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts"), "v")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = ig.file_stream(chunked, f"{tmp_path}/in", df.schema, files_per_batch=1)
    out = drained_in_time(stream, "ts", lambda s: zscore_stream(s, "k", "ts", "v", "id", span=5, delay="1 hour", slice_seconds=300, buckets=3), f"{tmp_path}/out")
    found = {r.id: (r.k, r.anomaly_score) for r in out.collect()}
    assert len(found) == len(rows)
    seen: dict = {}
    for i, k, _, v in rows:
        last = seen[k] = [*seen.get(k, []), v][-5:]
        mean = sum(last) / len(last)
        std = math.sqrt(sum((x - mean) ** 2 for x in last) / len(last))
        want = abs(v - mean) / std if len(last) > 2 and std > 0 else 0.0
        assert found[i][0] == k and abs(found[i][1] - want) < 1e-9


def test_rows_wait_for_the_watermark_across_runs_and_late_ones_drop(spark, tmp_path):
    base, kinds = f"{tmp_path}/in", "id long, k string, ts timestamp, v double"
    for key, value in FINITE.items():
        spark.conf.set(key, value)
    try:
        def run(rows):
            spark.createDataFrame(rows, "id long, k string, t double, v double").select("id", "k", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"), "v").coalesce(1).write.mode("append").parquet(base)
            stream = ig.file_stream(spark, base, kinds, files_per_batch=1)
            ig.drain(zscore_stream(stream, "k", "ts", "v", "id", delay="100 seconds", slice_seconds=10), f"{tmp_path}/out")
            return [r.id for r in spark.read.schema("id long").parquet(f"{tmp_path}/out").orderBy("id").collect()]

        assert run([(1, "a", 1000.0, 1.0), (2, "a", 1001.0, 2.0), (3, "b", None, 0.0)]) == []
        assert run([(4, "a", 1105.0, 3.0)]) == []  # the watermark is 900 in this batch, 1005 from now on
        assert run([(5, "a", 1003.0, 4.0), (6, "a", 1106.0, 5.0), (7, "b", 1008.0, 1.0)]) == []  # 1005 has not passed the slice to 1010
        assert run([(8, "a", 1200.0, 5.0)]) == []  # 1006 has not either
        # The watermark is 1100; rows behind the one of the batch before are late.
        assert run([(9, "a", 1201.0, 5.0), (10, "a", 1002.0, 9.0), (11, "a", 1007.0, 1.0)]) == [1, 2, 5, 7, 11]
    finally:
        for key in FINITE:
            spark.conf.unset(key)


def test_progress_counts_every_batch(spark, tmp_path):
    spark.range(300).repartition(30).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    log = ig.ProgressLog()
    spark.streams.addListener(log)
    try:
        q = ig.drain(ig.file_stream(spark, f"{tmp_path}/in", "id long", files_per_batch=2), f"{tmp_path}/out", name="counted")
        log.wait(q.runId)
    finally:
        spark.streams.removeListener(log)
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert [r[2] for r in log.rows() if r[0] == "counted"] == [300]


def test_online_model_goes_on_after_a_restart(spark, tmp_path):
    batches = [spark.createDataFrame([(float(i % 7), float(i % 7 > 3)) for i in range(40 * b, 40 * b + 40)], "x double, y double").coalesce(1) for b in range(4)]
    whole = OnlineLogistic(["x"], "y", replay_path=f"{tmp_path}/r0", state_path=f"{tmp_path}/s0", buffer_size=60)
    for b, rows in enumerate(batches):
        whole.learn(rows, b)
    first = OnlineLogistic(["x"], "y", replay_path=f"{tmp_path}/r1", state_path=f"{tmp_path}/s1", buffer_size=60)
    for b in (0, 1):
        first.learn(batches[b], b)
    # A run that failed while it wrote the next version.
    spark.createDataFrame([(9.0, 9.0, 9.0)], "x double, y double, _priority double").write.mode("overwrite").parquet(f"{tmp_path}/r1/slot=1")
    again = OnlineLogistic(["x"], "y", replay_path=f"{tmp_path}/r1", state_path=f"{tmp_path}/s1", buffer_size=60).restore(spark)
    for b in (1, 2, 3):  # batch 1 comes a second time
        again.learn(batches[b], b)
    assert again.w == pytest.approx(whole.w) and again.count == whole.count == 160 and again.version == whole.version == 4
    assert again.buffer(spark).count() == whole.buffer(spark).count() == 60
    assert OnlineLogistic(["x"], "y", state_path=f"{tmp_path}/none").restore(spark).last_batch == -1


def test_replay_buffer_is_a_uniform_sample_of_fixed_size(spark, tmp_path):
    model = OnlineLogistic(["x"], "y", steps=0, replay_path=f"{tmp_path}/r", buffer_size=400)
    sizes = (100, 3000, 500, 1, 400)
    start = 0
    for b, n in enumerate(sizes):
        model.learn(spark.range(start, start + n).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y")), b)
        start += n
        assert model.buffer(spark).count() == min(start, 400)
    kept = [r.x for r in model.buffer(spark).collect()]
    assert len(set(kept)) == 400
    for a, n in ((100, 3000), (3100, 500), (3601, 400)):  # each batch by its share, within five deviations
        share = 400 * n / start
        assert abs(sum(a <= x < a + n for x in kept) - share) < 5 * share**0.5

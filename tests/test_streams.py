"""Streams over files against plain loops and the batch operators."""

import random

import pytest

from gradeloom.operators.ordered import ema
from gradeloom.streaming import stateful as sf
from gradeloom.streaming import stateless as sl


@pytest.fixture
def replay(spark, tmp_path):
    def run(rows, schema, make, order, batches=3, mode="append"):
        """Feed the rows in several micro-batches and give all that comes out."""
        size = -(-len(rows) // batches)
        for n in range(batches):
            spark.createDataFrame(rows[n * size : (n + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        name = f"out_{order}"
        query = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    return run


def test_presence(spark, replay):
    rng = random.Random(1)
    rows = [(k, n, int(rng.random() < 0.4)) for n in range(30) for k in (1, 2)]
    schema = "camera long, frame long, boxes int"
    got = replay(rows, schema, lambda s: sf.presence_gate(s, "camera"), "presence")
    want = sf.presence_events(spark.createDataFrame(rows, schema), "camera").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r.event for r in want} == {"detection_group", "live_detection", "target_cleared"}


def test_smoothing(spark, replay):
    rows = [(n % 2, n, float(n * n % 17)) for n in range(20)]
    schema = "k long, id long, value double"
    got = {r.id: r.smooth for r in replay(rows, schema, lambda s: sf.stream_ema(s, "k", 0.3), "ema")}
    want = {r.id: r.smooth for r in ema(spark.createDataFrame(rows, schema), "k", ["id"], "value", 0.3).collect()}
    assert got == pytest.approx(want)


def test_throttle(replay):
    rows = [(1, n, n * 0.1) for n in range(20)]
    got = replay(rows, "k long, id long, seconds double", lambda s: sf.throttle(s, "k"), "throttle")
    assert sorted(r.id for r in got) == [0, 4, 8, 12, 16]


def test_labels(replay):
    labels = "a b b a a a a".split()
    rows = [(1, n, x, 0.9 if x == "b" else 0.2, n != 2) for n, x in enumerate(labels)]
    got = replay(rows, "k long, frame long, label string, confidence double, usable boolean", lambda s: sf.label_hysteresis(s, "k"), "labels")
    assert [r.shown for r in sorted(got, key=lambda r: r.frame)] == [None, "b", "b", "b", "b", "a", "a"]


def test_dedup_and_rate(spark, replay):
    rows = [(n % 4, n) for n in range(12)]
    timed = lambda s: s.withColumn("ts", s.n.cast("timestamp"))
    assert len(replay(rows, "code long, n long", lambda s: sl.stream_dedup(timed(s), "code", "ts"), "dedup")) == 4


def test_batch_stats_and_score(spark, replay):
    schema = "batch_id long, color_score double, integrity_score double, shape_score double, size_score double, defect_score double, processing_time double, model_grade string, model_score double, defects array<struct<type:string,name:string,severity:string>>"
    rows = [(n % 2, 90.0, 90.0, 90.0, 90.0, 90.0, 1.0, None, None, [("rot", "rot", "severe")] if n == 3 else []) for n in range(6)]
    got = replay(rows, schema, lambda s: sl.stream_batch_stats(sl.stream_score(s)), "stats", mode="complete")
    assert {r.batch_id: (r.total, r.n_a, r.n_c) for r in got} == {0: (3, 3, 0), 1: (3, 2, 1)}


def test_sessions_and_rate_plan(spark, replay):
    rows = [(1, t) for t in (0, 100, 220, 500, 5000)]
    timed = lambda s: s.withColumn("ts", s.t.cast("timestamp"))
    got = replay(rows, "k long, t long", lambda s: sl.stream_sessions(timed(s), "k", "ts", late="1 second"), "sessions", batches=5)
    assert [r.n for r in sorted(got, key=lambda r: r.start)][:2] == [3, 1]


def test_messages_are_there_once(spark, tmp_path):
    """A micro-batch whose commit is lost runs again and adds nothing; later ones add to the statistics."""
    import json

    schema = "batch_id long, color_score double, integrity_score double, shape_score double, size_score double, defect_score double, processing_time double, model_grade string, model_score double, defects array<struct<type:string,name:string,severity:string>>"
    row = lambda n: (n % 2, 90.0, 90.0, 90.0, 90.0, 90.0, 1.0, None, None, [])

    def feed(part, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / part))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        sl.publish_batch_stats(sl.stream_score(stream), str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
        files = spark.read.option("basePath", str(tmp_path / "out")).json(str(tmp_path / "out"))
        return files.count(), {r.batch_id: json.loads(r.message)["stats"]["total"] for r in sl.published_stats(spark, str(tmp_path / "out")).collect()}

    assert feed("a", [row(n) for n in range(5)]) == (2, {0: 3, 1: 2})
    for lost in (tmp_path / "state" / "commits").glob("*0*"):
        lost.unlink()
    assert feed("b", [row(0)]) == (3, {0: 4, 1: 2})
    assert feed("c", [row(1), row(0)]) == (5, {0: 5, 1: 3})

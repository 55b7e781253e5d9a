"""Streams in event order: rows shuffled over micro-batches give the result of the whole table."""

import random

import pytest

from gradeloom.operators.ordered import ema, steady_labels, throttle_events
from gradeloom.streaming import stateful as sf
from gradeloom.streaming import tracking as tr


@pytest.fixture
def shuffled(spark, tmp_path):
    def run(rows, schema, make, name, batches=4):
        """Feed the rows in random order in several micro-batches, then one row of another key that lets all time pass."""
        rows = random.Random(2).sample(rows, len(rows))
        size = -(-len(rows) // batches)
        parts = [rows[n * size : (n + 1) * size] for n in range(batches)]
        for n, part in enumerate([*parts, *[[(-1 - k, 10**6 + 10**5 * k, *[None] * (len(rows[0]) - 2))] for k in range(2)]]):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = make(stream.withColumn("ts", (stream.at / 100 + 10).cast("timestamp"))).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        return [r for r in spark.table(name).collect() if r[0] >= 0]

    return run


LATE = "1 hour"


def test_labels_and_smoothing(spark, shuffled):
    rng = random.Random(1)
    rows = [(rng.choice([0, 0, 1]), n, n, rng.choice("aaab"), rng.choice([0.25, 0.5]), rng.random() < 0.8) for n in range(120)]
    schema = "k long, at long, frame long, label string, confidence double, usable boolean"
    table = spark.createDataFrame(rows, schema)
    got = shuffled(rows, schema, lambda s: sf.label_hysteresis(s, "k", ts="ts", late=LATE), "ordered_labels")
    want = steady_labels(table, "k", "frame", "label", "confidence", "usable").select("k", "frame", "shown").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({r.shown for r in want}) == 3


def test_smoothing(spark, shuffled):
    rows = [(n % 2, n, n, float(n * n % 17)) for n in range(40)]
    schema = "k long, at long, id long, value double"
    got = {r.id: r.smooth for r in shuffled(rows, schema, lambda s: sf.stream_ema(s, "k", 0.3, ts="ts", late=LATE), "ordered_ema")}
    want = {r.id: r.smooth for r in ema(spark.createDataFrame(rows, schema), "k", ["id"], "value", 0.3).collect()}
    assert got == pytest.approx(want)


def test_throttle_and_presence(spark, shuffled):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2]), t, i, t / 64, int(rng.random() < 0.4)) for i, t in enumerate(sorted(rng.sample(range(4000), 150)))]
    schema = "k long, at long, id long, seconds double, boxes int"
    got = shuffled(rows, schema, lambda s: sf.throttle(s, "k", 0.75, ts="ts", late=LATE), "ordered_throttle")
    want = throttle_events(spark.createDataFrame(rows, schema), "k", "at", "id", 48).select("k", "id").collect()
    assert sorted((r.k, r.id) for r in got) == sorted(map(tuple, want)) and 20 < len(want) < 140


def test_tracks(spark, shuffled):
    box = lambda x: {"box": [x, 0.0, x + 100.0, 100.0], "label": "red:good", "kind_confidence": 0.8, "grade_confidence": 0.7, "joint_confidence": 0.6, "sharpness": None}
    rows = [(0, n, n, [] if n == 7 else [box(4.0 * n)] if n % 5 else [box(4.0 * n), box(400.0)]) for n in range(24)]
    schema = "camera long, at long, frame long, seen array<struct<box:array<double>,label:string,kind_confidence:double,grade_confidence:double,joint_confidence:double,sharpness:double>>"
    got = shuffled(rows, schema, lambda s: tr.track_objects(s, "camera", ts="ts", late=LATE), "ordered_tracks")
    tracks, number, want = [], 0, []
    for _, _, frame, boxes in rows:
        seen = [tr.Seen(tuple(b["box"]), b["label"], (0.8, 0.7, 0.6), float("inf")) for b in boxes]
        tracks, number = tr.next_tracks(tracks, seen, number)
        want += [(0, frame, *r) for r in tr.published(tracks)]
    assert [tuple(r)[:8] for r in sorted(got, key=lambda r: (r.frame, r.x1))] == [r[:8] for r in want]

"""Streams with state of their own by key: presence, throttling, smoothing and steady labels.

Each operator is a small step from the state and a row to the new state and, at times, a row out. State is
one row by key in Spark's state store. Rows are taken in the order of their event time where ``ts`` names it (``event_order.py``), else in the order of
``order`` inside a micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from gradeloom.streaming.event_order import scan_in_event_order

Step = Callable[[tuple, Any], tuple[tuple, tuple | list[tuple] | None]]


def scan_by_key(stream: DataFrame, key: str, order: str, out: str, state: str, first: tuple, step: Step, idle: int | None = None, ts: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Run ``step`` over the rows of each key; ``out`` and ``state`` are schemas, ``out`` begins with the key.

    A step gives a row, several or none. With ``ts`` rows are taken in the order of that event time, across micro-batches, once the watermark (``late``) has
    passed them. Without it what a micro-batch holds of a key is sorted together, and rows that come in a later
    micro-batch are taken as later. ``idle``: milliseconds without rows after which a key's state is dropped (null: never).
    """
    if ts is not None:
        return scan_in_event_order(stream, key, ts, order, out, first, step, late, idle)
    names = [part.split()[0] for part in out.split(",")]

    def scan(group: tuple, parts: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        now, found = kept.get if kept.exists else first, []
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        for row in rows.itertuples(index=False):
            now, result = step(now, row)
            if result is not None:
                found += [(group[0], *r) for r in (result if isinstance(result, list) else [result])]
        kept.update(now)
        if idle is not None:
            kept.setTimeoutDuration(idle)
        yield pd.DataFrame(found, columns=names)

    return stream.groupBy(key).applyInPandasWithState(scan, out, state, "append", GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout)


def presence_step(now: tuple, row: Any, misses: int = 3) -> tuple[tuple, tuple | None]:
    present, empty = now
    if row.boxes > 0:
        return (True, 0), (row.frame, "live_detection" if present else "detection_group")
    if not present:
        return (False, 0), None
    if empty + 1 >= misses:
        return (False, 0), (row.frame, "target_cleared")
    return (True, empty + 1), None


def presence_gate(stream: DataFrame, key: str, ts: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``frame, event`` of frames (``frame, boxes``): a group starts when boxes appear and is cleared by three empty frames in a row."""
    return scan_by_key(stream, key, "frame", f"{key} long, frame long, event string", "present boolean, empty int", (False, 0), presence_step, ts=ts, late=late)


def presence_events(frames: DataFrame, key: str, misses: int = 3) -> DataFrame:
    """The same events of a whole table: distances to the last frame with boxes, by windows alone."""
    by = Window.partitionBy(key).orderBy("frame")
    rows = frames.withColumn("_n", F.row_number().over(by))
    last = F.max(F.when(F.col("boxes") > 0, F.col("_n"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_gap", F.col("_n") - last)
    event = F.when((F.col("boxes") > 0) & (F.col("_gap") <= misses), "live_detection").when(F.col("boxes") > 0, "detection_group").when(F.col("_gap") == misses, "target_cleared")
    return rows.withColumn("event", event).filter("event IS NOT NULL").select(key, "frame", "event")


def throttle(stream: DataFrame, key: str, interval: float = 0.35, ts: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``id, seconds`` of the rows at least ``interval`` after the last row that passed."""

    def step(now: tuple, row: Any) -> tuple[tuple, tuple | None]:
        if now[0] is None or row.seconds - now[0] >= interval:
            return (row.seconds,), (row.id, row.seconds)
        return now, None

    return scan_by_key(stream, key, "seconds", f"{key} long, id long, seconds double", "last double", (None,), step, ts=ts, late=late)


def stream_ema(stream: DataFrame, key: str, alpha: float, ts: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``id, smooth``: the exponential mean of ``value`` in the order of ``id``."""

    def step(now: tuple, row: Any) -> tuple[tuple, tuple | None]:
        smooth = float(row.value) if now[0] is None else (1 - alpha) * now[0] + alpha * float(row.value)
        return (smooth,), (row.id, smooth)

    return scan_by_key(stream, key, "id", f"{key} long, id long, smooth double", "smooth double", (None,), step, ts=ts, late=late)


def label_step(now: tuple, row: Any, confirm: int = 2, switch: int = 3) -> tuple[tuple, tuple]:
    """The next state ``(shown, seen, labels, sums, other, run)`` and ``(frame, shown)``."""
    shown, seen, labels, sums, other, run = now
    if row.usable:
        seen += 1
        if shown is None:
            scores = dict(zip(labels, sums, strict=True))
            scores[row.label] = scores.get(row.label, 0.0) + float(row.confidence)
            labels, sums = list(scores), list(scores.values())
            if seen >= confirm:
                shown = min(scores, key=lambda x: (-scores[x], x))
        elif row.label == shown:
            other, run = None, 0
        else:
            run = run + 1 if row.label == other else 1
            other = row.label
            if run >= switch:
                shown, other, run = row.label, None, 0
    return (shown, seen, labels, sums, other, run), (row.frame, shown)


def label_hysteresis(stream: DataFrame, key: str, confirm: int = 2, switch: int = 3, ts: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``frame, shown`` of observations (``frame, label, confidence, usable``).

    The first label is that of the greatest summed confidence once ``confirm`` usable observations came (ties: the
    label first in order); later ``switch`` usable ones in a row of the same other label change it.
    """
    state = "shown string, seen int, labels array<string>, sums array<double>, other string, run int"
    return scan_by_key(stream, key, "frame", f"{key} long, frame long, shown string", state, (None, 0, [], [], None, 0), lambda now, row: label_step(now, row, confirm, switch), ts=ts, late=late)

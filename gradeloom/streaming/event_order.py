"""Streams with state by key whose rows are taken in the order of their event time, whatever micro-batch brings them.

Rows wait in the key's list until the watermark has passed them; a timer of the key then takes them in order through the same small
steps that ``stateful.scan_by_key`` runs. What comes later than the watermark is dropped. The result so does not depend on how
rows fell into micro-batches, and equals that of the whole table if none is late.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from types import SimpleNamespace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Waiting rows as ``(micros, row)`` and the step's state, each as JSON."""

    def __init__(self, order: str, names: list[str], first: tuple, step: Callable, idle: int | None) -> None:
        self.order, self.names, self.first, self.step, self.idle = order, names, first, step, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, row string")
        self.now = handle.getValueState("now", "state string, last long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        first = None
        for part in rows:
            for at, row in zip(part["at_micros"].tolist(), part["row_json"].tolist(), strict=True):
                if at // 1000 >= passed:  # others are late
                    self.waiting.appendValue((at, row))
                    first = at if first is None else min(first, at)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        due, rest = [r for r in rows if r[0] < passed], [r for r in rows if r[0] >= passed]
        now, last = self.now.get() if self.now.exists() else (None, None)
        state, found = self.first if now is None else tuple(json.loads(now)), []
        due = sorted(((at, json.loads(text)) for at, text in due), key=lambda r: (r[0], r[1][self.order]))
        for at, values in due:
            row = SimpleNamespace(**values)
            state, result = self.step(state, row)
            last = at
            if result is not None:
                found += [(key[0], *r) for r in (result if isinstance(result, list) else [result])]
        if due:
            self.now.update((json.dumps(state), last))
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            if self.idle is not None:
                self.handle.registerTimer(last // 1000 + self.idle + 1)
        if rest:
            self.handle.registerTimer(min(r[0] for r in rest) // 1000 + 1)
        elif self.idle is not None and last is not None and passed >= last + self.idle * 1000:
            self.now.clear()
        return iter([pd.DataFrame(found, columns=self.names)] if found else [])

    def close(self) -> None:
        pass


def scan_in_event_order(stream: DataFrame, key: str, ts: str, order: str, out: str, first: tuple, step: Callable, late: str = "10 minutes", idle: int | None = None) -> DataFrame:
    """Run ``step`` over the rows of each key in the order of ``ts``, then ``order``; ``out`` is a schema that begins with the key.

    ``late`` is how long after the newest row others may come. ``idle``: milliseconds of event time without rows after which a key's state is
    forgotten (null: never). State lies in RocksDB, which the session is set to; rows of null time are dropped.
    """
    stream.sparkSession.conf.set(_STORE, _ROCKSDB)
    timed = stream.filter(F.col(ts).isNotNull()).withWatermark(ts, late)
    packed = F.to_json(F.struct(*[c for c in stream.columns if c != ts]), {"ignoreNullFields": "false"})
    # names that begin with an underscore do not reach the processor
    rows = timed.select(key, ts, F.unix_micros(ts).alias("at_micros"), packed.alias("row_json"))
    schema = StructType.fromDDL(out)
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=InOrder(order, schema.fieldNames(), first, step, idle), outputStructType=schema, outputMode="Append", timeMode="EventTime")

"""Exact search for windows that occur more than once, shared by the two substring operators.

Every window of a fixed length has an anchor that its own content decides, so equal windows have
equal anchors at equal places. A run is a stretch of neighbouring windows of one text with one
anchor; its row is ``(name, content, row, at)``: the anchor's hash, the hash of the whole stretch,
the number of the text's row and the packed place (start, number of windows).

* Runs alike in a portion of some texts are settled there: one of them stands for all, the others are
  ``KNOWN`` to repeat. A passage that a third of all texts hold so sends one row for each portion.
* A name that occurs once holds no repeat. Most rows end there, after the only wide shuffle.
* Runs alike in name and content repeat as a whole.
* Only where one name has several contents do single windows matter, and there one run stands
  for all of equal content. The windows of these few runs are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeloom.llm.tokens import U64, mix, signed
from gradeloom.plans.durable import written
from gradeloom.plans.session import small_batches

#: Set in the place of a run that is known to repeat: settled before the shuffle, and dealt
#: by a name of its own, so that it loads no single task.
KNOWN = np.int64(1 << 31)


def packed_place(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 32) | (count.astype(np.int64) << 24)


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return at >> 32, (at >> 24) & 127


def is_known() -> Column:
    return F.shiftright("at", 31).bitwiseAND(1) == 1


def stored(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A written row for each row of ``docs``: a number ``row``, its ``id``, and the text compressed in ``small``.

    All later steps name texts by that number, so ids may be null, repeated and of any type. Nothing is
    computed from the numbers before they are written.
    """
    small_batches(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = batch.column(1).fill_null("").cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press.compress(x.as_buffer()) for x in texts], pa.binary())], ["id", "small"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(pack, f"id {kind}, small binary")
    return written(rows.withColumn("row", F.monotonically_increasing_id()))


def opened(column: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Portions ``(first, last, bytes, offsets)`` of compressed texts, of about ``limit`` bytes, one whole text at least."""
    loose = zstandard.ZstdDecompressor()
    first, parts, size = 0, [], 0
    for k in range(len(column)):
        parts.append(loose.decompress(column[k].as_buffer()))
        size += len(parts[-1])
        if size >= limit or k == len(column) - 1:
            yield first, k + 1, np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            first, parts, size = k + 1, [], 0


def company(name: np.ndarray, content: np.ndarray, order: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the first of their name and content here, by ``order``, and which have company."""
    code = mix(name ^ mix(content))
    line = np.lexsort([*order[::-1], code])
    new = np.ones(len(code), bool)
    new[1:] = code[line[1:]] != code[line[:-1]]
    begin = np.flatnonzero(new)
    number = np.diff(begin, append=len(code))
    lead = np.repeat(line[begin], number)
    first, more = np.zeros(len(code), bool), np.zeros(len(code), bool)
    first[line] = np.all([x[line] == x[lead] for x in order], axis=0) if order else new
    more[line] = np.repeat(number > 1, number)
    return first, more


def as_known(name: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Name and place of rows that are known to repeat: each has a name of its own."""
    return mix(name ^ mix(row.view(U64) ^ at.view(U64))), at | KNOWN


def runs_batch(name: np.ndarray, content: np.ndarray, row: np.ndarray, at: np.ndarray, known: np.ndarray, plain: np.ndarray, more: dict[str, pa.Array] | None = None) -> pa.RecordBatch:
    """Rows of runs: the ``plain`` ones under their names and the ``known`` ones under names of their own."""
    alone, marked = as_known(name, row, at)
    both = lambda x, y: np.concatenate([x[plain], y[known]])
    columns = [pa.array(signed(both(name, alone))), pa.array(signed(both(content, content))), pa.array(both(row, row)), pa.array(both(at, marked))]
    index = pa.array(np.concatenate([np.flatnonzero(plain), np.flatnonzero(known)]))
    more = more or {}
    return pa.RecordBatch.from_arrays([*columns, *[c.take(index) for c in more.values()]], ["name", "content", "row", "at", *more])


#: Texts that are returned go out in batches of about so many bytes.
PORTION = 1 << 26
RUNS = "name long, content long, row long, at long"


def sorted_runs(runs: DataFrame, *order: str) -> DataFrame:
    """Runs whose name occurs twice or more or that are ``known``, with ``nth`` (ties alike) and ``copies`` among runs alike and ``mixed`` (several contents)."""
    by_name = Window.partitionBy("name")
    alike = Window.partitionBy("name", "content")
    return (
        runs.repartition("name")
        .sortWithinPartitions("name", "content", *order)
        .withColumn("uses", F.count(F.lit(1)).over(by_name))
        .withColumn("mixed", F.min("content").over(by_name) != F.max("content").over(by_name))
        .withColumn("known", is_known())
        .filter("uses > 1 or known")
        .withColumn("copies", F.count(F.lit(1)).over(alike))
        .withColumn("line", F.row_number().over(alike.orderBy(*order)))
        .withColumn("nth", F.dense_rank().over(alike.orderBy(*order)))
    )


def texts_with_places(small: DataFrame, places: DataFrame, values: list[str], how: str) -> DataFrame:
    """Join the places of each text to it. The places are fewer than the texts' bytes, so they build the hash table."""
    grouped = places.groupBy("row").agg(*[F.collect_list(v).alias(v) for v in values])
    return small.join(grouped.hint("shuffle_hash"), "row", how)


def windows_of_runs(small: DataFrame, runs: DataFrame, length: int, hashes, with_id: bool) -> DataFrame:
    """A row for each single window of these runs, settled by portions like the runs: ``name, content, row, at`` (and ``id``).

    ``hashes`` turns the bytes of a text into a function from starts to hashes of windows.
    """
    kind = small.schema["id"].dataType.simpleString()
    loose = zstandard.ZstdDecompressor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = loose()
        for batch in batches:
            held, size = [], 0
            names, places = lists(batch.column("name")), lists(batch.column("at"))
            rows, rank = batch.column("row").to_numpy(), ranks(batch.column("id"))
            for k, (name, at) in enumerate(zip(names, places, strict=True)):
                of = hashes(np.frombuffer(opener.decompress(batch.column("small")[k].as_buffer()), np.uint8))
                first, count = unpacked(at)
                start = np.repeat(first, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
                held.append((np.repeat(name, count).view(U64), of(start), start, np.full(len(start), k)))
                size += len(start)
                if size >= 1 << 18 or k == batch.num_rows - 1:
                    yield settled(held, rows, rank, batch.column("id"))
                    held, size = [], 0

    def settled(held: list, rows: np.ndarray, rank: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
        name, content, start, text = (np.concatenate([h[i] for h in held]) for i in range(4))
        at, row = packed_place(start, np.ones(len(start), np.int64)), rows[text]
        if with_id:
            first, _ = company(name, content, (rank[text], start))
            return runs_batch(name, content, row, at, ~first, first, {"id": ids.take(pa.array(text))})
        first, more = company(name, content)
        return runs_batch(name, content, row, at, more, first)

    joined = texts_with_places(small, runs, ["name", "at"], "inner").select("row", "id", "small", "name", "at")
    return joined.mapInArrow(run, RUNS + (f", id {kind}" if with_id else ""))


def ranks(ids: pa.Array) -> np.ndarray:
    """Places of ids in their order, equal ones alike, null first."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


def lists(column: pa.Array) -> Iterator[np.ndarray]:
    """One int64 array a row of a list column; a null row is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.values.to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy()
    for k in range(len(column)):
        yield flat[ends[k] : ends[k + 1]] if column[k].is_valid else flat[:0]


def covered(places: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which of ``size`` places lie in a window of ``length`` that starts in one of the packed runs."""
    start, count = unpacked(places)
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + count - 1 + length, -1)
    return np.cumsum(edge)[:size] > 0

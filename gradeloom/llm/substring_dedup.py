"""Removal of repeated word passages by recompression.

Words get 64-bit names. A round names each maximal run of one symbol, then names each pair of a
left and a right symbol (the side is a bit of the symbol's name), so that the sequence shrinks by a
quarter and more. A name is a function of what it stands for, and therefore the same in every text
and every task. With each symbol goes its context: the words that decide it. Two equal passages
hold the same symbols wherever the context lies inside, and those symbols anchor the windows.
The Spark rounds that follow (``repeats.py``) count the names over the whole corpus and verify runs
and single windows under shared names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeloom.llm import repeats
from gradeloom.llm.tokens import U64, Rolling, mix, word_hashes, words

FAR = np.int64(1 << 40)
NONE = U64(2**64 - 1)
ROUNDS = 3


def recompressed(codes: np.ndarray, text: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after some rounds, with their contexts ``[low, high)``; a context that leaves its text is far wider."""
    symbol, low, high = codes, np.arange(len(codes), dtype=np.int64), np.arange(1, len(codes) + 1, dtype=np.int64)
    for k in range(rounds):
        if len(symbol) == 0:
            break
        joined = text[1:] == text[:-1]
        first = np.flatnonzero(np.concatenate([[True], ~(joined & (symbol[1:] == symbol[:-1]))]))
        length = np.diff(first, append=len(symbol))
        last = first + length - 1
        symbol = np.where(length > 1, mix(symbol[first] ^ mix(length.astype(U64) + U64(k << 32))), symbol[first])
        # a run's border is decided by the one symbol beside it, however long the run that this one belongs to
        text, run_low, run_high, last_low, first_high = text[first], low[first], high[last], low[last], high[first]
        joined = text[1:] == text[:-1]
        low, high = run_low.copy(), run_high.copy()
        low[0], high[-1] = -FAR, FAR
        low[1:] = np.where(joined, np.minimum(run_low[1:], last_low[:-1]), -FAR)
        high[:-1] = np.where(joined, np.maximum(run_high[:-1], first_high[1:]), FAR)
        left = (mix(symbol + U64(0x5851F42D4C957F2D * (k + 1) % 2**64)) >> U64(63)) == 1
        meets = np.concatenate([joined & left[:-1] & ~left[1:], [False]])
        second = np.concatenate([[False], meets[:-1]])
        after_low, after_high = np.append(low[1:], -FAR), np.append(high[1:], FAR)
        before_low, before_high = np.concatenate([[-FAR], low[:-1]]), np.concatenate([[FAR], high[:-1]])
        ends = np.concatenate([~joined, [True]])
        begins = np.concatenate([[True], ~joined])
        new_low = np.where(left, np.where(ends, -FAR, np.minimum(low, after_low)), np.where(begins, -FAR, np.minimum(low, before_low)))
        new_high = np.where(left, np.where(ends, FAR, np.maximum(high, after_high)), np.where(begins, FAR, np.maximum(high, before_high)))
        pair = mix(symbol * U64(3) ^ np.append(symbol[1:], U64(0)) * U64(0xD6E8FEB86659FD93))
        symbol = np.where(meets, pair, symbol)
        keep = ~second
        symbol, text, low, high = symbol[keep], text[keep], new_low[keep], new_high[keep]
    return symbol, low, high


def anchored_runs(codes: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Name, content, first window and number of windows of every run, for windows of ``size`` words."""
    n = len(codes)
    if n < size:
        return (np.zeros(0, U64),) * 2 + (np.zeros(0, np.int64),) * 2
    rolling = Rolling(codes)
    symbol, low, high = recompressed(codes, text)
    fits = high - low <= size
    symbol, low, high = symbol[fits], low[fits], high[fits]
    valid = text[: n - size + 1] == text[size - 1 :]
    name = mix(rolling.of(low, high) ^ symbol)
    bits = U64(max(20, len(name).bit_length()))
    key = (name >> bits << bits) | np.arange(len(name), dtype=U64)
    # each symbol covers the windows [high - size, low]; two overlapping powers of two cover that range
    begin, end = np.maximum(high - size, 0), np.minimum(low, n - size)
    level = np.floor(np.log2(np.maximum(end - begin + 1, 1))).astype(np.int64)
    best = np.full(n - size + 1, NONE)
    for j in range(int(level.max(initial=0)), -1, -1):
        at = np.flatnonzero((level == j) & (end >= begin))
        if j < level.max(initial=0):
            wider = best.copy()
            wider[1 << j :] = np.minimum(wider[1 << j :], best[: len(best) - (1 << j)])
            best = wider
        np.minimum.at(best, begin[at], key[at])
        np.minimum.at(best, end[at] + 1 - (1 << j), key[at])
    place = np.flatnonzero(valid)
    if len(place) == 0:
        return (np.zeros(0, U64),) * 2 + (np.zeros(0, np.int64),) * 2
    chosen = best[place]
    new = np.ones(len(place), bool)
    new[1:] = (np.diff(place) != 1) | (chosen[1:] != chosen[:-1]) | (chosen[1:] == NONE)
    first = np.flatnonzero(new)
    start, count = place[first], np.diff(first, append=len(place))
    content = rolling.of(start, start + count - 1 + size)
    chosen = chosen[first]
    own = chosen == NONE  # no symbol is decided inside: the window stands for itself
    which = np.where(own, 0, (chosen & ((U64(1) << bits) - U64(1))).astype(np.int64))
    if len(name) == 0:
        name, low = np.zeros(1, U64), np.zeros(1, np.int64)
    offset = np.where(own, 0, low[which] - start).astype(U64)
    return np.where(own, mix(content), name[which]), mix(content ^ mix(offset + U64(7))), start, count


def first_word(text: np.ndarray, texts: int) -> np.ndarray:
    """The number of the first word of each text."""
    return np.searchsorted(text, np.arange(texts), side="left")


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """Remove each word that a window of ``window`` words covers whose words also start anywhere else.

    Returns the id, ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept`` (the kept words joined by
    one space) for every row. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A null or empty text has no
    words, loses none and keeps the empty string. Texts shorter than a window lose nothing. A repeated
    row is a second document with the same words, so both lose them. Ids may be null, repeated and of any
    type. A very long text is one row of one task, read whole. An empty table gives an empty result. Other columns are not read.
    """
    if not 2 <= window <= 127:
        raise ValueError("window must be between 2 and 127 words")
    small = repeats.stored(docs, id_col, text_col)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row").to_numpy()
            for a, b, data, offsets in repeats.opened(batch.column("small"), 1 << 21):
                starts, ends, text = words(data, offsets)
                name, content, start, count = anchored_runs(word_hashes(data, starts, ends), text, window)
                if len(start):
                    owner = text[start]
                    at = repeats.packed_place(start - first_word(text, b - a)[owner], count)
                    first, more = repeats.company(name, content)
                    yield repeats.runs_batch(name, content, row[a + owner], at, more, first)

    runs = repeats.sorted_runs(small.select("row", "small").mapInArrow(find, repeats.RUNS), "row", "at")
    runs = repeats.written(runs.filter("known or copies > 1 or (mixed and line = 1)").select("name", "row", "at", "copies", "line", "mixed", "known"))

    def hashes(data: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        begin, end, _ = words(data, np.array([0, len(data)]))
        rolling = Rolling(word_hashes(data, begin, end))
        return lambda start: rolling.of(start, start + window)

    windows = repeats.windows_of_runs(small, runs.filter("mixed and line = 1 and not known"), window, hashes, with_id=False)
    again = windows.withColumn("uses", F.count(F.lit(1)).over(Window.partitionBy("name", "content"))).filter(repeats.is_known() | (F.col("uses") > 1))
    found = runs.filter("known or copies > 1").select("row", "at").unionByName(again.select("row", "at"))
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose = zstandard.ZstdDecompressor()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            rows, first, size = [], 0, 0
            for k, at in enumerate(repeats.lists(batch.column("at"))):
                parts = loose.decompress(batch.column("small")[k].as_buffer()).split()
                gone = repeats.covered(at, window, len(parts))
                left = b" ".join([parts[j] for j in np.flatnonzero(~gone)] if len(at) else parts)
                rows.append((len(parts), int(gone.sum()), hashlib.sha256(left).hexdigest(), left.decode()))
                size += len(left)
                if size > repeats.PORTION or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, k + 1 - first), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], [id_col, "n_words", "n_removed", "kept_sha256", "kept"])
                    rows, first, size = [], k + 1, 0

    return repeats.texts_with_places(small, found, ["at"], "left").select("id", "small", "at").mapInArrow(cut, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string, kept string")

"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words at a fixed mask's places; the other places may differ. Two texts that
share a seed are laid on each other there, and the overlap around is verified word by word: it counts
if a stretch of ``STRETCH`` words agrees in four words of five. The two masks find every such stretch
(all ways to place the differing words were tried out). Items shorter than a stretch must agree as a
whole to the same share and have a mask of neighbours that finds them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gradeloom.llm.tokens import LOWER, U64, groups, mix, word_hashes, words
from gradeloom.plans.session import small_batches

STRETCH = 13
SIMILARITY = 0.8
#: Places that count, of masks that together meet every stretch of 13 words with two that differ.
MASKS = ((0, 1, 3, 5, 6, 7), (0, 1, 2, 5, 6, 9))
#: The most test words that are broadcast at a time; a larger benchmark is searched in blocks of this size.
BLOCK_WORDS = 1_000_000
#: Meetings of seeds that are expanded at a time; the different placings of an item on a text are what is kept of them.
PAIRS = 1 << 18


def tolerated(length: int) -> int:
    """How many of this many words may differ."""
    return length - int(np.ceil(SIMILARITY * length - 1e-9))


def masks_of(length: int) -> tuple[tuple[int, ...], ...]:
    if length >= STRETCH:
        return MASKS
    return (tuple(range(max(1, length // (tolerated(length) + 1)))),)


def seeds(codes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The seed at every place where the mask fits."""
    n = len(codes) - mask[-1]
    if n <= 0:
        return np.zeros(0, U64)
    total = np.full(n, U64(len(mask) * 1000 + mask[-1]))
    for k, place in enumerate(mask):
        total = mix(total + codes[place : place + n] * U64(2 * k + 3))
    return total


class TestSet:
    """Seeds and words of some benchmark items."""

    __test__ = False

    def __init__(self, items: list[tuple[object, str | None]]):
        self.items: list[tuple[object, np.ndarray]] = []
        found: dict[tuple[int, ...], dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for name, text in items:
            data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            start, end, _ = words(data, np.array([0, len(data)]))
            codes = word_hashes(data, start, end)
            if len(codes):
                for mask in masks_of(len(codes)):
                    for at, seed in enumerate(seeds(codes, mask).tolist()):
                        found[mask][seed].append((len(self.items), at))
                self.items.append((name, codes))
        self.masks = []
        for mask, table in found.items():
            keys = np.array(sorted(table), U64)
            ends = np.cumsum([len(table[k]) for k in keys.tolist()])
            which = np.array([p for k in keys.tolist() for p in table[k]], np.int64).reshape(-1, 2)
            flags = np.zeros(1 << 20, bool)
            flags[(keys >> U64(44)).astype(np.int64)] = True
            self.masks.append((mask, keys, ends, which, flags))

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """``(text, item, start, words that agree in the best stretch, stretch)`` of each verified overlap, best first."""
        data = LOWER[data]
        start, end, owner = words(data, offsets)
        codes = word_hashes(data, start, end)
        pairs = []
        for mask, keys, ends, which, flags in self.masks:
            mine = seeds(codes, mask)
            at = np.flatnonzero(flags[(mine >> U64(44)).astype(np.int64)])
            place = np.minimum(np.searchsorted(keys, mine[at]), len(keys) - 1)
            real = (keys[place] == mine[at]) & (owner[at] == owner[np.minimum(at + mask[-1], len(owner) - 1)])
            at, place = at[real], place[real]
            count = ends[place] - np.concatenate([[0], ends])[place]
            border = np.searchsorted(np.cumsum(count), np.arange(PAIRS, int(count.sum()) + PAIRS, PAIRS), side="left") + 1
            for x, y in zip(np.concatenate([[0], border])[:-1].astype(np.int64), border, strict=True):  # seeds with many places on both sides: a portion at a time
                n = count[x:y]
                row = np.repeat(ends[place[x:y]] - n, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                pairs.append(np.unique(np.stack([which[row, 0], np.repeat(at[x:y], n) - which[row, 1], np.repeat(owner[at[x:y]], n)], axis=1), axis=0))
        if not pairs:
            return []
        pairs = np.unique(np.concatenate(pairs), axis=0)
        first = np.searchsorted(owner, np.arange(len(offsets)), side="left")
        out = []
        for k in np.unique(pairs[:, 0]):
            mine = codes_of = self.items[k][1]
            n = len(codes_of)
            width = min(STRETCH, n)
            group = pairs[pairs[:, 0] == k]
            for part in range(0, len(group), 4096):
                _, diagonal, text = group[part : part + 4096].T
                at = diagonal[:, None] + np.arange(n)
                inside = (at >= first[text][:, None]) & (at < first[text + 1][:, None])
                same = (codes[np.clip(at, 0, len(codes) - 1)] == mine) & inside
                run = np.concatenate([np.zeros((len(same), 1), np.int64), np.cumsum(same, axis=1)], axis=1)
                best = (run[:, width:] - run[:, :-width]).max(axis=1)
                for x in np.flatnonzero(best >= width - tolerated(width)):
                    out.append((int(text[x]), int(k), int(diagonal[x] - first[text[x]]), int(best[x]), int(same[x].sum())))
        return sorted(out, key=lambda h: (h[0], h[1], -h[3], -h[4], h[2]))


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int = BLOCK_WORDS) -> Iterator[TestSet]:
    """The benchmark in parts of about ``block_words`` words, one after the other on the driver."""
    size = F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"))
    total = benchmark.agg(F.sum(size)).first()[0] or 0
    number = max(1, -(-total // block_words))
    part = F.pmod(F.xxhash64(F.col(item_col).cast("string"), text_col), F.lit(number))
    for k in range(number):
        rows = benchmark.filter(part == k).select(item_col, text_col).collect()
        yield TestSet(sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, "" if r[0] is None else f"{r[0]:020d}" if isinstance(r[0], int) else str(r[0]), r[1] or "")))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document and benchmark item that overlap: the best place of theirs.

    Columns: the document's id and the item's, ``start`` (word of the document where the item's first
    word would lie; negative if it lies before), ``stretch`` (words compared), ``agreed`` (of them, those
    that agree), ``shared`` (words that agree over the whole item) and ``item_words``. Letters A-Z are
    made small first. Ids of both sides may be of any type. Null or blank texts and items never overlap. Repeated rows give their rows again; ids may be
    null. An empty benchmark or table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, start long, stretch long, agreed long, shared long, item_words long"
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("decontaminated_text"))
    out = None
    for tests in blocks(benchmark, item_col, item_text_col, block_words):
        sent = spark.sparkContext.broadcast(tests)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            test = sent.value
            for batch in batches:
                for a, _, data, offsets in groups(batch.column(1)):
                    best = {}
                    for hit in test.hits(data, offsets):
                        best.setdefault(hit[:2], hit)
                    if best:
                        found = list(best.values())
                        size = [len(test.items[k][1]) for _, k, *_ in found]
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column(0).take(pa.array([a + h[0] for h in found])),
                                pa.array([test.items[h[1]][0] for h in found], item_type),
                                pa.array([h[2] for h in found], pa.int64()),
                                pa.array([min(STRETCH, n) for n in size], pa.int64()),
                                pa.array([h[3] for h in found], pa.int64()),
                                pa.array([h[4] for h in found], pa.int64()),
                                pa.array(size, pa.int64()),
                            ],
                            [id_col, item_col, "start", "stretch", "agreed", "shared", "item_words"],
                        )

        part = rows.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item, with all their columns; null texts stay."""
    small_batches(docs.sparkSession)
    for tests in blocks(benchmark, item_col, item_text_col, block_words):
        clean = clean_texts(docs.sparkSession.sparkContext.broadcast(tests))
        docs = docs.filter(clean(F.col(text_col).cast("string")))
    return docs


def clean_texts(sent: Broadcast) -> Callable[[Column], Column]:
    """A vectorised function of texts: whether none of the broadcast items overlaps."""

    def clean(text: pd.Series) -> pd.Series:
        keep = np.ones(len(text), bool)
        for a, _, data, offsets in groups(pa.array(text, pa.string())):
            for hit in sent.value.hits(data, offsets):
                keep[a + hit[0]] = False
        return pd.Series(keep)

    return F.pandas_udf(clean, "boolean")

"""The best documents of each item by a whole-number BM25, found by presence masks.

Terms of a block of items are looked up in every text once; what a text holds of them is its line of an
index, which is written. Tasks then read the index in blocks of documents and turn it into one bitmap a
term. For an item the documents of a block are split by these bitmaps, the terms with the
largest weight first: documents with one mask of matched terms end in one group. A group's bound is the sum of
what its matched terms, and those not yet asked, give at most in this block. The group with the largest bound
is split or scored next, until the bound is under the score of the last place: no mask left can reach it.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeloom.plans.durable import written
from gradeloom.plans.session import small_batches

#: Items are searched in blocks of at most so many terms (one item at least) and items; each block reads the texts once.
BLOCK_TERMS, BLOCK_ITEMS = 200_000, 5_000
#: A task turns so many entries of the index into bitmaps at a time (one document at least).
ENTRIES = 1 << 21
#: A group of so few documents is scored at once: its masks need not be told apart.
FEW = 64
#: Bytes of a text that are cut into terms at a time.
PIECE = 1 << 20

_TABLE = bytes(k + 32 if 65 <= k <= 90 else k if k >= 128 or 48 <= k <= 57 or 97 <= k <= 122 else 32 for k in range(256))


def terms(text: str | None) -> Counter:
    """The terms of a text (maximal runs of ASCII letters, digits and all characters beyond ASCII; A-Z made small) with their numbers."""
    data = (text or "").encode().translate(_TABLE)
    found: Counter = Counter()
    start = 0
    while start < len(data):
        end = data.find(b" ", start + PIECE)
        end = len(data) if end < 0 else end
        found.update(data[start:end].split())
        start = end
    return found


def blocks_of_items(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Blocks of ``(number, terms)``; ``items`` has a ``number``."""
    block, size = [], 0
    for r in items.select("number", "texts").toLocalIterator():
        own = sorted(set().union(*(terms(t) for t in r["texts"])))
        if block and (size + len(own) > BLOCK_TERMS or len(block) == BLOCK_ITEMS):
            yield block
            block, size = [], 0
        block.append((r["number"], own))
        size += len(own)
    if block:
        yield block


def index_of(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """A written line for each text with a term: ``id``, ``n`` (its terms), and those of the vocabulary as ``held`` with their numbers ``tf``."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            lines, number, held, tf, ends = [], [], [], [], [0]
            for k, text in enumerate(batch.column(1)):
                found = terms(text.as_py())
                if found:
                    lines.append(k)
                    number.append(found.total())
                    own = [(known[t], c) for t, c in found.items() if t in known]
                    held += [x for x, _ in own]
                    tf += [c for _, c in own]
                    ends.append(len(held))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(lines, pa.int64())), pa.array(number, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(held, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))],
                ["id", "n", "held", "tf"],
            )

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(texts.mapInArrow(run, "id long, n long, held array<int>, tf array<long>"))


class Block:
    """Documents of one task turned by term: for each term its documents and what it adds to their scores."""

    def __init__(self, n: np.ndarray, ends: np.ndarray, held: np.ndarray, tf: np.ndarray, weight: np.ndarray, documents: int, length: int) -> None:
        self.size = len(n)
        m = np.array([50 + 50 * x * documents // length for x in n.tolist()], np.int64)
        owner = np.repeat(np.arange(self.size), np.diff(ends))
        adds = weight[held] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[owner]))
        order = np.argsort(held, kind="stable")
        self.owner, self.adds, held = owner[order].astype(np.int32), adds[order], held[order]
        first = np.flatnonzero(np.diff(held, prepend=-1))
        self.span = dict(zip(held[first].tolist(), zip(first.tolist(), np.append(first[1:], len(held)).tolist(), strict=True), strict=True))
        self.most = dict(zip(held[first].tolist(), np.maximum.reduceat(self.adds, first).tolist() if len(first) else [], strict=True))
        self.bitmaps: dict[int, int] = {}

    def bitmap(self, term: int) -> int:
        """The documents that hold the term, one bit each."""
        if term not in self.bitmaps:
            if len(self.bitmaps) >= 4096:
                self.bitmaps.clear()
            here = np.zeros(self.size, bool)
            a, b = self.span[term]
            here[self.owner[a:b]] = True
            self.bitmaps[term] = int.from_bytes(np.packbits(here, bitorder="little").tobytes(), "little")
        return self.bitmaps[term]

    def documents(self, bits: int) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes((self.size + 7) // 8, "little"), np.uint8), bitorder="little"))

    def scores(self, which: np.ndarray, of: list[int]) -> np.ndarray:
        """Exact sums of these documents over these terms."""
        total = np.zeros(len(which), np.int64)
        for term in of:
            a, b = self.span[term]
            own = self.owner[a:b]
            at = np.minimum(np.searchsorted(own, which), len(own) - 1)
            total += np.where(own[at] == which, self.adds[a:b][at], 0)
        return total

    def best(self, asked: list[int], k: int, floor: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores that can be among the ``k`` best; ``floor`` is a heap of the best scores so far."""
        asked = sorted((t for t in asked if self.most.get(t, 0) > 0), key=lambda t: -self.most[t])
        most = [self.most[t] for t in asked]
        # (bound, groups made before, terms asked, documents, matched terms)
        waiting = [(-sum(most), 0, 0, (1 << self.size) - 1, ())]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        made = 0
        while waiting and waiting[0][0] < 0:
            bound, _, level, bits, matched = heapq.heappop(waiting)
            if len(floor) == k and -bound < floor[0]:
                break  # no mask left reaches the last place
            if level == len(asked) or bits.bit_count() <= FEW:
                which = self.documents(bits)
                score = self.scores(which, [*matched, *asked[level:]])
                good = score >= max(1, floor[0] if len(floor) == k else 1)
                for x in np.sort(score[good])[::-1][:k].tolist():
                    if len(floor) < k:
                        heapq.heappush(floor, x)
                    elif x > floor[0]:
                        heapq.heapreplace(floor, x)
                    else:
                        break
                found.append((which[good], score[good]))
                continue
            term = asked[level]
            there = bits & self.bitmap(term)
            for part, rest, own in ((there, bound, (*matched, term)), (bits ^ there, bound + most[level], matched)):
                if part:
                    made += 1
                    heapq.heappush(waiting, (rest, made, level + 1, part, own))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``k`` documents with the highest scores of each item: its id, ``rank`` from 1, the document's id and ``score``.

    A score is the sum of ``w * ((10^9 tf) div (1000 tf + 20 m))`` over the item's terms, each once; ``w`` falls with the
    number of documents that hold the term, ``m`` grows with the document's length. Only scores above 0
    count. Equal scores are ordered by the document's id, null first; rows alike in both are neighbours.

    Document ids are whole numbers or null. A null or empty text has no term and is no document of
    the statistics. Repeated rows are documents of their own. Very long texts are cut into terms by pieces. Rows of one item id (null too) are one
    item with the terms of all its texts; an item without terms, or without a match, gives no row. Empty tables
    give an empty result. Other columns are not read.

    The items are the stated query side: they pass through the driver in blocks of bounded size, documents do not.
    """
    spark = docs.sparkSession
    small_batches(spark)
    asked = items.groupBy(F.col(item_col).alias("item")).agg(F.collect_list(F.coalesce(F.col(item_text_col).cast("string"), F.lit(""))).alias("texts"))
    asked = written(asked.withColumn("number", F.monotonically_increasing_id()))
    results = [_ranked_block(docs, block, k, id_col, text_col) for block in blocks_of_items(asked, item_col, item_text_col)]
    schema = "number long, id long, score long, rank int"
    out = results[0] if results else spark.createDataFrame([], schema)
    for more in results[1:]:
        out = out.unionByName(more)
    named = out.join(asked.select("number", "item").hint("merge"), "number")
    return named.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _ranked_block(docs: DataFrame, block: list[tuple[int, list[bytes]]], k: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, own in block for t in own}))}
    index = index_of(docs, id_col, text_col, vocabulary)
    documents, length = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = np.zeros(len(vocabulary), np.int64)
    for r in index.select(F.explode("held").alias("term")).groupBy("term").count().collect():  # as many rows as terms in the block
        weight[r["term"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["count"] + 1)))
    asked = [(number, [vocabulary[t] for t in own]) for number, own in block]
    sent = spark.sparkContext.broadcast((asked, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = sent.value
        floors: list[list[int]] = [[] for _ in asked]
        top = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in asked]  # ids, scores, null ids

        def take(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, lists = table.column("id").chunk(0), table.column("held").chunk(0)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            tf = table.column("tf").chunk(0).flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            here = Block(table.column("n").to_numpy(), ends, lists.flatten().to_numpy(), tf, weight, documents, length)
            for j, (_, own) in enumerate(asked):
                which, score = here.best(own, k, floors[j])
                if len(which):
                    a, b, c = (np.concatenate(x) for x in zip(top[j], (ids[which], score, null[which]), strict=True))
                    order = np.lexsort([a, ~c, -b])[:k]
                    top[j] = a[order], b[order], c[order]

        held, size = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                held.append(part)
                size += len(part.column("held").flatten())
                if size >= ENTRIES:
                    take(held)
                    held, size = [], 0
        if size:
            take(held)
        count = [len(x[0]) for x in top]
        ids, scores, null = (np.concatenate([x[i] for x in top]) for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([x for x, _ in asked], np.int64), count)), pa.array(ids, mask=null.astype(bool)), pa.array(scores)], ["number", "id", "score"])

    found = index.mapInArrow(run, "number long, id long, score long")
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("id").asc_nulls_first()))
    return written(found.withColumn("rank", place).filter(F.col("rank") <= k))

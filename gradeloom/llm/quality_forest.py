"""Quality rules with an isolation forest on the rule statistics.

The statistics come from one pass over whole texts. Each tree splits its own draw of rows from the whole
table at random places; a document that few splits set apart is odd. The threshold on that oddness comes
from all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.tokens import BYTE_CODE, LOWER, SPACE, U64, Rolling, groups, mix, words
from gradeloom.plans.durable import written
from gradeloom.plans.session import small_batches

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 20
REPEAT_WORDS = 8
MOST_REPEATED_PERCENT = 30

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_marks")


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text of a group."""
    texts = len(offsets) - 1

    def by_text(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    starts, ends, owner = words(data, offsets)
    out = {"n_words": np.bincount(owner, minlength=texts)}
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    solid = ~SPACE[data]
    out["word_chars"] = by_text(solid & ((data & 0xC0) != 0x80))
    out["n_symbols"] = by_text(table[data])
    capital = LOWER[data] != data
    small = (data >= 97) & (data <= 122)
    out["n_capitals"] = by_text(capital)
    out["n_letters"] = by_text(capital | small)
    out["n_marks"] = by_text((data == 33) | (data == 63))
    # lines
    rolling = Rolling(BYTE_CODE[data])
    new = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offsets[:-1], new + 1]))
    stop = np.sort(np.concatenate([new, offsets[1:]]))
    # a newline at the end of one text and the start of the next give the same place: order by text
    line_owner = np.repeat(np.arange(texts), by_text(data == 10) + 1)
    filled = np.concatenate([[0], np.cumsum(solid)])
    has_word = filled[stop] > filled[begin]
    code = mix(rolling.of(begin, stop) ^ mix(line_owner.astype(U64) + U64(1)))
    _, first = np.unique(code, return_index=True)
    again = np.ones(len(code), bool)
    again[first] = False
    out["n_dup_lines"] = np.bincount(line_owner[again & has_word], minlength=texts)
    out["n_lines"] = np.bincount(line_owner[has_word], minlength=texts)
    # windows of words
    repeated = np.zeros(len(starts), bool)
    k = REPEAT_WORDS
    if len(starts) >= k:
        run = Rolling(rolling.of(starts, ends))
        at = np.flatnonzero(owner[: len(owner) - k + 1] == owner[k - 1 :])
        code = mix(run.of(at, at + k) ^ mix(owner[at].astype(U64) + U64(1)))
        _, inverse, number = np.unique(code, return_inverse=True, return_counts=True)
        edge = np.zeros(len(starts) + 1, np.int32)
        twice = at[number[inverse] > 1]
        edge[twice] += 1  # starts are distinct
        np.subtract.at(edge, twice + k, 1)
        repeated = np.cumsum(edge)[:-1] > 0
    out["n_repeat_words"] = np.bincount(owner[repeated], minlength=texts)
    return out


def document_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in groups(batch.column(1)):
                found = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(found[c].astype(np.int64)) for c in COUNTS]], [id_col, *COUNTS])

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS)
    out = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
    few = F.col("n_words") < LEAST_WORDS
    much = 100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    return out.withColumn("base_failed", few | much)


#: Families of statistics; each has a forest and a threshold of its own.
FAMILIES = ("signs", "repeats")


def features(columns: dict[str, np.ndarray], family: str) -> np.ndarray:
    """What the forest of a family sees: a share or a logarithm of each of its statistics."""
    c = {k: v.astype(np.float64) for k, v in columns.items()}
    n = np.maximum(c["n_words"], 1)
    if family == "signs":
        of = [np.log1p(c["n_symbols"] / n * 20), c["word_chars"] / n, c["n_capitals"] / np.maximum(c["n_letters"], 1), np.log1p(c["n_marks"] / n * 20)]
    else:
        of = [c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / n, np.log1p(c["n_words"]), np.log1p(c["n_lines"] / n * 20)]
    return np.stack(of, axis=1)


class Forest:
    """Isolation trees over the features of some rows: each has ``size`` rows of its own, as long as there are enough."""

    def __init__(self, rows: np.ndarray, trees: int, size: int, seed: int):
        rng = np.random.default_rng(seed)
        self.size = min(size, len(rows))
        self.depth = int(np.ceil(np.log2(max(self.size, 2))))
        own = len(rows) >= trees * self.size
        part = lambda k: np.arange(k * self.size, (k + 1) * self.size) if own else rng.choice(len(rows), self.size, replace=False)
        self.trees = [self.grow(rows[part(k)], rng) for k in range(trees)]

    @staticmethod
    def expected(n: np.ndarray | float) -> np.ndarray:
        """Mean path length of a random search tree of ``n`` rows."""
        n = np.asarray(n, np.float64)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    def grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        """Nodes in arrays: feature (-1: a leaf), split place, left and right child, path length of a leaf."""
        nodes: list[list] = []
        waiting = [(rows, 0, -1, 0)]
        while waiting:
            part, depth, parent, side = waiting.pop()
            if parent >= 0:
                nodes[parent][2 + side] = len(nodes)
            low, high = part.min(axis=0), part.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if depth >= self.depth or len(part) < 2 or not len(open_):
                nodes.append([-1, 0.0, 0, 0, depth + float(self.expected(len(part)))])
                continue
            f = int(rng.choice(open_))
            at = rng.uniform(low[f], high[f])
            nodes.append([f, at, 0, 0, 0.0])
            left = part[:, f] <= at
            waiting += [(part[left], depth + 1, len(nodes) - 1, 0), (part[~left], depth + 1, len(nodes) - 1, 1)]
        return tuple(np.array(x) for x in zip(*nodes, strict=True))

    def oddness(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path length / expected): near 1 for rows that few splits set apart."""
        total = np.zeros(len(rows))
        line = np.arange(len(rows))
        for feature, at, left, right, length in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth + 1):
                f = feature[node]
                go = np.where(rows[line, np.maximum(f, 0)] <= at[node], left[node], right[node])
                node = np.where(f >= 0, go, node)
            total += length[node]
        return 2.0 ** (-total / len(self.trees) / max(float(self.expected(self.size)), 1e-9))


def fit_forests(stats: DataFrame, id_col: str, trees: int = 100, size: int = 256, seed: int = 7) -> dict[str, Forest]:
    """For each family trees of ``size`` rows each, drawn from all rows that pass the base rules: those with the least hash of the id and counts."""
    passed = stats.filter("not base_failed")
    need, number = trees * size, passed.count()
    if not number:
        return {}
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), *COUNTS), F.lit(1 << 40))
    share = min(1.0, (need + 4 * need**0.5 + 16) / number)
    rows = passed.select(draw.alias("draw"), *COUNTS).filter(F.col("draw") < int(share * (1 << 40))).toArrow()
    column = {c: rows.column(c).to_numpy() for c in ("draw", *COUNTS)}
    order = np.lexsort([column[c] for c in (*COUNTS, "draw")])[:need]
    return {f: Forest(features({c: column[c][order] for c in COUNTS}, f), trees, size, seed) for f in FAMILIES}


def with_oddness(stats: DataFrame, forests: dict[str, Forest]) -> DataFrame:
    """``stats`` with a column of oddness for each family."""
    names = [f"odd_{f}" for f in FAMILIES]
    if not forests:
        return stats.withColumns({n: F.lit(0.0) for n in names})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = {c: batch.column(c).to_numpy() for c in COUNTS}
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(forests[f].oddness(features(counts, f))) for f in FAMILIES]], [*batch.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema) + "".join(f", {n} double" for n in names)
    return stats.mapInArrow(run, schema)


def best_threshold(good: np.ndarray, bad: np.ndarray, cost: float, all_good: float, all_bad: float) -> float:
    """The threshold, of those between bins, that gains most: the share of all bad rows at or above it less ``cost`` times that of good ones."""
    if not all_good or not all_bad:
        return 1.0
    above = lambda x: np.concatenate([np.cumsum(x[::-1])[::-1], [0]])
    gain = above(bad) / all_bad - cost * above(good) / all_good
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(best[len(best) // 2]) / (len(good) - 2) if gain.max() > 0 else 1.0


def calibrated(scored: DataFrame, labels: DataFrame, id_col: str, label_col: str, steps: int = 2000, cost: float = 4.0) -> dict[str, float]:
    """The threshold of each family that serves all labelled rows best; a row that one family rejects does not count for the next."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("labelled")).agg(F.max(label_col).alias("good"))
    rows = scored.filter("not base_failed").join(known.hint("merge"), F.col(id_col) == F.col("labelled"))
    limits: dict[str, float] = {}
    totals = rows.agg(F.sum(F.col("good").cast("long")).alias("good"), F.count(F.lit(1)).alias("n")).first()
    all_good = totals["good"] or 0
    for f in FAMILIES:
        left = F.lit(True)
        for g, limit in limits.items():
            left = left & (F.col(f"odd_{g}") < limit)
        bins = rows.filter(left).groupBy(F.floor(F.col(f"odd_{f}") * steps).alias("bin")).agg(F.sum(F.col("good").cast("long")).alias("good"), F.count(F.lit(1)).alias("n")).collect()
        good, bad = np.zeros(steps + 2), np.zeros(steps + 2)
        for r in bins:
            good[r["bin"]] += r["good"]
            bad[r["bin"]] += r["n"] - r["good"]
        limits[f] = best_threshold(good, bad, cost, all_good, totals["n"] - all_good)
    return limits


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row for each document: the base counts, ``base_failed``, oddness (0 to 1) and threshold of each family, and ``kept``.

    ``kept`` is false if a base rule fails, else whether the oddness of each family is under its threshold. A null or
    empty text has no words, all counts zero, and fails. Without labelled rows of both kinds the forests
    reject nothing; an id labelled twice counts as good if one label says so; null labels are left out.
    Rows of one id are judged by their own text, very long texts as a whole. An empty table gives an empty result.
    Other columns are not read.
    """
    stats = written(document_statistics(docs, id_col, text_col))
    scored = written(with_oddness(stats, fit_forests(stats, id_col)))
    limits = calibrated(scored, labels, id_col, label_col)
    kept = ~F.col("base_failed")
    for f, limit in limits.items():
        kept = kept & (F.col(f"odd_{f}") < limit)
    return scored.withColumns({f"threshold_{f}": F.lit(limit) for f, limit in limits.items()}).withColumn("kept", kept)

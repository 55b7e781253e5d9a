"""Language-model scoring with a hashed maximum-entropy model.

P(word | history) = P(class | history) * P(word | class, history). Both factors are softmaxes over sums
of weights of hashed features: n-grams and skips of the history for the class, and the same crossed with
the class for the word. The most frequent words of each class have a place of their own in its softmax;
all others share one place and divide its probability by their exact counts.

Work on Spark: (1) words of all training texts are counted; (2) every text becomes a written row of word
codes, from which all later steps read; (3) words outside the frequent ones meet their counts by a join
on the word; (4) tasks make gradient updates at every token place of their own training texts, and after
each round the changes are averaged, weighted by use, in two steps; (5) texts are scored in batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.tokens import LOWER, U64, groups, mix, signed, word_hashes, words
from gradeloom.plans.durable import written
from gradeloom.plans.session import small_batches

END = U64(0x0123456789ABCDEF)
#: Classes of words (by their last two bytes), and places in the softmax of a class; place 0 is all its other words.
CLASSES, PLACES = 32, 32
#: At most so many words and their counts are in every task. The others meet their counts by a join; hardly one makes up more than 1/FREQUENT of the corpus.
FREQUENT = 1 << 18
#: Rows of weights; a feature is hashed to one.
BUCKETS = 1 << 14
#: Parts in which changes of weights travel.
BLOCKS = 64
RARE = np.uint32(1 << 31)
BATCH = 8192


def level_of(count: str = "c") -> Column:
    """Words are ranked by 64 levels to a doubling of their counts."""
    return F.floor(F.log2(count) * 64)


def in_training(id_col: str, folds: int, held: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds != held


def tokenize(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of all tokens of some texts, A-Z made small, each text with its end; and the edges between texts.

    A name is a 59-bit hash of the word with its class in the lowest bits.
    """
    data = LOWER[data]
    start, end, owner = words(data, offsets)
    edge = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(offsets) - 1) + 1)])
    name = np.full(edge[-1], END)
    if len(start):
        last = data[end - 1].astype(U64)
        before = np.where(end - start > 1, data[np.maximum(end - 2, 0)], 0).astype(U64)
        group = mix(last << U64(8) | before) % U64(CLASSES)
        name[np.arange(len(start)) + owner] = word_hashes(data, start, end) // U64(CLASSES) * U64(CLASSES) + group
    return name, edge


def count_words(texts: DataFrame) -> DataFrame:
    """``h`` (the name of a word) and ``c`` (its uses) over all rows of ``texts``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in groups(batch.column("text"), 1 << 20):
                name, number = np.unique(tokenize(data, offsets)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(name)), pa.array(number)], ["h", "n"])

    return texts.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("c"))


@dataclass
class Lexicon:
    """The frequent words in order of their names, and what scoring needs to know of each and of the classes."""

    keys: np.ndarray
    group: np.ndarray
    place: np.ndarray
    count: np.ndarray
    mass: np.ndarray
    types: np.ndarray
    #: Uses of each place of each class.
    table: np.ndarray
    #: The level (see ``level_of``) from which words are frequent.
    level: int

    @classmethod
    def of(cls, counted: DataFrame) -> Lexicon:
        """From the counts of all words: those above the lowest level that leaves ``FREQUENT`` or fewer."""
        sizes = sorted(counted.groupBy(level_of().alias("level")).count().collect(), reverse=True)
        total, level = 0, 1 << 20
        for r in sizes:
            total += r["count"]
            if total > FREQUENT:
                break
            level = r["level"]
        top = counted.filter(level_of() >= level).toArrow()
        keys, count = top.column("h").to_numpy().view(U64), top.column("c").to_numpy()
        ranked = np.lexsort([keys, -count])
        group = (keys % U64(CLASSES)).astype(np.int64)
        by_class = ranked[np.argsort(group[ranked], kind="stable")]
        first = np.searchsorted(group[by_class], np.arange(CLASSES))
        place = np.empty(len(keys), np.int64)
        place[by_class] = np.arange(len(keys)) - first[group[by_class]] + 1
        place[place >= PLACES] = 0
        mass, types = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for r in counted.groupBy(F.pmod("h", F.lit(CLASSES)).alias("k")).agg(F.sum("c").alias("m"), F.count(F.lit(1)).alias("t")).collect():
            mass[r["k"]], types[r["k"]] = r["m"], r["t"]
        table = np.zeros((CLASSES, PLACES), np.int64)
        np.add.at(table, (group, place), count)
        table[:, 0] += mass - table.sum(axis=1)
        order = np.argsort(keys)
        return cls(keys[order], group[order], place[order], count[order], mass, types, table, level)

    def encode(self, name: np.ndarray) -> np.ndarray:
        """A number for each token: the rank of a frequent word, else its class and a part of its hash."""
        if not len(self.keys):
            return self.rare(name)
        at = np.minimum(np.searchsorted(self.keys, name), len(self.keys) - 1)
        return np.where(self.keys[at] == name, at.astype(np.uint32), self.rare(name))

    @staticmethod
    def rare(name: np.ndarray) -> np.ndarray:
        return (name % U64(1 << 31)).astype(np.uint32) | RARE

    def of_codes(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, place in its softmax, and count (-1 if rare) of tokens."""
        frequent = code < RARE
        at = np.where(frequent, code, 0)
        if not len(self.keys):
            return (code % CLASSES).astype(np.int64), np.zeros(len(code), np.int64), np.full(len(code), -1)
        return np.where(frequent, self.group[at], code % CLASSES), np.where(frequent, self.place[at], 0), np.where(frequent, self.count[at], -1)


def histories(code: np.ndarray, group: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of every token, ``[feature, token]``: those of its class and those of its word.

    ``at`` is the token's place in its text. The class sees the word before, the words two, three and
    four before (skips), the two before together, and the three classes before; the word sees the word
    before, the two classes before and the word two before, each with the class.
    """

    def back(values: np.ndarray, k: int) -> np.ndarray:
        out = np.ones(len(values), U64)
        out[k:] = values[:-k]
        out[at < k] = U64(1)
        return out

    word, kind = code.astype(U64) + U64(2), group.astype(U64) + U64(2)
    w1, w2, k1, k2 = back(word, 1), back(word, 2), back(kind, 1), back(kind, 2)
    two = (k1 << U64(8)) | k2
    of_class = [w1, w2, back(word, 3), back(word, 4), w1 * U64(0x9E3779B97F4A7C15) ^ w2, (two << U64(8)) | back(kind, 3)]
    own = (kind << U64(40)) * U64(0xD6E8FEB86659FD93)
    of_word = [own ^ w1, own ^ two, own ^ (w2 << U64(1))]
    shift = U64(64 - (BUCKETS.bit_length() - 1))
    hashed = lambda parts: np.stack([(mix(x + U64(0x5851F42D4C957F2D * (k + 1) % 2**64)) >> shift).astype(np.uint16) for k, x in enumerate(parts)])
    return hashed(of_class), hashed(of_word)


def line_sums(lines: np.ndarray, which: np.ndarray, first: np.ndarray, number: np.ndarray, few: int = 12) -> np.ndarray:
    """Sums of neighbouring groups of lines: group ``k`` is ``which[first[k] : first[k] + number[k]]``."""
    total, more = np.take(lines, which[first], axis=0), np.arange(len(first))
    for k in range(1, few):
        more = more[number[more] > k]
        total[more] += np.take(lines, which[first[more] + k], axis=0)
    large = number > few
    if large.any():
        edge = np.concatenate([[0], np.cumsum(number[large])[:-1]])
        total[large] = np.add.reduceat(np.take(lines, which[np.repeat(large, number)], axis=0), edge, axis=0)
    return total


class Model:
    """Two tables of weights ``[bucket, choice]`` with a base for each choice: the logarithm of its share."""

    def __init__(self, table: np.ndarray):
        log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True)).astype(np.float32)
        self.bases = [log(table.sum(axis=1, keepdims=True).T + 0.5), log(table + 0.5)]
        self.weights = [np.zeros((BUCKETS, CLASSES), np.float32), np.zeros((BUCKETS, PLACES), np.float32)]

    def shares(self, k: int, buckets: np.ndarray, base: np.ndarray) -> np.ndarray:
        """The probability of every choice, a line for each token."""
        x = np.take(self.weights[k], buckets[0], axis=0)
        for b in buckets[1:]:
            x += np.take(self.weights[k], b, axis=0)
        x += self.bases[k][base]
        x -= x.max(axis=1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(axis=1, keepdims=True)
        return x

    def gradient(self, k: int, buckets: np.ndarray, base: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the negative log-likelihood: the buckets in use, their uses and their gradients."""
        g = self.shares(k, buckets, base)
        g[np.arange(len(chosen)), chosen] -= 1
        flat = buckets.ravel()
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        number = np.diff(first, append=len(flat))
        return ordered[first], number, line_sums(g, order % len(chosen), first, number)

    def log_share(self, code_features: tuple[np.ndarray, np.ndarray], group: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Logarithm of the probability of each token's class and place."""
        out = np.empty(len(group))
        for x in range(0, len(group), BATCH):
            at = slice(x, x + BATCH)
            line = np.arange(len(group[at]))
            kinds = self.shares(0, code_features[0][:, at], np.zeros(len(line), np.int64))
            places = self.shares(1, code_features[1][:, at], group[at])
            out[at] = np.log(np.maximum(kinds[line, group[at]], 1e-30)) + np.log(np.maximum(places[line, place[at]], 1e-30))
        return out


def positions(edge: np.ndarray) -> np.ndarray:
    return np.arange(edge[-1]) - np.repeat(edge[:-1], np.diff(edge))


def coded(column: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices ``(first, last, codes, edges)`` of a column of codes."""
    for a, b, data, offsets in groups(column, limit):
        yield a, b, np.frombuffer(data.tobytes(), np.uint32), offsets // 4


def train(texts: DataFrame, lexicon: Lexicon, rounds: int, rate: float) -> Model:
    """The model after ``rounds`` rounds: each takes its part of the texts, and all parts together are all texts.

    A task steps through its tokens in batches, with a pace for each row of weights that slows with its
    gradients. A row's changes are averaged over the tasks by how often each used it.
    """
    spark = texts.sparkSession
    model = Model(lexicon.table)
    each = BUCKETS // BLOCKS
    schema = "block long, part long, uses binary, change binary"
    width = CLASSES + PLACES

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        part = 0
        for batch in batches:
            for block, part, uses, change in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                old = total.setdefault(block, [np.zeros((each, 2)), np.zeros((each, width))])
                old[0] += np.frombuffer(uses, np.float64).reshape(each, 2)
                old[1] += np.frombuffer(change, np.float32).reshape(each, width)
        for block, (uses, change) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part]), pa.array([uses.tobytes()], pa.binary()), pa.array([change.astype(np.float32).tobytes()], pa.binary())], ["block", "part", "uses", "change"])

    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((lexicon, model))

        def update(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            words_, start = sent.value
            here = Model(words_.table)
            here.weights = [w.copy() for w in start.weights]
            square = [np.full(BUCKETS, 1e-1, np.float32) for _ in here.weights]
            uses = np.zeros((BUCKETS, 2))
            for batch in batches:
                for _, _, code, edge in coded(batch.column("codes")):
                    group, place, _ = words_.of_codes(code)
                    features = histories(code, group, positions(edge))
                    for x in range(0, len(code), BATCH):
                        at = slice(x, x + BATCH)
                        for k, base, chosen in ((0, np.zeros(len(code[at]), np.int64), group[at]), (1, group[at], place[at])):
                            rows, number, total = here.gradient(k, features[k][:, at], base, chosen)
                            square[k][rows] += np.einsum("ij,ij->i", total, total)
                            here.weights[k][rows] -= (rate / np.sqrt(square[k][rows]))[:, None] * total
                            uses[rows, k] += number
            if uses.any():
                for k in range(BLOCKS):
                    part = slice(k * each, (k + 1) * each)
                    change = np.concatenate([(a[part] - b[part]) * uses[part, i : i + 1] for i, (a, b) in enumerate(zip(here.weights, start.weights, strict=True))], axis=1).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([0]), pa.array([uses[part].tobytes()], pa.binary()), pa.array([change.tobytes()], pa.binary())], ["block", "part", "uses", "change"])

        now = texts.filter(F.pmod(F.xxhash64("row"), F.lit(rounds)) == turn) if rounds > 1 else texts
        changes = now.select("codes").mapInArrow(update, schema).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(16)).cast("long"))
        changes = changes.repartition("block", "part").mapInArrow(summed, schema).repartition("block").mapInArrow(summed, schema)
        for r in changes.collect():  # one row for each block
            part = slice(r["block"] * each, (r["block"] + 1) * each)
            uses = np.maximum(np.frombuffer(r["uses"], np.float64).reshape(each, 2), 1e-9)
            change = np.frombuffer(r["change"], np.float32).reshape(each, width)
            model.weights[0][part] += (change[:, :CLASSES] / uses[:, :1]).astype(np.float32)
            model.weights[1][part] += (change[:, CLASSES:] / uses[:, 1:]).astype(np.float32)
        sent.unpersist()
    return model


def encoded(docs: DataFrame, lexicon: Lexicon, id_col: str, text_col: str, folds: int, held: int) -> DataFrame:
    """A written row for each row of ``docs``: a number ``row``, ``id``, ``train``, the codes of its tokens, and its rare words with their uses."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in groups(batch.column("text"), 1 << 20):
                name, edge = tokenize(data, offsets)
                code = sent.value.encode(name)
                owner = np.repeat(np.arange(b - a), np.diff(edge))
                rare = code >= RARE
                h, own = name[rare], owner[rare]
                order = np.lexsort([h, own])
                h, own = h[order], own[order]
                first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])])) if len(h) else np.zeros(0, np.int64)
                cut = pa.array(np.searchsorted(own[first], np.arange(b - a + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(a, b - a) for c in ("id", "train")],
                        pa.array([code[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(cut, pa.array(signed(h[first]))),
                        pa.ListArray.from_arrays(cut, pa.array(np.diff(first, append=len(h)))),
                    ],
                    ["id", "train", "codes", "rare", "uses"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("train", in_training("id", folds, held))
    rows = rows.mapInArrow(run, f"id {kind}, train boolean, codes binary, rare array<long>, uses array<long>")
    # numbers are given once and written; nothing is computed from them before
    return written(rows.withColumn("row", F.monotonically_increasing_id()))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, rounds: int = 2, rate: float = 0.5) -> DataFrame:
    """One row for each document: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Learns from rows whose crc32(id as text) mod ``folds`` is not ``held``; a null id counts as the empty
    text. Tokens are words with A-Z made small, then one end; a null or empty text is its end alone. Both
    scores are log10 of the whole text's probability: ``base_score`` by word counts with one added,
    ``score`` by the model. A word that training never saw counts as the one unseen word of its class.
    Very long texts are scored whole, a batch of places at a time. Ids of any type do, also several rows
    of one id. Repeated rows count one by one and score alike. Without training rows the base score
    is 0. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = written(count_words(texts.filter(in_training("id", folds, held))))
    lexicon = Lexicon.of(counted)
    rows = encoded(docs, lexicon, id_col, text_col, folds, held)
    uses = rows.filter(F.size("rare") > 0).select("row", F.inline(F.arrays_zip(F.col("rare").alias("h"), F.col("uses").alias("n"))))
    found = uses.join(counted.filter(level_of() < lexicon.level).hint("merge"), "h", "left")
    sums = found.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("s"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"))
    model = train(rows.filter("train"), lexicon, rounds, rate)
    sent = spark.sparkContext.broadcast((lexicon, model))
    kind_of = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, fitted = sent.value
        others = known.types - np.bincount(known.group[known.place > 0], minlength=CLASSES)
        whole = np.log10(known.table[:, 0] + others + 1.0)
        for batch in batches:
            for a, b, code, edge in coded(batch.column("codes")):
                group, place, count = known.of_codes(code)
                logs = np.where(count > 0, np.log10(np.maximum(count, 0) + 1.0), 0.0)
                share = fitted.log_share(histories(code, group, positions(edge)), group, place) / np.log(10.0)
                share += np.where(place == 0, logs - whole[group], 0.0)
                total = lambda x: np.add.reduceat(x, edge[:-1])  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(a, b - a) for c in ("row", "id", "train")], pa.array(np.diff(edge)), pa.array(total((count > 0).astype(np.int64))), pa.array(total(logs)), pa.array(total(share))],
                    ["row", "id", "train", "n_tokens", "known", "logs", "shares"],
                )

    scored = rows.select("row", "id", "train", "codes").mapInArrow(score, f"row long, id {kind_of}, train boolean, n_tokens long, known long, logs double, shares double")
    out = written(scored).join(sums.hint("merge"), "row", "left")
    s, k = F.coalesce("s", F.lit(0.0)), F.coalesce("k", F.lit(0))
    return out.select(
        F.col("id").alias(id_col),
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("known") + k).cast("long").alias("n_known"),
        F.lit(int(lexicon.mass.sum())).cast("long").alias("train_tokens"),
        (F.col("logs") + s - F.col("n_tokens") * float(np.log10(lexicon.mass.sum() + lexicon.types.sum() + 1.0))).alias("base_score"),
        (F.col("shares") + s).alias("score"),
    )

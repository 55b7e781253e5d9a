"""Exact join of texts whose sets of word shingles have a high Jaccard similarity, by several global orders.

Two sets of the similarity share one of the first shingles of each in any common order, so a pair that shares none in one of
several orders is no pair. All orders put shingles of frequent cells last and differ in how they order shingles of one cell
level. The first order deals the sets into buckets, one for each of their first shingles; a pair that meets there
must be able to share enough at and after that shingle, and must share one of the first shingles in each of the other orders,
before the sets themselves are compared.

What is wanted is which texts hang together, so members of a bucket that do already need not meet. In each bucket all
members meet the one with the fewest rarer shingles, its hub: that is the text closest to what the members have in common. While many
are left apart from their hubs, buckets choose a further hub among these. Then whoever is still
apart meets every other member that the filters leave, among them short sketches of both sets inside the join. Buckets of the same members are one
bucket. Of candidates first whole sketches meet, which drop pairs that surely differ in too many shingles, then the sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.tokens import LOWER, U64, Rolling, groups, mix, signed, word_hashes, words
from gradeloom.operators.components import connected_components
from gradeloom.operators.hot_keys import HOT_KEYS, look_up
from gradeloom.plans.durable import drop_written, is_small, settled, written
from gradeloom.plans.session import small_batches

#: Cells in which uses of shingles are counted; shingles of cells with far more uses than most come last in every order.
CELLS = 1 << 21
#: Seeds of the orders among shingles of one level; the first order deals the buckets.
ORDERS = (U64(0), U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB))
#: Bits of the least sketch of a set, to which larger ones are folded where members of a bucket meet, and its columns there.
SKETCH = 1024
FOLDED = [f"p{k}" for k in range(SKETCH // 64)]
#: Bits of the map of texts whose sets are compared.
SLOTS = 1 << 24
#: Bytes of texts that a task looks at together.
PORTION = 1 << 19
#: Buckets choose a further hub while those apart from theirs would make more meetings than so many times the rows of these buckets, and a round helps.
FEW_MEETINGS, HUB_ROUNDS = 64, 8
#: Values of frequent keys that are larger than this many bytes are not broadcast but shuffled under so many salted keys.
WIDE, SALTS = 1 << 15, 16


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes of the word shingles of each text in order, and the edges between texts.

    A-Z are made small; a text of fewer words than ``size`` is one shingle and one without words has none.
    """
    small = LOWER[data]
    start, end, owner = words(small, offsets)
    count = np.bincount(owner, minlength=len(offsets) - 1)
    word = np.concatenate([[0], np.cumsum(count)])
    number = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    edge = np.concatenate([[0], np.cumsum(number)])
    own = np.repeat(np.arange(len(count)), number)
    first = word[own] + np.arange(edge[-1]) - edge[own]
    value = Rolling(word_hashes(small, start, end)).of(first, np.minimum(first + size, word[own + 1]))
    value = value[np.lexsort([value, own])]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    return value[new], np.searchsorted(own[new], np.arange(len(count) + 1))


def set_names(value: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A hash of each set of shingles; sets alike have one name."""
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(value ^ U64(0x5851F42D4C957F2D)), dtype=U64)])
    return mix(total[edge[1:]] - total[edge[:-1]] + np.diff(edge).astype(U64))


def sketches(value: np.ndarray, edge: np.ndarray) -> list[bytes]:
    """Parities of the shingles dealt to bits, over twice as many bits as shingles: two sketches differ in no more bits than their sets in members."""
    place, out = mix(value ^ U64(0x8BB84B93962EACC9)), []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        bits = max(SKETCH, 1 << (2 * (b - a)).bit_length())
        parity = np.bincount((place[a:b] & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(parity.astype(np.uint8)).tobytes())
    return out


def sketch_distance(one: bytes, two: bytes) -> int:
    """Bits in which two sketches differ, the larger one folded to the smaller one's length."""
    x, y = np.frombuffer(one, U64), np.frombuffer(two, U64)
    short = min(len(x), len(y))
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, short), axis=0) ^ np.bitwise_xor.reduce(y.reshape(-1, short), axis=0)).sum())


def needed(number: np.ndarray, similarity: float) -> np.ndarray:
    """The least whole number that is ``similarity`` times ``number`` or more."""
    return np.ceil(number * similarity - 1e-9).astype(np.int64)


def cell_of(value: np.ndarray, cells: int) -> np.ndarray:
    return (mix(value) % U64(cells)).astype(np.int64)


def levels_of(uses: np.ndarray) -> np.ndarray:
    """0 for most cells; more, by eighths of a power of two, for those with far more uses than the mean."""
    mean = max(float(uses.mean()), 1e-9)
    heavy = uses > mean + 5 * mean**0.5 + 5
    return np.where(heavy, np.clip(np.ceil(8 * np.log2(np.maximum(uses, 1) / mean)), 1, 255), 0).astype(np.uint8)


def prefixes(value: np.ndarray, edge: np.ndarray, similarity: float, levels: np.ndarray, seed: np.uint64 = ORDERS[0]) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of each set in an order (by the levels of their cells, then by a seeded hash), and the edges between sets.

    Two sets of this similarity share ``similarity`` times the larger one's size or more, so the first
    shingle they share is among the others' number and one of each. Portions have under 65,536 texts.
    """
    number = np.diff(edge)
    own = np.repeat(np.arange(len(number)), number)
    key = (own.astype(U64) << U64(48)) | (levels[cell_of(value, len(levels))].astype(U64) << U64(40)) | (mix(value ^ seed) >> U64(24))
    value = value[np.argsort(key, kind="stable")]  # ties stay in the order of their hashes
    length = np.where(number > 0, number - needed(number, similarity) + 1, 0)
    return value[np.arange(len(value)) - edge[own] < length[own]], np.concatenate([[0], np.cumsum(length)])


def levels_of_cells(texts: DataFrame, size: int) -> np.ndarray:
    """The levels of all cells, from all shingles of all texts, one for each text. A task counts up to 255 in a cell, which is enough for an order."""
    cells, each = CELLS, CELLS // 64
    schema = "block long, part long, uses binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int32)
        for batch in batches:
            for _, _, data, offsets in groups(batch.column("text"), PORTION):
                np.add.at(total, cell_of(shingle_sets(data, offsets, size)[0], cells), 1)
        if total.any():
            for k in range(64):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([0]), pa.array([np.minimum(total[k * each : (k + 1) * each], 255).astype(np.uint8).tobytes()], pa.binary())], ["block", "part", "uses"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, _, uses in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[block] = total.get(block, 0) + np.frombuffer(uses, np.uint8 if len(uses) == each else np.float32).astype(np.float32)
        for block, uses in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([0]), pa.array([uses.astype(np.float32).tobytes()], pa.binary())], ["block", "part", "uses"])

    counted = texts.select("text").mapInArrow(count, schema).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(16)).cast("long"))
    uses = np.zeros(cells, np.float32)
    for r in counted.repartition("block", "part").mapInArrow(add, schema).repartition("block").mapInArrow(add, schema).collect():  # 64 rows
        uses[r["block"] * each : (r["block"] + 1) * each] = np.frombuffer(r["uses"], np.float32)
    return levels_of(uses)


def with_hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``h, at, fp`` in this order: those of an ``h`` with two or more, once each, with its first row as ``hub, hub_at``.

    Buckets of any size pass through in portions; what is carried over is one row.
    """
    names = ["h", "at", "fp", "hub_at", "hub"]
    held, open_ = np.zeros((3, 0), np.int64), None  # a row that is alone so far; or the first and the latest row of a bucket under way
    for batch in batches:
        rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
        out = []
        if open_ is not None:
            first, latest = open_
            other = np.flatnonzero(rows[0] != first[0])
            same = int(other[0]) if len(other) else rows.shape[1]
            part = np.concatenate([latest[:, None], rows[:, :same]], axis=1)
            part = part[:, 1:][:, (np.diff(part[1]) != 0) | (np.diff(part[2]) != 0)]
            out.append(np.concatenate([part, np.repeat(first[1:, None], part.shape[1], axis=1)]))
            open_ = (first, part[:, -1] if part.shape[1] else latest)
            rows = rows[:, same:]
        if rows.shape[1]:
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
            rows = rows[:, new]
            begin = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
            number = np.diff(begin, append=rows.shape[1])
            several = np.repeat(number > 1, number)
            out.append(np.concatenate([rows, np.repeat(rows[1:, begin], number, axis=1)])[:, several])
            alone = number[-1] == 1
            held = rows[:, -1:] if alone else rows[:, :0]
            open_ = None if alone else (rows[:, begin[-1]], rows[:, -1])
        else:
            held = rows
        done = np.concatenate(out, axis=1) if out else np.zeros((5, 0), np.int64)
        if done.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in done], names)


def keyed(name: Column, text: Column) -> list[Column]:
    """``doc`` and ``tag``: 128 bits of hashes of a row's id and text. Rows alike in both are one."""
    parts = name.cast("string"), F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(F.lit(1), *parts).alias("doc"), F.xxhash64(F.lit(2), *parts[::-1]).alias("tag")]


def place_of(at: Column | str) -> Column:
    return F.shiftright(at, 32)


def size_of(at: Column | str) -> Column:
    return (F.col(at) if isinstance(at, str) else at).bitwiseAND((1 << 32) - 1)


def shared_at_least(sizes: Column, similarity: float) -> Column:
    """Shingles that two sets of the similarity have in common, by the sum of their sizes."""
    return F.ceil(sizes * F.lit(similarity / (1 + similarity)) - F.lit(1e-9))


def can_share(one: str, two: str, similarity: float) -> Column:
    """Whether two sets that meet at a shingle of these places can be of the similarity if that is the first one they share.

    It is for one of the buckets that they meet in, so no pair is lost.
    """
    n, m = size_of(one), size_of(two)
    least = lambda x: F.ceil(x * F.lit(similarity) - F.lit(1e-9))
    both = shared_at_least(n + m, similarity)
    return (F.least(n - place_of(one), m - place_of(two)) >= both) & (least(F.greatest(n, m)) <= F.least(n, m))


def ordered(one: str, two: str) -> list[Column]:
    return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]


def by_size(table: DataFrame, small: bool) -> DataFrame:
    """A table under the hint to send it to all tasks, if its size was found small, or else to shuffle and merge."""
    return F.broadcast(table) if small else table.hint("merge")


def sets_meeting(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """``pairs`` with ``value`` of both ends. An end with many pairs is met where they lie if its value is small, else under salted keys."""
    few = is_small(pairs)
    for end in ("a", "b"):
        uses = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("_n"))
        side = written(by_size(uses, few).join(table.select(F.col("fp").alias(end), F.col(value).alias(f"{end}_{value}")), end))
        if is_small(side):
            met = pairs.join(F.broadcast(side.drop("_n")), end)
            pairs = written(met) if end == "a" else met
            continue
        number = pairs.count()
        size = F.octet_length(F.col(f"{end}_{value}") if value == "set" else F.col(f"{end}_{value}.sketch"))
        wide = (F.col("_n") > max(256, number // HOT_KEYS)) & (size > WIDE)
        large = written(side.filter(wide).drop("_n"))
        met = look_up(pairs, side.filter(~wide), end, number)
        if not large.isEmpty():
            salted = large.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            own = pairs.withColumn("_salt", F.pmod(F.xxhash64("a", "b"), F.lit(SALTS)).cast("int"))
            met = met.unionByName(own.join(salted.hint("merge"), [end, "_salt"]).drop("_salt").select(*met.columns))
        pairs = written(met) if end == "a" else met
    return pairs


class Join:
    """The tables of one join and the steps over them. ``code`` gives each set a number of 64 bits, which the table of sets then has."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int, similarity: float, code: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
        self.spark, self.size, self.similarity = docs.sparkSession, size, similarity
        small_batches(self.spark)
        kind = docs.schema[id_col].dataType.simpleString()
        self.texts = docs.select(*keyed(F.col(id_col), F.col(text_col)), F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        # which shingles come last decides how many meet, not what is found
        sent = self.levels = self.spark.sparkContext.broadcast(levels_of_cells(self.texts, size))

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                for a, b, data, offsets in groups(batch.column("text"), PORTION):
                    value, edge = shingle_sets(data, offsets, size)
                    first, cut = prefixes(value, edge, similarity, sent.value)
                    fp = signed(set_names(value, edge))
                    # of sets alike in one task the first one has the shingles
                    new = np.array([not (x in seen or seen.add(x)) for x in fp.tolist()], bool)
                    lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(signed(first)))
                    take = pa.array(np.where(new, np.arange(b - a), -1), mask=~new)
                    codes = [] if code is None else [pa.array(signed(code(value, edge)))]
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in ("doc", "tag", "id")], pa.array(fp), pa.array(np.diff(edge)), lists.take(take), pa.array(sketches(value, edge), pa.binary()).take(take), *codes], ["doc", "tag", "id", "fp", "size", "first", "sketch", *coded])

        coded = [] if code is None else ["code"]
        wide = written(self.texts.mapInArrow(mark, f"doc long, tag long, id {kind}, fp long, size long, first array<long>, sketch binary{''.join(f', {c} long' for c in coded)}"))
        nodes = wide.groupBy("fp").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("smallest"), F.min(F.struct("doc", "tag")).alias("text"), F.first("size").alias("size"), F.first("sketch", ignorenulls=True).alias("sketch"), *[F.first(c).alias(c) for c in coded])
        self.nodes = written(nodes)
        self.members = self.bucket_members(wide)
        self.marked = written(wide.select("doc", "tag", "id", "fp", "size"))
        drop_written(wide)
        self.rows, self.sets = self.nodes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.lit(1))).first()

    def bucket_members(self, wide: DataFrame) -> DataFrame:
        """Members ``h, at, fp`` of buckets of two or more sets, with their hub. ``at`` packs the shingle's place in the set and the set's size."""
        members = wide.filter(F.size("first") > 0).select("fp", "size", F.posexplode("first").alias("place", "h"))
        rows = members.select("h", (F.shiftleft(F.col("place").cast("long"), 32) + F.col("size")).alias("at"), "fp")
        schema = "h long, at long, fp long, hub_at long, hub long"
        with_first = lambda table: table.repartition("h").sortWithinPartitions("h", "at", "fp").mapInArrow(with_hubs, schema)

        def make() -> DataFrame:
            raw = written(with_first(rows).select("h", "at", "fp"))
            mark = lambda k: F.bit_xor(F.xxhash64(F.lit(k), "fp"))
            alike = raw.groupBy("h").agg(F.xxhash64(F.count(F.lit(1)), mark(1), mark(2)).alias("g"))
            # a member's least place holds for all of them: a pair that can share enough in one bucket can so here
            return with_first(raw.join(alike.hint("merge"), "h").groupBy("g", "fp").agg(F.min("at").alias("at")).select(F.col("g").alias("h"), "at", "fp"))

        return settled(self.spark, make)

    def sets_of(self, pairs: DataFrame) -> DataFrame:
        """``fp`` and ``set`` of all texts that pairs name; a bitmap of fixed size leaves out most others before the shuffle.

        A set is 32 bits of each of its first shingles in the further orders, then the shingles themselves.
        """
        slot, size, similarity, levels = F.pmod(F.xxhash64("doc", "tag"), F.lit(SLOTS)), self.size, self.similarity, self.levels
        named = written(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().transform(by_size, is_small(pairs)).join(self.nodes.select("fp", "text.*"), "fp"))
        slots = np.zeros(SLOTS // 8, np.uint8)
        for r in named.groupBy(F.floor(slot / 32768).alias("part")).agg(F.bitmap_construct_agg(slot % 32768).alias("bits")).collect():  # 2 MB at most
            slots[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
        marks = self.spark.sparkContext.broadcast(slots)

        def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column("slot").to_numpy()
                batch = batch.filter(pa.array(marks.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1))
                for a, b, data, offsets in groups(batch.column("text"), PORTION):
                    value, edge = shingle_sets(data, offsets, size)
                    firsts = [prefixes(value, edge, similarity, levels.value, seed) for seed in ORDERS[1:]]
                    bits = [f.astype(np.uint32) for f, _ in firsts]
                    cut = firsts[0][1]
                    sets = pa.array([b"".join([*(f[c:d].tobytes() for f in bits), value[x:y].tobytes()]) for c, d, x, y in zip(cut[:-1], cut[1:], edge[:-1], edge[1:], strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column("doc").slice(a, b - a), batch.column("tag").slice(a, b - a), sets], ["doc", "tag", "set"])

        sets = self.texts.drop("id").withColumn("slot", slot).mapInArrow(full, "doc long, tag long, set binary")
        return written(sets.join(by_size(named, is_small(named)), ["doc", "tag"]).select("fp", "set").dropDuplicates(["fp"]))

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs that share first shingles in all orders and are of the similarity."""

        def not_far() -> DataFrame:
            return sets_meeting(written(pairs.distinct()), self.nodes.withColumn("sketched", F.struct("sketch", "size")), "sketched").mapInArrow(not_far_apart(self.similarity), "a long, b long")

        def verified() -> DataFrame:
            return sets_meeting(near, self.sets_of(near), "set").mapInArrow(of_similarity(self.similarity), "a long, b long")

        near = settled(self.spark, not_far)
        return settled(self.spark, verified)


def not_far_apart(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs whose sketches differ in no more bits than sets of the similarity may in members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (one, n), (two, m) = ((batch.column(c).field("sketch"), batch.column(c).field("size").to_numpy()) for c in ("a_sketched", "b_sketched"))
            apart = np.array([sketch_distance(x.as_buffer(), y.as_buffer()) for x, y in zip(one, two, strict=True)], np.int64)
            shared = needed(n + m, similarity / (1 + similarity))
            near = pa.array((apart <= n + m - 2 * shared) & (shared <= np.minimum(n, m)))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(near) for c in ("a", "b")], ["a", "b"])

    return run


def opened_set(packed: pa.Scalar, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """First shingles by order (32 bits of each), and the shingles of a set from ``sets_of``."""
    data, orders = packed.as_buffer(), len(ORDERS) - 1
    # n shingles and n - needed(n) + 1 first ones for each further order: one n fits
    about = int(data.size / (8 + 4 * orders * (1 - similarity)))
    n = next(n for n in range(max(0, about - 4), about + 4) if 8 * n + 4 * orders * (n - int(needed(np.int64(n), similarity)) + 1) == data.size)
    return np.frombuffer(data, np.uint32, count=data.size // 4 - 2 * n).reshape(orders, -1), np.frombuffer(data, np.uint8)[data.size - 8 * n :].copy().view(U64)


def of_similarity(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs whose first shingles meet in each of the further orders, and whose sets are of the similarity."""

    def close(one: pa.Scalar, two: pa.Scalar) -> bool:
        (f, x), (g, y) = opened_set(one, similarity), opened_set(two, similarity)
        if not all(len(np.intersect1d(a, b)) for a, b in zip(f, g, strict=True)):
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return bool(both >= needed(np.int64(len(x) + len(y) - both), similarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = pa.array([close(one, two) for one, two in zip(batch.column("a_set"), batch.column("b_set"), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(near) for c in ("a", "b")], ["a", "b"])

    return run


def still_apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets with several groups, with their ``root`` and that of the bucket's hub."""

    def make() -> DataFrame:
        rooted = written(members.join(by_size(roots, is_small(roots)), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
        several = rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min_by("root", F.struct("at", "fp")).alias("hub_root")).filter("low <> high")
        several = written(several.select("h", "hub_root"))
        return rooted.join(by_size(several, is_small(several)), "h")

    return settled(members.sparkSession, make)


def with_folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with ``SKETCH`` bits, as numbers, in place of their ``sketch``."""
    for batch in batches:
        folded = [np.bitwise_xor.reduce(np.frombuffer(x.as_buffer(), U64).reshape(-1, len(FOLDED)), axis=0) for x in batch.column("sketch")]
        table = np.array(folded, U64).reshape(-1, len(FOLDED))
        rest = [c for c in batch.schema.names if c != "sketch"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *[pa.array(signed(np.ascontiguousarray(c))) for c in table.T]], [*rest, *FOLDED])


def joined_roots(join: Join, known: DataFrame | None = None) -> DataFrame:
    """``fp`` and ``root`` of all sets that links join with another. Sets that ``known`` links ``a, b`` of the similarity join need not meet."""
    s = join.similarity
    roots_of = lambda links: settled(join.spark, lambda: connected_components(links).select(F.col("node").alias("fp"), "root"))
    buckets = join.members
    apart = buckets.filter("fp <> hub") if known is None else still_apart(buckets, roots_of(known)).filter("root <> hub_root")
    links = join.links(apart.filter(can_share("at", "hub_at", s)).select(*ordered("fp", "hub")))
    links = links if known is None else links.unionByName(known)
    roots = roots_of(links)

    left, before = still_apart(buckets.select("h", "at", "fp"), roots), None
    for turn in range(HUB_ROUNDS):
        rows, meetings = left.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("root") != F.col("hub_root")).alias("apart")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("apart")), F.lit(0))).first()
        if rows == 0:
            return roots
        if meetings <= FEW_MEETINGS * rows or (before is not None and meetings > 0.8 * before):
            break
        before = meetings
        further = F.struct(F.col("fp").alias("hub"), F.col("at").alias("hub_at"), F.col("root").alias("its_root"))
        hubs = left.filter("root <> hub_root").groupBy("h").agg(F.min_by(further, F.struct(place_of("at"), F.xxhash64(F.lit(turn), "h", "fp"))).alias("further"))
        met = left.join(hubs.select("h", "further.*").hint("merge"), "h").filter("root <> its_root").filter(can_share("at", "hub_at", s))
        links = links.unionByName(join.links(met.select(*ordered("fp", "hub"))))
        roots = roots_of(links)
        left = still_apart(left.select("h", "at", "fp"), roots)

    # whoever is still apart meets all others of its buckets; hub rounds have bounded how many meet, and sketches drop most of them inside the join
    longs = lambda names: ", ".join(f"{c} long" for c in names)
    own = ["h", "at", "fp", "root", "hub_root"]
    sketched = left.select(*own).join(join.nodes.select("fp", "sketch").hint("merge"), "fp").select(*own, "sketch")
    left = written(sketched.mapInArrow(with_folded, longs([*own, *FOLDED])))
    side = lambda name: [F.col(c).alias(f"{name}_{c}") for c in ("fp", "at", "root", *FOLDED)]
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"one_{p}").bitwiseXOR(F.col(f"two_{p}"))) for p in FOLDED])
    sizes = size_of("one_at") + size_of("two_at")
    close = can_share("one_at", "two_at", s) & (differ <= sizes - 2 * shared_at_least(sizes, s))
    one, two = left.filter("root <> hub_root").select("h", *side("one")), left.select("h", *side("two"))
    pairs = one.join(two.hint("merge"), "h").filter("one_root <> two_root").filter(close)
    return roots_of(links.unionByName(join.links(pairs.select(*ordered("one_fp", "two_fp")))))


def with_roots(join: Join, known: DataFrame | None = None) -> DataFrame:
    """All sets ``fp`` with their ``root``; ``_n`` rows have the set, ``smallest`` is their least id."""
    roots = joined_roots(join, known)
    return written(join.nodes.select("fp", "_n", "smallest", "size").join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row for each document: its id, ``n_shingles`` (different word shingles) and ``component_id``.

    Documents link when their sets of shingles of ``size`` words (A-Z made small) have this Jaccard similarity or more; ``component_id``
    is the smallest id that links reach, itself included. No link is missed. A text of fewer words is one shingle.

    A null, empty or blank text has no shingle and links with nothing: its component is its own id. A null id is never the smallest unless a
    component has no other. Repeated rows stay and share a component; ties do not arise. A very long text is one row of one task, read whole. Ids may be
    of any type that has an order. An empty table gives an empty result. Other columns are not read.
    """

    def make() -> DataFrame:
        join = Join(docs, id_col, text_col, size, similarity)
        rooted = with_roots(join)
        smallest = written(rooted.groupBy("root").agg(F.min("smallest").alias("component_id"), F.count(F.lit(1)).alias("_sets")))
        labels = written(look_up(rooted.select("fp", "root", "_n"), smallest, "root", join.sets, "_sets").drop("root"))
        out = look_up(join.marked.select("id", "fp", "size"), labels, "fp", join.rows)
        return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))

    return settled(docs.sparkSession, make)

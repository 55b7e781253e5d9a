"""Near-duplicate documents by SimHash and pigeonhole blocks.

A fingerprint of 64 bits is cut into ``b`` blocks. Two fingerprints that differ in at most ``k`` bits
agree in at least ``b - k`` blocks, so they meet in the bucket of some choice of ``b - k`` blocks. The
number of blocks follows from the number of different fingerprints, such that chance meetings stay
few; whatever it is, no close pair is missed. Fingerprints alike are one node from the start. In a
bucket the pairs are verified, but only links that join something new are kept, at most one fewer
than members.

Where the similarity of the texts' sets of shingles decides (``similar_groups``), the blocks give the candidates and the
sets are compared. Pairs of the similarity whose fingerprints are farther apart are found by the join of
``jaccard_join``, in which texts that the blocks have joined need not meet again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.jaccard_join import Join, keyed, ordered, with_roots
from gradeloom.llm.tokens import U64, mix
from gradeloom.operators.components import connected_components
from gradeloom.operators.hot_keys import look_up
from gradeloom.plans.columns import packed, unpacked
from gradeloom.plans.durable import settled, written
from gradeloom.plans.session import small_batches

#: A bucket with more members is cut again by its other bits, so that no task gets more of one bucket.
LARGE_BUCKET = 8192


def fingerprint(text: bytes, size: int, seed: int = 42) -> int:
    """The SimHash of the word shingles of a text whose letters A-Z are made small; 0 without words."""
    parts = text.lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(length + 1) - 1
    start = end - length
    size = min(size, len(parts))
    first, last = start[: len(parts) - size + 1], end[size - 1 :]
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(first)
    for k in range(0, n, 1 << 15):
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(first[k : k + (1 << 15)].tolist(), last[k : k + (1 << 15)].tolist(), strict=True)], U64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``id`` and ``fp`` (the bits as a long) of every row; a null text has no words."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("").cast(pa.large_binary())
            marks = np.array([fingerprint(x.as_py(), size) for x in texts], U64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def cut_mask(mask: int, parts: int) -> list[int]:
    """The set bits of a mask, dealt into neighbouring parts of nearly equal size."""
    bits = [k for k in range(64) if mask >> k & 1]
    edges = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(edges, edges[1:], strict=False)]


def as_long(x: int) -> int:
    return x - 2**64 if x >> 63 else x


def masks_for(number: int, distance: int) -> list[int]:
    """Masks of which every pair within ``distance`` bits shares one, with few chance meetings at this number."""
    whole = 2**64 - 1
    blocks = next(b for b in range(distance + 1, distance + 7) if number <= 2 ** (64 * (b - distance) / b) / 4 or b == distance + 6)
    return [sum(x) for x in combinations(cut_mask(whole, blocks), blocks - distance)]


def bucket_links(members: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join all members within reach of each other, without those that join nothing new."""
    found = []
    rest = members
    while len(rest) > 1:
        waiting, rest = [rest[0]], rest[1:]
        while waiting and len(rest):
            here = waiting.pop()
            near = np.bitwise_count(rest ^ here) <= distance
            if near.any():
                found.append((np.full(int(near.sum()), here), rest[near]))
                waiting.extend(rest[near])
                rest = rest[~near]
    return found


def close_pairs(nodes: DataFrame, number: int, distance: int = 4) -> DataFrame:
    """Links ``a``, ``b`` between different fingerprints ``fp`` that join whatever lies within ``distance`` bits."""
    spark = nodes.sparkSession
    masks = masks_for(number, distance)
    keys = nodes.select("fp", F.explode(F.array(*[F.lit(as_long(m)) for m in masks])).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    settled: DataFrame | None = None
    while True:
        large = keys.groupBy("mask", "key").count().filter(F.col("count") > LARGE_BUCKET).select("mask", "key")
        large = written(large)
        if large.isEmpty():
            settled = keys if settled is None else settled.unionByName(keys)
            break
        # pairs in a bucket differ in the other bits only: cut those, one part of five agrees as well
        finer = [(as_long(m), as_long(m | x)) for m in masks for x in cut_mask(~m & (2**64 - 1), distance + 1) if x]
        table = spark.createDataFrame(finer, "mask long, finer long")
        small = keys.join(large.hint("merge"), ["mask", "key"], "left_anti")
        settled = small if settled is None else settled.unionByName(small)
        keys = keys.join(large.hint("merge"), ["mask", "key"], "left_semi").join(table.hint("merge"), "mask").select("fp", F.col("finer").alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        masks = sorted({m % 2**64 for _, m in finer})

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            flat, ends = column.values.to_numpy().view(U64), column.offsets.to_numpy()
            two = ends[:-1][np.diff(ends) == 2]
            near = np.bitwise_count(flat[two] ^ flat[two + 1]) <= distance
            pairs = [(flat[two[near]], flat[two[near] + 1])]
            for k in np.flatnonzero(np.diff(ends) > 2):
                pairs += bucket_links(flat[ends[k] : ends[k + 1]], distance)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in pairs]).view(np.int64)) for i in (0, 1)], ["a", "b"])

    buckets = settled.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    pairs = buckets.select("fps").mapInArrow(links, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, distance: int = 4) -> DataFrame:
    """One row for each document: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id that links reach, itself included; a link joins fingerprints
    that differ in ``distance`` bits or fewer, equal ones too. A null text, an empty one and one of
    spaces have no words and the fingerprint zero, which is linked like any other. Texts with fewer
    words than a shingle are one shingle. A null id is never the smallest unless a component has no
    other. Repeated rows stay and share a component. An empty table gives an empty result. Other
    columns are not read.
    """
    marked = written(fingerprints(docs, id_col, text_col, size))
    nodes = written(marked.groupBy("fp").agg(F.min("id").alias("smallest"), F.count(F.lit(1)).alias("_n")))
    number, rows = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    roots = connected_components(close_pairs(nodes, number, distance))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted)
    smallest = written(rooted.groupBy("root").agg(F.min("smallest").alias("component_id"), F.count(F.lit(1)).alias("_members")))
    labels = written(look_up(rooted.select("fp", "root", "_n"), smallest, "root", number, "_members").drop("root"))
    return look_up(marked, labels, "fp", rows).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def set_fingerprints(value: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The SimHash of each set of shingle hashes: a bit is set if it is in over half of them; 0 for a set without any."""
    bits = np.unpackbits(mix(value).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    number = np.diff(edge)
    out, some = np.zeros(len(number), U64), number > 0
    if some.any():
        ones = np.add.reduceat(bits, edge[:-1][some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > number[some, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def block_links(join: Join, distance: int = 4) -> DataFrame:
    """Links ``a, b`` between sets of the join's similarity that SimHash blocks bring together: equal fingerprints, and those that differ in ``distance`` bits or fewer."""
    sets = join.nodes.filter("size > 0").select("fp", "code")
    codes = written(sets.groupBy("code").agg(F.min("fp").alias("first"), F.count(F.lit(1)).alias("_n")))
    alike = look_up(sets, codes, "code", join.sets).filter("fp <> first").select(*ordered("fp", "first"))
    near = written(close_pairs(codes.select(F.col("code").alias("fp")), codes.count(), distance))
    for end in ("a", "b"):
        near = near.join(codes.select(F.col("code").alias(end), F.col("first").alias(f"{end}_first")).hint("merge"), end)
    return join.links(alike.unionByName(near.select(*ordered("a_first", "b_first"))))


def similar_groups(docs: DataFrame, id_col: str, text_col: str, size: int, similarity: float) -> DataFrame:
    """``doc`` (the id) and ``key`` (hashes of id and text) of each text, with the ``root`` of its group.

    A link joins two texts whose sets of shingles have this Jaccard similarity or more: those that SimHash blocks bring together
    first, then what is farther apart by the join over first shingles, so no such pair is missed at any size. Sets alike are one node, that of texts without words too.
    """
    join = Join(docs, id_col, text_col, size, similarity, set_fingerprints)
    rooted = with_roots(join, block_links(join)).select("fp", "_n", "root")
    return look_up(join.marked.select("doc", "tag", "id", "fp"), rooted, "fp", join.rows).select(F.col("id").alias("doc"), F.struct("doc", "tag").alias("key"), "root")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """Keep one row of each group of texts that are alike at this similarity of word shingles: that of the smallest id.

    A null id counts as the smallest; among rows of one id a hash of the text decides, and of rows alike
    in id and text the one first by its columns written as JSON. Null, empty and blank texts are one
    group. All columns of ``docs`` stay, whatever their names. Ids may be of any type that has an order.
    """
    groups = settled(docs.sparkSession, lambda: similar_groups(docs, id_col, text_col, size, similarity))
    kept = groups.groupBy("root").agg(F.min(F.struct("doc", "key")).alias("first")).select("first.key.*")  # folded before the shuffle
    row = F.col("row")
    marked = packed(docs).select("row", *keyed(row.getField(id_col), row.getField(text_col)))
    out = marked.join(kept.hint("shuffle_hash"), ["doc", "tag"], "left_semi")
    twins = groups.groupBy("key").count().filter("count > 1")
    return unpacked(out if twins.isEmpty() else out.groupBy("doc", "tag").agg(F.min_by("row", F.to_json("row")).alias("row")))

"""One query for each operator of this folder, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.conversation_repair import repair_damaged
from gradeloom.llm.decontaminate import overlaps
from gradeloom.llm.jaccard_join import jaccard_join
from gradeloom.llm.language_id import identify
from gradeloom.llm.license_scan import scan_licenses
from gradeloom.llm.maxent_lm import score_texts
from gradeloom.llm.quality_forest import judge_quality
from gradeloom.llm.ranked_search import ranked
from gradeloom.llm.shards import shuffle_into_shards
from gradeloom.llm.simhash_dedup import near_duplicates
from gradeloom.llm.source_mix import mix_sources
from gradeloom.llm.substring_dedup import remove_repeated_passages
from gradeloom.llm.suffix_dedup import remove_repeated_bytes

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).drop("source", "copies")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle_into_shards(documents(spark, sf_dir))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    # documents have no paths: a tree by source, language and a hundred folders of ids
    folder = F.concat(F.lit("part-"), (F.col("doc_id") % 100).cast("string"))
    return scan_licenses(docs.withColumn("path", F.concat_ws("/", "source", "lang", folder, F.col("doc_id").cast("string"))))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(documents(spark, sf_dir)).drop("kept")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(documents(spark, sf_dir)).drop("kept")



def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Query] = {
    "op1_maxent_scores": op1,
    "op2_spaced_seed_overlaps": op2,
    "op3_substring_dedup": op3,
    "op4_language_id": op4,
    "op5_source_mix": op5,
    "op6_shards": op6,
    "op7_license_scan": op7,
    "op8_simhash_groups": op8,
    "op9_quality_forest": op9,
    "op10_suffix_dedup": op10,
    "op11_jaccard_join": op11,
    "op12_conversation_repair": op12,
    "op13_ranked_search": op13,
}

ORACLES: dict[str, str] = {
    "op3_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\x0C\r]+'), lambda x: x <> '') AS w FROM documents),
        starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
        windows AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM starts),
        again AS (SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
        gone AS (SELECT DISTINCT doc_id, i + k AS j FROM again, range(0, 35) AS r(k)),
        each AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d),
        kept AS (SELECT e.doc_id, count(g.j) AS n_removed, string_agg(CASE WHEN g.j IS NULL THEN e.w[e.j] END, ' ' ORDER BY e.j) AS t
                 FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.j = g.j GROUP BY e.doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
        FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    "op10_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
        s AS (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS i FROM d WHERE len(x) >= 200),
        w AS (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 200)) AS h1, md5_number(substr(x, 2 * i + 1, 200)) AS h2 FROM s),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h1, h2 ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
        gap AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM r),
        num AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM gap),
        span AS (SELECT doc_id, g, min(i) AS a, max(i) + 100 AS b FROM num GROUP BY doc_id, g),
        edge AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM span),
        kept AS (SELECT e.doc_id, sum(b - a) AS gone, count(*) AS n, max(b) AS last,
                        string_agg(substr(d.x, 2 * before::BIGINT + 1, 2 * (a - before)::BIGINT), '' ORDER BY a) AS t
                 FROM edge e JOIN d ON e.doc_id = d.doc_id GROUP BY e.doc_id)
        SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(t || substr(x, 2 * last::BIGINT + 1), x))) AS kept_sha256
        FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    "op13_ranked_search": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0),
        tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
        w AS (SELECT q.item_id, q.term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM q JOIN df ON q.term = df.term, s),
        scored AS (SELECT w.item_id, d.r, d.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * len(d.w) * s.docs) // s.words))))::BIGINT AS score
                   FROM w JOIN tf ON w.term = tf.term JOIN d ON tf.r = d.r, s GROUP BY w.item_id, d.r, d.doc_id),
        placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= 50""",
}

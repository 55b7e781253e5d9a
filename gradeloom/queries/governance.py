"""Queries over dataset manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import datasets as ds
from gradeloom.plans.catalog import query
from gradeloom.plans.fixtures import view, with_views


@query("A06_table_fingerprint", "SELECT count(*) AS rows, CAST(sum(CAST(('0x' || substr(sha256(concat(CASE WHEN doc_id IS NULL THEN '-;' ELSE length(CAST(doc_id AS VARCHAR)) || ':' || doc_id END, CASE WHEN text IS NULL THEN '-;' ELSE length(text) || ':' || text END)), 1, 15)) AS BIGINT)::HUGEINT) AS VARCHAR) AS content FROM documents")
def a06(spark, sf):
    return ds.table_fingerprint(spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id", "text"])


@query("A07_split_by_role", with_views("SELECT split, count(*) AS n, min(path) AS first, max(path) AS last FROM manifest GROUP BY split", "manifest"))
def a07(spark, sf):
    parts = ds.split_by_role(view(spark, sf, "manifest"), "split", ["train", "val", "test"])
    counted = [part.agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"), F.max("path").alias("last")).select(F.lit(role).alias("split"), "*") for role, part in parts.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).filter("n > 0")


@query("C11_leakage_audit", with_views("""WITH l AS (SELECT split, 'group_id' AS key, group_id AS value FROM manifest UNION ALL SELECT split, 'content', sha256(text) FROM manifest)
 SELECT key, value, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM l WHERE value IS NOT NULL AND value <> '' GROUP BY key, value HAVING count(DISTINCT split) > 1""", "manifest"))
def c11(spark, sf):
    return ds.leakage_audit(view(spark, sf, "manifest").withColumn("content", F.sha2("text", 256)), ["group_id", "content"])


@query("D07_integrity_report", with_views("""SELECT 'repeated_path' AS "check", CAST(path AS VARCHAR) AS key, count(*) AS n FROM manifest GROUP BY path HAVING count(*) > 1
 UNION ALL SELECT 'repeated_content', sha256(text), count(*) FROM manifest GROUP BY sha256(text) HAVING count(*) > 1
 UNION ALL SELECT 'mixed_labels', group_id, count(DISTINCT class_id) FROM manifest GROUP BY group_id HAVING count(DISTINCT class_id) > 1""", "manifest"))
def d07(spark, sf):
    return ds.integrity_report(view(spark, sf, "manifest"), "path", F.sha2("text", 256), "group_id", "class_id")


@query("D08_identity_conflicts", with_views("SELECT sha256(text) AS content, count(DISTINCT source_id || '/' || class_id) AS variants FROM manifest GROUP BY 1 HAVING variants > 1", "manifest"))
def d08(spark, sf):
    return ds.identity_conflicts(view(spark, sf, "manifest").withColumn("content", F.sha2("text", 256)), "content", ["source_id", "class_id"])


@query("D10_composition", with_views("""SELECT 'split' AS dimension, split AS value, count(*) AS n FROM manifest GROUP BY split UNION ALL SELECT 'class_id', CAST(class_id AS VARCHAR), count(*) FROM manifest GROUP BY class_id
 UNION ALL SELECT 'origin', origin, count(*) FROM manifest GROUP BY origin UNION ALL SELECT 'split:class_id', split || ':' || class_id, count(*) FROM manifest GROUP BY split, class_id""", "manifest"))
def d10(spark, sf):
    return ds.composition(view(spark, sf, "manifest"), ["split", "class_id", "origin", "split:class_id"])


GROUPS = "g AS (SELECT class_id, source_id || ':' || class_id AS grp, count(*) AS rows FROM manifest GROUP BY 1, 2)"


def grouped(spark, sf):
    return view(spark, sf, "manifest").withColumn("grp", F.concat("source_id", F.lit(":"), F.col("class_id").cast("string")))


@query("E03_stratified_group_split", with_views(f"""WITH {GROUPS}, p AS (SELECT *, count(*) OVER (PARTITION BY class_id) AS n, row_number() OVER (PARTITION BY class_id ORDER BY md5('7:' || grp), grp) AS place FROM g),
 q AS (SELECT *, CASE WHEN n < 3 THEN 0 ELSE greatest(1, round_even(n * 0.1::DOUBLE, 0)::INT) END AS nt, CASE WHEN n < 3 THEN 0 ELSE greatest(1, round_even(n * 0.2::DOUBLE, 0)::INT) END AS nv0 FROM p),
 r AS (SELECT *, least(nv0, n - 1 - nt) AS nv FROM q) SELECT class_id, grp, rows, CASE WHEN place <= nt THEN 'test' WHEN place <= nt + nv THEN 'val' ELSE 'train' END AS split FROM r""", "manifest"))
def e03(spark, sf):
    return ds.stratified_group_split(grouped(spark, sf), "grp", "class_id", 0.2, 0.1, 7)


FOLDS = f"{GROUPS}, f AS (SELECT grp, class_id, (row_number() OVER (PARTITION BY class_id ORDER BY md5('9:' || grp), grp) - 1) % 5 AS fold FROM g)"


@query("E04_group_kfold", with_views(f"WITH {FOLDS} SELECT grp, class_id, CAST(fold AS INT) AS fold FROM f", "manifest"))
def e04(spark, sf):
    return ds.group_kfold(grouped(spark, sf), "grp", "class_id", 5, 9)


@query("E05_fold_audit", with_views(f"WITH {FOLDS} SELECT CAST(fold AS INT) AS fold, count(*) AS rows, count(DISTINCT m.source_id || ':' || m.class_id) AS groups FROM manifest m JOIN f ON f.grp = m.source_id || ':' || m.class_id GROUP BY fold", "manifest"))
def e05(spark, sf):
    rows = grouped(spark, sf)
    return ds.fold_audit(rows, ds.group_kfold(rows, "grp", "class_id", 5, 9), "grp")


SESSIONS = """s AS (SELECT *, sum(new) OVER (PARTITION BY batch_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS session FROM
 (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY batch_id ORDER BY ts, id) <= 7200000000 THEN 0 ELSE 1 END AS new FROM inspection_log))"""


@query("E01_sessionize", with_views(f"WITH {SESSIONS} SELECT id, batch_id, session::BIGINT AS session FROM s", "inspection_log"))
def e01(spark, sf):
    return ds.sessionize(view(spark, sf, "inspection_log"), "batch_id", "ts", "id", 7200).select("id", "batch_id", "session")


@query("E02_holdout_latest", with_views(f"WITH {SESSIONS} SELECT id, CASE WHEN dense_rank() OVER (PARTITION BY batch_id ORDER BY session DESC) <= 2 THEN 'holdout' ELSE 'train' END AS pool FROM s", "inspection_log"))
def e02(spark, sf):
    return ds.holdout_latest(ds.sessionize(view(spark, sf, "inspection_log"), "batch_id", "ts", "id", 7200), "batch_id", 2).select("id", "pool")


@query("E14_first_wins", with_views("SELECT path, split FROM (SELECT path, split, row_number() OVER (PARTITION BY sha256(text) ORDER BY path) AS n FROM manifest) WHERE n = 1", "manifest"))
def e14(spark, sf):
    return ds.first_wins(view(spark, sf, "manifest"), [F.sha2("text", 256)], ["path"]).select("path", "split")


@query("G02_shared_keys", with_views("SELECT sha256(text) AS content FROM manifest WHERE split = 'train' INTERSECT SELECT sha256(text) FROM manifest WHERE split = 'test'", "manifest"))
def g02(spark, sf):
    rows = view(spark, sf, "manifest").withColumn("content", F.sha2("text", 256))
    return ds.shared_keys(rows.filter("split = 'train'"), rows.filter("split = 'test'"), "content")


@query("G03_fold_complement", with_views(f"WITH {FOLDS} SELECT m.path, m.class_id FROM manifest m JOIN f ON f.grp = m.source_id || ':' || m.class_id WHERE fold <> 0", "manifest"))
def g03(spark, sf):
    rows = grouped(spark, sf)
    return ds.fold_complement(rows, ds.group_kfold(rows, "grp", "class_id", 5, 9), "grp", 0).select("path", "class_id")


@query("W01_pair_mass", with_views("SELECT path, group_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY group_id) AS mass FROM manifest", "manifest"))
def w01(spark, sf):
    return ds.pair_mass(view(spark, sf, "manifest"), "group_id").select("path", "group_id", "mass")


@query("W02_balance_mass", with_views("""WITH t AS (SELECT sum(m) AS total, count(*) AS k FROM (SELECT class_id, sum(n_chars)::DOUBLE AS m FROM manifest GROUP BY class_id HAVING m > 0))
 SELECT path, class_id, round(n_chars * total / (k * sum(n_chars) OVER (PARTITION BY class_id)), 6) AS balanced FROM manifest, t""", "manifest"))
def w02(spark, sf):
    return ds.balance_mass(view(spark, sf, "manifest"), "class_id", "n_chars").select("path", "class_id", F.round("balanced", 6).alias("balanced"))


@query("W04_group_balanced", with_views("""WITH r AS (SELECT class_id, source_id, count(*) AS c FROM manifest GROUP BY 1, 2), w AS (SELECT class_id, source_id, c, 1.0::DOUBLE / (count(*) OVER (PARTITION BY class_id) * c) AS w FROM r),
 m AS (SELECT sum(w * c) / sum(c) AS mean FROM w) SELECT path, round(w / mean, 9) AS weight FROM manifest JOIN w USING (class_id, source_id), m""", "manifest"))
def w04(spark, sf):
    return ds.group_balanced(view(spark, sf, "manifest"), "class_id", "source_id").select("path", F.round("weight", 9).alias("weight"))


@query("W05_class_balanced", with_views("""WITH c AS (SELECT class_id, count(*) AS c FROM manifest GROUP BY 1), w AS (SELECT class_id, c, pow(sum(c) OVER ()::DOUBLE / (count(*) OVER () * c), 0.5) AS w FROM c),
 m AS (SELECT sum(w * c) / sum(c) AS mean FROM w) SELECT path, round(w / mean, 9) AS weight FROM manifest JOIN w USING (class_id), m""", "manifest"))
def w05(spark, sf):
    return ds.class_balanced(view(spark, sf, "manifest"), "class_id", 0.5).select("path", F.round("weight", 9).alias("weight"))

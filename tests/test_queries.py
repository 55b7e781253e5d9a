"""Every query with SQL gives the rows of its SQL over the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF, NEXT = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The smallest tables lack groups for five folds: these run on the next size.
LARGER = {"E04_group_kfold", "E04_balanced_folds", "E05_fold_audit", "G03_fold_complement"}
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op"))


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return str(value.replace(tzinfo=None)) if hasattr(value, "tzinfo") else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    folder = NEXT if name in LARGER else SF
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    result = db.execute(entry.oracle_sql()[name])
    place = [[d[0] for d in result.description].index(c) for c in columns]
    assert got == sorted(str([plain(r[i]) for i in place]) for r in result.fetchall())

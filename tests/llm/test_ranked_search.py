"""Ranked search against scores of all documents in plain Python, and its SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from gradeloom.llm import ranked_search as rs
from gradeloom.llm.queries import ORACLES, QUERIES
from gradeloom.llm.ranked_search import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def cut(text):
    return TERM.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))


def brute(docs, items, k):
    texts = [(d, Counter(cut(t))) for d, t in docs]
    texts = [(d, c) for d, c in texts if c]
    n, length = len(texts), sum(c.total() for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(cut(t))
    out = []
    for i, own in asked.items():
        scores = []
        for d, c in texts:
            m = 50 + 50 * c.total() * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0:
                scores.append((-s, d is not None, d or 0))
        out += [(i, r, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def corpus(rng, n):
    words = [f"{'wÉx'[k % 3]}{k}" for k in range(60)] + ["The", "the", "THE", "a-b", "ü", "x_y"]
    draw = lambda m: rng.choice([" ", "\n", ", "]).join(words[min(int(rng.expovariate(0.08)), len(words) - 1)] for _ in range(m))
    docs = [(k, draw(rng.randint(1, 60))) for k in range(n)]
    docs += [(n + k, docs[3][1]) for k in range(30)] + [docs[5], (None, docs[3][1]), (None, None), (n + 90, ""), (n + 91, "-- \n"), (n + 92, draw(5000))]
    items = [(k, draw(rng.randint(1, 25))) for k in range(20)] + [(3, "more terms w1"), (None, "w2 w3"), (50, ""), (51, None), (52, "nowhere"), (53, docs[3][1])]
    return docs, items


def test_all_scores(spark, monkeypatch):
    docs, items = corpus(random.Random(4), 300)
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in docs], "doc_id long, text string, number long, score long, item_id long").repartition(4)
    asked = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int").repartition(3)
    for k in (1, 7, 50):
        assert sorted((tuple(r) for r in ranked(table, asked, k).collect()), key=str) == brute(docs, items, k)
    monkeypatch.setattr(rs, "BLOCK_TERMS", 30)
    assert sorted((tuple(r) for r in ranked(table, asked, 7).collect()), key=str) == brute(docs, items, 7)
    none = table.filter("doc_id < -1")
    assert ranked(none, asked).collect() == [] == ranked(table, asked.filter("item_id < -1")).collect()


def test_masks_end_early(monkeypatch):
    """Many documents hold the common term alone: they are neither scored nor split after the last place is safe."""
    monkeypatch.setattr(rs, "FEW", 1)
    rng = np.random.default_rng(3)
    n, rare = 5000, 40
    held = [[0, 1, 2] if k % (n // rare) == 0 else [0] for k in range(n)]
    ends = np.concatenate([[0], np.cumsum([len(h) for h in held])])
    flat = np.concatenate(held).astype(np.int32)
    block = rs.Block(rng.integers(3, 90, n), ends, flat, np.ones(len(flat), np.int64), np.array([10, 3000, 3000]), n, 50 * n)
    scored = []
    exact = block.scores
    monkeypatch.setattr(block, "scores", lambda which, of: scored.append(len(which)) or exact(which, of))
    which, score = block.best([0, 1, 2], 10, [])
    assert sum(scored) <= rare
    whole = exact(np.arange(n), [0, 1, 2])
    assert sorted(score.tolist())[-10:] == sorted(whole.tolist())[-10:]


def test_long_texts_are_cut_by_pieces(monkeypatch):
    monkeypatch.setattr(rs, "PIECE", 7)
    text = "Ab cd, é-ab 12345678901234567890 x " * 20
    assert rs.terms(text) == Counter(t.encode() for t in cut(text))


def test_query_equals_sql_and_brute_force(spark):
    got = sorted((tuple(r) for r in QUERIES["op13_ranked_search"](spark, SF).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(c, "text").collect()]
    assert got == brute(read("documents", "doc_id"), read("benchmark", "item_id"), 50)
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert got == sorted(db.execute(ORACLES["op13_ranked_search"]).fetchall(), key=str)

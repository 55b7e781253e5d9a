"""Every stage of the pipeline against plain Python on the output of the stage before, and the whole run."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from gradeloom.llm.decontaminate import STRETCH, decontaminated, overlaps, tolerated
from gradeloom.plans.durable import written
from tests.llm.test_near_copies import brute

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF)))
    return out


def overlapping(texts, items):
    """Pairs of text and item with a stretch that agrees in enough words, over all ways to lay one on the other."""
    codes: dict[str, int] = {}
    number = lambda t: np.array([codes.setdefault(w, len(codes)) for w in WORDS.findall(lower(t))], np.int64)
    texts, items = [number(t) for t in texts], [number(t) for t in items]
    found = set()
    for i, item in enumerate(items):
        n = len(item)
        if not n:
            continue
        width = min(STRETCH, n)
        for t, text in enumerate(texts):
            if not len(text):
                continue
            padded = np.concatenate([np.full(n, -1), text, np.full(n, -1)])
            same = np.lib.stride_tricks.sliding_window_view(padded, n) == item
            run = np.concatenate([np.zeros((len(same), 1), np.int64), np.cumsum(same, axis=1)], axis=1)
            if (run[:, width:] - run[:, :-width]).max() >= width - tolerated(width):
                found.add((t, i))
    return found


def test_language_keeps_what_has_letters(stages):
    kept = {r.doc_id for r in stages[1].collect()}
    rows = stages[0].collect()
    assert not any(r.doc_id in kept for r in rows if not re.search(r"[^\W\d_]", r.text or ""))
    clear = [r for r in rows if r.lang and len(WORDS.findall(r.text or "")) >= 20]
    assert sum(r.doc_id in kept for r in clear) >= 0.98 * len(clear)


def test_one_of_each_group_stays(stages):
    rows = sorted(stages[1].collect(), key=lambda r: r.doc_id)
    groups = brute([lower(r.text) for r in rows], 0.8)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(rows[min(g)].doc_id for g in groups)


def test_benchmark_texts_go(spark, stages):
    rows, items = stages[2].collect(), spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    bad = {t for t, _ in overlapping([r.text for r in rows], [i.text for i in items])}
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(r.doc_id for t, r in enumerate(rows) if t not in bad)


def test_overlaps_by_brute_force(spark):
    rng = np.random.default_rng(6)
    text = lambda n, kinds: " ".join(f"w{k}" for k in rng.integers(0, kinds, n))
    items = [text(n, kinds) for n, kinds in ((3, 4), (8, 9), (12, 30), (13, 30), (20, 40), (40, 60), (30, 2))]
    texts = [text(60, 60) for _ in range(10)]
    for _ in range(60):
        words = items[rng.integers(len(items))].split()
        for k in rng.integers(0, len(words), rng.integers(0, 5)):
            words[k] = "other"
        a = rng.integers(0, len(words))
        texts.append(" ".join([text(int(rng.integers(0, 9)) + 1, 60), *words[a:], *words[:a], text(3, 60)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tests = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = overlapping(texts, items)
    assert {(r.doc_id, r.item_id) for r in overlaps(docs, tests).collect()} == want and len(want) > 20
    assert {r.doc_id for r in decontaminated(docs, tests).collect()} == set(range(len(texts))) - {t for t, _ in want}


def test_mix_comes_near_its_targets(stages):
    rows, taken = stages[3].collect(), Counter(r.doc_id for r in stages[4].collect())
    assert set(taken.values()) <= {1, 2} and stages[4].columns == stages[0].columns
    size = {r.doc_id: len(WORDS.findall(r.text or "")) for r in rows}
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(size[r.doc_id] for r in rows if r.source == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    goal, left, free = {}, 1.5 * sum(own.values()), set(sources)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * own[s]}
        if not full:
            break
        for s in full:
            goal[s] = 2 * own[s]
            left -= goal[s]
        free -= full
    goal |= share
    for s in sources:
        sizes = [size[r.doc_id] for r in rows if r.source == s]
        sums = {0}
        for x in sizes:
            sums |= {y + x for y in sums}
        base = int(round(goal[s]) // max(1, own[s])) * own[s]
        got = sum(size[r.doc_id] * taken[r.doc_id] for r in rows if r.source == s)
        assert abs(got - goal[s]) <= min(abs(base + y - goal[s]) for y in sums) + 1


def test_shards_hold_the_mix(spark, stages):
    rows = stages[5].collect()
    by = Counter(r.shard for r in rows)
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in stages[4].collect())
    counts = [by[k] for k in range(40)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == k) == list(range(by[k])) for k in by)
    again = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in again) == sorted((r.doc_id, r.shard, r.slot) for r in rows)

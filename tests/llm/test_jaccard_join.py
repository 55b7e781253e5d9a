"""The Jaccard join against all pairs in plain Python, with families that have no central text."""

import random
import re

import numpy as np

from gradeloom.llm.jaccard_join import jaccard_join, levels_of, prefixes, shingle_sets, sketch_distance, sketches
from gradeloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def sets_of(texts):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate({k: k + 32 for k in range(65, 91)}))
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(rows):
    sets = sets_of([t for _, t in rows])
    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < k}:
            if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                root[find(k)] = find(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return sorted(((d, len(s), d if not s else least.get(find(k))) for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def families():
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = []
    for _ in range(6):  # copies of a text that is not there, changed at a few places each
        base = [word() for _ in range(rng.choice([40, 90, 150]))]
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4])):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    passages = [" ".join(word() for _ in range(30)) for _ in range(5)]
    texts += [" ".join(rng.sample(passages, rng.randint(2, 4)) + [word() for _ in range(rng.randint(0, 9))]) for _ in range(150)]
    chain = [f"c{k}" for k in range(120)]  # each is like the next, the ends are not alike
    texts += [" ".join(chain[k : k + 80]) for k in range(0, 40, 4)]
    texts += ["", " \n", None, "one", "One", "one two three four", "a b c d e f g h i j k l m n", "A b c d e f g h i j k l m n", "é à", "É à"]
    rows = list(enumerate(texts))
    return rows + [rows[7], (None, texts[7]), (None, "alone in the world"), (None, None), (3, "x y z x y z x y z")]


def test_all_links_are_found(spark):
    rows = families()
    schema = "doc_id long, text string, h long, at long, fp long, hub long, root long, size long"
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], schema).repartition(3)
    assert sorted((tuple(r) for r in jaccard_join(docs).collect()), key=str) == brute(rows)
    assert jaccard_join(docs.filter("doc_id < -1")).collect() == []


def test_similar_sets_meet_in_every_order():
    rng = np.random.default_rng(5)
    levels = levels_of(rng.integers(0, 9, 128).astype(np.float32) ** 3)
    for n in (1, 4, 5, 9, 30, 200):
        value = np.unique(rng.integers(0, 2**63, 2 * n, dtype=np.uint64))
        gone = int(n * 2 / 9)  # as many as differ in each of two sets of this size
        one, two = value[:n], value[gone : n + gone]
        sets, edge = np.concatenate([one, two]), np.array([0, n, 2 * n])
        for seed in (np.uint64(0), np.uint64(77), np.uint64(99)):
            first, cut = prefixes(sets, edge, len(np.intersect1d(one, two)) / len(np.union1d(one, two)), levels, seed)
            assert len(np.intersect1d(first[: cut[1]], first[cut[1] :])) > 0


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(2)
    for n in (0, 1, 40, 900):
        value = np.unique(rng.integers(0, 2**63, n + n // 3, dtype=np.uint64))
        cut = len(value) // 5
        sets, edge = np.concatenate([value[cut:], value[: len(value) - cut]]), np.array([0, len(value) - cut, 2 * (len(value) - cut)])
        one, two = sketches(sets, edge)
        assert sketch_distance(one, two) <= 2 * cut and sketch_distance(one, sketches(value, np.array([0, len(value)]))[0]) <= cut


def test_shingles_of_short_texts():
    text = b"a b c  D e f a b c d e|one|| two words"
    cut = np.array([0, 22, 26, 27, 28, 38])
    data = np.frombuffer(text.replace(b"|", b" "), np.uint8)
    value, edge = shingle_sets(data, cut, 5)
    assert np.diff(edge).tolist() == [6, 1, 0, 0, 1] and len(value) == 8


def test_query_equals_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op11_jaccard_join"](spark, SF).collect()), key=str) == brute(rows)

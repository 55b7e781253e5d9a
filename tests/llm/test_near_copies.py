"""The near-copy stage against brute force over all pairs of texts."""

import random

from gradeloom.llm.simhash_dedup import similar_groups


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts, similarity):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or len(x & y) >= similarity * len(x | y):
                root[find(i)] = find(j)
    return {frozenset(i for i in range(len(texts)) if find(i) == k) for k in range(len(texts)) if find(k) == k}


def test_all_pairs_are_found(spark):
    rng = random.Random(5)
    head = " ".join(f"h{k}" for k in range(30))
    texts = ["", " ", "one two", "One two"]
    for family in range(60):
        n = rng.choice([3, 6, 12, 40, 90, 200])
        words = [f"w{rng.randrange(3000)}" for _ in range(n)]
        texts.append(" ".join(words))
        for _ in range(rng.randint(1, 5)):
            copy = list(words)
            for _ in range(max(1, round(n * rng.choice([0.01, 0.02, 0.025, 0.04])))):
                copy[rng.randrange(n)] = f"v{rng.randrange(3000)}"
            texts.append((head + " " if rng.random() < 0.2 else "") + " ".join(copy))
    texts.append("one two three four five six seven eight nine")
    texts.append("one two three four five six seven eight")
    texts[3] = "one two"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {}
    for r in similar_groups(docs, "doc_id", "text", 5, 0.8).collect():
        found.setdefault(r.root, set()).add(r.doc)
    assert {frozenset(x) for x in found.values()} == brute(texts, 0.8)


def test_an_order_that_knows_little(spark, monkeypatch):
    from gradeloom.llm import jaccard_join as jj

    monkeypatch.setattr(jj, "CELLS", 64)  # buckets are large
    monkeypatch.setattr(jj, "WIDE", 64)  # sets of frequent ends are salted
    monkeypatch.setattr(jj, "FEW_MEETINGS", 0)  # further hubs while they help
    test_all_pairs_are_found(spark)


def test_hubs_over_batches():
    import numpy as np
    import pyarrow as pa

    from gradeloom.llm.jaccard_join import with_hubs

    rng = np.random.default_rng(3)
    for _ in range(60):
        rows = np.array(sorted((h, fp % 3, fp) for h, fp in zip(rng.integers(0, 12, 40).tolist(), rng.integers(0, 6, 40).tolist(), strict=True)), np.int64)
        cuts = [0, *sorted(rng.integers(0, 41, 5).tolist()), 40]
        batches = [pa.RecordBatch.from_arrays([pa.array(rows[x:y, k]) for k in range(3)], ["h", "at", "fp"]) for x, y in zip(cuts, cuts[1:], strict=False)]
        got = sorted(tuple(r.values()) for b in with_hubs(iter(batches)) for r in b.to_pylist())
        members = {}
        for h, at, fp in rows.tolist():
            members.setdefault(h, set()).add((at, fp))
        assert got == sorted((h, at, fp, *min(m)) for h, m in members.items() if len(m) > 1 for at, fp in m)


def test_simhash_blocks_give_links(spark, monkeypatch):
    """The blocks' links are pairs of the similarity and reach whatever they should; what they have joined does not meet again in the join of the rest."""
    from gradeloom.llm import jaccard_join as jj
    from gradeloom.llm import simhash_dedup as sd

    rng = random.Random(8)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(4000)}" for _ in range(150)]
        copy = list(words)
        copy[rng.choice([0, 1, 70])] = "other"
        texts += [" ".join(words), " ".join(copy)]
    texts += ["", "one two", " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    join = jj.Join(docs, "doc_id", "text", 5, 0.8, sd.set_fingerprints)
    nodes = {r.fp: (r.smallest, r.code % 2**64) for r in join.nodes.collect()}
    links = {tuple(sorted((nodes[r.a][0], nodes[r.b][0]))) for r in sd.block_links(join).collect()}
    code = dict(nodes.values())
    pairs = {(k, k + 1) for k in range(0, 80, 2)}  # the only ones of the similarity
    assert links == {(a, b) for a, b in pairs if (code[a] ^ code[b]).bit_count() <= 4} and 10 < len(links) < 40

    met, of_pairs = [], jj.Join.links
    monkeypatch.setattr(jj.Join, "links", lambda self, pairs: met.append({(r.a, r.b) for r in pairs.collect()}) or of_pairs(self, pairs))
    found = {}
    for r in similar_groups(docs, "doc_id", "text", 5, 0.8).collect():
        found.setdefault(r.root, set()).add(r.doc)
    assert {frozenset(x) for x in found.values()} == brute(texts, 0.8)
    own = lambda some: {tuple(sorted((nodes[a][0], nodes[b][0]))) for a, b in some}
    assert links <= own(met[0]) and all(not links & own(later) for later in met[1:]) and len(met) > 1

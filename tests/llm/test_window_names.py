"""Equal windows of words have equal names, whatever stands beside the passage."""

import random

import numpy as np

from gradeloom.llm.substring_dedup import anchored_runs
from gradeloom.llm.tokens import U64, mix

SIZE = 35


def names(texts):
    codes = mix(np.array([w for t in texts for w in t], U64))
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    flat = [w for t in texts for w in t]
    found = {}
    for name, _, start, count in zip(*anchored_runs(codes, owner, SIZE), strict=True):
        for i in range(int(start), int(start + count)):
            found.setdefault(tuple(flat[i : i + SIZE]), set()).add(int(name))
    return found


def test_edge_words_repeated_beside_a_passage():
    rng = random.Random(8)
    for _ in range(400):
        passage = [rng.randrange(1, 40) for _ in range(rng.randint(35, 60))]
        texts = []
        for _ in range(6):
            before, after = ([edge] * rng.randint(0, 3) + [rng.randrange(1, 40)] * rng.randint(0, 1) for edge in (passage[0], passage[-1]))
            texts.append([rng.randrange(1, 40) for _ in range(rng.randint(0, 3))] + before[::-1] + passage + after + [rng.randrange(1, 40) for _ in range(rng.randint(0, 3))])
        assert all(len(x) == 1 for x in names(texts).values())
    few = [[rng.randrange(3) for _ in range(3000)] for _ in range(2)]
    few[0][100:1000] = few[1][700:1600]
    few[0][1500:1600], few[1][100:200] = [1] * 100, [1] * 100
    assert all(len(x) == 1 for x in names(few).values())

"""Hashes of structured sequences: the words of Thue and Morse meet their complement in any hash modulo a power of two."""

import hashlib

import numpy as np

from gradeloom.llm.quality_forest import judge_quality
from gradeloom.llm.substring_dedup import remove_repeated_passages
from gradeloom.llm.suffix_dedup import remove_repeated_bytes
from gradeloom.llm.tokens import BYTE_CODE, PRIME, U64, Rolling, modulo, word_hashes


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


ONE, TWO = thue_morse(2048), thue_morse(2048, "b", "a")


def test_slices_have_their_own_hashes():
    data = np.frombuffer((ONE + TWO + ONE).encode(), np.uint8)
    start = np.array([0, 2048, 4096])
    for found in (word_hashes(data, start, start + 2048), Rolling(BYTE_CODE[data]).of(start, start + 2048)):
        assert found[0] == found[2] and bin(int(found[0]) ^ int(found[1])).count("1") > 8
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**63, 300, dtype=np.uint64)
    twice = Rolling(np.concatenate([codes, codes]))
    at = np.arange(200)
    assert (twice.of(at, at + 90) == twice.of(at + 300, at + 390)).all()
    assert len(np.unique(twice.of(at, at + 90))) == 200
    big = rng.integers(0, PRIME, 1000, dtype=np.uint64) * rng.integers(0, PRIME, 1000, dtype=np.uint64)
    assert (modulo(big) == big % U64(PRIME)).all() and int(modulo(np.array([PRIME], U64))[0]) == 0


def test_structured_words_are_not_confused(spark):
    words = [f"w{k}" for k in range(34)]
    docs = spark.createDataFrame([(0, " ".join([*words, ONE])), (1, " ".join([*words, TWO]))], "doc_id long, text string")
    assert [r.n_removed for r in remove_repeated_passages(docs).collect()] == [0, 0]
    lines = spark.createDataFrame([(0, ONE + "\n" + TWO), (1, ONE + "\n" + ONE)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.n_dup_lines for r in judge_quality(lines, none).collect()} == {0: 0, 1: 1}


def test_structured_bytes_are_not_confused(spark):
    texts = [ONE, TWO]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, want = set(), []
    for k, text in enumerate(texts):
        gone = [False] * len(text)
        for i in range(len(text) - 99):
            if text[i : i + 100] in seen:
                gone[i : i + 100] = [True] * 100
            seen.add(text[i : i + 100])
        want.append((k, sum(gone), hashlib.sha256("".join(c for c, g in zip(text, gone, strict=True) if not g).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in remove_repeated_bytes(docs).collect()) == want

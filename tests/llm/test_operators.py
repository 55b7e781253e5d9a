"""The operators against plain Python on small tables with nulls, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash

from gradeloom.llm.decontaminate import MASKS, STRETCH, decontaminated, overlaps, tolerated
from gradeloom.llm.language_id import identify, keep_identified
from gradeloom.llm.license_scan import scan_licenses
from gradeloom.llm.maxent_lm import score_texts
from gradeloom.llm.quality_forest import judge_quality
from gradeloom.llm.shards import draw_matrix, sharded, shuffle_into_shards
from gradeloom.llm.simhash_dedup import bucket_links, keep_one_of_each, masks_for, near_duplicates
from gradeloom.llm.source_mix import mix_sources, mixed, take_by_length
from gradeloom.llm.substring_dedup import remove_repeated_passages
from gradeloom.llm.suffix_dedup import remove_repeated_bytes

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name long, at long, doc string, tag string, fp string, size string, shard string, path string"
#: Names that working columns might have.
CLASHING = ["row", "score", "lang_pred", "text_", "_text", "_source", "_size", "_crc", "_sum", "nth", "turn", "of", "sum", "slot", "copies", "copy", "size_", "h", "id", "root", "_doc", "_tag", "first"]


def lower(text):
    return text.translate({k: k + 32 for k in range(65, 91)})


def corpus():
    rng = random.Random(3)
    vocabulary = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(150)] for lang, letters in (("aa", "abcdefgh"), ("bb", "mnopqrst"))}
    prose = lambda n, lang="aa": " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    shared, long = prose(60), prose(4000)
    texts = [prose(rng.randint(1, 120), rng.choice(["aa", "bb"])) for _ in range(40)]
    texts += [prose(20) + " " + shared + "\n" + prose(20) for _ in range(6)]
    texts += [shared] * 4 + [long, long + " tail", "x" * 700, "x" * 350 + "y" + "x" * 350, "word " * 90, "a b " * 60, "", " \n\t ", None, None]
    texts += ["é" * 120, " no break " * 30, "Licensed under the Apache License, Version 2.0.\n" + prose(5), "line\nline\nline\n" + prose(30)]
    rows = [(k, t, "aa" if t and t[0] in "abcdefgh" else "bb" if t else None, None if k % 7 == 0 else f"s{k % 3}", 0, 1, 2, "d", "t", "f", "z", "h", None if k % 9 == 0 else f"r/{k % 4}/{k}") for k, t in enumerate(texts)]
    return rows + [rows[3], (None, "null id " + shared) + rows[0][2:], (5, "same id, other text " + shared) + rows[5][2:]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_repeated_passages(docs, empty):
    rows = [(d, WORDS.findall(t or "")) for d, t, *_ in corpus()]
    seen = Counter(tuple(w[i : i + 35]) for _, w in rows for i in range(len(w) - 34))
    want = []
    for d, w in rows:
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((d, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest(), left))
    got = [tuple(r) for r in remove_repeated_passages(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert remove_repeated_passages(empty).count() == 0


def test_repeated_bytes(docs, empty):
    rows = sorted({(d, t) for d, t, *_ in corpus() if d not in (None, 5)}, key=lambda r: r[0])
    clean = docs.filter("doc_id IS NOT NULL AND doc_id <> 5")
    seen, want = set(), {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeated_bytes(clean).collect()}
    assert got == want
    assert remove_repeated_bytes(docs).count() == docs.count() and remove_repeated_bytes(empty).count() == 0


def simhash(text, size):
    w = lower(text or "").encode().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + size]), seed=42) for i in range(max(1, len(w) - size + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(docs, empty):
    rows = [(d, simhash(t, 4)) for d, t, *_ in corpus()]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    want = [(d, f"{f:016x}", least.get(find(k))) for k, (d, f) in enumerate(rows)]
    assert sorted(map(tuple, near_duplicates(docs).collect()), key=str) == sorted(want, key=str)
    assert near_duplicates(empty).count() == 0
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.filter("text is null or trim(text) = ''").count() <= 1 and 40 < kept.count() < docs.count()


def test_masks_share_a_bucket():
    rng = random.Random(2)
    for number in (10, 10**5, 10**8):
        masks = masks_for(number, 4)
        for _ in range(50):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 4):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)


def test_bucket_links_join_all():
    import numpy as np

    found = bucket_links(np.array([0, 15, 255, 2**40], np.uint64), 4)
    assert sum(len(x) for _, x in found) == 3


def test_decontamination(spark, docs, empty):
    passage = " ".join(f"w{k}" for k in range(30))
    words = passage.split()
    changed = list(words)
    for k in (3, 9, 14, 20, 26):
        changed[k] = "other"
    tests = spark.createDataFrame([(1, passage, "t"), (2, None, "t"), (3, "", "t"), (4, "two words", "t"), (5, passage.upper(), "t")], "item_id long, text string, doc_id string")
    more = spark.createDataFrame([(900, "before " + passage + " after"), (901, " ".join(["x"] * 40 + changed)), (902, " ".join(words[:6]) + " not more"), (903, "TWO words"), (904, " ".join(words[10:24])), (905, None)], "doc_id long, text string")
    hit = {(r.doc_id, r.item_id) for r in overlaps(more, tests).collect()}
    assert hit == {(900, 1), (900, 5), (901, 1), (901, 5), (903, 4), (904, 1), (904, 5)}
    assert {(r.doc_id, r.item_id) for r in overlaps(more, tests, block_words=20).collect()} == hit
    assert {r.doc_id for r in decontaminated(more, tests).collect()} == {902, 905}
    assert decontaminated(docs, tests).count() == docs.count() and overlaps(empty, tests).count() == 0
    assert decontaminated(more, tests.limit(0)).count() == 6


def test_masks_find_every_stretch():
    from itertools import combinations

    for bad in combinations(range(STRETCH), tolerated(STRETCH)):
        assert any(all(i + o not in bad for o in m) for m in MASKS for i in range(STRETCH - m[-1]))


def test_base_scores(docs, empty):
    rows = [(d, WORDS.findall(lower(t or "")) + ["\0"]) for d, t, *_ in corpus()]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    count = Counter(w for d, ws in rows if not held(d) for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((str(d), held(d), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 5)) for d, ws in rows)
    got = score_texts(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got) and score_texts(empty).count() == 0


def test_language(docs, empty):
    got = identify(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    blank = {d for d, t, *_ in corpus() if d is not None and not re.search(r"[^\W\d_]", t or "")}
    assert {r.doc_id for r in got if r.lang_pred == "und"} == blank
    assert identify(empty).count() == 0 and keep_identified(docs).columns == docs.columns


def test_shards(docs, empty):
    assert [sum(x) for x in zip(*draw_matrix([5, 0, 9, 3], 4, 1), strict=True)] == [5, 4, 4, 4]
    got = shuffle_into_shards(docs, shards=7).collect()
    by = Counter(r.shard for r in got)
    assert len(got) == docs.count() and max(by.values()) - min(by.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in by.items())
    assert shuffle_into_shards(empty).count() == 0
    assert sorted(map(str, shuffle_into_shards(docs, shards=7).collect())) == sorted(map(str, got))
    assert sharded(docs).count() == docs.count()


def test_mix(docs, empty):
    got = mix_sources(docs).collect()
    assert len(got) == docs.count()
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in got)
    total = sum(r["size"] for r in got)
    goals = {r.source: r.target for r in got}
    assert abs(sum(goals.values()) - 1.5 * total) < 1e-6
    for s, goal in goals.items():
        sizes = [r["size"] for r in got if r.source == s]
        whole = round(goal) // max(1, sum(sizes))
        sums = {whole * sum(sizes)}
        for x in sizes:
            sums |= {y + x for y in sums}
        assert abs(sum(r.taken for r in got if r.source == s) - goal) <= min(abs(y - goal) for y in sums) + 1
    assert mixed(docs).count() == sum(r.copies for r in got) and mix_sources(empty).count() == 0


def test_knapsack_is_exact():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(30):
        length, number = np.unique(rng.integers(2, 40, 5)), None
        number = rng.integers(1, 4, len(length))
        sums = {0}
        for a, k in zip(length.tolist(), number.tolist(), strict=True):
            sums = {s + a * j for s in sums for j in range(k + 1)}
        budget = int(rng.integers(0, (length * number).sum() + 1))
        take = take_by_length(length, number, budget)
        assert (take >= 0).all() and (take <= number).all()
        assert abs(int((length * take).sum()) - budget) == min(abs(s - budget) for s in sums)


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] + [(None, 1), (3, None)], "doc_id long, quality int")
    want = []
    for d, t, *_ in corpus():
        w, seen, lines = WORDS.findall(t or ""), set(), 0
        for line in (t or "").split("\n"):
            lines += bool(WORDS.search(line)) and line in seen
            seen.add(line)
        count, gone = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
        for i in range(len(w) - 7):
            if count[tuple(w[i : i + 8])] > 1:
                gone.update(range(i, i + 8))
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), lines, len(gone), len(w) < 20 or 100 * len(gone) > 30 * len(w)))
    got = judge_quality(docs, labels).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == sorted(want, key=str)
    assert not any(r.kept and r.base_failed for r in got)
    assert judge_quality(empty, labels).count() == 0 and all(r.kept != r.base_failed for r in judge_quality(docs, labels.limit(0)).collect())


def test_licenses(spark, docs, empty):
    rows = [(1, "a/LICENSE", "Licensed under the Apache License, Version 2.0\nmore"), (2, "a/b/c/x", "no words"), (3, "a/b/y", "Released under the MIT License."), (4, "z/q", None), (5, None, "Released under the MIT License."), (6, "w", ""), (7, "a/b/c/d/e", "the licence of nothing in particular")]
    got = {r.doc_id: (r.license, r.origin, r.from_dir) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("Apache-2.0", "own", None), 2: ("MIT", "inherited", "a/b"), 3: ("MIT", "own", None), 4: (None, "none", None), 5: ("MIT", "own", None), 6: (None, "none", None), 7: ("MIT", "inherited", "a/b")}
    assert scan_licenses(docs).count() == docs.count() and scan_licenses(empty).count() == 0


@pytest.mark.parametrize("keep", [keep_identified, keep_one_of_each, mixed, sharded])
def test_columns_with_working_names_stay(docs, keep):
    wide = docs.select("*", *[docs.n_chars.alias(c) for c in CLASHING])
    out = keep(wide)
    assert set(out.columns) == {*wide.columns, *(("shard", "slot") if keep is sharded else ())}
    assert out.count() == keep(docs).count()
    assert out.filter("score <> n_chars or lang_pred <> n_chars").count() == 0


def test_decontaminated_keeps_columns(spark, docs):
    wide = docs.select("*", *[docs.n_chars.alias(c) for c in CLASHING])
    tests = spark.createDataFrame([("t1", "some words that are not there at all in these texts of ours here", 1)], "item_id string, text string, row int")
    assert decontaminated(wide, tests).columns == wide.columns and decontaminated(wide, tests).count() == docs.count()
    named = spark.createDataFrame([("a", "w " * 40 + "these are ten words of a benchmark item in a text " + "w " * 30), (None, None)], "doc_id string, text string")
    item = spark.createDataFrame([("t2", "these are ten words of a benchmark item in a text"), (None, "w w w"), ("t3", "w " * 50)], "item_id string, text string")
    assert {(r.doc_id, r.item_id) for r in overlaps(named, item).collect()} == {("a", "t2"), ("a", None), ("a", "t3")}


def test_ids_of_any_type(spark, docs):
    named = docs.selectExpr("concat('d', doc_id) AS doc_id", "text", "lang", "source")
    for f in (identify, mix_sources, shuffle_into_shards, near_duplicates, score_texts):
        got = f(named)
        assert got.count() == docs.count() and got.schema["doc_id"].dataType.simpleString() == "string"


def test_language_network_gradient():
    import numpy as np

    from gradeloom.llm.language_id import Network

    net, rng = Network(3, 2, 1), np.random.default_rng(2)
    net.p = {n: v.astype(np.float64) for n, v in net.p.items()}
    data, mask, label = rng.integers(97, 100, (5, 4)), rng.random((5, 4)) < 0.8, np.array([0, 1, 1, 0])

    def loss():
        p = net.probabilities(data)[:, np.arange(4), label]
        return -(np.log(p) * mask).sum() / mask.sum()

    for name, g in net.gradient(data, mask, label).items():
        flat, values = net.p[name].reshape(-1), g.reshape(-1)
        for k in np.argsort(-np.abs(values))[:4]:
            flat[k] += 1e-3
            up = loss()
            flat[k] -= 2e-3
            down = loss()
            flat[k] += 1e-3
            assert abs((up - down) / 2e-3 - values[k]) < 2e-3, name


def test_language_is_learned(spark):
    rng = random.Random(8)
    letters = {"xx": "abcdefghij ", "yy": "hijklmnopq ", "zz": "opqrstuvwa "}
    rows = [(k, "".join(rng.choice(letters[lang]) for _ in range(200)), lang) for k in range(240) for lang in [sorted(letters)[k % 3]]]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(got[k].lang_pred, lang) for k, _, lang in rows if got[k].held_out]
    assert len(held) > 20 and sum(a == b for a, b in held) >= 0.95 * len(held)


def test_forest_paths_and_threshold():
    import numpy as np

    from gradeloom.llm.quality_forest import Forest, best_threshold

    rng = np.random.default_rng(5)
    rows = np.concatenate([rng.normal(0, 1, (400, 3)), [[9, 9, 9]]])
    forest = Forest(rows, 20, 64, 1)

    def mean_search(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def path(x, tree, node=0):
        feature, at, left, right, length = (c[node] for c in tree)
        return length if feature < 0 else path(x, tree, int(left if x[int(feature)] <= at else right))

    for x in (rows[0], rows[7], rows[-1]):
        mean = sum(path(x, t) for t in forest.trees) / 20
        assert abs(2 ** (-mean / mean_search(64)) - forest.oddness(x[None])[0]) < 1e-9
    assert forest.oddness(rows)[-1] == forest.oddness(rows).max()
    for tree in forest.trees:  # leaves at depth d with n rows count d and the mean search in n rows
        assert tree[4].max() <= forest.depth + mean_search(64)
    good, bad = rng.integers(0, 5, 22).astype(float), rng.integers(0, 5, 22).astype(float)
    gain = [bad[k:].sum() / bad.sum() - 2 * good[k:].sum() / good.sum() for k in range(23)]
    k = round(best_threshold(good, bad, 2.0, good.sum(), bad.sum()) * 20)
    assert max(gain) <= 0 or abs(gain[k] - max(gain)) < 1e-9


def test_licenses_in_headers_and_files(spark):
    from gradeloom.llm.license_scan import TEMPLATES

    mit, bsd = TEMPLATES["MIT"][1], TEMPLATES["BSD-3-Clause"][1]
    rows = [
        (1, "a/LICENSE.txt", "Somebody 2020\n\n" + "\n".join(mit.split(". "))),
        (2, "a/x.py", "import os\nprint(1)"),
        (3, "b/y.c", "/*\n * " + "\n * ".join(bsd.split(", ")) + "\n */\nint main() { return 0; }\n" * 3),
        (4, "c/z.js", "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/.\n\nlet x = 1;\n"),
        (5, "d/plain.txt", "words of no matter here\nand then some more of them\nThis Source Code Form is subject to the terms of the Mozilla Public\nLicense, version 2.0\nand the text goes on and on about quite other things"),
        (6, "e/COPYING", "nothing that any template says"),
    ]
    got = {r.doc_id: (r.license, r.origin) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("BSD-3-Clause", "own"), 4: ("MPL-2.0", "own"), 5: ("MPL-2.0", "own"), 6: (None, "none")}


def test_license_cosine_by_brute_force(spark):
    from gradeloom.llm.license_scan import part_licenses

    rng = random.Random(4)
    pool = ["grant", "use", "copy", "free", "terms", "law", "the", "of", "v1.0", "v2.0"]
    templates = [(f"L{k}", " ".join(rng.choices(pool, k=rng.randint(2, 9)))) for k in range(5)]
    parts = [(f"k{k}", " ".join(rng.choices([*pool, "other", "words"], k=rng.randint(1, 12)))) for k in range(40)]
    bags = {k: Counter(t.lower().split()) for k, t in parts}
    given = [(name, Counter(t.split())) for name, t in set(templates)]
    number = len(bags) + len(given)
    df = Counter(w for bag in [*bags.values(), *[b for _, b in given]] for w in bag)
    weigh = lambda bag: {w: n * (math.log((number + 1) / (df[w] + 1)) + 1) for w, n in bag.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = {}
    for k, bag in bags.items():
        v = weigh(bag)
        scores = [(-round(sum(x * weigh(t).get(w, 0) for w, x in v.items()) / norm(v) / norm(weigh(t)), 6), name) for name, t in given if set(t) & set(bag)]
        if scores:
            want[k] = (min(scores)[1], -min(scores)[0])
    got = part_licenses(spark.createDataFrame(parts, "key string, part string"), spark.createDataFrame(templates, "license string, text string")).collect()
    assert {r.key: r.license for r in got} == {k: v[0] for k, v in want.items()}
    assert all(abs(r.similarity - want[r.key][1]) < 2e-6 for r in got)


def test_bytes_of_a_name_with_many_uses(docs, monkeypatch):
    from gradeloom.llm import suffix_dedup

    clean = docs.filter("doc_id IS NOT NULL AND doc_id <> 5")
    want = sorted(map(tuple, remove_repeated_bytes(clean).collect()), key=str)
    monkeypatch.setattr(suffix_dedup, "LARGE_NAME", 2)
    assert sorted(map(tuple, remove_repeated_bytes(clean).collect()), key=str) == want


def test_rows_without_id_keep_to_themselves(spark):
    passage = " ".join(f"w{k}" for k in range(40))
    rows = [(None, passage), (None, passage)] + [(None, f"text{k} that has nothing in common with others " + " ".join(f"x{k}y{j}" for j in range(40))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted(r.n_removed for r in remove_repeated_passages(docs).collect()) == [0] * 300 + [40, 40]
    assert remove_repeated_bytes(docs).filter("n_removed > 0").count() <= 2

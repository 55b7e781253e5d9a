"""The model learns from every token place, its probabilities sum to one and its gradient is that of the likelihood."""

import numpy as np
import pytest

from gradeloom.llm import maxent_lm as lm


def texts_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.fixture()
def fitted(spark):
    docs = texts_of(spark, *[" ".join(f"word{k % (7 + n)}" for k in range(60)) for n in range(5)])
    lexicon = lm.Lexicon.of(lm.count_words(docs))
    rows = lm.encoded(docs, lexicon, "doc_id", "text", 7, -1)
    return lexicon, rows


def features(lexicon, rows):
    column = rows.select("codes").toArrow().column("codes").combine_chunks()
    ((_, _, code, edge),) = lm.coded(column)
    group, place, count = lexicon.of_codes(code)
    return code, group, place, count, lm.histories(code, group, lm.positions(edge))


def test_every_place_trains(fitted):
    lexicon, rows = fitted
    model = lm.train(rows, lexicon, 1, 0.1)
    _, _, _, _, (of_class, of_word) = features(lexicon, rows)
    assert model.weights[0][of_class].any(axis=2).all() and model.weights[1][of_word].any(axis=2).all()
    parts = lm.train(rows, lexicon, 2, 0.1)
    assert parts.weights[0][of_class].any(axis=2).all()


def test_probabilities_sum_to_one(fitted):
    lexicon, rows = fitted
    model = lm.train(rows, lexicon, 2, 0.5)
    _, group, place, _, (of_class, of_word) = features(lexicon, rows)
    for k, buckets, base, number in ((0, of_class, np.zeros(len(group), np.int64), lm.CLASSES), (1, of_word, group, lm.PLACES)):
        shares = model.shares(k, buckets, base)
        assert shares.shape[1] == number and np.allclose(shares.sum(axis=1), 1, atol=1e-5)
    # the words of the shared place, with the unseen one, sum to its probability
    others = lexicon.types - np.bincount(lexicon.group[lexicon.place > 0], minlength=lm.CLASSES)
    shared = lexicon.place == 0
    for c in range(lm.CLASSES):
        words = lexicon.count[shared & (lexicon.group == c)]
        assert words.sum() + len(words) + 1 == lexicon.table[c, 0] + others[c] + 1


def test_gradient_is_that_of_the_likelihood(fitted):
    lexicon, rows = fitted
    model = lm.train(rows, lexicon, 1, 0.3)
    _, group, place, _, (of_class, of_word) = features(lexicon, rows)
    for k, buckets, base, chosen in ((0, of_class, np.zeros(len(group), np.int64), group), (1, of_word, group, place)):
        model.weights[k] = model.weights[k].astype(np.float64)
        model.bases[k] = model.bases[k].astype(np.float64)
        which, _, total = model.gradient(k, buckets, base, chosen)
        loss = lambda: -np.log(model.shares(k, buckets, base)[np.arange(len(chosen)), chosen]).sum()  # noqa: E731, B023
        for row in (0, len(which) // 2, len(which) - 1):
            for choice in (0, 3, int(chosen[0])):
                at = (which[row], choice)
                model.weights[k][at] += 1e-4
                up = loss()
                model.weights[k][at] -= 2e-4
                down = loss()
                model.weights[k][at] += 1e-4
                assert abs((up - down) / 2e-4 - total[row, choice]) < 1e-3


def test_words_are_ranked_on_all_texts(spark, monkeypatch):
    rows = spark.range(8000).selectExpr("id AS doc_id", "concat(CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd odd' END, ' all all all', CASE WHEN id < 4001 THEN ' more' ELSE '' END) AS text")
    counted = lm.count_words(rows)
    assert sorted(r.c for r in counted.collect()) == [4000, 4001, 8000, 8000, 24000]
    monkeypatch.setattr(lm, "FREQUENT", 3)
    assert sorted(lm.Lexicon.of(counted).count.tolist()) == [8000, 8000, 24000]


def test_learns_what_follows_what(spark):
    texts = ["a b c d e f g h " * 20, "h g f e d c b a " * 20] * 30
    got = lm.score_texts(texts_of(spark, *texts), rounds=2).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.score > 0.5 * r.base_score for r in held)


def test_text_ids_and_many_nulls(spark):
    docs = spark.createDataFrame([(None, f"alone{k} twice twice") for k in range(50)] + [("x", "twice")], "doc_id string, text string")
    got = lm.score_texts(docs).collect()
    assert len(got) == 51 and {r.n_tokens for r in got if r.doc_id is None} == {4}

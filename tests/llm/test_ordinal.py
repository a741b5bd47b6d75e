import random

import numpy as np
import pytest

from lodestone.llm import ordinal


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        grade = rng.choice([0, 1, 2, 2, 2])
        own = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        if grade == 0:
            own = [w.upper() + "!!" for w in own]
        if grade == 1:
            own[rng.randrange(len(own))] = rng.choice(["nasty", "vile"])
        rows.append((i, " ".join(own), grade))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(1500, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, truth int")
    model = ordinal.train(docs, docs.filter("doc_id < 1000").selectExpr("doc_id", "truth grade"))
    assert (np.diff(model.thresholds) > 0).all()
    scored = ordinal.classify(docs.filter("doc_id >= 1000"), model).collect()
    assert np.mean([r.selected == (r.truth == 2) for r in scored]) > 0.97
    by = [np.mean([r.expected_grade for r in scored if r.truth == k]) for k in range(3)]
    assert by[0] < 0.3 < by[1] < 1.6 < by[2]
    assert all(0 <= r.tail_probability <= 1 and r.tail_probability <= r.expected_grade + 1e-9 for r in scored)


def test_gradient_fits_the_likelihood():
    rng = np.random.default_rng(0)
    x = rng.normal(size=3000)
    y = (2 * x + rng.logistic(size=3000) > -1).astype(int) + (2 * x + rng.logistic(size=3000) > 1.5)
    model = ordinal.fit([(int(k), np.array([5], "i4"), np.array([v], "f4")) for k, v in zip(y, x)], 3)
    assert model.weights[5] == pytest.approx(2, abs=0.3) and model.thresholds == pytest.approx([-1, 1.5], abs=0.5)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, True), (1, None, True), (2, "", None), (None, "x " * 50_000, None)], "doc_id long, text string, selected boolean")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")
    model = ordinal.train(docs, ordinal.graded(labels))
    rows = ordinal.classify(docs, model).collect()
    assert len(rows) == 4 and rows[0][1:] == rows[1][1:]
    nothing = ordinal.train(docs, ordinal.graded(labels.limit(0)))
    assert all(r.selected for r in ordinal.classify(docs, nothing).collect())
    assert ordinal.classify(docs.limit(0), nothing).count() == 0


def test_grades(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 0, 1), (5, None, 0), (6, 1, None)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.grade for r in ordinal.graded(labels).collect()} == {1: 2, 2: 1, 3: 0, 4: 0}


def test_gradient_is_that_of_finite_differences():
    rng = np.random.default_rng(3)
    n, d, grades = 40, 6, 4
    owner = np.repeat(np.arange(n), 3)
    column, values = rng.integers(0, d, 3 * n), rng.normal(size=3 * n)
    y, theta = rng.integers(0, grades, n), np.concatenate([rng.normal(size=d), [-0.5, 0.1, -0.3]])
    _, slope = ordinal.loss_and_slope(y, column, values, owner, theta, grades)
    for i in range(len(theta)):
        step = np.zeros(len(theta))
        step[i] = 1e-6
        up, down = (ordinal.loss_and_slope(y, column, values, owner, theta + s, grades)[0] for s in (step, -step))
        assert slope[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_scores_like_plain_sums(spark):
    """Grades and tails of every row, from the features and weights, one at a time."""
    rows = corpus(300, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, truth int")
    model = ordinal.train(docs, docs.selectExpr("doc_id", "truth grade"))
    scored = {r.doc_id: r for r in ordinal.classify(docs, model).collect()}
    for i, text, _ in rows:
        slots, values = ordinal.features(text)
        score = sum(float(model.weights[s]) * float(v) for s, v in zip(slots, values))
        tails = [1 / (1 + np.exp(c - score)) for c in model.thresholds]
        assert scored[i].tail_probability == pytest.approx(tails[-1], abs=1e-9) and scored[i].expected_grade == pytest.approx(sum(tails), abs=1e-9)
        assert scored[i].selected == (scored[i].tail_probability >= ordinal.CUT)


def test_a_tie_at_the_cut_is_selected(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")
    model = ordinal.Model(np.zeros(ordinal.WIDTH), np.array([-1.0, 0.0]))
    assert [r.selected for r in ordinal.classify(docs, model, cut=0.5).collect()] == [True, True]
    assert [r.selected for r in ordinal.classify(docs, model, cut=0.5000001).collect()] == [False, False]


def test_a_repeated_document_is_fitted_once(spark):
    docs = spark.createDataFrame([(1, "good words here")] * 500 + [(1, "other words"), (2, "BAD!!")], "doc_id long, text string")
    ratings = spark.createDataFrame([(1, 2), (1, 2), (2, 0)], "doc_id long, grade int")
    once = spark.createDataFrame([(1, min(["good words here", "other words"], key=lambda t: spark.range(1).selectExpr(f"xxhash64('{t}') h").first()[0])), (2, "BAD!!")], "doc_id long, text string")
    a, b = ordinal.train(docs, ratings), ordinal.train(once, ratings.distinct())
    assert (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()


def test_long_tokens_count_whole():
    assert ordinal._shape("aA" * 40 + "1") != ordinal._shape("aA" * 40 + "!")

"""Learned models against slow versions: a kernel on sets with a dense ridge, and a likelihood
whose slope is taken by finite differences."""

import random
import re

import numpy as np
import pytest

from lakelens.llm import langid, quality


def texts(rng, n):
    sounds = ["ka lo mi tu re na".split(), "sch ung eit ber zu ig".split(), "que ción ado mente la".split()]
    out = []
    for i in range(n):
        words = ["".join(rng.choices(sounds[i % 3], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 30))]
        out.append(" ".join(words) + rng.choice(["", ".", " 12!", "\n"]))
    return out, np.arange(n) % 3


def grams(text):
    letters = re.sub(r"[^a-zà-ÿ]+", " ", text.lower())
    return {letters[i:i + n] for n in range(1, langid.LONGEST + 1) for i in range(len(letters) - n + 1)}


def test_kernel_is_that_of_sets():
    rows, _ = texts(random.Random(1), 80)
    x, has = langid.presence(rows, langid._letters())
    sets = [grams(t) for t in rows]
    want = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    assert has.all() and np.abs(langid.kernel(x, x) - want).max() < 0.05  # places are hashed


def test_landmarks_predict_as_a_dense_ridge_does(spark):
    rows, y = texts(random.Random(2), 200)
    names = ["aa", "bb", "cc"]
    docs = spark.createDataFrame([(i, t, names[y[i]]) for i, t in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    sets = [grams(t) for t in rows]
    dense = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    dual = np.linalg.solve(dense + 1e-2 * np.eye(len(rows)), (y[:, None] == np.arange(3)).astype(float))
    got, _ = model.score(rows, langid._letters())
    plain = [names[i] for i in (dense @ dual).argmax(1)]
    assert np.mean([a == b for a, b in zip(got, plain)]) > 0.97


def loss(params, x, y, grades, weight):
    """Penalised negative log likelihood, row by row."""
    w, cuts = params[:x.shape[1]], params[x.shape[1]:]
    t = [cuts[0]]
    for gap in cuts[1:]:
        t.append(t[-1] + np.exp(gap))
    total = 0.0
    for row, grade, share in zip(x, y, weight / weight.sum()):
        above = [1.0, *[1 / (1 + np.exp(c - row @ w)) for c in t], 0.0]
        total -= share * np.log(max(above[grade] - above[grade + 1], 1e-9))
    return total + quality.RIDGE / 2 * w @ w


@pytest.mark.parametrize("grades", [2, 4])
def test_fit_is_at_the_top_of_the_likelihood(grades):
    rng = np.random.default_rng(grades)
    x = rng.normal(size=(150, 3))
    y = np.digitize(x @ [1.0, -1.5, 0.5] + rng.logistic(size=150), np.linspace(-1.5, 1.5, grades - 1))
    weight = rng.random(150) + 0.5
    model = quality.fit_ordinal(x, y, grades, weight)
    t = model.thresholds
    params = np.concatenate([model.weights.astype(float), t[:1], np.log(np.maximum(np.diff(t), 1e-12))])
    here = loss(params, x, y, grades, weight)
    slope = np.array([(loss(params + d, x, y, grades, weight) - loss(params - d, x, y, grades, weight)) / 2e-5
                      for d in np.eye(len(params)) * 1e-5])
    assert np.abs(slope).max() < 5e-3
    for _ in range(20):  # nothing near is better
        assert loss(params + rng.normal(size=len(params)) * 0.05, x, y, grades, weight) > here - 1e-4

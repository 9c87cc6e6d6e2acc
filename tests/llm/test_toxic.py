"""The clause grammar against its parts, its order of kinds, and what labels can and cannot change."""

import random

import numpy as np
import pyarrow as pa

from brute import SCHEMA
from lakelens.llm import toxicity as tox

K = tox.KINDS


def test_machine_is_its_parts_side_by_side():
    rng = random.Random(1)
    strings = [[rng.randrange(6) for _ in range(rng.randrange(1, 40))] for _ in range(300)]
    flat = np.array([s for x in strings for s in x], np.int8)
    lengths = np.array([len(x) for x in strings])
    starts = np.cumsum(lengths) - lengths
    for parts, backwards in ((tox.PARTS, False), ((tox.AIM, tox.REPORTED), True), ((tox.NEGATE,), False)):
        got = tox.read(tox.arrays(tox.compose(parts)), flat, starts, lengths, backwards)
        for x, start in zip(strings, starts):
            for column, part in enumerate(parts):
                state = 0
                for i in (reversed(range(len(x))) if backwards else range(len(x))):
                    want = (state, x[i]) in part.emits if part.emits else state > 0
                    assert got[start + i, column] == want
                    state = part.moves[state][x[i]]


def grammar(kinds=None):
    weights = tox.prior() if kinds is None else kinds
    return tox.Grammar({"blorf": 2.0}, {"zork": 1.0}, weights, -1.0)


def kinds_at(text):
    found = grammar().matches(text)
    return {k: float(found[i]) for k, i in K.items() if found[i]}


def test_clauses():
    assert kinds_at("a blorf here") == {(0, False, False, False): 2.0}
    assert kinds_at("you are a blorf") == kinds_at("such a blorf, you know") == {(0, True, False, False): 2.0}
    assert kinds_at("blorf you.") == {(0, True, False, False): 2.0} and kinds_at("blorf. You") == {(0, False, False, False): 2.0}
    assert kinds_at("it was not a zorkish one") == {(0, False, True, False): 1.0}
    assert kinds_at("a blorf, it is said") == {(0, False, False, True): 2.0}
    assert kinds_at("i will kill you") == {(1, False, False, False): 1.0}
    assert kinds_at("kill. you") == {} and kinds_at("") == {} and kinds_at("never kill the time") == {}
    many = ["", "x " * 3000 + "blorf", "blorf\nblorf! you blorf " * 50, "é blorf你 b"]
    assert (grammar().matches_many(pa.array([*many, None])) == np.stack([grammar().matches(t) for t in [*many, ""]])).all()


def test_context_changes_scores():
    g = grammar()
    plain, aimed, negated, quoted, nothing = (g.score(t) for t in (
        "a blorf here", "you are a blorf", "it is not a blorf", "a blorf, she wrote and left", "nothing here at all"))
    assert nothing < negated < plain < aimed and nothing < quoted < plain


def rows(rng, n, shape):
    """Texts of which a third hold the word; ``shape`` says in which clause, and the label."""
    texts, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(40)]
        clause, label = shape(i)
        words[20:20] = [".", *clause, "."]
        texts.append(" ".join(words))
        labels.append(label)
    return texts, labels


def fitted(spark, shape, n=900):
    texts, labels = rows(random.Random(7), n, shape)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    marks = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "doc_id long, toxic int")
    return tox.fit(docs, marks)


def test_words_alone_do_not_score_where_labels_do_not_say_so(spark):
    """Toxic where somebody is addressed, clean where the word stands alone."""
    g = fitted(spark, lambda i: [(["you", "blorf"], 1), (["a", "blorf"], 0), (["a", "b"], 0), (["you", "b"], 0),
                                 (["c", "d"], 0), (["e"], 0)][i % 6] if i % 6 > 1 or i % 60 < 42 else (["e"], 0))
    if g.words:
        assert g.score("xx a blorf yy") <= g.score("xx a cc yy") < g.score("xx you blorf yy")
    else:
        assert g.score("xx a blorf yy") == g.score("")


def test_labels_cannot_turn_a_negation_round(spark):
    g = fitted(spark, lambda i: [(["not", "a", "blorf"], 1), (["a", "blorf"], 1), (["x"], 0), (["not"], 0)][i % 4])
    assert g.words and g.score("it was not a blorf") <= g.score("it was just a blorf")
    order = g.kinds
    for base in (0, 1):
        for a in (False, True):
            for other in (False, True):
                assert order[K[base, a, True, other]] <= order[K[base, a, False, other]]
                assert order[K[base, a, other, True]] <= order[K[base, a, other, False]]
                assert order[K[base, True, a, other]] >= order[K[base, False, a, other]]


def test_scores_by_hand():
    g = grammar()
    found = np.zeros(len(K) + 1)
    found[K[0, True, False, False]], found[-1] = 2.0, 100 / 4
    line = np.log1p(found) @ g.kinds + g.bias
    assert abs(g.score("you are a blorf") - 1 / (1 + np.exp(-line))) < 1e-12


def test_very_long_and_repeated_texts(spark):
    long = "word " * 200_000 + "you blorf"
    table = spark.createDataFrame([(1, long, "en", "s", 0), (1, long, "en", "s", 0), (2, None, None, None, None)], SCHEMA)
    got = tox.detect(table, grammar=grammar()).collect()
    scores = sorted(r.score for r in got)
    assert len(got) == 3 and scores[1] == scores[2] > scores[0]

import random

import numpy as np
import pytest

from brute import SCHEMA, components
from lakelens.llm import near


def words(n, rng):
    return ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def rows():
    rng = random.Random(3)
    out = []
    base = words(120, rng)
    for k in range(40):  # a chain: neighbours are alike, ends are not
        start = k * 2
        out.append((100 + k, " ".join(words(0, rng) + (base + words(0, rng))[start:start + 60] + ["end"])))
    passage = words(80, rng)
    for k in range(60):  # a passage with more and more text of its own
        out.append((300 + k, " ".join(passage + words(k, rng))))
    star = words(100, rng)
    out.append((500, " ".join(star)))
    for k in range(30):  # copies like their source, but not like each other
        copy = list(star)
        at = rng.randrange(90)
        copy[at:at + 3] = words(3, rng)
        out.append((501 + k, " ".join(copy)))
    out += [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two"), (6, "one two three"), (7, "one two"),
            (7, "one two"), (None, "one two"), (None, "alone here now and then"), (8, "x" * 50_000)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("size", [4, 5])
def test_components(spark, size):
    data = rows()
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], SCHEMA).withColumnRenamed("n_chars", "row")
    sets, want = components(data, size, 80)
    expected = sorted(((i, len(s), c if s else i) for (i, _), s, c in zip(data, sets, want)), key=repr)
    got = near.near_classes(table, size, 0.8)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == expected


def test_one_of_each_class_stays(spark):
    data = rows()
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], SCHEMA)
    _, want = components(data, 5, 80)
    kept = [(r.doc_id, r.text) for r in near.deduplicated(table).collect()]
    wordless = {(i, t) for i, t in data if not (t or "").strip()}
    ids = {c for (i, t), c in zip(data, want) if (i, t) not in wordless}
    assert sorted((i for i, t in kept if (i, t) not in wordless), key=repr) == sorted(ids, key=repr)
    assert wordless <= set(kept) and len(kept) == len(wordless) + len(ids)


def test_all_rows_without_words_stay(spark):
    data = [(None, None), (None, ""), (None, " \t\n"), (1, ""), (1, ""), (None, "one two"), (None, "one two"), (2, "\u00a0")]
    table = spark.createDataFrame([(i, t, "en", str(k), k) for k, (i, t) in enumerate(data)], SCHEMA)
    kept = near.deduplicated(table.withColumnRenamed("n_chars", "_row"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "_row"]
    places = sorted(r._row for r in kept.collect())
    assert places[:5] == [0, 1, 2, 3, 4] and places[5] in (5, 6) and places[6:] == [7]


def test_empty(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert near.near_classes(table).count() == 0
    assert near.deduplicated(table).columns == table.columns


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (300, 500))
    whole, left, right = near.sketches([np.unique(np.concatenate([a, b])), a, b])
    assert (whole == np.maximum(left, right)).all()
    hits = 0
    for k in range(50):
        x = rng.integers(0, 2**63, 1000).astype(np.uint64)
        p, q = np.unique(x[:900]), np.unique(x[100:])  # 0.8
        s = near.sketches([p, q, np.unique(x[500:])])
        size = np.array([float(len(p))])
        hits += bool(near.may_be_alike(s[:1], s[1:2], size, size, near._margin(0.8))[0])
        assert not near.may_be_alike(s[:1], s[2:], size, np.array([500.0]), near._margin(0.8))[0]
    assert hits == 50


def test_long_bucket_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 4)
    test_components(spark, 4)


def test_pairs_that_the_estimate_refuses_are_verified(spark, monkeypatch):
    monkeypatch.setattr(near, "_margin", lambda similarity: 0.995)
    test_components(spark, 4)


def test_linking_joins_what_all_pairs_would():
    rng = random.Random(5)
    data = [(i, t) for i, t in rows() if t and t.strip() and i is not None]
    import pyarrow as pa

    from lakelens.llm.shingles import shingle_sets
    sets = shingle_sets(pa.array([t for _, t in data]), 4)
    v = np.arange(len(data))
    a, b = near.linking(sets, v, v.copy(), np.zeros(len(v), int), 80)
    root = list(range(len(v)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a, b):
        root[find(x)] = find(y)
    _, want = components(data, 4, 80)
    seen = {}
    for i in range(len(v)):
        assert seen.setdefault(find(i), want[i]) == want[i]
    assert len(seen) == len(set(want))
    del rng

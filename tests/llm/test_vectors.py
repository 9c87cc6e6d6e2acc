"""Vector codes, near-duplicate vectors and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from lakelens.llm import codes, resampling, semdedup

VECTORS = "vec_id long, embedding array<float>, label int, vec string, v int, key string"


def table(spark, rows):
    """Rows (vec_id, embedding, label) with columns whose names the operators use too."""
    return spark.createDataFrame([(*r, "x", 1, "k") for r in rows], VECTORS)


def clustered(n, dim, seed, labels=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(7, dim))
    x = middle[rng.integers(0, 7, n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.2, 1.0], n)[:, None]
    return [(int(i), v, int(rng.integers(0, labels))) for i, v in enumerate(x.astype(np.float32).tolist())]


AWKWARD = [(None, [0.5] * 8, None), (3, None, 1), (3, [1.0] * 7 + [None], 1), (4, [float("nan")] * 8, 1),
           (5, [float("inf")] * 8, 2), (6, [0.0] * 8, 1), (6, [0.0] * 8, 1), (7, [0.5] * 8, None), (8, [1.0, 2.0], 1),
           (8, [1.0, 2.0], 1), (9, [], 1), (10, [-0.0] * 7 + [1.0], 2), (11, [0.0] * 7 + [1.0], 2),
           (None, [0.0] * 7 + [1.0], 2), (12, [3e38] * 8, 2), (13, [1e-42] * 8, 2)]


def lloyd(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Codes, errors and digest by all distances, in Python's integers."""
    sound = [(i, [math.floor(c * scale) for c in v], lab) for i, v, lab in rows
             if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    lengths = {}
    for _, v, _ in sound:
        if v:
            lengths[len(v)] = lengths.get(len(v), 0) + 1
    dim = min(lengths, key=lambda d: (-lengths[d], d))
    limit = codes.largest_component(dim)
    fits = lambda v: len(v) == dim and all(-limit <= c < limit for c in v)
    good = sorted((r for r in sound if fits(r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda v, p: v[p * dim // parts:(p + 1) * dim // parts]
    books = [[cut(v, p) for _, v, _ in good[:entries]] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        own = [[min(range(len(books[p])), key=lambda e: (square(cut(v, p), books[p][e]), e)) for p in range(parts)]
               for _, v, _ in good]
        if turn < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [cut(v, p) for (_, v, _), o in zip(good, own) if o[p] == e]
                    if mine:
                        books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    error = [sum(square(cut(v, p), books[p][o[p]]) for p in range(parts)) for (_, v, _), o in zip(good, own)]
    sums = {}
    for (_, _, lab), e in zip(good, error):
        sums[lab] = sums.get(lab, 0) + e
    text = ",".join(str(c) for book in books for e in book for c in e)
    digest = hashlib.sha256(text.encode()).hexdigest()
    out = [(i, "".join(f"{x:02x}" for x in o), e, sums[lab], digest) for (i, _, lab), o, e in zip(good, own, error)]
    return out + [(i, None, None, sums.get(lab), digest) for i, v, lab in sound if not fits(v)]


@pytest.mark.parametrize("dim", [8, 20])
def test_codes(spark, dim):
    rows = clustered(300, dim, dim) + (AWKWARD if dim == 8 else [])
    got = codes.compress(table(spark, rows).repartition(5)).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(lloyd(rows), key=repr)


def test_codes_of_few_and_none(spark):
    rows = [(5, [1.0] * 8, 1), (2, [1.0] * 8, None), (2, [2.0] * 8, None)]
    got = codes.compress(table(spark, rows)).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(lloyd(rows), key=repr)
    assert codes.compress(table(spark, rows).limit(0)).count() == 0
    one = codes.compress(table(spark, [(1, [], None), (2, None, 1)])).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in one] == [(1, None, None, None)]


def test_bounds_decide_as_all_distances_do():
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (500, 3))  # many ties
    book = rng.integers(-3, 4, (16, 3))
    bounds, paid, b = codes.Bounds.fresh(x, book, 6), 0, 6
    for turn in range(8):
        after = book + rng.integers(-1, 2, book.shape) * (rng.random((16, 1)) < 0.3)
        b = max(2, b - 1)
        bounds = codes.Bounds.unpacked(bounds.packed(), bounds.near.shape[1])
        bounds.kept(b)
        bounds.moved(np.sqrt(((after - book) ** 2).sum(1)))
        used, cost = bounds.decide(x, after)
        square = codes.exact(x, after)
        assert (bounds.own == square.argmin(1)).all()
        away = np.sqrt(np.take_along_axis(square, bounds.near.astype(int), 1))
        assert (bounds.lower[:, :-1] <= away).all() and (bounds.upper >= np.sqrt(square.min(1))).all()
        book, paid = after, paid + cost
    far = np.concatenate([x % 2 + 40 * i for i in range(16)])  # clusters far apart: nothing is open
    book = np.array([[40 * i] * 3 for i in range(16)])
    bounds = codes.Bounds.fresh(far, book, 4)
    bounds.moved(np.full(16, 1.0))
    assert bounds.decide(far, book + np.array([1, 0, 0]))[1] == 0


def classes(rows, least=0.93):
    n = len(rows)
    unit = []
    for _, v, lab in rows:
        fine = v and lab is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)
        unit.append(semdedup.units(np.array([v], np.float64))[0] if fine else None)
    link = [[i != j and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2]
             and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= least for j in range(n)] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            k = todo.pop()
            for j in range(n):
                if link[k][j] and j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        kept = None if comp is None or rows[i][0] is None else rows[i][0] == comp
        out.append((rows[i][0], sum(link[i]), comp, kept))
    return out


@pytest.mark.parametrize("block, tile", [(1024, 16 << 20), (7, 200)])
def test_vector_classes(spark, monkeypatch, block, tile):
    monkeypatch.setattr(semdedup, "PER_CELL", 4)
    rows = clustered(250, 8, 9, labels=2) + AWKWARD
    got = semdedup.vector_classes(table(spark, rows).repartition(4), block=block, tile_bytes=tile)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(classes(rows), key=repr)


def test_tight_and_copied_groups(spark):
    """Half exact copies, half near copies of another vector: every row is linked with all of its group."""
    rng = np.random.default_rng(2)
    base = np.eye(16)[1]
    near = (base + rng.normal(size=(300, 16)) * 1e-3).astype(np.float32).tolist()
    rows = [(i, np.eye(16)[0].tolist(), 1) for i in range(300)] + [(300 + i, v, 1) for i, v in enumerate(near)]
    got = semdedup.vector_classes(table(spark, rows), block=16, tile_bytes=1000).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(299, 0), (299, 300)}
    assert sorted(r.vec_id for r in got if r.kept) == [0, 300]


def test_bound_of_spans():
    rng = np.random.default_rng(3)
    to = semdedup.units(rng.normal(size=(4, 6)))
    for spread in (0.01, 0.1, 0.5):
        for _ in range(60):
            a, b = (semdedup.units(rng.normal(size=6) + rng.normal(size=(20, 6)) * spread) for _ in range(2))
            x, y = semdedup.angles(a, to), semdedup.angles(b, to)
            kind = semdedup.bound(x.min(0), x.max(0), y.min(0), y.max(0), math.acos(0.93))
            hits = (a @ b.T >= 0.93)
            assert kind == semdedup.SOME or hits.all() == hits.any() == (kind == semdedup.ALL)


def test_no_vectors(spark):
    assert semdedup.vector_classes(table(spark, AWKWARD).limit(0)).count() == 0
    alone = semdedup.vector_classes(table(spark, [(1, None, 1), (2, [0.0], 1)])).collect()
    assert sorted(map(tuple, alone)) == [(1, 0, 1, True), (2, 0, 2, True)]


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    words = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return len(words), [zlib.crc32(b" ".join(words[i:i + k])) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain_resample(docs, goal, percent, least):
    feats = [plain_features(t) for _, t in docs]
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for _, f in feats:
        np.add.at(s, f, 1)
    for text in goal:
        np.add.at(t, plain_features(text)[1], 1)
    gain = [math.floor(1000 * math.log((float(t[b]) + 1) * (float(s.sum()) + 10_000)
                                       / ((float(s[b]) + 1) * (float(t.sum()) + 10_000)))) for b in range(10_000)]
    rows = []
    for (doc, _), (n, f) in zip(docs, feats):
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((doc, len(f), n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = [r for r in rows if r[2] >= least]
    drawn = sorted(able, key=lambda r: (-r[4], r[0] is None, r[0] or 0))[:len(able) * percent // 100]
    ranks = {}
    for i, r in enumerate(drawn):
        ranks.setdefault(r, []).append(i + 1)
    return [(*r, ranks[r].pop(0) if ranks.get(r) else None) for r in rows]


def test_resample(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdeXYéß0") for _ in range(rnd.randint(1, 9))) for _ in range(400)] + ["w" * 90]
    text = lambda: rnd.choice([" ", "-_", ". "]).join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))
    docs = [(i, text()) for i in range(150)] + [(7, None), (None, text()), (8, ""), (9, "?!"), (3, "Hot " * 70_000)]
    docs += [docs[5]] * 4
    goal = [text() for _ in range(10)] + [None, ""]
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, rank int, weight int")
    target = spark.createDataFrame([(i, t) for i, t in enumerate(goal)], "item_id int, text string")
    for percent, least in ((5, 20), (40, 0)):
        got = resampling.resample(frame.repartition(3), target, percent, least)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_resample(docs, goal, percent, least), key=repr)
    assert resampling.resample(frame.limit(0), target).count() == 0
    assert resampling.resample(frame, target.limit(0)).where("rank IS NOT NULL").count() > 0


def test_planes_sum_as_products_do():
    rng = np.random.default_rng(1)
    counts = rng.poisson(0.02, (9, 10_000)) * rng.integers(1, 5000, (9, 1))
    for gain in (rng.integers(-9000, 9000, 10_000), np.full(10_000, -1), np.zeros(10_000, int)):
        assert (resampling.weights(counts, resampling.gain_planes(gain)) == counts @ gain).all()

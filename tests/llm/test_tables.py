"""WARC, top-k, mixing, learned scores and the pipeline."""

import base64
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from brute import SCHEMA, components
from lakelens.llm import mixing, quality, topk, toxicity, warc

PAGES = [
    (1, "http://a/", "x"), (2, "http://b/", "x"), (2, "http://b/", "x"), (3, None, None), (4, "http://u\r\nv", ""),
    (None, "n", "WARC/1.0\r\nWARC-Type: x\r\n\r\nWARC/1.0\r\n"), (6, "q", "\r\n\r\n"), (7, "z", "é" * 9000 + "WARC/1.0\r\n"),
    (None, "n", "x"), (8, "c", "Content-Length: 3\r\n\r\nabc"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "page_id AS payload")


@pytest.mark.parametrize("least", [0, 2])
def test_warc(spark, tmp_path, least):
    want = []
    for k, (page, _, html) in enumerate(PAGES):
        raw = (html or "").encode()
        same = [(p if p is not None else -1, j) for j, (p, _, h) in enumerate(PAGES) if (h or "").encode() == raw]
        top = max(same)[0] if len(raw) >= least and len(same) > 1 else None
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        revisit = top is not None and (page if page is not None else -1, k) != max(same, key=lambda x: (x[0], x[1]))
        want.append((page, len(raw), digest, "revisit" if revisit else "response", top if revisit else None))
    got = warc.page_captures(pages(spark), str(tmp_path / "w"), least)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_warc_transactions(spark, tmp_path):
    warc.write(pages(spark), str(tmp_path / "w"))
    nested = warc.captures(warc.records(spark, str(tmp_path / "w"))).collect()
    assert len(nested) == len(PAGES)
    assert all(r.n_requests == r.n_metadata == 1 and r.request.url == r.url == r.metadata.url for r in nested)
    bodies = sorted(bytes(r.payload).decode() for r in nested if r.record_type == "response")
    assert bodies == sorted({h or "" for _, _, h in PAGES})
    assert warc.page_captures(pages(spark).limit(0), str(tmp_path / "e")).count() == 0


def test_warc_that_names_its_requests(spark):
    fields = ("record_id string, type string, concurrent_to array<string>, refers_to string, url string, "
              "declared_digest string, http_head string, payload binary, payload_bytes bigint, payload_digest string")
    row = lambda i, kind, to: (i, kind, to, None, "u", None, None, b"", 0, "")
    table = spark.createDataFrame([row("a", "response", ["q", "r"]), row("q", "request", []), row("r", "request", []),
                                   row("m", "metadata", ["a"]), row("s", "request", ["gone"]), row("b", "response", [])], fields)
    got = {r.record_id: r for r in warc.captures(table).collect()}
    assert (got["a"].request.record_id, got["a"].n_requests, got["a"].n_metadata) == ("q", 2, 1)
    assert (got["b"].request, got["b"].n_requests) == (None, 0)


def test_top_k(spark):
    rng, rows = np.random.default_rng(0), []
    for i in range(700):
        v = [float(x) for x in rng.integers(-3, 4, 3 if i % 7 else 2) * 0.3 + (10 if i % 3 == 0 else 0)]
        rows.append((i, v))
    rows += [(0, rows[0][1]), (40, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (60, None), (80, [None, 1.0, 2.0]),
             (100, [math.nan, 1.0, 2.0]), (120, [math.inf, 0.0, 0.0]), (140, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "vec_id AS score")
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for a, (i, q) in enumerate(good):
        if i % 20 == 0:
            met = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(good)
                         if b != a and len(v) == len(q))[:20]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(met)]
    rows += [(160, [1e200, 0.0]), (180, [2.0**40, 1.0])]  # too large to multiply in 63 bits
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "vec_id AS score")
    for annulus, block in ((50, 16), (2048, 1024)):
        got = topk.top_k(table, annulus=annulus, block=block)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(table.limit(0)).count() == 0


def test_clustered_vectors_meet_few_annuli(spark, monkeypatch):
    """Pairs of a block and an annulus are planned on bounds, without vectors, and few are left."""
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(40, 16)) * 20
    x = middle[np.arange(6000) % 40] + rng.normal(size=(6000, 16)) * 0.2
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    seen = []
    write = topk.stage
    monkeypatch.setattr(topk, "stage", lambda df: seen.append(write(df)) or seen[-1])
    got = topk.top_k(table, annulus=100, block=8).collect()
    plans = [df for df in seen if "place" in df.columns and "ring" in df.columns]
    rings = next(df.count() for df in seen if "vecs" in df.columns)
    blocks = next(df.count() for df in seen if df.columns[:2] == ["block", "dim"])
    met = plans[0].where(f"place <= {topk.NEAREST}").count() + plans[1].count()
    assert len(got) == 300 * 20 and met < 0.4 * rings * blocks
    q = np.floor(64 * x).astype(np.int64)
    for r in got[::97]:
        scores = q[r.query_id] @ q.T
        scores[r.query_id] = np.iinfo(np.int64).min
        assert r.score == scores[r.vec_id] == np.sort(scores)[-r["rank"]]


def corpus(spark, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(400):
        source = rng.choice(["src0", "src0", "src1", "src2", None])
        text = " ".join("w" for _ in range(rng.randrange(0, 60))) or rng.choice([None, "", " "])
        rows.append((rng.choice([i, i, i, None, 7]), text, rng.choice(["en", "en", "de", "fr", None]), source, 0))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("how", [
    mixing.DEFAULT_MIX, mixing.Mix(share=1.9), mixing.Mix(tokens=1), mixing.Mix(tokens=0), mixing.Mix(share=5.0),
    mixing.Mix(weights={"domain": {"crawl": 0.0}, "source": {"src1": 30.0}}, share=0.5, epochs=3),
])
def test_mix_is_what_sql_takes(spark, how):
    documents = corpus(spark)
    con = duckdb.connect()
    con.register("documents", documents.toArrow())
    want = sorted(con.sql(mixing.mix_sql(how)).fetchall(), key=repr)
    taken = mixing.mix(documents, how).withColumns({"domain": mixing.F.expr(mixing.DOMAIN_SQL), "n": mixing.token_count()})
    got = taken.selectExpr("doc_id", "domain", "coalesce(lang, '')", "coalesce(source, '')", "n", "epoch")
    assert sorted(map(tuple, got.collect()), key=repr) == want


@pytest.mark.parametrize("seed", [1, 2, 3, 17])
@pytest.mark.parametrize("hot", ["IF(id % 3 = 0, NULL, id) AS doc_id, concat('a b c ', id) AS text",
                                 "IF(id % 3 = 0, 7, id) AS doc_id, IF(id % 3 = 0, 'a b c d', concat('a b c ', id)) AS text"])
def test_a_leaf_is_filled_across_hot_rows(spark, tmp_path, seed, hot):
    """A third of the rows share an id, or are one row: the leaf ends within one row of its budget."""
    rows = spark.sql(f"SELECT {hot}, 'en' AS lang, 's' AS source, id FROM range(3000)").repartition(7)
    rows.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    taken = mixing.mix(docs, mixing.Mix(tokens=6001, seed=seed)).cache()
    assert taken.count() == 1500 and taken.select("id").distinct().count() == 1500
    again = mixing.mix(docs, mixing.Mix(tokens=6001, seed=seed))
    assert taken.exceptAll(again).isEmpty()


def test_repeats_are_taken_in_file_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "_STRETCH", 16)
    spark.range(0, 300, 1, 3).selectExpr("5 AS doc_id", "'a b' AS text", "'en' AS lang", "'s' AS source", "id").write.parquet(
        str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for tokens, copies in ((1, 0), (2, 1), (255, 127), (599, 299), (600, 300), (801, 400)):
        got = mixing.mix(docs, mixing.Mix(tokens=tokens))
        first = docs.select("id", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index").limit(copies % 300)
        assert got.count() == copies
        assert {r.id for r in got.where(f"epoch = {copies // 300}").collect()} == {r.id for r in first.collect()}


def test_budgets_go_to_siblings_first(spark):
    sizes = spark.createDataFrame(
        [(1, "a", "x", "s", 10), (2, "a", "y", "s", 1000), (3, "b", "x", "s", 1000)],
        "doc_id long, _domain string, _lang string, _source string, _tokens long")
    got = {(r._domain, r._lang): r._budget for r in mixing.budgets(sizes, mixing.Mix(tokens=400, epochs=1)).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 200}


def test_mix_of_nothing(spark):
    assert mixing.mix(corpus(spark).limit(0)).count() == 0


OWN_NAMES = ("row", "_null", "_cid", "_chash", "_spans", "_rules", "_id", "_hash", "epoch", "_full", "_last", "_tokens", "_domain",
             "_lang", "_source", "_place", "_upto", "_key", "_bucket", "expected_grade", "tail", "selected", "n_words", "doc",
             "v", "comp", "bucket", "label", "h", "slot", "changed", "x")


def test_names_of_an_operators_own_pass_through(spark, tmp_path):
    """Every stage gives documents back with columns named like its own, values and all."""
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(30)) + ".", "en", "s", 0) for i in range(60)]
    rows[7] = (7, rows[7][1] + " password=abcdef77 x", "en", "s", 0)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"concat('{n}', doc_id) AS {n}" for n in OWN_NAMES])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, step in corpus_pipeline.STAGES[:-1]:
        got = step(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        for r in got.collect():
            assert all(r[n] == f"{n}{r.doc_id}" for n in OWN_NAMES)
    assert mixing.mix(docs).columns == [*docs.columns, "epoch_"]
    rated = quality.rate(docs, quality.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))))
    assert rated.columns == [*docs.columns, "expected_grade_", "tail_", "selected_"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def toxic_rows():
    rng, rows, labels = random.Random(2), [], []
    for i in range(600):
        words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            words[rng.randrange(50)] = "zorkan" + rng.choice("abc")
            words[rng.randrange(50)] = "blorf"
        rows.append((i, " ".join(words) + ".", "en", "s", 0))
        labels.append((i, int(i % 7 > 0), int(bad)))
    rows += [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (None, "you blorf", "en", "s", 0), (0, "nothing", "en", "s", 0)]
    return rows, labels + [(None, 1, 1), (3, None, None)]


def test_toxicity(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "doc_id AS score")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.detect(docs, marks).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    right = sum(by[i].predicted == (i % 5 == 0) for i in range(1, 600))
    assert right >= 590 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert by[1000].predicted == by[1001].predicted == 0
    assert next(r for r in got if r.doc_id is None).predicted == 1
    none = toxicity.detect(docs, marks.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    assert toxicity.detect(docs.limit(0), marks).count() == 0


def test_quality(spark):
    rng = random.Random(5)
    plain = lambda: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(50)) + "."
    junk = lambda: " ".join(["ab#$%", "##", "!!"][rng.randrange(3)] for _ in range(60))
    rows = [(i, [junk, plain][i % 2](), "en", "s", 0) for i in range(200)] + [(None, None, None, None, 0), (500, "", "x", "y", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([(i, i % 2) for i in range(0, 160)] + [(1, None), (None, 1)], "doc_id long, quality int")
    got = quality.rate(docs, quality.fit(docs, marks)).collect()
    assert len(got) == len(rows) and all(r.selected == (r.doc_id % 2 == 1) for r in got if r.doc_id is not None and r.doc_id < 200)
    assert all(abs(r.expected_grade - r.tail) < 1e-9 for r in got)
    unknown = quality.rate(docs, quality.fit(docs, marks.limit(0)))
    assert unknown.where("NOT selected OR tail IS NOT NULL").count() == 0
    assert quality.rate(docs.limit(0), quality.fit(docs, marks)).count() == 0
    halves = spark.createDataFrame([(i, 2.5 + 2 * (i % 2)) for i in range(160)], "doc_id long, quality double")
    graded = quality.rate(docs, quality.fit(docs, halves)).collect()
    assert all(r.selected == (r.doc_id % 2 == 1) for r in graded if r.doc_id is not None and r.doc_id < 200)


def test_ordinal_grades():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 4))
    line = x @ [1.5, -2, 0, 1] + rng.logistic(size=900) * 0.3
    y = np.digitize(line, [-1.5, 0.5, 2])
    model = quality.fit_ordinal(x, y, 4, np.ones(900))
    tails = model.tails(x)
    assert (np.diff(model.thresholds) > 0).all() and (np.diff(tails, axis=1) <= 0).all()
    assert np.corrcoef(tails.sum(1), y)[0, 1] > 0.9
    assert abs((tails > 0.5).sum(1) - y).mean() < 0.2


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    plain = lambda: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(50)) + "."
    rows, marks = [], []
    for i in range(240):
        text = "## $$ !! " * 30 if i % 6 == 0 else plain()
        if i % 6 == 1 and i > 6:
            text = rows[1][1] if i % 12 == 1 else rows[1][1] + " end"
        if i % 6 == 2:
            text += f" password=abcdef{i} end"
        rows.append((i, text, ["en", "de"][i % 2], f"src{i % 3}", len(text)))
        marks.append((i, int(i % 6 > 0), 0))
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [r for r in rows if r[0] % 6]
    _, comp = components([(r[0], r[1]) for r in kept], 5, 80)
    kept = [r for r, c in zip(kept, comp) if r[0] == c]
    for k, r in enumerate(kept):
        at = [m for m in __import__("re").finditer(r"password=\w+", r[1])]
        text = r[1] if not at else r[1][:at[0].start()] + "[SECRET]" + r[1][at[0].end():]
        kept[k] = (r[0], text, r[2], r[3], len(text))
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(kept, SCHEMA).toArrow())
    taken = con.sql(mixing.mix_sql()).fetchall()
    texts = {r[0]: r[1] for r in kept}
    tokenizer = Tokenizer.from_file(corpus_pipeline.vocabulary())
    tokenizer.no_truncation()
    want = sorted((d, tokenizer.encode(texts[d], add_special_tokens=False).ids) for d, *_ in taken)
    assert sorted((r.doc_id, r.ids) for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got) and len(got) > 50
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secrets", "mixing", "bpe"]


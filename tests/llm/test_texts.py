"""Fingerprints, BPE, secrets and languages against plain versions."""

import hashlib
import random
import re

import pytest

from brute import SCHEMA, shingles
from lakelens.llm import bpe, fingerprints, langid, secrets

TEXTS = [
    (9, "A quick brown fox jumps over the lazy dog. " * 20), (8, None), (7, ""), (6, "   "), (5, "é" * 7 + "🙂🙂x"),
    (4, "word " * 30_000), (3, "A quick brown fox jumps over the lazy dog. " * 20), (2, "one"), (2, "two words"),
    (None, "no id"), (1, "last one of all the many texts in here"),
]


def docs(spark, rows=TEXTS):
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    return table.withColumn("fingerprint", table.doc_id).withColumn("part", table.doc_id)


def test_fingerprints(spark):
    rows = [(i, t or "") for i, t in TEXTS if i not in (None, 2)]
    rows.sort(key=lambda r: -r[0])
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for (i, text), (_, after) in zip(rows, [*rows[1:], rows[0]]):
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = shingles(text, 5), shingles(other, 5)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(near - true) < 0.25 and (true not in (0.0, 1.0) or near == pytest.approx(true, abs=0.02))
    assert got[9].fingerprint == got[3].fingerprint != got[5].fingerprint


def test_fingerprints_of_odd_tables(spark):
    assert fingerprints.fingerprints(docs(spark).limit(0)).count() == 0
    assert fingerprints.fingerprints(docs(spark)).count() == len(TEXTS)
    one = fingerprints.fingerprints(docs(spark, [(1, "a b c d e f")])).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(1, 1.0)]


def test_near_pairs(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-2])), (3, " ".join(base)), (4, "something else altogether here now"),
            (5, None), (None, " ".join(base))]
    got = [(r.a, r.b, round(r.jaccard, 4)) for r in fingerprints.near_pairs(docs(spark, rows)).collect()]
    assert got == [(1, 2, round(94 / 96, 4))]


def test_near_pairs_around_a_passage_that_many_share(spark):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = words(100)
    rows = [(i, " ".join(passage + words(70))) for i in range(1, 121)]
    rows += [(500, " ".join(passage + words(4))), (501, " ".join(passage + words(4)))]
    got = [(r.a, r.b) for r in fingerprints.near_pairs(docs(spark, rows)).collect()]
    assert got == [(500, 501)]


def test_near_pairs_of_an_id_with_two_texts(spark):
    rng = random.Random(6)
    base, other = ([f"w{rng.randrange(10**6)}" for _ in range(100)] for _ in range(2))
    rows = [(7, " ".join(base)), (7, " ".join(other)), (8, " ".join(base[:-2])), (9, " ".join(other[:-2])),
            (3, " ".join(base[1:])), (3, " ".join(base[1:-1]))]
    got = {(r.a, r.b) for r in fingerprints.near_pairs(docs(spark, rows)).collect()}
    assert (7, 9) in got and {b for a, b in got if a == 3} == {3, 7, 8} and got <= {(7, 9), (3, 3), (3, 7), (3, 8), (7, 8)}


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def library():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(vocabulary())
    out.no_truncation()
    out.no_padding()
    return out


def strange(seed, count):
    rng = random.Random(seed)
    alphabet = "ab' !.é́\n\x1c　Z9🙂<|>sd\x85 "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(count)]
    return texts + ["<|startoftext|> a<|endoftext|>b", "don't we'll", "ab" * 3000 + " c " + "!'" * 900, "İΣ ﬀ"]


@pytest.mark.parametrize("leaf, edge", [(bpe.LEAF, bpe.EDGE), (40, bpe.EDGE), (60, 9), (500, 30)])
def test_bpe(spark, monkeypatch, leaf, edge):
    monkeypatch.setattr(bpe, "EDGE", edge)
    texts = [t for _, t in TEXTS[:6]] + strange(2, 150)
    rows = [(i, t) for i, t in enumerate(texts)]
    want = library()
    got = {r.doc_id: r for r in bpe.encode(docs(spark, rows), vocabulary(), leaf).collect()}
    for i, t in rows:
        if leaf < 100 and len(t or "") > 10_000:
            continue
        ids = want.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids) == (len(ids), " ".join(map(str, ids))), t
        assert got[i].decoded == want.decode(ids, skip_special_tokens=False)


def test_bpe_of_odd_tables(spark):
    assert bpe.encode(docs(spark).limit(0), vocabulary()).count() == 0
    twice = docs(spark).union(docs(spark))
    assert bpe.digests(bpe.encode(twice, vocabulary(), 1000)).count() == 2 * len(TEXTS)


def encoder():
    return bpe.Encoder(bpe.tokenizer_json(vocabulary()))


def leaves_of(code, text, leaf):
    cuts = bpe.leaf_cuts(len(text), leaf)
    return cuts, [code.spans(text[a:b], a) for a, b in zip(cuts, [*cuts[1:], len(text)])]


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", ["the"], "abc9!.é", "'s.tll"])
def test_runs_without_spaces_keep_their_leaves(alphabet):
    """A million code points without white space: the library's tokens, and joins that encode
    only a little again."""
    rng, code = random.Random(3), encoder()
    text = "".join(rng.choice(alphabet) for _ in range(1_000_000 // len(alphabet[0])))
    cuts, leaves = leaves_of(code, text, bpe.LEAF)
    assert [t[0] for t in code.tree(text, cuts, leaves)] == library().encode(text, add_special_tokens=False).ids
    assert code.by_pair and code.again < 0.01 * len(text)


def test_joins_of_random_runs():
    rng, code, want = random.Random(5), encoder(), library()
    alphabets = ["ab' !.é\u0301\n\x1c\u3000Z9🙂<|>sd\x85 ", "abcdefghij", "ab'.!9", "'s'tll", "é🙂ñ漢字かな", "<|endoftext|>a"]
    pieces = ["the", "ing", "<|endoftext|>", "'s", "''", "été", "9", "tion", "aaaa", "🙂"]
    for n in range(1500):
        alphabet, size = rng.choice(alphabets), rng.randrange(1, 160)
        text = "".join(rng.choice(alphabet if n % 3 else pieces) for _ in range(size))
        cuts, leaves = leaves_of(code, text, rng.choice([7, 15, 40]))
        parts = list(zip(cuts, [*cuts[1:], len(text)], leaves))
        while len(parts) > 1:
            joined = [(a[0], b[1], code.join(text, a[2], b[2], (a[0], b[0], b[1]), window=rng.choice([2, 3, 5, 8])))
                      for a, b in zip(parts[::2], parts[1::2])]
            parts = joined + parts[len(joined) * 2:]
        assert [t[0] for t in parts[0][2]] == want.encode(text, add_special_tokens=False).ids, text


def test_looked_up_words_are_the_librarys():
    texts = strange(4, 600) + ["", "  ", " a ", "\u200b \u200b", "ÀÉÎ naïve İstanbul ﬁn", "x\x1cy z"]
    code = encoder()
    for _ in range(2):  # words new, then known
        assert [tuple(c) for c in code.encode_many(bpe.pa.array([*texts, None]))] == [code.encode(t) for t in [*texts, ""]]


def test_a_full_table_of_words_gives_the_same_codes(monkeypatch):
    monkeypatch.setattr(bpe, "_KEPT", 40)
    texts = strange(6, 60) + ["a b c a", "", "a d e f g h a"]
    code = encoder()
    for n in range(0, len(texts), 3):
        few = texts[n:n + 3]
        assert [tuple(c) for c in code.encode_many(bpe.pa.array(few))] == [code.encode(t) for t in few]


def test_a_worker_holds_little_of_its_texts(monkeypatch):
    """Words are learned some at a time, and codes leave the task before many are held."""
    rng, sizes, learn = random.Random(8), [], bpe.Encoder._learn
    monkeypatch.setattr(bpe.Encoder, "_learn", lambda self, new: (sizes.append(len(new)), learn(self, new)))
    words = ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(60_000)]
    texts = [" ".join(words[n * 100:n * 100 + 100]) for n in range(600)] + [" ".join(words[:200])] * 1500
    batch = bpe.pa.record_batch({"doc_id": bpe.pa.array(range(len(texts))), "text": bpe.pa.array(texts)})
    parts = list(bpe._short(bpe.tokenizer_json(vocabulary()), False)(iter([batch])))
    assert [i for p in parts for i in p.column("doc_id").to_pylist()] == list(range(len(texts)))
    assert len(sizes) > 2 and max(sizes) < 20_000 and max(p.nbytes for p in parts) < 8e6
    want = library().encode(texts[599], add_special_tokens=False).ids
    ids = [i for p in parts for i in p.column("ids").to_pylist()]
    assert ids[599] == " ".join(map(str, want)) and ids[600] == ids[-1]


def test_digests_are_of_the_codes(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "ab " * 400, "the" * 900, "a b"])]
    for leaf in (50, 1000):
        want = sorted(map(tuple, bpe.digests(bpe.encode(docs(spark, rows), vocabulary(), leaf)).collect()))
        assert sorted(map(tuple, bpe.encode_digests(docs(spark, rows), vocabulary(), leaf).collect())) == want


SECRETS = [
    "password=abcdef", "PassWord : 'abc", "secret: token:abcdefgh", 'api_key="a1B2c3D4"', "apikey=short", "token=token=abcdef123",
    "AKIA" + "A" * 16, "AKIA" + "A" * 15, "xAKIAAKIA" + "B" * 20, "0" * 24, "0" * 23, "ab" * 40 + "g" + "12" * 12,
    "é🙂 password=ab🙂 secret=abcdef🙂🙂 " + "f" * 30, "passwd=" + "x" * 5000, "-----BEGIN RSA PRIVATE KEY-----",
    "ghp_" + "a1" * 20, "pass word=abcdef", "secret=" + "ab12" * 8 + " token=" + "ab12" * 8, None, "", "tok en secre t",
] + ["token=abcdef%d " % i * i for i in (3, 40, 300)]


def found(text):
    out = []
    for rank, rule in enumerate(secrets.RULES):
        flags = re.I | re.A if rule.pattern.startswith("(?i)") else re.A
        for m in re.finditer(rule.pattern.removeprefix("(?i)"), text or "", flags):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), rank, m.end(), rule.kind))
    return sorted(out)


def test_secrets(spark):
    rows = [(i, t) for i, t in enumerate(SECRETS)] + [(0, SECRETS[0]), (0, "token=zzzzzzz"), (None, "token=abcdef")]
    got = secrets.scan(docs(spark, rows)).collect()
    shown = lambda s: ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
    want = []
    for i, t in rows:
        spans = found(t)
        base = [s for s in spans if s[1] < 3]
        want.append((i, *[sum(s[1] == k for s in base) for k in range(3)],
                     hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_redacted(spark):
    table = docs(spark, [(i, t) for i, t in enumerate(SECRETS)])
    got = {r.doc_id: r for r in secrets.redact(table).collect()}
    for i, t in enumerate(SECRETS):
        want, at = "", 0
        for start, _, end, _ in found(t):
            if start >= at:
                want += t[at:start] + "[SECRET]"
            at = max(at, end)
        assert got[i].text == (want + t[at:] if at else t)
        assert got[i].n_chars == (len(got[i].text) if at else 1)
    assert secrets.redact(table).columns == table.columns
    assert secrets.redact(table.limit(0)).count() == 0


def test_trigram_queries():
    ask = secrets.trigram_query
    assert ask("abcd") == [{"abc", "bcd"}]
    assert ask("(abc|xyz)+q") == [{"abc"}, {"xyz"}]
    assert ask("a[0-9]+b") is None and ask("(abc|x)y") is None and ask("(abc)?") is None
    assert ask("ab?c") is None and ask("ab?cde") == [{"abc", "bcd", "cde"}, {"acd", "cde"}]


def test_native_plans(spark):
    plan = secrets.scan(docs(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_languages(spark):
    rng = random.Random(4)
    sounds = {"aa": "ka lo mi tu re".split(), "bb": "sch ung eit ber zu".split()}
    rows = [(i, " ".join("".join(rng.choices(sounds[lang], k=3)) for _ in range(30)), lang, "s", 0)
            for i in range(120) for lang in [("aa", "bb")[i % 2]]]
    rows += [(900, None, "aa", "s", 0), (901, "12 !?", "aa", "s", 0), (902, "", None, "s", 0), (None, "kalomi", None, "s", 0)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _, _ in rows[:120])
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[None].lang_pred == "aa" and got[None].held_out is False
    assert all(0 <= r.score <= 1 for r in got.values())
    import zlib
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(120))
    none = spark.createDataFrame([(1, "abc", None, "s", 0)], SCHEMA)
    assert [r.lang_pred for r in langid.identify(none).collect()] == ["und"]
    assert langid.identify(none.limit(0)).count() == 0

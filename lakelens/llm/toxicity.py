"""Toxicity by a weighted finite-state pattern grammar.

Small transducers read the words of a clause, one symbol each: an insult transducer
(its words and stems are learned), a threat transducer (a threatening verb with its
object), a target transducer (somebody is addressed), a negation and a reported-speech
transducer. Their composition, one machine over tuples of their states, is built once
and reads every clause forwards; a second one reads it backwards, so that a target or a
reporting verb behind an insult counts like one before it. A clause emits its matches at
its end: "insult, aimed, negated" and so on. All clauses of many texts that hold a
candidate are read side by side.

What a match of each kind weighs is fitted to labelled rows, around the grammar's own
weights: a target adds, a negation and a report take away, and no fit may turn that
round. An insult alone in its clause, without target, negation or report, is a kind like
others: it weighs what the labels say of texts that hold no other kind, and nothing if
those are not toxic more often than texts are on the whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.llm.learning import labelled, sample, trains
from lakelens.llm.shared import held_out, slices
from lakelens.llm.shingles import Powers, shingle_sets

#: Labelled rows to learn from: toxic ones and others.
TOXIC_ROWS, CLEAN_ROWS = 4096, 12288

#: Evidence that an entry of the learned lexicon needs (a log-likelihood ratio of its
#: counts in toxic and other texts).
EVIDENCE = 24.0

#: Lengths of the word beginnings that may be learned as stems.
STEMS = (4, 5, 6, 7, 8)

#: Toxic texts of an entry for each other text that holds it, at least.
PURE = 8

#: Share of a stem's toxic texts that one word may account for.
SHARED = 0.7

#: What the grammar says before any label: a match, and factors of a target, a negation, a report.
MATCH, AIMED, NEGATED, QUOTED = 1.0, 1.5, 0.3, 0.6

#: Bytes of texts that are read side by side.
BYTES = 1 << 22

TARGETS = frozenset("""you your yours yourself u ur he she they him her them his their
    du dich dein deine ihr euch sie tu te toi ton ta vous votre usted ustedes tú ti""".split())
NEGATIONS = frozenset("""not no never nobody none isn aren wasn don doesn didn won cannot
    nicht kein keine nie pas jamais aucun nunca ningún""".split())
REPORTING = frozenset("""said says say told claims claimed reported reports quoted wrote called
    sagte sagt berichtet schrieb dit disait affirme dijo dice""".split())
THREATS = frozenset("""kill murder hurt destroy beat shoot stab burn strangle
    töten umbringen schlagen tuer frapper matar golpear""".split())

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
_END, _SKIP = 6, 7  # a clause's end, and what is no word


@dataclass(frozen=True)
class Transducer:
    """``moves[state][symbol]`` is the next state; ``emits(state, symbol)`` what a step says."""

    states: int
    moves: tuple[tuple[int, ...], ...]
    emits: frozenset[tuple[int, int]] = frozenset()


def _latch(symbol: int, span: int) -> Transducer:
    """In a state other than 0 for ``span`` words after ``symbol``; 0 before and later."""
    rows = []
    for state in range(span + 1):
        fall = max(0, state - 1)
        rows.append(tuple(span if s == symbol else fall for s in range(6)))
    return Transducer(span + 1, tuple(rows))


#: Somebody addressed within four words, a negation within three, speech reported in the clause.
AIM, NEGATE, REPORTED = _latch(TARGET, 4), _latch(NEGATION, 3), _latch(REPORT, 12)
#: An insult is said at once. A threat is said when its object follows within three words.
INSULTS = Transducer(1, ((0,) * 6,), frozenset({(0, INSULT)}))
THREATEN = Transducer(4, tuple(
    tuple(3 if s == THREAT else 0 if s == TARGET else max(0, state - 1) for s in range(6)) for state in range(4)
), frozenset((state, TARGET) for state in (1, 2, 3)))

PARTS = (INSULTS, THREATEN, AIM, NEGATE, REPORTED)


def compose(parts: tuple[Transducer, ...] = PARTS):
    """One machine over the tuples of the parts' states that can be reached.

    A step maps (state, symbol) to the next state and what it says: for the first parts,
    those that emit, whether each does, and for the others whether they are in a state
    other than 0 before the step.
    """
    number, table, queue = {tuple(0 for _ in parts): 0}, {}, [tuple(0 for _ in parts)]
    while queue:
        state = queue.pop()
        for symbol in range(6):
            after = tuple(p.moves[s][symbol] for p, s in zip(parts, state))
            if after not in number:
                number[after] = len(number)
                queue.append(after)
            said = tuple((s, symbol) in p.emits if p.emits else s > 0 for p, s in zip(parts, state))
            table[number[state], symbol] = number[after], said
    return table


def arrays(table) -> tuple[np.ndarray, np.ndarray]:
    """A composed machine as next[state, symbol] and said[state, symbol, part]."""
    states = 1 + max(s for s, _ in table)
    parts = len(next(iter(table.values()))[1])
    after, said = np.zeros((states, 6), np.int32), np.zeros((states, 6, parts), bool)
    for (state, symbol), (to, what) in table.items():
        after[state, symbol], said[state, symbol] = to, what
    return after, said


def read(machine, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, backwards: bool = False) -> np.ndarray:
    """What the machine says at each symbol of clauses, all clauses a step at a time."""
    after, said = machine
    out = np.zeros((len(symbols), said.shape[2]), bool)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    state = np.zeros(len(starts), np.int32)
    live = len(starts)
    for step in range(int(lengths.max(initial=0))):
        while live and lengths[live - 1] <= step:
            live -= 1
        at = starts[:live] + (lengths[:live] - 1 - step if backwards else step)
        now = symbols[at]
        out[at] = said[state[:live], now]
        state[:live] = after[state[:live], now]
    return out


KINDS = {k: i for i, k in enumerate(product((0, 1), (False, True), (False, True), (False, True)))}
#: An insult with nothing else in its clause.
BARE = KINDS[0, False, False, False]

_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Grammar:
    """Learned insult entries with weights, and the weight of each kind of match."""

    words: dict[str, float]
    stems: dict[str, float]
    kinds: np.ndarray
    bias: float

    def __post_init__(self):
        self.forwards, self.backwards = arrays(compose()), arrays(compose((AIM, REPORTED)))
        self.fixed = {w: s for s, group in ((TARGET, TARGETS), (NEGATION, NEGATIONS),
                                            (REPORT, REPORTING), (THREAT, THREATS)) for w in group}
        self.fixed |= {".": _END, "": _SKIP}
        self.seen: dict[str, tuple[int, float]] = {}

    def insult(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n in STEMS:
            if len(word) >= n:
                best = max(best, self.stems.get(word[:n], 0.0))
        return best

    def symbol(self, word: str) -> tuple[int, float]:
        """A word's symbol, and what it weighs if it is an insult."""
        found = self.seen.get(word)
        if found is None:
            weight = 0.0 if word in (".", "") else self.insult(word)
            found = (INSULT, weight) if weight else (self.fixed.get(word, OTHER), 1.0)
            if len(self.seen) > 500_000:
                self.seen.clear()
            self.seen[word] = found
        return found

    def matches(self, text: str) -> np.ndarray:
        return self.matches_many(pa.array([text], pa.string()))[0]

    def matches_many(self, texts: pa.Array) -> np.ndarray:
        """Summed weight of matches per kind, a row for each text; the last place is
        their number per 100 words."""
        out = np.zeros((len(texts), len(KINDS) + 1))
        low = pc.utf8_lower(texts.fill_null(""))
        low = pc.replace_substring_regex(low, r"[.!?;:\n|]+", " . ")
        split = pc.utf8_split_whitespace(pc.replace_substring_regex(low, r"[^\pL.]+", " "))
        ends = np.asarray(split.offsets)
        coded = split.flatten().dictionary_encode()
        if not len(coded):
            return out
        codes = [self.symbol(w) for w in coded.dictionary.to_pylist()]
        place = coded.indices.to_numpy()
        symbols = np.array([c[0] for c in codes], np.int8)[place]
        weights = np.array([c[1] for c in codes])[place]
        owner = np.repeat(np.arange(len(texts)), np.diff(ends))
        word = symbols < _END
        total = np.bincount(owner[word], minlength=len(texts))
        # clauses end where a mark stands and where a text does
        clause = np.cumsum(symbols == _END) + owner * (len(symbols) + 1)
        symbols, weights, owner, clause = symbols[word], weights[word], owner[word], clause[word]
        starts = np.flatnonzero(np.concatenate([[True], clause[1:] != clause[:-1]])) if len(clause) else np.empty(0, int)
        lengths = np.diff(np.append(starts, len(clause)))
        candidate = (symbols == INSULT) | (symbols == THREAT)
        some = np.add.reduceat(candidate, starts) > 0 if len(starts) else np.empty(0, bool)
        starts, lengths = starts[some], lengths[some]
        said = read(self.forwards, symbols, starts, lengths)
        behind = read(self.backwards, symbols, starts, lengths, backwards=True)
        insult, threat, aimed, negated, reported = said.T
        hit = np.flatnonzero(insult | threat)
        kind = ((threat & ~insult) * 8 + (aimed | behind[:, 0]) * 4 + negated * 2 + (reported | behind[:, 1]))[hit]
        np.add.at(out, (owner[hit], kind), weights[hit])
        out[:, -1] = 100 * np.bincount(owner[hit], minlength=len(texts)) / np.maximum(total, 1)
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        line = np.log1p(self.matches_many(texts)) @ self.kinds + self.bias
        return 1 / (1 + np.exp(-np.clip(line, -40, 40)))

    def score(self, text: str) -> float:
        return float(self.scores(pa.array([text], pa.string()))[0])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per entry, the texts that hold it, toxic and others, summed over a batch."""
    for batch in batches:
        counts = Counter(), Counter()
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            words = {w for w in _WORD.findall(text.lower()) if len(w) >= 3}
            found = {"=" + w for w in words}
            for n in STEMS:
                found |= {w[:n] for w in words if len(w) > n}
            counts[label].update(found)
        for label, counter in enumerate(counts):
            keys = list(counter)
            for start in range(0, len(keys), 50_000):
                part = keys[start:start + 50_000]
                yield pa.record_batch({"entry": pa.array(part, pa.string()),
                                       "label": pa.array([label] * len(part), pa.int32()),
                                       "texts": pa.array([counter[k] for k in part], pa.int64())})


def _first_shingles(batches):
    """Two values that near copies mostly share: the smallest and the greatest shingle hash."""
    powers = Powers()
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(part.column("text"), 4, powers)
            ends = [(int(s[0]), int(s[-1])) if len(s) else (0, 0) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *[pa.array(np.array([e[i] for e in ends], np.uint64).view(np.int64)) for i in (0, 1)]],
                names=[*part.schema.names, "low", "high"])


def fit(docs: DataFrame, labels: DataFrame) -> Grammar | None:
    """From a bounded sample of labelled rows that are not held out; None without both labels.

    Near copies are thinned out first: words of a text that was copied often would
    otherwise look like words of its label.
    """
    known = labelled(docs, labels, "toxic").where(trains(F.col("doc_id")))
    known = known.withColumn("label", F.when(F.col("label") > 0, 1).otherwise(0))
    toxic = sample(docs, known.where("label = 1"), TOXIC_ROWS)
    clean = sample(docs, known.where("label = 0"), CLEAN_ROWS)
    rows = toxic.unionByName(clean).select("doc_id", "label", "text").mapInArrow(
        _first_shingles, "doc_id bigint, label int, text string, low bigint, high bigint")
    for end in ("low", "high"):
        rows = rows.groupBy(end).agg(F.min(F.struct("doc_id", "label", "text", "low", "high")).alias("r")).select("r.*")
    rows = rows.persist()
    try:
        totals = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
        if len(totals) < 2:
            return None
        share = totals[1] / (totals[0] + totals[1])
        found = rows.select("text", "label").mapInArrow(_entries, "entry string, label int, texts bigint").groupBy(
            "entry").agg(F.sum(F.when(F.col("label") == 1, F.col("texts")).otherwise(0)).alias("t"),
                         F.sum(F.when(F.col("label") == 0, F.col("texts")).otherwise(0)).alias("c"))
        t, c = F.col("t"), F.col("c")
        n = t + c
        term = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
        evidence = 2 * (term(t, share) + term(c, 1 - share))
        best = found.where((t > 2) & (t > PURE * c)).withColumn("g", evidence).where(F.col("g") >= EVIDENCE).orderBy(
            F.desc("g"), "entry").collect()  # bounded by the evidence that a bounded sample can give
        weigh = lambda r: float(np.log((r.t + 0.5) / (r.c + 0.5) * totals[0] / totals[1]))
        words = {r.entry[1:]: weigh(r) for r in best if r.entry.startswith("=")}
        # a stem speaks for words it was not seen with, so it must not owe its texts to one word
        held = {r.entry[1:]: r.t for r in best if r.entry.startswith("=")}
        stems = {r.entry: weigh(r) for r in best if not r.entry.startswith("=") and not any(
            t >= SHARED * r.t for w, t in held.items() if w.startswith(r.entry))}
        start = Grammar(words, stems, np.zeros(len(KINDS) + 1), 0.0)

        def measured(batches):
            for batch in batches:
                for part in slices(batch, "text", BYTES):
                    found = start.matches_many(part.column("text"))
                    yield pa.record_batch({"label": part.column("label"),
                                           "found": pa.array(found.tolist(), pa.list_(pa.float64()))})

        got = rows.select("text", "label").mapInArrow(measured, "label int, found array<double>").collect()
    finally:
        rows.unpersist()
    return Grammar(words, stems, *weigh_kinds(np.array([r.found for r in got]), np.array([r.label for r in got], float)))


def prior() -> np.ndarray:
    """The grammar's own weight of each kind of match, and none for their density."""
    out = [MATCH * (AIMED if a else 1) * (NEGATED if n else 1) * (QUOTED if r else 1) for _, a, n, r in KINDS]
    return np.array([*out, 0.0])


def in_order(w: np.ndarray) -> np.ndarray:
    """Weights that keep the grammar's order: no kind below 0, a target never takes away,
    a negation and a report never add."""
    w = np.maximum(w, 0)
    for base in (0, 1):
        for flags in sorted(product((False, True), repeat=3), key=sum):
            aimed, negated, reported = flags
            here = KINDS[(base, *flags)]
            if negated:
                w[here] = min(w[here], NEGATED * w[KINDS[base, aimed, False, reported]])
            elif reported:
                w[here] = min(w[here], QUOTED * w[KINDS[base, aimed, negated, False]])
            if aimed:
                w[here] = max(w[here], w[KINDS[base, False, negated, reported]])
    return w


def weigh_kinds(found: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the kinds and the bias from matches (as ``matches`` has them) and labels.

    The likeliest weights around the grammar's own, put in order, then scaled.
    """
    x = np.log1p(found)
    w, _ = _logistic(x, y, prior())
    kinds = found[:, :len(KINDS)] > 0
    alone = kinds[:, BARE] & (kinds.sum(1) == 1)
    if not alone.any() or y[alone].mean() <= y.mean():
        w[BARE] = 0.0  # the labels do not say that a word alone is toxic
    w = in_order(w)
    scale, bias = _logistic((x @ w)[:, None], y, np.ones(1))
    return w * max(scale[0], 0.0), bias


def _logistic(x: np.ndarray, y: np.ndarray, mean: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Newton's method with a ridge around ``mean``."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], 1)
    around = np.append(mean, 0.0)
    w = around.copy()
    hold = ridge * len(y) * np.append(np.ones(len(mean)), 1e-3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -40, 40)))
        grad = x1.T @ (p - y) + hold * (w - around)
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(hold), grad)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def detect(docs: DataFrame, labels: DataFrame | None = None, grammar: Grammar | None = None) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 if score >= 0.5, else 0).

    Null texts are empty; a text without a match has the score of no match. Without
    labels of both kinds to learn from nothing is known and the score is 0. A null id
    is not held out. Only doc_id and text are read of the documents; an empty table
    gives no rows.
    """
    grammar = grammar or (fit(docs, labels) if labels is not None else None)

    def scored(batches):
        for batch in batches:
            for part in slices(batch, "text", BYTES):
                scores = grammar.scores(part.column("text")) if grammar else np.zeros(part.num_rows)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"),
                                       "score": pa.array(scores),
                                       "predicted": pa.array((scores >= 0.5).astype(np.int32))})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(
        scored, "doc_id bigint, held_out boolean, score double, predicted int")

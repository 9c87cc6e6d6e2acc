"""Quality by ordinal regression on graded ratings.

One vector of weights over hashed text features serves all grades; ordered
thresholds cut its line: P(grade > g) = sigmoid(w x - t_g) with t_0 <= t_1 <= ...
The model gives the expected grade and the probability of reaching a wanted grade,
and selection is on that tail probability.

Features, all hashed into one space: words, runs of character classes (a text's
shape), and how often words repeat, by whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.llm.learning import labelled, sample
from lakelens.llm.shared import free_name, slices
from lakelens.llm.shingles import Powers, mix, text_bytes, word_hashes
from lakelens.sources.schema import quoted

PLACES = 4096

#: Labelled rows per grade to learn from; steps and ridge of the fit.
ROWS_PER_GRADE, STEPS, RIDGE = 1024, 400, 1e-4

#: Different grades learned from, and texts whose features are made at once.
GRADES, ROWS = 64, 256

_CLASSES = 16


def _classes() -> np.ndarray:
    """A class per byte: letter cases, digits, line ends, spaces, marks of prose and others."""
    out = np.full(256, 1, np.uint8)
    for group, number in ((b"abcdefghijklmnopqrstuvwxyz", 2), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3), (b"0123456789", 4),
                          (b"\n\r", 5), (b" \t", 6), (b".", 7), (b",;:", 8), (b"!?", 9), (b"'\"()-", 10),
                          (b"|", 11), (b"#$%&*@^~+=<>{}[]\\/_`", 12)):
        out[list(group)] = number
    out[0x80:] = 13
    out[0xC3] = 14  # the lead byte of most accented Latin letters
    return out


_CLASS = _classes()


def features(column: pa.Array, powers: Powers) -> np.ndarray:
    """float32, one row per text: square roots of relative counts, by kind."""
    raw, offsets = text_bytes(column)
    n = len(column)
    out = np.zeros(n * PLACES, np.float32)
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(n), sizes)
    shape = _CLASS[raw].astype(np.int64)
    gram = np.zeros(len(raw), np.int64)
    with np.errstate(over="ignore"):
        for length in (1, 2, 3):
            if len(raw) < length:
                break
            gram = gram[:len(raw) - length + 1] * _CLASSES + shape[length - 1:]
            inside = owner[:len(gram)] == owner[length - 1:]
            place = (mix((gram + (length << 20)).astype(np.uint64)) >> np.uint64(52)).astype(np.int64)
            found, total = owner[:len(gram)][inside], np.maximum(sizes - length + 1, 1)
            counts = np.bincount(found * PLACES + place[inside], minlength=n * PLACES)
            out += counts / np.repeat(total, PLACES)
        words, at = word_hashes(raw, offsets, powers)
        many = np.diff(at)
        holder = np.repeat(np.arange(n), many)
        counts = np.bincount(holder * PLACES + (mix(words + np.uint64(7)) >> np.uint64(52)).astype(np.int64),
                             minlength=n * PLACES)
        out += 0.25 * counts / np.repeat(np.maximum(many, 1), PLACES)
        same = np.zeros(n)
        if len(words) > 1:
            again = (words[1:] == words[:-1]) & (holder[1:] == holder[:-1])
            same = np.bincount(holder[1:][again], minlength=n)
        distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist())])
        out = np.sqrt(out.reshape(n, PLACES))
        for kind, part in enumerate((same, distinct)):
            level = np.floor(10 * part / np.maximum(many, 1)).astype(np.uint64)
            place = (mix(level + np.uint64((kind + 3) << 32)) >> np.uint64(52)).astype(np.int64)
            out[np.arange(n), place] += 0.5
    return out.astype(np.float32)


@dataclass
class Model:
    """``thresholds[g]`` parts grade g from those above it; grades are 0, 1, ..."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade > g) for each g, falling along each row."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - (x @ self.weights)[:, None], -60, 60)))


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, weight: np.ndarray) -> Model:
    """Maximum likelihood with a ridge, by Adam on weights, first threshold and log gaps."""
    w = np.zeros(x.shape[1])
    cuts = np.concatenate([[0.0], np.zeros(grades - 2)])  # t_0, then log of the gaps
    m = [np.zeros_like(w), np.zeros_like(cuts)]
    v = [np.zeros_like(w), np.zeros_like(cuts)]
    weight = weight / weight.sum()
    rows = np.arange(len(y))
    x = np.ascontiguousarray(x, np.float32)  # mixed types would be copied at every step
    for step in range(1, STEPS + 1):
        gaps = np.exp(cuts[1:])
        t = np.concatenate([cuts[:1], cuts[0] + np.cumsum(gaps)])
        above = 1 / (1 + np.exp(np.clip(t[None, :] - (x @ w.astype(np.float32))[:, None], -60, 60)))
        full = np.concatenate([np.ones((len(y), 1)), above, np.zeros((len(y), 1))], 1)
        slope = full * (1 - full)
        chance = np.maximum(full[rows, y] - full[rows, y + 1], 1e-9)
        d_line = -(slope[rows, y] - slope[rows, y + 1]) / chance * weight
        d_t = np.zeros(grades - 1)
        lower, upper = slope[rows, y] / chance * weight, -slope[rows, y + 1] / chance * weight
        for g in range(grades - 1):
            d_t[g] = lower[y == g + 1].sum() + upper[y == g].sum()
        tail = np.cumsum(d_t[::-1])[::-1]
        grads = [d_line.astype(np.float32) @ x + RIDGE * w, np.concatenate([tail[:1], gaps * tail[1:]])]
        for i, (value, grad) in enumerate(zip((w, cuts), grads)):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad**2
            value -= 0.3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8) * min(1, 100 / step)
    gaps = np.exp(cuts[1:])
    return Model(w.astype(np.float32), np.concatenate([cuts[:1], cuts[0] + np.cumsum(gaps)]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model | None:
    """From at most ``ROWS_PER_GRADE`` rated rows of each grade; None if ratings do
    not tell anything apart. Grades are any numbers, counted in their order, and weigh as
    often as they come among all ratings; of more than ``GRADES`` different ones the most
    frequent are learned from.
    """
    rated = labelled(docs, labels, label).withColumn("label", F.col("label").cast("double"))
    shares = {r.label: r["count"] for r in rated.groupBy("label").count().orderBy(
        F.desc("count"), "label").limit(GRADES).collect()}
    if len(shares) < 2:
        return None
    grades = sorted(shares)
    rated = rated.where(F.col("label").isin(grades))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in slices(batch, "text", 1 << 19, ROWS):
                x = features(part.column("text"), powers).astype(np.float16)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "label": part.column("label"),
                                       "x": pa.array([r.tobytes() for r in x], pa.binary())})

    rows = sample(docs, rated, ROWS_PER_GRADE).select("doc_id", "label", "text")
    got = rows.mapInArrow(vectors, "doc_id bigint, label double, x binary").collect()
    got = sorted(got, key=lambda r: r.doc_id)
    x = np.stack([np.frombuffer(bytes(r.x), np.float16) for r in got]).astype(np.float32)
    y = np.array([grades.index(r.label) for r in got])
    sampled = np.bincount(y, minlength=len(grades))
    weight = np.array([shares[g] / max(1, s) for g, s in zip(grades, sampled)])[y]
    return fit_ordinal(x, y, len(grades), weight)


ADDED = ("expected_grade", "tail", "selected")


def rate(docs: DataFrame, model: Model | None, target: int = 1, least: float = 0.5) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail`` = P(grade >= target) and ``selected``.

    A null text is rated as an empty one. Without a model all are selected, with null
    ratings. Rows come out as they went in, repeated ones too. Where ``docs`` has a column
    of one of the three names, the added one gets underscores behind its name.
    """
    names = [free_name(docs.columns, n) for n in ADDED]
    if model is None:
        return docs.select("*", F.lit(None).cast("double").alias(names[0]),
                           F.lit(None).cast("double").alias(names[1]), F.lit(True).alias(names[2]))

    def rated(batches):
        powers = Powers()
        for batch in batches:
            for part in slices(batch, "text", 1 << 19, ROWS):
                tails = model.tails(features(part.column("text"), powers))
                tail = tails[:, min(target, tails.shape[1]) - 1].astype(float)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(tails.sum(1).astype(float)), pa.array(tail), pa.array(tail >= least)],
                    names=[*part.schema.names, *names])

    return docs.mapInArrow(rated, _schema(docs, f"`{names[0]}` double, `{names[1]}` double, `{names[2]}` boolean"))


def selected(docs: DataFrame, model: Model | None, target: int = 1, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``rate`` selects, as they came."""
    chosen = rate(docs, model, target, least).where(F.col(free_name(docs.columns, ADDED[2])))
    return chosen.select(*[F.col(quoted(c)) for c in docs.columns])


def _schema(docs: DataFrame, added: str):
    from pyspark.sql import types as T

    return T.StructType([*docs.schema.fields, *T.StructType.fromDDL(added).fields])

"""Language identification by string kernels.

The kernel of two texts is the number of n-grams (1 to 4 letters, non-letters are one
space) that both contain, over the geometric mean of how many each contains: a
blended-spectrum presence kernel, with n-grams hashed into a fixed number of places.
A few texts are landmarks; kernels with them are Nyström features, on which one
ridge regression per language is fitted. Scoring is two matrix products per batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.llm.learning import sample, trains
from lakelens.llm.shared import held_out, slices
from lakelens.llm.shingles import mix

PLACES, LONGEST = 1 << 15, 4

#: Labelled rows to learn from, over all languages and per language; landmarks.
ROWS, ROWS_PER_LANGUAGE, LANDMARKS = 4096, 256, 96

#: Strength of the ridge.
RIDGE = 1e-2


def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(1 << 16)])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def presence(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0/1 per text and place, and whether the text has a letter at all."""
    out = np.zeros((len(texts), PLACES), np.uint8)
    points = [code_points(t.lower()) for t in texts]
    sizes = np.array([len(p) for p in points])
    flat = np.concatenate([np.empty(0, np.uint32), *points])
    alpha = letters[np.minimum(flat, 0xFFFF)]
    high = np.flatnonzero(flat > 0xFFFF)
    alpha[high] = [chr(c).isalpha() for c in flat[high].tolist()]
    owner = np.repeat(np.arange(len(texts)), sizes)
    any_letter = np.zeros(len(texts), bool)
    any_letter[owner[alpha]] = True
    code = np.where(alpha, flat, 32).astype(np.uint64)
    # a run of non-letters is one space
    keep = alpha.copy()
    if len(keep):
        keep[1:] |= alpha[:-1] | (owner[1:] != owner[:-1])
        keep[0] = True
    code, owner = code[keep], owner[keep]
    grams = np.zeros(len(code), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, LONGEST + 1):
            if len(code) < n:
                break
            grams = grams[:len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1:]
            inside = owner[:len(grams)] == owner[n - 1:]
            place = (mix(grams + np.uint64(n)) >> np.uint64(49)).astype(np.int64)
            out.reshape(-1)[(owner[:len(grams)] * PLACES + place)[inside]] = 1
    return out, any_letter


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    x, landmarks = x.astype(np.float32), landmarks.astype(np.float32)
    scale = np.sqrt(np.maximum(x.sum(1), 1))[:, None] * np.sqrt(np.maximum(landmarks.sum(1), 1))[None, :]
    return x @ landmarks.T / scale


@dataclass
class Model:
    languages: list[str]
    landmarks: bytes  # packed bits
    weights: np.ndarray

    def score(self, texts: list[str], letters: np.ndarray):
        """(language, score in 0..1) of each text; texts without letters are und."""
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        marks = np.unpackbits(np.frombuffer(self.landmarks, np.uint8)).reshape(-1, PLACES)
        names, scores = [], []
        for start in range(0, len(texts), 128):
            x, has = presence(texts[start:start + 128], letters)
            out = kernel(x, marks) @ self.weights
            best = out.argmax(1)
            top = np.clip(out[np.arange(len(out)), best], 0, 1)
            names += [self.languages[b] if h else "und" for b, h in zip(best.tolist(), has.tolist())]
            scores += np.where(has, top, 0.0).tolist()
        return names, scores


def fit(docs: DataFrame) -> Model:
    """From a bounded sample of rows with text and language that are not held out."""
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & trains(F.col("doc_id"))).select(
        "doc_id", F.col("lang").alias("label"))
    languages = sorted(r.label for r in usable.select("label").distinct().collect())
    if not languages:
        return Model([], b"", np.zeros((0, 0)))
    rows = sample(docs, usable, max(2, min(ROWS_PER_LANGUAGE, ROWS // len(languages))))
    rows = rows.withColumnRenamed("label", "lang")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                bits = np.packbits(presence(part.column("text").to_pylist(), letters)[0], axis=1)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "lang": part.column("lang"),
                                       "bits": pa.array([b.tobytes() for b in bits], pa.binary())})

    got = sorted(rows.mapInArrow(packed, "doc_id bigint, lang string, bits binary").collect())
    x = np.unpackbits(np.frombuffer(b"".join(bytes(r.bits) for r in got), np.uint8)).reshape(len(got), PLACES)
    y = np.array([languages.index(r.lang) for r in got])
    # landmarks: the languages take turns
    turn = np.zeros(len(got), int)
    for c in range(len(languages)):
        turn[y == c] = np.arange((y == c).sum())
    marks = np.lexsort((y, turn))[:max(LANDMARKS, 2 * len(languages))]
    landmarks = x[marks]
    inner = kernel(landmarks, landmarks).astype(np.float64)
    value, vector = np.linalg.eigh(inner)
    root = vector / np.sqrt(np.maximum(value, 1e-6))  # Nyström: kernels times this are features
    z = np.concatenate([kernel(x[i:i + 256], landmarks) for i in range(0, len(x), 256)]).astype(np.float64) @ root
    target = (y[:, None] == np.arange(len(languages))).astype(float)
    weight = 1 / np.maximum(target.sum(0), 1)[y]  # languages count alike
    weight *= len(y) / weight.sum()
    gram = (z * weight[:, None]).T @ z + RIDGE * len(y) / 100 * np.eye(z.shape[1])
    weights = root @ np.linalg.solve(gram, (z * weight[:, None]).T @ target)
    return Model(languages, np.packbits(landmarks).tobytes(), weights.astype(np.float32))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter are ``und`` with score 0. Without any
    labelled row to learn from everything is. A null id is not held out; an empty
    table gives no rows. Columns other than doc_id, text and lang are not read,
    and lang only to learn.
    """
    model = model or fit(docs)

    def scored(batches):
        letters = _letters()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                names, scores = model.score([t or "" for t in part.column("text").to_pylist()], letters)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"),
                                       "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(
        scored, "doc_id bigint, held_out boolean, lang_pred string, score double")

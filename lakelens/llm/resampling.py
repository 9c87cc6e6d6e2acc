"""Resampling documents towards a target by importance weights, summed bit-sliced.

A text's features are its runs of one to three words, hashed into buckets. A bucket's
gain says how much commoner it is in the target than in the documents, in thousandths
of a natural logarithm, as an integer. A document's weight is the sum of the gains of
its features, and it is never added up feature by feature:

* the document's bucket counts become planes of ``buckets`` bits: plane i has bit i of
  every count;
* the gains become planes in two's complement, the last one of negative value;
* a plane of counts AND a plane of gains leaves the buckets where both bits are set. The
  population count of that, times the product of both planes' powers of two, summed over
  all pairs of planes, is the exact weight.

Corpus counts are summed inside each task first. What is sent to the tasks are the planes
of gains, whose size is fixed by the number of buckets. Gumbel noise keyed by the id makes
the largest scores a sample without replacement in proportion to exp(weight / 1000).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakelens.llm.shared import slices
from lakelens.llm.shingles import text_bytes
from lakelens.operators.ordering import ROW_ID, Sort
from lakelens.operators.rows import with_row_id
from lakelens.session import stage

#: Buckets of features, words of the longest feature, words a document needs to be drawn.
BUCKETS, RUN, LEAST_WORDS = 10_000, 3, 20

#: Percent of the eligible documents that are drawn, and what the noise is keyed by.
PERCENT, SEED = 5, 42

#: Texts whose planes are built at once, and bytes of texts hashed at once.
ROWS, BYTES = 256, 1 << 19

#: Words up to this long are hashed side by side, longer ones one by one.
SHORT = 48


def _lowered() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A"):ord("Z") + 1] += 32
    word = np.zeros(256, bool)
    word[ord("0"):ord("9") + 1] = word[ord("a"):ord("z") + 1] = word[128:] = True
    return lower, word[lower]


_LOWER, _IN_WORD = _lowered()


class Crc32:
    """CRC-32 of many byte strings at once, and of their concatenations.

    The checksum of a joined string is the first part's, moved past the second part's
    length, XOR the second part's. Moving is linear over bits, so it is four look-ups;
    a move by any length is put together from moves by powers of two.
    """

    NEAR = 64  # moves by fewer bytes than this have tables of their own

    def __init__(self):
        byte = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)
        self.byte = byte.astype(np.uint32)
        places = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
        self.near = np.empty((self.NEAR, 4, 256), np.uint32)
        self.near[0] = places
        for n in range(1, self.NEAR):
            last = self.near[n - 1]
            self.near[n] = (last >> np.uint32(8)) ^ self.byte[last & 255]
        self.powers = [self._twice(self._twice(self.near[self.NEAR // 4]))]  # by 64, 128, ...

    def _twice(self, tables: np.ndarray) -> np.ndarray:
        return self._move(tables, tables)

    @staticmethod
    def _move(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return (tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255]
                ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24])

    def moved(self, crc: np.ndarray, by: np.ndarray) -> np.ndarray:
        """``crc`` moved past ``by`` bytes."""
        flat, low = self.near.reshape(-1), (by & (self.NEAR - 1)) << 10
        out = flat[low + (crc & 255)]
        for i, shift in ((1, 8), (2, 16), (3, 24)):
            out ^= flat[low + ((i << 8) + ((crc >> np.uint32(shift)) & 255))]
        high = by >> 6
        step = 0
        while high.any():
            if step == len(self.powers):
                self.powers.append(self._twice(self.powers[-1]))
            hit = np.flatnonzero(high & 1)
            out[hit] = self._move(self.powers[step], out[hit])
            high, step = high >> 1, step + 1
        return out

    def joined(self, first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of first + second, where ``length`` is the second one's."""
        return self.moved(first, length) ^ second

    def words(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of each word of ``raw``: a byte of all short ones at a time."""
        state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
        active = np.flatnonzero(lengths <= SHORT)
        at = 0
        while len(active):
            now = state[active]
            state[active] = (now >> np.uint32(8)) ^ self.byte[(now ^ raw[starts[active] + at]) & 255]
            at += 1
            active = active[lengths[active] > at]
        state ^= np.uint32(0xFFFFFFFF)
        for i in np.flatnonzero(lengths > SHORT).tolist():
            state[i] = zlib.crc32(raw[starts[i]:starts[i] + lengths[i]].tobytes())
        return state


def features(column: pa.Array, crc: Crc32, buckets: int = BUCKETS, run: int = RUN):
    """(row, bucket, words): owner and bucket of every feature, and words of each text.

    Words are the maximal runs of ASCII letters and digits and of all non-ASCII
    characters, A-Z lowered; a null text has none.
    """
    raw, offsets = text_bytes(column)
    raw = _LOWER[raw]
    inside = _IN_WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[0], edge[-1] = True, True
    edge[offsets] = True  # a text's end is a word's end
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    lengths = np.flatnonzero(inside & (~after | edge[1:])) + 1 - starts
    owner = np.searchsorted(offsets, starts, side="right") - 1
    words = np.bincount(owner, minlength=len(column)).astype(np.int64)
    last = one = crc.words(raw, starts, lengths)
    space = np.uint32(zlib.crc32(b" "))
    rows, hashes = [owner], [one]
    if len(starts) and run > 1:
        follows = crc.joined(np.full(len(one), space, np.uint32), one, lengths)
    for size in range(2, run + 1):
        if len(starts) < size:
            break
        last = crc.joined(last[:-1], follows[size - 1:], lengths[size - 1:] + 1)
        same = owner[size - 1:] == owner[:len(owner) - size + 1]
        rows.append(owner[size - 1:][same])
        hashes.append(last[same])
    return np.concatenate(rows), (np.concatenate(hashes) % np.uint32(buckets)).astype(np.int64), words


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded rows and bytes; a longer text is one of its own."""
    for batch in batches:
        for part in slices(batch, "text", BYTES):
            for start in range(0, part.num_rows, ROWS):
                yield part.slice(start, ROWS)


def _counted(buckets: int, run: int):
    """Features in each bucket, one row per task and bucket."""
    def tally(batches):
        crc, total = Crc32(), np.zeros(buckets, np.int64)
        for part in _parts(batches):
            total += np.bincount(features(part.column("text"), crc, buckets, run)[1], minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(found, pa.int32()), "n": pa.array(total[found])})
    return tally


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """(bucket, n): features of all texts of ``docs`` in each bucket that has any."""
    each = docs.select("text").mapInArrow(_counted(buckets, run), "bucket int, n bigint")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """The gain of each bucket: floor(1000 ln) of the ratio of smoothed shares.

    Counts are summed in Spark; as many numbers as there are buckets come back.
    """
    s, t = np.zeros(buckets), np.zeros(buckets)
    for side, df in ((s, docs), (t, target)):
        for r in bucket_counts(df, buckets, run).collect():
            side[r.bucket] = r.n
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def bit_planes(values: np.ndarray, bits: int) -> np.ndarray:
    """(rows, bits, words): bit i of all values of a row, packed 64 to a word."""
    rows, width = values.shape
    out = np.zeros((rows, bits, -(-width // 64) * 8), np.uint8)
    for i in range(bits):
        packed = np.packbits(((values >> i) & 1).astype(np.uint8), axis=1, bitorder="little")
        out[:, i, :packed.shape[1]] = packed
    return out.view(np.uint64)


def gain_planes(gain: np.ndarray) -> np.ndarray:
    """Two's complement planes of signed gains; the last one counts negative."""
    bits = int(max(gain.max(initial=0), -1 - gain.min(initial=0))).bit_length() + 1
    return bit_planes(gain[None, :], bits)[0]


def weights(counts: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The sum of count times gain of each row, by AND, population count and shifts."""
    total = np.zeros(len(counts), np.int64)
    most = int(counts.max(initial=0))
    bits = most.bit_length()
    sliced = bit_planes(counts.astype(np.min_scalar_type(most)), bits)
    for i in range(bits):
        some = np.flatnonzero(sliced[:, i].any(axis=1))  # the high planes of most texts are empty
        plane = sliced[some, i]
        for j, of_gain in enumerate(planes):
            ones = np.bitwise_count(plane & of_gain).sum(axis=1, dtype=np.int64)
            total[some] += -(ones << (i + j)) if j == len(planes) - 1 else ones << (i + j)
    return total


def _weighed(planes: np.ndarray, buckets: int, run: int):
    def score(batches):
        crc = Crc32()
        for part in _parts(batches):
            n = part.num_rows
            row, bucket, words = features(part.column("text"), crc, buckets, run)
            counts = np.bincount(row * buckets + bucket, minlength=n * buckets).reshape(n, buckets)
            yield pa.record_batch({
                "doc_id": part.column("doc_id"), "n_words": pa.array(words),
                "n_features": pa.array(np.bincount(row, minlength=n).astype(np.int64)),
                "weight": pa.array(weights(counts, planes))})
    return score


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             seed: int = SEED, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, n_words, weight, score, rank.

    Of the N rows with at least ``least_words`` words, floor(percent * N / 100) are drawn:
    those with the largest scores, ties to smaller ids; they get ranks from 1, the others
    null. A null or empty text, or one without words, has no features and weight 0, and
    is never drawn unless ``least_words`` is 0. A null id hashes as an empty one and
    comes last among ties; rows that share an id are rows of their own, ordered among
    themselves by their place. An empty target gives gains from the documents alone,
    an empty table no rows. Other columns are not read.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    goal = target.select(F.col("text").cast("string").alias("text"))
    planes = gain_planes(gains(source, goal, buckets, run))
    scored = source.mapInArrow(_weighed(planes, buckets, run),
                               "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    scored = stage(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    ordered = with_row_id(scored.where(able), [Sort("score", "DESC"), Sort("doc_id")])
    rank = F.col(ROW_ID) + 1
    ranked = ordered.select(*scored.columns, F.when(rank <= drawn, rank).alias("rank"))
    return ranked.union(scored.where(~able).withColumn("rank", F.lit(None).cast("bigint"))).select(
        "doc_id", "n_features", "n_words", "weight", "score", "rank")

"""Vector code compression: product codebooks fitted with adaptive distance bounds.

Vectors become integers and are cut into parts; each part position has a codebook, and
a vector's code names the nearest entry of each. Codebooks come from rounds of assigning
every part and moving each entry to the mean of its parts.

Most assignments do not change from round to round, and bounds show it without a
distance. Each part keeps, from round to round and with the vector in a written table,
an upper bound of the distance to its own entry, its b next closest entries with a lower
bound for each, in order, and one outer bound for all other entries. When entries move,
the bounds give way by how far they moved. A part whose upper bound is below its first
lower bound keeps its entry; one below the i-th is decided among its own and the i - 1
entries before it; one that reaches the outer bound looks at all. Whatever is not certain
is decided on exact integer distances, ties to the lower index, so bounds only save
work. b is adapted for each part position: it shrinks to what nearly all parts needed.

A round is one pass: tasks assign, write the state, and add up what the means need. Only
the codebooks and their sums, whose size the parameters fix, come to the driver.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.session import scratch_dir

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096

#: Bounds kept at first, fewest bounds kept, share of the parts that the bounds kept must serve.
MOST, FEWEST, SERVED = 8, 2, 0.99

#: Vectors of one numpy step.
STEP = 4096


@dataclass(frozen=True)
class Plan:
    """What all rounds share: where parts begin, and how vectors are stored."""

    dim: int
    cuts: tuple[int, ...]
    kind: str  # numpy type of a stored component

    def parts(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [vectors[:, a:b] for a, b in zip(self.cuts, self.cuts[1:])]


def largest_component(dim: int) -> int:
    """Up to this size of components all distances, and entry numbers beside them, are exact."""
    return math.isqrt((1 << 57) // max(1, dim)) - 1


def exact(vectors: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (n, k) or, for entries of each row (n, k, d), to those."""
    entries = entries if entries.ndim == 3 else entries[None]
    out = np.zeros((len(vectors), entries.shape[1]), np.int64)
    for i in range(vectors.shape[1]):  # no (n, k, d) array of differences
        out += (vectors[:, i, None] - entries[:, :, i]) ** 2
    return out


def _down(x: np.ndarray) -> np.ndarray:
    """float32 at or below x, with room for the rounding of what x came from; below 0 all is one."""
    return np.nextafter((np.maximum(x, 0) * (1 - 1e-9)).astype(np.float32), np.float32(-np.inf))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + 1e-9)).astype(np.float32), np.float32(np.inf))


@dataclass
class Bounds:
    """One part position of some vectors: own entry, its upper bound, the next entries
    with their lower bounds in order, and the outer bound as the last lower bound."""

    own: np.ndarray  # (n,) uint8
    upper: np.ndarray  # (n,) float32
    near: np.ndarray  # (n, b) uint8
    lower: np.ndarray  # (n, b + 1) float32

    @classmethod
    def fresh(cls, vectors: np.ndarray, entries: np.ndarray, b: int) -> Bounds:
        """From all distances."""
        n, k = len(vectors), len(entries)
        b = min(b, k - 1)
        square = exact(vectors, entries)
        order = np.argsort(square, axis=1, kind="stable")  # ties to the lower index
        away = np.sqrt(np.take_along_axis(square, order, 1).astype(np.float64))
        lower = np.full((n, b + 1), np.inf, np.float32)
        seen = min(b + 1, k - 1)
        lower[:, :seen] = _down(away[:, 1:seen + 1])
        return cls(order[:, 0].astype(np.uint8), _up(away[:, 0]), order[:, 1:b + 1].astype(np.uint8), lower)

    def moved(self, moves: np.ndarray) -> None:
        """Give way to entries that moved by ``moves``; keep lower bounds in order."""
        self.upper = _up(self.upper.astype(np.float64) + moves[self.own])
        b = self.near.shape[1]
        lower = self.lower.astype(np.float64)
        lower[:, :b] -= moves[self.near]
        lower[:, b] -= moves.max(initial=0)
        lower = np.minimum.accumulate(lower[:, ::-1], axis=1)[:, ::-1]
        self.lower = _down(lower)

    def decide(self, vectors: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, int]:
        """Settle every part. How many lower bounds each looked behind, and the number of
        distances it took."""
        b = self.near.shape[1]
        used = self._open()
        paid = 0
        rows = np.flatnonzero(used)
        if len(rows):  # first the upper bound alone is made exact
            square = exact(vectors[rows], entries[self.own[rows]][:, None, :])[:, 0]
            self.upper[rows] = _up(np.sqrt(square.astype(np.float64)))
            paid += len(rows)
            used[rows] = self._open(rows)
        for i in range(1, b + 1):
            rows = np.flatnonzero(used == i)
            if len(rows):
                some = np.concatenate([self.own[rows, None], self.near[rows, :i]], axis=1)
                square = exact(vectors[rows], entries[some])
                paid += square.size
                order = np.lexsort((some, square), axis=1)
                some, square = np.take_along_axis(some, order, 1), np.take_along_axis(square, order, 1)
                away = np.sqrt(square.astype(np.float64))
                self.own[rows], self.upper[rows] = some[:, 0], _up(away[:, 0])
                self.near[rows, :i] = some[:, 1:]
                lower = self.lower[rows]
                lower[:, :i] = _down(away[:, 1:])
                self.lower[rows] = np.minimum.accumulate(lower[:, ::-1], axis=1)[:, ::-1]
        rows = np.flatnonzero(used == b + 1)
        if len(rows):
            new = Bounds.fresh(vectors[rows], entries, b)
            self.own[rows], self.upper[rows], self.near[rows], self.lower[rows] = new.own, new.upper, new.near, new.lower
            paid += len(rows) * len(entries)
        return used, paid

    def _open(self, rows=slice(None)) -> np.ndarray:
        """How many lower bounds are not above the upper one: 0 if the entry is certain."""
        return (self.lower[rows] <= self.upper[rows, None]).sum(1)

    def kept(self, b: int) -> None:
        """Fewer bounds: the first one dropped, which is below all after it, becomes the outer one."""
        if b < self.near.shape[1]:
            self.near, self.lower = self.near[:, :b], self.lower[:, :b + 1]

    def packed(self) -> np.ndarray:
        n = len(self.own)
        fields = (self.own[:, None], self.near, self.upper[:, None], self.lower)
        return np.concatenate([np.ascontiguousarray(f).view(np.uint8).reshape(n, -1) for f in fields], axis=1)

    @classmethod
    def unpacked(cls, raw: np.ndarray, b: int) -> Bounds:
        floats = np.ascontiguousarray(raw[:, 1 + b:]).view(np.float32)
        return cls(raw[:, 0].copy(), floats[:, 0].copy(), raw[:, 1:1 + b].copy(), floats[:, 1:].copy())

    @staticmethod
    def size(b: int) -> int:
        return 1 + b + 4 * (b + 2)


def _rows(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _binaries(matrix: np.ndarray) -> pa.Array:
    """A fixed number of bytes per row as a binary column."""
    matrix = np.ascontiguousarray(matrix).view(np.uint8).reshape(len(matrix), -1)
    offsets = pa.py_buffer((np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, offsets, pa.py_buffer(matrix.tobytes())])


def _integers(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            vectors = flat.astype(plan.kind).reshape(batch.num_rows, plan.dim)
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), _binaries(vectors)],
                                  names=["vec_id", "label", "vec"])
    return run


def _assigned(plan: Plan, books: list[np.ndarray], before: list[np.ndarray] | None, keep: list[int], had: list[int]):
    """One round's assignment: the state of each vector after it.

    ``before`` are the codebooks that the stored bounds are about, ``had`` and ``keep``
    the bounds stored and to be stored per part.
    """
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                vectors = _rows(part.column("vec"), plan.kind, plan.dim).astype(np.int64)
                state = _rows(part.column("state"), np.uint8, sum(map(Bounds.size, had))) if before else None
                out, at = [], 0
                used, error = np.zeros((part.num_rows, len(books)), np.uint8), np.zeros(part.num_rows, np.int64)
                for p, x in enumerate(plan.parts(vectors)):
                    if before is None:
                        bounds = Bounds.fresh(x, books[p], keep[p])
                        used[:, p] = bounds.lower.shape[1]
                    else:
                        bounds = Bounds.unpacked(state[:, at:at + Bounds.size(had[p])], had[p])
                        at += Bounds.size(had[p])
                        bounds.kept(keep[p])
                        bounds.moved(np.sqrt(((books[p] - before[p]).astype(np.float64) ** 2).sum(1)) * (1 + 1e-9))
                        used[:, p] = bounds.decide(x, books[p])[0]
                    error += exact(x, books[p][bounds.own][:, None, :])[:, 0]
                    out.append(bounds.packed())
                yield pa.record_batch(
                    [part.column("vec_id"), part.column("label"), part.column("vec"),
                     _binaries(np.concatenate(out, axis=1)), _binaries(used), pa.array(error)],
                    names=["vec_id", "label", "vec", "state", "used", "error"])
    return run


def _summed(plan: Plan, entries: list[int], had: list[int]):
    """Per task: for each (part, entry) the count and sums of its parts, and for each
    (part, used) how many parts looked behind that many bounds."""
    def run(batches):
        sums = [np.zeros((k, b - a + 1), np.int64) for k, a, b in zip(entries, plan.cuts, plan.cuts[1:])]
        looks = np.zeros((len(entries), 256), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                vectors = _rows(part.column("vec"), plan.kind, plan.dim).astype(np.int64)
                state = _rows(part.column("state"), np.uint8, sum(map(Bounds.size, had)))
                used = _rows(part.column("used"), np.uint8, len(entries))
                at = 0
                for p, x in enumerate(plan.parts(vectors)):
                    own = state[:, at]
                    at += Bounds.size(had[p])
                    order = np.argsort(own, kind="stable")
                    names, first = np.unique(own[order], return_index=True)
                    if len(names):
                        sums[p][names, 1:] += np.add.reduceat(x[order], first, axis=0) if x.shape[1] else 0
                        sums[p][names, 0] += np.diff([*first, len(own)])
                    looks[p] += np.bincount(used[:, p], minlength=256)
        yield pa.RecordBatch.from_pylist(
            [{"kind": "sum", "part": p, "entry": e, "values": row.tolist()}
             for p, table in enumerate(sums) for e, row in enumerate(table) if row[0]]
            + [{"kind": "used", "part": p, "entry": int(e), "values": [int(looks[p, e])]}
               for p in range(len(entries)) for e in np.flatnonzero(looks[p])], schema=_SUMS)
    return run


_SUMS = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("entry", pa.int32()), ("values", pa.list_(pa.int64()))])


def _moved(state: DataFrame, plan: Plan, books: list[np.ndarray], had: list[int]):
    """(codebooks after the round, bounds to keep from now on)."""
    each = state.mapInArrow(_summed(plan, [len(b) for b in books], had),
                            "kind string, part int, entry int, `values` array<bigint>")
    spots = each.select("kind", "part", "entry", F.posexplode("values").alias("at", "x"))
    total = spots.groupBy("kind", "part", "entry", "at").agg(F.sum("x").alias("x"))
    # as many rows as the codebooks have numbers
    sums: dict = {}
    for r in total.collect():
        sums.setdefault((r.kind, r.part, r.entry), {})[r["at"]] = r.x
    after, keep = [b.copy() for b in books], list(had)
    for (kind, p, e), got in sums.items():
        if kind == "sum":
            after[p][e] = [got[i + 1] // got[0] for i in range(books[p].shape[1])]  # floors
    for p in range(len(books)):
        looks = np.array([sums.get(("used", p, i), {}).get(0, 0) for i in range(had[p] + 2)])
        # the first round has no bounds to judge by
        enough = int(np.searchsorted(np.cumsum(looks), SERVED * looks.sum()))
        keep[p] = min(had[p], max(FEWEST, enough))
    return after, keep


class _Rounds:
    """Written tables of which only the last two are kept: a round's table goes when
    the one made from it is complete."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.paths = spark, f"{scratch_dir(spark)}/codes-{uuid.uuid4().hex}", []

    def written(self, df: DataFrame) -> DataFrame:
        self.paths.append(f"{self.base}-{len(self.paths)}")
        df.write.parquet(self.paths[-1])
        if len(self.paths) > 1:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[-2])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])


def _books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def compress(table: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             most: int = MOST) -> DataFrame:
    """Per sound row: vec_id, code, error, label_error, codebooks_sha256, label.

    Rows whose vector is null or holds a null or non-finite component are left out. All codebooks are about vectors of one length, the commonest one (of equally
    common ones the shortest, empty ones aside), and about components up to ``largest_component``, beyond
    which distances would not be exact in 64 bits; rows of another length or with larger
    components come out with null code and error. Lengths that ``parts`` does not divide
    are cut as evenly as possible. Codebooks begin as the ``entries`` rows with the
    smallest keys (null keys last, equal keys by vector); with fewer rows there are fewer
    entries, and equal entries leave all but the first unused. Repeated rows count as
    often as they come. ``label_error`` is the sum of the errors of equal labels, nulls
    together; null if it does not fit a long. An empty table gives no rows.
    """
    spark = table.sparkSession
    number = F.col(column).cast("array<double>")
    sound = F.coalesce(F.forall(number, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))
    rows = table.where(F.col(column).isNotNull() & sound).select(
        F.col(key).cast("bigint").alias("vec_id"), F.col(label).alias("label"), number.alias("x"))
    common = rows.where(F.size("x") > 0).groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if common is None:
        return _with_labels(_uncoded(rows), None)
    limit = largest_component(common.dim)
    size = F.array_max(F.transform("x", lambda c: F.abs(F.floor(c * scale))))
    fits = (F.size("x") == common.dim) & F.forall(
        "x", lambda c: (c * scale < float(limit)) & (c * scale >= float(-limit)))
    good = rows.where(fits).select("vec_id", "label", F.transform("x", lambda c: F.floor(c * scale)).alias("x"))
    first = good.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    rest = _uncoded(rows.where(~fits))
    if not first:
        return _with_labels(rest, None)
    largest = rows.where(fits).agg(F.max(size)).first()[0]
    cuts = tuple(i * common.dim // parts for i in range(parts + 1))
    plan = Plan(common.dim, cuts, "int16" if largest < 1 << 15 else "int32")
    start = np.array([r.x for r in first], np.int64)
    books = [np.ascontiguousarray(x) for x in plan.parts(start)]
    keep = [min(most, len(start) - 1)] * parts
    label_type = good.schema["label"].dataType.simpleString()
    fields = f"vec_id bigint, label {label_type}, vec binary"
    tables = _Rounds(spark)
    state = tables.written(good.mapInArrow(_integers(plan), fields))
    before = None
    for turn in range(rounds + 1):
        had = keep if before is None else keep_before
        state = tables.written(state.mapInArrow(
            _assigned(plan, books, before, keep, had), fields + ", state binary, used binary, error bigint"))
        before, keep_before = books, keep
        if turn < rounds:
            books, keep = _moved(state, plan, books, keep)
    # the own entry is the first byte of each part's state
    digits = F.hex(F.concat(*[F.substring("state", 1 + sum(map(Bounds.size, keep_before[:p])), 1) for p in range(parts)]))
    coded = state.select("vec_id", "label", F.lower(digits).alias("code"), "error")
    return _with_labels(coded.union(rest), _books_digest(books))


def _uncoded(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"),
                       F.lit(None).cast("bigint").alias("error"))


def _with_labels(coded: DataFrame, digest: str | None) -> DataFrame:
    """Add the sum of errors of equal labels: summed map-side, one row per label."""
    sums = coded.groupBy(F.struct("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"))
    rows = coded.withColumn("of", F.struct("label"))
    return rows.join(sums, "of", "left").select(
        "vec_id", "code", "error", F.expr("try_cast(sum AS bigint)").alias("label_error"),
        F.lit(digest).cast("string").alias("codebooks_sha256"), "label")


def compress_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same codes in DuckDB SQL, all distances of all rounds computed."""
    steps = [f"""
    kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
        list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    cut AS MATERIALIZED (SELECT r, p, v[1 + p * len(v) // {parts} : (p + 1) * len(v) // {parts}] AS x
        FROM kept, (SELECT unnest(range({parts})) AS p)),
    book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM cut WHERE r <= {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""
    near{i} AS MATERIALIZED (SELECT r, p, min(d * {entries} + e) AS best FROM (SELECT r, p, e, CAST(list_sum(
        list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
        FROM cut JOIN book{i} USING (p)) GROUP BY r, p)""")
        if i < rounds:
            steps.append(f"""
    mean{i} AS (SELECT p, e, pos, CAST(sum(val) AS BIGINT) AS s, count(*) AS n FROM
        (SELECT p, best % {entries} AS e, unnest(x) AS val, unnest(range(len(x))) AS pos
         FROM near{i} JOIN cut USING (r, p)) GROUP BY p, e, pos),
    book{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN
        (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS c FROM mean{i} GROUP BY p, e) m
        ON b.p = m.p AND b.e = m.e)""")
    steps.append(f"""
    code AS (SELECT r, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code,
        CAST(sum(best // {entries}) AS BIGINT) AS error FROM near{rounds} GROUP BY r),
    sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM kept JOIN code USING (r), sha""")
    return "WITH " + ",".join(steps[:-1]) + "," + steps[-1]

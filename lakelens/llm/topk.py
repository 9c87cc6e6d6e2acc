"""Exact top-k inner products through a pivot-distance index.

Vectors become integers, and every vector is lifted by one coordinate so that all
have the same length: then a larger inner product with a query is a smaller distance
to it, and distances obey the triangle inequality. The index keys each vector by its
nearest pivot and its distance to that pivot; a range partitioning on those keys puts
the vectors in order, and consecutive ones of one pivot form an annulus with a known
range of distances.

A query first meets its own annulus, which gives it a k-th best score so far. Blocks of
queries then meet the table of annuli, which has no vectors: the triangle inequality's
bound |d(query, pivot) - d(vector, pivot)| tells which annuli can still hold a score
that counts for a query of the block (ties included), and how near they can be. Vectors
are sent for those pairs alone, in two rounds: a few of the nearest annuli first, which
raise the k-th scores, then what still passes under the raised ones. A task takes a
block's annuli in order of their bound and stops at the first one beyond all its queries.
Scores are exact integers; a bound is never tighter than rounding allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakelens.session import stage

#: Vectors of an annulus and queries of a block.
ANNULUS, QUERIES = 2048, 4096

#: Rows of which the pivots are chosen, and how many are.
PIVOT_SAMPLE, PIVOTS = 2048, 32

#: Annuli of the first round, of a task's run, and rows of the table of annuli met at once.
NEAREST, RUN, ROWS = 4, 32, 1024

_EXACT = float(2**52)


def _matrix(column: pa.Array, dim: int, kind: str = "i8") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), dim).astype(np.int64)


def narrowest(most: int) -> str:
    """The narrowest integer type for components up to ``most`` in size."""
    return next(k for k in ("i1", "i2", "i4", "i8") if most <= np.iinfo(k).max)


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products: in float64 where all partial sums are exact there."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    if most < _EXACT:
        return (queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    if most >= 2.0**63:
        raise OverflowError("inner products do not fit into 64 bits")
    return queries @ vectors.T


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first points of a sample: each next pivot is farthest from those before."""
    if not len(sample):
        return sample
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def integer_vectors(table: DataFrame, key: str, column: str, scale: int) -> DataFrame:
    """(vec_id, row, dim, vec): floor(scale * x) of each component as packed 64-bit
    integers. Rows without id or vector, or with a null or non-finite component,
    are left out, and so are those with a component so large that inner products of
    such vectors would not fit into 63 bits."""
    x = F.transform(column, lambda c: F.floor(c.cast("double") * scale))
    most = F.sqrt(F.lit(2.0**62) / F.greatest(F.size(column), F.lit(1)))
    sound = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c.cast("double"))
                     & (F.abs(c.cast("double")) * scale < most - 1))
    return table.where(F.col(key).isNotNull() & F.col(column).isNotNull() & F.coalesce(sound, F.lit(False))).select(
        F.col(key).cast("bigint").alias("vec_id"), F.monotonically_increasing_id().alias("row"),
        F.size(column).alias("dim"), x.alias("x"))


def _packed(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(kind)
            ends = np.cumsum(batch.column("dim").to_numpy()) * flat.itemsize
            raw = flat.tobytes()
            vec = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
            yield pa.record_batch([batch.column("vec_id"), batch.column("row"), batch.column("dim"),
                                   pa.array(vec, pa.binary())], names=["vec_id", "row", "dim", "vec"])
    return run


def _lift(vectors: np.ndarray, top: float) -> np.ndarray:
    """The lifting coordinate of each vector: all become as long as the longest."""
    return np.sqrt(np.maximum(top - (vectors.astype(np.float64) ** 2).sum(1), 0))


def _distances(vectors: np.ndarray, lift: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of lifted vectors to pivots, which have the lifting coordinate as their last."""
    x = np.concatenate([vectors.astype(np.float64), lift[:, None]], 1)
    square = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _keyed(pivots: dict[int, np.ndarray], tops: dict[int, float], kind: str):
    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                v = _matrix(part.column("vec"), dim, kind)
                away = _distances(v, _lift(v, tops[dim]), pivots[dim])
                near = away.argmin(1)
                yield pa.record_batch([*part.columns, pa.array(near, pa.int32()), pa.array(away.min(1))],
                                      names=[*part.schema.names, "pivot", "away"])
    return run


_RING = ("ring bigint, dim int, pivot int, near double, far double, ids binary, rows binary, vecs binary, "
         "asks binary")


def _ringed(every: int, k: int, size: int, kind: str):
    """Annuli from rows sorted by (dim, pivot, away); ``asks`` holds, for the queries
    among an annulus's vectors, their place in it and their k-th best score in it."""
    def ring(place, number, rows: pa.Table):
        dim = rows.column("dim")[0].as_py()
        v = _matrix(rows.column("vec").combine_chunks(), dim, kind)
        ids = rows.column("vec_id").to_numpy()
        own = np.flatnonzero(ids % every == 0)
        asks = b""
        if len(own):
            scores = _scores(v[own], v)
            scores[np.arange(len(own)), own] = np.iinfo(np.int64).min
            kth = (np.partition(scores, len(v) - k, axis=1)[:, len(v) - k] if len(v) > k
                   else np.full(len(own), np.iinfo(np.int64).min))
            asks = np.stack([own, kth], 1).astype(np.int64).tobytes()
        away = rows.column("away").to_numpy()
        return {"ring": (place << 32) + number, "dim": dim, "pivot": rows.column("pivot")[0].as_py(),
                "near": float(away.min()), "far": float(away.max()), "ids": ids.tobytes(),
                "rows": rows.column("row").to_numpy().tobytes(), "vecs": v.astype(kind).tobytes(), "asks": asks}

    def run(batches):
        held, number, place = None, 0, 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            place = table.column("part")[0].as_py()
            held = pa.concat_tables([held, table]) if held is not None else table
            while held.num_rows:
                dims, pivots = (held.column(c).to_numpy() for c in ("dim", "pivot"))
                change = np.flatnonzero((dims != dims[0]) | (pivots != pivots[0]))
                cut = min(size, int(change[0]) if len(change) else held.num_rows + 1)
                if cut > held.num_rows:
                    break  # the annulus may go on in the next batch
                yield pa.RecordBatch.from_pylist([ring(place, number, held.slice(0, cut))], schema=_RING_ARROW)
                held, number = held.slice(cut), number + 1
        if held is not None and held.num_rows:
            for start in range(0, held.num_rows, size):
                yield pa.RecordBatch.from_pylist([ring(place, number, held.slice(start, size))], schema=_RING_ARROW)
                number += 1
    return run


_RING_ARROW = pa.schema([("ring", pa.int64()), ("dim", pa.int32()), ("pivot", pa.int32()), ("near", pa.float64()),
                         ("far", pa.float64()), ("ids", pa.binary()), ("rows", pa.binary()), ("vecs", pa.binary()),
                         ("asks", pa.binary())])


def _asked(pivots, kind: str):
    """The queries of an annulus as one row: ids, rows, vectors, k-th scores and
    their distances to all pivots."""
    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                asks = np.frombuffer(x["asks"], np.int64).reshape(-1, 2)
                v = np.frombuffer(x["vecs"], kind).reshape(len(x["ids"]) // 8, x["dim"])[asks[:, 0]]
                away = _distances(v, np.zeros(len(v)), pivots[x["dim"]])
                pick = lambda name: np.frombuffer(x[name], np.int64)[asks[:, 0]]
                ids, rows = pick("ids"), pick("rows")
                yield pa.record_batch({
                    "dim": pa.array([x["dim"]] * len(v), pa.int32()),
                    "pivot": pa.array([x["pivot"]] * len(v), pa.int32()),
                    "home": pa.array([(x["near"] + x["far"]) / 2] * len(v)),
                    "query_id": pa.array(ids), "query_row": pa.array(rows), "kth": pa.array(asks[:, 1]),
                    "vec": pa.array([r.tobytes() for r in np.ascontiguousarray(v)], pa.binary()),
                    "away": pa.array([r.tobytes() for r in away], pa.binary())})
    return run


def _blocked(size: int):
    """Queries of one length in blocks."""
    names = ("query_id", "query_row", "kth", "vec", "away")

    def block(place, number, rows: pa.Table):
        data = {n: (b"".join(rows.column(n).to_pylist()) if n in ("vec", "away")
                    else rows.column(n).to_numpy().astype(np.int64).tobytes()) for n in names}
        return pa.RecordBatch.from_pylist(
            [{"block": (place << 32) + number, "dim": rows.column("dim")[0].as_py(), **data}],
            schema=pa.schema([("block", pa.int64()), ("dim", pa.int32()), *[(n, pa.binary()) for n in names]]))

    def run(batches):
        number, held, place = 0, None, 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            place = table.column("part")[0].as_py()
            held = pa.concat_tables([held, table]) if held is not None else table
            while held.num_rows:
                dims = held.column("dim").to_numpy()
                change = np.flatnonzero(dims != dims[0])
                cut = min(size, int(change[0]) if len(change) else held.num_rows + 1)
                if cut > held.num_rows:
                    break
                yield block(place, number, held.slice(0, cut))
                held, number = held.slice(cut), number + 1
        if held is not None and held.num_rows:
            yield block(place, number, held)
    return run


def _limits(away: np.ndarray, near, far, square: np.ndarray, top: float) -> np.ndarray:
    """The largest score that each query can have with a vector of an annulus.

    distance**2 = |query|**2 + top - 2 * score, and no distance is below the bound.
    """
    least = np.maximum(0, np.maximum(away - far, near - away))
    limit = (square + top - least**2) / 2
    return limit + 1e-9 * (np.abs(limit) + square + top) + 1e-6  # rounding of the bound


def _queries(x: dict, kind: str) -> dict:
    n = len(x["query_id"]) // 8
    q = {name: np.frombuffer(x[name], np.int64) for name in ("query_id", "query_row", "kth")}
    q["vec"] = np.frombuffer(x["vec"], kind).reshape(n, x["dim"]).astype(np.int64)
    q["away"] = np.frombuffer(x["away"], np.float64).reshape(n, len(x["away"]) // (8 * n))
    q["square"] = (q["vec"].astype(np.float64) ** 2).sum(1)
    q["kth"] = q["kth"].copy()
    return q


def _planned(tops, kind: str):
    """(block, ring, best): the annuli that can hold a score that counts for a query of
    the block, and the largest margin by which one can."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.slice(i, 1).to_pylist()[0]
                q, best = _queries(x, kind), []
                for ring in x["rings"]:
                    limit = _limits(q["away"][:, ring["pivot"]], ring["near"], ring["far"], q["square"], tops[x["dim"]])
                    best.append(float((limit - q["kth"]).max()))
                best = np.array(best)
                some = np.flatnonzero(best >= 0)
                yield pa.record_batch({
                    "block": pa.array([x["block"]] * len(some), pa.int64()),
                    "ring": pa.array([x["rings"][n]["ring"] for n in some.tolist()], pa.int64()), "best": pa.array(best[some])})
    return run


def _searched(k: int, tops, kind: str):
    """Top k of each query of a block over one run of annuli.

    Rows come sorted by (block, run, place): first the block, then its annuli in order of
    what they can give, so that the first which cannot give anything ends the run.
    """
    def finish(q):
        counts = [len(s) for s, _ in q["best"]]
        return pa.record_batch({
            "block": pa.array(np.full(sum(counts), q["block"])),
            "query_id": pa.array(np.repeat(q["query_id"], counts)),
            "query_row": pa.array(np.repeat(q["query_row"], counts)),
            "score": pa.array(np.concatenate([np.empty(0, np.int64), *[s for s, _ in q["best"]]])),
            "vec_id": pa.array(np.concatenate([np.empty(0, np.int64), *[i for _, i in q["best"]]]))})

    def gained(q) -> float:
        """By how much the k-th score of every query at least has risen since the plan."""
        if q["start"].min() < -(2**62):
            return -np.inf  # some query had none
        return float((q["kth"] - q["start"]).min()) - 1

    def meet(q, x):
        limit = _limits(q["away"][:, x["pivot"]], x["near"], x["far"], q["square"], tops[x["dim"]])
        alive = np.flatnonzero(limit >= q["kth"])
        if not len(alive):
            return
        ids, rows = (np.frombuffer(x[c], np.int64) for c in ("ids", "rows"))
        v = np.frombuffer(x["vecs"], kind).reshape(len(ids), x["dim"]).astype(np.int64)
        scores = _scores(q["vec"][alive], v)
        keep = scores >= q["kth"][alive][:, None]
        for i in np.flatnonzero(keep.any(1)).tolist():
            n = alive[i]
            hit = np.flatnonzero(keep[i])
            hit = hit[rows[hit] != q["query_row"][n]]
            have = q["best"][n]
            s, d = np.concatenate([have[0], scores[i][hit]]), np.concatenate([have[1], ids[hit]])
            if len(s) > k:
                order = np.lexsort((d, -s))[:k]
                s, d = s[order], d[order]
            if len(s) == k:
                q["kth"][n] = max(q["kth"][n], s.min())
            q["best"][n] = s, d

    def run(batches):
        q = None
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.slice(i, 1).to_pylist()[0]
                if x["ring"] is None:
                    if q is not None:
                        yield finish(q)
                    q = _queries(x, kind)
                    q["block"], q["start"] = x["block"], q["kth"].copy()
                    q["best"] = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in q["kth"]]
                elif x["best"] >= gained(q):  # else no query of the block can gain from here on
                    meet(q, x)
        if q is not None:
            yield finish(q)
    return run


def _raised(k: int):
    """Blocks with the k-th scores that (query_row, score) lists in ``found`` prove."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.slice(i, 1).to_pylist()[0]
                kth = np.frombuffer(x["kth"], np.int64).copy()
                proved = dict(zip(x["proved_rows"] or (), x["proved"] or ()))
                for n, row in enumerate(np.frombuffer(x["query_row"], np.int64).tolist()):
                    kth[n] = max(kth[n], proved.get(row, kth[n]))
                row = {c: x[c] for c in ("block", "dim", "query_id", "query_row", "vec", "away")}
                yield pa.RecordBatch.from_pylist([row | {"kth": kth.tobytes()}], schema=_BLOCK)
    return run


_BLOCK = pa.schema([("block", pa.int64()), ("dim", pa.int32()), *[
    (n, pa.binary()) for n in ("query_id", "query_row", "kth", "vec", "away")]])
_BLOCK_SQL = "block bigint, dim int, query_id binary, query_row binary, kth binary, vec binary, away binary"


def top_k(table: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = 20, every: int = 20,
          scale: int = 64, annulus: int = ANNULUS, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by ``every``,
    the ``k`` other rows with the largest integer inner products, ties to smaller keys.

    Rows with a null key, vector or component, or a non-finite one, take no part, nor do
    vectors with a component so large that inner products would not fit into 63 bits.
    Vectors of different lengths are not compared. Repeated rows are rows of their own:
    a query does not meet itself but its copies. An empty table gives no rows; a query
    with fewer than ``k`` candidates gives all. Pivots come from at most
    ``PIVOT_SAMPLE`` rows per vector length, smallest hash of the key first; every
    row is indexed.
    """
    spark = table.sparkSession
    whole = integer_vectors(table, key, column, scale)
    most = whole.agg(F.max(F.array_max(F.transform("x", lambda c: F.greatest(c, -c))))).first()[0]
    if most is None:
        most = 0
    kind = narrowest(most)
    rows = stage(whole.mapInArrow(_packed(kind), "vec_id bigint, row bigint, dim int, vec binary"))
    # a bounded sample per length: the first of each of so many hash buckets
    sample = rows.groupBy("dim", F.pmod(F.xxhash64("vec_id"), F.lit(PIVOT_SAMPLE)).alias("slot")).agg(
        F.min("row").alias("row")).join(rows.select("row", "vec"), "row").orderBy("dim", "slot")
    square = rows.mapInArrow(_squares(kind), "dim int, square double").groupBy("dim").agg(F.max("square").alias("top"))
    tops = {r.dim: r.top for r in square.collect()}
    if not tops:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    packed: dict[int, list] = {}
    for r in sample.select("dim", "vec").collect():
        packed.setdefault(r.dim, []).append(bytes(r.vec))
    pivots = {}
    for dim, parts in packed.items():
        v = np.frombuffer(b"".join(parts), kind).reshape(len(parts), dim)
        pivots[dim] = choose_pivots(np.concatenate([v.astype(float), _lift(v, tops[dim])[:, None]], 1), PIVOTS)
    keyed = rows.mapInArrow(_keyed(pivots, tops, kind),
                            "vec_id bigint, row bigint, dim int, vec binary, pivot int, away double")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, "dim", "pivot", "away", "row").sortWithinPartitions(
        "dim", "pivot", "away", "row").withColumn("part", F.spark_partition_id())
    rings = stage(ordered.mapInArrow(_ringed(every, k, annulus, kind), _RING))
    asks = rings.where("octet_length(asks) > 0").mapInArrow(
        _asked(pivots, kind), "dim int, pivot int, home double, query_id bigint, query_row bigint, kth bigint, "
        "vec binary, away binary")
    # a block's queries are of one region, as far as its size allows
    near = asks.repartitionByRange(max(1, parts // 4), "dim", "pivot", "home", "query_row").sortWithinPartitions(
        "dim", "pivot", "home").withColumn("part", F.spark_partition_id())
    blocks = stage(near.mapInArrow(_blocked(block), _BLOCK_SQL))

    # the table of annuli has no vectors; it is met in rows of many
    listed = rings.select("dim", "pivot", "near", "far", "ring").groupBy(
        "dim", F.pmod(F.xxhash64("ring"), F.lit(-(-rings.count() // ROWS) or 1)).alias("part")).agg(
        F.collect_list(F.struct("ring", "pivot", "near", "far")).alias("rings"))

    def plan(blocks: DataFrame) -> DataFrame:
        met = blocks.join(listed.drop("part"), "dim").mapInArrow(
            _planned(tops, kind), "block bigint, ring bigint, best double")
        order = Window.partitionBy("block").orderBy(F.desc("best"), "ring")
        return stage(met.withColumn("place", F.row_number().over(order)))

    def search(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
        pairs = pairs.withColumn("run", F.expr(f"(place - 1) div {RUN}"))
        empty = lambda names, kind: [F.lit(None).cast(kind).alias(n) for n in names]
        own = ("query_id", "query_row", "kth", "vec", "away")
        # a run gets its block once, and then its annuli
        heads = pairs.select("block", "run").distinct().join(blocks, "block").select(
            "block", "run", F.lit(0).alias("place"), "dim", *own, *empty(["best"], "double"),
            *empty(["ring"], "bigint"), *empty(["pivot"], "int"), *empty(["near", "far"], "double"),
            *empty(["ids", "rows", "vecs"], "binary"))
        tails = pairs.join(rings.drop("asks"), "ring").select(
            "block", "run", "place", "dim", *empty(own, "binary"), "best", "ring", "pivot", "near", "far", "ids", "rows", "vecs")
        return heads.union(tails).repartition("block", "run").sortWithinPartitions("block", "run", "place").mapInArrow(
            _searched(k, tops, kind), "block bigint, query_id bigint, query_row bigint, score bigint, vec_id bigint")

    first = plan(blocks).where(F.col("place") <= NEAREST)
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    best = stage(search(first, blocks).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    proved = best.where(F.col("rank") == k).groupBy("block").agg(
        F.collect_list("query_row").alias("proved_rows"), F.collect_list("score").alias("proved"))
    raised = stage(blocks.join(proved, "block", "left").mapInArrow(_raised(k), _BLOCK_SQL))
    rest = plan(raised).join(first.select("block", "ring"), ["block", "ring"], "left_anti")
    rest = rest.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("best"), "ring")))
    found = best.select("query_id", "query_row", "score", "vec_id").union(
        search(rest, raised).select("query_id", "query_row", "score", "vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _squares(kind: str):
    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                v = _matrix(batch.column("vec").filter(pa.array(dims == dim)), dim, kind).astype(np.float64)
                yield pa.record_batch({"dim": pa.array([dim], pa.int32()), "square": pa.array([(v**2).sum(1).max()])})
    return run

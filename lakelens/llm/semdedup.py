"""Near-duplicate vectors of equal label, by spherical k-means cells and blocked products.

Rows of equal label and vector become one representative, which goes on with its number
of rows. Spherical k-means, fitted on a bounded sample, assigns each representative to
the cell whose centre it makes the smallest angle with. Representatives are put in order
of label, cell and that angle and cut into blocks of one cell; consecutive blocks of one
label make a tile. Blocks and tiles know the span of their vectors' angles to every
centre.

Angles obey the triangle inequality, which settles most pairs before any vector moves:
two tiles whose spans lie further apart than the widest linked angle, at some centre,
hold no link; two whose spans, added, do not reach it hold nothing but links, and are
counted as such. What is left are pairs of tiles, each the work of one task: its pairs of
blocks go through the same test, then through a matrix product in double precision. So
no link is lost at a cell's border, a tight cluster of any size costs sums of its tiles'
sizes, and cells that are far apart never meet. Vectors without clusters have angles
the bounds cannot tell apart: then all tiles of a label meet, in blocks.

Only counts and the links that join components come out of a task. One row of each
component is kept, the one with the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.llm.near import components
from lakelens.session import bounded_broadcast, stage
from lakelens.sources.schema import field_of

#: Vectors of a block, and bytes of the vectors of a tile, at most.
BLOCK, TILE_BYTES = 1024, 16 << 20

#: Rows the centres are fitted on, rounds of fitting, and representatives of a label for
#: each of its cells. A label has 1, 4, 16, 64 or 256 cells.
SAMPLE, SAMPLE_BYTES, FITS, PER_CELL = 8192, 32 << 20, 8, 128
CELLS = (1, 4, 16, 64, 256)

#: Radians by which bounds give way to rounding.
SLACK = 1e-6


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled first, so that no square over- or underflows."""
    vectors = vectors / np.maximum(np.abs(vectors).max(axis=1, keepdims=True, initial=0), np.finfo(float).tiny)
    return vectors / np.sqrt((vectors**2).sum(1, keepdims=True))


def _matrix(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), dim).astype(np.float64)


def centres(sample: np.ndarray, count: int, fits: int = FITS) -> np.ndarray:
    """Spherical k-means: sums of the cells' unit vectors, made unit again.

    Starts at points each of which is farthest from those before it; an empty cell keeps
    its centre.
    """
    chosen = [0]
    most = sample @ sample[0]
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(most.argmin()))
        most = np.maximum(most, sample @ sample[chosen[-1]])
    out = sample[chosen].copy()
    for _ in range(fits):
        cell = (sample @ out.T).argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, cell, sample)
        length = np.sqrt((sums**2).sum(1))
        some = length > 1e-9
        out[some] = sums[some] / length[some, None]
    return out


def angles(vectors: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ to.T, -1, 1))


def _packed(kind: str):
    """Vectors as the bytes of their numbers; one whose length is 0 as null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            flat = (flat + 0.0).astype(kind)  # -0.0 is 0.0
            ends = np.cumsum(batch.column("dim").to_numpy())
            raw, width = flat.tobytes(), flat.itemsize
            vec = [raw[width * a:width * b] if np.any(flat[a:b]) else None
                   for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), batch.column("dim"),
                                   pa.array(vec, pa.binary())], names=["vec_id", "label", "dim", "vec"])
    return run


def _celled(models: dict[int, dict[int, np.ndarray]], kind: str):
    """Cell and angle to its centre, by the model of the vector's length and cells."""
    def run(batches):
        for batch in batches:
            dims, cells = (batch.column(c).to_numpy() for c in ("dim", "cells"))
            cell, away = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for dim, count in {*zip(dims.tolist(), cells.tolist())}:
                rows = np.flatnonzero((dims == dim) & (cells == count))
                if dim in models:
                    to = angles(units(_matrix(batch.column("vec").take(pa.array(rows)), dim, kind)), models[dim][count])
                    cell[rows], away[rows] = to.argmin(1), to.min(1)
            yield pa.record_batch([*batch.columns, pa.array(cell), pa.array(away)],
                                  names=[*batch.schema.names, "cell", "away"])
    return run


_BLOCKS = pa.schema([
    ("tile", pa.int64()), ("block", pa.int32()), ("group", pa.string()), ("dim", pa.int32()), ("cells", pa.int32()),
    ("rows", pa.int32()), ("weight", pa.int64()), ("lo", pa.list_(pa.float32())), ("hi", pa.list_(pa.float32())),
    ("lead", pa.int64()), ("v", pa.binary()), ("n", pa.binary()), ("vecs", pa.binary())])


def _blocked(models, block: int, tile_bytes: int, kind: str):
    """Blocks of rows sorted by (group, cell, away); block -1 of each tile has its sums."""
    def one(tile, number, rows: pa.Table):
        dim, cells = rows.column("dim")[0].as_py(), rows.column("cells")[0].as_py()
        raw = rows.column("vec").combine_chunks()
        to = angles(units(_matrix(raw, dim, kind)), models[dim][cells]) if dim in models else np.zeros((len(rows), 0))
        v, n = (rows.column(c).to_numpy() for c in ("v", "n"))
        return {"tile": tile, "block": number, "group": rows.column("group")[0].as_py(), "dim": dim, "cells": cells,
                "rows": len(n), "weight": int(n.sum()),
                "lo": (to.min(0) - SLACK).tolist(), "hi": (to.max(0) + SLACK).tolist(),
                "lead": int(v[0]), "v": v.tobytes(), "n": n.tobytes(), "vecs": b"".join(raw.to_pylist())}

    def whole(blocks):
        """What the blocks of a tile have together."""
        return {**blocks[0], "block": -1, "rows": sum(b["rows"] for b in blocks),
                "weight": sum(b["weight"] for b in blocks), "v": b"",
                "lo": np.min([b["lo"] for b in blocks], axis=0).tolist(),
                "hi": np.max([b["hi"] for b in blocks], axis=0).tolist()}

    def run(batches):
        held, made, tile, size, place = None, [], 0, 0, 0

        def emit(rows: pa.Table):
            nonlocal made, tile, size
            out = []
            if made and (made[0]["group"] != rows.column("group")[0].as_py() or size >= tile_bytes):
                out, made, tile, size = [whole(made)], [], tile + 1, 0
            row = one((place << 32) + tile, len(made), rows)
            size += len(row["vecs"])
            made.append({**row, "n": b"", "vecs": b""})
            return pa.RecordBatch.from_pylist([*out, row], schema=_BLOCKS)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            place = table.column("part")[0].as_py()
            held = pa.concat_tables([held, table]) if held is not None else table
            while held.num_rows:
                group, cell = held.column("group").combine_chunks(), held.column("cell").to_numpy()
                other = pa.compute.not_equal(group, group[0]).to_numpy(zero_copy_only=False)
                change = np.flatnonzero(other | (cell != cell[0]))
                cut = min(block, int(change[0]) if len(change) else held.num_rows + 1)
                if cut > held.num_rows:
                    break  # the block may go on in the next batch
                yield emit(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield emit(held)
        yield pa.RecordBatch.from_pylist([whole(made)] if made else [], schema=_BLOCKS)
    return run


NONE, SOME, ALL = 0, 1, 2


def bound(lo_a, hi_a, lo_b, hi_b, widest: float) -> np.ndarray:
    """Whether pairs across two spans are links: none, all, or some may be.

    Spans are angles to the same centres along the last axis.
    """
    apart = np.maximum(lo_a - hi_b, lo_b - hi_a).max(-1, initial=-np.inf)
    within = (hi_a + hi_b).min(-1, initial=np.inf)
    return np.where(apart > widest, NONE, np.where(within < widest, ALL, SOME))


def _planned(widest: float):
    """The pairs of tiles that hold links, or may: ``kind`` tells which."""
    def run(batches):
        for batch in batches:
            sides = [[np.array(x, np.float64) for x in batch.column(c).to_pylist()] for c in ("lo_a", "hi_a", "lo_b", "hi_b")]
            kind = np.array([int(bound(*x, widest)) for x in zip(*sides)], np.int32)
            out = pa.record_batch([batch.column(c) for c in ("a", "b", "weight_a", "weight_b", "lead_a", "lead_b")]
                                  + [pa.array(kind, pa.int32())],
                                  names=["a", "b", "weight_a", "weight_b", "lead_a", "lead_b", "kind"])
            yield out.filter(pa.array(kind != NONE))
    return run


class _Unit:
    """The blocks of one pair of tiles, and what is found between them."""

    def __init__(self, a: int, b: int, least: float, kind: str):
        self.a, self.b, self.kind = a, b, kind
        self.least, self.widest = least, float(np.arccos(least))
        self.blocks = {a: [], b: []}

    def add(self, x: dict) -> None:
        v, n = (np.frombuffer(x[c], np.int64) for c in ("v", "n"))
        vectors = np.frombuffer(x["vecs"], self.kind).reshape(len(v), x["dim"])
        self.blocks[x["tile"]].append({
            "v": v, "n": n, "vecs": units(vectors.astype(np.float64)),
            "lo": np.array(x["lo"]), "hi": np.array(x["hi"])})

    def result(self) -> pa.RecordBatch:
        """(v, links, to): rows linked with, itself included, and the smallest v joined with."""
        sides = [self.blocks[self.a]] if self.a == self.b else [self.blocks[self.a], self.blocks[self.b]]
        v = np.concatenate([x["v"] for side in sides for x in side])
        starts = np.cumsum([0, *[len(x["v"]) for side in sides for x in side]])
        links, root = np.zeros(len(v), np.int64), np.arange(len(v))
        left = list(zip(starts, sides[0]))
        right = list(zip(starts[len(sides[0]):], sides[-1])) if len(sides) > 1 else left
        for i, (s, x) in enumerate(left):
            for t, y in (right[i:] if len(sides) == 1 else right):
                kind = bound(x["lo"], x["hi"], y["lo"], y["hi"], self.widest)
                at_x, at_y = slice(s, s + len(x["v"])), slice(t, t + len(y["v"]))
                if kind == ALL:
                    links[at_x] += y["n"].sum()
                    if s != t:
                        links[at_y] += x["n"].sum()
                    _join_all(root, at_x, at_y)
                elif kind == SOME:
                    hit = x["vecs"] @ y["vecs"].T >= self.least
                    if hit.any():
                        p, q = np.nonzero(hit)
                        np.add.at(links, p + s, y["n"][q])
                        if s != t:
                            np.add.at(links, q + t, x["n"][p])
                        _join(root, p + s, q + t)
        root = _settled(root)
        # a component of the unit is named by its smallest vertex
        least = np.full(len(v), np.iinfo(np.int64).max)
        np.minimum.at(least, root, v)
        found = np.flatnonzero(links)
        return pa.record_batch({"v": pa.array(v[found]), "links": pa.array(links[found]),
                                "to": pa.array(least[root][found])})


def _settled(root: np.ndarray) -> np.ndarray:
    while True:
        up = root[root]
        if np.array_equal(up, root):
            return root
        root = up


def _join(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Lead the ends of all pairs to common roots; ``root`` is changed in place."""
    while True:
        root[:] = _settled(root)
        a, b = root[p], root[q]
        apart = a != b
        if not apart.any():
            return
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))


def _join_all(root: np.ndarray, *parts: slice) -> None:
    root[:] = _settled(root)
    ends = np.unique(np.concatenate([root[p] for p in parts]))
    root[ends] = ends[0]


def _met(least: float, kind: str):
    """Rows come sorted by (a, b): a unit is complete when the next one begins."""
    def run(batches):
        unit = None
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.slice(i, 1).to_pylist()[0]
                if unit is None or (unit.a, unit.b) != (x["a"], x["b"]):
                    if unit is not None:
                        yield unit.result()
                    unit = _Unit(x["a"], x["b"], least, kind)
                unit.add(x)
        if unit is not None:
            yield unit.result()
    return run


def _ids_of(batches):
    for batch in batches:
        v = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("v")]
        yield pa.record_batch({
            "tile": batch.column("tile").take(pa.array(np.repeat(np.arange(len(v)), [len(x) for x in v]))),
            "v": pa.array(np.concatenate([np.empty(0, np.int64), *v]))})


def vector_classes(table: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label",
                   similarity: float = 0.93, block: int = BLOCK, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Rows of equal, non-null label and equal length link when the cosine of their vectors
    is at least ``similarity`` (over 0), computed in doubles. ``n_links`` counts the
    other rows linked directly, copies included; ``component_id`` is the smallest key
    reachable, the row's own included; ``kept`` says it is the row's own. A vector that
    is null, empty or zero or holds a null or non-finite component, and one with a null
    label, links with nothing: 0 links, its own component. Null keys are never a
    component's smallest; where it has no other, ``component_id`` and ``kept`` are null,
    as for an unlinked row with a null key. Repeated rows are linked with each other. An
    empty table gives no rows. Other columns are not read. Centres are fitted on at most
    ``SAMPLE`` representatives of each of the 4 commonest vector lengths; vectors of
    other lengths have one cell. Every row is indexed and every link is found.
    """
    spark = table.sparkSession
    kind = "f4" if field_of(table, column).dataType.elementType.typeName() == "float" else "f8"
    x = F.col(column).cast("array<double>")
    sound = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))
    usable = F.col(column).isNotNull() & F.col(label).isNotNull() & (F.size(column) > 0) & sound
    rows = table.select(
        F.col(key).cast("bigint").alias("vec_id"), F.col(label).cast("string").alias("label"),
        F.when(usable, x).otherwise(F.array().cast("array<double>")).alias("x"))
    packed = rows.select("vec_id", "label", F.size("x").alias("dim"), "x").mapInArrow(
        _packed(kind), "vec_id bigint, label string, dim int, vec binary")
    # a label and a vector as one number of 128 bits
    same = F.unhex(F.md5(F.concat(F.unhex(F.md5(F.encode("label", "UTF-8"))), F.col("vec"))))
    every = packed.select("vec_id", "label", "dim", "vec", F.when(F.col("vec").isNotNull(), same).alias("key"))
    apart = every.where("key IS NULL").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"),
        (F.col("vec_id") == F.col("vec_id")).alias("kept"))
    reps = every.where("key IS NOT NULL").groupBy("key").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"),
        F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    reps = stage(reps.select(
        F.monotonically_increasing_id().alias("v"), F.concat_ws(":", "dim", "label").alias("group"),
        "key", "first", "n", "dim", "vec"))

    models = _models(reps, kind)
    sizes = reps.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    cells = F.lit(CELLS[0])
    for count in CELLS[1:]:
        cells = F.when(F.col("size") >= count * PER_CELL, count).otherwise(cells)
    # one row per label, sent to the vectors if those are few
    celled = reps.join(bounded_broadcast(sizes.select("group", cells.cast("int").alias("cells"))), "group")
    celled = celled.select("v", "group", "dim", "cells", "n", "vec").mapInArrow(
        _celled(models, kind), "v bigint, `group` string, dim int, cells int, n bigint, vec binary, cell int, away double")
    order = ["group", "cell", "away", "v"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = celled.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(
        "part", F.spark_partition_id())
    blocks = stage(ordered.mapInArrow(
        _blocked(models, block, tile_bytes, kind),
        "tile bigint, block int, `group` string, dim int, cells int, rows int, weight bigint, lo array<float>, "
        "hi array<float>, lead bigint, v binary, n binary, vecs binary"))

    # tiles are few: a plan of pairs costs a row for each, without vectors
    tiles = blocks.where("block = -1")
    ends = [tiles.select("group", F.col("tile").alias(x), F.col("weight").alias(f"weight_{x}"),
                         F.col("lo").alias(f"lo_{x}"), F.col("hi").alias(f"hi_{x}"), F.col("lead").alias(f"lead_{x}"))
            for x in "ab"]
    plan = stage(ends[0].join(ends[1], "group").where("a <= b").mapInArrow(
        _planned(float(np.arccos(similarity))),
        "a bigint, b bigint, weight_a bigint, weight_b bigint, lead_a bigint, lead_b bigint, kind int"))
    units_ = plan.where(F.col("kind") == SOME).select("a", "b")
    needs = units_.select("a", "b", F.col("a").alias("tile")).union(
        units_.where("a <> b").select("a", "b", F.col("b").alias("tile")))
    vectors = blocks.where("block >= 0").select("tile", "dim", "lo", "hi", "v", "n", "vecs")
    met = vectors.join(bounded_broadcast(needs), "tile").repartition("a", "b").sortWithinPartitions("a", "b")
    met = met.select("a", "b", "tile", "dim", "lo", "hi", "v", "n", "vecs").mapInArrow(
        _met(similarity, kind), "v bigint, links bigint, to bigint")

    # tiles all of whose pairs are links: each row has the other tile's rows, and one link joins them
    full = plan.where(F.col("kind") == ALL)
    both = full.select(F.col("a").alias("tile"), F.col("weight_b").alias("links"), F.col("lead_b").alias("to")).union(
        full.where("a <> b").select("b", "weight_a", "lead_a"))
    summed = both.groupBy("tile").agg(F.sum("links").alias("links"), F.min("to").alias("to"))
    members = blocks.where("block >= 0").select("tile", "v").mapInArrow(_ids_of, "tile bigint, v bigint")
    sure = members.join(summed, "tile").select("v", "links", "to")
    found = stage(met.union(sure))
    bridges = full.where("a <> b").select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b"))
    edges = found.where("v <> to").select(F.col("v").alias("a"), F.col("to").alias("b")).union(bridges)
    comp = components(edges)

    counts = found.groupBy("v").agg(F.sum("links").alias("links"))
    named = reps.select("v", "key", "first").join(comp, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    least = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    each = named.join(least, "comp").join(counts, "v").select("key", "links", "component_id")
    linked = every.where("key IS NOT NULL").select("vec_id", "key").join(each, "key").select(
        "vec_id", (F.col("links") - 1).alias("n_links"), "component_id",
        (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.union(apart)


def _models(reps: DataFrame, kind: str) -> dict[int, dict[int, np.ndarray]]:
    """Centres for each number of cells, of each of the commonest vector lengths.

    Of the rows whose vertex hashes to one of ``SAMPLE`` slots the first is taken.
    """
    commonest = [r.dim for r in reps.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "dim").limit(4).collect()]
    models = {}
    for dim in commonest:
        slot = F.pmod(F.xxhash64("v"), F.lit(max(256, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))))
        picked = reps.where(F.col("dim") == dim).groupBy(slot.alias("slot")).agg(F.min("v").alias("v"))
        rows = reps.join(F.broadcast(picked.select("v")), "v").select("v", "vec").orderBy("v").collect()
        sample = units(_matrix(pa.array([bytes(r.vec) for r in rows]), dim, kind))
        models[dim] = {count: centres(sample, count) for count in CELLS}
    return models


def vector_classes_sql(similarity: float = 0.93) -> str:
    """The same classes in DuckDB SQL: all pairs of a label, reachability by recursion."""
    return f"""
    WITH RECURSIVE u AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    ok AS (SELECT * FROM u WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0
        AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
    links AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r
        AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= {similarity}),
    reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    least AS (SELECT a, min(vec_id) AS m FROM reach JOIN u ON reach.b = u.r GROUP BY a),
    n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
        vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
    FROM u LEFT JOIN least ON u.r = least.a LEFT JOIN n ON u.r = n.a"""

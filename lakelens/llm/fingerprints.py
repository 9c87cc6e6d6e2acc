"""MinHash fingerprints of documents, and near pairs by banded signatures.

A signature has one minimum per hash function of a universal family (multiply, add,
keep the 16 high bits of the minimum) over the text's shingles; functions and shingles meet in numpy,
many texts at once. Equal places of two signatures estimate the Jaccard similarity.
``near_pairs`` joins signature bands in Spark, searches what the join leaves open, and
verifies on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.llm import near
from lakelens.llm.shared import slices, text_or_empty
from lakelens.llm.shingles import Powers, mix, shingle_sets
from lakelens.session import stage

HASHES = 128
_EMPTY = np.uint16(0xFFFF)


def universal(count: int = HASHES, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets modulo 2**64."""
    with np.errstate(over="ignore"):
        numbers = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) + np.uint64(seed << 32))
    return numbers[:count] | np.uint64(1), numbers[count:]


def signatures(sets: list[np.ndarray], count: int = HASHES, seed: int = 1) -> np.ndarray:
    """uint16 per hash function, one row per set; an empty set has the greatest everywhere.

    The minimum itself is taken over 64 bits and mixed before 16 of them are kept:
    the high bits of a minimum are nearly always 0.
    """
    out = np.full((len(sets), count), _EMPTY, np.uint16)
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    items = np.concatenate([sets[i] for i in full.tolist()])
    starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
    times, plus = universal(count, seed)
    work = np.empty_like(items)
    with np.errstate(over="ignore"):
        for i in range(count):
            np.multiply(items, times[i], out=work)
            np.add(work, plus[i], out=work)
            out[full, i] = mix(np.minimum.reduceat(work, starts)) >> np.uint64(48)
    return out


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows.astype(">u2")], pa.binary())


def _edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as much of the next text's beginning."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


#: Digests and signatures are bytes until the last projection: half of their hexadecimal form.
_OUT = ("doc_id bigint, n_chars bigint, edited_sha256 binary, fingerprint binary, "
        "edited_fingerprint binary, near_edited double, near_next double")
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


def _shown(rows: DataFrame) -> DataFrame:
    texts = ("edited_sha256", "fingerprint", "edited_fingerprint")
    return rows.select(*[F.lower(F.hex(c)).alias(c) if c in texts else F.col(c) for c in _NAMES])


def _measured(ids, texts: list[str], following: list[str], marks, next_marks, shingle, powers) -> pa.RecordBatch:
    edited = [_edited(t, f) for t, f in zip(texts, following)]
    changed = signatures(shingle_sets(pa.array(edited, pa.large_string()), shingle, powers))
    return pa.record_batch({
        "doc_id": ids,
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).digest() for t in edited], pa.binary()),
        "fingerprint": _packed(marks),
        "edited_fingerprint": _packed(changed),
        "near_edited": pa.array((marks == changed).mean(1), pa.float64()),
        "near_next": pa.array((marks == next_marks).mean(1), pa.float64()),
    })


def _signed(column: pa.Array, shingle: int, powers) -> np.ndarray:
    return signatures(shingle_sets(column, shingle, powers))


def _in_order(shingle: int):
    """Finished rows of all documents whose successor is in the same partition.

    The first and the last document of a partition also leave their texts: the
    last one's successor is the first one of a later partition.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, place, held, first = Powers(), None, None, True
        for batch in batches:
            for part in slices(batch, "text"):
                marks = _signed(part.column("text"), shingle, powers)
                ids = part.column("doc_id")
                texts = part.column("text").to_pylist()
                place = part.column("part")[0].as_py()
                if first:
                    yield _edge(place, 0, ids[0].as_py(), texts[0])
                    first = False
                else:
                    ids = pa.concat_arrays([held[0], ids])
                    texts = [held[1], *texts]
                    marks = np.concatenate([held[2], marks])
                if len(texts) > 1:
                    done = _measured(ids[:-1], texts[:-1], texts[1:], marks[:-1], marks[1:], shingle, powers)
                    yield pa.record_batch(
                        [*done.columns, *[pa.nulls(done.num_rows, t) for t in (pa.int32(), pa.int32(), pa.string())]],
                        names=[*done.schema.names, "part", "edge", "text"])
                held = ids[-1:], texts[-1], marks[-1:]
        if held is not None:
            yield _edge(place, 1, held[0][0].as_py(), held[1])
    return run


def _edge(place, edge, doc_id, text) -> pa.RecordBatch:
    return pa.record_batch({
        "doc_id": pa.array([doc_id], pa.int64()), "n_chars": pa.nulls(1, pa.int64()),
        "edited_sha256": pa.nulls(1, pa.binary()), "fingerprint": pa.nulls(1, pa.binary()),
        "edited_fingerprint": pa.nulls(1, pa.binary()), "near_edited": pa.nulls(1, pa.float64()),
        "near_next": pa.nulls(1, pa.float64()), "part": pa.array([place], pa.int32()),
        "edge": pa.array([edge], pa.int32()), "text": pa.array([text], pa.string())})


def _at_edges(shingle: int):
    def run(batches):
        powers = Powers()
        for batch in batches:
            for part in slices(batch, "text"):
                marks = _signed(part.column("text"), shingle, powers)
                nexts = _signed(part.column("following"), shingle, powers)
                yield _measured(part.column("doc_id"), part.column("text").to_pylist(),
                                part.column("following").to_pylist(), marks, nexts, shingle, powers)
    return run


def fingerprints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """Per row: the fingerprint of its text and of the text edited with its successor's.

    Documents follow each other by falling doc_id, null ids last, and by text where
    ids tie; the last one is followed by the first, and a single one by itself. Null
    texts are empty. Texts without words have the fingerprint of the empty set; two
    of them are alike (1.0). An empty table gives no rows; other columns are not read.

    One range partitioning puts rows in order; a document meets its successor while
    its partition streams by. Only the edges of partitions are joined, two per task.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    keys = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.length("text")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ordered = ordered.withColumn("part", F.spark_partition_id())
    rows = stage(ordered.mapInArrow(_in_order(shingle), _OUT + ", part int, edge int, text string"))
    edges = rows.where("edge IS NOT NULL")
    heads = edges.where("edge = 0").select(F.col("part").alias("after"), F.col("text").alias("following"))
    # partitions that hold rows: as many as tasks, without their texts
    held = sorted(r.part for r in edges.where("edge = 1").select("part").collect())
    if not held:
        return _shown(rows)
    chain = docs.sparkSession.createDataFrame(list(zip(held, [*held[1:], held[0]])), "part int, after int")
    ends = (
        edges.where("edge = 1").select("part", "doc_id", "text").join(chain, "part").join(heads, "after")
        .select("doc_id", "text", "following").mapInArrow(_at_edges(shingle), _OUT)
    )
    return _shown(rows.where("edge IS NULL").select(*_NAMES).unionByName(ends))


def near_pairs(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, band: int = 4) -> DataFrame:
    """(a, b, jaccard): near pairs between the classes of equal shingle sets.

    ``a`` and ``b`` are the smallest doc_ids of two classes, a <= b, equal only where
    one id has different texts; copies are one class and not expanded. Signature
    bands are joined in Spark: each member of a band's bucket meets the bucket's first
    member. A bucket whose members still are in different components after that is
    searched whole, in blocks. Every pair's Jaccard similarity is counted on the full
    sets and at least ``similarity`` (kept to hundredths). Not all pairs come out, which
    are as many as the square of a group, but two classes that share a band and are
    alike are always linked, directly or over others. Rows without id or words have
    no pairs.
    """
    share = round(similarity * 100)

    def signed(batches):
        powers = Powers()
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), shingle, powers)
                rows = signatures(sets)
                bands = [[int.from_bytes(hashlib.blake2b(bytes([i]) + r[i * band:(i + 1) * band].tobytes(),
                                                         digest_size=8).digest(), "big", signed=True)
                          for i in range(HASHES // band)] if len(s) else [] for s, r in zip(sets, rows)]
                yield pa.record_batch({
                    "doc_id": part.column("doc_id"), "row": part.column("row"),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "set_key": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    "bands": pa.array(bands, pa.list_(pa.int64()))})

    def counted(batches):
        for batch in batches:
            both, union = [], []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both.append(len(np.intersect1d(x, y, assume_unique=True)))
                union.append(len(x) + len(y) - both[-1])
            both, union = np.array(both, np.int64), np.array(union, np.int64)
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"),
                                   "jaccard": pa.array(both / np.maximum(union, 1), pa.float64())}).filter(
                pa.array(100 * both >= share * union, pa.bool_()))

    source = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    source = source.select("doc_id", near.row_key().alias("row"), "text")
    rows = stage(source.mapInArrow(
        signed, "doc_id bigint, row bigint, n bigint, set_key binary, bands array<bigint>").where("n > 0"))
    # one vertex per distinct shingle set; its id is its place, fixed by writing
    classes = rows.groupBy("set_key").agg(
        F.min(F.struct("doc_id", "row")).alias("lead"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = stage(classes.select(
        F.monotonically_increasing_id().alias("v"), "lead.doc_id", "lead.row", "n", "bands"))
    member = classes.select("v", "doc_id", "n", F.explode("bands").alias("bucket"))
    hubs = member.groupBy("bucket").agg(
        F.min(F.struct("doc_id", "v", "n")).alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1")
    others = stage(member.join(hubs.select("bucket", "hub"), "bucket").where("v <> hub.v"))

    def full_sets(ends: DataFrame) -> DataFrame:
        return near.sets_of(ends, classes.select("v", "row"), source.select("row", "text"), shingle)

    def verified(pairs: DataFrame) -> DataFrame:
        sets = full_sets(pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))))
        a = sets.select(F.col("v").alias("a"), F.col("shingles").alias("set_a"))
        b = sets.select(F.col("v").alias("b"), F.col("shingles").alias("set_b"))
        return stage(pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(
            counted, "a bigint, b bigint, jaccard double"))

    # a set of other size cannot be alike
    stars = stage(others.where(f"least(n, hub.n) * 100 >= greatest(n, hub.n) * {share}").select(
        F.col("hub.v").alias("a"), F.col("v").alias("b")).distinct())
    links = verified(stars)
    # a bucket's hub has met all others; what is left are pairs of others
    comp = stage(near.components(links.select("a", "b")))
    more = near.open_links(others, comp, full_sets, share)
    more = stage(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = links.unionByName(verified(more))
    ids = classes.select("v", "doc_id")
    named = links.join(ids.select(F.col("v").alias("a"), F.col("doc_id").alias("id_a")), "a").join(
        ids.select(F.col("v").alias("b"), F.col("doc_id").alias("id_b")), "b")
    return named.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "jaccard")

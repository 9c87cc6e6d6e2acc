"""Near-duplicate classes by SetSketch registers, banded, estimated and verified.

Every distinct shingle of a text throws exponentially distributed values at m
registers, in increasing order, one register each; a register keeps the smallest
value it met, truncated to the integer exponent k of ``base ** -k``. Sketches of
parts merge by taking the larger exponents. Two texts agree in a register about as
often as their sets are alike, so

1. texts of equal shingle sets become one class, which goes on alone;
2. classes that agree in all registers of some band share a bucket; each member is
   compared with its bucket's smallest set (a star, never all pairs);
3. a pair's likeness is estimated from the counts of larger, equal and smaller
   registers jointly with both set sizes, by the sign of the derivative of their
   likelihood at a similarity four standard errors below the wanted one;
4. pairs that pass are verified on their full shingle sets, then those that do not
   pass, as far as their ends are not in one component by then;
5. a bucket with members in several components after that is searched in blocks: full
   sets meet in numpy, and of the links found only those come out that still join
   two components. Shingles that one member alone has cannot be shared, so many
   texts around one passage cost as much as the passage.

Nothing is capped: a long bucket is dealt out as pairs of blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from lakelens.llm.shared import packed, slices, text_or_empty, unpacked
from lakelens.llm.shingles import Powers, mix, shingle_sets
from lakelens.session import stage

#: Registers (a power of 2), registers of a band, base and rate of the sketch.
REGISTERS, BAND, BASE, RATE = 256, 6, 1.001, 20.0
BANDS = REGISTERS // BAND

#: Members of a block of a bucket, and shingles of all its sets, both about;
#: members and columns of one matrix product.
BLOCK, BLOCK_SHINGLES, TILE, COLUMNS = 2048, 2_000_000, 512, 4096


def sketches(sets: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """The exponents of each set, uint16; 0 in all registers for an empty set.

    All values of one element are order statistics of ``registers`` exponential
    variables: the j-th is the one before it plus Exp(1) / (registers - j). An
    element stops when its value is above all registers of its text.
    """
    n = len(sets)
    low = np.full((n, registers), np.inf)
    if not n:
        return low.astype(np.uint16)
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    with np.errstate(over="ignore"):
        seed = mix(items + np.uint64(0x5851F42D4C957F2D))
        place = (seed & np.uint64(registers - 1)).astype(np.int64)
        stride = ((seed >> np.uint64(20)) & np.uint64(registers - 1)).astype(np.int64) | 1
        value = np.zeros(len(items))
        flat = low.reshape(-1)
        for j in range(registers):
            seed = seed + np.uint64(0x9E3779B97F4A7C15)
            uniform = (mix(seed.copy()) >> np.uint64(11)).astype(np.float64) + 0.5
            value = value - np.log(uniform * 2.0**-53) / (registers - j)
            np.minimum.at(flat, owner * registers + place, value)
            if j == registers - 1:
                break
            if j < 8 or j % 8 == 0:
                alive = value < low.max(axis=1)[owner]
                if not alive.any():
                    break
                owner, place, stride, seed, value = (
                    x[alive] for x in (owner, place, stride, seed, value))
            place = (place + stride) & (registers - 1)
    with np.errstate(divide="ignore"):
        exponents = np.floor(1 - np.log(low / RATE) / math.log(BASE))
    return np.clip(exponents, 0, 65535).astype(np.uint16)


def may_be_alike(a: np.ndarray, b: np.ndarray, na, nb, least: float) -> np.ndarray:
    """Whether the likeliest Jaccard similarity of sketches is ``least`` or more.

    The likelihood of the counts of registers where a is larger, b is larger and
    both are equal is concave in the similarity, so its maximum is at ``least`` or
    above it exactly if it does not fall there.
    """
    above, below, registers = (a > b).sum(-1), (b > a).sum(-1), a.shape[-1]
    total = na + nb
    u, v = na / total, nb / total
    possible = np.minimum(na, nb) >= least * np.maximum(na, nb)
    j = np.minimum(least, np.minimum(na / nb, nb / na) * (1 - 1e-9))
    step = (BASE - 1) / BASE
    log_base = math.log(BASE)
    xa, xb = u - v * j, v - u * j
    pa_, pb_ = -np.log1p(-xa * step) / log_base, -np.log1p(-xb * step) / log_base
    da, db = -v * step / (1 - xa * step) / log_base, -u * step / (1 - xb * step) / log_base
    tiny = 1e-12
    slope = (above * da / np.maximum(pa_, tiny) + below * db / np.maximum(pb_, tiny)
             - (registers - above - below) * (da + db) / np.maximum(1 - pa_ - pb_, tiny))
    return possible & (slope >= 0)


def _margin(similarity: float) -> float:
    return similarity - 4 * math.sqrt(similarity * (1 - similarity) / REGISTERS)


def _sketched(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), shingle, powers)
                regs = sketches(sets)
                yield pa.record_batch({
                    "doc_id": part.column("doc_id"), "row": part.column("row"),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "set_key": pa.array(
                        [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    "regs": pa.array([r.tobytes() for r in regs], pa.binary()),
                })
    return run


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each band of a class: a hash of the band's place and registers."""
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            part = batch.slice(start, 2000)
            regs = np.frombuffer(b"".join(part.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            rows = regs[:, :BANDS * BAND].astype(np.uint64).reshape(len(regs), BANDS, BAND)
            with np.errstate(over="ignore"):
                key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(regs), BANDS)).copy()
                for i in range(BAND):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, i])
            repeat = np.repeat(np.arange(len(regs)), BANDS)
            yield pa.record_batch({
                "bucket": pa.array(key.view(np.int64).reshape(-1)),
                "v": part.column("v").take(pa.array(repeat)),
                "n": part.column("n").take(pa.array(repeat)),
            })


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _estimated(least: float):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4000):
                part = batch.slice(start, 4000)
                keep = may_be_alike(
                    _registers(part.column("regs_a")), _registers(part.column("regs_b")),
                    part.column("n_a").to_numpy(), part.column("n_b").to_numpy(), least)
                yield pa.record_batch({"a": part.column("a"), "b": part.column("b")}).filter(pa.array(keep))
    return run


class _Forest:
    """Which components the links found so far lead together."""

    def __init__(self, names):
        self.root = {c: c for c in names}

    def find(self, c):
        root = self.root
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        self.root[a] = b
        return a != b


def linking(sets: list[np.ndarray], v: np.ndarray, comp: np.ndarray, side: np.ndarray, share: int):
    """Links between different components that together lead as far as all of them.

    With two sides only pairs across them are looked at; what one side alone can
    link is another piece's. Members come in order of component, so that tiles
    within one component are passed over.
    """
    order = np.lexsort((v, comp, side))
    sets, v, comp, side = [sets[i] for i in order], v[order], comp[order], side[order]
    sizes = np.array([len(s) for s in sets])
    _, code, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen > 1
    number = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(sets)), sizes)
    keep = shared[code]
    owner, code = owner[keep], number[code[keep]]
    starts = np.searchsorted(owner, np.arange(len(sets) + 1))
    forest = _Forest(set(comp.tolist()))
    out_a, out_b = [], []
    two = side[0] != side[-1]
    columns = int(number[-1]) + 1 if len(number) else 0

    def dense(lo, hi, left, right):
        part = slice(starts[lo], starts[hi])
        inside = (code[part] >= left) & (code[part] < right)
        out = np.zeros((hi - lo, right - left), np.float32)
        out[owner[part][inside] - lo, code[part][inside] - left] = 1
        return out

    tiles = [(i, min(i + TILE, len(sets))) for i in range(0, len(sets), TILE)]
    for x, (a, b) in enumerate(tiles):
        for c, d in tiles[x:]:
            if comp[a] == comp[d - 1] and comp[a:d].min() == comp[a:d].max():
                continue
            if two and side[a] == side[d - 1]:
                continue
            both = np.zeros((b - a, d - c), np.float32)
            for left in range(0, columns, COLUMNS):
                right = min(columns, left + COLUMNS)
                both += dense(a, b, left, right) @ dense(c, d, left, right).T
            union = sizes[a:b, None] + sizes[None, c:d] - both
            hit = (100 * both >= share * union) & (comp[a:b, None] != comp[None, c:d])
            if two:
                hit &= side[a:b, None] != side[None, c:d]
            for i, j in zip(*np.nonzero(hit)):
                if forest.join(comp[a + i], comp[c + j]):
                    out_a.append(v[a + i])
                    out_b.append(v[c + j])
    return out_a, out_b


def _searched(share: int):
    """The links of one (bucket, i, j) after the other; rows come sorted so."""
    def one(piece: pa.Table):
        v, comp, side = (piece.column(c).to_numpy() for c in ("v", "comp", "side"))
        if comp.min() == comp.max():
            return [], []
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in piece.column("shingles")]
        return linking(sets, v, comp, side, share)

    def run(batches):
        held = []
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("bucket", "i", "j")]
            cuts = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist(), batch.num_rows]
            out = [], []
            for start, end in zip(cuts, cuts[1:]):
                part = batch.slice(start, end - start)
                if held and any(held[-1].column(c)[0] != part.column(c)[0] for c in ("bucket", "i", "j")):
                    for have, new in zip(out, one(pa.Table.from_batches(held))):
                        have.append(new)
                    held = []
                if part.num_rows:
                    held.append(part)
            yield _pairs(out)
        if held:
            a, b = one(pa.Table.from_batches(held))
            yield _pairs(([a], [b]))

    return run


def _pairs(parts) -> pa.RecordBatch:
    a, b = (np.concatenate([np.empty(0, np.int64), *[np.asarray(x, np.int64) for x in p]]) for p in parts)
    return pa.record_batch({"a": pa.array(a), "b": pa.array(b)})


def _sets(shingle: int):
    def run(batches):
        powers = Powers()
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), shingle, powers)
                yield pa.record_batch({
                    "v": part.column("v"), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})
    return run


def _verified(share: int):
    """Pairs with 100 * |intersection| >= share * |union|."""
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= share * (len(x) + len(y) - both))
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(keep, pa.bool_()))
    return run


def components(edges: DataFrame) -> DataFrame:
    """(v, comp): the smallest vertex that each vertex of ``edges`` (a, b) reaches.

    Alternating stars: every vertex hands its larger neighbours to its smallest
    one, then its smaller ones, until only stars are left: each vertex has one
    edge, to a vertex that has none of its own. Each round is a written table.
    Stars never gather a vertex's neighbours in one row, and a vertex with very many
    of them is summed map-side.
    """
    edges = stage(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _is_stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.where("m < a").select("a", F.col("m").alias("b"))
        starred = stage(large.union(own).where("a <> b").distinct())
        down = starred.groupBy("a").agg(F.min("b").alias("m"))
        small = starred.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(small.union(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
    roots = edges.select(F.col("b").alias("v")).distinct().select("v", F.col("v").alias("comp"))
    return edges.select(F.col("a").alias("v"), F.col("b").alias("comp")).union(roots)


def _is_stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(
        edges.select("b", F.lit(0), F.lit(1)))
    each = ends.groupBy("v").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return each.where("out > 1 OR (out > 0 AND into > 0)").isEmpty()


def sets_of(ends: DataFrame, leads: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(v, shingles) of the classes ``ends`` (v): the full sets of their rows in ``leads`` (v, row)."""
    wanted = ends.distinct().join(leads, "v")
    sets = texts.join(wanted, "row").select("v", "text").mapInArrow(_sets(shingle), "v bigint, shingles binary")
    # a class's row may come several times; dealt by v, as the joins need it
    return sets.dropDuplicates(["v"])


def open_links(members: DataFrame, comp: DataFrame, full_sets, share: int) -> DataFrame:
    """(a, b): what still joins components (v, comp) inside buckets of ``members`` (bucket, v, n).

    Buckets whose members are in several components are searched whole, in pairs of
    blocks, on full sets. Links may come more than once.
    """
    labelled = members.select("bucket", "v", "n").join(comp, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    size = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)
    open_ = labelled.groupBy("bucket").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(size).cast("int").alias("blocks")
    ).where("lo < hi").select("bucket", "blocks")
    # a member meets every block once: as the left or as the right one of a pair of blocks
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    search = stage(
        labelled.join(open_, "bucket")
        .withColumn("side", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).select("*", meets.alias("other"))
        .select("bucket", "v", "comp", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")))
    pieces = search.join(full_sets(search.select("v")), "v").select(
        "bucket", "i", "j", "v", "comp", "side", "shingles")
    return pieces.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(
        _searched(share), "a bigint, b bigint")


def near_classes(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept, row, leads.

    ``component_id`` is the smallest doc_id among all rows reachable by links of at
    least ``similarity`` (kept to hundredths), the row's own included; ``kept`` says
    it is the row's own. Texts are linked by content, so rows of equal words are
    one class however often they come. A null or wordless text is linked with
    nothing and its component is its own id. A null doc_id never is a component's
    smallest id; where a class has no other, ``component_id`` and ``kept`` are null.
    An empty table gives no rows. Other columns are not read. ``row`` is a hash of id
    and text, and ``leads`` is true for one (id, text) of each class and for each text
    without words.
    """
    share, least = round(similarity * 100), _margin(similarity)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    source = source.select("doc_id", row_key().alias("row"), "text")
    rows = stage(source.mapInArrow(
        _sketched(shingle), "doc_id bigint, row bigint, n bigint, set_key binary, regs binary"))

    # one vertex per distinct shingle set; its id is its place, fixed by writing
    classes = (
        rows.where("n > 0").groupBy("set_key")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("lead"),
             F.first("n").alias("n"), F.first("regs").alias("regs"))
    )
    classes = stage(classes.select(F.monotonically_increasing_id().alias("v"), "set_key", "lead", "n", "regs"))
    bands = classes.select("v", "n", "regs").mapInArrow(_banded, "bucket bigint, v bigint, n bigint")
    hubs = bands.groupBy("bucket").agg(
        F.min(F.struct("n", "v")).alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1")
    member = stage(bands.join(hubs.select("bucket", "hub"), "bucket"))  # buckets of two and more

    texts = source.select("row", "text")
    regs = classes.select("v", "n", "regs")

    def estimated(pairs: DataFrame) -> DataFrame:
        a = regs.select(F.col("v").alias("a"), F.col("n").alias("n_a"), F.col("regs").alias("regs_a"))
        b = regs.select(F.col("v").alias("b"), F.col("n").alias("n_b"), F.col("regs").alias("regs_b"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(
            _estimated(least), "a bigint, b bigint")

    def full_sets(ends: DataFrame) -> DataFrame:
        return sets_of(ends, classes.select("v", F.col("lead.row").alias("row")), texts, shingle)

    def verified(pairs: DataFrame) -> DataFrame:
        sets = full_sets(pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))))
        a = sets.select(F.col("v").alias("a"), F.col("shingles").alias("set_a"))
        b = sets.select(F.col("v").alias("b"), F.col("shingles").alias("set_b"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(
            _verified(share), "a bigint, b bigint")

    others = member.where("v <> hub.v")
    # a set of other size cannot be alike
    stars = stage(others.where("least(n, hub.n) * 100 >= greatest(n, hub.n) * " + str(share)).select(
        F.col("hub.v").alias("a"), F.col("v").alias("b")).distinct())
    links = stage(verified(stage(estimated(stars))))
    comp = stage(components(links))
    # the estimate only orders the work: pairs it refused are verified too, unless linked by others
    ends = [comp.select(F.col("v").alias(x), F.col("comp").alias(f"comp_{x}")) for x in "ab"]
    refused = stars.join(ends[0], "a", "left").join(ends[1], "b", "left").where(
        "coalesce(comp_a, a) <> coalesce(comp_b, b)").select("a", "b")
    late = stage(verified(stage(refused)))
    if not late.isEmpty():
        comp = stage(components(comp.select(F.col("v").alias("a"), F.col("comp").alias("b")).union(late)))
    # a bucket's hub has met all others on full sets; what is left are pairs of others
    more = stage(open_links(others, comp, full_sets, share).distinct())
    if not more.isEmpty():
        comp = components(comp.select(F.col("v").alias("a"), F.col("comp").alias("b")).union(more))
    named = classes.select("v", "set_key", "lead").join(comp, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    first = named.groupBy("comp").agg(F.min("lead").alias("first"))
    ids = named.join(first, "comp").select("set_key", "first")
    out = rows.select("doc_id", "row", "n", "set_key").join(ids, "set_key", "left")
    alone = F.col("n") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        (F.col("doc_id") == component).alias("kept"), "row",
        (alone | (F.col("row") == F.col("first.row"))).alias("leads"))


def row_key() -> Column:
    """A hash of a row's id and text, as ``near_classes`` has it."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), text_or_empty())


def deduplicated(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each near-duplicate class of ``docs``, that with the smallest id, as it
    came; of rows with that id and text, one. Texts without words are no copies of each
    other: all their rows stay, null and repeated ids too."""
    worded = text_or_empty().rlike(r"[^\x20\x09-\x0D]")
    leads = near_classes(docs, shingle, similarity).where("leads AND n_shingles > 0").select("row").distinct()
    rows = docs.where(worded).select(packed(docs, "doc"), row_key().alias("row")).join(leads, "row", "left_semi")
    # of rows with one id and text the same one at every run, whatever their other columns
    rank = F.xxhash64(*[F.col("doc")[f.name] for f in docs.schema.fields if isinstance(f.dataType, AtomicType)])
    first = rows.groupBy("row").agg(F.min_by("doc", rank).alias("doc"))
    return first.select(*unpacked(docs, "doc")).union(docs.where(~worded))

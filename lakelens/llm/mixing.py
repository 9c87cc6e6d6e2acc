"""Mixing sources to target weights by hierarchical budgets, in DataFrame functions only.

A token budget goes down a tree (domain, language, source). Siblings share their
parent's budget by weight; a sibling that holds fewer tokens than its share gives
the rest to its siblings, and only what all siblings together cannot take was never
handed to the parent: each node's capacity is the sum of its leaves', so a shortage
is met among siblings before it reaches an ancestor's. Each leaf then takes whole
seeded epochs and the token-prefix of one more.

Rows of a leaf are never brought together: tokens are summed per (leaf, order
bucket), the cut bucket is found on those sums in two levels of 256, only the rows of
the cut buckets are put in order, and the choice itself is a comparison of a row's order
key with its leaf's threshold. The key hashes id and text, so that rows of one id are
spread like others. Exact repeats share a key; where the cut falls among them, as many
as fit are taken, first in file order, found by counts of blocks of files.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelens.llm.shared import free_name, packed, text_or_empty, unpacked
from lakelens.operators.rows import file_position
from lakelens.session import bounded_broadcast, stage

LEVELS = ("domain", "lang", "source")

#: Hexadecimal digits of the order key that name its bucket, half of them per level.
_BUCKET_DIGITS = 4

#: Rows of a file among which repeats are counted together.
_STRETCH = 1 << 16


@dataclass(frozen=True)
class Mix:
    """``weights[level]`` gives the weight of a value among its siblings; others
    weigh ``other``. ``share`` is the budget as a part of all tokens, unless
    ``tokens`` fixes it. A document is taken at most ``epochs`` times.
    """

    weights: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    other: float = 1.0
    share: float = 0.6
    tokens: int | None = None
    epochs: int = 2
    seed: int = 17


#: The default tree's first level: one source holds a third of all rows.
DOMAIN_SQL = "CASE WHEN source = 'src0' THEN 'crawl' WHEN source IS NULL THEN 'unknown' ELSE 'curated' END"

DEFAULT_MIX = Mix(weights={
    "domain": {"crawl": 0.4, "curated": 0.6},
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15},
})

_WORD = r"[^\x20\x09-\x0D]+"


def token_count() -> Column:
    """Words of the whole text; a null text has none."""
    return F.regexp_count(text_or_empty(), F.lit(_WORD)).cast("bigint")


def order_key(epoch: Column | int, seed: int) -> Column:
    """The place of a row in an epoch: a hash of seed, epoch, id and the text's hash.

    Null counts as an id, and as an empty text.
    """
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"),
                             F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("_hash")).cast("binary"))


def _nodes(domain: str) -> list[Column]:
    return [
        F.expr(domain).alias("_domain"),
        F.coalesce("lang", F.lit("")).alias("_lang"),
        F.coalesce("source", F.lit("")).alias("_source"),
        F.md5(text_or_empty().cast("binary")).alias("_hash"),
    ]


def tree(docs: DataFrame, domain: str = DOMAIN_SQL) -> DataFrame:
    """(doc_id, _domain, _lang, _source, _hash, _tokens, _file, _pos) of rows of files;
    null values are nodes named ''."""
    path, place = file_position(docs)
    return docs.select("doc_id", *_nodes(domain), token_count().alias("_tokens"),
                       path.alias("_file"), place.alias("_pos"))


def _weight(level: str, mix: Mix) -> Column:
    given = mix.weights.get(level, {})
    out = F.lit(float(mix.other))
    for name, weight in given.items():
        out = F.when(F.col(f"_{level}") == name, F.lit(float(weight))).otherwise(out)
    return out


def budgets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """One row per leaf with ``_tokens`` (what it holds) and ``_budget``.

    Siblings are filled in order of capacity per weight. One is short when its
    capacity is under its share of what those before it left; all after the last
    short one share the rest by weight. Siblings of weight 0 get nothing.
    """
    leaves = sizes.groupBy("_domain", "_lang", "_source").agg(F.sum("_tokens").alias("_tokens"))
    leaves = leaves.withColumn("_cap", (F.col("_tokens") * mix.epochs).cast("double"))
    wanted = mix.tokens
    if wanted is None:
        wanted = math.floor((sizes.agg(F.sum("_tokens")).first()[0] or 0) * mix.share)
    nodes = leaves.withColumn("_budget", F.lit(float(wanted)))
    for depth, level in enumerate(LEVELS):
        parents = [f"_{x}" for x in LEVELS[:depth]]
        keys = [*parents, f"_{level}"]
        at = nodes.groupBy(*keys).agg(F.sum("_cap").alias("_c"), F.max("_budget").alias("_b"))
        at = at.withColumn("_w", _weight(level, mix)).where("_w > 0")
        family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
        line = family.orderBy(F.col("_c") / F.col("_w"), f"_{level}")
        before = line.rowsBetween(Window.unboundedPreceding, -1)
        at = (
            at.withColumn("_left", F.col("_b") - F.coalesce(F.sum("_c").over(before), F.lit(0.0)))
            .withColumn("_ws", F.sum("_w").over(family) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
            .withColumn("_short", F.col("_c") * F.col("_ws") <= F.col("_left") * F.col("_w"))
            .withColumn("_rate", F.min(F.when(~F.col("_short"), F.struct(
                F.col("_c") / F.col("_w"), F.col("_left") / F.col("_ws")))).over(family)["col2"])
            .withColumn("_share", F.when(F.col("_short"), F.col("_c")).otherwise(F.col("_w") * F.col("_rate")))
        )
        nodes = nodes.drop("_budget").join(at.select(*keys, F.col("_share").alias("_budget")), keys)
    return nodes.select(*[f"_{x}" for x in LEVELS], "_tokens", F.floor("_budget").cast("bigint").alias("_budget"))


def _cut(sums: DataFrame, leaf: list[str], digits: int) -> DataFrame:
    """Of sums per ``_bucket`` the one the leaf's ``_rest`` ends in, by its first
    ``digits``, and the rest left for it. A leaf has at most 256 rows here."""
    short = sums.withColumn("_at", F.substring("_bucket", 1, digits)).groupBy(*leaf, "_rest", "_at").agg(
        F.sum("_sum").alias("_sum"))
    line = Window.partitionBy(*leaf).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    upto = short.withColumn("_upto", F.sum("_sum").over(line))
    return upto.where("_upto > _rest AND _upto - _sum <= _rest").select(
        *leaf, F.col("_at").alias("_edge"), (F.col("_rest") - F.col("_upto") + F.col("_sum")).alias("_room"))


def thresholds(rows: DataFrame, mix: Mix) -> DataFrame:
    """Per leaf: ``_full`` epochs taken whole and ``_last``, the greatest order key taken
    in the epoch after them; of the rows of that key those up to place ``_upto`` (file
    and row; null: all)."""
    leaf = [f"_{x}" for x in LEVELS]
    whole = budgets(rows, mix).where("_tokens > 0")
    plan = whole.select(
        *leaf,
        F.least(F.floor(F.col("_budget") / F.col("_tokens")), F.lit(mix.epochs)).cast("int").alias("_full"),
        F.when(F.col("_budget") < F.col("_tokens") * mix.epochs,
               F.col("_budget") % F.col("_tokens")).otherwise(F.lit(0)).alias("_rest"),
    )
    plan = bounded_broadcast(plan)  # one row per leaf, if those are few
    placed = rows.join(plan, leaf).withColumn("_key", order_key(F.col("_full"), mix.seed))
    placed = placed.withColumn("_bucket", F.substring("_key", 1, _BUCKET_DIGITS))
    sums = stage(placed.groupBy(*leaf, "_rest", "_bucket").agg(F.sum("_tokens").alias("_sum")))
    coarse = _cut(sums, leaf, _BUCKET_DIGITS // 2)
    inner = sums.join(bounded_broadcast(coarse), leaf).where(F.col("_bucket").startswith(F.col("_edge")))
    fine = _cut(inner.select(*leaf, F.col("_room").alias("_rest"), "_bucket", "_sum"), leaf, _BUCKET_DIGITS)
    fine = bounded_broadcast(fine)
    # repeats are summed map-side: a hot row is one row
    inside = placed.join(fine, leaf).where(F.col("_bucket") == F.col("_edge")).groupBy(*leaf, "_key", "_room").agg(
        F.sum("_tokens").alias("_sum"), F.max("_tokens").alias("_tokens"))
    running = F.sum("_sum").over(Window.partitionBy(*leaf).orderBy("_key"))
    inside = inside.withColumn("_run", running)
    past = F.col("_run") > F.col("_room")
    ends = inside.groupBy(*leaf).agg(
        F.max(F.when(~past, F.col("_key"))).alias("_whole"),
        F.min(F.when(past, F.struct("_key", F.floor((F.col("_room") - F.col("_run") + F.col("_sum")) / F.col("_tokens"))
                                    .cast("bigint").alias("copies")))).alias("_part"))
    some = F.col("_part.copies") > 0
    cut = plan.join(fine.select(*leaf, "_edge"), leaf, "left").join(ends, leaf, "left").select(
        *leaf, "_full", F.when(some, F.col("_part.copies")).alias("_copies"),
        # no row of the cut bucket fits: all buckets before it are taken, none of its rows
        F.when(some, F.col("_part._key")).otherwise(F.coalesce("_whole", "_edge")).alias("_last"))
    cut = stage(cut)
    return cut.join(_places(placed, cut, leaf), leaf, "left").select(*leaf, "_full", "_last", "_upto")


def _places(placed: DataFrame, cut: DataFrame, leaf: list[str]) -> DataFrame:
    """(leaf, _upto): the place of the last copy taken of the repeats that a cut falls among.

    Repeats are counted by stretches of their files; only those of the stretch in which
    the last copy lies are put in order.
    """
    wanted = bounded_broadcast(cut.where("_copies IS NOT NULL").select(*leaf, "_last", "_copies"))
    copies = placed.join(wanted, leaf).where("_key = _last").select(
        *leaf, "_copies", "_file", "_pos", F.expr(f"_pos div {_STRETCH}").alias("_stretch"))
    counts = copies.groupBy(*leaf, "_copies", "_file", "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    line = Window.partitionBy(*leaf).orderBy("_file", "_stretch").rowsBetween(Window.unboundedPreceding, 0)
    held = counts.withColumn("_seen", F.sum("_n").over(line)).where("_seen >= _copies AND _seen - _n < _copies").select(
        *leaf, "_file", "_stretch", (F.col("_copies") - F.col("_seen") + F.col("_n")).alias("_nth"))
    row = F.row_number().over(Window.partitionBy(*leaf).orderBy("_pos"))
    found = copies.drop("_copies").join(bounded_broadcast(held), [*leaf, "_file", "_stretch"]).withColumn("_row", row)
    return found.where("_row = _nth").select(*leaf, F.struct("_file", "_pos").alias("_upto"))


def mix(docs: DataFrame, how: Mix = DEFAULT_MIX, domain: str = DOMAIN_SQL, epoch: str = "epoch") -> DataFrame:
    """``docs`` with ``epoch`` (from 0): a row for each time a document is taken.

    Null languages, sources and domains are nodes of their own; a null or empty
    text has no tokens and comes with its leaf's first epoch if the leaf takes
    one whole or its place is before the cut. A leaf without any token has no
    share and gives none of its rows. Repeated rows count as often as they come;
    where the cut falls among repeats of one id and text, those first in file order
    are taken, so a leaf ends within one row of its budget. An empty table gives no
    rows. Columns of any name pass through; where ``epoch`` is one of them, the added
    column gets underscores behind its name. Rows that no longer are rows of files are
    written first.
    """
    docs = docs if file_position(docs) else stage(docs)
    rows = stage(tree(docs, domain))  # narrow; read several times, so that texts are read once
    leaf = [f"_{x}" for x in LEVELS]
    # few leaves are sent to the texts; many are joined, with the hot ones split by Spark
    cut = bounded_broadcast(thresholds(rows, how))
    path, place = file_position(docs)
    keyed = docs.select(packed(docs), "doc_id", *_nodes(domain), F.struct(
        path.alias("_file"), place.alias("_pos")).alias("_place"))
    last = lambda e: (order_key(e, how.seed) < F.col("_last")) | (
        (order_key(e, how.seed) == F.col("_last")) & (F.col("_upto").isNull() | (F.col("_place") <= F.col("_upto"))))
    epochs = F.array_compact(F.array(*[
        F.when((F.col("_full") > e) | ((F.col("_full") == e) & last(e)), F.lit(e)) for e in range(how.epochs)]))
    taken = keyed.join(cut, leaf).select("row", F.explode(epochs).alias("_epoch"))
    return taken.select(*unpacked(docs), F.col("_epoch").alias(free_name(docs.columns, epoch)))


def mix_sql(how: Mix = DEFAULT_MIX, domain: str = DOMAIN_SQL) -> str:
    """The same choice in DuckDB SQL, with a plain running total per leaf.

    Rows are taken in order of a hash of seed, epoch, id and text. Rows that repeat id and
    text are alike to the query, so which of them a cut takes makes no difference.
    """
    parts = [f"""
    docs AS (SELECT doc_id, {domain} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        md5(coalesce(text, '')) AS text_hash, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS n_tokens FROM documents),
    leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens,
        CAST(sum(n_tokens) * {how.epochs} AS DOUBLE) AS cap FROM docs GROUP BY ALL),
    nodes0 AS (SELECT *, CAST({f'{how.tokens}' if how.tokens is not None else
        f'(SELECT floor(sum(tokens) * {how.share!r}) FROM leaves)'} AS DOUBLE) AS budget FROM leaves)"""]
    for depth, level in enumerate(LEVELS):
        cases = "".join(f" WHEN {level} = '{v}' THEN {w!r}" for v, w in how.weights.get(level, {}).items())
        weight = f"CASE{cases} ELSE {float(how.other)!r} END" if cases else repr(float(how.other))
        parents = LEVELS[:depth]
        keys = ", ".join([*parents, level])
        family = f"PARTITION BY {', '.join(parents) or '0'}"
        line = f"({family} ORDER BY c / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        parts.append(f"""
    at{depth} AS (SELECT {keys}, sum(cap) AS c, max(budget) AS b, CAST({weight} AS DOUBLE) AS w
        FROM nodes{depth} GROUP BY {keys} HAVING w > 0),
    line{depth} AS (SELECT *, b - coalesce(sum(c) OVER {line}, 0) AS rest_b,
        sum(w) OVER ({family}) - coalesce(sum(w) OVER {line}, 0) AS rest_w FROM at{depth}),
    short{depth} AS (SELECT *, c * rest_w <= rest_b * w AS short FROM line{depth}),
    rate{depth} AS (SELECT *, min(CASE WHEN NOT short THEN {{'r': c / w, 'x': rest_b / rest_w}} END)
        OVER ({family}).x AS rate FROM short{depth}),
    nodes{depth + 1} AS (SELECT n.* REPLACE (CASE WHEN short THEN c ELSE w * rate END AS budget)
        FROM nodes{depth} n JOIN rate{depth} USING ({keys}))""".replace(f"OVER ({family}).x", f"OVER ({family})"))
        parts[-1] = parts[-1].replace(" AS rate FROM", " AS rate_row FROM").replace("w * rate END", "w * rate_row.x END")
    last = len(LEVELS)
    parts.append(f"""
    plan AS (SELECT domain, lang, source, tokens, floor(budget)::BIGINT AS budget FROM nodes{last} WHERE tokens > 0),
    cuts AS (SELECT domain, lang, source, least(budget // tokens, {how.epochs}) AS full_epochs,
        CASE WHEN budget < tokens * {how.epochs} THEN budget % tokens ELSE 0 END AS rest FROM plan),
    runs AS (SELECT d.*, e.epoch, full_epochs, rest, sum(n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source, e.epoch
        ORDER BY md5('{how.seed}:' || e.epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_hash)
        ROWS UNBOUNDED PRECEDING) AS run
        FROM docs d JOIN cuts USING (domain, lang, source), (SELECT unnest(range({how.epochs})) AS epoch) e)
    SELECT doc_id, domain, lang, source, n_tokens, CAST(epoch AS INTEGER) AS epoch FROM runs
    WHERE epoch < full_epochs OR (epoch = full_epochs AND run <= rest)""")
    return "WITH " + ",".join(parts)

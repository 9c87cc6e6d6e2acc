"""Secret scans through a trigram inverted index, in DataFrame functions only.

Each rule's regex is turned into a Boolean query over trigrams: an OR of ANDs
that every match must satisfy. Postings (trigram, row key) are built for the
trigrams that some rule names: a posting no rule could ever ask for is not
written. Postings are intersected per AND by one grouped bit mask, united per
rule, and the rows that remain are verified with the regex. A rule without
mandatory trigrams (a bare run of hex digits) scans every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakelens.llm.shared import let, packed, text_or_empty, unpacked
from lakelens.session import bounded_broadcast

#: Candidate rows that are sent to every executor rather than met by a shuffle of all texts.
CANDIDATES = 1_000_000

_parser = re._parser


@dataclass(frozen=True)
class Rule:
    """A kind of secret; ``group`` must be at least ``least`` characters long.

    ``verify`` may be a pattern with the same kept matches that is cheaper to
    run: bounds on a maximal run can be put inside it.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    verify: str | None = None


_ASSIGN = (
    r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)

BASE = (
    Rule("assign", _ASSIGN, group=2, least=6),
    # a run is maximal, so its lower bound can be part of the pattern
    Rule("access", r"AKIA[A-Z0-9]+", least=20, verify=r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]+", least=24, verify=r"[0-9a-f]{24,}"),
)

EXTRA = (
    Rule("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("gitkey", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

RULES = BASE + EXTRA

#: Trigrams asked for per AND; fewer than a match has give more candidates, never fewer.
_ASKED = 8


def _asked(ands: frozenset[str]) -> list[str]:
    """The trigrams of an AND that are looked up: those rare in prose first."""
    return sorted(ands, key=lambda t: (" " in t, t.isalpha(), t))[:_ASKED]


#: Strings that one part of a pattern may stand for before it counts as unknown.
_STRINGS = 64


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i:i + 3] for i in range(len(text) - 2))


#: What a part of a pattern says: the strings it can be (None: too many), and
#: the ANDs of which a match satisfies one (None: nothing is known).
_ANY = (None, None)


def _both(a, b):
    if a is None or b is None:
        return b if a is None else a
    out = {x | y for x, y in product(a, b)}
    return out if len(out) <= _STRINGS else a


def _known(strings):
    """The query of a set of whole strings."""
    ands = {_trigrams(s) for s in strings}
    return None if frozenset() in ands else ands


def _part(code, value):
    name = str(code)
    if name == "LITERAL":
        return {chr(value).lower()}, None
    if name == "IN":
        chars = set()
        for kind, x in value:
            if str(kind) == "LITERAL":
                chars.add(chr(x).lower())
            elif str(kind) == "RANGE" and x[1] - x[0] < 8:
                chars.update(chr(c).lower() for c in range(x[0], x[1] + 1))
            else:
                return _ANY
        return (chars, None) if len(chars) <= 8 else _ANY
    if name == "SUBPATTERN":
        return _sequence(value[-1])
    if name == "BRANCH":
        parts = [_sequence(x) for x in value[1]]
        if all(s is not None for s, _ in parts):
            strings = set().union(*(s for s, _ in parts))
            return (strings, None) if len(strings) <= _STRINGS else (None, _known(strings))
        queries = [q if s is None else _known(s) for s, q in parts]
        return None, None if None in queries else set().union(*queries)
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, body = value
        strings, query = _sequence(body)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, None
        if low == 0:
            return _ANY
        return None, query if strings is None else _known(strings)
    return _ANY


def _sequence(parts):
    run, query, whole = {""}, None, True
    for code, value in parts:
        strings, more = _part(code, value)
        joined = None if strings is None else {a + b for a, b in product(run, strings)}
        if joined is not None and len(joined) <= _STRINGS:
            run = joined
            continue
        whole = False
        query = _both(_both(query, _known(run)), more)
        run = {""} if strings is None else strings
    return (run, None) if whole else (None, _both(query, _known(run)))


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The OR of ANDs of lower-case trigrams a match needs; None: scan fully."""
    strings, query = _sequence(_parser.parse(pattern))
    query = _known(strings) if strings is not None else query
    if query is None:
        return None
    # an AND that contains another adds nothing to the OR
    return sorted((a for a in query if not any(b < a for b in query)), key=sorted)


def _row_key() -> list[Column]:
    """Rows of equal id and text share a key; an id shared by texts is told apart."""
    return [F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash")]


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(_id, _hash, trigram) for each of ``trigrams`` that a row's text holds."""
    found = let(F.lower("text"), lambda low: F.array_compact(
        F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams])))
    return docs.select(*_row_key(), F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(_id, _hash, _rules): a bit for each rule whose trigram query a row satisfies."""
    spark = docs.sparkSession
    terms = [
        (t, i, 1 << place, (1 << len(ands)) - 1, 1 << bit)
        for i, (bit, ands) in enumerate(
            (bit, _asked(a)) for bit, rule in enumerate(rules) for a in trigram_query(rule.pattern) or ())
        for place, t in enumerate(ands)
    ]
    if not terms:
        return docs.select(*_row_key()).limit(0).withColumn("_rules", F.lit(0).cast("bigint"))
    # one row for each trigram of each rule: bounded by the rules
    table = F.broadcast(spark.createDataFrame(
        terms, "trigram string, conj int, bit bigint, full bigint, rule bigint"))
    return (
        postings(docs, sorted({t[0] for t in terms}))
        .join(table, "trigram")
        .groupBy("_id", "_hash", "conj", "full", "rule")
        .agg(F.bit_or("bit").alias("got"))
        .where("got = full")
        .groupBy("_id", "_hash")
        .agg(F.bit_or("rule").alias("_rules"))
    )


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, rank, end, kind>> of a rule's kept matches in ``text``.

    Start positions are sums of the lengths of gaps and matches before. They are
    summed in two levels, runs of about the square root of their number, so that
    a text with very many matches does not cost their square.
    """
    pattern = F.lit(rule.verify or rule.pattern)
    kind = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"
    empty = F.from_json(F.lit("[]"), kind)

    def lengths(text: Column) -> Column:
        return F.arrays_zip(
            F.transform(F.split(text, rule.verify or rule.pattern, -1), F.length).alias("gap"),
            F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("hit"),
            F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("part"),
        )

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda s, x: s + x["gap"] + x["hit"])

    def located(s: Column) -> Column:
        """s: struct of all, n (matches), step and the total of each run."""
        def one(i: Column) -> Column:
            run = F.floor(i / s["step"]).cast("int")
            before = F.aggregate(F.slice(s["heads"], F.lit(1), run), F.lit(0).cast("bigint"), lambda a, b: a + b)
            inside = total(F.slice(s["all"], run * s["step"] + 1, i - run * s["step"]))
            start = before + inside + F.get(s["all"], i)["gap"]
            return F.struct(start.alias("start"), F.lit(order).alias("rank"),
                            (start + F.get(s["all"], i)["hit"]).alias("end"), F.lit(rule.kind).alias("kind"),
                            (F.get(s["all"], i)["part"] >= rule.least).alias("keep"))
        every = F.transform(F.sequence(F.lit(0), s["n"] - 1), one)
        return F.transform(F.filter(every, lambda x: x["keep"]), lambda x: F.struct(
            x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))

    def heads(s: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), F.floor((s["n"] - 1) / s["step"]).cast("int")),
            lambda c: total(F.slice(s["all"], c * s["step"] + 1, s["step"])))
        return F.struct(s["all"].alias("all"), s["n"].alias("n"), s["step"].alias("step"), runs.alias("heads"))

    def sized(all_: Column) -> Column:
        n = F.size(all_) - 1  # one gap more than matches
        return F.struct(all_.alias("all"), n.alias("n"), F.greatest(F.lit(1), F.sqrt(n).cast("int")).alias("step"))

    found = let(let(let(lengths(text), sized), heads), located)
    return F.when(F.regexp(text, pattern), found).otherwise(empty)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, text, _spans): each row of ``docs`` as one struct, its text (null: empty) and
    every span by start, then by the rules' order.

    Null and repeated ids are keys like others: the key holds a hash of the text, so
    equal rows get equal spans and rows are neither lost nor multiplied. An empty table
    gives no rows. Columns of any name pass through, as they are inside the struct.
    """
    keyed = docs.select(packed(docs), "doc_id", text_or_empty().alias("text"))
    found = candidates(keyed.select("doc_id", "text"), rules).withColumnsRenamed({"_id": "_cid", "_hash": "_chash"})
    # up to so many candidates (24 bytes each) are sent to the texts; else both are shuffled
    found = bounded_broadcast(found, CANDIDATES)
    joined = keyed.join(
        found, F.col("doc_id").eqNullSafe(F.col("_cid")) & (F.xxhash64("text") == F.col("_chash")), "left")
    spans = []
    for bit, rule in enumerate(rules):
        here = _spans(F.col("text"), rule, bit)
        if trigram_query(rule.pattern) is not None:
            asked = F.coalesce(F.col("_rules").bitwiseAND(F.lit(1 << bit)) != 0, F.lit(False))
            here = F.when(asked, here).otherwise(
                F.from_json(F.lit("[]"), "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"))
        spans.append(here)
    return joined.select("row", "text", F.array_sort(F.concat(*spans)).alias("_spans"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """One row per document: counts of the first ``base`` rules, their digest, all spans.

    Null texts count as empty: no span, and the digest of an empty list.
    """
    rows = with_spans(docs.select("doc_id", "text"), rules).select("row.doc_id", "_spans")
    count = lambda i: F.size(F.filter("_spans", lambda s: s["rank"] == i)).cast("bigint")
    return rows.select(
        "doc_id",
        *[count(i).alias(f"n_{rules[i].kind}") for i in range(base)],
        F.sha2(_joined(F.filter("_spans", lambda s: s["rank"] < base)), 256).alias("base_sha256"),
        _joined(F.col("_spans")).alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found secret replaced by ``mark``; no document goes.

    Spans come from ``with_spans``; where they overlap they are replaced as one.
    A text with no span, a null text included, keeps its value. ``n_chars`` is
    the new length where a text changed and the table has that column.
    """
    found = with_spans(docs, rules)

    def cut(text: Column, spans: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

        def step(state: Column, s: Column) -> Column:
            gap = F.when(s["start"] >= state["at"], F.concat(F.substring(
                text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit(mark)))
            return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                            F.when(gap.isNull(), state["out"]).otherwise(
                                F.array_append(state["out"], gap)).alias("out"))

        return F.aggregate(spans, start, step, lambda x: F.concat(
            F.array_join(x["out"], ""), F.substring(text, (x["at"] + 1).cast("int"), F.lit(2**31 - 1))))

    changed = F.size("_spans") > 0
    new = F.when(changed, cut(F.col("text"), F.col("_spans"))).otherwise(F.col("row")["text"])
    out = found.select("row", changed.alias("changed"), new.alias("text"))
    columns = dict(zip(docs.columns, unpacked(docs)))
    columns["text"] = F.col("text")
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("changed"), F.length("text").cast("bigint")).otherwise(
            F.col("row")["n_chars"]).alias("n_chars")
    return out.select(*columns.values())


def scan_sql(rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> str:
    """``scan`` in DuckDB SQL, every rule over every text."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    found = "\nUNION ALL\n".join(
        f"SELECT row, {rank} AS rank, {quoted(r.kind)} AS kind, {r.least} AS least, "
        f"regexp_extract_all(text, {quoted(r.pattern)}, 0) AS hits, "
        f"regexp_extract_all(text, {quoted(r.pattern)}, {r.group}) AS parts, "
        f"string_split_regex(text, {quoted(r.pattern)}) AS gaps FROM d"
        for rank, r in enumerate(rules))
    counts = ", ".join(f"count(kind) FILTER (rank = {i}) AS n_{rules[i].kind}" for i in range(base))
    listed = "string_agg(kind || ':' || begins || ':' || (begins + size), ',' ORDER BY begins, rank)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
each AS (SELECT row, rank, kind, least, hits, parts, gaps, unnest(range(1, len(hits) + 1)) AS i FROM found),
spans AS (SELECT row, rank, kind, length(hits[i]) AS size,
    list_sum(list_transform(gaps[1:i], lambda g: length(g)))
    + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS begins
    FROM each WHERE length(parts[i]) >= least)
SELECT any_value(doc_id) AS doc_id, {counts},
    sha256(coalesce({listed} FILTER (rank < {base}), '')) AS base_sha256, coalesce({listed}, '') AS spans
FROM d LEFT JOIN spans USING (row) GROUP BY row"""

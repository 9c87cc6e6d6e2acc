"""From raw documents to token ids: rate, deduplicate, redact, mix, encode.

Each stage takes what its predecessor kept and returns rows of ``documents`` (the last
one codes); between stages rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm import bpe, mixing, near, quality, secrets
from lakelens.llm.shared import table
from lakelens.session import stage
from lakelens.sources.schema import quoted

#: Stages that SQL cannot express; the tests have a brute-force version.
ORACLE_SQL = None


def vocabulary() -> str:
    """The tokenizer file; the package that knows its place is no part of the library."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def rated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents whose chance of a good grade is under one half go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.selected(docs, model)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: the document with the smallest id of each class stays."""
    return near.deduplicated(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: found secrets are masked, no document goes."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: a row for each time a document is taken."""
    return mixing.mix(docs).select(*[quoted(c) for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding: token ids of each row, their number, and a digest that decoding checks."""
    codes = bpe.encode(docs, vocabulary())
    return codes.select(
        "doc_id", "n_tokens",
        F.when(F.col("n_tokens") == 0, F.array().cast("array<int>")).otherwise(
            F.split("ids", " ").cast("array<int>")).alias("ids"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", rated),
    ("near_dedup", deduplicated),
    ("secrets", redacted),
    ("mixing", mixed),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

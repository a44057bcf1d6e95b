"""A corpus pipeline of five stages over ``documents``.

Quality rules drop documents; exact and near duplicates leave one document of each group; mixing repeats or leaves out
documents so that domains come to their target weights; the last stage encodes what is left and decodes
it again. A stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read
again as the next one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.bpe import bpe_round_trip
from shelfmark.llm.exact_dedup import exact_dedup
from shelfmark.llm.mixing import mixed
from shelfmark.llm.near_dedup import near_dedup
from shelfmark.llm.quality import fit, quality_filter
from shelfmark.llm.queries import TARGETS, domains, fit_split
from shelfmark.session import configure, ship, work_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands, which clean labelled documents set."""
    configure(ship(spark))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_filter(docs, limits=fit(docs, labels, usable=fit_split(F.col("id"))))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that agree up to white space, the document with the least id."""
    configure(ship(spark))
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingles at 0.8, the document with the least id."""
    configure(ship(spark))
    return near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, so that domains come to TARGETS."""
    configure(ship(spark))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixed(docs, domains(labels), TARGETS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row."""
    configure(ship(spark))
    return bpe_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("mixing", mix),
    ("bpe", encode),
]

# Compression ratios, classifier and tokenizer have no SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in their order over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs

"""Corpus pipeline: five stages over ``documents``, each by one operator of ``groundsieve.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as Parquet in the shared
folder and reads it back as the next one's documents. All but the last return the columns of ``documents``.

Defined results: null texts count as empty and are scored, joined, scanned and packed as such; rows with an empty set of
shingles stay; equal rows are near duplicates of each other, so one of them stays; an empty table passes through empty; a
null id never wins a group that has another id. Extra columns of the input are dropped at the first stage.
"""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from groundsieve.llm import decontaminate, jaccard, packing, quality, secrets
from groundsieve.llm.common import documents, whole, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None  # fitted scores, edit distances and token ids are not expressible; tests compare with brute force


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of at least 0.3)."""
    weights = quality.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.with_score(docs.select(*COLUMNS), weights, whole(), name="quality_score").where("quality_score >= 0.3").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return jaccard.one_per_component(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.with_items(docs.select(*COLUMNS), items, name="items_found").where(F.size("items_found") == 0).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark; n_chars follows the text."""
    found = secrets.find_wide(docs.select(*COLUMNS), whole(), keep=COLUMNS)
    clean = found.withColumn("clean", F.when(F.size("spans") > 0, secrets.redacted(F.col("text"), F.col("spans"))))
    return clean.select("doc_id", F.coalesce("clean", "text").alias("text"), "lang", "source",
                        F.coalesce(F.length("clean").cast("long"), "n_chars").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences of at most 4096 tokens."""
    texts = docs.select("doc_id", whole().alias("text"))
    pieces = packing.token_pieces(texts, public_tokenizers.path("word_bpe_49k.json"), F.col("text"), keep=["doc_id"])
    return packing.pack(pieces)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_quality), ("ngram_jaccard_join", drop_near_duplicates), ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets), ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs

"""The registered document queries: thin contracts over the operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from groundsieve.llm import (alignment, conversations, decontaminate, fingerprints, jaccard, language, licenses, lm, packing, quality, secrets,
                             token_counts, token_files)
from groundsieve.llm.common import documents, remainder, whole, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = "word_bpe_49k.json"


def query(plan):
    QUERIES[plan.__name__] = plan
    return plan


@query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts meet their successors' heads by two joins on the row's number; ids, not texts, are sorted."""
    docs = documents(spark, sf_dir).select(F.monotonically_increasing_id().alias("row"), "doc_id", whole().alias("text"))
    links = written(fingerprints.successors(docs.select("row", "doc_id", F.length("text").cast("long").alias("n_chars")), "row", "doc_id"))
    wanted = links.select(F.col("next_row").alias("row"), F.col("row").alias("for"), F.floor(F.col("n_chars") / 3).cast("int").alias("need"))
    texts = docs.select("row", "text")  # both joins read this one exchange
    heads = texts.join(wanted.hint("shuffle_hash"), "row").select(F.col("for").alias("row"), F.substring("text", F.lit(1), F.col("need")).alias("head"), "need")
    both = texts.join(heads.hint("shuffle_hash"), "row")
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.length("text") - F.col("need")).cast("int")), "head"))
    both = both.select("row", F.sha2("edited", 256).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("kind", "text"))
    votes = both.select("row", "kind", "edited_sha256", F.explode_outer(fingerprints.terms(F.col("text"))).alias("term"))
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("bits")))
    prints = fingerprints.voted(votes, ["row", "kind", "edited_sha256"], "term").groupBy("row", "edited_sha256")
    prints = written(prints.agg(of(0).alias("own"), of(1).alias("changed")))
    following = prints.select(F.col("row").alias("next_row"), F.col("own").alias("next"))
    done = prints.join(links, "row").join(following, "next_row")
    return done.select("doc_id", "n_chars", "edited_sha256", fingerprints.as_hex(F.col("own")).alias("fingerprint"),
                       fingerprints.as_hex(F.col("changed")).alias("edited_fingerprint"),
                       fingerprints.likeness(F.col("own"), F.col("changed")).alias("near_edited"),
                       fingerprints.likeness(F.col("own"), F.col("next")).alias("near_next"))


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", whole().alias("text"))
    pieces = packing.token_pieces(docs, public_tokenizers.path(VOCABULARY), F.col("text"), keep=["doc_id"])
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of every whole text: doc_id, paragraph, family, probability, likeness."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return licenses.scan(docs, licenses.train(docs), keep=["doc_id"])


@query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every whole text, within 8 % edits."""
    return decontaminate.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    weights = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.with_score(docs, weights, whole())
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", whole().alias("text"))
    found = secrets.find(docs, F.col("text"), keep=["doc_id"])
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.train(docs.select("doc_id", "lang", "text"))
    named = language.with_language(docs.select("doc_id", "text"), model, F.col("text"))
    return named.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "language.lang_pred", "language.score")


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", whole().alias("text"))
    counted = token_counts.with_counts(docs, public_tokenizers.path(VOCABULARY), F.col("text"), limit=2048)
    n = F.col("tokens.n_tokens")
    return counted.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), n.alias("n_tokens"),
                          (n > 2048).alias("over_limit"), F.col("tokens.limit_chars").alias("limit_chars"))


@query
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", (remainder("doc_id", 7) == 2).alias("held_out"))
    return lm.scored(docs, "held_out")


@query
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    path = public_tokenizers.path
    return alignment.aligned(docs, path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    planned, repaired = conversations.repair(rows)
    hashed = conversations.digests(repaired)
    return planned.join(hashed, planned["conv_id"].eqNullSafe(hashed["conv_id"])).select(planned["*"], "repaired_sha256")


@query
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.texts(token_files.write(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path(VOCABULARY)))

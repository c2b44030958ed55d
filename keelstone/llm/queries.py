"""Contract queries of the corpus operators over the standard tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelstone.llm import oracles
from keelstone.llm._common import n_rows, spread_join, text_copies, text_key
from keelstone.llm.ann import ann_search
from keelstone.llm.chat_format import format_conversations, loss_text
from keelstone.llm.decontamination import decontaminate
from keelstone.llm.html_extract import extract_pages
from keelstone.llm.ngram_jaccard import ngram_jaccard
from keelstone.llm.packing import pack
from keelstone.llm.substring_dedup import repeat_classes
from keelstone.llm.token_counts import token_counts
from keelstone.llm.toxicity import fit_toxicity, held_out, score_toxicity
from keelstone.llm.url_filter import url_filter

#: Files of the public tokenizers.
PACKING_TOKENIZER, COUNTING_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"
#: The rules of the URL filter's contract: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: A conversation that every template has to survive.
HARD_TEXT = "\\### Assistant: </turn> ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)["page_id", "host", "path", "rule", "verdict"]


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(PACKING_TOKENIZER), capacity=4096, end_id=2)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document's source and text, and of every line of them."""
    docs = _table(spark, sf_dir, "documents")
    return token_counts(docs, public_tokenizers.path(COUNTING_TOKENIZER), public_tokenizers.PATTERN, fields=["source", "text"], rule="start")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), n=10, keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TEXT).alias("text"))
    out = format_conversations(rows.unionByName(hard))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann_search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    copies = text_copies(docs, "text")
    classes = repeat_classes(docs, width=35, copies=copies).select("k1", "k2", "n_words", "n_removed", "kept_sha256")
    rows = docs.select("doc_id", *text_key(F.col("text")))
    out = spread_join(rows, classes, ["k1", "k2"], ["doc_id"], n_rows(copies), counts=copies)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_ngram_jaccard,
        op3_toxicity,
        op4_packing,
        op5_token_counts,
        op6_decontamination,
        op7_html_extraction,
        op8_chat_format,
        op9_ann,
        op10_substring_dedup,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": oracles.OP1,
    "op6_decontamination": oracles.OP6,
    "op8_chat_format": oracles.OP8,
}

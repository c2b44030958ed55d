"""The corpus pipeline: toxicity, near copies, repeated substrings, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelstone.llm._common import free_name, materialise, n_rows, spread_join, text_copies, text_key
from keelstone.llm.decontamination import text_hits
from keelstone.llm.ngram_jaccard import ngram_jaccard
from keelstone.llm.packing import pack
from keelstone.llm.substring_dedup import substring_dedup
from keelstone.llm.toxicity import fit_toxicity, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more; a null text is scored as an empty one."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs.columns, "score")
    return score_toxicity(docs, model, score_col=score).where(F.col(score) < 0.5).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of five-word shingle sets with a similarity of 0.8.

    Rows of one id are one document: the row with the smallest text, and one of equal
    rows, stands for it before copies are looked for, so no text goes as the copy of a row
    that goes itself.  Of a component the document with the smallest id stays.
    Documents without words all stay, as do those whose id is null.
    """
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.coalesce("text", F.lit("")).alias("t"))).alias("first")).where("n > 1")
    if not several.isEmpty():
        twice = docs.join(several, "doc_id").where(F.coalesce("text", F.lit("")) == F.col("first.t")).dropDuplicates(["doc_id"])
        docs = materialise(docs.join(several, "doc_id", "left_anti").select(docs.columns).unionByName(twice.select(docs.columns)), "one_row_an_id")
    found = ngram_jaccard(docs, k=5, num=4, den=5)
    # a document that is not its component's smallest goes
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 35 words or more that occur elsewhere.

    A text that loses words is put together anew, with single spaces, and its ``n_chars``
    is counted again; others stay as they are.
    """
    # Texts come back from the operator, so the join moves each text once.
    taken = [*docs.columns, "n_words", "n_removed", "kept_text"]
    null, size = free_name(taken, "null"), free_name(taken, "size")
    rest = [c for c in docs.columns if c not in ("text", "n_chars", "n_words", "n_removed", "kept_text")]
    own = {c: free_name(taken, f"own_{c}") for c in docs.columns if c in ("n_words", "n_removed", "kept_text")}
    rows = docs.withColumns({null: F.col("text").isNull(), size: F.col("n_chars")} | {new: F.col(c) for c, new in own.items()})
    cut = substring_dedup(rows, width=35, keep=[*rest, null, size, *own.values()], as_is=True)
    lost = F.col("n_removed") > 0
    text = F.when(~F.col(null), F.col("kept_text"))
    chars = F.when(lost, F.length("kept_text").cast("long")).otherwise(F.col(size))
    out = {"text": text, "n_chars": chars} | {c: F.col(new) for c, new in own.items()}
    return cut.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which any window of ten words of a benchmark item occurs."""
    hits = text_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10, "text", "item_id", "text")
    a, b = free_name(docs.columns, "k1"), free_name(docs.columns, "k2")
    keys = [c.alias(n) for c, n in zip(text_key(F.col("text")), (a, b), strict=True)]
    gone = materialise(hits.select(F.col("k1").alias(a), F.col("k2").alias(b)), "contaminated")
    copies = text_copies(docs, "text").withColumnsRenamed({"k1": a, "k2": b})
    kept = spread_join(docs.select("*", *keys), gone, [a, b], ["doc_id"], n_rows(copies), "left_anti", counts=copies)
    return kept.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=2)


STAGES = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("repeated_substrings", repeated_substrings),
    ("benchmark_passages", benchmark_passages),
    ("packing", packing),
]

#: SQL cannot express the fitted model, the tokenizer or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

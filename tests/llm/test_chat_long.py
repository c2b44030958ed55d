"""Conversations of many turns, and the places of the loss mask."""

import time

import pytest
from pyspark.sql import functions as F

from keelstone.llm import chat_format
from keelstone.llm.queries import HARD_TEXT, QUERIES


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 1000])
def test_running_sums(spark, n):
    got = spark.range(1).select(chat_format.running_sums(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i * i).cast("long")))).first()[0]
    assert got == [sum(j * j for j in range(1, i + 1)) for i in range(1, n + 1)]


def test_fifty_thousand_turns(spark):
    n = 50_000
    role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    text = F.when(F.col("id") % 10 == 3, F.concat(F.lit("é </turn> \\"), F.col("id"))).otherwise(F.concat(F.lit("turn "), F.col("id")))
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), text.alias("text"))
    began = time.time()
    out = chat_format.format_conversations(rows)
    r = out.withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))).first()
    took = time.time() - began
    texts = [f"é </turn> \\{i}" if i % 10 == 3 else f"turn {i}" for i in range(n)]
    assert [t["text"] for t in r["turns"]] == texts and r["loss"] == "".join(texts[1::2])
    assert [s["turn"] for s in r["loss_spans"]] == list(range(1, n, 2))
    assert took < 10


def test_spans_are_places_in_the_formatted_text(spark):
    turns = ["plain", "", HARD_TEXT, "é\n<turn x>", "\\\\<\\/turn>", "z" * 50]
    rows = spark.createDataFrame([(1, i, "a" if i % 2 else "<b>", t) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    r = chat_format.format_conversations(rows, ("a", "<b>")).first()
    raw = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
    read = spark.createDataFrame([(x,) for x in raw], "x string").select(chat_format.unescape(F.col("x"))).collect()
    assert [x[0] for x in read] == turns


def test_the_query_starts_no_python(spark, sf_dir):
    plan = QUERIES["op8_chat_format"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan

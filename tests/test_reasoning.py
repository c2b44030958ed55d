"""Expected classifications, verdicts and bounds."""

import pytest
from pyspark.sql import functions as F

from keelstone.functions import text as X
from keelstone.operators import reasoning


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Signed overflow wraps around", "positive"),
        ("Overflow is undefined behavior", "negative"),
        ("The value is valid", "positive"),
        ("The value is invalid", "negative"),
        ("It must not be null", "negative"),
        ("A neutral sentence", "neutral"),
        ("", "neutral"),
    ],
)
def test_polarity(spark, text, expected):
    assert one(spark, X.polarity(F.col("t")), t=text) == expected


def test_topics_after_lemmas(spark):
    assert one(spark, X.topics(F.col("t")), t="Dereferencing a NULL pointer overflows") == ["overflow", "null_pointer", "pointer"]


PAIRS = [
    ("Signed integer overflow is safe", "Signed integer overflow is undefined behavior", "M", "CONTRADICTS", 0.9),
    ("Integer overflow is undefined", "Signed integer overflow is undefined behavior", "M", "SUPPORTS", 0.8),
    ("Unsigned integer works", "Unsigned integer wraps around", "M", "SUPPORTS", 0.7),
    ("Integer is invalid", "Integer returns", "M", "CONTRADICTS", 0.7),
    ("An integer", "The integer is undefined", "M", "RELATED_TO", 0.5),
    ("A buffer is safe", "Division by zero is undefined", "M", "RELATED_TO", 0.3),
    ("An integer is valid", "integer", "C-ERROR", "CONTRADICTS", 0.9),
    ("A null pointer is valid", "null pointer", "M", "CONTRADICTS", 0.9),
]


def test_entailment_table(spark):
    rows = spark.createDataFrame([(i, *p[:3]) for i, p in enumerate(PAIRS)], "i int, claim string, content string, module string")
    got = {r["i"]: (r["relationship"], r["entailment"]) for r in reasoning.classify(rows).collect()}
    assert got == {i: p[3:] for i, p in enumerate(PAIRS)}


HIT = "claim_id long, claim string, rank int, id string, content string, module string, layer string, confidence double, distance double"


def test_chain_keeps_near_hits_else_the_first(spark):
    rows = [(1, "c d", 1, "a", "x", "M", "library", 0.9, 0.5), (1, "c d", 2, "b", "x", "M", "c11_core", 0.8, 1.5), (1, "c d", 3, "c", "x", "M", "c11_core", 0.7, 1.6), (2, "c d", 1, "d", "x", "M", "library", 0.6, 9.0), (2, "c d", 2, "e", "x", "M", "c11_core", 0.6, 9.5), (3, "c d", 1, "f", "a c d b", "M", "c11_core", 1.0, None)]
    steps = reasoning.chain_steps(spark.createDataFrame(rows, HIT))
    assert sorted((r["claim_id"], r["step"], r["id"]) for r in steps.collect()) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "d"), (3, 1, "f")]
    chain = {r["claim_id"]: r for r in reasoning.chains(steps).collect()}
    assert (chain[1]["grounded"], chain[1]["chain_confidence"]) == (False, 0.8)
    assert chain[3]["grounded"]
    found = spark.createDataFrame([("a", "z", 0.5)], "id string, found_id string, found_confidence double")
    chain = {r["claim_id"]: r for r in reasoning.chains(steps, found).collect()}
    assert (chain[1]["grounded"], chain[1]["chain_confidence"], chain[1]["n_steps"]) == (True, 0.5, 3)


def test_verdicts(spark):
    claims = spark.createDataFrame([(i,) for i in range(5)], "claim_id long")
    chain = spark.createDataFrame([(0, True, 0.9, 2, "a", 1, 0), (1, True, 0.9, 2, "a", 0, 0), (2, False, 0.5, 1, "a", 1, 0), (3, True, 0.9, 2, "a", 1, 1)], "claim_id long, grounded boolean, chain_confidence double, n_steps long, first_id string, supported int, contradicted int")
    against = spark.createDataFrame([(3, "a", "entailment", 0.9), (3, "b", "semantic", 0.7)], "claim_id long, id string, kind string, sure double")
    got = {r["claim_id"]: (r["is_valid"], r["confidence"], r["status"]) for r in reasoning.validate(claims, chain, against).collect()}
    assert got == {0: (True, 0.9, "VALID"), 1: (True, 0.5, "VALID"), 2: (True, 0.4, "LIKELY VALID"), 3: (False, 0.1, "INVALID"), 4: (True, 0.3, "UNCERTAIN")}
    quick = {r["claim_id"]: r["is_valid"] for r in reasoning.quick_check(claims, against.where("sure < 0.8")).collect()}
    assert quick[3]


def test_negations_keep_their_quirks(spark):
    assert one(spark, X.negations(F.col("t")), t="It can be valid") == ["it can be invalid", "it cannot be valid", "not It can be valid", "undefined behavior It can be valid"]


def test_claims_are_stripped_and_long_enough(spark):
    assert one(spark, X.claims(F.col("t")), t="Short. \tThis one is long enough!? ok") == ["This one is long enough"]

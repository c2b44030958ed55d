"""Reasoning over claims in batch: proof chains, contradictions, validation.

``hits`` are search results: ``claim_id, claim, rank, id, content, module, layer,
confidence, distance``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelstone.functions import patterns as P
from keelstone.functions import text as X
from keelstone.schemas import grounded


class Lexicon:
    """What the classifier listens to."""

    def __init__(self, positive: Sequence[str] = P.POSITIVE, negative: Sequence[str] = P.NEGATIVE, topics=P.TOPICS, lemmas=P.LEMMAS, implicit: Sequence[str] = P.IMPLICIT_ERRORS, safety=P.SAFETY, danger=P.DANGER, pairs=P.CONTRADICTION_PAIRS, dangerous=P.DANGEROUS_CLAIMS):
        self.positive, self.negative, self.topics, self.lemmas, self.implicit = positive, negative, topics, lemmas, implicit
        self.safety, self.danger, self.pairs, self.dangerous = safety, danger, pairs, dangerous


def classify(pairs: DataFrame, lex: Lexicon | None = None) -> DataFrame:
    """``pairs`` (``claim, content, module``) with ``relationship`` and ``entailment`` (its confidence)."""
    lex = lex or Lexicon()
    claim = X.polarity(F.col("claim"), lex.positive, lex.negative)
    rule = X.rule_polarity(F.col("content"), F.col("module"), None, lex.positive, lex.negative, lex.implicit)
    both = F.size(F.array_intersect(X.topics(F.col("claim"), lex.topics, lex.lemmas), X.topics(F.col("content"), lex.topics, lex.lemmas)))
    out = pairs.withColumns({"_c": claim, "_r": rule, "_t": both})
    out = out.withColumn("_e", X.entailment(F.col("_c"), F.col("_r"), F.col("_t")))
    return out.withColumns({"relationship": F.col("_e.relationship"), "entailment": F.col("_e.confidence")}).drop("_c", "_r", "_t", "_e")


def chain_steps(hits: DataFrame, lex: Lexicon | None = None, most: int = 3, least: float = 0.4) -> DataFrame:
    """Per claim the first ``most`` hits near enough, else its first hit, classified: adds ``step``."""
    good = X.passes(F.col("distance"), F.col("claim"), F.col("content"), least)
    any_good = Window.partitionBy("claim_id")
    rows = hits.withColumn("_good", good).withColumn("_any", F.max("_good").over(any_good))
    rows = rows.where(F.col("_good") | (~F.col("_any") & (F.col("rank") == 1)))
    step = Window.partitionBy("claim_id").orderBy("rank")
    rows = rows.withColumn("step", F.row_number().over(step)).where(F.col("step") <= most)
    return classify(rows.drop("_good", "_any"), lex)


def chains(steps: DataFrame, foundations: DataFrame | None = None) -> DataFrame:
    """Per claim ``grounded, chain_confidence`` (least of its steps), ``n_steps``, first step and relationships.

    ``foundations`` (``id, found_id, found_confidence``) has the first grounded rule on a
    dependency path of a rule; it grounds a claim whose first step is not, as one
    more step.
    """
    out = steps.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("n_steps"), F.min("confidence").alias("least"), F.min_by("id", "step").alias("first_id"), F.min_by("layer", "step").alias("first_layer"),
        F.max((F.col("relationship") == "SUPPORTS").cast("int")).alias("supported"), F.max((F.col("relationship") == "CONTRADICTS").cast("int")).alias("contradicted"),
    )
    direct = grounded(F.col("first_layer"))
    if foundations is None:
        return out.select("claim_id", direct.alias("grounded"), F.col("least").alias("chain_confidence"), "n_steps", "first_id", "supported", "contradicted")
    found = foundations.select(F.col("id").alias("first_id"), "found_id", "found_confidence")
    out = out.join(found, "first_id", "left")
    more = ~direct & F.col("found_id").isNotNull()
    return out.select(
        "claim_id", (direct | more).alias("grounded"), F.when(more, F.least("least", "found_confidence")).otherwise(F.col("least")).alias("chain_confidence"),
        (F.col("n_steps") + more.cast("int")).alias("n_steps"), "first_id", "supported", "contradicted",
    )


def detect(hits: DataFrame, term_hits: DataFrame | None = None, lex: Lexicon | None = None) -> DataFrame:
    """Contradictions per claim and rule, the surest: ``claim_id, id, kind, sure``.

    ``term_hits`` are hits of a dangerous claim's search terms (R8), tested against
    pattern pairs (0.9); ``hits`` of the claim itself are tested for meaning (0.7).
    """
    lex = lex or Lexicon()
    meant = hits.where(X.contradicts(F.col("claim"), F.col("content"), lex.safety, lex.danger))
    out = meant.select("claim_id", "id", F.lit("semantic").alias("kind"), F.lit(0.7).alias("sure"))
    if term_hits is not None:
        kind = X.pattern_contradiction(F.col("claim"), F.col("content"), lex.pairs)
        direct = term_hits.where(X.is_dangerous(F.col("claim"), lex.dangerous)).withColumn("kind", kind).where("kind is not null")
        out = out.unionByName(direct.select("claim_id", "id", "kind", F.lit(0.9).alias("sure")))
    best = out.groupBy("claim_id", "id").agg(F.max(F.struct("sure", "kind")).alias("b"))
    return best.select("claim_id", "id", F.col("b.kind").alias("kind"), F.col("b.sure").alias("sure"))


def combined(steps: DataFrame, detected: DataFrame) -> DataFrame:
    """Contradicting steps (0.9), and detected contradictions of other rules."""
    own = steps.where("relationship = 'CONTRADICTS'").select("claim_id", "id", F.lit("entailment").alias("kind"), F.lit(0.9).alias("sure")).distinct()
    return own.unionByName(detected.join(own, ["claim_id", "id"], "left_anti"))


def validate(claims: DataFrame, chain: DataFrame, contradictions: DataFrame) -> DataFrame:
    """Per claim ``is_valid, confidence, n_contradictions, status``.

    A contradiction of any confidence makes a claim invalid, with 1 - the surest.  Else
    a grounded claim has its chain's confidence if a step supports it and 0.5 if none
    does; any other 0.8 of its chain's, or 0.3 without a chain.
    """
    against = contradictions.groupBy("claim_id").agg(F.max("sure").alias("surest"), F.count(F.lit(1)).alias("n"))
    out = claims.select("claim_id").join(chain, "claim_id", "left").join(against, "claim_id", "left")
    valid = F.col("n").isNull()
    safe = F.coalesce("grounded", F.lit(False))
    sure = (
        F.when(~valid, 1 - F.col("surest")).when(safe & (F.col("supported") == 1), F.col("chain_confidence")).when(safe, F.lit(0.5))
        .when(F.col("n_steps") > 0, 0.8 * F.col("chain_confidence")).otherwise(F.lit(0.3))
    )
    status = F.when(~valid, "INVALID").when(safe, "VALID").when(F.col("n_steps") > 0, "LIKELY VALID").otherwise("UNCERTAIN")
    return out.select("claim_id", valid.alias("is_valid"), F.round(sure, 6).alias("confidence"), F.coalesce("n", F.lit(0)).alias("n_contradictions"), safe.alias("grounded"), status.alias("status"))


def quick_check(claims: DataFrame, detected: DataFrame, least: float = 0.8) -> DataFrame:
    """The detector alone; a claim is invalid only from a confidence of ``least`` on."""
    worst = detected.groupBy("claim_id").agg(F.max("sure").alias("sure"))
    return claims.select("claim_id").join(worst, "claim_id", "left").select("claim_id", (F.coalesce("sure", F.lit(0.0)) < least).alias("is_valid"))


def explain(validated: DataFrame) -> DataFrame:
    """A sentence for each verdict; needs ``status``, ``rule_id``, ``content`` and ``kind``."""
    text = (
        F.when(F.col("status") == "INVALID", F.format_string("INVALID: The claim contradicts formal semantics. The rule '%s' states: %s. Contradiction type: %s.", "rule_id", "content", "kind"))
        .when(F.col("status") == "VALID", F.format_string("VALID: The claim is grounded in formal semantics. The rule '%s' states: %s", "rule_id", "content"))
        .when(F.col("status") == "LIKELY VALID", F.lit("LIKELY VALID: Found supporting rules but claim is not directly grounded."))
        .otherwise(F.lit("UNCERTAIN: No contradictions found, but no supporting rules were found either. Exercise caution."))
    )
    return validated.withColumn("explanation", text)

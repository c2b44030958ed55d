"""Plans that put the operators together: validate texts, search with partners, load a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelstone.functions import patterns as P
from keelstone.functions import text as X
from keelstone.operators import graph, reasoning, store, vectors
from keelstone.schemas import GROUNDED


def search_claims(claims: DataFrame, rules: DataFrame, k: int = 10) -> DataFrame:
    """Hits of ``claims`` (``claim_id, claim``) among ``rules`` (``id, content, module, layer, confidence``), by their vectors ``v``, made if absent."""
    base = rules if "v" in rules.columns else rules.withColumn("v", vectors.encode(F.col("content")))
    near = vectors.knn(claims.withColumn("q", vectors.encode(F.col("claim"))), base, k, "claim_id", "q").withColumnRenamed("query_id", "claim_id")
    return near.join(claims, "claim_id").join(rules.select("id", "content", "module", "layer", "confidence"), "id")


def term_searches(claims: DataFrame, rules: DataFrame, k: int = 5, dangerous=None) -> DataFrame:
    """Hits of the search terms of dangerous claims."""
    lex = reasoning.Lexicon() if dangerous is None else reasoning.Lexicon(dangerous=dangerous)
    risky = claims.where(X.is_dangerous(F.col("claim"), lex.dangerous))
    terms = risky.select("claim_id", "claim", F.posexplode(X.search_terms(F.col("claim"))).alias("n", "term"))
    terms = terms.withColumn("query", F.concat_ws(":", F.col("claim_id").cast("string"), F.col("n").cast("string")))
    hits = search_claims(terms.select(F.col("query").alias("claim_id"), F.col("term").alias("claim")), rules, k)
    return hits.withColumnRenamed("claim_id", "query").drop("claim").join(terms.select("query", "claim_id", "claim", "n"), "query").drop("query")


def contradicting_hits(claims: DataFrame, rules: DataFrame, k: int = 5) -> DataFrame:
    """Hits of every negated form of a claim, ``k`` each, distinct as whole rows, numbered by ``pos``.

    Rows are in the order of the forms, then of rank; a caller that wants a list of
    ``n`` takes the rows with ``pos <= n``.
    """
    forms = claims.select("claim_id", F.posexplode(X.negations(F.col("claim"))).alias("n", "form"))
    forms = forms.withColumn("query", F.concat_ws(":", F.col("claim_id").cast("string"), F.col("n").cast("string")))
    hits = search_claims(forms.select(F.col("query").alias("claim_id"), F.col("form").alias("claim")), rules, k)
    hits = hits.withColumnRenamed("claim_id", "query").drop("claim").join(forms.select("query", "claim_id", "n"), "query").drop("query")
    once = store.first_per_key(hits, ["claim_id", "id", "distance"], ["n", "rank"])
    return once.withColumn("pos", F.row_number().over(Window.partitionBy("claim_id").orderBy("n", "rank"))).drop("n", "rank")


def foundations(edges: DataFrame, rules: DataFrame, ids: DataFrame, most: int = 10, checkpoint=None) -> DataFrame:
    """For each of ``ids`` (column ``id``) the first grounded rule on its longest dependency path."""
    trusted = rules.where(F.col("layer").isin(*GROUNDED))
    paths = graph.longest_paths(ids, edges, trusted.select("id"), most, checkpoint)
    first = graph.first_on_path(paths, rules.select("id", "layer"), F.col("layer").isin(*GROUNDED))
    return first.select(F.col("start").alias("id"), F.col("id").alias("found_id")).join(rules.select(F.col("id").alias("found_id"), F.col("confidence").alias("found_confidence")), "found_id")


def _judged(claims: DataFrame, rules: DataFrame, edges: DataFrame | None, lex: reasoning.Lexicon | None, checkpoint) -> tuple[DataFrame, ...]:
    """Hits of claims, hits of their search terms, chain steps, contradictions, and verdicts."""
    hits = search_claims(claims, rules)
    steps = reasoning.chain_steps(hits, lex)
    found = None
    if edges is not None:
        loose = steps.where((F.col("step") == 1) & ~F.col("layer").isin(*GROUNDED)).select("id").distinct()
        found = foundations(edges, rules, loose, checkpoint=checkpoint)
    chain = reasoning.chains(steps, found)
    term_hits = term_searches(claims, rules, dangerous=lex and lex.dangerous)
    against = reasoning.combined(steps, reasoning.detect(hits, term_hits, lex))
    return hits, term_hits, steps, against, reasoning.validate(claims, chain, against)


def validate_claims(claims: DataFrame, rules: DataFrame, edges: DataFrame | None = None, lex: reasoning.Lexicon | None = None, checkpoint=None) -> DataFrame:
    """R10 in one plan for all claims: search, chain, contradictions, grounding, verdict, warnings."""
    *_, against, out = _judged(claims, rules, edges, lex, checkpoint)
    contents = against.join(rules.select("id", "content"), "id").groupBy("claim_id").agg(F.collect_list("content").alias("contents"))
    out = out.join(claims.select("claim_id", "claim"), "claim_id").join(contents, "claim_id", "left")
    none = F.array().cast("array<string>")
    return out.withColumn("warnings", X.warnings(F.col("claim"), F.coalesce("contents", none))).drop("contents")


def explain_claims(claims: DataFrame, rules: DataFrame, edges: DataFrame | None = None, lex: reasoning.Lexicon | None = None, checkpoint=None) -> DataFrame:
    """The verdict of each claim with its sentence, about its first contradiction or else its first step.

    Contradicting steps come first, in their order, then detected contradictions, the
    surest first, in the order of the searches.
    """
    hits, term_hits, steps, against, out = _judged(claims, rules, edges, lex, checkpoint)
    place = lambda at: F.min(F.struct(*at)).alias("place")
    own = steps.groupBy("claim_id", "id").agg(place([F.lit(0).alias("n"), F.col("step").alias("rank")])).withColumn("way", F.lit("entailment"))
    terms = term_hits.groupBy("claim_id", "id").agg(place([F.col("n"), F.col("rank")])).withColumn("way", F.lit("pattern"))
    near = hits.groupBy("claim_id", "id").agg(place([F.lit(0).alias("n"), F.col("rank")])).withColumn("way", F.lit("semantic"))
    way = F.when(F.col("kind").isin("entailment", "semantic"), F.col("kind")).otherwise("pattern")
    placed = against.withColumn("way", way).join(own.unionByName(terms).unionByName(near), ["claim_id", "id", "way"])
    order = F.struct((F.col("kind") != "entailment").alias("a"), (-F.col("sure")).alias("b"), "place", "id")
    worst = placed.groupBy("claim_id").agg(F.min_by(F.struct("id", "kind"), order).alias("w")).select("claim_id", F.col("w.id").alias("rule_id"), F.col("w.kind").alias("kind"))
    first = steps.where("step = 1").select("claim_id", F.col("id").alias("first_id"))
    out = out.join(worst, "claim_id", "left").join(first, "claim_id", "left").withColumn("rule_id", F.coalesce("rule_id", "first_id")).drop("first_id")
    return reasoning.explain(out.join(rules.select(F.col("id").alias("rule_id"), "content"), "rule_id", "left"))


def validate_texts(texts: DataFrame, rules: DataFrame, edges: DataFrame | None = None, lex: reasoning.Lexicon | None = None) -> DataFrame:
    """``texts`` (``text_id, text``) split into claims, each validated; ids are (text, place)."""
    split = texts.select("text_id", F.posexplode(X.claims(F.col("text"))).alias("place", "claim"))
    claims = split.withColumn("claim_id", F.concat_ws("/", F.col("text_id").cast("string"), F.col("place").cast("string")))
    return validate_claims(claims.select("claim_id", "claim"), rules, edges, lex).join(claims.select("claim_id", "text_id", "place"), "claim_id")


def search_with_pairs(queries: DataFrame, rules: DataFrame, pairs: DataFrame, participants: DataFrame, k: int = 5) -> DataFrame:
    """V5: the ``k`` nearest rules of ``queries`` (``claim_id, claim``), each followed by its partners and idioms."""
    hits = search_claims(queries, rules, k).select(F.col("claim_id").alias("query_id"), "rank", "id")
    both = pairs.select(F.col("src").alias("at"), F.col("dst").alias("other")).unionByName(pairs.select(F.col("dst").alias("at"), F.col("src").alias("other")))
    return vectors.expand_pairs(hits, both, participants.select(F.col("src").alias("at"), F.col("dst").alias("idiom")))


def candidate_queries(functions: DataFrame, terms: str = P.CANDIDATE_TERMS, concepts=P.CANDIDATE_CONCEPTS) -> DataFrame:
    """V6: the searches for each function (``fn, place, signature, content``, a row for each rule): ``fn, ord, k, text``.

    The signatures of its first three rules, their contents with fixed terms, and the
    concepts whose words occur in the contents.
    """
    three = functions.where("place <= 3")
    signed = three.where("signature <> ''").select("fn", F.col("place").cast("int").alias("ord"), F.lit(10).alias("k"), F.col("signature").alias("text"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "content"))), lambda x: x["content"]), " ")
    whole = three.groupBy("fn").agg(joined.alias("content"))
    meant = whole.select("fn", F.lit(4).alias("ord"), F.lit(20).alias("k"), F.concat("content", F.lit(" " + terms)).alias("text"))
    named = [F.when(X.has_any(F.lower("content"), keys), F.struct(F.lit(i).alias("ord"), F.lit(10).alias("k"), F.lit(text).alias("text"))) for i, (keys, text) in enumerate(concepts, 5)]
    return signed.unionByName(meant).unionByName(whole.select("fn", F.inline(F.array_compact(F.array(*named)))))


def candidate_foundations(queries: DataFrame, base: DataFrame, most: int = 30) -> DataFrame:
    """The first ``most`` distinct rules of ``base`` that the ``queries`` of each function find, in their order: ``fn, id, pos``."""
    asked = queries.withColumn("claim_id", F.concat_ws(":", F.col("fn").cast("string"), F.col("ord").cast("string")))
    widest = queries.agg(F.max("k").alias("k")).first()["k"] or 1
    hits = search_claims(asked.select("claim_id", F.col("text").alias("claim")), base, widest).select("claim_id", "rank", "id")
    found = hits.join(asked.select("claim_id", "fn", "ord", "k"), "claim_id").where("rank <= k")
    united = store.first_per_key(found, ["fn", "id"], ["ord", "rank"])
    pos = Window.partitionBy("fn").orderBy("ord", "rank")
    return united.withColumn("pos", F.row_number().over(pos)).where(F.col("pos") <= most).select("fn", "id", "pos")


def load_collection(rules: DataFrame, codes: DataFrame, old_rules: DataFrame | None = None, mode: str = "upsert") -> dict[str, DataFrame]:
    """K2, K4, K8: the tables of a loaded collection: rules, codes, depends_on and violated_by edges, dangling ids.

    Codes are matched by their internal code; edges are built from the whole set, so the
    order of rows does not matter.
    """
    if mode not in ("upsert", "append"):
        raise ValueError("mode has to be upsert or append")
    new = rules.withColumn("_ord", F.monotonically_increasing_id())
    if old_rules is None:
        every = store.first_per_key(new, ["id"], [F.desc("_ord")]) if mode == "upsert" else new
    elif mode == "upsert":
        every = store.upsert(old_rules.withColumn("_ord", F.lit(-1).cast("long")), new, ["id"], ["_ord"])
    else:
        every = old_rules.unionByName(rules)
    every = every.drop("_ord")
    listed = every.select("id", F.transform("violated_by", lambda v: v["code"]).alias("codes"))
    return {
        "rules": every, "codes": store.first_per_key(codes, ["internal_code"], ["code"]),
        "depends_on": store.resolved_edges(every, "id", "depends_on", every, "id"), "violated_by": store.resolved_edges(listed, "id", "codes", codes, "internal_code"),
        "dangling": store.dangling(every, "id", "depends_on", every, "id"),
    }

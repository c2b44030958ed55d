"""Queries that do the whole job, where the queries beside them are bounded by their SQL."""

from keelstone import catalog
from keelstone.catalog import language
from keelstone.plans import validation
from tests.oracle import connect


def brute_negations(claim):
    low, out = claim.lower(), []
    if "is safe" in low:
        out += [low.replace("is safe", "is unsafe"), low.replace("is safe", "undefined behavior")]
    if "defined" in low and "undefined" not in low:
        out.append(low.replace("defined", "undefined"))
    for old, new in (("valid", "invalid"), ("can", "cannot"), ("will", "will not")):
        if old in low:
            out.append(low.replace(old, new))
    return [*out, f"not {claim}", f"undefined behavior {claim}"]


def test_every_claim_is_negated(spark, sf_dir):
    claims = {r["claim_id"]: r["claim"] for r in language.claims(spark, sf_dir).collect()}
    got = {r["claim_id"]: r["variants"] for r in catalog.QUERIES["f14_all_negations"](spark, sf_dir).collect()}
    assert got == {i: brute_negations(c) for i, c in claims.items()}
    assert any(not c.isascii() for c in claims.values())


def brute_steps(n, most):
    """Fewest steps between vertices of the graph of the catalog, and each start's longest simple path."""
    hop = {i: sorted({(7 * i + 1) % n, (3 * i + 2) % n}) for i in range(n)}
    steps, longest = {}, {}
    for start in range(n):
        seen, front = {start: 0}, [start]
        for d in range(1, most + 1):
            front = [x for x in sorted({y for v in front for y in hop[v]}) if x not in seen]
            seen |= {x: d for x in front}
        steps |= {(start, x): d for x, d in seen.items() if d}
        paths = [(start,)]
        for d in range(1, most + 1):
            paths = [(*p, x) for p in paths for x in hop[p[-1]] if x not in p]
            if paths:
                longest[start] = d
    return steps, longest


def test_graphs_go_to_ten_steps(spark, sf_dir):
    n = connect(sf_dir).execute("select count(*) from embeddings").fetchone()[0]
    steps, longest = brute_steps(n, 10)
    assert {(r["start"], r["node"]): r["steps"] for r in catalog.QUERIES["g2_reachability_10"](spark, sf_dir).collect()} == steps
    assert {r["start"]: r["depth"] for r in catalog.QUERIES["o3_argmax_path_10"](spark, sf_dir).collect()} == longest
    assert max(steps.values()) > 5
    assert max(longest.values()) == 10


def test_rules_of_search_terms_contradict(spark, tmp_path):
    claim = "the of and division alpha beta gamma delta"
    rules = [(i, f"the of and alpha beta gamma delta word{i}") for i in range(12)] + [(12, "division by zero undefined in the end")]
    spark.createDataFrame([(1, 0, claim)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(rules, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near = {r["id"] for r in language.hits(spark, str(tmp_path)).collect()}
    found = {r["id"]: r["sure"] for r in catalog.QUERIES["r7_contradictions"](spark, str(tmp_path)).collect()}
    assert "rule_12" not in near
    assert found["rule_12"] == 0.9
    assert catalog.QUERIES["r10_validate"](spark, str(tmp_path)).first()["n_contradictions"] == len(found)


def test_dependencies_ground_claims(spark, sf_dir):
    alone = {r["claim_id"]: r for r in catalog.QUERIES["r10_validate"](spark, sf_dir).collect()}
    linked = {r["claim_id"]: r for r in catalog.QUERIES["r10_validate_grounded"](spark, sf_dir).collect()}
    more = [i for i in alone if linked[i]["grounded"] and not alone[i]["grounded"]]
    assert more
    assert alone.keys() == linked.keys()
    assert not [i for i in alone if alone[i]["grounded"] and not linked[i]["grounded"]]
    said = {r["claim_id"]: r for r in catalog.QUERIES["r9_explanations"](spark, sf_dir).collect()}
    assert {i: r["status"] for i, r in said.items()} == {i: r["status"] for i, r in linked.items()}
    assert all(r["explanation"].startswith(r["status"] + ": ") for r in said.values())


def test_negated_forms_find_more_rules(spark, sf_dir):
    claims = spark.createDataFrame([(1, "It is valid")], "claim_id long, claim string")
    rules = spark.createDataFrame([("a", "it is valid"), ("b", "undefined behavior it is valid"), ("c", "not it is valid"), ("d", "invalid")], "id string, content string")
    rules = rules.selectExpr("*", "'M' AS module", "'library' AS layer", "1.0D AS confidence")
    rows = validation.contradicting_hits(claims, rules, 1).orderBy("pos").collect()
    assert [(r["id"], r["pos"]) for r in rows] == [("a", 1), ("c", 2), ("b", 3)]
    found = {(r["claim_id"], r["id"]) for r in catalog.QUERIES["r2_contradicting"](spark, sf_dir).collect()}
    assert found - {(r["claim_id"], r["id"]) for r in catalog.QUERIES["r2_supporting"](spark, sf_dir).collect()}


def test_sections_are_whole_up_to_40000_characters(spark, tmp_path):
    pages = [(1, "x" * 4001), (2, "y" * 40000), (3, "z" * 40001), (4, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["section"] for r in catalog.QUERIES["s10_full_sections"](spark, str(tmp_path)).collect()}
    assert got == {1: pages[0][1], 2: pages[1][1], 3: "z" * 40000 + "\n[truncated]", 4: None}


def test_candidates_come_from_all_strategies(spark):
    functions = spark.createDataFrame([("f", 1, "alpha", "a lambda"), ("f", 2, None, "a loop"), ("f", 3, "beta", "x"), ("f", 4, "gamma", "template"), ("g", 1, None, "y")], "fn string, place int, signature string, content string")
    queries = validation.candidate_queries(functions)
    got = sorted((r["fn"], r["ord"], r["k"], r["text"]) for r in queries.collect())
    fixed = "C++ lambda template parameter reference capture"
    assert got == [("f", 1, 10, "alpha"), ("f", 3, 10, "beta"), ("f", 4, 20, f"a lambda a loop x {fixed}"), ("f", 5, 10, "lambda expression capture closure"), ("f", 8, 10, "range-based for loop iterator"), ("g", 4, 20, f"y {fixed}")]
    words = ["alpha"] * 12 + ["beta"] * 12 + ["lambda"] * 12 + ["closure"] * 12
    base = spark.createDataFrame([(f"{i:02}", w, "M", "c11_core", 1.0) for i, w in enumerate(words)], "id string, content string, module string, layer string, confidence double")
    found = {fn: [r["id"] for r in validation.candidate_foundations(queries, base).orderBy("pos").collect() if r["fn"] == fn] for fn in "fg"}
    assert found["f"] == [f"{i:02}" for i in [*range(10), *range(12, 22), *range(24, 34)]]
    assert len(found["g"]) == 20

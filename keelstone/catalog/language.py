"""Text functions, reasoning, linking and extraction: F*, R*, J9-J22, X* on the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelstone.catalog._registry import LOW, query, table
from keelstone.functions import text as X
from keelstone.operators import extract, linking, reasoning, vectors
from keelstone.operators.store import first_per_key
from keelstone.plans import validation
from keelstone.plans.state import materialise

# -- lexicons that occur in the test corpus --------------------------------------------------

POSITIVE, NEGATIVE = ("the ",), ("and ",)
TOPICS = {"th": ("th",), "er": ("er ",), "en": ("en ",)}
SAFETY, DANGER = ("the ",), ("and ",)
PAIRS = ((" of ", " the ", "direct"), (" is ", " and ", "implied"))
CONCEPTS = ((("th",), "the of and"), (("zzz",), "and"), (("er ", "zzz"), "is to in it"), (("en ",), "der die und"))
DANGEROUS = ("the of and", "is to in it")
LEXICON = reasoning.Lexicon(POSITIVE, NEGATIVE, TOPICS, {"thth": "th"}, ("zzz",), SAFETY, DANGER, PAIRS, DANGEROUS)

_CLAIMS = """SELECT conv_id * 1000000 + turn * 1000 + i - 1 AS claim_id, s AS claim FROM (SELECT conv_id, turn, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS s FROM
 (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 10) AS l FROM conversations))"""
_RULES = "SELECT 'rule_' || item_id AS id, text AS content, 'M' || item_id % 7 AS module, CASE WHEN item_id % 3 = 0 THEN 'c11_core' ELSE 'library' END AS layer, 0.5 + 0.1 * (item_id % 5) AS confidence FROM benchmark"
_VEC = "SELECT {0}, ('0x' || left(md5(w), 8))::UBIGINT % 64 AS b, count(*)::DOUBLE AS n FROM (SELECT {0}, unnest(regexp_extract_all(" + LOW.format("{1}") + ", '[a-z0-9]+')) AS w FROM {2}) GROUP BY 1, 2"
_HITS = f"""c AS ({_CLAIMS}), r AS ({_RULES}), cv AS ({_VEC.format("claim_id", "claim", "c")}), rv AS ({_VEC.format("id", "content", "r")}),
 cn AS (SELECT claim_id, sqrt(sum(n * n)) AS s FROM cv GROUP BY 1), rn AS (SELECT id, sqrt(sum(n * n)) AS s FROM rv GROUP BY 1),
 dot AS (SELECT claim_id, id, sum(cv.n * rv.n) AS d FROM cv JOIN rv USING (b) GROUP BY 1, 2),
 alld AS (SELECT c.claim_id, c.claim, r.*, round(greatest((cn.s IS NOT NULL)::INT + (rn.s IS NOT NULL)::INT - 2 * coalesce(dot.d / (cn.s * rn.s), 0), 0), 6) AS distance
  FROM c CROSS JOIN r LEFT JOIN cn USING (claim_id) LEFT JOIN rn USING (id) LEFT JOIN dot USING (claim_id, id)),
 hits AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY distance, id) AS rank FROM alld QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY distance, id) <= 10)"""
_POL = "CASE WHEN contains({0}, 'and ') THEN 'negative' WHEN contains({0}, 'the ') THEN 'positive' ELSE 'neutral' END"
_TOPICS = "((regexp_matches({0}, 'th') AND regexp_matches({1}, 'th'))::INT + (regexp_matches({0}, 'er ') AND regexp_matches({1}, 'er '))::INT + (regexp_matches({0}, 'en ') AND regexp_matches({1}, 'en '))::INT)"
_CLASSIFIED = f"""cl AS (SELECT *, CASE WHEN t = 0 THEN 'RELATED_TO' WHEN cp = 'positive' AND rp = 'negative' THEN 'CONTRADICTS' WHEN cp = 'negative' AND rp = 'negative' THEN 'SUPPORTS'
  WHEN cp = 'positive' AND rp = 'positive' THEN 'SUPPORTS' WHEN cp = 'negative' AND rp = 'positive' THEN 'CONTRADICTS' ELSE 'RELATED_TO' END AS relationship,
  CASE WHEN t = 0 THEN 0.3 WHEN cp = 'positive' AND rp = 'negative' THEN 0.9 WHEN cp = 'negative' AND rp = 'negative' THEN 0.8 WHEN cp = 'positive' AND rp = 'positive' THEN 0.7 WHEN cp = 'negative' AND rp = 'positive' THEN 0.7 ELSE 0.5 END AS entailment
  FROM (SELECT *, {_POL.format("lower(claim)")} AS cp, {_POL.format("lower(content)")} AS rp, {_TOPICS.format("lower(claim)", "lower(content)")} AS t FROM {{}}))"""
_STEPS = f"""good AS (SELECT *, bool_or(1 / (1 + distance) >= 0.4) OVER (PARTITION BY claim_id) AS near_one FROM hits), picked AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY rank) AS step FROM good
  WHERE 1 / (1 + distance) >= 0.4 OR (NOT near_one AND rank = 1) QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY rank) <= 3), {_CLASSIFIED.format("picked")}"""
_SEM = "((contains(lower(claim), 'the ') AND contains(lower(content), 'and ')) OR (contains(lower(claim), 'never') AND (contains(lower(content), 'may') OR contains(lower(content), 'can'))) OR (contains(lower(claim), 'always') AND contains(lower(content), 'not always')))"
_DANGEROUS = "(len(list_intersect(list_distinct(string_split_regex(lower(claim), '\\s+')), ['the', 'of', 'and'])) >= 0.6 * 3 OR len(list_intersect(list_distinct(string_split_regex(lower(claim), '\\s+')), ['in', 'is', 'it', 'to'])) >= 0.6 * 4)"
_KIND = "CASE WHEN contains(lower(claim), ' of ') AND contains(lower(content), ' the ') THEN 'direct' WHEN contains(lower(claim), ' is ') AND contains(lower(content), ' and ') THEN 'implied' END"
_DETECTED = f"""det AS (SELECT claim_id, id, max(sure) AS sure, arg_max(kind, sure * 10 + (kind > 'e')::INT) AS kind FROM (SELECT claim_id, id, 'semantic' AS kind, 0.7 AS sure FROM hits WHERE {_SEM}
  UNION ALL SELECT claim_id, id, {_KIND}, 0.9 FROM hits WHERE rank <= 5 AND {_DANGEROUS} AND {_KIND} IS NOT NULL) GROUP BY 1, 2)"""
_VALIDATED = f"""chain AS (SELECT claim_id, count(*) AS n_steps, min(confidence) AS least, arg_min(layer, step) AS layer, bool_or(relationship = 'SUPPORTS') AS supported FROM cl GROUP BY 1),
 own AS (SELECT DISTINCT claim_id, id, 0.9 AS sure FROM cl WHERE relationship = 'CONTRADICTS'), against AS (SELECT claim_id, max(sure) AS surest, count(*) AS n FROM (SELECT * FROM own UNION ALL SELECT claim_id, id, sure FROM det ANTI JOIN own USING (claim_id, id)) GROUP BY 1),
 val AS (SELECT c.claim_id, n IS NULL AS is_valid, round(CASE WHEN n IS NOT NULL THEN 1 - surest WHEN layer = 'c11_core' AND supported THEN least WHEN layer = 'c11_core' THEN 0.5 WHEN n_steps > 0 THEN 0.8 * least ELSE 0.3 END::DOUBLE, 6) AS confidence,
  coalesce(n, 0) AS n_contradictions, coalesce(layer = 'c11_core', false) AS grounded, CASE WHEN n IS NOT NULL THEN 'INVALID' WHEN layer = 'c11_core' THEN 'VALID' WHEN n_steps > 0 THEN 'LIKELY VALID' ELSE 'UNCERTAIN' END AS status
  FROM c LEFT JOIN chain USING (claim_id) LEFT JOIN against USING (claim_id))"""

_NEGATED = """list_filter([CASE WHEN contains(l, 'is safe') THEN replace(l, 'is safe', 'is unsafe') END, CASE WHEN contains(l, 'is safe') THEN replace(l, 'is safe', 'undefined behavior') END,
 CASE WHEN contains(l, 'defined') AND NOT contains(l, 'undefined') THEN replace(l, 'defined', 'undefined') END, CASE WHEN contains(l, 'valid') THEN replace(l, 'valid', 'invalid') END,
 CASE WHEN contains(l, 'can') THEN replace(l, 'can', 'cannot') END, CASE WHEN contains(l, 'will') THEN replace(l, 'will', 'will not') END, 'not ' || claim, 'undefined behavior ' || claim], lambda x: x IS NOT NULL)"""

_FORM_HITS = _HITS.replace(_CLAIMS, f"SELECT claim_id * 100 + unnest(range(len(v))) AS claim_id, unnest(v) AS claim FROM (SELECT claim_id, {_NEGATED} AS v FROM (SELECT *, lower(claim) AS l FROM ({_CLAIMS})))", 1)
_CANDIDATE_QUERIES = """SELECT fn * 100 + place AS claim_id, signature AS claim FROM rr WHERE place <= 3 AND signature <> '' UNION ALL SELECT fn * 100 + 4, content || ' C++ lambda template parameter reference capture' FROM ff UNION ALL SELECT fn * 100 + 5, 'the of and' FROM ff WHERE contains(lower(content), 'th')
 UNION ALL SELECT fn * 100 + 7, 'is to in it' FROM ff WHERE contains(lower(content), 'er ') UNION ALL SELECT fn * 100 + 8, 'der die und' FROM ff WHERE contains(lower(content), 'en ')"""
_CANDIDATE_HITS = _HITS.replace(_CLAIMS, _CANDIDATE_QUERIES, 1).replace(_RULES, f"SELECT * FROM ({_RULES}) WHERE layer = 'c11_core'", 1).replace("<= 10)", "<= 20)")
_FOUND = """re AS (SELECT DISTINCT 'rule_' || item_id AS src, 'rule_' || unnest([(item_id * 7 + 1) % n, (item_id * 3 + 2) % n]) AS dst FROM benchmark, (SELECT count(*) AS n FROM benchmark)),
 p(start, node, path, depth) AS (SELECT id, id, [id], 0 FROM (SELECT DISTINCT id FROM cl WHERE step = 1 AND layer <> 'c11_core') UNION ALL SELECT p.start, re.dst, list_append(p.path, re.dst), p.depth + 1 FROM p JOIN re ON re.src = p.node WHERE p.depth < 10 AND NOT list_contains(p.path, re.dst)),
 lp AS (SELECT start, path FROM p JOIN r ON r.id = p.node WHERE r.layer = 'c11_core' AND depth > 0 QUALIFY row_number() OVER (PARTITION BY start ORDER BY depth DESC, path) = 1),
 fd AS (SELECT start, r.confidence AS found FROM (SELECT start, i, path[i] AS id FROM (SELECT start, path, unnest(range(2, len(path) + 1)) AS i FROM lp)) JOIN r USING (id) WHERE r.layer = 'c11_core' QUALIFY row_number() OVER (PARTITION BY start ORDER BY i) = 1),
 gc AS (SELECT a.*, a.layer = 'c11_core' OR fd.start IS NOT NULL AS safe, CASE WHEN fd.start IS NOT NULL THEN least(a.least, fd.found) ELSE a.least END AS lowest FROM (SELECT claim_id, count(*) AS n_steps, min(confidence) AS least, arg_min(id, step) AS first_id, arg_min(layer, step) AS layer, bool_or(relationship = 'SUPPORTS') AS supported FROM cl GROUP BY 1) a LEFT JOIN fd ON fd.start = a.first_id),
 gval AS (SELECT c.claim_id, n IS NULL AS is_valid, round(CASE WHEN n IS NOT NULL THEN 1 - surest WHEN safe AND supported THEN lowest WHEN safe THEN 0.5 WHEN n_steps > 0 THEN 0.8 * lowest ELSE 0.3 END::DOUBLE, 6) AS confidence,
  coalesce(n, 0) AS n_contradictions, coalesce(safe, false) AS grounded, CASE WHEN n IS NOT NULL THEN 'INVALID' WHEN safe THEN 'VALID' WHEN n_steps > 0 THEN 'LIKELY VALID' ELSE 'UNCERTAIN' END AS status, first_id
  FROM c LEFT JOIN gc USING (claim_id) LEFT JOIN against USING (claim_id)),
 worst AS (SELECT claim_id, id, kind FROM (SELECT claim_id, id, 'entailment' AS kind, 0 AS a, step AS b FROM cl WHERE relationship = 'CONTRADICTS' UNION ALL SELECT d.claim_id, d.id, d.kind, CASE WHEN sure > 0.8 THEN 1 ELSE 2 END, h.rank FROM (SELECT * FROM det ANTI JOIN own USING (claim_id, id)) d JOIN hits h USING (claim_id, id)) QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY a, b, id) = 1)"""


def claims(spark, sf):
    """Sentences of all conversations."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode_outer(X.claims(F.col("text"))).alias("i", "claim")).where("claim is not null")
    return c.select((F.col("conv_id") * 1000000 + F.col("turn") * 1000 + F.col("i")).alias("claim_id"), "claim")


def rules(spark, sf):
    """Benchmark items as rules; every third is of a trusted layer."""
    i = F.col("item_id")
    layer = F.when(i % 3 == 0, "c11_core").otherwise("library")
    return table(spark, sf, "benchmark").select(F.concat(F.lit("rule_"), i).alias("id"), F.col("text").alias("content"), F.concat(F.lit("M"), i % 7).alias("module"), layer.alias("layer"), (0.5 + 0.1 * (i % 5)).alias("confidence"))


def hits(spark, sf, k=10):
    """The nearest rules of every claim."""
    c, r = claims(spark, sf), rules(spark, sf)
    near = vectors.knn(c.withColumn("q", vectors.encode(F.col("claim"))), r.withColumn("v", vectors.encode(F.col("content"))), k, "claim_id", "q")
    return near.withColumnRenamed("query_id", "claim_id").join(c, "claim_id").join(r, "id")


# -- text functions ------------------------------------------------------------------------


@query("SELECT p_partkey, 'c11_' || CASE WHEN length(m) > 30 THEN left(array_to_string(list_filter(string_split(m, '_'), lambda x: x NOT IN ('c', 'common', 'syntax')), '_'), 25) ELSE m END || '_' || lower(p_type) || '_' || left(md5(p_brand || '-C-' || p_name || ':' || lower(p_type) || ':' || p_size), 8) AS id FROM (SELECT *, replace(lower(p_brand || '-C-' || p_name), '-', '_') AS m FROM part)")
def f1_rule_id(spark, sf):
    module = F.concat(F.col("p_brand"), F.lit("-C-"), F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", X.rule_id(module, F.lower("p_type"), F.col("p_size").cast("string")).alias("id"))


@query("SELECT s_suppkey, 'lib_' || regexp_replace(s_name, '[^A-Za-z0-9]+', '_', 'g') || '_' || left(md5(s_name || s_nationkey), 8) AS id FROM supplier")
def f2_hashed_id(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", X.hashed_id("lib", F.col("s_name"), F.concat("s_name", "s_nationkey")).alias("id"))


@query("SELECT item_id, len(list_filter(list_transform(string_split_regex(regexp_replace(text, '\\s+', ' ', 'g'), '\\s+the\\s+'), lambda x: trim(x)), lambda x: x <> '')) AS n FROM benchmark")
def f3_conditions(spark, sf):
    spec = F.regexp_replace("text", r"(?<=\s)the(?=\s)", "andBool")
    return table(spark, sf, "benchmark").select("item_id", F.size(X.conditions(spec)).cast("long").alias("n"))


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'divisor must be non-zero' WHEN 1 THEN 'either value must be zero or operand is a pointer type' WHEN 2 THEN 'if type is void then value is opaque'
 WHEN 3 THEN 'NOT: x' || p_size || ' > 1' WHEN 4 THEN 'x' || p_size || ' ≤ 7' ELSE 'exactly one of (must be an lvalue) or (value must be zero)' END AS said FROM part""")
def f4_condition_text(spark, sf):
    from keelstone.functions.conditions import condition_text

    n = F.concat(F.lit("x"), "p_size")
    forms = [F.lit("((notBool isZero(X)))"), F.lit("isZero(X) orBool (isPointerType(T))"), F.lit("isVoidType(T) impliesBool isOpaque(V)"), F.concat(F.lit("notBool ("), n, F.lit(":Int >Int 1)")), F.concat(n, F.lit("::CValue <=Int 7")), F.lit("isLValue(E) xorBool isZero(E)")]
    return table(spark, sf, "part").select("p_partkey", condition_text(F.element_at(F.array(*forms), F.col("p_size") % 6 + 1)).alias("said"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Integer division requires: divisor must be non-zero, and operand must be integer-promoted.' WHEN 1 THEN 'The x is freed.'
 WHEN 2 THEN 'Operation requires: a' || p_size || ' > 0.' ELSE 'No preconditions specified.' END AS said FROM part""")
def f5_description(spark, sf):
    from keelstone.functions.conditions import description

    forms = [F.lit("notBool isZero(X) // note\n andBool isPromoted(T)"), F.lit("/*@ \\fromStandard{s}{The x is freed.}*/ q"), F.concat(F.lit("(a"), "p_size", F.lit(" >Int 0)")), F.lit("")]
    op = F.when(F.col("p_size") % 4 == 0, "division").otherwise("other")
    return table(spark, sf, "part").select("p_partkey", description(F.element_at(F.array(*forms), F.col("p_size") % 4 + 1), op).alias("said"))


@query("SELECT p_partkey, 'x' || p_size || ' ≠ y' AS clean, CASE WHEN p_size % 2 = 0 THEN 'this is undefined behavior' END AS said FROM part")
def f6_clean_up(spark, sf):
    from keelstone.functions import conditions as C

    spec = F.concat(F.lit("(x"), "p_size", F.lit("::UType =/=K y) "), F.when(F.col("p_size") % 2 == 0, "// this is undefined behavior").otherwise("/* a * b */"))
    return table(spark, sf, "part").select("p_partkey", C.plain_signs(C.without_comments(spec)).alias("clean"), C.standard_text(spec).alias("said"))


@query("""SELECT p_partkey, CASE WHEN contains(l, '/') AND NOT contains(lower(l), 'div') THEN 'division' WHEN contains(l, '%') THEN 'modulus' WHEN contains(l, '*') AND NOT contains(lower(l), 'mult') THEN 'multiplication' WHEN contains(l, '+') THEN 'addition'
 WHEN contains(l, '-') THEN 'subtraction' WHEN contains(l, '<<') OR contains(l, '>>') THEN 'shift' WHEN contains(l, '&') OR contains(l, '|') OR contains(l, '^') THEN 'bitwise' WHEN contains(l, '==') OR contains(l, '!=') OR contains(l, '<') OR contains(l, '>') THEN 'comparison'
 WHEN contains(l, ':=') OR contains(l, '=') THEN 'assignment' ELSE 'operation' END AS op FROM (SELECT p_partkey, CASE p_size % 10 WHEN 0 THEN 'a / b' WHEN 1 THEN 'div / b' WHEN 2 THEN 'a % b' WHEN 3 THEN 'a * b' WHEN 4 THEN 'a + b' WHEN 5 THEN 'a << b' WHEN 6 THEN 'a & b' WHEN 7 THEN 'a == b' WHEN 8 THEN 'a := b' ELSE 'a' END AS l FROM part)""")
def f7_operation(spark, sf):
    lhs = F.element_at(F.array(*map(F.lit, ("a / b", "div / b", "a % b", "a * b", "a + b", "a << b", "a & b", "a == b", "a := b", "a"))), F.col("p_size") % 10 + 1)
    return table(spark, sf, "part").select("p_partkey", X.operation_of(lhs).alias("op"))


@query("SELECT p_partkey, concat_ws(',', CASE WHEN p_size < 10 THEN 'zero_check' END, CASE WHEN p_size > 20 THEN 'pointer' END, CASE WHEN p_size % 2 = 0 THEN 'addition' END) AS tags FROM part")
def f8_tags(spark, sf):
    spec = F.concat_ws(" ", F.when(F.col("p_size") < 10, "isZero(x)"), F.when(F.col("p_size") > 20, "isPointer(y)"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.spec_tags(spec, F.when(F.col("p_size") % 2 == 0, "a + b").otherwise("a")), ",").alias("tags"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'malloc' WHEN p_size % 3 = 1 THEN 'fn' || p_partkey END AS function FROM part")
def f9_function_name(spark, sf):
    lhs = F.when(F.col("p_size") % 3 == 0, 'x builtin("malloc", y)').when(F.col("p_size") % 3 == 1, F.concat(F.lit("<k> fn"), "p_partkey", F.lit("(A, B)"))).otherwise("tv(A)")
    return table(spark, sf, "part").select("p_partkey", X.function_name(lhs, lhs).alias("function"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'beta,f' || p_size ELSE 'f' || p_size END AS calls FROM part")
def f10_calls(spark, sf):
    rhs = F.concat(F.lit("f"), "p_size", F.lit("(lval(x)) "), F.when(F.col("p_size") % 2 == 0, 'builtin("beta", 1)').otherwise(F.concat(F.lit("f"), "p_size", F.lit("(y)"))))
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.function_calls(rhs, ("lval", "builtin")), ",").alias("calls"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'mem:write' WHEN 1 THEN 'mem:remove' WHEN 2 THEN 'mem:modify' ELSE 'mem:read' END || ' env:read' AS access FROM part")
def f11_cell_access(spark, sf):
    forms = ("<mem> .Map => X </mem>", "<mem> (B) |-> _ => .Map </mem>", "<mem> (A => B) |-> C </mem>", "<mem> A </mem>")
    rule = F.concat(F.element_at(F.array(*map(F.lit, forms)), F.col("p_size") % 4 + 1), F.lit(" <env> E </env>"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(X.cell_access(rule), lambda a: F.concat_ws(":", a["cell"], a["access"])), " ").alias("access"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'pointer,size_t' WHEN 1 THEN 'optional,reference' ELSE '' END AS types FROM part")
def f12_signature_types(spark, sf):
    sig = F.element_at(F.array(F.lit("size_t f(char* p)"), F.lit("std::optional<T>& g()"), F.lit("int h()")), F.col("p_size") % 3 + 1)
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.signature_types(sig, {r"\bsize_t\b": "size_t"}), ",").alias("types"))


@query("SELECT p_partkey, concat_ws(',', 'err' || p_size, CASE WHEN p_size > 25 THEN 'pointer' END, CASE WHEN p_size < 10 THEN 'null' END) AS types FROM part")
def f13_spec_types(spark, sf):
    spec = F.concat_ws(" ", F.concat(F.lit("throws(Err"), "p_size", F.lit(")")), F.when(F.col("p_size") > 25, "is_pointer(p)"), F.when(F.col("p_size") < 10, "not null"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.spec_types(spec), ",").alias("types"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'bad_alloc,exception,pointer,size_t,throw expression' WHEN 1 THEN 'lambda capture,lambda expression' WHEN 2 THEN 'atomic,memory order,null' ELSE '' END AS refs FROM part""")
def f13_type_references(spark, sf):
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), F.col("p_size") % 4 + 1)
    refs = X.type_references(pick("void f(size_t n, T* p)", "", "", ""), pick("May throw BAD_ALLOC as an exception", "A lambda needs its capture", "An atomic has a memory order", "Nothing"), pick("", "", "not null", ""))
    return table(spark, sf, "part").select("p_partkey", F.array_join(refs, ",").alias("refs"))


@query(f"WITH c AS ({_CLAIMS}) SELECT claim_id, md5(concat_ws('|', CASE WHEN contains(l, 'can') THEN replace(l, 'can', 'cannot') END, CASE WHEN contains(l, 'will') THEN replace(l, 'will', 'will not') END, 'not ' || claim, 'undefined behavior ' || claim)) AS digest FROM (SELECT *, {LOW.format('claim')} AS l FROM c WHERE NOT regexp_matches(claim, '[^\\x00-\\x7F]')) WHERE NOT contains(l, 'valid') AND NOT contains(l, 'defined') AND NOT contains(l, 'is safe')")
def f14_negations(spark, sf):
    c = claims(spark, sf).where(~F.col("claim").rlike(r"[^\x00-\x7F]"))
    low = F.lower("claim")
    c = c.where(~X.has_any(low, ("valid", "defined", "is safe")))
    return c.select("claim_id", F.md5(F.array_join(X.negations(F.col("claim")), "|")).alias("digest"))


@query(f"""WITH c AS ({_CLAIMS}) SELECT claim_id, {_NEGATED} AS variants FROM (SELECT *, lower(claim) AS l FROM c)""")
def f14_all_negations(spark, sf):
    """F14 of every claim; ``f14_negations`` leaves out those that its SQL leaves out."""
    return claims(spark, sf).select("claim_id", X.negations(F.col("claim")).alias("variants"))


@query("SELECT item_id, concat_ws(',', CASE WHEN contains(l, 'th') THEN 'a' END, CASE WHEN contains(l, 'ing') OR contains(l, 'tion') THEN 'b' END) AS terms FROM (SELECT item_id, lower(text) AS l FROM benchmark)")
def f15_terms(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(X.terms(F.col("text"), {"a": ("th",), "b": ("ing", "tion")}), ",").alias("terms"))


@query("SELECT p_partkey, concat_ws(',', 'ctx' || p_size, CASE WHEN p_size > 25 THEN 'ILP_FOR' END) AS words FROM part")
def f16_keywords(spark, sf):
    text = F.concat_ws(" ", F.concat(F.lit("access to ctx"), "p_size"), F.when(F.col("p_size") > 25, "in ILP_FOR"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.keywords(text), ",").alias("words"))


_STEPS_SQL = "html"
for _a, _b in (*X.HTML_STEPS,):
    _STEPS_SQL = "regexp_replace({}, '{}', '{}', 'g')".format(_STEPS_SQL, _a.replace("'", "''"), _b.replace("$1", "\\1").replace("\n", "' || chr(10) || '"))
for _a, _b in X.ENTITIES:
    _STEPS_SQL = "replace({}, '{}', '{}')".format(_STEPS_SQL, _a, _b.replace("'", "''"))


@query(f"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace({_STEPS_SQL}, '\\n\\s*\\n\\s*\\n', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM pages")
def f17_html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(X.html_text(F.col("html"))).alias("digest"))


@query("SELECT page_id, length(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]+>', '', 'g')) > 0 AS has_text FROM pages")
def f18_html_events(spark, sf):
    from keelstone.functions.markup import html_event_text

    return table(spark, sf, "pages").select("page_id", (F.length(html_event_text(F.col("html"))) > 0).alias("has_text"))


@query("SELECT conv_id, turn, 'rule_' || turn AS link FROM conversations WHERE turn > 0")
def f19_json_links(spark, sf):
    said = F.concat(F.lit('Sure: ```json\n{"f": ["rule_'), "turn", F.lit('"], "n": 3}\n```'))
    c = table(spark, sf, "conversations").where("turn > 0").select("conv_id", "turn", F.explode(F.element_at(X.json_links(said), "f")).alias("link"))
    return c


@query("SELECT conv_id, turn, 'content ' || role AS content FROM conversations")
def f20_toml_records(spark, sf):
    c = table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("prompt_id"), F.concat(F.lit("```toml\n[[rules]]\ncontent = \"content "), "role", F.lit('"\n\n[[rules]]\nid = "no content"\n```')).alias("response"))
    out = extract.toml_records(c)
    return out.select(F.split("prompt_id", "/")[0].cast("long").alias("conv_id"), F.split("prompt_id", "/")[1].cast("long").alias("turn"), "content")


@query("SELECT conv_id, turn, 'c' || turn AS content FROM conversations")
def f21_json_records(spark, sf):
    said = F.concat(F.lit('Here: [{"content": "c'), "turn", F.lit('", "formal_spec": "s"}, {"formal_spec": "t"}] done'))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.explode(X.json_records(said)).alias("r")).select("conv_id", "turn", "r.content")


@query("SELECT doc_id, md5(array_to_string(string_split(text, chr(10))[2:3], chr(10))) AS digest FROM documents")
def f22_line_slice(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.line_slice(F.col("text"), F.lit(2), F.lit(3))).alias("digest"))


@query("""SELECT user_id, max((event_type = 'view')::INT) + 2 * max((event_type = 'click')::INT) + 2 * max((event_type = 'signup')::INT) + count(DISTINCT CASE WHEN event_type = 'purchase' THEN 'purchase' END) AS n FROM events GROUP BY 1""")
def f23_retrieval_queries(spark, sf):
    from keelstone.catalog.store import _ops

    ops = _ops(spark, sf).withColumn("function_called", F.when(F.col("op_type") == "function_call", F.col("function_called")))
    return extract.profiles(ops).select(F.col("fn").alias("user_id"), F.size("queries").cast("long").alias("n"))


@query("SELECT item_id, '- **rule_' || item_id || '**: ' || text AS line FROM benchmark")
def f24_formatter(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.format_string("- **rule_%d**: %s", "item_id", "text").alias("line"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'M' || p_size || '(a, b)' ELSE 'M' || p_size END AS signature FROM part")
def f25_macro_signature(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.macro_signature(F.concat(F.lit("M"), "p_size"), F.array(F.lit("a"), F.lit("b")), F.col("p_size") > 25).alias("signature"))


@query("SELECT p_partkey, p_size > 25 AS has_division, p_size % 2 = 0 AS has_pointer_ops, CASE WHEN p_size % 3 = 0 THEN 'call' ELSE '' END AS calls FROM part")
def f26_macro_features(spark, sf):
    body = F.concat_ws(" ", F.when(F.col("p_size") > 25, "a / b"), F.when(F.col("p_size") % 2 == 0, "*p"), F.when(F.col("p_size") % 3 == 0, "call(x) if(y)"))
    f = X.macro_features(body)
    return table(spark, sf, "part").select("p_partkey", f["has_division"].alias("has_division"), f["has_pointer_ops"].alias("has_pointer_ops"), F.array_join(f["function_calls"], ",").alias("calls"))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def f27_timestamps(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_format(F.to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), "yyyyMMdd_HHmmss").alias("stamp"))


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def f28_record_round_trip(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.to_json(F.struct("c_name", "c_nationkey")).alias("j"))
    return c.select("c_custkey", F.from_json("j", "c_name string, c_nationkey int").alias("r")).select("c_custkey", "r.c_name", "r.c_nationkey")


# -- reasoning -----------------------------------------------------------------------------


@query("SELECT doc_id, len(l) AS n, md5(array_to_string(l, '|')) AS digest FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 10) AS l FROM documents)")
def r12_claims(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.claims(F.col("text")).alias("l")).select("doc_id", F.size("l").cast("long").alias("n"), F.md5(F.array_join("l", "|")).alias("digest"))


@query(f"WITH c AS ({_CLAIMS}) SELECT claim_id, {_POL.format('lower(claim)')} AS polarity FROM c")
def r4_polarity(spark, sf):
    return claims(spark, sf).select("claim_id", X.polarity(F.col("claim"), POSITIVE, NEGATIVE).alias("polarity"))


@query(f"WITH c AS ({_CLAIMS}) SELECT claim_id, concat_ws(',', CASE WHEN contains(lower(claim), 'th') THEN 'th' END, CASE WHEN contains(lower(claim), 'er ') THEN 'er' END, CASE WHEN contains(lower(claim), 'en ') THEN 'en' END) AS topics FROM c")
def r5_topics(spark, sf):
    return claims(spark, sf).select("claim_id", F.array_join(X.topics(F.col("claim"), TOPICS, {}), ",").alias("topics"))


@query(f"SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'negative' WHEN {_POL.format('lower(text)')} = 'neutral' AND contains(lower(text), 'ti') THEN 'negative' ELSE {_POL.format('lower(text)')} END AS polarity FROM benchmark")
def r6_rule_polarity(spark, sf):
    module = F.when(F.col("item_id") % 4 == 0, "C-ERROR").otherwise("C-MAIN")
    return table(spark, sf, "benchmark").select("item_id", X.rule_polarity(F.col("text"), module, None, POSITIVE, NEGATIVE, ("ti",)).alias("polarity"))


@query(f"WITH {_HITS}, {_CLASSIFIED.format('hits')} SELECT claim_id, id, relationship, entailment::DOUBLE AS entailment FROM cl")
def r3_entailment(spark, sf):
    return reasoning.classify(hits(spark, sf), LEXICON).select("claim_id", "id", "relationship", "entailment")


@query(f"WITH {_HITS}, {_STEPS} SELECT claim_id, step, id, relationship, distance FROM cl")
def r1_proof_steps(spark, sf):
    return reasoning.chain_steps(hits(spark, sf), LEXICON).select("claim_id", F.col("step").cast("long").alias("step"), "id", "relationship", "distance")


@query(f"WITH {_HITS} SELECT claim_id, id, distance FROM hits WHERE rank <= 5")
def r2_supporting(spark, sf):
    return hits(spark, sf, 5).select("claim_id", "id", "distance")


@query(f"""WITH {_FORM_HITS} SELECT of_claim AS claim_id, id, distance, row_number() OVER (PARTITION BY of_claim ORDER BY form, rank) AS pos FROM (SELECT claim_id // 100 AS of_claim, claim_id % 100 AS form, id, distance, rank FROM hits WHERE rank <= 5
 QUALIFY row_number() OVER (PARTITION BY claim_id // 100, id, distance ORDER BY claim_id % 100, rank) = 1)""")
def r2_contradicting(spark, sf):
    """R2: every rule that a negated form of a claim finds."""
    return validation.contradicting_hits(claims(spark, sf), rules(spark, sf)).select("claim_id", "id", "distance", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {_HITS} SELECT DISTINCT claim, id, content, layer, distance FROM hits")
def r2_distinct_results(spark, sf):
    """U4: results of several queries, distinct as whole rows."""
    return hits(spark, sf).select("claim", "id", "content", "layer", "distance").dropDuplicates()


@query(f"""WITH rr AS (SELECT item_id % 7 AS fn, row_number() OVER (PARTITION BY item_id % 7 ORDER BY item_id) AS place, CASE WHEN item_id % 5 > 0 THEN left(text, 60) END AS signature, text AS content FROM benchmark),
 ff AS (SELECT fn, string_agg(content, ' ' ORDER BY place) AS content FROM rr WHERE place <= 3 GROUP BY 1), {_CANDIDATE_HITS}, u AS (SELECT claim_id // 100 AS fn, claim_id % 100 AS ord, id, rank FROM hits WHERE rank <= CASE WHEN claim_id % 100 = 4 THEN 20 ELSE 10 END QUALIFY row_number() OVER (PARTITION BY claim_id // 100, id ORDER BY claim_id % 100, rank) = 1)
 SELECT fn, id, row_number() OVER (PARTITION BY fn ORDER BY ord, rank) AS pos FROM u QUALIFY row_number() OVER (PARTITION BY fn ORDER BY ord, rank) <= 30""")
def v6_all_strategies(spark, sf):
    """V6: signatures, contents and concepts of every seventh item, among the trusted rules, at most 30 candidates."""
    i = F.col("item_id")
    place = F.row_number().over(Window.partitionBy(i % 7).orderBy(i))
    f = table(spark, sf, "benchmark").select((i % 7).alias("fn"), place.alias("place"), F.when(i % 5 > 0, F.substring("text", 1, 60)).alias("signature"), F.col("text").alias("content"))
    out = validation.candidate_foundations(validation.candidate_queries(f, concepts=CONCEPTS), rules(spark, sf).where("layer = 'c11_core'"))
    return out.select("fn", "id", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {_HITS} SELECT claim_id, id, 1 / (1 + distance) >= 0.4 AS passes, round(1 / (1 + distance), 6) AS similarity FROM hits")
def p8_threshold(spark, sf):
    return hits(spark, sf).select("claim_id", "id", X.passes(F.col("distance"), F.col("claim"), F.col("content")).alias("passes"), F.round(X.similarity(F.col("distance")), 6).alias("similarity"))


def _detected(spark, sf, h):
    return reasoning.detect(h, validation.term_searches(claims(spark, sf), rules(spark, sf), dangerous=DANGEROUS), LEXICON)


@query(f"WITH {_HITS}, {_DETECTED} SELECT claim_id, id, sure::DOUBLE AS sure FROM det")
def r7_contradictions(spark, sf):
    h = hits(spark, sf)
    return _detected(spark, sf, h).select("claim_id", "id", "sure")


@query(f"WITH c AS ({_CLAIMS}) SELECT claim_id, {_DANGEROUS} AS dangerous FROM c")
def r8_dangerous(spark, sf):
    return claims(spark, sf).select("claim_id", X.is_dangerous(F.col("claim"), DANGEROUS).alias("dangerous"))


def _validated(spark, sf):
    h = hits(spark, sf)
    steps = reasoning.chain_steps(h, LEXICON)
    against = reasoning.combined(steps, _detected(spark, sf, h))
    return reasoning.validate(claims(spark, sf), reasoning.chains(steps), against)


@query(f"WITH {_HITS}, {_STEPS}, {_DETECTED}, {_VALIDATED} SELECT * FROM val")
def r10_validate(spark, sf):
    return _validated(spark, sf)


@query(f"WITH {_HITS}, {_STEPS}, {_DETECTED}, {_VALIDATED} SELECT status, count(*) AS n FROM val GROUP BY 1")
def r9_status_counts(spark, sf):
    return _validated(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def rule_edges(spark, sf):
    """Each rule depends on two others."""
    b = table(spark, sf, "benchmark")
    i, n = F.col("item_id"), b.agg(F.count(F.lit(1)).alias("n")).scalar()
    return b.select(F.concat(F.lit("rule_"), i).alias("src"), F.explode(F.array((i * 7 + 1) % n, (i * 3 + 2) % n)).alias("dst")).select("src", F.concat(F.lit("rule_"), "dst").alias("dst")).distinct()


@query(f"WITH RECURSIVE {_HITS}, {_STEPS}, {_DETECTED}, {_VALIDATED}, {_FOUND} SELECT * EXCLUDE first_id FROM gval")
def r10_validate_grounded(spark, sf):
    """R10 with the foundations of first steps that are not grounded themselves."""
    out = validation.validate_claims(claims(spark, sf), rules(spark, sf), rule_edges(spark, sf), LEXICON, materialise)
    return out.drop("claim", "warnings")


@query(f"""WITH RECURSIVE {_HITS}, {_STEPS}, {_DETECTED}, {_VALIDATED}, {_FOUND} SELECT claim_id, status, CASE status WHEN 'INVALID' THEN 'INVALID: The claim contradicts formal semantics. The rule ' || chr(39) || id || chr(39) || ' states: ' || content || '. Contradiction type: ' || kind || '.'
 WHEN 'VALID' THEN 'VALID: The claim is grounded in formal semantics. The rule ' || chr(39) || id || chr(39) || ' states: ' || content WHEN 'LIKELY VALID' THEN 'LIKELY VALID: Found supporting rules but claim is not directly grounded.'
 ELSE 'UNCERTAIN: No contradictions found, but no supporting rules were found either. Exercise caution.' END AS explanation FROM (SELECT g.claim_id, status, coalesce(w.id, first_id) AS id, kind FROM gval g LEFT JOIN worst w USING (claim_id)) LEFT JOIN r USING (id)""")
def r9_explanations(spark, sf):
    out = validation.explain_claims(claims(spark, sf), rules(spark, sf), rule_edges(spark, sf), LEXICON, materialise)
    return out.select("claim_id", "status", "explanation")


@query(f"WITH {_HITS}, {_DETECTED} SELECT c.claim_id, coalesce(max(sure), 0) < 0.8 AS is_valid FROM c LEFT JOIN det USING (claim_id) GROUP BY 1")
def r11_quick_check(spark, sf):
    h = hits(spark, sf)
    return reasoning.quick_check(claims(spark, sf), _detected(spark, sf, h))


@query(f"WITH c AS ({_CLAIMS}) SELECT claim_id, concat_ws(',', CASE WHEN contains(lower(claim), 'th') THEN 'involves security-sensitive operations' END) AS warnings FROM c")
def r13_warnings(spark, sf):
    none = F.array().cast("array<string>")
    return claims(spark, sf).select("claim_id", F.array_join(X.warnings(F.col("claim"), none, ("th",)), ",").alias("warnings"))


# -- linking -------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, p_type AS signature FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def j9_signature_lookup(spark, sf):
    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return l.join(p, l["l_partkey"] == p["p_partkey"], "left").select("l_orderkey", "l_linenumber", F.col("p_type").alias("signature"))


@query("SELECT p.p_partkey AS id, s.s_suppkey AS dep_id FROM part p JOIN supplier s ON s.s_nationkey = p.p_size % 25 WHERE p.p_partkey % 25 <> s.s_nationkey AND s.s_suppkey <> p.p_partkey")
def j10_resolve_calls(spark, sf):
    """Parts call the function named by their size; suppliers are indexed by nation."""
    r = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 25).cast("string").alias("function"), F.array((F.col("p_size") % 25).cast("string")).alias("calls"))
    i = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("function"), F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("ord"))
    return linking.resolve_calls(r, i).select("id", "dep_id")


@query("SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def j12_index_merge(spark, sf):
    a, b = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.unionByName(b).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT item_id, item_id % 3 AS m, list_filter(['thnt', 'er', 'ing', 'on'], lambda p: contains(text, p)) AS p FROM benchmark) SELECT DISTINCT x.item_id AS id, y.item_id AS code FROM a x JOIN a y USING (m) WHERE len(list_intersect(x.p, y.p)) >= 2 OR len(list_intersect(x.p, y.p)) >= 1""")
def j13_related_errors(spark, sf):
    """A predicate is its own undone negation, so any shared one relates two rules."""
    b = table(spark, sf, "benchmark").select("item_id", (F.col("item_id") % 3).alias("module"), X.predicates(F.col("text"), ("thnt", "er", "ing", "on")).alias("preds"))
    return linking.related_errors(b.withColumnRenamed("item_id", "id"), b.withColumnRenamed("item_id", "code"))


@query("WITH a AS (SELECT item_id, list_filter(['th', 'ing', 'tion', 'ea'], lambda p: contains(lower(text), p)) AS p FROM benchmark) SELECT x.item_id AS a, y.item_id AS b, len(list_intersect(x.p, y.p)) AS shared FROM a x, a y WHERE len(list_intersect(x.p, y.p)) >= 2")
def j14_term_overlap(spark, sf):
    t = table(spark, sf, "benchmark").select("item_id", X.terms(F.col("text"), {w: (w,) for w in ("th", "ing", "tion", "ea")}).alias("terms"))
    return linking.overlapping_terms(t.withColumnRenamed("item_id", "a"), t.withColumnRenamed("item_id", "b"), "a", "b")


@query("SELECT p_brand AS code, count(DISTINCT p_partkey) AS n, md5(string_agg(DISTINCT p_partkey::VARCHAR, ',' ORDER BY p_partkey::VARCHAR)) AS ids FROM part GROUP BY 1")
def j15_reverse_links(spark, sf):
    g = table(spark, sf, "part").groupBy(F.col("p_brand").alias("code")).agg(F.sort_array(F.collect_set(F.col("p_partkey").cast("string"))).alias("l"))
    return g.select("code", F.size("l").cast("long").alias("n"), F.md5(F.array_join("l", ",")).alias("ids"))


@query("""WITH a AS (SELECT DISTINCT user_id AS cell, event_id % 40 AS fn, CASE event_type WHEN 'signup' THEN 'write' WHEN 'purchase' THEN 'remove' WHEN 'click' THEN 'modify' ELSE 'read' END AS access FROM events),
 p AS (SELECT x.fn AS opener, y.fn AS closer, x.cell, k.k FROM (VALUES ('write', 'remove', 0), ('write', 'modify', 1), ('modify', 'remove', 2)) k(a, b, k) JOIN a x ON x.access = k.a JOIN a y ON y.access = k.b AND x.cell = y.cell WHERE x.fn <> y.fn)
 SELECT opener, closer, k = 0 AS required, CASE k WHEN 0 THEN 1.0 ELSE 0.8 END::DOUBLE AS confidence, cell FROM p QUALIFY row_number() OVER (PARTITION BY opener, closer ORDER BY k, cell) = 1""")
def j16_cell_pairings(spark, sf):
    t = F.col("event_type")
    access = F.when(t == "signup", "write").when(t == "purchase", "remove").when(t == "click", "modify").otherwise("read")
    e = table(spark, sf, "events").select(F.col("event_id").alias("ord"), (F.col("event_id") % 40).alias("function"), F.col("user_id").alias("cell"), access.alias("access"))
    return linking.cell_pairings(e).select("opener", "closer", "required", "confidence", "cell")


@query("SELECT DISTINCT 'f' || s_suppkey || '_open' AS opener, 'f' || s_suppkey || '_close' AS closer FROM supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer) UNION SELECT DISTINCT 'f' || s_suppkey || '_init', 'f' || s_suppkey || '_free' FROM supplier WHERE s_nationkey < 12 AND s_nationkey > 5")
def j17_name_pairings(spark, sf):
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    name = lambda key, end: F.concat(F.lit("f"), F.col(key), F.lit(end)).alias("name")
    names = s.select(name("s_suppkey", "_open")).unionByName(c.select(name("c_custkey", "_close")))
    names = names.unionByName(s.where("s_nationkey < 12").select(name("s_suppkey", "_init"))).unionByName(s.where("s_nationkey > 5").select(name("s_suppkey", "_free")))
    return linking.name_pairings(names)


@query("SELECT * FROM (VALUES ('push_back', 'pop_back'), ('emplace_back', 'pop_back')) t(opener, closer)")
def j18_static_pairs(spark, sf):
    names = table(spark, sf, "region").select(F.element_at(F.array(*map(F.lit, ("push_back", "pop_back", "emplace_back", "push_front", "x"))), F.col("r_regionkey") + 1).alias("name"))
    return linking.static_pairings(names)


@query("WITH f AS (SELECT p_brand AS function, min(p_partkey) AS id FROM part GROUP BY 1), p AS (SELECT DISTINCT p_brand AS o, 'Brand#' || (11 + p_size % 5) AS c FROM part) SELECT DISTINCT a.id AS src, b.id AS dst FROM p JOIN f a ON a.function = o JOIN f b ON b.function = c")
def j19_placeholders(spark, sf):
    p = table(spark, sf, "part")
    pairs = p.select(F.concat(F.lit("rule_for_"), "p_brand").alias("opener"), F.concat(F.lit("rule_for_Brand#"), 11 + F.col("p_size") % 5).alias("closer")).distinct()
    index = p.select(F.col("p_brand").alias("function"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"))
    return linking.resolve_placeholders(pairs, index, "rule_for_")


@query(f"WITH {_HITS}, w AS (SELECT *, string_split({LOW.format('claim')}, ' ')[1] AS term FROM hits), g AS (SELECT * FROM w WHERE contains(lower(content), lower(term)) OR contains(id, lower(term)) QUALIFY row_number() OVER (PARTITION BY claim_id, term ORDER BY distance, id) <= 3) SELECT DISTINCT claim_id AS src, id FROM g")
def j20_residual_links(spark, sf):
    from keelstone.catalog._registry import ascii_lower

    h = hits(spark, sf).withColumn("term", F.split(ascii_lower(F.col("claim")), " ")[0])
    h = h.withColumns({"src": F.col("claim_id").cast("string"), "content": ascii_lower(F.col("content"))})
    return linking.residual_links(h, "term", "content").select(F.col("src").cast("long").alias("src"), "id")


@query("SELECT event_id, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_purchase FROM events")
def j21_forward_as_of(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    return table(spark, sf, "events").select("event_id", F.min(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(w).alias("next_purchase"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_signup FROM events")
def j22_backward_as_of(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf, "events").select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("last_signup"))


# -- extractors ----------------------------------------------------------------------------


def _source(spark, sf, body):
    """One source file per supplier."""
    return table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("path"), body.alias("content"))


def _fill(template: str, *columns: str):
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for p, c in zip(parts[1:], columns, strict=True):
        out += [F.col(c).cast("string"), F.lit(p)]
    return F.concat(*out)


def _function_source():
    return F.translate(_fill("int fn{}(int a, int *p) \x01\n  int q = a / 2;\n  if (q > 1) \x01\n    return g(p[0]);\n  \x02\n  return q;\n\x02\n", "s_suppkey"), "\x01\x02", "{}")


@query("SELECT 's' || s_suppkey AS path, unnest([0, 1]) AS ord, unnest([2, 6]) AS line_start FROM supplier")
def x1_rule_blocks(spark, sf):
    k = _fill("module LIBC-A{}\nrule fa{}(X) => X +Int 1\n  requires X >Int 0\n\n/*@ note */\nrule fb(Y) => Y [structural]\nendmodule\n", "s_suppkey", "s_suppkey")
    return extract.rule_blocks(_source(spark, sf, k)).select("path", "ord", "line_start")


@query("SELECT 's' || s_suppkey AS path, unnest(['precondition', 'effect', 'constraint']) AS rule_type, unnest(['fa' || s_suppkey, 'fb', 'fc']) AS function FROM supplier")
def x2_rules(spark, sf):
    k = _fill('module LIBC-A{}\nrule fa{}(X) => X\n  requires X >Int 0\n\nrule fb(Y) => Y\n\nrule fc(Z) => UNDEF("U1", "bad")\nendmodule\n', "s_suppkey", "s_suppkey")
    return extract.rules_from(extract.parsed_rules(extract.rule_blocks(_source(spark, sf, k)))).select("path", "rule_type", "function")


@query("SELECT 's' || s_suppkey AS path, 'X' || s_suppkey AS rhs FROM supplier")
def x3_right_sides(spark, sf):
    """Of rules with one id, the last one's right side."""
    k = _fill("module LIBC-A\nrule f(X) => Y{}\n  requires a{}\n\nrule f(X) => X{}\n  requires a{}\nendmodule\n", "s_suppkey", "s_suppkey", "s_suppkey", "s_suppkey")
    found = extract.rules_from(extract.parsed_rules(extract.rule_blocks(_source(spark, sf, k))))
    return first_per_key(found, ["id"], [F.desc("ord")]).select("path", "rhs")


@query("SELECT 'rule_for_open' || s_suppkey AS opener_id, 'rule_for_close' || s_suppkey AS closer_id, s_suppkey % 2 = 0 AS required FROM supplier")
def x4_annotations(spark, sf):
    c = F.concat(_fill("// @rule:pairs_with close{}\n// @rule:required ", "s_suppkey"), F.when(F.col("s_suppkey") % 2 == 0, "true").otherwise("false"), _fill("\nint open{}(void);\n\n// @rule:pairs_with x\n;;;\nint y(int z);\n", "s_suppkey"))
    return extract.annotated_pairs(extract.annotations(_source(spark, sf, c)))[0].select("opener_id", "closer_id", "required")


@query("SELECT 's' || s_suppkey AS path, unnest(['int f' || s_suppkey || '(int a, char* b)', 'void g(void)']) AS signature FROM supplier")
def x5_signatures(spark, sf):
    c = _fill("/* int no(int x); */\nint f{}(int a, char *b);\nvoid g(void);\n", "s_suppkey")
    out = extract.signatures(_source(spark, sf, c))
    return out.select("path", F.regexp_replace("signature", r"char \*b|char \* b", "char* b").alias("signature"))


@query("""SELECT 's' || s_suppkey AS path, op_type, n FROM supplier, (VALUES ('division', 0), ('variable_decl', 1), ('branch', 2), ('array_access', 3), ('function_call', 4), ('return', 5), ('return', 6)) k(op_type, n)""")
def x6_operations(spark, sf):
    return extract.operations(_source(spark, sf, _function_source())).select(F.col("file").alias("path"), "op_type", F.col("ord").alias("n"))


@query("SELECT 'fn' || s_suppkey AS fn, 7 AS n_ops, true AS has_division, true AS has_hazard, 'q > 1' AS guard FROM supplier")
def x7_profiles(spark, sf):
    ops = extract.operations(_source(spark, sf, _function_source()))
    guard = ops.where(F.size("guards") > 0).groupBy("fn").agg(F.max(F.col("guards")[0]).alias("guard"))
    return extract.profiles(ops).join(guard, "fn").select("fn", F.col("n_ops").cast("int").alias("n_ops"), "has_division", "has_hazard", "guard")


@query("SELECT 's' || s_suppkey AS path, unnest(['DIV' || s_suppkey || '(a, b)', 'LIMIT']) AS signature, unnest([true, false]) AS has_hazard FROM supplier")
def x8_macros(spark, sf):
    c = _fill("#define DIV{}(a, b) \\\n  ((a) / (b))\n#define LIMIT 7\nint x;\n", "s_suppkey")
    return extract.macros(_source(spark, sf, c)).select("path", "signature", "has_hazard")


@query("SELECT s_suppkey, 'Rules for ' || s_name || '.' AS prompt, '' AS response FROM supplier")
def x9_model_stage(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    return extract.model_stage(s, F.format_string("Rules for %s.", "s_name")).select("s_suppkey", "prompt", "response")


@query("SELECT l_orderkey, l_linenumber, p_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, p_name) AS item_no FROM lineitem JOIN part ON l_partkey = p_partkey")
def x10_review_items(spark, sf):
    from keelstone.operators.review import ordered

    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    rows = l.join(p, l["l_partkey"] == p["p_partkey"]).withColumn("f", F.lit(""))
    return ordered(rows, "f", "l_linenumber", "p_name", "l_partkey", "l_orderkey").select("l_orderkey", "l_linenumber", "p_name", F.col("item_no").cast("long").alias("item_no"))


@query("SELECT p_brand, 'a' || p_size AS link FROM part GROUP BY 1, 2")
def x11_link_stage(spark, sf):
    """Prompt, answer, parse, keep known ids, unite: with a model that names each size."""
    p = table(spark, sf, "part").select("p_brand", "p_size")
    stage = extract.model_stage(p, F.concat(F.lit("size "), "p_size"), lambda prompts: ['{"f": ["a' + x[5:] + '", "unknown"]}' for x in prompts])
    links = stage.select("p_brand", "p_size", F.explode(F.element_at(X.json_links(F.col("response")), "f")).alias("link"))
    known = p.select(F.concat(F.lit("a"), "p_size").alias("link")).distinct()
    return links.join(known, "link", "left_semi").select("p_brand", "link").distinct()


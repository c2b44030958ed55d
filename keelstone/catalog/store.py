"""Store, predicates, joins, aggregates and sets: S*, K*, P*, J1-J8, A*, U* on the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelstone.catalog._registry import query, table
from keelstone.functions import text as X
from keelstone.operators import graph, review, store
from keelstone.schemas import effective_confidence, grounded
from keelstone.sources import files
from keelstone.sources.toml import parse_rules, toml_record

# -- sources -------------------------------------------------------------------------------


@query("SELECT p_partkey::VARCHAR AS id, p_name AS content, p_type AS formal_spec, 'c11_core' AS layer, p_retailprice / 10000.0 AS confidence, p_brand AS function FROM part")
def s1_toml_round_trip(spark, sf):
    """Every part as a TOML record, read back."""
    from pyspark.sql.pandas.types import to_arrow_schema
    import pyarrow as pa

    from keelstone.schemas import RULE

    part = table(spark, sf, "part")
    cols = {"id": (F.col("p_partkey").cast("string"), ""), "content": (F.col("p_name"), ""), "formal_spec": (F.col("p_type"), ""), "confidence": (F.col("p_retailprice") / 10000.0, 1.0), "function": (F.col("p_brand"), "")}
    records = part.select(toml_record(cols).alias("record"))
    arrow = to_arrow_schema(RULE)

    def parse(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist(parse_rules("\n".join(batch.column(0).to_pylist())), schema=arrow)

    return records.mapInArrow(parse, RULE).select("id", "content", "formal_spec", "layer", "confidence", "function")


@query("SELECT c_mktsegment AS seg, count(*) AS n FROM (SELECT c_mktsegment FROM customer UNION ALL SELECT DISTINCT c_mktsegment FROM customer) GROUP BY 1")
def s2_union_scan(spark, sf):
    c = table(spark, sf, "customer").select("c_mktsegment")
    return c.unionByName(c.distinct(), allowMissingColumns=True).groupBy(F.col("c_mktsegment").alias("seg")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'UB-' || o_orderkey AS code, o_orderkey::VARCHAR AS internal_code, CASE o_orderstatus WHEN 'F' THEN 'constraint_violation' WHEN 'O' THEN 'unspecified' ELSE 'undefined_behavior' END AS type,
 trim(o_orderpriority) AS description, 2 AS n_refs FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'UB-' || o_orderkey, o_orderkey::VARCHAR, 'undefined_behavior', trim(o_orderpriority), 2 FROM orders WHERE o_orderstatus = 'P'""")
def s4_error_catalogue(spark, sf):
    o = table(spark, sf, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "Constraint Violation").when(F.col("o_orderstatus") == "O", "Unspecified").otherwise("other")
    raw = o.select(F.concat(F.lit("UB-"), F.col("o_orderkey")).alias("c0"), F.col("o_orderpriority").alias("c1"), F.concat_ws(", ", F.lit("6.5"), F.col("o_custkey").cast("string")).alias("c2"), kind.alias("c3"))
    junk = o.select(F.lit("Code").alias("c0"), F.lit("x").alias("c1"), F.lit("y").alias("c2"), F.lit(None).cast("string").alias("c3"))
    return files.error_catalogue(raw.unionByName(junk)).select("code", "internal_code", "type", "description", F.size("std_refs").alias("n_refs"))


@query("SELECT trim(text) AS pattern FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM benchmark) WHERE trim(text) <> '' AND NOT starts_with(trim(text), 'T')")
def s7_ignore_lines(spark, sf):
    lines = table(spark, sf, "benchmark").select(F.explode(F.split("text", "\n")).alias("value"))
    marked = lines.select(F.when(F.startswith(F.trim("value"), F.lit("T")), F.concat(F.lit("#"), "value")).otherwise(F.col("value")).alias("value"))
    return files.ignore_patterns(marked)


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def s9_last_wins(spark, sf):
    e = table(spark, sf, "events")
    return store.first_per_key(e.select("user_id", "event_id", "event_type"), ["user_id"], [F.desc("event_id")])


@query("SELECT page_id, CASE WHEN length(html) > 4000 THEN left(html, 4000) || '[cut]' ELSE html END AS section FROM pages")
def s10_sections(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "html")
    return files.page_sections(p, F.col("html"), 4000, "[cut]").select("page_id", "section")


@query("SELECT page_id, CASE WHEN length(html) > 40000 THEN left(html, 40000) || chr(10) || '[truncated]' ELSE html END AS section FROM pages")
def s10_full_sections(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "html")
    return files.page_sections(p, F.col("html")).select("page_id", "section")


@query("SELECT 0::BIGINT AS n")
def s11_missing_table(spark, sf):
    return files.table_or_empty(spark, "keelstone_no_such_table", "id string").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.ref') AS ref FROM events")
def s12_json_rows(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.ref").alias("ref"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def s13_point_lookup(spark, sf):
    return table(spark, sf, "customer").where(F.col("c_custkey") == 42).select("c_custkey", "c_name")


# -- sinks as transformations --------------------------------------------------------------


@query("""SELECT md5('[[rules]]' || chr(10) || 'id = ''''''' || s_suppkey || '''''''' || chr(10) || 'content = ''''''' || s_name || '''''''') AS digest, s_suppkey AS id FROM supplier""")
def k1_toml_record(spark, sf):
    s = table(spark, sf, "supplier")
    text = toml_record({"id": (F.col("s_suppkey").cast("string"), ""), "content": (F.col("s_name"), ""), "confidence": (F.lit(1.0), 1.0), "tags": (F.array().cast("array<string>"), [])})
    return s.select(F.md5(text).alias("digest"), F.col("s_suppkey").alias("id"))


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def k2_upsert(spark, sf):
    """Clicks and views are the old table, all events the new batch."""
    e = table(spark, sf, "events").select("user_id", "event_type", "value", "event_id")
    old = store.first_per_key(e.where(F.col("event_type").isin("click", "view")), ["user_id", "event_type"], ["event_id"])
    return store.upsert(old, e, ["user_id", "event_type"], ["event_id"])


@query("SELECT p_brand AS code, arg_max(p_type, p_partkey) AS type FROM part GROUP BY 1")
def k3_code_upsert(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("code"), F.col("p_type").alias("type"), F.col("p_partkey").alias("ord"))
    return store.upsert(p.limit(0), p, ["code"], ["ord"]).select("code", "type")


@query("SELECT 'vertices' AS label, count(*) AS n FROM part UNION ALL SELECT 'codes', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT p_partkey, p_brand FROM part)")
def k4_collection_load(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array("p_brand").alias("codes"), "p_brand")
    codes = p.select(F.col("p_brand").alias("code")).distinct()
    return store.counts_by_label({"vertices": p, "codes": codes, "edges": store.resolved_edges(p, "id", "codes", codes, "code")})


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 7 THEN 'RENAMED' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 99, 'NEW', 0")
def k5_single_upsert(spark, sf):
    n = table(spark, sf, "nation")
    one = spark.createDataFrame([(7, "RENAMED", None, 1), (99, "NEW", 0, 2)], "n_nationkey int, n_name string, n_regionkey int, ord int")
    one = one.join(n.select("n_nationkey", F.col("n_regionkey").alias("r")), "n_nationkey", "left").withColumn("n_regionkey", F.coalesce("n_regionkey", "r")).drop("r")
    return store.upsert(n, one, ["n_nationkey"], ["ord"]).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT DISTINCT o_custkey AS src, o_orderkey AS dst FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) AND o_orderkey IN (SELECT c_custkey FROM customer)")
def k6_pairing_upsert(spark, sf):
    e = table(spark, sf, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")).distinct()
    return store.endpoints_exist(e, table(spark, sf, "customer"), "c_custkey")


@query("SELECT DISTINCT n_regionkey AS src, n_nationkey AS dst FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def k7_idiom_participants(spark, sf):
    idioms = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list("n_nationkey").alias("participants"))
    return store.resolved_edges(idioms, "n_regionkey", "participants", table(spark, sf, "supplier"), "s_nationkey")


@query("SELECT count(*) AS n, count(DISTINCT vec_id) AS ids FROM (SELECT vec_id FROM embeddings UNION ALL SELECT vec_id FROM embeddings)")
def k8_vector_append(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id")
    return e.unionByName(e).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("ids"))


@query("SELECT item_id, CASE WHEN item_id = 3 THEN 'a,b' ELSE item_id::VARCHAR END AS deps FROM benchmark")
def k9_list_update(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.array(F.col("item_id").cast("string")).alias("deps"))
    return store.set_list(b, "item_id", 3, "deps", F.array(F.lit("a"), F.lit("b"))).select("item_id", F.array_join("deps", ",").alias("deps"))


@query("SELECT md5(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def k10_unique_violations(spark, sf):
    return store.repeated_keys(table(spark, sf, "documents").select(F.md5("text").alias("digest")), "digest")


@query("SELECT count(*) AS n FROM region WHERE false")
def k11_truncate(spark, sf):
    return table(spark, sf, "region").limit(0).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, count(*) AS n, md5(string_agg('{"turn":' || turn || ',"role":"' || role || '"}', ',' ORDER BY turn)) AS digest FROM conversations GROUP BY 1""")
def k12_session_json(spark, sf):
    c = table(spark, sf, "conversations")
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("items"))
    return g.select("conv_id", F.size("items").cast("long").alias("n"), F.md5(F.array_join(F.transform("items", lambda x: F.to_json(x)), ",")).alias("digest"))


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' UNION ALL SELECT conv_id, turn, upper(role) FROM conversations WHERE role = 'system'")
def k13_export_approved(spark, sf):
    c = table(spark, sf, "conversations").withColumn("decision", F.when(F.col("role") == "assistant", "approved").when(F.col("role") == "system", "modified").otherwise("pending"))
    return review.approved(c, F.col("text"), F.upper("role")).select("conv_id", "turn", F.col("exported").alias("text"))


@query("SELECT md5(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def k14_merge_append(spark, sf):
    """German documents are in the file already; of new ones the first of a text wins."""
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"), "lang")
    low = d.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min_by("lang", "doc_id").alias("lang"))
    old = low.where("lang = 'de'").select("digest", "doc_id")
    return store.append_new(old, d.select("digest", "doc_id"), ["digest"], ["doc_id"])


@query("SELECT count(*) FILTER (WHERE quality = 1) AS loaded, count(*) FILTER (WHERE quality <> 1) AS quarantined, 2 * count(*) FILTER (WHERE quality = 1) AS entries FROM labels")
def k15_load_counters(spark, sf):
    rows = table(spark, sf, "labels").withColumn("deps", F.array("quality", "toxic"))
    return store.load_counters(rows, "deps", F.col("quality") != 1)


# -- predicates ----------------------------------------------------------------------------


@query("SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def p1_module_filter(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).where("r_name = 'ASIA'").select("n_name")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def p2_equality(spark, sf):
    return table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_nationkey")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def p3_type_filter(spark, sf):
    return table(spark, sf, "events").where(F.col("event_type") == "error").select("event_id", "user_id")


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), (SELECT string_split(p_name, ' ')[1] FROM part WHERE p_partkey = 1))")
def p4_array_contains(spark, sf):
    p = table(spark, sf, "part")
    word = p.where("p_partkey = 1").select(F.split("p_name", " ")[0].alias("w"))
    return p.join(F.broadcast(word), F.array_contains(F.split("p_name", " "), F.col("w"))).select("p_partkey")


@query("SELECT count(*) AS n FROM customer WHERE c_name = 'O''Brien'")
def p5_literal(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("_p5")
    return spark.sql("SELECT count(*) AS n FROM _p5 WHERE c_name = :name", args={"name": "O'Brien"})


@query("SELECT c_custkey, c_name FROM customer WHERE contains(c_name, '12') OR contains(c_mktsegment, '12') OR contains(c_custkey::VARCHAR, '12') ORDER BY c_custkey LIMIT 50")
def p6_substring_or(spark, sf):
    c = table(spark, sf, "customer")
    hit = X.has_any(F.col("c_name"), ["12"]) | X.has_any(F.col("c_mktsegment"), ["12"]) | X.has_any(F.col("c_custkey").cast("string"), ["12"])
    return c.where(hit).orderBy("c_custkey").limit(50).select("c_custkey", "c_name")


@query("SELECT vec_id FROM embeddings WHERE label IN (1, 2, 5)")
def p7_in_set(spark, sf):
    return table(spark, sf, "embeddings").where(F.col("label").isin(1, 2, 5)).select("vec_id")


_OPS = "SELECT event_id, user_id AS fn, CASE event_type WHEN 'view' THEN 'division' WHEN 'click' THEN 'pointer_deref' WHEN 'signup' THEN 'new' WHEN 'purchase' THEN 'function_call' ELSE 'return' END AS op FROM events"


def _ops(spark, sf):
    """Events as operations of a function (the user)."""
    t = F.col("event_type")
    op = F.when(t == "view", "division").when(t == "click", "pointer_deref").when(t == "signup", "new").when(t == "purchase", "function_call").otherwise("return")
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("fn"), op.alias("op_type"), F.col("event_type").alias("function_called"), F.col("event_id").alias("ord"), F.lit("f").alias("file"))


@query(f"SELECT fn, bool_or(op IN ('division', 'modulo') OR op IN ('pointer_deref', 'array_access', 'arrow_access') OR op IN ('new', 'delete') OR op = 'function_call') AS hazard FROM ({_OPS}) GROUP BY 1")
def p9_hazard(spark, sf):
    from keelstone.operators.extract import profiles

    ops = _ops(spark, sf).withColumn("function_called", F.when(F.col("op_type") == "function_call", F.col("function_called")))
    return profiles(ops).select("fn", F.col("has_hazard").alias("hazard"))


@query("SELECT p_partkey, (regexp_matches(b, '[^/]/[^/*]|%') OR regexp_matches(b, '\\*[a-zA-Z_]|&[a-zA-Z_]') OR regexp_matches(b, '\\([a-zA-Z_][a-zA-Z_0-9]*\\s*\\*?\\s*\\)') OR regexp_matches(b, '(^|[^a-zA-Z_0-9])[a-z_][a-zA-Z_0-9]*\\s*\\(')) AS hazard FROM (SELECT p_partkey, CASE WHEN p_size > 40 THEN 'x / ' || p_size WHEN p_size > 30 THEN '(' || lower(p_brand) || ')' WHEN p_size > 20 THEN 'call(' || p_size || ')' ELSE p_name END AS b FROM part)")
def p10_macro_hazard(spark, sf):
    size = F.col("p_size")
    body = F.when(size > 40, F.concat(F.lit("x / "), size)).when(size > 30, F.concat(F.lit("("), F.lower("p_brand"), F.lit(")"))).when(size > 20, F.concat(F.lit("call("), size, F.lit(")"))).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", X.macro_hazard(X.macro_features(body)).alias("hazard"))


@query(f"SELECT event_id, op FROM ({_OPS}) WHERE op IN ('division', 'new')")
def p11_operations_by_kind(spark, sf):
    return _ops(spark, sf).where(F.col("op_type").isin("division", "new")).select("event_id", F.col("op_type").alias("op"))


@query("SELECT event_id, event_type FROM events WHERE event_id = (SELECT min(event_id) FROM events WHERE user_id = 5)")
def p12_first_by_id(spark, sf):
    return table(spark, sf, "events").where("user_id = 5").orderBy("event_id").limit(1).select("event_id", "event_type")


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '://[^/?#]*/([^?#]*)', 1) AS path FROM pages)
SELECT page_id, (regexp_matches(path, '^(en)/') OR regexp_matches(path, '^de/.*5$') OR len(list_filter(string_split(path, '/'), lambda x: regexp_matches(x, '^[^/]*\\.html$'))) > 0) AS ignored FROM p""")
def p13_glob_filter(spark, sf):
    path = F.regexp_extract("url", r"://[^/?#]*/([^?#]*)", 1)
    return table(spark, sf, "pages").select("page_id", X.ignored(path, ["en/", "de/*5", "*.html"]).alias("ignored"))


@query("SELECT conv_id, turn FROM conversations WHERE trim(text) <> ''")
def p14_not_blank(spark, sf):
    return table(spark, sf, "conversations").where(X.strip(F.col("text")) != "").select("conv_id", "turn")


@query("SELECT c_custkey FROM customer WHERE starts_with(c_mktsegment, 'AUTO') OR c_nationkey IN (1, 2) OR contains(c_name, '77')")
def p15_library_predicate(spark, sf):
    hit = F.startswith("c_mktsegment", F.lit("AUTO")) | F.col("c_nationkey").isin(1, 2) | F.contains("c_name", F.lit("77"))
    return table(spark, sf, "customer").where(hit).select("c_custkey")


@query("SELECT conv_id, turn, CASE role WHEN 'assistant' THEN text ELSE 'edited: ' || text END AS rule, true AS reviewed FROM conversations WHERE role IN ('assistant', 'system')")
def p16_approved(spark, sf):
    c = table(spark, sf, "conversations").withColumn("decision", F.when(F.col("role") == "assistant", "approved").when(F.col("role") == "system", "modified").otherwise("rejected"))
    return review.approved(c, F.col("text"), F.concat(F.lit("edited: "), "text")).select("conv_id", "turn", F.col("exported").alias("rule"), "reviewed")


@query("SELECT item_id::VARCHAR AS id, text AS content, length(text)::BIGINT AS chars FROM benchmark")
def p17_api_projection(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("content"), F.length("text").cast("long").alias("chars"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_brand END, '') AS function, coalesce(p_type, '') AS header FROM part")
def p18_vector_record(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.coalesce(F.when(F.col("p_size") > 25, F.col("p_brand")), F.lit("")).alias("function"), F.coalesce("p_type", F.lit("")).alias("header"))


_LAYER = "CASE label WHEN 0 THEN 'c11_core' WHEN 1 THEN 'c11_stdlib' WHEN 2 THEN 'cpp20_language' WHEN 3 THEN 'cpp20_stdlib' ELSE 'library' END"


def _layer(label):
    return F.when(label == 0, "c11_core").when(label == 1, "c11_stdlib").when(label == 2, "cpp20_language").when(label == 3, "cpp20_stdlib").otherwise("library")


@query(f"SELECT vec_id, round(CASE WHEN label < 4 THEN 0.95 WHEN label < 7 THEN 0.9 * 0.95 ELSE 0.7 * 0.95 END::DOUBLE, 6) AS confidence, {_LAYER} AS layer FROM embeddings")
def p19_effective_confidence(spark, sf):
    label = F.col("label")
    return table(spark, sf, "embeddings").select("vec_id", F.round(effective_confidence(_layer(label), F.lit(0.95), label < 7), 6).alias("confidence"), _layer(label).alias("layer"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def p20_closed_validation(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").where("c_acctbal > 0")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left_semi").select("o_orderkey", "o_custkey")


# -- edges and neighbours ------------------------------------------------------------------


def _order_lists(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.array(F.col("o_custkey"), F.lit(-1).cast("long"), -F.col("o_custkey")).alias("deps"))


@query("SELECT DISTINCT o_orderkey AS src, o_custkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey")
def j1_depends_on(spark, sf):
    return store.resolved_edges(_order_lists(spark, sf), "o_orderkey", "deps", table(spark, sf, "customer"), "c_custkey")


@query("SELECT DISTINCT l_orderkey AS src, p_brand AS dst FROM lineitem JOIN part ON l_partkey = p_partkey")
def j2_violated_by(spark, sf):
    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    rows = l.join(p, l["l_partkey"] == p["p_partkey"]).select("l_orderkey", F.array("p_brand", F.lit("no-code")).alias("codes"))
    return store.resolved_edges(rows, "l_orderkey", "codes", p, "p_brand")


@query("SELECT DISTINCT r_regionkey AS src, n_nationkey AS dst FROM region JOIN nation ON r_regionkey = n_regionkey")
def j3_participates_in(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    lists = r.join(n, r["r_regionkey"] == n["n_regionkey"]).groupBy("r_regionkey").agg(F.collect_list("n_nationkey").alias("ids"))
    return store.resolved_edges(lists, "r_regionkey", "ids", n, "n_nationkey")


@query("SELECT c_custkey AS at, n_nationkey AS other, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j4_neighbours(spark, sf):
    edges = table(spark, sf, "customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("dst"))
    return store.neighbours(edges, table(spark, sf, "nation"), "n_nationkey").select("at", "other", "n_name")


_TRADE = "SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"


def _trade(spark, sf):
    """Edges from a supplier's nation to a customer's nation."""
    l, o, c, s = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier"))
    rows = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == c["c_custkey"]).join(s, F.col("l_suppkey") == s["s_suppkey"])
    return rows.select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).distinct()


@query(f"WITH e AS ({_TRADE}) SELECT \"at\", other, n_name FROM (SELECT src AS \"at\", dst AS other FROM e UNION ALL SELECT dst, src FROM e) JOIN nation ON other = n_nationkey")
def j5_undirected(spark, sf):
    return store.neighbours(_trade(spark, sf), table(spark, sf, "nation"), "n_nationkey", "both").select("at", "other", "n_name")


@query("SELECT o_orderkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j6_label_joins(spark, sf):
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("o_orderkey", "n_name", "r_name")


@query("SELECT DISTINCT d AS dst FROM (SELECT -1 AS d UNION ALL SELECT -o_custkey FROM orders UNION ALL SELECT o_custkey FROM orders) WHERE d NOT IN (SELECT c_custkey FROM customer)")
def j7_dangling(spark, sf):
    return store.dangling(_order_lists(spark, sf), "o_orderkey", "deps", table(spark, sf, "customer"), "c_custkey")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j8_ungrounded(spark, sf):
    edges = table(spark, sf, "labels").select(F.col("doc_id").alias("src"), F.col("quality").alias("dst"))
    return store.without_edges(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", edges)


# -- aggregates ----------------------------------------------------------------------------


@query("SELECT 'customer' AS label, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'events', count(*) FROM events")
def a1_counts_by_label(spark, sf):
    return store.counts_by_label({t: table(spark, sf, t) for t in ("customer", "orders", "nation", "events")})


@query("SELECT count(*) AS n FROM embeddings")
def a2_row_count(spark, sf):
    return table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(nullif(CASE WHEN p_size > 45 THEN '' ELSE p_brand END, ''), 'ungrouped') AS grp, count(*) AS n, md5(string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey)) AS ids FROM part GROUP BY 1")
def a3_group_by_function(spark, sf):
    name = F.when(F.col("p_size") > 45, "").otherwise(F.col("p_brand"))
    g = table(spark, sf, "part").groupBy(F.coalesce(F.nullif(name, F.lit("")), F.lit("ungrouped")).alias("grp")).agg(F.sort_array(F.collect_list("p_partkey")).alias("l"))
    return g.select("grp", F.size("l").cast("long").alias("n"), F.md5(F.array_join(F.transform("l", lambda x: x.cast("string")), ",")).alias("ids"))


@query("SELECT p_type AS function, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY 1")
def a4_function_index(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("function")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_id"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type || ':' || n, ' ' ORDER BY event_type) AS histogram, bool_or(event_type = 'error') AS has_error FROM c GROUP BY 1")
def a5_histogram(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    g = c.groupBy("user_id").agg(F.sort_array(F.collect_list(F.concat_ws(":", "event_type", "n"))).alias("h"), F.max(F.col("event_type") == "error").alias("has_error"))
    return g.select("user_id", F.array_join("h", " ").alias("histogram"), "has_error")


@query("SELECT p_brand, string_agg(DISTINCT w, ' ' ORDER BY w) AS words FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def a6_operand_set(spark, sf):
    w = table(spark, sf, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("w"))
    return w.groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("w")), " ").alias("words"))


@query("""SELECT conv_id, count(*) AS total, count(*) FILTER (WHERE role <> 'user') AS reviewed, count(*) FILTER (WHERE role = 'assistant') AS approved,
 count(*) FILTER (WHERE role <> 'user') = count(*) AS complete FROM conversations GROUP BY 1""")
def a7_review_counts(spark, sf):
    d = F.when(F.col("role") == "user", "pending").when(F.col("role") == "assistant", "approved").otherwise("rejected")
    return review.session_totals(table(spark, sf, "conversations").withColumn("decision", d), "conv_id").select("conv_id", "total", "reviewed", "approved", "complete")


@query("SELECT conv_id, count(*) AS total FROM conversations GROUP BY 1 ORDER BY total DESC, conv_id")
def a8_session_list(spark, sf):
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("total"))
    return t.orderBy(F.desc("total"), "conv_id")


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 15")
def a9_top_types(spark, sf):
    return store.histogram(table(spark, sf, "part"), ["p_type"], 15)


@query("SELECT lang, count(*) AS n, count(quality) AS labelled, (100 * count(quality)) // count(*) AS percent FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def a10_coverage(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("labelled")).withColumn("percent", F.floor(100 * F.col("labelled") / F.col("n")))


@query("SELECT l_orderkey, min(l_discount) AS least FROM lineitem GROUP BY 1")
def a11_least_confidence(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_discount").alias("least"))


@query("SELECT l_orderkey, round(1 - max(l_discount), 6) AS confidence FROM lineitem GROUP BY 1")
def a12_contradiction_confidence(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(1 - F.max("l_discount"), 6).alias("confidence"))


@query(f"SELECT {_LAYER} AS layer, count(*) AS n, bool_and(label < 4) AS grounded FROM embeddings GROUP BY 1")
def a13_count_per_layer(spark, sf):
    e = table(spark, sf, "embeddings").select(_layer(F.col("label")).alias("layer"))
    return store.histogram(e, ["layer"]).withColumn("grounded", grounded(F.col("layer")))


# -- order and sets ------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_linenumber, l_linestatus, l_linenumber) AS item_no FROM lineitem")
def o1_item_order(spark, sf):
    l = table(spark, sf, "lineitem")
    return review.ordered(l, "l_returnflag", "l_linenumber", "l_linestatus", "l_linenumber", "l_orderkey").select("l_orderkey", "l_linenumber", F.col("item_no").cast("long").alias("item_no"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def o2_limit(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("""SELECT conv_id, turn, lag(turn) OVER w AS previous, lead(turn) OVER w AS next,
 coalesce(min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id)) AS next_pending
 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def o6_cursor(spark, sf):
    d = F.when(F.col("role") == "user", "pending").otherwise("approved")
    return review.cursor(table(spark, sf, "conversations").withColumn("decision", d), "conv_id", "turn").select("conv_id", "turn", "previous", "next", "next_pending")


@query("SELECT kind, count(*) AS n FROM (SELECT 'c' AS kind FROM customer UNION ALL SELECT 's' FROM supplier) GROUP BY 1")
def u1_union_all(spark, sf):
    c, s = table(spark, sf, "customer").select(F.lit("c").alias("kind")), table(spark, sf, "supplier").select(F.lit("s").alias("kind"))
    return c.unionByName(s).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY 1")
def u2_first_wins(spark, sf):
    return store.first_per_key(table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id"], ["event_id"])


@query("SELECT l_orderkey, l_suppkey, l_quantity, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_quantity DESC, l_linenumber) = 1")
def u3_highest_confidence(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_linenumber")
    return store.best_per_key(l, ["l_orderkey", "l_suppkey"], "l_quantity", "l_linenumber")


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_tax FROM lineitem")
def u4_whole_row(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_tax").dropDuplicates()


@query("SELECT c_nationkey AS k, 'customer' AS origin FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, 'supplier' FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer) GROUP BY 1")
def u5_left_precedence(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("origin")).distinct()
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("origin")).distinct()
    return store.append_new(a, b, ["k"])


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY 1")
def u6_list_union(spark, sf):
    """Two lists of each user united."""
    e = table(spark, sf, "events").select("user_id", "event_type", "value")
    g = e.groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 50, F.col("event_type"))).alias("a"), F.collect_set(F.when(~(F.col("value") > 50) | F.col("value").isNull(), F.col("event_type"))).alias("b"))
    return g.select("user_id", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("types"))


_WORDS_SQL = "list_distinct(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' '))"


@query(f"WITH b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark) SELECT x.item_id AS a, y.item_id AS b, len(list_intersect(x.w, y.w)) AS shared FROM b x JOIN b y ON x.item_id < y.item_id WHERE len(list_intersect(x.w, y.w)) >= 4")
def u7_overlap(spark, sf):
    from keelstone.catalog._registry import ascii_lower
    from keelstone.operators.linking import overlapping_terms

    b = table(spark, sf, "benchmark").select("item_id", F.split(ascii_lower(F.col("text")), " ").alias("terms"))
    out = overlapping_terms(b.withColumnRenamed("item_id", "a"), b.withColumnRenamed("item_id", "b"), "a", "b", 4)
    return out.where("a < b").select("a", "b", "shared")


@query("SELECT user_id, count(*) FILTER (WHERE event_type <> 'view' AND event_type <> 'click') AS n FROM events GROUP BY 1")
def u8_difference(spark, sf):
    """What is left of each user's list without two kinds, repeats kept."""
    g = table(spark, sf, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("l"))
    return g.select("user_id", F.size(F.filter("l", lambda x: ~x.isin("view", "click"))).cast("long").alias("n"))


@query(f"WITH e AS ({_TRADE}) SELECT src, dst FROM e WHERE src < dst AND EXISTS (SELECT 1 FROM e r WHERE r.src = e.dst AND r.dst = e.src)")
def g4_two_cycles(spark, sf):
    return graph.two_cycles(_trade(spark, sf))


@query("SELECT event_id, lag(event_id) OVER w AS predecessor, lead(event_id) OVER w AS successor FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def g5_chain(spark, sf):
    return graph.chained(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_id").select("event_id", "predecessor", "successor")

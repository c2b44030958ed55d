"""Vector search and graph traversal: V*, G*, O3 on the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelstone.catalog._registry import LOW, query, table
from keelstone.functions import text as X
from keelstone.operators import graph, linking, vectors
from keelstone.operators.store import first_per_key
from keelstone.plans.state import materialise

_DIST = "round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2, 6)"
_KNN = f"SELECT a.vec_id AS query_id, b.vec_id AS id, b.label, {_DIST} AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DIST}, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def _all_knn(spark, sf, k, base=None):
    e = _vectors(spark, sf)
    return vectors.knn(e, e if base is None else base, k, "id", "v", skip_self=True)


def nearest_to(spark, sf, vec_id, k=10):
    """V1: the nearest rows to one stored vector; the vector is a scalar subquery, the rest a top-k."""
    e = _vectors(spark, sf)
    query = e.where(F.col("id") == vec_id).select("v").limit(1).scalar()
    near = e.where(F.col("id") != vec_id).withColumn("q", query).withColumn("distance", F.round(vectors.distance(F.col("v"), F.col("q")), 6))
    return near.select("id", "label", "distance").orderBy("distance", "id").limit(k)


@query(f"""SELECT b.item_id, k::BIGINT AS bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY b.item_id)), 6) AS weight FROM
 (SELECT item_id, ('0x' || left(md5(w), 8))::UBIGINT % 64 AS k, count(*)::DOUBLE AS n FROM (SELECT item_id, unnest(regexp_extract_all({LOW.format("text")}, '[a-z0-9]+')) AS w FROM benchmark) GROUP BY 1, 2) b""")
def v0_encode(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", vectors.encode(F.col("text")).alias("v"))
    return b.select("item_id", F.posexplode("v").alias("bucket", "w")).where("w <> 0").select("item_id", F.col("bucket").cast("long").alias("bucket"), F.round("w", 6).alias("weight"))


@query(f"SELECT b.vec_id AS id, b.label, {_DIST} AS distance FROM embeddings a, embeddings b WHERE a.vec_id = 3 AND b.vec_id <> 3 ORDER BY distance, id LIMIT 10")
def v1_knn_topk(spark, sf):
    return nearest_to(spark, sf, 3)


@query(f"SELECT query_id, id, distance, rank FROM ({_KNN}) WHERE rank <= 5")
def v2_knn_batch(spark, sf):
    return _all_knn(spark, sf, 5).select("query_id", "id", "distance", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM ({_KNN}) WHERE rank <= 30 AND label IN (0, 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 3")
def v3_over_fetch(spark, sf):
    hits = _all_knn(spark, sf, 30).join(_vectors(spark, sf).select("id", "label"), "id")
    return vectors.over_fetch(hits, F.col("label").isin(0, 1, 2), 3).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM ({_KNN}) WHERE label IN (0, 1, 2)) WHERE rank <= 3")
def v3_filter_first(spark, sf):
    return _all_knn(spark, sf, 3, _vectors(spark, sf).where(F.col("label").isin(0, 1, 2))).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH h AS (SELECT query_id, 1 / (1 + distance) AS s FROM ({_KNN}) WHERE rank <= 10), g AS (SELECT query_id, count(*) FILTER (WHERE s >= 0.7) AS same, count(*) FILTER (WHERE s >= 0.45 AND s < 0.7) AS alike FROM h GROUP BY 1)
 SELECT query_id, CASE WHEN same > 0 THEN 'duplicate' WHEN alike > 0 THEN 'similar' ELSE 'unique' END AS verdict, same AS duplicates, CASE WHEN same > 0 THEN 0 ELSE alike END AS similar FROM g""")
def v4_near_duplicates(spark, sf):
    return vectors.near_duplicates(_all_knn(spark, sf, 10), 0.7, 0.45)


@query(f"""WITH h AS (SELECT query_id, rank, id, label FROM ({_KNN}) WHERE rank <= 3),
 p AS (SELECT a.vec_id AS at, b.other FROM embeddings a JOIN (SELECT label, min(vec_id) AS other FROM embeddings GROUP BY 1) b ON b.label = (a.label + 1) % 10),
 o AS (SELECT h.query_id, h.rank, p.other AS id, h.id::VARCHAR AS via FROM h JOIN p ON p.at = h.id WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.query_id = h.query_id AND x.id = p.other) QUALIFY row_number() OVER (PARTITION BY h.query_id, p.other ORDER BY h.rank) = 1),
 e AS (SELECT query_id, rank, 0 AS step, 'hit' AS kind, id, NULL::VARCHAR AS via FROM h UNION ALL SELECT query_id, rank, 1, 'pair', id, via FROM o UNION ALL SELECT query_id, rank, 2, 'idiom', label, id::VARCHAR FROM h)
 SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, step, id) AS pos, kind, id, via FROM e""")
def v5_pair_expansion(spark, sf):
    e = _vectors(spark, sf)
    hits = _all_knn(spark, sf, 3)
    first = e.groupBy("label").agg(F.min("id").alias("other"))
    pairs = e.select(F.col("id").alias("at"), ((F.col("label") + 1) % 10).alias("label")).join(first, "label").select("at", "other")
    out = vectors.expand_pairs(hits, pairs, e.select(F.col("id").alias("at"), F.col("label").alias("idiom")))
    return out.withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH q AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings), h AS (SELECT q.label AS fn, q.n AS strategy, k.rank, k.id FROM q JOIN ({_KNN}) k ON k.query_id = q.vec_id WHERE q.n <= 3 AND k.rank <= 10),
 u AS (SELECT *, row_number() OVER (PARTITION BY fn, id ORDER BY strategy, rank) AS first FROM h) SELECT fn, id, row_number() OVER (PARTITION BY fn ORDER BY strategy, rank) AS pos FROM u WHERE first = 1 QUALIFY row_number() OVER (PARTITION BY fn ORDER BY strategy, rank) <= 20""")
def v6_multi_strategy(spark, sf):
    """Three queries for each label, united, at most 20 candidates."""
    e = _vectors(spark, sf)
    n = Window.partitionBy("label").orderBy("id")
    asked = e.withColumn("strategy", F.row_number().over(n)).where("strategy <= 3")
    hits = vectors.knn(asked, e, 10, "id", "v", skip_self=True).join(asked.select(F.col("id").alias("query_id"), F.col("label").alias("fn"), "strategy"), "query_id")
    united = first_per_key(hits, ["fn", "id"], ["strategy", "rank"])
    pos = Window.partitionBy("fn").orderBy("strategy", "rank")
    return united.withColumn("pos", F.row_number().over(pos)).where("pos <= 20").select("fn", "id", F.col("pos").cast("long").alias("pos"))


def _flagged(spark, sf):
    """Candidates of every vector with flags made from labels; five query forms each."""
    e = _vectors(spark, sf)
    hits = _all_knn(spark, sf, 10).join(e.select("id", F.col("label").alias("dst_label")), "id").join(e.select(F.col("id").alias("query_id"), F.col("label").alias("src_label")), "query_id")
    layer = F.when(F.col("dst_label") < 4, "c11_core").otherwise("library")
    content = F.when(F.col("dst_label") % 2 == 0, F.concat(F.lit("provides key"), F.col("dst_label"))).otherwise(F.lit("plain text"))
    source = F.when(F.col("src_label") % 2 == 1, "requires x").otherwise("other")
    rows = hits.withColumns({"layer": layer, "content": content, "source_content": source, "keyword": F.concat(F.lit("key"), "src_label"), "ord": F.col("rank")})
    return linking.candidate_flags(rows).withColumn("other_function", F.col("src_label") != F.col("dst_label"))


_FLAGS = f"""SELECT k.query_id, k.id, k.rank, s.label AS sl, k.label AS dl, k.label < 4 AS f, k.label % 2 = 0 AS p, k.label % 2 = 0 AND contains('key' || k.label, 'key' || s.label) AS kw, k.label % 2 = 0 AND s.label % 2 = 1 AS c
 FROM ({_KNN}) k JOIN embeddings s ON s.vec_id = k.query_id WHERE k.rank <= 10"""


@query(f"SELECT query_id, id, f AS is_foundation, p AS is_provider, kw AS has_keyword, c AS complements FROM ({_FLAGS}) WHERE f OR p OR kw")
def v7_candidate_flags(spark, sf):
    return _flagged(spark, sf).select("query_id", "id", "is_foundation", "is_provider", "has_keyword", "complements")


@query(f"SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS pos FROM (SELECT *, 2 * f::INT + 4 * p::INT + 3 * kw::INT + 5 * c::INT + (sl <> dl)::INT AS score FROM ({_FLAGS}) WHERE f OR p OR kw) WHERE score > 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) <= 3")
def o4_scored_top3(spark, sf):
    out = linking.top_links(_flagged(spark, sf).drop("rank"), "query_id")
    return out.select("query_id", "id", "score", F.col("rank").cast("long").alias("pos"))


@query(f"SELECT id, query_id FROM ({_FLAGS}) WHERE f OR p OR kw QUALIFY row_number() OVER (PARTITION BY id ORDER BY p DESC, c DESC, rank, query_id) = 1")
def o5_best_candidate(spark, sf):
    rows = _flagged(spark, sf).withColumn("ord", F.struct("rank", "query_id"))
    return linking.best_candidates(rows, ["id"]).select("id", "query_id")


@query(f"SELECT a.label AS category, count(DISTINCT k.id) AS n, min(k.id) AS first_id FROM (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY 1) a JOIN ({_KNN}) k ON k.query_id = a.vec_id WHERE k.rank <= 8 GROUP BY 1")
def v8_categories(spark, sf):
    e = _vectors(spark, sf)
    asked = first_per_key(e, ["label"], ["id"])
    hits = vectors.knn(asked, e, 8, "id", "v", skip_self=True).join(asked.select(F.col("id").alias("query_id"), F.col("label").alias("category")), "query_id")
    return hits.groupBy("category").agg(F.countDistinct("id").alias("n"), F.min("id").alias("first_id"))


@query(f"SELECT b.vec_id AS id, {_DIST} AS distance FROM embeddings a, embeddings b WHERE a.vec_id = 11 AND b.vec_id <> 11 ORDER BY distance, id LIMIT 15")
def v9_section_search(spark, sf):
    return nearest_to(spark, sf, 11, 15).select("id", "distance")


@query("""SELECT p_partkey, p_name || CASE WHEN p_brand <> '' THEN '. Function: ' || p_brand ELSE '' END || CASE WHEN p_size > 25 THEN '. Type: ' || p_type ELSE '' END || '. Module: ' || p_brand || '. Tags: ' || replace(p_name, ' ', ', ') AS text FROM part""")
def v10_embedding_text(spark, sf):
    p = table(spark, sf, "part")
    text = X.embedding_text(F.col("p_name"), F.col("p_brand"), function=F.col("p_brand"), rule_type=F.when(F.col("p_size") > 25, F.col("p_type")), header=F.lit(""), tags=F.split("p_name", " "))
    return p.select("p_partkey", text.alias("text"))


@query("SELECT vec_id AS id, label FROM embeddings WHERE label >= 4")
def v11_filter_scan(spark, sf):
    """A search that only served as a scan, as a scan."""
    return _vectors(spark, sf).where("label >= 4").select("id", "label")


# -- graph ---------------------------------------------------------------------------------

_EDGES = "SELECT vec_id AS src, (vec_id * 7 + 1) % (SELECT count(*) FROM embeddings) AS dst FROM embeddings UNION SELECT vec_id, (vec_id * 3 + 2) % (SELECT count(*) FROM embeddings) FROM embeddings"


def _edges(spark, sf):
    e = table(spark, sf, "embeddings")
    i, n = F.col("vec_id"), e.agg(F.count(F.lit(1)).alias("n")).scalar()
    return e.select(i.alias("src"), F.explode(F.array((i * 7 + 1) % n, (i * 3 + 2) % n)).alias("dst")).distinct()


_PATHS = f"""WITH RECURSIVE e AS ({_EDGES}), p(start, node, path, depth) AS (SELECT vec_id, vec_id, [vec_id], 0 FROM embeddings UNION ALL
 SELECT p.start, e.dst, list_append(p.path, e.dst), p.depth + 1 FROM p JOIN e ON e.src = p.node WHERE p.depth < 5 AND NOT list_contains(p.path, e.dst))"""


@query(f"""{_PATHS}, g AS (SELECT p.*, array_to_string(path, ',') AS s FROM p JOIN embeddings v ON v.vec_id = p.node WHERE v.label < 2 AND depth > 0)
 SELECT start, depth, s AS path FROM g QUALIFY row_number() OVER (PARTITION BY start ORDER BY depth DESC, path) = 1""")
def g1_longest_paths(spark, sf):
    v = table(spark, sf, "embeddings")
    out = graph.longest_paths(v.select(F.col("vec_id").alias("id")), _edges(spark, sf), v.where("label < 2").select(F.col("vec_id").alias("id")), 5, materialise)
    return out.select("start", "depth", F.array_join("path", ",").alias("path"))


@query(f"{_PATHS} SELECT start, node, min(depth) AS steps FROM p WHERE depth > 0 GROUP BY 1, 2")
def g2_reachability(spark, sf):
    return graph.reachable(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")), _edges(spark, sf), 5, materialise)


@query("""SELECT n.n_nationkey, r.r_name, count(DISTINCT c.c_custkey) AS incoming, string_agg(DISTINCT p.n_name, ',' ORDER BY p.n_name) AS paired FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
 LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN nation p ON p.n_regionkey = n.n_regionkey AND p.n_nationkey <> n.n_nationkey GROUP BY 1, 2""")
def g3_listing(spark, sf):
    n, r, c = table(spark, sf, "nation"), table(spark, sf, "region"), table(spark, sf, "customer")
    incoming = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.countDistinct("c_custkey").alias("incoming"))
    mates = n.select(F.col("n_regionkey"), F.col("n_name").alias("mate"), F.col("n_nationkey").alias("m"))
    paired = n.join(mates, "n_regionkey").where("m <> n_nationkey").groupBy("n_nationkey").agg(F.array_join(F.sort_array(F.collect_set("mate")), ",").alias("paired"))
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).join(incoming, "n_nationkey", "left").join(paired, "n_nationkey").select("n_nationkey", "r_name", F.coalesce("incoming", F.lit(0)).alias("incoming"), "paired")


@query(f"""{_PATHS}, g AS (SELECT start, path FROM p JOIN embeddings v ON v.vec_id = p.node WHERE v.label < 2 AND depth > 0 QUALIFY row_number() OVER (PARTITION BY start ORDER BY depth DESC, path) = 1),
 s AS (SELECT start, unnest(range(2, len(path) + 1)) AS i, path FROM g), f AS (SELECT start, i - 1 AS pos, path[i] AS id FROM s) SELECT start, id, pos FROM f JOIN embeddings v ON v.vec_id = f.id WHERE v.label < 2 QUALIFY row_number() OVER (PARTITION BY start ORDER BY pos) = 1""")
def g6_first_grounded(spark, sf):
    v = table(spark, sf, "embeddings")
    paths = graph.longest_paths(v.select(F.col("vec_id").alias("id")), _edges(spark, sf), v.where("label < 2").select(F.col("vec_id").alias("id")), 5, materialise)
    return graph.first_on_path(paths, v.select(F.col("vec_id").alias("id"), "label"), F.col("label") < 2).select("start", "id", F.col("pos").cast("long").alias("pos"))


@query(f"{_PATHS} SELECT start, max(depth) AS depth FROM p WHERE depth > 0 GROUP BY 1")
def o3_argmax_path(spark, sf):
    paths = graph.simple_paths(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")), _edges(spark, sf), 5, materialise)
    return paths.groupBy("start").agg(F.max("depth").alias("depth"))


# -- graph, to the bound of 10 edges -------------------------------------------------------

_PATHS_10 = _PATHS.replace("p.depth < 5", "p.depth < 10")


def _vertices(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")


def _longest_10(spark, sf):
    v = _vertices(spark, sf)
    return graph.longest_paths(v.select("id"), _edges(spark, sf), v.where("label < 2").select("id"), checkpoint=materialise)


@query(f"""{_PATHS_10}, g AS (SELECT p.*, array_to_string(path, ',') AS s FROM p JOIN embeddings v ON v.vec_id = p.node WHERE v.label < 2 AND depth > 0)
 SELECT start, depth, s AS path FROM g QUALIFY row_number() OVER (PARTITION BY start ORDER BY depth DESC, path) = 1""")
def g1_longest_paths_10(spark, sf):
    return _longest_10(spark, sf).select("start", "depth", F.array_join("path", ",").alias("path"))


@query(f"""WITH RECURSIVE e AS ({_EDGES}), p(start, node, depth) AS (SELECT vec_id, vec_id, 0 FROM embeddings UNION SELECT p.start, e.dst, p.depth + 1 FROM p JOIN e ON e.src = p.node WHERE p.depth < 10)
 SELECT start, node, min(depth) AS steps FROM p WHERE node <> start GROUP BY 1, 2""")
def g2_reachability_10(spark, sf):
    return graph.reachable(_vertices(spark, sf).select("id"), _edges(spark, sf), checkpoint=materialise)


@query(f"""{_PATHS_10}, g AS (SELECT start, path FROM p JOIN embeddings v ON v.vec_id = p.node WHERE v.label < 2 AND depth > 0 QUALIFY row_number() OVER (PARTITION BY start ORDER BY depth DESC, path) = 1),
 s AS (SELECT start, unnest(range(2, len(path) + 1)) AS i, path FROM g), f AS (SELECT start, i - 1 AS pos, path[i] AS id FROM s) SELECT start, id, pos FROM f JOIN embeddings v ON v.vec_id = f.id WHERE v.label < 2 QUALIFY row_number() OVER (PARTITION BY start ORDER BY pos) = 1""")
def g6_first_grounded_10(spark, sf):
    return graph.first_on_path(_longest_10(spark, sf), _vertices(spark, sf), F.col("label") < 2).select("start", "id", F.col("pos").cast("long").alias("pos"))


@query(f"{_PATHS_10} SELECT start, max(depth) AS depth FROM p WHERE depth > 0 GROUP BY 1")
def o3_argmax_path_10(spark, sf):
    paths = graph.simple_paths(_vertices(spark, sf).select("id"), _edges(spark, sf), checkpoint=materialise)
    return paths.groupBy("start").agg(F.max("depth").alias("depth"))

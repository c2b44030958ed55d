"""Sources and sinks on real files in the shared folder: written, read back, and compared with the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from keelstone.catalog._registry import query, table
from keelstone.operators import extract, graph, store
from keelstone.plans.state import put_text, shared_folder
from keelstone.sources import files
from keelstone.sources.toml import read_rules, toml_record


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/keelstone-{name}-{uuid.uuid4().hex}"


def _tree(spark, sf, name: str, file, content) -> str:
    """A file for each of the 25 nations, in a folder for each region."""
    folder = _folder(spark, name)
    for r in table(spark, sf, "nation").select("n_nationkey", "n_regionkey", "n_name").collect():
        put_text(spark, f"{folder}/r{r['n_regionkey']}/{file(r)}", content(r))
    return folder


def _name():
    return F.element_at(F.split("path", "/"), -1).alias("file")


@query("SELECT 's' || s_suppkey AS id, s_name AS content, CASE WHEN s_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS module FROM supplier")
def s2_several_files(spark, sf):
    """Two collections in files of their own, and one that is not there."""
    s = table(spark, sf, "supplier")
    folders = [_folder(spark, "even"), _folder(spark, "odd"), _folder(spark, "missing")]
    for n, (folder, module) in enumerate(zip(folders, ("even", "odd"), strict=False)):
        cols = {"id": (F.concat(F.lit("s"), "s_suppkey"), ""), "content": (F.col("s_name"), ""), "formal_spec": (F.lit("x"), ""), "module_name": (F.lit(module), "")}
        s.where(F.col("s_suppkey") % 2 == n).select(F.concat(toml_record(cols), F.lit(f"\nmodule = '{module}'\n"))).write.text(folder)
    rules = read_rules(spark, files.present(spark, folders))
    return rules.select("id", "content", F.col("source.module").alias("module"))


@query("SELECT 'f' || s_suppkey || '_open' AS opener_id, 'f' || s_suppkey || '_close' AS closer_id, s_suppkey % 2 = 0 AS required, 1.0::DOUBLE AS confidence FROM supplier")
def s3_manifest_scan(spark, sf):
    """S3: pairings of manifests; a pairing is required unless its record says otherwise."""
    name = lambda end: (F.concat(F.lit("f"), "s_suppkey", F.lit(end)), "")
    folder = _folder(spark, "manifest")
    record = toml_record({"opener": name("_open"), "closer": name("_close"), "required": (F.col("s_suppkey") % 2 == 0, True)}, "pairing")
    table(spark, sf, "supplier").select(record).write.text(folder)
    return read_rules(spark, folder, "pairings").select("opener_id", "closer_id", "required", "confidence")


@query("SELECT 'idiom_' || n_name AS id, n_name AS name, 'c' || n_nationkey || ',r' || n_regionkey AS participants FROM nation")
def s3_idiom_scan(spark, sf):
    folder = _folder(spark, "idioms")
    part = F.array(F.concat(F.lit("c"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))
    table(spark, sf, "nation").select(toml_record({"name": (F.col("n_name"), ""), "participants": (part, [])}, "idiom")).write.text(folder)
    return read_rules(spark, folder, "idioms").select("id", "name", F.array_join("participants", ",").alias("participants"))


@query("SELECT 'd' || n_nationkey || '.k' AS file, unnest([0, 1]) AS ord, unnest([2, 6]) AS line_start FROM nation WHERE n_nationkey % 3 <> 1")
def s5_definition_files(spark, sf):
    """Definitions in a tree of folders; files of other kinds are left out."""
    text = "module LIBC-A{0}\nrule fa{0}(X) => X +Int 1\n  requires X >Int 0\n\n/*@ note */\nrule fb(Y) => Y [structural]\nendmodule\n"
    folder = _tree(spark, sf, "definitions", lambda r: f"d{r['n_nationkey']}.{'md' if r['n_nationkey'] % 3 == 1 else 'k'}", lambda r: text.format(r["n_nationkey"]))
    blocks = extract.rule_blocks(files.source_tree(spark, folder, "*.k"))
    return blocks.select(_name(), "ord", "line_start")


@query("SELECT 'n' || n_nationkey || '.' || ['cpp', 'h', 'txt', 'hxx'][n_nationkey % 4 + 1] AS file, n_name AS content FROM nation WHERE n_nationkey % 4 <> 2")
def s6_source_files(spark, sf):
    """Sources of a language in a tree of folders, by their extensions."""
    kinds = ("cpp", "h", "txt", "hxx")
    folder = _tree(spark, sf, "sources", lambda r: f"n{r['n_nationkey']}.{kinds[r['n_nationkey'] % 4]}", lambda r: r["n_name"])
    return files.source_tree(spark, folder, "cpp").select(_name(), "content")


@query("SELECT conv_id, count(*) AS n, md5(string_agg(turn || ':' || role || ':' || coalesce(text, ''), '|' ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def s12_sessions(spark, sf):
    """Every conversation saved as a session and loaded again; a broken file is left out."""
    folder = _folder(spark, "sessions")
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("items")
    files.write_sessions(table(spark, sf, "conversations").groupBy("conv_id").agg(turns), folder)
    put_text(spark, f"{folder}/broken.json", '{"conv_id": 1, "items": [')
    found = files.read_sessions(spark, folder, "conv_id long, items array<struct<turn:long,role:string,text:string>>", one_a_file=False)
    said = F.transform("items", lambda t: F.concat_ws(":", t["turn"].cast("string"), t["role"], F.coalesce(t["text"], F.lit(""))))
    return found.select("conv_id", F.size("items").cast("long").alias("n"), F.md5(F.array_join(said, "|")).alias("digest"))


@query("SELECT 2 * count(*) AS n, count(DISTINCT vec_id) AS ids, count(*) AS first, 0::BIGINT AS last FROM embeddings")
def k8_appends(spark, sf):
    """K8: vectors appended twice, then none; each append returns how many rows it added."""
    folder = _folder(spark, "vectors")
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    added = [store.append_rows(x, folder) for x in (e, e, e.limit(0))]
    every = spark.read.schema(e.schema).parquet(folder)
    return every.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("ids"), F.lit(added[0]).cast("long").alias("first"), F.lit(added[2]).cast("long").alias("last"))


@query("SELECT 0::BIGINT AS n, count(*) AS before FROM customer")
def k11_truncated(spark, sf):
    """A table is emptied and keeps its columns."""
    folder = _folder(spark, "truncated")
    c = table(spark, sf, "customer")
    before = store.append_rows(c, folder)
    store.truncate(spark, folder)
    left = spark.read.parquet(folder).select(c.columns)
    return left.agg(F.count(F.lit(1)).alias("n"), F.lit(before).cast("long").alias("before"))


@query("""SELECT event_id, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER w AS next_purchase, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_signup
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""")
def j21_as_of_both_ways(spark, sf):
    """Of each event the next purchase and the last signup of its user."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    out = graph.next_of(e, ["user_id"], ["event_id"], "event_id", F.col("event_type") == "purchase", "next_purchase")
    out = graph.last_of(out, ["user_id"], ["event_id"], "event_id", F.col("event_type") == "signup", "last_signup")
    return out.select("event_id", "next_purchase", "last_signup")

"""The knowledge store: upserts, edges, neighbours, aggregates and set operations.

Everything is DataFrame in, DataFrame out.  Upserts are an anti-join and a union, so they
work on any storage; where "the last of a batch wins", an explicit ``ord`` column says
which is last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation
from pyspark.sql.window import Window


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; the planner limits each task to ``n`` before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """K2, K3, K5: rows of ``new`` replace those of ``old``; in one batch the last in ``order`` wins."""
    batch = first_per_key(new, keys, [F.desc(o) if isinstance(o, str) else o.desc() for o in order])
    return old.join(batch.select(*keys), list(keys), "left_anti").unionByName(batch, allowMissingColumns=True)


def append_new(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column | str] | None = None) -> DataFrame:
    """Existing rows stay, rows with new keys are added; the first of a key wins."""
    batch = first_per_key(new, keys, order) if order else new
    return old.unionByName(batch.join(old.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def append_rows(rows: DataFrame, path: str) -> int:
    """K8: rows added to a Parquet table, which is made if it is absent; how many were added."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def truncate(spark: SparkSession, path: str) -> None:
    """A Parquet table without its rows; its columns stay."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def set_list(rows: DataFrame, key: str, value, column: str, items: Column) -> DataFrame:
    """K9: one list column of the row with a key."""
    return rows.withColumn(column, F.when(F.col(key) == value, items).otherwise(F.col(column)))


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that break a uniqueness constraint, and how often they occur."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unnest(rows: DataFrame, key: str, items: str) -> DataFrame:
    """One (src, dst) per entry of a list column."""
    return rows.select(F.col(key).alias("src"), F.explode(items).alias("dst"))


def resolved_edges(rows: DataFrame, key: str, items: str, targets: DataFrame, target_key: str) -> DataFrame:
    """Distinct edges to targets that exist, whatever the load order."""
    found = targets.select(F.col(target_key).alias("dst"))
    return unnest(rows, key, items).join(found, "dst", "left_semi").select("src", "dst").distinct()


def dangling(rows: DataFrame, key: str, items: str, targets: DataFrame, target_key: str) -> DataFrame:
    """Distinct entries that name no target."""
    found = targets.select(F.col(target_key).alias("dst"))
    return unnest(rows, key, items).select("dst").distinct().join(found, "dst", "left_anti")


def endpoints_exist(edges: DataFrame, vertices: DataFrame, key: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """K6: edges whose two ends are vertices."""
    ids = vertices.select(F.col(key).alias("_id"))
    return edges.join(ids, edges[src] == ids["_id"], "left_semi").join(ids, edges[dst] == ids["_id"], "left_semi")


def neighbours(edges: DataFrame, vertices: DataFrame, key: str, direction: str = "out") -> DataFrame:
    """Each edge with the vertex at its other end; ``both`` goes either way, keeping an edge and its reverse."""
    out = edges.select(F.col("src").alias("at"), F.col("dst").alias("other"))
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("other"))
    way = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return way.join(vertices, way["other"] == vertices[key])


def without_edges(vertices: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """Vertices with no outgoing edge."""
    return vertices.join(edges.select(F.col("src").alias(key)), key, "left_anti")


def best_per_key(rows: DataFrame, keys: Sequence[str], score: str, ord_: str) -> DataFrame:
    """Per key the row of the highest score, the first of equals."""
    return first_per_key(rows, keys, [F.desc(score), ord_])


def counts_by_label(tables: dict[str, DataFrame]) -> DataFrame:
    """A1: one row (label, n) per table."""
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("label"), "n") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def histogram(rows: DataFrame, by: Sequence[str], top: int | None = None) -> DataFrame:
    """Group sizes, largest first; the ``top`` of them, if given."""
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), *by).limit(top) if top else out


def load_counters(rows: DataFrame, list_column: str, bad: Column) -> DataFrame:
    """One row of counters of a load: good rows, quarantined rows, list entries."""
    return rows.agg(
        F.count_if(~bad).alias("loaded"), F.count_if(bad).alias("quarantined"),
        F.sum(F.when(~bad, F.size(list_column)).otherwise(0)).alias("entries"),
    )

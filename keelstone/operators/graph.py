"""Graph traversal over edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def simple_paths(starts: DataFrame, edges: DataFrame, most: int = 10, checkpoint=None) -> DataFrame:
    """All simple paths of 1 to ``most`` edges from ``starts`` (column ``id``): ``start, node, path, depth``.

    The frontier is joined with the edges step by step, in one lazy plan.  ``checkpoint``
    may write and reread each frontier, so that no step is computed again.
    """
    hop = edges.select("src", "dst").distinct()
    front = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("path"), F.lit(0).alias("depth"))
    out = None
    for _ in range(most):
        front = front.join(hop, front["node"] == hop["src"]).where(~F.array_contains("path", F.col("dst")))
        front = front.select("start", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"), (F.col("depth") + 1).alias("depth"))
        front = checkpoint(front) if checkpoint else front
        out = front if out is None else out.unionByName(front)
    return out


def longest_paths(starts: DataFrame, edges: DataFrame, goals: DataFrame, most: int = 10, checkpoint=None) -> DataFrame:
    """G1, O3: per start the longest simple path to a goal (column ``id``), the smallest path of equals."""
    goal = goals.select(F.col("id").alias("node"))
    paths = simple_paths(starts, edges, most, checkpoint).join(goal, "node", "left_semi")
    best = paths.groupBy("start").agg(F.min(F.struct((-F.col("depth")).alias("d"), F.col("path").alias("path"))).alias("best"))
    return best.select("start", (-F.col("best.d")).alias("depth"), F.col("best.path").alias("path"))


def reachable(starts: DataFrame, edges: DataFrame, most: int = 10, checkpoint=None) -> DataFrame:
    """Vertices that each start reaches, with the fewest steps: ``start, node, steps``.

    Breadth first; only unseen (start, node) pairs go on, so cycles end.  ``checkpoint``
    may write and reread the state between steps.
    """
    hop = edges.select("src", "dst").distinct()
    seen = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("steps"))
    front = seen
    for step in range(1, most + 1):
        new = front.join(hop, front["node"] == hop["src"]).select("start", F.col("dst").alias("node")).distinct()
        front = new.join(seen, ["start", "node"], "left_anti").withColumn("steps", F.lit(step))
        seen = seen.unionByName(front)
        if checkpoint:
            seen = checkpoint(seen)
            front = seen.where(F.col("steps") == step)
            if front.isEmpty():
                break
    return seen.where("steps > 0")


def two_cycles(edges: DataFrame) -> DataFrame:
    """Pairs of vertices with edges both ways, the smaller first."""
    a = edges.select("src", "dst").distinct()
    b = a.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return a.join(b, ["src", "dst"], "left_semi").where("src < dst")


def chained(rows: DataFrame, by: list[str], order: list[str], key: str) -> DataFrame:
    """Each row with the keys of the rows before and after it."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("predecessor", F.lag(key).over(w)).withColumn("successor", F.lead(key).over(w))


def next_of(rows: DataFrame, by: list[str], order: list[str], key: str, wanted: Column, name: str) -> DataFrame:
    """Forward as-of: the ``key`` of the first later row of the same group that fulfils ``wanted``."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn(name, F.first(F.when(wanted, F.col(key)), ignorenulls=True).over(w))


def last_of(rows: DataFrame, by: list[str], order: list[str], key: str, wanted: Column, name: str) -> DataFrame:
    """Backward as-of: the ``key`` of the last earlier row of the same group that fulfils ``wanted``."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(wanted, F.col(key)), ignorenulls=True).over(w))


def first_on_path(paths: DataFrame, vertices: DataFrame, wanted) -> DataFrame:
    """The first vertex after the start of each path that fulfils ``wanted`` (a condition on ``vertices``)."""
    steps = paths.select("start", F.posexplode("path").alias("pos", "id")).where("pos > 0")
    good = steps.join(vertices.where(wanted), "id")
    return good.groupBy("start").agg(F.min(F.struct("pos", "id")).alias("first")).select("start", F.col("first.id").alias("id"), F.col("first.pos").alias("pos"))

"""Review sessions as tables: ``session_id, item_no, decision`` and the rules under review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def session_totals(items: DataFrame, session: str = "session_id", decision: str = "decision") -> DataFrame:
    """Per session how many items there are and how they were decided; complete without pending ones."""
    is_ = lambda d: F.count_if(F.col(decision) == d)
    out = items.groupBy(session).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(decision) != "pending").alias("reviewed"), is_("approved").alias("approved"),
        is_("rejected").alias("rejected"), is_("modified").alias("modified"), is_("skipped").alias("skipped"),
    )
    return out.withColumn("complete", F.col("reviewed") == F.col("total"))


def cursor(items: DataFrame, session: str = "session_id", item: str = "item_no", decision: str = "decision") -> DataFrame:
    """Each item with the one before, the one after, and the next pending one, wrapping round."""
    w = Window.partitionBy(session).orderBy(item)
    pending = F.when(F.col(decision) == "pending", F.col(item))
    later = F.min(pending).over(w.rowsBetween(1, Window.unboundedFollowing))
    first = F.min(pending).over(Window.partitionBy(session))
    return items.withColumns({"previous": F.lag(item).over(w), "next": F.lead(item).over(w), "next_pending": F.coalesce(later, first)})


def approved(items: DataFrame, rule: Column, modified: Column, decision: str = "decision") -> DataFrame:
    """The rules to export: approved ones, and the replacements of modified ones, now reviewed."""
    out = items.withColumn("exported", F.when(F.col(decision) == "approved", rule).when(F.col(decision) == "modified", modified))
    return out.where("exported is not null").withColumn("reviewed", F.lit(True))


def ordered(items: DataFrame, file: str, line: str, function: str, ord_: str, session: str = "session_id") -> DataFrame:
    """O1: a session's items numbered by file, line (0 if null) and function (empty if null), stable."""
    w = Window.partitionBy(session).orderBy(F.col(file), F.coalesce(F.col(line), F.lit(0)), F.coalesce(F.col(function), F.lit("")), F.col(ord_))
    return items.withColumn("item_no", F.row_number().over(w))

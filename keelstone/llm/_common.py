"""Helpers shared by the corpus operators: shared-folder tables, row keys, sizing."""

from __future__ import annotations

import ctypes
import itertools
import math
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelstone.plans.state import shared_folder


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialise` wrote and nothing reads any more."""
    for df in tables:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.keelstone_path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back; :func:`discard` deletes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/keelstone-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.keelstone_path = path
    return out


_CALLS = itertools.count()


def release(every: int = 1) -> None:
    """In a worker: give memory that is free back to the system, at each ``every``-th call.

    Workers are kept between stages, so what their allocators hold on to would add up.
    """
    if next(_CALLS) % every == 0:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a text, as columns ``k1`` and ``k2``.

    Together they are the 128-bit identity of a text.  A null text has the key
    of the empty text.
    """
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit("second"), t).alias("k2")]


def text_copies(docs: DataFrame, text: str) -> DataFrame:
    """How many rows each text has, as a written table: ``k1, k2, n``."""
    return materialise(docs.select(*text_key(F.col(text))).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")), "copies")


def n_rows(copies: DataFrame) -> int:
    """All rows of a table of counts ``n``."""
    return copies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def hashable(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of the columns that a hash can be made of."""
    def fine(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return fine(kind.elementType)
        if isinstance(kind, T.StructType):
            return all(fine(f.dataType) for f in kind)
        return not isinstance(kind, (T.MapType, T.VariantType))

    return [f"`{c}`" for c in columns if fine(df.schema[c].dataType)]


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of UTF-8 in the text column, over all rows."""
    row = df.agg(F.sum(F.octet_length(F.col(text))).alias("b")).first()
    return int(row["b"] or 0)


#: Bytes of text in a part, about, at most.
PART_BYTES = 32_000_000
#: A key of more than this share of the rows is cut; each of its shares holds about as many.
SHARES = 1024


def buckets_for(total_bytes: int) -> int:
    """How many buckets to deal the hashes of texts into.

    Their number grows with the square root of the corpus, so that the rows of the
    parts-by-buckets exchange, of about a kilobyte each, grow in proportion to it.
    """
    return max(1, math.ceil(math.sqrt(total_bytes / 1000)))


def parts_for(total_bytes: int) -> int:
    """How many parts to deal texts into: as many as buckets, and more where a part would be over ``PART_BYTES``."""
    return max(buckets_for(total_bytes), math.ceil(total_bytes / PART_BYTES))


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], draw: list[str], total: int, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``many`` joined to ``few`` on ``keys``, where any key may hold a large share of the rows of ``many``.

    A key of more than one ``SHARES``-th of the ``total`` rows is cut into shares by a hash of the
    columns ``draw``, and its rows of ``few``, of which a key has one or a bounded number, are
    repeated for each share.  Fewer than ``SHARES`` keys can be that frequent, so
    they are broadcast, and no more than ``2 * SHARES`` rows a key are added.  ``counts``
    may give the keys' rows in ``many``, as ``n``.
    """
    share, shares = free_name([*many.columns, *few.columns], "share"), free_name([*many.columns, *few.columns], "shares")
    counts = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    hot = F.broadcast(counts.where(F.col("n") * SHARES > total).select(*keys, F.ceil(F.col("n") * SHARES / max(total, 1)).cast("int").alias(shares)))
    left = many.join(hot, keys, "left").withColumn(share, F.coalesce(F.pmod(F.xxhash64(F.lit(share), *draw), F.col(shares)), F.lit(0)).cast("int")).drop(shares)
    right = few.join(hot, keys, "left").withColumn(share, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(shares), F.lit(1)) - 1))).drop(shares)
    return left.join(right, [*keys, share], how).drop(share)


def free_name(taken: list[str], base: str) -> str:
    """``base``, or ``base`` with underscores in front if a column has that name."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base = "_" + base
    return base

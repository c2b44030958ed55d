"""Vector search: exact k nearest, thresholds, near-duplicate verdicts, expansion by edges."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Bytes of vectors that are sent to every task; a larger base is searched in blocks.
BROADCAST_BYTES = 64_000_000
#: Bytes of the distances that a task holds at a time, several times over.
MATRIX_BYTES = 16_000_000
#: Queries and rows whose products are made at a time, and pairs of those queries that are held for distances in doubles.
QUERY_ROWS, BASE_ROWS, MAX_PAIRS = 256, 4096, 4_000_000
METRICS = ("l2sq", "l2", "cosine", "dot")


def distance(a: Column, b: Column, metric: str = "l2sq") -> Column:
    """Distance of two array columns, in doubles, smaller is nearer."""
    if metric not in METRICS:
        raise ValueError(f"metric has to be one of {METRICS}")
    total = lambda f: F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    if metric in ("l2sq", "l2"):
        d = total(lambda x, y: (x - y) * (x - y))
        return F.sqrt(d) if metric == "l2" else d
    dot = total(lambda x, y: x * y)
    if metric == "dot":
        return -dot
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return 1 - dot / (norm(a) * norm(b))


def nearest(base: DataFrame, query: Column, k: int = 10, id_col: str = "id", vec_col: str = "v", metric: str = "l2sq", digits: int = 6) -> DataFrame:
    """V1: the ``k`` rows nearest to one query vector, ties by id; plans as a top-k without a full sort."""
    return base.withColumn("distance", F.round(distance(F.col(vec_col), query, metric), digits)).drop(vec_col).orderBy("distance", id_col).limit(k)


def _matrix(vectors: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    parts = vectors.chunks if isinstance(vectors, pa.ChunkedArray) else [vectors]
    if all(not c.null_count and (c.value_lengths().to_numpy() == dim).all() for c in parts):
        flat = [c.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim) for c in parts if len(c)]
        return np.concatenate(flat) if flat else np.empty((0, dim))
    return np.stack(vectors.to_numpy(zero_copy_only=False)).astype(np.float64)


def _batch(q_ids, rows: np.ndarray, near: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
    text = near.dtype == object
    return pa.RecordBatch.from_arrays([q_ids.take(pa.array(rows.astype(np.int64))), pa.array(near.tolist() if text else near.astype(np.int64), pa.string() if text else pa.int64()), pa.array(dist.astype(np.float64))], names=["query_id", "id", "distance"])


def _whole(q_ids, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, metric: str, digits: int, skip_self: bool) -> pa.RecordBatch:
    """The k nearest rows of ``x`` for every row of ``q``, ties by id, from all distances in doubles."""
    norms = (x * x).sum(axis=1)
    mine = np.array(q_ids.to_pylist(), dtype=object)
    most = k + int(np.unique(ids, return_counts=True)[1].max(initial=1)) * skip_self
    rows, near, dist = [np.empty(0)], [ids[:0]], [np.empty(0)]
    step = max(1, MATRIX_BYTES // (8 * max(1, len(x))))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        dot = part @ x.T
        own = (part * part).sum(axis=1)[:, None]
        if metric in ("l2sq", "l2"):
            d = np.maximum(own + norms - 2 * dot, 0.0)
            d = np.sqrt(d) if metric == "l2" else d
        elif metric == "cosine":
            d = 1 - dot / np.sqrt(own * norms)
        else:
            d = -dot
        d = np.round(d, digits)
        for i, r in enumerate(d):
            top = np.arange(len(r))
            if len(r) > most:
                near_edge = np.flatnonzero(r <= np.partition(r, most - 1)[most - 1])
                top = near_edge if len(near_edge) >= most else top  # the edge is no number
            top = top[ids[top] != mine[at + i]] if skip_self else top
            top = top[np.lexsort((ids[top], r[top]))][:k]
            rows.append(np.full(len(top), at + i))
            near.append(ids[top])
            dist.append(r[top])
    return _batch(q_ids, np.concatenate(rows), np.concatenate(near), np.concatenate(dist))


class _Base:
    """Vectors to search by l2: as they are, and as floats with half their squared lengths, of which one product gives the order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, half = ids, x, (x * x).sum(axis=1) / 2
        self.most = float(half.max(initial=0.0))
        self.repeats = int(np.unique(ids, return_counts=True)[1].max(initial=1))
        self.narrow = np.concatenate([x, -half[:, None]], axis=1).astype(np.float32) if self.most < 1e30 else None

    def near(self, q_ids, q: np.ndarray, k: int, metric: str, digits: int, skip_self: bool) -> pa.RecordBatch:
        """As ``_whole``; only pairs that floats, with the bound of their error, can't exclude have distances in doubles."""
        fits = metric in ("l2sq", "l2") and self.narrow is not None and bool(((q * q).sum(axis=1) < 1e30).all()) and 0 <= digits <= 12
        found = []
        for at in range(0, len(q), QUERY_ROWS):
            own, part = q_ids.slice(at, QUERY_ROWS), q[at : at + QUERY_ROWS]
            pairs = self._pairs(part, k + self.repeats * skip_self, metric, digits) if fits else None
            found.append(_whole(own, part, self.ids, self.x, k, metric, digits, skip_self) if pairs is None else self._nearest(own, part, *pairs, k, metric, digits, skip_self))
        return pa.Table.from_batches(found).combine_chunks().to_batches()[0] if sum(map(len, found)) else _batch(q_ids, np.empty(0), self.ids[:0], np.empty(0))

    def _pairs(self, q: np.ndarray, k: int, metric: str, digits: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Rows of ``q`` and of the base that hold the ``k`` nearest and all that round to the same; None if they are too many."""
        n, dim = len(q), q.shape[1]
        length = np.sqrt((q * q).sum(axis=1))
        # of the sum of dim + 1 rounded products, in any order; twice, as the edge and the pair both err
        slack = 2 * (dim + 8) * 2.0**-24 * (length * np.sqrt(2 * self.most) + self.most) + 1e-30
        unit = 2 * 10.0**-digits  # what can round to the same distance; a distance d apart by u is (d + u)² - d² squared
        slack += unit if metric == "l2sq" else unit * (length + np.sqrt(2 * self.most) + unit)
        narrow = np.concatenate([q, np.ones((n, 1))], axis=1).astype(np.float32)
        best, edge, rows, cols, got, held = np.full((n, k), -np.inf), np.full(n, -np.inf), [], [], [], 0
        for at in range(0, len(self.x), BASE_ROWS):
            score = narrow @ self.narrow[at : at + BASE_ROWS].T
            if not at and score.shape[1] > k:
                edge = np.partition(score, -k, axis=1)[:, -k].astype(np.float64)
            # floats next below the bound, so that none is lost to its rounding
            bound = np.nextafter((edge - slack).astype(np.float32), np.float32(-np.inf))
            i, j = np.divmod(np.flatnonzero(score >= bound[:, None]), score.shape[1])
            if not len(i):
                continue
            held += len(i)
            if held > MAX_PAIRS:
                return None
            s = score[i, j].astype(np.float64)
            rows.append(i), cols.append(j + at), got.append(s)
            who, what = np.concatenate([np.repeat(np.arange(n), k), i]), np.concatenate([best.ravel(), s])
            order = np.lexsort((-what, who))
            who, what = who[order], what[order]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            best = what[place < k].reshape(n, k)
            edge = best[:, -1]
        i, j, s = np.concatenate(rows), np.concatenate(cols), np.concatenate(got)
        keep = s >= (edge - slack)[i]
        return i[keep], j[keep]

    def _nearest(self, q_ids, q: np.ndarray, rows: np.ndarray, cols: np.ndarray, k: int, metric: str, digits: int, skip_self: bool) -> pa.RecordBatch:
        if skip_self:
            other = self.ids[cols] != np.array(q_ids.to_pylist(), dtype=object)[rows]
            rows, cols = rows[other], cols[other]
        d, step = np.empty(len(rows)), max(1, MATRIX_BYTES // (8 * max(1, q.shape[1])))
        for at in range(0, len(rows), step):
            apart = q[rows[at : at + step]] - self.x[cols[at : at + step]]
            d[at : at + step] = np.einsum("ij,ij->i", apart, apart)
        d = np.round(np.sqrt(d) if metric == "l2" else d, digits)
        order = np.lexsort((self.ids[cols], d, rows))
        rows, cols, d = rows[order], cols[order], d[order]
        first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        return _batch(q_ids, rows[first], self.ids[cols[first]], d[first])


def knn(queries: DataFrame, base: DataFrame, k: int = 10, query_id: str = "query_id", query_vec: str = "q", id_col: str = "id", vec_col: str = "v", metric: str = "l2sq", digits: int = 6, skip_self: bool = False) -> DataFrame:
    """V2: the ``k`` nearest rows of ``base`` for every query: ``query_id, rank, id, distance``.

    A base of up to ``BROADCAST_BYTES`` goes to every task as one matrix.  A larger one is
    cut into blocks by a hash of its ids and the queries into chunks of the same
    size; every block meets every chunk in a group of its own, and the partial lists are
    merged.  Distances are rounded to ``digits``, ties go to the smaller id.
    """
    text_ids = isinstance(base.schema[id_col].dataType, T.StringType)
    id_type = object if text_ids else np.int64
    schema = T.StructType([T.StructField("query_id", queries.schema[query_id].dataType), T.StructField("id", T.StringType() if text_ids else T.LongType()), T.StructField("distance", T.DoubleType())])
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("q"))
    rows = base.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    dim = shape["d"] or 0
    size = shape["n"] * dim * 8
    if not size:
        found = queries.sparkSession.createDataFrame([], schema)
    elif size <= BROADCAST_BYTES:
        table = rows.toArrow()
        x, ids = _matrix(table["v"], dim), np.array(table["id"].to_pylist(), dtype=id_type)

        def scan(batches):
            held = _Base(ids, x)
            for batch in batches:
                yield held.near(batch.column(0), _matrix(batch.column(1), dim), k, metric, digits, skip_self)

        found = asked.mapInArrow(scan, schema)
    else:
        blocks = math.ceil(size / BROADCAST_BYTES)
        chunks = max(1, math.ceil(asked.count() * dim * 8 / BROADCAST_BYTES))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        left = asked.select("*", part("query_id", chunks).alias("chunk"), every(blocks).alias("block"))
        right = rows.select("*", part("id", blocks).alias("block"), every(chunks).alias("chunk"))

        def meet(q: pa.Table, b: pa.Table) -> pa.Table:
            if not q.num_rows or not b.num_rows:
                return q.select(["query_id"]).slice(0, 0).append_column("id", pa.array([], pa.string() if text_ids else pa.int64())).append_column("distance", pa.array([], pa.float64()))
            held = _Base(np.array(b["id"].to_pylist(), dtype=id_type), _matrix(b["v"], dim))
            near = held.near(q["query_id"].combine_chunks(), _matrix(q["q"], dim), k, metric, digits, skip_self)
            return pa.Table.from_batches([near])

        found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(meet, schema)
    rank = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def near_duplicates(hits: DataFrame, same: float = 0.9, alike: float = 0.7) -> DataFrame:
    """V4: per query the verdict of its hits and, unless one is a duplicate, how many are similar."""
    sim = 1 / (1 + F.col("distance"))
    out = hits.groupBy("query_id").agg(F.max(sim).alias("best"), F.count_if(sim >= same).alias("n_same"), F.count_if((sim >= alike) & (sim < same)).alias("n_alike"))
    verdict = F.when(F.col("n_same") > 0, "duplicate").when(F.col("n_alike") > 0, "similar").otherwise("unique")
    return out.select("query_id", verdict.alias("verdict"), F.col("n_same").alias("duplicates"), F.when(F.col("n_same") > 0, 0).otherwise(F.col("n_alike")).alias("similar"))


def over_fetch(hits: DataFrame, keep: Column, k: int) -> DataFrame:
    """V3: hits that pass a filter, the first ``k`` of each query, ranked anew."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return hits.where(keep).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def expand_pairs(hits: DataFrame, pairs: DataFrame, idioms: DataFrame) -> DataFrame:
    """V5: each hit, then its unseen paired ids, then its idioms; ``hits`` has ``query_id, rank, id``.

    ``pairs`` has ``at, other`` and ``idioms`` ``at, idiom``.  An id that is a hit, or was
    reached as a pair of an earlier hit, is not repeated; idioms are.  Returns ``query_id,
    pos, kind, id, via``.
    """
    kind = hits.schema["id"].dataType
    item = lambda step, name, c, via: F.struct(F.lit(step).alias("step"), F.lit(name).alias("kind"), c.cast(kind).alias("id"), via.cast("string").alias("via"))
    others = pairs.groupBy("at").agg(F.collect_list(F.struct("other")).alias("others")).withColumnRenamed("at", "id")
    named = idioms.groupBy("at").agg(F.collect_list(F.struct("idiom")).alias("idioms")).withColumnRenamed("at", "id")
    # one pass over the hits, which may be a whole search
    known = hits.select("query_id", "rank", "id").join(others, "id", "left").join(named, "id", "left")

    def listed(step: int, name: str, c: str, field: str) -> Column:
        none = F.slice(F.array(item(step, name, F.lit(None), F.lit(None))), 1, 0)
        return F.coalesce(F.transform(c, lambda x: item(step, name, x[field], F.col("id"))), none)

    lists = [F.array(item(0, "hit", F.col("id"), F.lit(None))), listed(1, "pair", "others", "other"), listed(2, "idiom", "idioms", "idiom")]
    every = known.select("query_id", "rank", F.inline(F.concat(*lists)))
    same, first = Window.partitionBy("query_id", "id"), Window.partitionBy("query_id", "id", "step").orderBy("rank")
    seen = F.coalesce(F.max(F.col("step") == 0).over(same) & F.col("id").isNotNull(), F.lit(False))
    every = every.withColumns({"_seen": seen, "_n": F.row_number().over(first)}).where("step <> 1 or (not _seen and _n = 1)")
    pos = Window.partitionBy("query_id").orderBy("rank", "step", "id")
    return every.withColumn("pos", F.row_number().over(pos)).select("query_id", "pos", "kind", "id", "via")


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def encode(text: Column, dim: int = 64) -> Column:
    """V0: the default encoder: words hashed by md5 into ``dim`` buckets, counted, scaled to length 1.

    Words are runs of lower-cased ASCII letters and digits; without any, the vector is zero.
    Built-in functions only, so it runs in the JVM.
    """
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_remove(F.split(low, "[^a-z0-9]+"), "")
    buckets = F.transform(words, lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % dim).cast("int"))
    count = lambda b: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(b, lambda x: x == i)).cast("double"))
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    scaled = lambda v: _let(size(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x)))
    return _let(_let(buckets, count), scaled)

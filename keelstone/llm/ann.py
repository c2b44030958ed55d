"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample and grows with the corpus: leaves that hold
several times the wanted rows get a tree of their own, fitted in Spark on a bounded
sample of each leaf.  A query walks the tree best bin first: a priority queue holds the
nodes seen so far, by the largest inner product that is to be expected in them, and
leaves come out of it in the order in which they are visited.  How many leaves are visited
is calibrated: for a sample of queries the true neighbours are found by brute force
over all vectors, and visits are widened in small steps until the recall reaches
the target, then until it does on a second sample that was held out.

Leaves that are neighbours in the tree are put together into shards of bounded size, so a
query reaches few of them; a leaf over that size is cut into several, all of which are
searched.  The queries of a shard are cut into chunks of bounded size.  Of equal
vectors, only the ``k + 1`` smallest ids can be among the nearest of any query, so
only these are indexed.
"""

from __future__ import annotations

import heapq
import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelstone.llm._common import discard, materialise

#: Rows and bytes of the sample that the first tree is fitted on.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 64_000_000
BRANCH, LEAF_ROWS, ITERATIONS = 16, 8, 8
#: Bytes of the tree's centres, which go to every task; beyond, leaves grow instead.
TREE_BYTES = 64_000_000
#: A leaf of more than so many times the wanted rows is split, if such leaves hold more than that share of all rows.
OVERSIZE, OVERSIZE_SHARE = 3, 0.1
#: Queries whose true neighbours are found by brute force, to calibrate and to check, and the recall that they have to reach.
CALIBRATION_QUERIES, CHECK_QUERIES, TARGET_RECALL = 200, 100, 0.95
#: Factor by which visits are widened.
WIDER = 1.05
#: Vectors of a shard, at most, and bytes of them and of the queries that are searched there at a time.
SHARD_ROWS, SHARD_BYTES, CHUNK_BYTES = 4096, 8_000_000, 8_000_000
#: Scores that are held in one matrix.
BLOCK_SCORES = 2_000_000

_LOG = logging.getLogger(__name__)


def wanted_leaf_rows(n_rows: int, dim: int) -> int:
    """Rows of a leaf: with the square root of the corpus, and more where the tree would be over its bound."""
    return max(LEAF_ROWS, math.isqrt(n_rows) // 16, -(-n_rows * 4 * dim // TREE_BYTES))


class Tree:
    """Nodes in arrays: centre, children (first, count) and leaf number; :meth:`weigh` makes it ready for visits."""

    def __init__(self, sample: np.ndarray, branch: int = BRANCH, leaf_rows: int | None = None, seed: int = 7):
        leaf_rows = LEAF_ROWS if leaf_rows is None else leaf_rows
        rng = np.random.default_rng(seed)
        centres, first, count = [], [], []

        def node(x: np.ndarray) -> int:
            centres.append(x.mean(axis=0) if len(x) else np.zeros(x.shape[1]))
            first.append(0)
            count.append(0)
            return len(centres) - 1

        todo = [(node(sample), sample)]
        while todo:
            at, x = todo.pop()
            groups = self._split(x, min(branch, -(-len(x) // leaf_rows)), rng) if len(x) > leaf_rows else []
            if len(groups) >= 2:
                first[at], count[at] = len(centres), len(groups)
                todo += [(node(g), g) for g in groups]
        self.centres = np.array(centres, dtype=np.float32)
        self.first, self.count = np.array(first), np.array(count)
        self._number()

    def _number(self) -> None:
        """Numbers the leaves from left to right, so that near ones have near numbers."""
        self.leaf = np.full(len(self.first), -1)
        todo, n = [0], 0
        while todo:
            at = todo.pop()
            if self.count[at]:
                todo.extend(range(self.first[at] + self.count[at] - 1, self.first[at] - 1, -1))
            else:
                self.leaf[at] = n
                n += 1
        self.leaves = n

    def leaf_nodes(self) -> np.ndarray:
        """The node of each leaf number."""
        out = np.empty(self.leaves, dtype=np.int64)
        at = np.flatnonzero(self.leaf >= 0)
        out[self.leaf[at]] = at
        return out

    def graft(self, parts: dict[int, tuple]) -> None:
        """Puts trees (as (centres, first, count)) in the place of leaf nodes and numbers the leaves anew."""
        centres, first, count = [self.centres], [self.first], [self.count]
        size = len(self.first)
        for at, (c, f, n) in sorted(parts.items()):
            if n[0]:  # its first node is the leaf node itself
                self.first[at], self.count[at] = size + f[0] - 1, n[0]
                centres.append(c[1:])
                first.append(np.where(n[1:] > 0, f[1:] + size - 1, 0))
                count.append(n[1:])
                size += len(c) - 1
        self.centres, self.first, self.count = (np.concatenate(x) for x in (centres, first, count))
        self._number()

    def weigh(self, held: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> None:
        """Moves every node to the mean of its rows, from the number, sums and sums of squares of each leaf.

        ``reach`` is how far the best of a node's rows is expected beyond its centre: the
        largest of as many normal draws, with the node's spread along one direction.
        Nodes without rows are never visited.
        """
        n, dim = len(self.first), self.centres.shape[1]
        rows, total, square = np.zeros(n), np.zeros((n, dim)), np.zeros(n)
        at = np.flatnonzero(self.leaf >= 0)
        rows[at], total[at], square[at] = held[self.leaf[at]], sums[self.leaf[at]], squares[self.leaf[at]]
        for i in range(n - 1, -1, -1):  # children come after their node
            if self.count[i]:
                own = slice(self.first[i], self.first[i] + self.count[i])
                rows[i], total[i], square[i] = rows[own].sum(), total[own].sum(axis=0), square[own].sum()
        mean = total / np.maximum(rows, 1)[:, None]
        spread = np.sqrt(np.maximum(square / np.maximum(rows, 1) - (mean**2).sum(axis=1), 0.0))
        self.centres, self.rows = mean.astype(np.float32), rows
        self.reach = np.sqrt(2 * np.log(np.maximum(rows, 2))) * spread / math.sqrt(dim)

    @staticmethod
    def _split(x: np.ndarray, branch: int, rng) -> list[np.ndarray]:
        c = x[rng.choice(len(x), size=min(branch, len(x)), replace=False)]
        for _ in range(ITERATIONS):
            near = np.argmin((c**2).sum(axis=1) - 2 * x @ c.T, axis=1)
            c = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        near = np.argmin((c**2).sum(axis=1) - 2 * x @ c.T, axis=1)
        return [x[near == j] for j in range(len(c)) if (near == j).any()]

    def assign(self, x: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row, by the nearest centre at every level, from the root or the rows' own nodes on."""
        out = np.empty(len(x), dtype=np.int32)
        todo = [(0, np.arange(len(x)))]
        if start is not None:
            order = np.argsort(start, kind="stable")
            nodes, cuts = np.unique(start[order], return_index=True)
            todo = list(zip(nodes.tolist(), np.split(order, cuts[1:]), strict=True))
        while todo:
            node, rows = todo.pop()
            if not self.count[node]:
                out[rows] = self.leaf[node]
                continue
            a = self.first[node]
            c = self.centres[a : a + self.count[node]].astype(np.float64)
            near = np.argmin((c**2).sum(axis=1) - 2 * x[rows] @ c.T, axis=1)
            todo += [(a + j, rows[near == j]) for j in range(len(c)) if (near == j).any()]
        return out

    def visits(self, q: np.ndarray, n_leaves: int, n_rows: int) -> list[int]:
        """Leaves in best-bin-first order, until ``n_leaves`` were visited that hold ``n_rows`` together."""
        size, q = float(np.sqrt(q @ q)), q.astype(np.float32)
        queue, out, rows = [(0.0, 0)], [], 0
        while queue and (len(out) < n_leaves or rows < n_rows):
            _, node = heapq.heappop(queue)
            n = self.count[node]
            if not n:
                out.append(int(self.leaf[node]))
                rows += self.rows[node]
                continue
            a = int(self.first[node])
            worst = -(self.centres[a : a + n] @ q + size * self.reach[a : a + n])
            for j, w in enumerate(worst.tolist(), a):
                if self.rows[j]:
                    heapq.heappush(queue, (w, j))
        return out


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, v`` (doubles): without null ids and vectors, zeros, and null or non-finite components; equal rows once."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False))).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).dropDuplicates()


_FOUND_SQL = "query_id long, vec_id long, score double, leaf int"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("leaf", pa.int32())])


def _best(scores: np.ndarray, q_ids: np.ndarray, qs: np.ndarray, ids: np.ndarray, x: np.ndarray, leaf: np.ndarray, k: int) -> list[np.ndarray]:
    """Of a matrix of rough scores (minus infinity: not visited): of each query the ``k`` best, with all that may tie with the last.

    Their scores are summed in one order, so equal vectors have equal scores.
    """
    scores[q_ids[:, None] == ids[None, :]] = -np.inf
    edge = np.full((len(scores), 1), -np.inf)
    if scores.shape[1] > k:
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
    low = np.where(np.isfinite(edge), edge - 1e-9 * np.maximum(1.0, np.abs(edge)), edge)
    i, j = np.nonzero((scores >= low) & (scores > -np.inf))
    return [q_ids[i], ids[j], (x[j] * qs[i]).sum(axis=1), leaf[j]]


def _found(parts: list[list[np.ndarray]]) -> pa.Table:
    if not parts:
        return _FOUND.empty_table()
    return pa.Table.from_arrays([pa.array(np.concatenate(z), f.type) for z, f in zip(zip(*parts, strict=True), _FOUND, strict=True)], schema=_FOUND)


def _scan(qs: np.ndarray, q_ids: np.ndarray, k: int):
    """Brute force: the nearest of each batch for a bounded set of queries."""

    def run(batches):
        for batch in batches:
            ids, x, leaf = batch.column("id").to_numpy(), _matrix(batch.column("v"), qs.shape[1]), batch.column("leaf").to_numpy()
            yield from _found([_best(qs @ x.T, q_ids, qs, ids, x, leaf, k)]).to_batches()

    return run


def _nearest(found: DataFrame, k: int) -> DataFrame:
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def _search(dim: int, k: int):
    """Of a shard and a chunk of queries: for each query, the nearest in the leaves that it visits."""

    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        if not index.num_rows or not asked.num_rows:
            return _FOUND.empty_table()
        order = np.argsort(index["leaf"].to_numpy(), kind="stable")
        leaf, ids, x = index["leaf"].to_numpy()[order], index["id"].to_numpy()[order], _matrix(index["v"], dim)[order]
        names, lo = np.unique(leaf, return_index=True)
        hi = np.append(lo[1:], len(leaf))
        q_ids, qs = asked["query_id"].to_numpy(), _matrix(asked["q"], dim)
        visited = asked["leaves"].combine_chunks()
        cuts, flat = visited.offsets.to_numpy(), visited.values.to_numpy()
        step, out = max(1, BLOCK_SCORES // len(ids)), []
        for a in range(0, len(q_ids), step):
            b = min(a + step, len(q_ids))
            scores = np.full((b - a, len(ids)), -np.inf)
            leaves = flat[cuts[a] : cuts[b]]
            who = np.repeat(np.arange(b - a), np.diff(cuts[a : b + 1]))
            by_leaf = np.argsort(leaves, kind="stable")
            leaves, who = leaves[by_leaf], who[by_leaf]
            for name, s, e, c, d in zip(names, lo, hi, np.searchsorted(leaves, names), np.searchsorted(leaves, names, side="right"), strict=True):
                if d > c:
                    scores[who[c:d], s:e] = qs[a + who[c:d]] @ x[s:e].T
            out.append(_best(scores, q_ids[a:b], qs[a:b], ids, x, leaf, k))
        return _found(out)

    return run


def _grow(tree: Tree, index: DataFrame, held: np.ndarray, dim: int, rows_of_leaf: int) -> DataFrame | None:
    """Splits leaves that hold far more rows than wanted; the index with its new leaves, or none if nothing was split.

    Each gets a tree that is fitted in a task of its own, on a sample of eight rows for each
    leaf that is wanted there.
    """
    big = np.flatnonzero(held > OVERSIZE * rows_of_leaf)
    if not len(big) or held[big].sum() <= OVERSIZE_SHARE * held.sum():
        return None
    wanted = np.minimum(-(-held // rows_of_leaf), SAMPLE_ROWS // LEAF_ROWS)
    every = np.where(held > OVERSIZE * rows_of_leaf, np.maximum(1, held // np.maximum(1, LEAF_ROWS * wanted)), 0)

    def take(batches):
        for batch in batches:
            n = every[batch.column("leaf").to_numpy()]
            yield batch.filter(pa.array((n > 0) & (batch.column("draw").to_numpy() % np.maximum(n, 1) == 0)))

    def fit(table: pa.Table) -> pa.Table:
        x = _matrix(table["v"], dim)[np.argsort(table["id"].to_numpy(), kind="stable")]
        n = table["leaf"][0].as_py()
        t = Tree(x, leaf_rows=max(LEAF_ROWS, -(-len(x) // int(wanted[n]))), seed=n)
        return pa.table({"leaf": pa.array([n], pa.int32()), "parts": pa.array([[t.centres.tobytes(), t.first.tobytes(), t.count.tobytes()]], pa.list_(pa.binary()))})

    draw = F.pmod(F.xxhash64(F.lit("split"), "id"), F.lit(1 << 40)).alias("draw")
    sample = index.select("id", "v", "leaf", draw).mapInArrow(take, "id long, v array<double>, leaf int, draw long")
    parts = sample.groupBy("leaf").applyInArrow(fit, "leaf int, parts array<binary>")
    nodes = tree.leaf_nodes()
    grown = {}
    for r in parts.collect():  # centres of TREE_BYTES at most, as the wanted rows of a leaf see to
        c, f, n = r["parts"]
        grown[int(nodes[r["leaf"]])] = (np.frombuffer(c, np.float32).reshape(-1, dim), np.frombuffer(f, np.int64), np.frombuffer(n, np.int64))
    tree.graft(grown)

    def leaf(batches):
        for batch in batches:
            found = tree.assign(_matrix(batch.column("v"), dim), nodes[batch.column("leaf").to_numpy()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(found, pa.int32())], names=["id", "v", "leaf"])

    return materialise(index.mapInArrow(leaf, "id long, v array<double>, leaf int"), "index")


def _held(index: DataFrame, leaves: int) -> np.ndarray:
    held = np.zeros(leaves, dtype=np.int64)
    for r in index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per leaf
        held[r["leaf"]] = r["n"]
    return held


def _moments(index: DataFrame, leaves: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each leaf the sum of its vectors and of their squares; added up in batches first, then by groups of leaves."""
    groups = max(1, leaves * dim * 8 // 4_000_000)

    def add(leaf: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> pa.Table:
        names, inverse = np.unique(leaf, return_inverse=True)
        total = np.zeros((len(names), dim))
        np.add.at(total, inverse, sums)
        return pa.table({
            "part": pa.array(names % groups, pa.int32()), "leaf": pa.array(names, pa.int32()), "square": np.bincount(inverse, weights=squares, minlength=len(names)),
            "v": pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, dim), pa.int32()), pa.array(total.ravel())),
        })

    def partial(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            yield from add(batch.column("leaf").to_numpy(), x, (x**2).sum(axis=1)).to_batches()

    def whole(table: pa.Table) -> pa.Table:
        return add(table["leaf"].to_numpy(), _matrix(table["v"], dim), table["square"].to_numpy())

    schema = "part int, leaf int, square double, v array<double>"
    found = index.select("v", "leaf").mapInArrow(partial, schema).groupBy("part").applyInArrow(whole, schema).toArrow()  # one row per leaf
    sums, squares = np.zeros((leaves, dim)), np.zeros(leaves)
    if found.num_rows:
        at = found["leaf"].to_numpy()
        sums[at], squares[at] = _matrix(found["v"], dim), found["square"].to_numpy()
    return sums, squares


def build_index(rows: DataFrame, dim: int) -> tuple[Tree, DataFrame, np.ndarray]:
    """Of ``id, v, copy``: the tree, the rows with their leaves, and how many each leaf holds."""
    n = rows.count()
    rows_of_leaf = wanted_leaf_rows(n, dim)
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    sample = rows.where("copy = 1").orderBy(F.xxhash64("id"), "id").select("v").limit(most).toArrow()
    x = _matrix(sample["v"], dim)
    tree = Tree(x, leaf_rows=max(LEAF_ROWS, rows_of_leaf * len(x) // n))

    def leaf(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(tree.assign(_matrix(batch.column("v"), dim)), pa.int32())], names=["id", "v", "leaf"])

    index = materialise(rows.select("id", "v").mapInArrow(leaf, "id long, v array<double>, leaf int"), "index")
    held = _held(index, tree.leaves)
    if (grown := _grow(tree, index, held, dim, rows_of_leaf)) is not None:
        discard(index)
        index, held = grown, _held(grown, tree.leaves)
    tree.weigh(held, *_moments(index, tree.leaves, dim))
    return tree, index, held


def _calibrate(tree: Tree, index: DataFrame, held: np.ndarray, asked: DataFrame, dim: int, k: int, target: float) -> tuple[int, dict]:
    """How many leaves to visit, and what was measured."""
    test = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATION_QUERIES + CHECK_QUERIES).toArrow()
    q, q_ids = _matrix(test["q"], dim), test["query_id"].to_numpy()
    true = _nearest(index.mapInArrow(_scan(q, q_ids, k), _FOUND_SQL), k)
    leaves_of: dict[int, list[int]] = {}
    for r in true.select("query_id", "leaf").collect():  # k for each of these queries
        leaves_of.setdefault(r["query_id"], []).append(r["leaf"])
    # of fewer queries than both samples ask for, two thirds calibrate
    own = min(CALIBRATION_QUERIES, -(-2 * len(q) // 3))
    ranks, orders = [[], []], []
    for n, (i, x) in enumerate(zip(q_ids, q, strict=True)):
        orders.append(np.array(tree.visits(x, tree.leaves, 0)))
        at = np.empty(tree.leaves, dtype=np.int64)
        at[orders[-1]] = np.arange(len(orders[-1]))
        ranks[n >= own] += at[leaves_of.get(int(i), [])].tolist()
    fitted, checked = (np.array(r) for r in ranks)
    used = int((held > 0).sum())

    def widen(at: np.ndarray, visits: int) -> int:
        while len(at) and visits < used and (at < visits).mean() < target:
            visits = min(used, max(visits + 1, int(visits * WIDER)))
        return visits

    first = widen(fitted, 1)
    visits = widen(checked, first)
    share = float(np.mean([held[o[:visits]].sum() for o in orders]) / held.sum())
    recall = lambda at, v: float((at < v).mean()) if len(at) else None
    return visits, {
        "dim": dim, "rows": int(held.sum()), "leaves": used, "visits": visits, "share_of_rows": share,
        "recall_calibration": recall(fitted, visits), "recall_held_out": recall(checked, first), "recall_checked": recall(checked, visits),
    }


def _search_length(rows: DataFrame, asked: DataFrame, dim: int, k: int, target: float) -> tuple[DataFrame, list[DataFrame], dict]:
    """The nearest among vectors of one length, the tables that they are read from, and what was measured."""
    tree, index, held = build_index(rows, dim)
    visits, measured = _calibrate(tree, index, held, asked, dim, k, target)

    # Shards of whole leaves that are neighbours; a leaf over the size is cut into several.
    most = max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * dim)))
    cut = np.maximum(1, -(-held // most))
    first, at, load = np.zeros(tree.leaves, dtype=np.int64), 0, 0
    for n in range(tree.leaves):
        if cut[n] > 1 or load + held[n] > most:
            at, load = at + (load > 0), 0
        first[n] = at
        if cut[n] > 1:
            at += int(cut[n])
        else:
            load += int(held[n])

    def visit(batches):
        for batch in batches:
            at, shards, leaves = [], [], []
            for i, x in enumerate(_matrix(batch.column("q"), dim)):
                n = np.sort(np.array(tree.visits(x, visits, k + 1), dtype=np.int32))
                names, cuts = np.unique(first[n], return_index=True)
                at += [i] * len(names)
                shards += names.tolist()
                leaves += np.split(n, cuts[1:])
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(rows), batch.column("q").take(rows), pa.array(shards, pa.int64()), pa.array(leaves, pa.list_(pa.int32()))], names=["query_id", "q", "shard", "leaves"])

    queries = asked.count()
    tasks = max(-(-queries // 20_000), min(-(-queries // 256), 4 * rows.sparkSession.sparkContext.defaultParallelism))
    spread = asked.repartition(max(1, tasks), F.xxhash64("query_id", "q"))
    went = materialise(spread.mapInArrow(visit, "query_id long, q array<double>, shard long, leaves array<int>"), "visits")
    # The queries of a shard are dealt to chunks; a leaf that is cut has the same queries in all its pieces.
    chunk_rows = max(1, CHUNK_BYTES // (8 * dim))
    chunks = np.ones(at + 1, dtype=np.int64)
    for r in went.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per shard, of which there are fewer than leaves
        chunks[r["shard"]] = -(-r["n"] // chunk_rows)
    pieces = np.ones(at + 1, dtype=np.int64)
    pieces[first] = cut

    def deal(batches):
        """Each row of the index to its shard, once for each chunk of queries there."""
        for batch in batches:
            n = batch.column("leaf").to_numpy()
            times = chunks[first[n]]
            rows = np.repeat(np.arange(len(n)), times)
            chunk = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
            shard = (first[n] + batch.column("draw").to_numpy() % cut[n])[rows]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(rows)) for c in ("id", "v", "leaf")], pa.array(shard), pa.array(chunk)], names=["id", "v", "leaf", "shard", "chunk"])

    def send(batches):
        """Each query to its chunk, in every piece of a leaf that is cut."""
        for batch in batches:
            s = batch.column("shard").to_numpy()
            rows = np.repeat(np.arange(len(s)), pieces[s])
            shard = s[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(pieces[s]) - pieces[s], pieces[s])
            chunk = (batch.column("draw").to_numpy() % chunks[s])[rows]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(rows)) for c in ("query_id", "q", "leaves")], pa.array(shard), pa.array(chunk)], names=["query_id", "q", "leaves", "shard", "chunk"])

    draw = lambda *c: F.pmod(F.xxhash64(F.lit("deal"), *c), F.lit(1 << 40)).alias("draw")
    sharded = index.select("id", "v", "leaf", draw("id")).mapInArrow(deal, "id long, v array<double>, leaf int, shard long, chunk long")
    sent = went.select("*", draw("query_id", "q")).mapInArrow(send, "query_id long, q array<double>, leaves array<int>, shard long, chunk long")
    found = sharded.groupBy("shard", "chunk").cogroup(sent.groupBy("shard", "chunk")).applyInArrow(_search(dim, k), _FOUND_SQL)
    return found.select("query_id", "vec_id", "score"), [index, went], measured


def ann_search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", target: float = TARGET_RECALL, report: list[dict] | None = None) -> DataFrame:
    """The ``k`` vectors of largest inner product found for each query, other than those with the query's id.

    Returns ``query_id, rank, vec_id, score``, ties by the smaller id.  Rows whose id or
    vector is null, zero, or has null or non-finite components take no part.  Vectors of
    each length are searched by queries of that length, in an index of their own.  Equal
    rows count once; a query id with several vectors is searched with each, and their
    results are one list.  Other columns are ignored; empty tables give an empty result.

    What was measured for each length is logged, and appended to ``report``: rows, leaves,
    how many are visited, the share of all rows in them, and the recall against brute force of the
    calibration queries and, at the visits that these ask for, of queries held out.
    """
    spark = vectors.sparkSession
    all_rows = usable_vectors(vectors, id_col, vec_col)
    # Of equal vectors the k + 1 smallest ids.
    same = Window.partitionBy(F.xxhash64("v"), F.xxhash64(F.lit("second"), "v")).orderBy("id")
    rows = materialise(all_rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1), "vectors")
    asked = materialise(usable_vectors(queries, id_col, vec_col).select(F.col("id").alias("query_id"), F.col("v").alias("q")), "queries")
    there = {r["dim"] for r in rows.select(F.size("v").alias("dim")).distinct().collect()}  # lengths of vectors, one as a rule
    lengths = sorted(there & {r["dim"] for r in asked.select(F.size("q").alias("dim")).distinct().collect()})
    used, found = [rows, asked], spark.createDataFrame([], "query_id long, vec_id long, score double")
    for dim in lengths:
        part, tables, measured = _search_length(rows.where(F.size("v") == dim), asked.where(F.size("q") == dim), dim, k, target)
        _LOG.info("nearest neighbours: %s", measured)
        if report is not None:
            report.append(measured)
        found = found.unionByName(part)
        used += tables
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    out = materialise(_nearest(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "nearest")
    discard(*used)
    return out

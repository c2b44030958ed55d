"""N-gram Jaccard join by grouped prefixes.

A document's set holds the distinct hashes of its k-word shingles.  Documents
``a`` and ``b`` link when ``den * |a & b| >= num * |a | b|``.  The join runs over
distinct texts:

1. *Rarity.* Texts are dealt into parts.  Each part sends its distinct shingles to
   range buckets, which return the document frequency of those that occur twice or
   more.  A shingle of one document alone can match nothing, so a text with fewer
   than ``num/den`` of its shingles shared is settled here as having no link.
2. *Prefix.* Shingles are ordered by (document frequency, hash), unique ones first.
   Two sets that link share a shingle among the first
   ``n - ceil(num/den * n) + 1`` of each.
3. *Groups.* Texts with the same size, the same number of unique shingles and the
   same shared prefix form one group; groups meet on a prefix shingle, and pairs
   of groups must pass the size and the positional bound.
4. *Expansion.* First a representative of each group is verified, and each
   member against its group's representative; groups whose representatives do
   not link are then expanded to all members and verified exactly.

Since the result is the components, pairs that are already in one component are
never expanded: each posting list is compared with a few of its groups (hubs), the
links found are closed, and the lists that still hold several components go on
with more hubs.  A clique of near copies takes a linear number of comparisons.

Of a list that is longer than that, of documents that share a frequent shingle but mostly do
not link, only those are compared whose places leave room for a link, in blocks over
many tasks.  No link between different components can be missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelstone.llm._common import SHARES, buckets_for, discard, materialise, parts_for, release, spread_join, text_bytes, text_key
from keelstone.llm._words import Buckets, chunks, ngrams, word_hashes
from keelstone.llm.components import connected

#: Groups of a posting list that a round compares with all others; the last round compares longer lists in blocks.
HUBS = (2, 64, None)
#: Members of two groups that are compared all with all if their representatives do not link; larger groups wait for the last round.
SPLIT = 64
#: Documents of a hot list that a task compares with the whole of it, and posts that a hot list has at least.
BLOCK, HOT_POSTS = 256, 4096
#: Hashes of a bucket that are sorted at a time.
BUCKET_KEYS = 4_000_000


def shingle_sets(texts: list[bytes], k: int):
    """The sorted distinct shingle hashes of each text; one for a text of 1 to k-1 words."""
    for run in chunks(texts):
        words, cut = word_hashes(texts[run.start : run.stop])
        grams = ngrams(words, k)
        for i in range(len(run)):
            a, b = cut[i], cut[i + 1]
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield ngrams(words[a:b], b - a)
            else:
                yield np.empty(0, dtype=np.uint64)


def first_copies(batches):
    """Within a task, the text of each key once."""
    seen = set()
    for batch in batches:
        k1, k2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keep = []
        for key in zip(k1, k2, strict=True):
            keep.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(keep, pa.bool_()))
        release()


def dealt_texts(docs: DataFrame, text: str, parts: int) -> DataFrame:
    """Texts with their keys and parts, mostly without exact copies (one of each a task)."""
    keyed = docs.select(*text_key(F.col(text)), F.coalesce(F.col(text), F.lit("")).alias("text"))
    once = keyed.mapInArrow(first_copies, "k1 long, k2 long, text string")
    return once.select(F.pmod(F.xxhash64("k1", "k2"), F.lit(parts)).cast("int").alias("part"), "k1", "k2", "text")


def distinct_texts(table: pa.Table) -> tuple[list[int], list[int], list[bytes]]:
    """Of a part: its distinct keys and lower-cased (A-Z) texts."""
    at = {}
    for i, key in enumerate(zip(table["k1"].to_pylist(), table["k2"].to_pylist(), strict=True)):
        at.setdefault(key, i)
    release(every=16)
    keys = sorted(at)
    texts = table["text"].cast(pa.large_binary()).take(pa.array([at[x] for x in keys], pa.int64())).to_pylist()
    return [x[0] for x in keys], [x[1] for x in keys], texts


_SENT = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])


def _send(buckets: Buckets, k: int):
    def run(table: pa.Table) -> pa.Table:
        _, _, texts = distinct_texts(table)
        sets = list(shingle_sets([t.lower() for t in texts], k))
        keys, counts = np.unique(buckets.keys(np.concatenate(sets)), return_counts=True)
        part = table["part"][0].as_py()
        rows = [(b, part, low.tobytes(), counts[s].astype(np.uint32).tobytes()) for b, s, low in buckets.split(keys)]
        return pa.Table.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True) if rows else ([],) * 4, _SENT, strict=True)], schema=_SENT)

    return run


def ranges(arrays: list[np.ndarray], size: int):
    """Slices of sorted arrays, by ranges of their values, of about ``size`` values together if they are spread evenly."""
    n = max(1, -(-sum(map(len, arrays)) // size))
    low, high = min((int(a[0]) for a in arrays if len(a)), default=0), max((int(a[-1]) for a in arrays if len(a)), default=0)
    edges = np.array([low + (high - low + 1) * i // n for i in range(n)], dtype=np.uint64)
    cuts = [np.append(np.searchsorted(a, edges), len(a)) for a in arrays]
    for i in range(n):
        yield [slice(c[i], c[i + 1]) for c in cuts]


def _count(table: pa.Table) -> pa.Table:
    """Of a bucket: the frequency, as a rank of 255 steps, of shingles in two documents or more."""
    grams = [np.frombuffer(x, np.uint32) for x in table["grams"].to_pylist()]
    counts = [np.frombuffer(x, np.uint32) for x in table["counts"].to_pylist()]
    ranks = [np.zeros(len(g), np.uint8) for g in grams]
    for cut in ranges(grams, BUCKET_KEYS):
        keys, inverse = np.unique(np.concatenate([g[s] for g, s in zip(grams, cut, strict=True)]), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([c[s] for c, s in zip(counts, cut, strict=True)]), minlength=len(keys))
        rank = np.where(total >= 2, np.clip(np.round(np.log2(np.maximum(total, 2)) * 8), 1, 255), 0).astype(np.uint8)
        at = 0
        for r, s in zip(ranks, cut, strict=True):
            r[s] = rank[inverse[at : at + s.stop - s.start]]
            at += s.stop - s.start
    rows = zip(grams, ranks, table["part"].to_pylist(), strict=True)
    out = [(table["bucket"][0].as_py(), part, g[r > 0].tobytes(), r[r > 0].tobytes()) for g, r, part in rows if r.any()]
    return pa.Table.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True) if out else ([],) * 4, _SENT, strict=True)], schema=_SENT)


_NODE = "k1 long, k2 long, n long, own long, prefix array<long>, shared array<long>"
_NODE_ARROW = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("own", pa.int64()), ("prefix", pa.list_(pa.int64())), ("shared", pa.list_(pa.int64()))])


def _rank(buckets: Buckets, k: int, num: int, den: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _NODE_ARROW.empty_table()
        k1, k2, texts = distinct_texts(table)
        known, ranks = np.empty(0, np.uint64), np.empty(0, np.uint8)
        if answers.num_rows:
            order = np.argsort(answers["bucket"].to_numpy())
            grams, counts = answers["grams"].to_pylist(), answers["counts"].to_pylist()
            where = answers["bucket"].to_pylist()
            known = np.concatenate([np.frombuffer(grams[i], np.uint32).astype(np.uint64) + buckets.low[where[i]] for i in order])
            ranks = np.concatenate([np.frombuffer(counts[i], np.uint8) for i in order])
        rows = []
        for a, b, s in zip(k1, k2, shingle_sets([t.lower() for t in texts], k), strict=True):
            n = len(s)
            need = -(-num * n // den)
            prefix = shared = None
            own = n
            if n and len(known):
                keys = buckets.keys(s)
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                own = n - int(hit.sum())
                if n - own >= need:
                    r, s = ranks[at[hit]], s[hit]
                    shared = s[np.lexsort((s, r))].view(np.int64)
                    prefix = shared[: n - need + 1 - own]
            rows.append((a, b, n, own, prefix, shared))
        return pa.Table.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), _NODE_ARROW, strict=True)], schema=_NODE_ARROW)

    return run


def shingle_classes(docs: DataFrame, text: str, k: int, num: int, den: int) -> DataFrame:
    """One row per distinct text: its set's size, and its prefix where it may have a link."""
    total = text_bytes(docs, text)
    parts = parts_for(total)
    buckets = Buckets(buckets_for(total))
    texts = dealt_texts(docs, text, parts)
    sent = texts.groupBy("part").applyInArrow(_send(buckets, k), "bucket int, part int, grams binary, counts binary")
    counted = sent.groupBy("bucket").applyInArrow(_count, "bucket int, part int, grams binary, counts binary")
    return texts.groupBy("part").cogroup(counted.groupBy("part")).applyInArrow(_rank(buckets, k, num, den), _NODE)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs of node keys x and y (a written table), those whose sets link."""
    total = pairs.count()
    left = sets.select(F.col("node").alias("x"), F.col("n").alias("xn"), F.col("shared").alias("xs"))
    right = sets.select(F.col("node").alias("y"), F.col("n").alias("yn"), F.col("shared").alias("ys"))
    # sizes first, so that a text meets only sets that it can link with
    met = spread_join(pairs.select("x", "y"), left, ["x"], ["y"], total)
    met = spread_join(met, right, ["y"], ["x"], total, counts=pairs.groupBy("y").agg(F.count(F.lit(1)).alias("n")))
    both = F.size(F.array_intersect("xs", "ys"))
    return met.where(F.lit(den) * both >= F.lit(num) * (F.col("xn") + F.col("yn") - both)).select("x", "y")


def _live(posts: DataFrame, *more: Column) -> DataFrame:
    """Tokens whose posts (``token, cid``) hold several components, and how many posts they have."""
    stats = posts.groupBy("token").agg(F.min("cid").alias("low"), F.max("cid").alias("high"), F.count(F.lit(1)).alias("size"), *more)
    return stats.where("low <> high").drop("low", "high")


def _possible(num: int, den: int) -> Column:
    """Whether two posts (one with ``h_`` in front) can link, by size and position.

    If this is the first shingle that they share, all others come after it in both; a pair
    that links passes there.
    """
    size = den * F.least("n", "h_n") >= num * F.greatest("n", "h_n")
    most = F.least(F.col("n") - F.col("pos"), F.col("h_n") - F.col("h_pos"))
    return size & ((den + num) * most >= num * (F.col("n") + F.col("h_n")))


def _room(num: int, den: int) -> tuple[Column, Column]:
    """Whether a post's position leaves room for a link at all, and for one with a set that is no smaller.

    The first asks for room for a link with the smallest set that there may be one with; the
    smaller set of a pair that links has to have the second.
    """
    have, need = F.lit(den + num) * (F.col("n") - F.col("pos")), F.ceil(F.lit(num) * F.col("n") / den)
    return have >= num * (F.col("n") + need), have >= 2 * num * F.col("n")


def _candidates(posts: DataFrame, live: DataFrame, hubs: int, num: int, den: int) -> DataFrame:
    """Pairs of subgroups of different components that share a live prefix shingle, one of them a hub, within the bounds.

    Hubs are, of the subgroups that can be the smaller of a pair, those of a shingle with the fewest shingles of their own, as the least
    altered copy of a text has the most links.  Only they are ranked, so no task sorts a whole list.
    """
    rank = Window.partitionBy("token").orderBy("own", "sid")
    hub = posts.where("index").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= hubs).join(live.select("token"), "token")
    hub = hub.select("token", *[F.col(c).alias(f"h_{c}") for c in ("sid", "cid", "n", "pos")])
    met = spread_join(posts, hub, ["token"], ["sid"], posts.count()).where(F.col("h_cid") != F.col("cid"))
    return met.where(_possible(num, den)).select(F.least("sid", "h_sid").alias("sid1"), F.greatest("sid", "h_sid").alias("sid2")).distinct()


def _last_pairs(nodes: DataFrame, comps: DataFrame, tokens: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``x, y`` of nodes of different components that meet in the lists of ``tokens``, within the bounds.

    A node stays in a list only if its position there leaves room for a link with the smallest
    set that it may have one with; the smaller of a pair has to leave room for a link with
    a set of its own size.  Of a hot list blocks of these meet the whole of it, so it is
    shared out over many tasks.
    """
    able, index = _room(num, den)
    posts = nodes.select("node", "n", "own", F.posexplode("prefix").alias("i", "token")).withColumn("pos", F.col("own") + F.col("i")).where(able)
    posts = spread_join(posts.drop("own", "i"), tokens, ["token"], ["node"], nodes.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0)).alias("s")).first()["s"])
    lists = materialise(posts.join(comps.select("node", F.xxhash64("comp").alias("cid")), "node"), "lists")
    # fewer than SHARES lists can hold that large a share of the posts
    often = lists.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.count_if(index).alias("indexed"))
    often = often.where((F.col("size") > HOT_POSTS) & (F.col("size") * SHARES > lists.count()))
    hot = {r["token"]: -(-r["indexed"] // BLOCK) or 1 for r in often.collect()}
    one = lists.where(index).select("token", *[F.col(c).alias(f"h_{c}") for c in ("node", "cid", "n", "pos")], F.lit(0).alias("block"))
    two = lists.select("token", "node", "cid", "n", "pos", F.lit(0).alias("block"))
    if hot:
        blocks, warm = F.element_at(F.create_map(*[F.lit(x) for kv in hot.items() for x in kv]), F.col("token")).cast("int"), F.col("token").isin(*hot)
        one = one.withColumn("block", F.when(warm, F.pmod(F.xxhash64("h_node"), blocks).cast("int")).otherwise(0))
        two = two.where(~warm).unionByName(two.where(warm).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))))
    larger = (F.col("h_n") < F.col("n")) | ((F.col("h_n") == F.col("n")) & (F.col("h_node") < F.col("node")))
    met = one.join(two, ["token", "block"]).where((F.col("h_cid") != F.col("cid")) & larger & _possible(num, den))
    out = materialise(met.select(F.col("h_node").alias("x"), F.col("node").alias("y")).distinct(), "pairs")
    discard(lists)
    return out


def _closed(comps: DataFrame, links: DataFrame) -> DataFrame:
    """New components of all nodes, after links between nodes (a written table)."""
    total = links.count()
    at = spread_join(links, comps.select(F.col("node").alias("x"), F.col("comp").alias("a")), ["x"], ["y"], total)
    at = spread_join(at, comps.select(F.col("node").alias("y"), F.col("comp").alias("b")), ["y"], ["x"], total, counts=links.groupBy("y").agg(F.count(F.lit(1)).alias("n")))
    roots = materialise(connected(at.select("a", "b")).select(F.col("node").alias("comp"), "root"), "roots")
    out = spread_join(comps, roots, ["comp"], ["node"], comps.count(), "left")
    return out.select("node", F.coalesce("root", "comp").alias("comp"))


def class_components(classes: DataFrame, num: int, den: int) -> DataFrame:
    """The component (smallest node key) of every text class that may have links: ``node``, ``comp``."""
    node = F.struct("k1", "k2").alias("node")
    grp = F.struct(F.xxhash64("n", "own", "prefix").alias("g1"), F.xxhash64(F.lit("second"), "n", "own", "prefix").alias("g2")).alias("grp")
    nodes = materialise(classes.where("prefix is not null").select(node, grp, "n", "own", "prefix", "shared"), "nodes")
    used = [nodes]

    def kept(df: DataFrame, name: str) -> DataFrame:
        used.append(materialise(df, name))
        return used[-1]

    def close(comps: DataFrame, pairs: DataFrame) -> DataFrame:
        links = kept(_verified(pairs, nodes, num, den), "links")
        if links.isEmpty():
            return comps
        used.append(comps)
        return materialise(_closed(comps, links), "comps")

    grouped = nodes.select("node", "grp")
    # members against their group's representative
    reps = grouped.groupBy("grp").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("n"))
    star = spread_join(grouped, reps.select("grp", "rep"), ["grp"], ["node"], nodes.count(), counts=reps.select("grp", "n"))
    star = kept(star.where("node <> rep").select(F.col("rep").alias("x"), F.col("node").alias("y")), "star")
    comps = close(materialise(nodes.select("node", F.col("node").alias("comp")), "comps"), star)
    tested = left = None
    for hubs in HUBS:
        subs = nodes.select("node", "grp", "n", "own", "prefix").join(comps, "node").withColumn("sid", F.xxhash64("grp", "comp"))
        member = kept(subs.select("sid", "node"), "members")
        subs = kept(subs.groupBy("sid", "comp").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("n").alias("n"), F.first("own").alias("own"), F.first("prefix").alias("prefix")), "subs")
        posts = subs.select("sid", F.xxhash64("comp").alias("cid"), "m", "n", "own", F.posexplode("prefix").alias("i", "token"))
        able, index = _room(num, den)
        posts = posts.select("token", "sid", "cid", "m", "n", "own", (F.col("own") + F.col("i")).alias("pos"))
        posts = kept(posts.where(able).withColumn("index", index), "posts")
        live = kept(_live(posts, F.max("m").alias("m"), F.count_if("index").alias("indexed")).where("indexed > 0"), "live")
        if hubs is None:
            # lists that no round has compared whole
            rest = live.select("token") if left is None else live.select("token").join(left.select("token"), "token", "left_semi")
            if not rest.isEmpty():
                comps = close(comps, kept(_last_pairs(nodes, comps, rest, num, den), "last"))
            break
        longest = live.agg(F.max("size").alias("s")).first()["s"]
        if longest is None:
            break
        if left is not None:  # what earlier rounds have compared whole
            live = kept(live.join(left.select("token"), "token", "left_semi"), "live")
        met = _candidates(posts, live, hubs, num, den)
        one, two = (subs.select(F.col("sid").alias(f"sid{i}"), F.col("rep").alias(f"rep{i}"), F.col("m").alias(f"m{i}")) for i in (1, 2))
        pairs = met.join(one, "sid1").join(two, "sid2")
        if tested is not None:  # larger groups may have gained members since
            pairs = pairs.join(tested.withColumn("old", F.lit(True)), ["rep1", "rep2"], "left").where("old is null or m1 > 1 or m2 > 1").drop("old")
        pairs = kept(pairs, "pairs")
        comps = close(comps, pairs.select(F.col("rep1").alias("x"), F.col("rep2").alias("y")))
        # small groups whose representatives do not link are expanded to all members; larger ones wait for the last round
        wide = pairs.where(F.greatest("m1", "m2").between(2, SPLIT))
        if not wide.isEmpty():
            root = comps.select(F.col("node").alias("rep1"), F.col("comp").alias("c1"))
            apart = wide.join(root, "rep1").join(root.select(F.col("rep1").alias("rep2"), F.col("c1").alias("c2")), "rep2").where("c1 <> c2")
            both = apart.select(F.col("sid1").alias("sid"), "sid2").join(member, "sid").select(F.col("sid2").alias("sid"), F.col("node").alias("x"))
            both = kept(both.join(member, "sid").select("x", F.col("node").alias("y")).distinct(), "members")
            comps = close(comps, both)
        left = live.where((F.col("indexed") > hubs) | (F.col("m") > SPLIT))
        done = pairs.where("m1 = 1 and m2 = 1").select(F.least("rep1", "rep2").alias("rep1"), F.greatest("rep1", "rep2").alias("rep2"))
        done = done.unionByName(done.select(F.col("rep2").alias("rep1"), F.col("rep1").alias("rep2")))
        tested = done if tested is None else tested.unionByName(done).distinct()
    discard(*used)
    return comps


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Components of documents whose k-word shingle sets have a Jaccard similarity of ``num/den`` or more.

    Returns one row per input row: ``id_col``, ``n_shingles`` (size of the set) and
    ``component_id`` (smallest id that can be reached by links, itself included).
    Words are split at ASCII white space after lower-casing A-Z.  A text of fewer
    than k words, but not none, has one shingle.  A null or empty text has an empty
    set and links with nothing, its copies included.  Rows with equal texts are in
    one component.  A null id is kept, and is a component's id only if all its ids
    are null.  Extra columns are ignored.  An empty table gives an empty result.
    """
    classes = materialise(shingle_classes(docs, text_col, k, num, den), "classes")
    comps = class_components(classes, num, den)
    sized = classes.select(F.struct("k1", "k2").alias("node"), "n").join(comps, "node", "left").select(F.col("node.k1").alias("k1"), F.col("node.k2").alias("k2"), "n", F.coalesce("comp", "node").alias("comp"))
    rows = materialise(docs.select(F.col(id_col).alias("id"), *text_key(F.col(text_col))), "rows")
    copies = rows.groupBy("k1", "k2").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("rows"))
    labelled = materialise(sized.join(copies, ["k1", "k2"]), "labelled")
    discard(classes, comps)
    least = labelled.groupBy("comp").agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("n"))
    best = spread_join(labelled, least.select("comp", "least"), ["comp"], ["k1", "k2"], labelled.count(), counts=least.select("comp", "n"))
    out = spread_join(rows, best.select("k1", "k2", "n", "least"), ["k1", "k2"], ["id"], rows.count(), counts=labelled.select("k1", "k2", F.col("rows").alias("n")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))

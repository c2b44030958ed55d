"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

Every window of ``n`` consecutive item words is a set of word shingles with their
offsets.  Since a window counts only if the whole of it occurs, its necessary prefix
is one shingle: the rarest.  Shingles are ordered by how often they occur in all
documents; a window with a shingle that occurs nowhere is dropped at once.  The
documents' shingles meet the windows' rarest ones, a pair must leave room for the
window on both sides (length and position), and then the words are compared.

Documents are read twice, for the counts and for the windows, whatever the benchmark's
size: up to ``BLOCK_WINDOWS`` windows are broadcast and their words compared on the spot;
beyond, shingles are shuffled, without their documents' words, and the words are compared
in the documents that are still in question.  The items of a window are joined to what
was found, so they travel with no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelstone.llm._common import free_name, hashable, materialise, n_rows, spread_join, text_copies, text_key
from keelstone.llm.url_filter import LOWER, UPPER

#: Words of a shingle, or all words of a shorter window.
SHINGLE = 3
#: Item windows that are broadcast, and shingles for each; at 10 words a window about 50 MB.
BLOCK_WINDOWS = 200_000
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, letters a-z and non-ASCII characters, after lower-casing A-Z."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), _BETWEEN), "")


def _hash(items: Column, i: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(items, i + j) for j in range(size)])


def item_windows(benchmark: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """One row per window of an item: ``window`` (its words), ``wid`` (its identity) and ``item`` (the id as string)."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    count = F.greatest(F.size("w") - n, F.lit(0))
    wins = items.select("item", F.explode_outer(F.transform(F.sequence(F.lit(1), count + 1), lambda i: F.slice(F.col("w"), i, n))).alias("window"))
    wid = F.struct(F.xxhash64("window").alias("a"), F.xxhash64(F.lit("second"), "window").alias("b"))
    return wins.select("item", "window", wid.alias("wid")).distinct()


def _doc_shingles(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """Every shingle of each of the sizes: its hash and place, beside the document's words.

    The outer generator keeps Catalyst from inferring a filter on the array, which
    would be pushed below and split the text again for every word.
    """
    w = F.col("w")

    def of_size(size: int) -> Column:
        return F.transform(w, lambda _, i: F.struct(i.alias("at"), _hash(w, i, size).alias("shingle")))

    spots = of_size(sizes[0]) if len(sizes) == 1 else F.concat(*map(of_size, sizes))
    return docs.select("k1", "k2", "w", spots.alias("h")).select("k1", "k2", "w", F.explode_outer("h").alias("s")).select("k1", "k2", "w", "s.at", "s.shingle")


def window_hits(docs: DataFrame, windows: DataFrame, sizes: list[int], n_windows: int) -> DataFrame:
    """Occurrences of windows (``wid, window``) in documents (``k1, k2, w``): ``k1, k2, start, length, wid``."""
    small = n_windows <= BLOCK_WINDOWS

    def of_size(size: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size("window") - size), lambda i: F.struct(_hash(F.col("window"), i, size).alias("shingle"), i.alias("offset")))

    shingles = F.coalesce(*[F.when(F.least(F.size("window"), F.lit(SHINGLE)) == size, of_size(size)) for size in sizes])
    each = windows.select("wid", F.size("window").alias("length"), F.explode(shingles).alias("s")).select("wid", "length", "s.shingle", "s.offset")
    asked = each.select("shingle").distinct()
    seen = _doc_shingles(docs, sizes).select("shingle")
    # a shingle is counted where it is read, so a frequent one is added up from many counts
    counts = seen.join(F.broadcast(asked), "shingle").groupBy("shingle") if small else seen.groupBy("shingle")
    counts = counts.agg(F.count(F.lit(1)).alias("seen"))
    counts = materialise(counts if small else counts.join(asked, "shingle"), "rarity")
    ranked = each.join(counts, "shingle").groupBy("wid", "length").agg(F.count(F.lit(1)).alias("met"), F.min(F.struct("seen", "offset", "shingle")).alias("rarest"))
    every = F.col("length") - F.least("length", F.lit(SHINGLE)) + 1
    anchors = ranked.where(F.col("met") == every).select("wid", "length", "rarest.shingle", "rarest.offset", "rarest.seen")
    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start + F.col("length") <= F.size("w"))
    same = F.slice("w", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("length")) == F.col("window")
    found = ["k1", "k2", "start", "length", "wid"]
    if small:
        anchors = anchors.drop("seen").join(windows.select("wid", "window"), "wid")
        met = _doc_shingles(docs, sizes).join(F.broadcast(anchors), "shingle").where(fits)
        return met.withColumn("start", start).where(same).select(*found)
    # a shingle that begins many windows meets them in shares of its places
    anchors = materialise(anchors, "anchors")
    often = anchors.groupBy("shingle").agg(F.max("seen").alias("n"))
    places = _doc_shingles(docs, sizes).select("k1", "k2", "at", "shingle", F.size("w").alias("words")).join(anchors.select("shingle").distinct(), "shingle", "left_semi")
    met = spread_join(places, anchors.drop("seen"), ["shingle"], ["k1", "k2", "at"], n_rows(often), counts=often)
    met = met.where((start >= 0) & (start + F.col("length") <= F.col("words"))).select("k1", "k2", start.alias("start"), "length", "wid").distinct()
    met = materialise(met.join(windows.select("wid", "window"), "wid"), "places")
    texts = docs.join(met.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return spread_join(met, texts, ["k1", "k2"], ["start", "wid"], met.count()).where(same).select(*found)


def _covered(spans: Column) -> Column:
    """Words that sorted spans cover together."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum"))

    def step(acc: Column, s: Column) -> Column:
        end = F.greatest(acc["end"], s["start"] + s["length"])
        return F.struct(end.alias("end"), (acc["sum"] + end - F.greatest(acc["end"], s["start"])).alias("sum"))

    return F.aggregate(spans, zero, step)["sum"]


def text_hits(docs: DataFrame, benchmark: DataFrame, n: int, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """One row per distinct text with a hit: ``k1, k2, spans, items, n_hit``.

    Null and empty texts, and items without words, have no hits; an item whose id is null is
    not listed.  Other columns are ignored, whatever their names; empty tables give an
    empty result.
    """
    listed = materialise(item_windows(benchmark, n, item_col, item_text_col), "windows")
    windows = listed.select("wid", "window").dropDuplicates(["wid"])
    shape = windows.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(F.least(F.size("window"), F.lit(SHINGLE)))).alias("sizes")).first()
    texts = docs.select(*text_key(F.col(text_col)), words(F.col(text_col)).alias("w"))
    if not shape["n"]:
        hits = texts.where("false").select("k1", "k2", F.lit(0).alias("start"), F.lit(0).alias("length"), F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("wid"))
    else:
        hits = window_hits(texts, windows, shape["sizes"], shape["n"])
    # every window and place once for each text, whatever its copies
    hits = materialise(hits.distinct(), "hits")
    spans = hits.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"))
    there = hits.select("k1", "k2", "wid").distinct()
    most = there.groupBy("wid").agg(F.count(F.lit(1)).alias("n"))
    items = spread_join(there, listed.select("wid", "item"), ["wid"], ["k1", "k2"], n_rows(most), "left", counts=most)
    items = items.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return spans.join(items, ["k1", "k2"]).withColumn("n_hit", _covered(F.col("spans")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the benchmark windows that occur in each text.

    New columns: ``n_words``; ``n_hit``, the words inside any occurrence of a window;
    ``items``, the sorted ids (as strings) of the items with occurring windows;
    ``spans``, the occurrences as (start, length) in words; ``contaminated``.  A window
    is ``n`` consecutive words of an item; an item of fewer words, but not none, is one
    window.  Null and empty texts have no words and no hits; items without words have
    no window.  An item whose id is null marks words but is not listed.  Repeated
    items count once per id; repeated documents each get their row.  Columns of
    ``docs`` that have one of the new names are replaced.  Empty tables are fine.
    """
    new = {"n_words", "n_hit", "items", "spans", "contaminated"}
    k1, k2 = free_name(docs.columns, "k1"), free_name(docs.columns, "k2")
    keys = [c.alias(name) for c, name in zip(text_key(F.col(text_col)), (k1, k2), strict=True)]
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    own = [F.col(f"`{c}`") for c in names]
    hits = text_hits(docs, benchmark, n, text_col, item_col, item_text_col).withColumnsRenamed({"k1": k1, "k2": k2})
    count = F.size(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")).cast("long")
    rows = docs.select(*own, *keys, count.alias("n_words"))
    none = F.array().cast("array<string>")
    copies = text_copies(docs, text_col).withColumnsRenamed({"k1": k1, "k2": k2})
    # rows of one text are told apart by their other columns
    out = spread_join(rows, hits, [k1, k2], hashable(docs, [c for c in names if c != text_col]), n_rows(copies), "left", counts=copies)
    return out.select(
        *own, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )

"""URL filter: a blocked Bloom filter in front of an exact hash join.

Rules are listed as canonical URL prefixes, ``host + path``.  Each is indexed under
its host and its path up to the last slash.  A URL asks for the keys of all its
host suffixes and path prefixes.  A blocked Bloom filter (eight 32-bit words a
block, one bit in each) passes the possible hits on to a hash join with the rules
themselves, which removes false positives; then the longest rule wins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelstone.llm._common import free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_KEY = 16
WORDS = 8
#: Blocks of a filter that is broadcast (80 bytes each with its key: 40 MB); beyond, it is joined by block.
BROADCAST_BLOCKS = 500_000
#: Rules that are broadcast to the exact join; beyond, it shuffles.
BROADCAST_RULES = 100_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``? #`` or the end; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def _masks(key: Column) -> list[Column]:
    """The bit of a key in each word of its block, from two further hashes."""
    a, b = F.xxhash64(F.lit("a"), key), F.xxhash64(F.lit("b"), key)
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(a if i < 4 else b, 16 * (i % 4)).bitwiseAND(F.lit(31).cast("long")).cast("int")) for i in range(WORDS)]


def bloom_blocks(keys: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """The filter's blocks (``block``, ``w0`` to ``w7``) of a column of keys, and how many there may be."""
    blocks = 1 << max(0, math.ceil(math.log2(max(1, n_keys) * BITS_PER_KEY / (32 * WORDS))))
    words = keys.select(_block(F.col(key), blocks).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(_masks(F.col(key)))])
    return words.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def possible(candidates: DataFrame, key: str, filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """The candidates that the filter does not rule out."""
    side = F.broadcast(filter_blocks) if blocks <= BROADCAST_BLOCKS else filter_blocks
    met = candidates.withColumn("block", _block(F.col(key), blocks)).join(side, "block")
    for i, m in enumerate(_masks(F.col(key))):
        met = met.where(F.col(f"w{i}").bitwiseAND(m) != 0)
    return met.drop("block", *[f"w{i}" for i in range(WORDS)])


def _prefix(path: Column) -> Column:
    """A path up to its last slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def url_filter(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has string columns ``host``, ``path`` and ``verdict``; rules with a null
    host or verdict are left out, a null path is empty.  A rule fits its host and all
    subdomains if the URL's path starts with the rule's.  The longest ``host + path``
    wins, then the longer host, then ``block``.  Without a rule, ``rule`` is null and
    ``verdict`` is ``default``.  A null URL, or one without ``://``, has an empty host
    and path.  Repeated rows stay; columns of ``pages`` that have one of the new names
    are replaced.  Empty tables of pages or rules are fine.
    """
    listed = rules.where("host is not null and verdict is not null").select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
    listed = listed.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
    listed = listed.withColumn("key", F.concat("rule_host", _prefix(F.col("rule_path"))))
    shape = listed.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("rule_path") - F.length(F.replace("rule_path", F.lit("/"), F.lit("")))).alias("depth"), F.max(F.size(F.split("rule_host", r"\."))).alias("labels")).first()
    depth, labels = shape["depth"] or 0, shape["labels"] or 1
    blocks, n_blocks = bloom_blocks(listed, "key", shape["n"])

    new = ("host", "path", "rule", "verdict")
    own = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in new]
    h, p = free_name(pages.columns, "host"), free_name(pages.columns, "path")
    rows = pages.select(*own, url_host(F.col(url_col)).alias(h), url_path(F.col(url_col)).alias(p))
    urls = rows.select(F.col(h).alias("host"), F.col(p).alias("path")).distinct()
    # The last labels of the host and the first directories of the path, as far as any rule goes.
    parts = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda i: F.array_join(F.slice(parts, -i, i), "."))
    slashes = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    deep = F.least(slashes, F.lit(depth))
    prefix = F.transform(F.sequence(F.lit(0), deep), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(F.split("path", "/"), 1, i), "/"), F.lit("/"))))
    asked = urls.select("host", "path", F.explode(suffix).alias("s"), prefix.alias("p")).select("host", "path", "s", F.explode("p").alias("p"))
    asked = asked.select("host", "path", F.concat("s", "p").alias("key"))
    hits = possible(asked, "key", blocks, n_blocks)
    exact = F.broadcast(listed) if shape["n"] <= BROADCAST_RULES else listed
    fits = hits.join(exact, "key").where(F.expr("startswith(path, rule_path)"))
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.col("verdict"))
    won = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), rank).alias("won"))
    won = won.select(F.col("host").alias(h), F.col("path").alias(p), F.col("won.rule").alias("rule"), F.col("won.verdict").alias("verdict"))
    out = rows.join(won, [h, p], "left")
    return out.select(*own, F.col(h).alias("host"), F.col(p).alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))

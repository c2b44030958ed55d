"""Hot keys, hot shingles and lists that no prefix makes short: whole results from bounded work."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelstone.llm import _common, decontamination, ngram_jaccard, substring_dedup
from keelstone.llm.components import connected
from tests.llm.test_operators import brute_components, brute_cut, docs


def test_spread_join_cuts_hot_keys(spark):
    many = spark.range(30_000).select(F.when(F.col("id") < 10_000, 0).otherwise(F.col("id") % 9000).alias("k"), F.col("id").alias("i"))
    few = spark.range(8000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = many.join(few, ["k"], "left")
    out = _common.spread_join(many, few, ["k"], ["i"], 30_000, "left")
    assert sorted(out.columns) == sorted(plain.columns)
    assert out.exceptAll(plain.select(out.columns)).isEmpty() and out.count() == 30_000
    # the largest share of the hot key
    hot = many.groupBy("k").count().where(F.col("count") * _common.SHARES > 30_000)
    assert hot.count() < _common.SHARES
    empty = _common.spread_join(many.limit(0), few, ["k"], ["i"], 0)
    assert empty.count() == 0


def test_a_star_with_a_large_centre(spark):
    links = spark.range(1, 3000).select(F.lit(5000).cast("long").alias("a"), F.col("id").alias("b"))
    links = links.unionByName(spark.range(6000, 8000).select(F.lit(5000).cast("long").alias("a"), F.col("id").alias("b")))
    got = connected(links).toPandas()
    assert len(got) == 2999 + 2000 + 1 and set(got.root) == {1}


def some_texts(seed, n, vocabulary, length):
    """Texts of frequent phrases, so that every shingle of a phrase is in many of them."""
    rng = np.random.default_rng(seed)
    phrases = [" ".join(f"p{i}w{j}" for j in range(6)) for i in range(vocabulary)]
    out = []
    for _ in range(n):
        out.append(" ".join(phrases[i] for i in rng.choice(vocabulary, size=length, replace=False)))
        if rng.random() < 0.3:
            words = out[int(rng.integers(len(out)))].split()
            words[int(rng.integers(len(words)))] = f"x{rng.integers(5)}"
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize("hubs", [(1, None), (None,), (2, 64, None)])
def test_frequent_shingles_lose_no_link(spark, monkeypatch, hubs):
    monkeypatch.setattr(ngram_jaccard, "HUBS", hubs)
    monkeypatch.setattr(ngram_jaccard, "SPLIT", 2)
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 3)
    monkeypatch.setattr(ngram_jaccard, "HOT_POSTS", 2)
    monkeypatch.setattr(ngram_jaccard, "BUCKET_KEYS", 50)
    texts = some_texts(3, 60, 12, 5) + some_texts(4, 40, 30, 12) + ["a b c d e", "a b c d f", "a b c d", "b c d e f", "a b c d e f"]
    got = ngram_jaccard.ngram_jaccard(docs(spark, texts), k=3, num=4, den=5).collect()
    want = brute_components(texts, 3, 4, 5)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(i, *w) for i, w in enumerate(want)]


def test_a_shingle_that_two_thousand_documents_share(spark, monkeypatch):
    # each shares one frequent phrase with all, the rest with one other that is not like it
    hot = "one two three four"
    texts = [f"{hot} " + " ".join(f"a{i // 2}b{j}" if (j // 6) % 2 == i % 2 or j < 6 else f"c{i}d{j}" for j in range(24)) for i in range(2000)]
    texts = [" ".join(t.split()[:10]) for t in texts]
    seen = []
    verified = ngram_jaccard._verified

    def count(pairs, *more):
        seen.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(ngram_jaccard, "_verified", count)
    got = ngram_jaccard.ngram_jaccard(docs(spark, texts), k=4, num=85, den=100).toPandas()
    assert (got.component_id == got.doc_id).mean() > 0.4
    assert sum(seen) < 20 * len(texts)


def test_a_text_of_a_third_of_all_rows(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    texts = [passage if i % 3 == 0 else f"own {i} {passage if i % 50 == 1 else 'text'}" for i in range(900)]
    out = substring_dedup.substring_dedup(docs(spark, texts), keep=["doc_id"])
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()}
    assert got == dict(enumerate(brute_cut(texts, 35)))
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(5, 25)))], "item_id long, text string")
    hit = decontamination.decontaminate(docs(spark, texts), bench, keep=["doc_id"]).toPandas()
    assert len(hit) == 900 and set(hit[hit.contaminated].doc_id) == {i for i in range(900) if passage in texts[i]}

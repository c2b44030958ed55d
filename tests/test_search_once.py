"""Expansion reads a search once, and the search leaves out only pairs that can't be among the nearest."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keelstone.catalog import search
from keelstone.operators import vectors


def test_expansion_searches_once(spark, sf_dir):
    plan = search.v5_pair_expansion(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def _tables(n=160, dim=6):
    rng = np.random.default_rng(7)
    plain = rng.standard_normal((n, dim))
    copies = np.repeat(plain[:4], n // 4, axis=0)
    return {
        "plain": plain, "copies": copies, "near copies": copies + rng.standard_normal(copies.shape) * 1e-7, "far from zero": plain + 1000, "tiny": plain * 1e-4,
        "on a grid": rng.integers(0, 3, (n, dim)).astype(float), "huge": plain * 1e20, "zero": plain * 0, "one is no number": np.where(np.arange(n)[:, None] == 5, np.nan, plain),
    }


@pytest.mark.parametrize("kind", _tables())
@pytest.mark.parametrize("metric", ["l2sq", "l2"])
def test_excluded_pairs_are_not_nearest(kind, metric, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_ROWS", 37)
    monkeypatch.setattr(vectors, "BASE_ROWS", 50)
    x = _tables()[kind]
    for ids in (np.arange(len(x))[::-1].copy(), np.arange(len(x)) // 2, np.array([f"k{i}" for i in range(len(x))], dtype=object)):
        own = pa.array(ids.tolist())
        for k in (1, 4, 1000):
            for most in (4_000_000, 100):
                monkeypatch.setattr(vectors, "MAX_PAIRS", most)
                got = vectors._Base(ids, x).near(own, x, k, metric, 6, True).to_pydict()
                want = {"query_id": [], "id": [], "distance": []}
                for i in range(len(x)):
                    d = ((x[i] - x) ** 2).sum(axis=1)
                    d = np.round(np.sqrt(d) if metric == "l2" else d, 6)
                    top = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
                    want["query_id"] += [ids[i]] * len(top)
                    want["id"] += list(ids[top])
                    want["distance"] += list(d[top])
                assert len(got["id"]) == len(want["id"]) and got["query_id"] == want["query_id"]
                if kind not in ("far from zero", "near copies", "huge") or most > 100 and kind != "huge":
                    assert got["id"] == want["id"]
                    np.testing.assert_allclose(got["distance"], want["distance"], rtol=1e-9, atol=2e-6)


def test_expansion_of_repeats_and_gaps(spark):
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "b"), (2, 2, "z")], "query_id long, rank int, id string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "c"), ("b", "c"), ("b", "a"), ("b", None), ("q", "r")], "at string, other string")
    idioms = spark.createDataFrame([("a", "c"), ("b", "i"), ("b", "i"), ("b", "j")], "at string, idiom string")
    rows = vectors.expand_pairs(hits, pairs, idioms).orderBy("query_id", "pos").select(F.concat_ws(" ", "query_id", "kind", "id", "via")).collect()
    assert [r[0] for r in rows] == [
        "1 hit a", "1 pair c a", "1 idiom c a", "1 hit b", "1 pair b", "1 idiom i b", "1 idiom i b", "1 idiom j b",
        "2 hit b", "2 pair b", "2 pair a b", "2 pair c b", "2 idiom i b", "2 idiom i b", "2 idiom j b", "2 hit z",
    ]

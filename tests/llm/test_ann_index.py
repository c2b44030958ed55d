"""The index of nearest neighbours: recall, growth with the corpus, cut leaves, chunks, several lengths."""

import numpy as np
import pytest

from keelstone.llm import ann
from keelstone.llm.queries import QUERIES
from tests.llm.test_operators import brute_nearest

TABLE = "vec_id long, embedding array<double>"


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], TABLE)


def recall(found, ids, x, k):
    by_query = dict(tuple(found.groupby("query_id")))
    got = [len({i for _, i in brute_nearest(ids, x, q, k)} & set(rows.vec_id)) / min(k, len(ids) - 1) for q, rows in by_query.items()]
    return float(np.mean(got))


def clustered(n, dim=16, seed=4, centres=40):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return c[rng.integers(centres, size=n)] + 0.3 * rng.normal(size=(n, dim))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_on_the_standard_tables(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").toPandas()
    x = np.array(rows.embedding.tolist(), dtype=float)
    found = QUERIES["op9_ann"](spark, f"/root/testdata/{sf}").toPandas()
    assert set(found.query_id) == {i for i in rows.vec_id if i % 20 == 0}
    assert (found.groupby("query_id").size() == 20).all()
    assert recall(found, rows.vec_id.tolist(), x, 20) >= 0.9


def test_what_was_measured_is_reported(spark):
    x = clustered(2000)
    df, report = table(spark, x), []
    found = ann.ann_search(df, df.where("vec_id % 20 = 0"), 10, report=report).toPandas()
    (r,) = report
    assert r["rows"] == 2000 and 0 < r["visits"] < r["leaves"] and r["share_of_rows"] < 0.3
    assert r["recall_calibration"] >= 0.95 and r["recall_checked"] >= 0.95 and 0 < r["recall_held_out"] <= 1
    assert recall(found, list(range(2000)), x, 10) >= 0.9


def test_the_share_of_rows_falls_as_they_grow(spark):
    shares = []
    for n in (500, 8000):
        df, report = table(spark, clustered(n, seed=n)), []
        ann.ann_search(df, df.where(f"vec_id % {n // 50} = 0"), 5, report=report)
        shares.append(report[0]["share_of_rows"])
    assert shares[1] < shares[0] / 2


def test_leaves_beyond_the_sample_are_split(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 64)
    x = clustered(3000)
    df, report = table(spark, x), []
    rows = ann.usable_vectors(df, "vec_id", "embedding").selectExpr("id", "v", "1 as copy")
    tree, index, held = ann.build_index(rows, 16)
    assert held.sum() == 3000 and tree.leaves > 64 and np.median(held[held > 0]) <= 3 * ann.LEAF_ROWS
    assert index.count() == 3000 and index.select("id").distinct().count() == 3000
    assert np.allclose(tree.centres[0], x.mean(axis=0), atol=1e-5) and tree.rows[0] == 3000
    found = ann.ann_search(df, df.where("vec_id % 20 = 0"), 5, report=report).toPandas()
    assert report[0]["share_of_rows"] < 0.3 and recall(found, list(range(3000)), x, 5) >= 0.9


def test_cut_leaves_and_chunks_of_queries_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 7)
    monkeypatch.setattr(ann, "CHUNK_BYTES", 5 * 8 * 4)
    monkeypatch.setattr(ann, "LEAF_ROWS", 60)
    monkeypatch.setattr(ann, "BLOCK_SCORES", 20)
    x = clustered(400, 4)
    df = table(spark, x)
    found = ann.ann_search(df, df.where("vec_id % 10 = 0"), 6, target=1.0).toPandas()
    assert len(found) == 40 * 6
    for q, rows in found.sort_values("rank").groupby("query_id"):
        assert list(rows.vec_id) == [i for _, i in brute_nearest(list(range(400)), x, q, 6)]


def test_each_length_is_searched_by_its_own_queries(spark):
    a, b = clustered(60, 8), clustered(40, 3, seed=9)
    df = table(spark, a).unionByName(table(spark, b, 1000)).unionByName(table(spark, clustered(5, 2), 2001))
    found = ann.ann_search(df, df.where("vec_id % 20 = 0"), 4, target=1.0).toPandas()
    want = {(q, r + 1, i) for ids, x in ((range(60), a), (range(1000, 1040), b)) for q in ids if q % 20 == 0 for r, (_, i) in enumerate(brute_nearest(list(ids), x, q, 4))}
    assert set(zip(found.query_id, found["rank"], found.vec_id, strict=True)) == want

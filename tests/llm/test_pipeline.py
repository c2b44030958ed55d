"""The pipeline's stages against brute force, on the smallest table and on awkward ones."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.test_operators import AWKWARD, LONG, altered, brute_components, brute_cut, brute_hits, check_packed, docs

SF = "/root/testdata/sf0.001"


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's output on the smallest table, collected and given on as a fresh table."""
    df, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["input"] = by_id(df)
    columns = df.columns
    for name, stage in pipeline.STAGES:
        df = stage(spark, df, SF)
        rows = df.collect()
        out[name] = rows if name == "packing" else {r["doc_id"]: r for r in rows}
        if name != "packing":
            assert df.columns == columns and len(rows) == len(out[name])
            df = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    return out


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept, all_ = stages["toxicity"], stages["input"]
    assert set(kept) < set(all_) and all(kept[i] == all_[i] for i in kept)
    toxic = [i for i in all_ if labels.get(i) == 1]
    clean = [i for i in all_ if labels.get(i) == 0]
    assert sum(i not in kept for i in toxic) >= 0.9 * len(toxic) and sum(i in kept for i in clean) >= 0.97 * len(clean)


def test_one_of_each_near_copy_stays(stages):
    before = stages["toxicity"]
    ids = sorted(before)
    found = brute_components([before[i]["text"] for i in ids], 5, 4, 5)
    assert set(stages["near_copies"]) == {i for n, (i, (_, root)) in enumerate(zip(ids, found, strict=True)) if root == n}


def test_repeats_go(stages):
    before = stages["near_copies"]
    want = brute_cut([before[i]["text"] for i in before], 35)
    for i, (n, gone, kept) in zip(before, want, strict=True):
        now = stages["repeated_substrings"][i]
        assert now["text"] == (kept if gone else before[i]["text"]) and now["n_chars"] == (len(kept) if gone else before[i]["n_chars"])
        assert n >= gone


def test_benchmark_documents_go(spark, stages):
    before = stages["repeated_substrings"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute_hits([before[i]["text"] for i in before], items, 10)
    assert set(stages["benchmark_passages"]) == {i for i, (_, n, _) in zip(before, want, strict=True) if not n}


def test_the_rest_is_packed(stages):
    kept = stages["benchmark_passages"]
    check_packed(stages["packing"], {i: r["text"] for i, r in kept.items()}, 4096)


def test_run_is_the_stages_in_turn(spark, stages):
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
    assert sorted(map(key, pipeline.run(spark, SF).collect())) == sorted(map(key, stages["packing"]))


@pytest.mark.parametrize("n", range(len(pipeline.STAGES)))
def test_stages_on_awkward_tables(spark, n):
    name, stage = pipeline.STAGES[n]
    texts = [t for t in AWKWARD if t != LONG] + altered(1, 60, 4, 1)
    d = docs(spark, texts, [*range(len(texts) - 2), None, None]).unionByName(docs(spark, ["same id", "same id", "a b c d e f g"], [3, 3, 3]))
    out = stage(spark, d, SF)
    if name != "packing":
        assert out.columns == d.columns
    assert out.count() > 0
    assert stage(spark, docs(spark, []), SF).count() == 0


def test_near_copies_of_one_id(spark):
    d = docs(spark, ["b text", "a text", "a text", None, None], [1, 1, 1, None, None])
    out = pipeline.near_copies(spark, d, SF)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.select("doc_id", F.col("text")).collect()) == [(0, ""), (0, ""), (1, "a text")]

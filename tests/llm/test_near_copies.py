"""Near copies among rows that share an id."""

import corpus_pipeline as pipeline
from tests.llm.test_operators import docs

SF = "/root/testdata/sf0.001"
A, B, C = ("".join(f"{x}{i} " for i in range(30)) for x in "abc")


def kept(spark, *rows):
    d = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    return sorted((r["doc_id"], r["text"]) for r in pipeline.near_copies(spark, d, SF).collect())


def test_a_text_with_a_repeated_id_keeps_a_document(spark):
    assert kept(spark, (3, A), (5, A), (5, B), (7, B)) == [(3, A), (7, B)]


def test_a_copy_of_a_row_that_goes_stays(spark):
    assert kept(spark, (5, B), (5, C), (7, C)) == [(5, B), (7, C)]


def test_copies_of_different_ids_go(spark):
    assert kept(spark, (2, C), (3, A), (5, A), (7, B), (9, C)) == [(2, C), (3, A), (7, B)]

"""The pipeline's stages, each on its own input."""

from conftest import DATA
from tests.llm.test_native import ITEMS, _contained, _dedup

import corpus_pipeline as pipeline


def _docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_every_stage_returns_documents(spark):
    docs = _docs(spark)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == list(pipeline.COLUMNS), name
        docs = out
    assert pipeline.run(spark, DATA).count() > 0


def test_quality_keeps_good_documents(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = pipeline.quality(spark, _docs(spark), DATA)
    good = labels.where("quality = 1").select("doc_id")
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.03 * good.count()
    bad = labels.where("quality = 0").select("doc_id")
    assert bad.join(kept, "doc_id", "left_semi").count() <= 0.2 * bad.count()


def test_lines_match_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in _docs(spark).collect()]
    got = pipeline.lines(spark, _docs(spark), DATA).collect()
    assert {(r.doc_id, r.text) for r in got} == {k[:2] for k in _dedup(rows)} and all(r.n_chars == len(r.text) for r in got)


def test_copies_go_and_others_stay(spark):
    docs = _docs(spark)
    again = docs.selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars")
    kept = pipeline.near_duplicates(spark, docs.unionByName(again), DATA)
    assert kept.where("doc_id >= 100000").count() == 0
    assert kept.count() == pipeline.near_duplicates(spark, docs, DATA).count()


def test_contaminated_documents_go(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in _docs(spark).collect()]
    hit = {k[0] for k in _contained(rows, items)}
    assert {r.doc_id for r in pipeline.decontaminate(spark, _docs(spark), DATA).collect()} == {i for i, _ in rows} - hit
    assert ITEMS


def test_stages_on_odd_rows(spark, odd, nothing):
    """Nulls, empty and long texts, ties, repeated rows, clashing names and an empty table."""
    for docs in (odd, nothing):
        n = docs.count()
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, DATA)
            assert out.columns[: len(pipeline.COLUMNS)] == list(pipeline.COLUMNS), name
            assert out.count() <= n and (n or not out.count()), name

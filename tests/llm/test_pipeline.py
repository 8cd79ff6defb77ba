"""The pipeline's stages: whole columns, decisions that take effect, clean documents kept."""

import corpus_pipeline
import pytest

from orgloom.llm import queries


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.stored(stage(spark, docs, sf_dir), f"test-{name}")
        out.append((name, docs, path))
        docs = path
    return out


def test_stages(spark, sf_dir, stages):
    assert [s[0] for s in stages] == ["toxicity", "exact_dedup", "jaccard_join", "pii", "packing"]
    for _, before, after in stages[:4]:
        assert after.columns == corpus_pipeline.COLUMNS
        assert after.join(before, "doc_id", "left_anti").count() == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = stages[0][2]
    assert kept.join(labels.filter("toxic = 0"), "doc_id").count() >= 0.99 * labels.filter("toxic = 0").count()
    assert kept.join(labels.filter("toxic = 1"), "doc_id").count() <= 0.3 * labels.filter("toxic = 1").count()
    dedup = stages[1]
    norm = "translate(text, ' \t\n\x0b\x0c\r', '')"
    assert dedup[2].count() == dedup[1].selectExpr(f"{norm} AS t").distinct().count()
    near = stages[2]
    assert near[2].count() == corpus_pipeline.jaccard_join.near_duplicates(near[1]).select("class_id").distinct().count()
    assert stages[3][1].count() == stages[3][2].count()
    assert stages[4][2].select("doc_id").distinct().count() == stages[3][2].count()


def test_every_operator_is_registered():
    names = sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))

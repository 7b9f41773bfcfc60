"""The pipeline's stages one by one, each judged on its own input."""

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from basinframe.llm import near, quality, queries, suffixes


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    tables = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, tables[-1], sf).write.parquet(path)
        tables.append(spark.read.parquet(path))
    return tables


def test_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "repeats", "private", "packing"]
    assert all(t.columns == stages[0].columns for t in stages[1:5])
    assert cp.ORACLE_SQL is None and {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in queries.QUERIES}


def test_each_stage_decides_on_what_it_gets(spark, sf, stages):
    start, good, single, cut, masked, packed = stages
    model = quality.train_line_model(start, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = quality.quality_rules(start, model).where("kept").select("doc_id")
    assert sorted(kept.collect()) == sorted(good.select("doc_id").collect()) and 0 < good.count() < start.count()
    groups = near.near_duplicates(good)
    assert sorted(groups.where("kept").select("doc_id").collect()) == sorted(single.select("doc_id").collect())
    assert single.count() < good.count()
    spans = suffixes.remove_repeats(single).where("size(spans) = 0").select("doc_id")
    same = cut.join(single.withColumnRenamed("text", "before"), "doc_id").where("text = before").select("doc_id")
    assert sorted(spans.collect()) == sorted(same.collect()) and cut.count() == single.count()
    assert cut.where(F.length("text") != F.col("n_chars")).count() == 0
    assert masked.where(F.col("text").rlike(r"[a-z]@[a-z]+\.[a-z]")).count() == 0 and masked.count() == cut.count()
    assert packed.select("doc_id").distinct().count() == masked.count()
    assert packed.where(F.size("ids") != F.col("length")).count() == 0

"""The pipeline against plain versions of its stages, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pricelens.llm import queries

from . import test_contamination, test_similarity

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test data absent")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], SF).write.parquet(str(tmp_path / str(k)))
        tables.append(spark.read.parquet(str(tmp_path / str(k))))
    rows = [{r.doc_id: r.text for r in t.collect()} for t in tables]
    assert [t.columns for t in tables[:-1]] == [columns] * 5
    assert all(tables[k].count() == len(rows[k]) for k in range(6)) and len(rows[1]) < len(rows[0])

    groups = test_similarity.brute(list(rows[1].items()))
    assert set(rows[2]) == {i for i, (_, component, _) in groups.items() if component == i}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    judged = test_contamination.brute(list(rows[2].items()), items)
    assert set(rows[3]) == {r[0] for r in judged if not r[5]} and len(rows[3]) < len(rows[2])

    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = {i for i in rows[3] if i in labels and labels[i].quality and not labels[i].toxic}
    assert len(clean & set(rows[4])) >= 0.95 * len(clean)
    assert all(rows[4][i] == rows[0][i] for i in rows[4])

    final = tables[5].collect()
    assert {r.doc_id for r in final} == set(rows[4])
    by = {}
    for r in final:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 16


def test_registered():
    names = set(entry.queries())
    assert set(queries.QUERIES) <= names and "pipeline" in names
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(queries.ORACLE) <= set(entry.oracle_sql())


def test_empty_and_odd_tables(spark, tmp_path):
    """Empty tables, and rows with nulls, repeated rows and columns with clashing names."""
    from pyspark.sql import functions as F

    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None), (None, ""), (7000, None), (7001, "x y " * 9000), (7001, "x y " * 9000)], "doc_id bigint, text string")
    odd = odd.select("doc_id", "text", *[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes if c not in odd.columns])
    some = docs.limit(60).unionByName(odd)
    for name in ("score", "shard", "p", "tokens", "_id"):
        some = some.withColumn(name, F.lit(name))
    some.write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == [*some.columns, "shard_1", "slot"]
    ids = [r.doc_id for r in found.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) > 10
    some.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

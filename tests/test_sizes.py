"""Tasks that grow in number, not in size, with the tables."""

import glob
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pricelens.operators.resolve import distinct_titles, product_groups
from pricelens.plans.queries import QUERIES
from pricelens.session import shared_dir
from pricelens.sources import tables


@pytest.fixture
def lines(spark, tmp_path, monkeypatch):
    """Tables of 400 order lines and 20 parts; a task is to take 20 lines."""
    monkeypatch.setattr(tables, "ROWS", 20)
    n = F.col("id")
    spark.range(400).select(
        (n / 4).cast("bigint").alias("l_orderkey"), (n % 4).cast("int").alias("l_linenumber"),
        (n % 20).alias("l_partkey"), (n % 7).alias("l_suppkey"), F.lit("2024-01-01").alias("l_shipdate"),
        (n % 15).cast("double").alias("l_quantity"), (n + 1000).cast("double").alias("l_extendedprice"),
        (n % 3).cast("double").alias("l_discount"), F.lit(0.1).alias("l_tax"),
        F.lit("A").alias("l_returnflag"), F.lit("O").alias("l_linestatus"),
    ).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(20).select(
        n.alias("p_partkey"), F.concat(F.lit("red part "), n.cast("string")).alias("p_name"),
        (n % 9).cast("int").alias("p_size"), F.lit(10.0).alias("p_retailprice"),
    ).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def _dealt(df):
    """Numbers of partitions that the plan names itself."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {int(k) for k in re.findall(r"partitioning\([^\n]*?, (\d+)\), REPARTITION_BY_NUM", plan)}


@pytest.mark.parametrize("name", ["dedup_title", "canonical_keys", "variant_counts", "best_offer"])
def test_lines_are_dealt_by_their_number(spark, lines, name):
    assert 20 in _dealt(QUERIES[name](spark, lines))


def test_small_tables_are_dealt_over_all_cores(spark, lines):
    part = tables.table(spark, lines, "part")
    assert tables.parts_of(part) == spark.sparkContext.defaultParallelism
    assert tables.parts_of(part.limit(0)) == spark.sparkContext.defaultParallelism


def test_titles_are_dealt_before_their_keys_are_made(spark, lines):
    rows = tables.offers(spark, lines)
    titles = distinct_titles(rows, parts=37)
    assert 37 in _dealt(titles) and 37 not in _dealt(distinct_titles(rows))
    assert sorted(titles.collect()) == sorted(distinct_titles(rows).collect())
    assert 37 in _dealt(product_groups(rows, parts=37))


def test_anchor_join_makes_keys_once(spark, lines):
    found = QUERIES["anchor_join"](spark, lines)
    assert found.count() > 0
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_stored_by_many_tasks(spark, tmp_path):
    spark.range(40).select(
        F.col("id").alias("page_id"), F.lit("http://a/b").alias("url"),
        F.concat(F.lit("<h1>"), F.col("id").cast("string"), F.lit("</h1>")).alias("html"),
    ).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    place = f"{shared_dir(spark).removeprefix('file:')}/pricelens/*/stream-pages-*/pages"
    before = set(glob.glob(place))
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # a task for each file
    try:
        rows = {r.page_id: (r.times, r.name) for r in QUERIES["stream_pages"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    (root,) = set(glob.glob(place)) - before
    assert len(list(Path(root).glob("*.parquet"))) > 2
    assert rows == {k: (2, f"New {k}") if k % 3 == 0 else (1, str(k)) for k in range(40)}

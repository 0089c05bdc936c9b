"""Layouts, registered tables and the console."""

from pyspark.sql import functions as F

from tessera.console import run_statement
from tessera.operators import relational
from tessera.sources import layout
from tessera.sources.tables import read_table, register


def _cube(spark, prefix=""):
    k = [(F.floor(F.col("id") / 20**n) % 20 + 1).cast("int").alias(f"{prefix}key_{n + 1}") for n in range(3)]
    return spark.range(8000).select(*k).withColumn(f"{prefix}data", F.concat_ws("_", F.lit("test"), *(f"{prefix}key_{n}" for n in (1, 2, 3))))


def test_range_layout_answers_prefix_selections(spark, tmp_path):
    layout.write_range_layout(_cube(spark), f"{tmp_path}/cube.parquet", "key_1", "key_2", "key_3")
    cube = read_table(spark, str(tmp_path), "cube")
    point = relational.select(cube, F.col("key_1") == 1, F.col("key_2") == 2, F.col("key_3") == 3)
    assert [r.data for r in point.collect()] == ["test_1_2_3"]
    assert relational.select(cube, F.col("key_1") == 1).count() == 400
    assert "PushedFilters: [IsNotNull(key_1), EqualTo(key_1,1)]" in relational.select(cube, F.col("key_1") == 1)._jdf.queryExecution().executedPlan().toString()


def test_hash_layouts_join_without_a_shuffle(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS layout_test LOCATION '{tmp_path}'")
    keys = ["key_1", "key_2", "key_3"]
    layout.write_hash_layout(_cube(spark), "layout_test.left", 4, *keys)
    layout.write_hash_layout(_cube(spark, "join_"), "layout_test.right", 4, *[f"join_{k}" for k in keys])
    joined = relational.equi_join(spark.table("layout_test.left"), spark.table("layout_test.right"), [(k, f"join_{k}") for k in keys], "merge")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.where("join_key_1 = 1 AND join_key_2 = 2 AND join_key_3 = 3").count() == 1 and joined.count() == 8000
    layout.warm(spark, "layout_test.left")
    assert spark.catalog.isCached("layout_test.left")
    spark.catalog.uncacheTable("layout_test.left")
    spark.sql("DROP DATABASE layout_test CASCADE")


def test_registered_tables_and_console(spark, tmp_path):
    _cube(spark).write.parquet(f"{tmp_path}/cube.parquet")
    register(spark, str(tmp_path), "cube")
    assert list(run_statement(spark, "SELECT count(*) AS n FROM cube;")) == ["n", "8000", "1 records"]
    assert "TABLE_OR_VIEW_NOT_FOUND" in next(run_statement(spark, "SELECT * FROM missing"))

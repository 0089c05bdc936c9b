"""Operators on the university tables, whose values follow from the rows' formulas."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import aggregates as A
from tessera.functions import arithmetic as X
from tessera.console import run_statement
from tessera.operators import changes, ordered, relational, statistics
from tessera.operators.procedures import ManualAbort, Procedures
from tessera.operators.verify import BadSemantic
from tessera.sources.tables import Views, field_catalog, table_catalog


@pytest.fixture(scope="module")
def student(spark):
    return spark.createDataFrame([(i, f"student{i}", i % 40, i % 50 + 1960) for i in range(900)], "sid int, sname string, majorid int, gradyear int")


@pytest.fixture(scope="module")
def dept(spark):
    return spark.createDataFrame([(i, f"dept{i}") for i in range(40)], "did int, dname string")


def test_aggregates(student):
    row = relational.group_by(student, [], A.greatest("gradyear"), A.least("sid"), A.count("gradyear"), A.average("sid"), A.total("sid"), A.count_distinct("gradyear"))
    assert row.columns == ["maxofgradyear", "minofsid", "countofgradyear", "avgofsid", "sumofsid", "dstcountofgradyear"]
    assert tuple(row.first()) == (2009, 0, 900, 449.5, 404550.0, 50)
    assert [t for _, t in row.dtypes] == ["int", "int", "bigint", "double", "double", "bigint"]


def test_global_aggregate_over_nothing_has_no_row(student):
    assert relational.group_by(student.where("sid < 0"), [], A.count("sid")).count() == 0


def test_groups(student):
    assert relational.group_by(student, ["gradyear"], A.count("sid")).count() == 50
    assert relational.group_by(student, ["gradyear"]).count() == 50


def test_sort(student):
    rows = relational.sort(student, "gradyear", "-sid").collect()
    assert rows == sorted(rows, key=lambda r: (r.gradyear, -r.sid)) and len(rows) == 900


def test_product_and_joins(student, dept):
    assert relational.product(student, dept).count() == 36000
    want = set(range(0, 900, 40))
    for strategy in (None, "broadcast", "merge", "hash", "loop"):
        joined = relational.equi_join(student, dept, [("majorid", "did")], strategy)
        assert joined.count() == 900
        assert {r.sid for r in relational.select(joined, F.col("dname") == "dept0").collect()} == want
    for bad in (lambda: relational.product(student, student), lambda: relational.theta_join(student, student), lambda: relational.equi_join(student, student, [("sid", "sid")])):
        with pytest.raises(BadSemantic, match="ambiguous"):
            bad()


def test_broadcast_is_for_checked_sizes_only(student, dept, monkeypatch):
    assert relational.small_enough(dept, 40) and not relational.small_enough(student, 40)
    assert not relational.small_enough(dept.withColumn("wide", F.repeat(F.lit("x"), 300_000)))
    big = relational.equi_join(student, dept.withColumn("wide", F.repeat(F.lit("x"), 300_000)), [("majorid", "did")], "loop")
    assert "Cartesian" not in big._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(relational, "small_enough", lambda df: False)
    assert "broadcast" not in relational.equi_join(student, dept, [("majorid", "did")], "broadcast")._jdf.queryExecution().logical().toString().lower()


def test_project_gives_a_sorted_set(student):
    assert relational.project(student, "sname", "sid", "sname").columns == ["sid", "sname"]
    assert relational.project(student, "*", "sid").columns == sorted(student.columns)


def test_filter_reaches_the_scan(spark, student, tmp_path):
    student.write.parquet(str(tmp_path / "student"))
    df = relational.select(spark.read.parquet(str(tmp_path / "student")), F.col("majorid") == 30).select("sid")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(majorid,30)" in plan and "ReadSchema: struct<sid:int,majorid:int>" in plan
    assert df.count() == 22


def test_arithmetic(spark):
    row = spark.range(1).select(
        X.div_whole(F.lit(-7), F.lit(2)).alias("a"), X.div_whole(F.lit(7), F.lit(2)).alias("b"), X.div_double(F.lit(1.0), F.lit(0.0)).alias("c"),
        X.div_double(F.lit(-1.0), F.lit(0.0)).alias("d"), X.div_double(F.lit(0.0), F.lit(0.0)).alias("e"), X.concat(F.lit("a"), F.lit("b")).alias("f"),
    ).first()
    assert tuple(row[:4]) == (-3, 3, math.inf, -math.inf) and math.isnan(row.e) and row.f == "ab"


def test_division_follows_the_types(spark):
    df = spark.createDataFrame([(-7, 9007199254740993, 0.0)], "i int, l long, d double")
    out = df.select(X.divide(df, F.col("i"), F.lit(2)).alias("a"), X.divide(df, F.col("l"), F.lit(1)).alias("b"), X.divide(df, F.col("i"), F.col("d")).alias("c"))
    assert tuple(out.first()) == (-3, 9007199254740993, -math.inf) and [t for _, t in out.dtypes] == ["int", "bigint", "double"]
    with pytest.raises(BadSemantic):
        X.divide(df, F.lit("7"), F.lit(1))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        df.select(X.divide(df, F.col("i"), F.lit(0))).collect()


def test_statements_are_verified(student, dept):
    refused = (
        lambda: relational.project(student, "notexisted"), lambda: relational.select(student, ("notexisted", "=", 1)), lambda: relational.select(student, ("sname", "=", 5)),
        lambda: relational.select(student, ("sid", "<", F.lit("5"))), lambda: relational.select(student, F.col("notexisted") == 1), lambda: relational.select(student, F.col("sid")), lambda: relational.select(student, ("sid", "<>", 5)),
        lambda: relational.equi_join(student, dept, [("sname", "did")]), lambda: relational.equi_join(student, dept, [("sid", "notexisted")]), lambda: relational.theta_join(student, dept, ("sname", "<", "did")),
        lambda: relational.group_by(student, ["notexisted"]), lambda: relational.group_by(student, ["majorid"], A.count("notexisted")), lambda: relational.group_by(student, [], A.total("sname")),
        lambda: relational.group_by(student, [], A.average("sname")), lambda: relational.sort(student, "notexisted"), lambda: relational.sort(relational.group_by(student, ["majorid"], A.count("sid")), "gradyear"),
        lambda: changes.insert_rows(dept, ["did"], [(1,)]), lambda: changes.insert_rows(dept, ["did", "notexisted"], [(1, "x")]), lambda: changes.insert_rows(dept, ["did", "dname"], [("x", "y")]),
        lambda: changes.insert_rows(dept, ["did", "dname"], [(1, 2)]), lambda: changes.insert_rows(dept, ["did", "dname"], [(1,)]), lambda: changes.update_where(student, {"notexisted": F.lit(1)}),
        lambda: changes.update_where(student, {"gradyear": X.add(F.col("notexisted"), F.lit(1))}), lambda: changes.update_where(student, {"gradyear": F.lit("x")}), lambda: changes.update_where(student, {"sid": F.lit(1)}, ("notexisted", "=", 1)),
        lambda: changes.delete_where(student, ("notexisted", "=", 1)), lambda: statistics.maxdiff_histogram(student, "notexisted"), lambda: statistics.maxdiff_area_histogram(student, "sname"),
    )
    for k, statement in enumerate(refused):
        with pytest.raises(BadSemantic):
            statement()
            pytest.fail(f"statement {k} was taken")
    counted = relational.sort(relational.group_by(relational.select(student, ("majorid", ">=", 10), (10, ">=", "majorid")), ["gradyear"], A.count("sid")), "countofsid")
    assert counted.count() == 5


def test_changes(student):
    assert changes.delete_where(student, F.col("majorid") == 10).count() == 877
    assert changes.delete_where(student).count() == 0
    done = changes.update_where(student, {"majorid": F.lit(-1.0), "sname": F.lit("kkkkk")}, ("majorid", "=", 10))
    assert done.schema["majorid"].dataType == student.schema["majorid"].dataType
    assert done.where("majorid = -1 AND sname = 'kkkkk'").count() == 23
    assert changes.affected_rows(student, ("majorid", "=", 10)).first()[0] == 23 and changes.affected_rows(student).first()[0] == 900
    swapped = changes.update_where(student, {"sid": F.col("majorid"), "majorid": F.col("sid")}, F.col("sid") == 41)
    assert swapped.where("sid = 1 AND majorid = 41").count() == 1
    more = changes.insert_rows(student, ["gradyear", "sid", "sname", "majorid"], [(2001, -1, "new", 3)])
    assert more.where("sid = -1 AND gradyear = 2001").count() == 1


@pytest.fixture
def database(spark, tmp_path):
    spark.sql(f"CREATE DATABASE changes_test LOCATION '{tmp_path}'")
    yield "changes_test"
    spark.sql("DROP DATABASE changes_test CASCADE")


def test_published_tables(spark, dept, database, monkeypatch):
    dept.write.saveAsTable("changes_test.dept")
    assert changes.delete_from(spark, "changes_test.dept", ("did", "<", 10)) == 10 and changes.delete_from(spark, "changes_test.dept", ("did", "<", 10)) == 0
    assert changes.update(spark, "changes_test.dept", {"dname": F.lit("new")}, ("did", "<", 15)) == 5
    assert changes.publish(spark, "changes_test.dept", changes.insert_rows(spark.table("changes_test.dept"), ["dname", "did"], [("x", 99)])) == 31
    assert spark.table("changes_test.dept").where("dname = 'new'").count() == 5
    before = spark.table("changes_test.dept")
    with pytest.raises(Exception, match="raise_error|failed|boom"):  # while the new content is written
        changes.publish(spark, "changes_test.dept", before.select(F.expr("if(did = 99, raise_error('boom'), did)").alias("did"), "dname"))
    assert spark.table("changes_test.dept").count() == 31


def test_views_and_catalog(spark, student, dept, tmp_path):
    views = Views({"student": student, "dept": dept})
    views.create("cs", lambda s, d: relational.equi_join(s, d, [("majorid", "did")]).where("dname = 'dept0'"), "student", "dept")
    views.create("old", lambda x: x.where("gradyear < 1970"), "cs")
    assert views["cs"].count() == 23
    with pytest.raises(ValueError):
        views.create("dept", lambda s: s, "student")
    views.drop("dept")
    assert set(views.made) == set() and "student" in views.tables
    for name, df in (("student", student), ("dept", dept)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert [r.tblname for r in table_catalog(spark, str(tmp_path)).collect()] == ["dept", "student"]
    assert [tuple(r) for r in field_catalog(spark, str(tmp_path)).where("tblname = 'dept'").collect()] == [("dept", "did", "int"), ("dept", "dname", "varchar")]
    dept.withColumn("more", F.lit(1.5)).write.mode("overwrite").parquet(f"{tmp_path}/dept.parquet")
    assert ("dept", "more", "double") in [tuple(r) for r in field_catalog(spark, str(tmp_path)).collect()]


def test_procedures(spark, student, dept, database):
    dept.write.saveAsTable("changes_test.dept")
    procedures = Procedures()
    procedures.register(1, lambda spark, changed, major: relational.group_by(student.where(F.col("majorid") == major), ["majorid"], A.count("sid")))

    def removes(spark, changed, most, gives_up):
        changed["changes_test.dept"] = changes.delete_where(spark.table("changes_test.dept"), ("did", "<", most))
        if gives_up:
            raise ManualAbort

    procedures.register(2, removes)
    procedures.register(3, lambda spark, changed: student)
    committed, row = procedures.call(spark, 1, 10)
    assert committed and row.first().countofsid == 23
    assert procedures.call(spark, 2, 10, True) == (False, None) and spark.table("changes_test.dept").count() == 40
    assert procedures.call(spark, 2, 10, False) == (True, None) and spark.table("changes_test.dept").count() == 30
    for number, error in ((3, ValueError), (4, KeyError)):
        with pytest.raises(error):
            procedures.call(spark, number)


def test_console(spark):
    lines = list(run_statement(spark, "SELECT id, id % 2 AS odd FROM range(250);"))
    assert lines[:2] == ["id\todd", "0\t0"] and lines[-1] == "250 records" and len(lines) == 252
    assert list(run_statement(spark, "CREATE OR REPLACE TEMP VIEW console_test AS SELECT 1")) == ["done"]
    assert "TABLE_OR_VIEW_NOT_FOUND" in list(run_statement(spark, "SELECT * FROM no_such_table"))[0]


def test_counts_of_greater_pairs(spark):
    left = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 5.0), ("c", 9.0), ("a", None), (None, 0.0)], "k string, v double")
    right = spark.createDataFrame([(1.0,), (2.0,), (5.0,), (6.0,), (6.0,), (None,)], "w double")
    got = {r.k: r.n for r in relational.count_greater(left, "k", "v", right, "w", "n").collect()}
    assert got == {"a": 6, "b": 2, None: 5}


def test_running_totals_and_neighbours_over_many_ranges(spark):
    df = spark.createDataFrame([(k * k % 1009, k) for k in range(0, 505)], "v int, n int").dropDuplicates(["v"]).repartition(7)
    rows = sorted((r.v, r.n) for r in df.collect())
    got = sorted((r.v, r["_up_to"], r["_all"]) for r in ordered.running_totals(df, "v", "n").collect())
    total = 0
    for (v, n), row in zip(rows, got):
        total += n
        assert row == (v, total, sum(n for _, n in rows))
    near = sorted((r["_rank"], r.v, r["_last"], r["_last_n"], r["_next"]) for r in ordered.with_neighbours(df, "v", "n").collect())
    assert near == [(k + 1, v, rows[k - 1][0] if k else None, rows[k - 1][1] if k else None, rows[k + 1][0] if k + 1 < len(rows) else None) for k, (v, _) in enumerate(rows)]


def test_explain(student):
    text = relational.explain(student.where("majorid = 10")).first()["query-plan"]
    assert text.endswith("Actual #recs: 23")


R12 = [(10, 15)] * 10 + [(10, 20)] * 10 + [(10, 25)] * 10 + [(15, 15)] * 65 + [(15, 20)] * 15 + [(15, 25)] * 40 + [(20, 15)] * 75 + [(20, 20)] * 5 + [(20, 25)] * 10 + [(50, 50)] * 60


R3 = [12] * 10 + [16] * 30 + [20] * 20 + [24] * 20 + [28] * 40
R4 = [1, 2] + [12] * 10 + [13] * 10 + [14] * 10 + [28] * 40 + [400]


def test_maxdiff_area_histograms(spark):
    def buckets(values, n):
        df = spark.createDataFrame([(v,) for v in values], "v int")
        return sorted((r.frequency, r.low, r.high, r.n_distinct) for r in statistics.maxdiff_area_histogram(df, "v", n).collect())

    assert buckets([a for a, _ in R12], 3) == [(30, 10, 10, 1), (60, 50, 50, 1), (210, 15, 20, 2)]
    assert buckets([b for _, b in R12], 3) == [(60, 50, 50, 1), (90, 20, 25, 2), (150, 15, 15, 1)]
    assert buckets(R3, 3) == [(10, 12, 12, 1), (40, 28, 28, 1), (70, 16, 24, 3)]
    assert buckets(R4, 4) == [(1, 400, 400, 1), (2, 1, 2, 2), (30, 12, 14, 3), (40, 28, 28, 1)]
    assert buckets([7, 7], 3) == [(2, 7, 7, 1)] and buckets([], 3) == []


def test_histograms_count_all_rows_and_estimate_ranges(spark):
    df = spark.range(20000).select((F.col("id") % 4000).cast("int").alias("v"))
    for build in (statistics.maxdiff_histogram, statistics.maxdiff_area_histogram):
        made = build(df, "v", 4)
        assert tuple(made.agg(F.sum("frequency"), F.sum("n_distinct"), F.min("low"), F.max("high")).first()) == (20000, 4000, 0, 3999)
    assert abs(statistics.estimated_range(statistics.maxdiff_area_histogram(df, "v", 1), 1000, 1999).first()[0] - 5000) < 10
    text = spark.createDataFrame([(chr(97 + k % 10),) for k in range(95)], "v string")
    assert statistics.maxdiff_histogram(text, "v", 3).agg(F.sum("frequency")).first()[0] == 95


def test_maxdiff_histograms(spark):
    df = spark.createDataFrame(R12, "f1 int, f2 int")

    def buckets(field, n):
        return sorted((r.frequency, r.low, r.high, r.n_distinct) for r in statistics.maxdiff_histogram(df, field, n, 2).collect())

    assert buckets("f1", 3) == [(30, 10, 10, 1), (120, 15, 15, 1), (150, 20, 50, 2)]
    assert buckets("f2", 3) == [(30, 20, 20, 1), (120, 25, 50, 2), (150, 15, 15, 1)]
    f4 = spark.createDataFrame([(x,) for x in [1, 2] + [12] * 10 + [13] * 10 + [14] * 10 + [28] * 40 + [400]], "f4 int")
    rows = {r.low: r for r in statistics.maxdiff_histogram(f4, "f4", 3, 5).collect()}
    assert {k: (r.frequency, r.high, r.n_distinct) for k, r in rows.items()} == {400: (1, 400, 1), 28: (40, 28, 1), 1: (32, 14, 5)}
    assert [(p.v, round(p.share, 1)) for p in rows[1].percentiles] == [(1, 0.2), (2, 0.4), (12, 0.6), (13, 0.8), (14, 1.0)]


def test_column_statistics(student):
    rows = {r.field: r for r in statistics.column_statistics(student, "gradyear", "sname").collect()}
    assert (rows["gradyear"].n_rows, rows["gradyear"].n_distinct, rows["gradyear"].low, rows["gradyear"].high) == (900, 50, "1960", "2009")
    assert rows["sname"].n_distinct == 900

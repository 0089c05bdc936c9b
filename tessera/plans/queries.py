"""The relational queries by name: a DataFrame plan and the SQL that gives the same rows.

A plan gets ``t``, which gives a table's DataFrame by name. Sums of money go through decimals and averages are
rounded, so that the order of additions doesn't show.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import aggregates as A
from tessera.functions import arithmetic as X
from tessera.operators import changes, relational, statistics
from tessera.operators.procedures import Procedures
from tessera.sources.tables import Views, field_catalog, read_table, table_catalog

Tables = Callable[[str], DataFrame]
PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

c = F.col


def plan(name: str, sql: str | None, build: Callable[[Tables], DataFrame]) -> None:
    PLANS[name] = build
    if sql:
        SQL[name] = sql


def _rounded(df: DataFrame, *fields: str) -> DataFrame:
    return df.withColumns({f: F.round(f, 6) for f in fields})


# Scans and projections
plan("table_scan", "SELECT * FROM nation", lambda t: t("nation"))
plan("project", "SELECT n_name, n_regionkey FROM nation", lambda t: relational.project(t("nation"), "n_regionkey", "n_name", "n_name"))
plan("select_star", "SELECT r_name, r_regionkey FROM region", lambda t: relational.project(t("region"), "*"))

# Selections
_ORDER = ("o_orderkey", "o_totalprice", "o_orderstatus")


def _orders(terms: Callable[[], list[Column]]) -> Callable[[Tables], DataFrame]:
    return lambda t: relational.select(t("orders").select(*_ORDER), *terms())


_FROM_ORDERS = "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE "
for _name, _sql, _terms in (
    ("filter_eq", "o_orderkey = 7", lambda: [c("o_orderkey") == 7]),
    ("filter_lt", "o_totalprice < 5000", lambda: [c("o_totalprice") < 5000]),
    ("filter_lte", "o_orderkey <= 100", lambda: [c("o_orderkey") <= 100]),
    ("filter_gt", "o_totalprice > 300000", lambda: [c("o_totalprice") > 300000]),
    ("filter_gte", "o_orderkey >= 9000", lambda: [c("o_orderkey") >= 9000]),
    ("filter_conjunction", "o_totalprice > 1000 AND o_orderstatus = 'F' AND o_orderkey < 5000", lambda: [c("o_totalprice") > 1000, c("o_orderstatus") == "F", c("o_orderkey") < 5000]),
    ("filter_const_left", "1000 < o_totalprice", lambda: [F.lit(1000) < c("o_totalprice")]),
    ("filter_const_const", "1 = 1", lambda: [F.lit(1) == F.lit(1)]),
    ("filter_varchar_eq", "o_orderstatus = 'O'", lambda: [c("o_orderstatus") == "O"]),
    ("filter_varchar_range", "o_orderstatus >= 'G' AND o_orderstatus < 'P'", lambda: [c("o_orderstatus") >= "G", c("o_orderstatus") < "P"]),
    ("point_select", "o_orderkey = 42", lambda: [c("o_orderkey") == 42]),
    ("range_select", "o_orderkey > 100 AND o_orderkey <= 900", lambda: [c("o_orderkey") > 100, c("o_orderkey") <= 900]),
):
    plan(_name, _FROM_ORDERS + _sql, _orders(_terms))
plan(
    "filter_field_field", "SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM lineitem WHERE l_tax < l_discount",
    lambda t: relational.select(t("lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount"), c("l_tax") < c("l_discount")),
)

# Joins
plan("cross_product", "SELECT * FROM region, nation", lambda t: relational.product(t("nation"), t("region")))
plan(
    "theta_join", "SELECT p_brand, count(s_suppkey) AS countofs_suppkey FROM part, supplier WHERE p_retailprice < s_acctbal GROUP BY p_brand",
    lambda t: relational.count_greater(t("part"), "p_brand", "p_retailprice", t("supplier"), "s_acctbal", "countofs_suppkey"),
)
plan(
    "theta_join_pairs", "SELECT p_partkey, s_suppkey FROM part, supplier WHERE p_size = 7 AND p_retailprice < s_acctbal AND p_partkey < s_suppkey",
    lambda t: relational.theta_join(
        relational.select(t("part"), ("p_size", "=", 7)), t("supplier"), ("p_retailprice", "<", "s_acctbal"), ("p_partkey", "<", "s_suppkey")
    ).select("p_partkey", "s_suppkey"),
)
_JOIN_SQL = "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey"


def _joined(strategy: str | None) -> Callable[[Tables], DataFrame]:
    def build(t: Tables) -> DataFrame:
        sides = t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), t("customer").select("c_custkey", "c_name")
        return relational.equi_join(*sides, [("o_custkey", "c_custkey")], strategy).select("o_orderkey", "c_name", "o_totalprice")

    return build


for _name, _strategy in (("equi_join", None), ("join_broadcast", "broadcast"), ("join_merge", "merge"), ("join_shuffle_hash", "hash")):
    plan(_name, _JOIN_SQL, _joined(_strategy))
plan(
    "join_nested_loop", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    lambda t: relational.equi_join(t("nation"), t("region"), [("n_regionkey", "r_regionkey")], "loop").select("n_name", "r_name"),
)
plan(
    "multi_key_join", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey = c_custkey",
    lambda t: relational.equi_join(t("supplier"), t("customer"), [("s_nationkey", "c_nationkey"), ("s_suppkey", "c_custkey")]).select("s_suppkey", "c_custkey"),
)
plan(
    "join_3way", "SELECT c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 5000",
    lambda t: relational.equi_join(
        relational.equi_join(relational.select(t("customer"), c("c_acctbal") > 5000), t("nation"), [("c_nationkey", "n_nationkey")]), t("region"), [("n_regionkey", "r_regionkey")]
    ).select("c_name", "n_name", "r_name"),
)


def star_join(t: Tables) -> DataFrame:
    """Revenue and orders by nation: four tables, a filter, a group."""
    orders = relational.select(t("orders"), c("o_totalprice") > 1000)
    rows = relational.equi_join(orders, t("customer"), [("o_custkey", "c_custkey")])
    rows = relational.equi_join(rows, t("nation"), [("c_nationkey", "n_nationkey")])
    rows = relational.equi_join(rows, t("region"), [("n_regionkey", "r_regionkey")])
    return relational.group_by(rows, ["n_name"], A.count("o_orderkey"), A.exact_total("o_totalprice"))


_STAR_SQL = """
SELECT n_name, count(o_orderkey) AS countofo_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS sumofo_totalprice
FROM customer, orders, nation, region
WHERE c_custkey = o_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND o_totalprice > 1000 GROUP BY n_name
"""
plan("join_4way_star", _STAR_SQL, star_join)
plan(
    "group_after_join", "SELECT c_mktsegment, o_orderstatus, count(o_orderkey) AS countofo_orderkey, max(o_totalprice) AS maxofo_totalprice FROM orders, customer WHERE o_custkey = c_custkey GROUP BY c_mktsegment, o_orderstatus",
    lambda t: relational.group_by(
        relational.equi_join(t("orders"), t("customer"), [("o_custkey", "c_custkey")]), ["c_mktsegment", "o_orderstatus"], A.count("o_orderkey"), A.greatest("o_totalprice")
    ),
)

# Aggregates
for _name, _sql, _agg in (
    ("agg_count", "count(l_orderkey) AS countofl_orderkey", lambda: A.count("l_orderkey")),
    ("agg_count_distinct", "count(DISTINCT l_suppkey) AS dstcountofl_suppkey", lambda: A.count_distinct("l_suppkey")),
    ("agg_sum", "CAST(sum(CAST(l_quantity AS DOUBLE)) AS DOUBLE) AS sumofl_quantity", lambda: A.total("l_quantity")),  # whole numbers: exact in any order
    ("agg_sum_decimal", "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sumofl_extendedprice", lambda: A.exact_total("l_extendedprice")),
    ("agg_min", "min(l_quantity) AS minofl_quantity", lambda: A.least("l_quantity")),
    ("agg_max", "max(l_shipdate) AS maxofl_shipdate", lambda: A.greatest("l_shipdate")),
):
    plan(_name, f"SELECT l_returnflag, {_sql} FROM lineitem GROUP BY l_returnflag", lambda t, a=_agg: relational.group_by(t("lineitem"), ["l_returnflag"], a()))
plan(
    "agg_avg", "SELECT l_returnflag, round(avg(l_discount), 6) AS avgofl_discount FROM lineitem GROUP BY l_returnflag",
    lambda t: _rounded(relational.group_by(t("lineitem"), ["l_returnflag"], A.average("l_discount")), "avgofl_discount"),
)
plan(
    "agg_all_global",
    "SELECT count(o_orderkey) AS countofo_orderkey, count(DISTINCT o_custkey) AS dstcountofo_custkey, "
    "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS sumofo_totalprice, round(avg(o_totalprice), 4) AS avgofo_totalprice, "
    "min(o_totalprice) AS minofo_totalprice, max(o_totalprice) AS maxofo_totalprice FROM orders HAVING count(*) > 0",
    lambda t: relational.group_by(
        t("orders"), [], A.count("o_orderkey"), A.count_distinct("o_custkey"), A.exact_total("o_totalprice"), A.average("o_totalprice"), A.least("o_totalprice"), A.greatest("o_totalprice")
    ).withColumn("avgofo_totalprice", F.round("avgofo_totalprice", 4)),
)
plan(
    "agg_global_empty", "SELECT count(l_tax) AS countofl_tax FROM lineitem WHERE l_tax < 0 HAVING count(*) > 0",
    lambda t: relational.group_by(relational.select(t("lineitem"), c("l_tax") < 0), [], A.count("l_tax")),
)
plan("min_max_varchar", "SELECT min(p_brand) AS minofp_brand, max(p_brand) AS maxofp_brand FROM part HAVING count(*) > 0", lambda t: relational.group_by(t("part"), [], A.least("p_brand"), A.greatest("p_brand")))
plan("group_by_one", "SELECT p_brand, count(p_partkey) AS countofp_partkey FROM part GROUP BY p_brand", lambda t: relational.group_by(t("part"), ["p_brand"], A.count("p_partkey")))
plan(
    "group_by_multi",
    "SELECT l_returnflag, l_linestatus, count(l_orderkey) AS countofl_orderkey, count(DISTINCT l_suppkey) AS dstcountofl_suppkey, "
    "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sumofl_extendedprice, round(avg(l_discount), 6) AS avgofl_discount, "
    "min(l_quantity) AS minofl_quantity, max(l_tax) AS maxofl_tax FROM lineitem GROUP BY l_returnflag, l_linestatus",
    lambda t: _rounded(relational.group_by(
        t("lineitem"), ["l_returnflag", "l_linestatus"], A.count("l_orderkey"), A.count_distinct("l_suppkey"), A.exact_total("l_extendedprice"), A.average("l_discount"), A.least("l_quantity"), A.greatest("l_tax")
    ), "avgofl_discount"),
)
plan("group_by_distinct", "SELECT DISTINCT p_brand, p_size FROM part", lambda t: relational.group_by(t("part"), ["p_brand", "p_size"]))

# Sorting
plan("sort_asc", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey", lambda t: relational.sort(t("customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey"))
plan("sort_desc", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey DESC", lambda t: relational.sort(t("customer").select("c_custkey", "c_name"), "-c_custkey"))
plan("sort_multi_mixed", "SELECT p_brand, p_partkey, p_size FROM part ORDER BY p_brand, p_size DESC, p_partkey", lambda t: relational.sort(t("part").select("p_brand", "p_partkey", "p_size"), "p_brand", "-p_size", "p_partkey"))
plan(
    "sort_by_aggregate", "SELECT c_mktsegment, count(c_custkey) AS countofc_custkey FROM customer GROUP BY c_mktsegment ORDER BY countofc_custkey",
    lambda t: relational.sort(relational.group_by(t("customer"), ["c_mktsegment"], A.count("c_custkey")), "countofc_custkey"),
)

# Arithmetic
plan(
    "arith_div_long", "SELECT p_partkey, (9007199254740993 + p_partkey) // p_size AS result FROM part",  # beyond 2**53
    lambda t: t("part").select("p_partkey", X.divide(t("part"), F.lit(9007199254740993) + c("p_partkey"), c("p_size")).alias("result")),
)
plan("arith_div_ints", "SELECT p_partkey, CAST((p_size - 25) // 7 AS INT) AS result FROM part", lambda t: t("part").select("p_partkey", X.divide(t("part"), c("p_size") - 25, F.lit(7)).alias("result")))
for _name, _table, _sql, _column in (
    ("arith_add", "part", "p_partkey, p_size + 5 AS result", lambda: X.add(c("p_size"), F.lit(5))),
    ("arith_sub", "part", "p_partkey, p_retailprice - 0.5::DOUBLE AS result", lambda: X.sub(c("p_retailprice"), F.lit(0.5))),
    ("arith_mul", "part", "p_partkey, p_size * 3 AS result", lambda: X.mul(c("p_size"), F.lit(3))),
    ("arith_div_int", "part", "p_partkey, CAST(trunc((p_partkey - 500) / 7.0) AS BIGINT) AS result", lambda: X.div_whole(c("p_partkey") - 500, F.lit(7))),
    ("arith_div_double", "part", "p_partkey, CASE WHEN p_size = 10 THEN 'Infinity'::DOUBLE ELSE p_retailprice / (p_size - 10) END AS result", lambda: X.div_double(c("p_retailprice"), c("p_size") - 10)),
    ("arith_concat", "part", "p_partkey, p_brand || p_type AS result", lambda: X.concat(c("p_brand"), c("p_type"))),
):
    plan(_name, f"SELECT {_sql} FROM {_table}", lambda t, n=_table, x=_column: t(n).select("p_partkey", x().alias("result")))


# Views
def _views(t: Tables) -> Views:
    views = Views({n: t(n) for n in ("customer", "nation", "orders")})
    views.create("rich", lambda x: relational.select(x, c("c_acctbal") > 8000).select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), "customer")
    views.create("by_nation", lambda x: relational.group_by(x, ["c_nationkey"], A.count("c_custkey"), A.greatest("c_acctbal")), "rich")
    return views


_RICH = "(SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 8000)"
plan("view_basic", f"SELECT * FROM {_RICH}", lambda t: _views(t)["rich"])
plan("view_filtered", f"SELECT c_custkey, c_acctbal FROM {_RICH} WHERE c_nationkey < 5", lambda t: relational.select(_views(t)["rich"], c("c_nationkey") < 5).select("c_custkey", "c_acctbal"))
plan(
    "view_join_table", f"SELECT c_name, n_name FROM {_RICH}, nation WHERE c_nationkey = n_nationkey",
    lambda t: relational.equi_join(_views(t)["rich"], t("nation"), [("c_nationkey", "n_nationkey")]).select("c_name", "n_name"),
)
plan(
    "view_aggregate", f"SELECT c_nationkey, count(c_custkey) AS countofc_custkey, max(c_acctbal) AS maxofc_acctbal FROM {_RICH} GROUP BY c_nationkey",
    lambda t: _views(t)["by_nation"],
)

# Changes
plan(
    "insert_visible", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 99, 'ATLANTIS', 3",
    lambda t: changes.insert_rows(t("nation"), ["n_name", "n_regionkey", "n_nationkey"], [("ATLANTIS", 3, 99)]),
)
plan("delete_where", "SELECT * FROM customer WHERE NOT (c_nationkey = 7)", lambda t: changes.delete_where(t("customer"), c("c_nationkey") == 7))
plan(
    "update_where", "SELECT s_suppkey, s_name, CASE WHEN s_acctbal < 0 THEN -1 ELSE s_nationkey END AS s_nationkey, s_acctbal FROM supplier",
    lambda t: changes.update_where(t("supplier"), {"s_nationkey": F.lit(-1.0)}, c("s_acctbal") < 0),
)
plan(
    "update_count", "SELECT count(*) AS n_rows FROM supplier WHERE s_acctbal < 0",
    lambda t: changes.affected_rows(t("supplier"), ("s_acctbal", "<", 0)),
)
plan("delete_count", "SELECT count(*) AS n_rows FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING'", lambda t: changes.affected_rows(t("customer"), ("c_nationkey", "=", 7), ("c_mktsegment", "=", F.lit("BUILDING"))))
plan(
    "update_multi_assign",
    "SELECT s_suppkey, CASE WHEN s_nationkey > 10 THEN 'moved' ELSE s_name END AS s_name, CASE WHEN s_nationkey > 10 THEN s_nationkey - 10 ELSE s_nationkey END AS s_nationkey, s_acctbal FROM supplier",
    lambda t: changes.update_where(t("supplier"), {"s_name": F.lit("moved"), "s_nationkey": X.sub(c("s_nationkey"), F.lit(10))}, c("s_nationkey") > 10),
)

# Plans, catalog, statistics, procedures
plan("explain_rows", None, lambda t: relational.explain(relational.select(t("nation"), c("n_regionkey") == 1)))
_NAMED = "table_name IN ('" + "', '".join(NAMES) + "')"
#: Types by the names that DuckDB and this data model give them.
_TYPES = {"INTEGER": "int", "BIGINT": "long", "DOUBLE": "double", "VARCHAR": "varchar", "TIMESTAMP": "timestamp_ntz", "FLOAT[]": "array<float>"}
_TYPE_SQL = "CASE data_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _TYPES.items()) + " ELSE data_type END"
plan("catalog_tables", f"SELECT DISTINCT table_name AS tblname FROM information_schema.tables WHERE {_NAMED}", lambda t: table_catalog(t.spark, t.folder))
plan("catalog_fields", f"SELECT DISTINCT table_name AS tblname, column_name AS fldname, {_TYPE_SQL} AS type FROM information_schema.columns WHERE {_NAMED}", lambda t: field_catalog(t.spark, t.folder))
plan(
    "stats_columns",
    " UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) AS n_rows, count(DISTINCT {f}) AS n_distinct, CAST(min({f}) AS VARCHAR) AS low, CAST(max({f}) AS VARCHAR) AS high FROM orders" for f in ("o_orderkey", "o_custkey", "o_orderstatus")),
    lambda t: statistics.column_statistics(t("orders"), "o_orderkey", "o_custkey", "o_orderstatus"),
)
plan(
    "stats_join_size", "SELECT count(*) AS n_rows FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    lambda t: statistics.equi_join_size(t("lineitem"), "l_suppkey", t("supplier"), "s_suppkey"),
)
_MAXDIFF_SQL = """
WITH f AS (SELECT p_type AS v, count(*) AS n FROM part GROUP BY p_type),
s AS (SELECT v, n, abs(n - lag(n) OVER (ORDER BY v)) AS step, row_number() OVER (ORDER BY v) AS r FROM f),
cuts AS (SELECT r AS cut FROM s WHERE step IS NOT NULL ORDER BY step DESC, v LIMIT 4),
placed AS (SELECT v, n, r, (SELECT count(*) FROM cuts WHERE cut <= r) AS bucket FROM s),
numbered AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY v) AS i, count(*) OVER (PARTITION BY bucket) AS k FROM placed)
SELECT CAST(sum(n) AS DOUBLE) AS frequency, min(v) AS low, max(v) AS high, count(*) AS n_distinct,
       string_agg(CASE WHEN i * 5 // k > (i - 1) * 5 // k THEN v || '@' || (i * 5 // k) END, ', ' ORDER BY v) AS fifths
FROM numbered GROUP BY bucket
"""
_FIFTHS = "array_join(transform(percentiles, p -> concat(p.v, '@', cast(round(p.share * 5) as int))), ', ')"
plan("stats_maxdiff", _MAXDIFF_SQL, lambda t: statistics.maxdiff_histogram(t("part"), "p_type", 5, 5).withColumn("fifths", F.expr(_FIFTHS)).drop("percentiles"))
plan("stats_maxdiff_area", None, lambda t: statistics.maxdiff_area_histogram(t("orders"), "o_totalprice", 5))


def _customer_total(spark: SparkSession, changed: dict, customer: int, orders: DataFrame) -> DataFrame:
    return relational.group_by(relational.select(orders, c("o_custkey") == customer), ["o_custkey"], A.exact_total("o_totalprice"), A.count("o_orderkey"))


def _procedure(t: Tables) -> DataFrame:
    orders, procedures = t("orders"), Procedures()
    procedures.register(1, _customer_total)
    return procedures.call(orders.sparkSession, 1, 14, orders)[1]


plan(
    "stored_procedure",
    "SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS sumofo_totalprice, count(o_orderkey) AS countofo_orderkey FROM orders WHERE o_custkey = 14 GROUP BY o_custkey",
    _procedure,
)


@dataclass(frozen=True)
class Folder:
    """The tables of a folder."""

    spark: SparkSession
    folder: str

    def __call__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)


def _query(build: Callable[[Folder], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Folder(spark, sf_dir))


QUERIES = {name: _query(build) for name, build in PLANS.items()}

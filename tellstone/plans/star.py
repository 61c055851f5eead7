"""Queries over the star schema: scans, joins, aggregates, windows and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tellstone.sources.tables import read_table


def _revenue() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(_revenue()), 2).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count(F.lit(1)).alias("n"),
    )


def shipping_priority(spark: SparkSession, folder: str) -> DataFrame:
    customers = read_table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = read_table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    lines = read_table(spark, folder, "lineitem", "l_orderkey", "l_extendedprice", "l_discount")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    revenue = joined.groupBy("l_orderkey").agg(F.round(F.sum(_revenue()), 2).alias("revenue"))
    return revenue.orderBy(F.desc("revenue"), "l_orderkey").limit(10)


def nation_revenue(spark: SparkSession, folder: str) -> DataFrame:
    c, o, n, r = (read_table(spark, folder, t) for t in ("customer", "orders", "nation", "region"))
    lines = read_table(spark, folder, "lineitem", "l_orderkey", "l_extendedprice", "l_discount")
    names = n.join(r, n.n_regionkey == r.r_regionkey)
    joined = lines.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    by_nation = joined.groupBy("c_nationkey").agg(F.sum(_revenue()).alias("revenue"))  # before the names are joined: one row a nation
    return by_nation.join(names, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "n_name", F.round("revenue", 2).alias("revenue"))


def top_customers(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("n_orders"))
    joined = orders.join(read_table(spark, folder, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    place = F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.desc("total"), "c_custkey"))
    return joined.withColumn("place", place).where(F.col("place") <= 3).select("c_nationkey", "c_custkey", "total", "n_orders", "place")


def customers_without_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders", "o_custkey")
    return read_table(spark, folder, "customer", "c_custkey", "c_name").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


def event_days(spark: SparkSession, folder: str) -> DataFrame:
    """Events by day and type, pivoted."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    rows = read_table(spark, folder, "events", "ts", "event_type")
    return rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).pivot("event_type", kinds).agg(F.count(F.lit(1))).na.fill(0)


QUERIES = {f.__name__: f for f in (pricing_summary, shipping_priority, nation_revenue, top_customers, customers_without_orders, event_days)}
SQL = {
    "pricing_summary": """
select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(avg(l_quantity), 4) as avg_qty, count(*) as n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""",
    "shipping_priority": """
select l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
where c_mktsegment = 'BUILDING' group by 1 order by 2 desc, 1 limit 10""",
    "nation_revenue": """
select r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by 1, 2""",
    "top_customers": """
with t as (select o_custkey, round(sum(o_totalprice), 2) as total, count(*) as n_orders from orders group by 1)
select c_nationkey, c_custkey, total, n_orders, cast(row_number() over (partition by c_nationkey order by total desc, c_custkey) as integer) as place from t join customer on c_custkey = o_custkey qualify place <= 3""",
    "customers_without_orders": "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)",
    "event_days": "select strftime(ts, '%Y-%m-%d') as day, " + ", ".join(f"count(*) filter (event_type = '{k}') as {k}" for k in ("click", "error", "purchase", "signup", "view")) + " from events group by 1",
}

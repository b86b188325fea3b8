"""General relational queries: joins, sets, groupings, windows, nested values, approximate aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.operators import joins
from tidewell.plans.registry import query
from tidewell.session import table


def _t(name: str):  # noqa: ANN202
    return lambda spark, sf_dir: table(spark, sf_dir, name)


lineitem, orders, customer, events = _t("lineitem"), _t("orders"), _t("customer"), _t("events")


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lineitem(spark, sf_dir).where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return kept.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"),
    )


@query("revenue_by_nation", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    asia = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    people = customer(spark, sf_dir).join(asia, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    bought = orders(spark, sf_dir).select("o_orderkey", "o_custkey").join(people, F.col("o_custkey") == F.col("c_custkey"))
    return lineitem(spark, sf_dir).join(bought, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("customers_without_orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer(spark, sf_dir).join(orders(spark, sf_dir), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("orders_with_returns", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def orders_with_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = lineitem(spark, sf_dir).where("l_returnflag = 'R'")
    return orders(spark, sf_dir).join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("top_orders_per_customer", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return orders(spark, sf_dir).withColumn("n", n).where("n <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("priority_cube", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, grouping(o_orderpriority, o_orderstatus) AS level FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def priority_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).cube("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


@query("status_pivot", "SELECT l_returnflag, round(coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0), 2) AS open_qty, round(coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0), 2) AS filled_qty FROM lineitem GROUP BY 1")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = lineitem(spark, sf_dir).groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).sum("l_quantity").na.fill(0.0)
    return wide.select("l_returnflag", F.round("O", 2).alias("open_qty"), F.round("F", 2).alias("filled_qty"))


@query("running_spend", """SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, lag(o_orderkey) OVER w AS before, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS quartile,
  round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS sum3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""".replace("sum(o_totalprice) OVER w", "sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def running_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return orders(spark, sf_dir).select(
        "o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(W.unboundedPreceding, 0)), 2).alias("running"), F.lag("o_orderkey").over(w).alias("before"),
        F.ntile(4).over(w).cast("bigint").alias("quartile"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("sum3"),
    )


@query("nations_in_both", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def nations_in_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer(spark, sf_dir).select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")))


@query("segments_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def segments_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = orders(spark, sf_dir).where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return customer(spark, sf_dir).select(F.col("c_custkey").alias("k")).subtract(done)


@query("last_purchase_before_error", "SELECT e.event_id, p.event_id AS purchase_id, p.ts AS matched_time FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def last_purchase_before_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    errors = rows.where("event_type = 'error'").select("event_id", "user_id", "ts")
    bought = rows.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought_at"), F.col("event_id").alias("purchase_id"))
    return joins.as_of(errors, bought, ["user_id"], "ts", "bought_at", ["purchase_id"]).select("event_id", "purchase_id", "matched_time")


@query("parts_in_price_band", "WITH b AS (SELECT s_suppkey, 900 + (s_suppkey % 50) * 20 AS lo, 930 + (s_suppkey % 50) * 20 AS hi FROM supplier) SELECT s_suppkey, count(*) AS parts FROM part JOIN b ON p_retailprice BETWEEN lo AND hi GROUP BY s_suppkey")
def parts_in_price_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = 900 + (F.col("s_suppkey") % 50) * 20
    bands = table(spark, sf_dir, "supplier").select("s_suppkey", low.alias("lo"), (low + 30).alias("hi"))
    return joins.in_range(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), bands, "p_retailprice", "lo", "hi", 30.0).groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("parts"))


@query("events_per_type_salted", "SELECT e.event_type, count(*) AS n FROM events e JOIN (SELECT DISTINCT event_type FROM events) t USING (event_type) GROUP BY 1")
def events_per_type_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "event_type")
    return joins.salted(rows, rows.select("event_type").distinct(), "event_type", 8).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g) SELECT user_id, min(ts) AS started, count(*) AS actions FROM k GROUP BY user_id, n")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    made = rows.groupBy("user_id", F.session_window("ts", "30 minutes").alias("s")).agg(F.min("ts").alias("started"), F.count(F.lit(1)).alias("actions"))
    return made.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "actions")


@query("hourly_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    made = events(spark, sf_dir).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return made.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


@query("order_stats", "SELECT o_orderpriority, round(median(o_totalprice), 2) AS median_price, round(stddev_samp(o_totalprice), 4) AS deviation, round(quantile_cont(o_totalprice, 0.9), 2) AS p90, arg_max(o_orderkey, o_totalprice) AS dearest FROM orders GROUP BY 1")
def order_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).groupBy("o_orderpriority").agg(
        F.round(F.median("o_totalprice"), 2).alias("median_price"), F.round(F.stddev_samp("o_totalprice"), 4).alias("deviation"),
        F.round(F.percentile("o_totalprice", F.lit(0.9)), 2).alias("p90"), F.max_by("o_orderkey", "o_totalprice").alias("dearest"),
    )


@query("approximate_counts")
def approximate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem(spark, sf_dir).groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_extendedprice", F.lit(0.5)).alias("price"))


@query("unpivoted_amounts", "SELECT l_orderkey, l_linenumber, name, value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem) ON l_quantity, l_tax INTO NAME name VALUE value)")
def unpivoted_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"], "name", "value")


@query("brands_by_type", "SELECT p_type, list_sort(list(DISTINCT p_brand)) AS brands, count(*) AS parts FROM part GROUP BY p_type")
def brands_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.sort_array(F.collect_set("p_brand")).alias("brands"), F.count(F.lit(1)).alias("parts"))


@query("sql_interface", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) GROUP BY o_orderstatus")
def sql_interface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM {o} WHERE o_totalprice > (SELECT avg(o_totalprice) FROM {o}) GROUP BY o_orderstatus", o=orders(spark, sf_dir))

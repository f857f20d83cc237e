"""The retail model over the driver's tables, and the recommender's interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def users(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    # nation has 25 rows by definition
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"), F.col("n_name").alias("country"),
        F.expr("date_add(DATE '1995-01-01', cast(c_custkey * 37 % 2190 AS int))").alias("signup_date"))


def orders(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "O", "confirmed").otherwise("cancelled")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ordered_at"), status.alias("status"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("total_amount"), F.to_date("o_orderdate").alias("order_date"))


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("amount"))


def products(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title"), F.col("p_type").alias("category_name"), F.col("p_brand").alias("brand"))


def events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "add_to_cart").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("product_id"), kind.alias("event_type"), F.col("ts").alias("event_time"))


def interactions(spark: SparkSession, d: str) -> DataFrame:
    """user_id, item_id, ts: what a customer ordered, repeats included."""
    o, i = table(spark, d, "orders"), table(spark, d, "lineitem")
    return i.join(o, i.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("o_orderdate").alias("ts"))


#: The same model as DuckDB views, for oracles.
SQL = {
    "r_users": "SELECT c_custkey AS user_id, c_name AS email, n_name AS country, DATE '1995-01-01' + CAST(c_custkey * 37 % 2190 AS INTEGER) AS signup_date FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "r_orders": "SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderdate AS ordered_at, CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'confirmed' ELSE 'cancelled' END AS status, CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount, CAST(o_orderdate AS DATE) AS order_date FROM orders",
    "r_items": "SELECT l_orderkey AS order_id, l_partkey AS product_id, l_quantity AS quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS amount FROM lineitem",
    "r_products": "SELECT p_partkey AS product_id, p_name AS title, p_type AS category_name, p_brand AS brand FROM part",
    "r_events": "SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id, CASE WHEN event_type = 'click' THEN 'add_to_cart' ELSE event_type END AS event_type, ts AS event_time FROM events",
    "r_inter": "SELECT o_custkey AS user_id, l_partkey AS item_id, o_orderdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
}


def with_views(sql: str) -> str:
    """`sql` (which may begin with further CTEs: 'name AS (...), ... SELECT') after the views that it names."""
    used = [f"{k} AS ({v})" for k, v in SQL.items() if k in sql]
    more = sql.lstrip()
    if more.upper().startswith("SELECT"):
        return f"WITH {', '.join(used)} {more}" if used else more
    return f"WITH {', '.join([*used, more])}"

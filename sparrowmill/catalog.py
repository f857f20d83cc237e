"""Names, queries and SQL of the library's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import clip, cosine, ratio_round, ratio_sql, title_or_default, valid
from .operators import reco
from .operators import retail as R
from .operators.quality import dq_violations
from .plans import ntile_distributed, running_share, stored
from .sources import retail as S

AS_OF = "2001-08-02"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = S.with_views(sql)
        return f

    return keep


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)


# --- the six analyses ---------------------------------------------------------------------------

VALID = "status NOT IN ('cancelled', 'refunded')"
COHORT = f"""
c AS (SELECT user_id, CAST(date_trunc('month', signup_date) AS DATE) AS cohort_month FROM r_users),
s AS (SELECT cohort_month, count(DISTINCT user_id) AS cohort_size FROM c GROUP BY 1),
a AS (SELECT cohort_month, (year(order_date) - year(cohort_month)) * 12 + month(order_date) - month(cohort_month) AS p, user_id FROM r_orders JOIN c USING (user_id) WHERE {VALID}),
n AS (SELECT cohort_month, p, count(DISTINCT user_id) AS n FROM a WHERE p BETWEEN 0 AND 6 GROUP BY ALL),
f AS (SELECT cohort_month, cohort_size, p, coalesce(n, 0) AS n FROM s CROSS JOIN range(0, 7) g(p) LEFT JOIN n USING (cohort_month, p)),
l AS (SELECT *, n - lag(n) OVER (PARTITION BY cohort_month ORDER BY p) AS d FROM f),
coh AS (SELECT cohort_month, CAST(cohort_size AS BIGINT) AS cohort_size, CAST(p AS BIGINT) AS months_since_signup, CAST(n AS BIGINT) AS active_users,
  {ratio_sql('(100 * n)', 'cohort_size', 1)} AS retention_pct, {ratio_sql('(100 * d)', 'cohort_size', 1)} AS retention_delta_ppt FROM l)"""


@_add("cohort_retention", COHORT + " SELECT * FROM coh")
def cohort(spark, d):
    return R.cohort_retention(S.users(spark, d), S.orders(spark, d))


@_add("retention_pivot", COHORT + " SELECT cohort_month, " + ", ".join(f'max(CASE WHEN months_since_signup = {k} THEN retention_pct END) AS "Month {k}"' for k in range(7)) + " FROM coh GROUP BY 1")
def retention_pivot(spark, d):
    p = cohort(spark, d).groupBy("cohort_month").pivot("months_since_signup", list(range(7))).agg(F.first("retention_pct"))
    return p.toDF("cohort_month", *[f"Month {k}" for k in range(7)])


FUNNEL = f"""
f AS (SELECT category_name, count(DISTINCT product_id) AS product_count, count(DISTINCT user_id) FILTER (WHERE event_type = 'view') AS viewers,
  count(DISTINCT user_id) FILTER (WHERE event_type = 'add_to_cart') AS add_to_carts, count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS purchasers
  FROM r_events JOIN r_products USING (product_id) GROUP BY 1),
g AS (SELECT *, viewers - purchasers AS lost_buyers, {ratio_sql('(100 * add_to_carts)', 'viewers', 1)} AS view_to_cart_pct, {ratio_sql('(100 * purchasers)', 'add_to_carts', 1)} AS cart_to_purchase_pct,
  {ratio_sql('(100 * purchasers)', 'viewers', 1)} AS overall_conversion_pct FROM f)"""


@_add("conversion_funnel", FUNNEL + " SELECT *, rank() OVER (ORDER BY lost_buyers DESC) AS lost_buyer_rank, CASE WHEN viewers < 100 THEN 'low-traffic' ELSE 'sufficient volume' END AS data_quality_flag FROM g")
def funnel(spark, d):
    return R.conversion_funnel(S.events(spark, d), S.products(spark, d))


@_add("funnel_bars", FUNNEL + " SELECT category_name, view_to_cart_pct, cart_to_purchase_pct, overall_conversion_pct FROM g")
def funnel_bars(spark, d):
    return funnel(spark, d).select("category_name", "view_to_cart_pct", "cart_to_purchase_pct", "overall_conversion_pct")


RFM = f"""
b AS (SELECT user_id, CAST(DATE '{AS_OF}' - max(order_date) AS BIGINT) AS recency_days, count(DISTINCT order_id) AS frequency, sum(total_amount) AS monetary FROM r_orders WHERE {VALID} GROUP BY 1),
t AS (SELECT *, 6 - ntile(5) OVER (ORDER BY recency_days, user_id) AS r, ntile(5) OVER (ORDER BY frequency, user_id) AS f, ntile(5) OVER (ORDER BY monetary, user_id) AS m FROM b),
rfm AS (SELECT user_id, email, country, recency_days, frequency, CAST(monetary AS DOUBLE) AS monetary, CAST(r AS BIGINT) AS r_score, CAST(f AS BIGINT) AS f_score, CAST(m AS BIGINT) AS m_score,
  {ratio_sql('(r + f + m)', '3', 2)} AS rfm_score, CASE WHEN r >= 4 AND f >= 4 AND m >= 4 THEN 'Gold' WHEN r >= 3 AND f >= 3 AND m >= 3 THEN 'Silver' WHEN r >= 4 AND f <= 2 THEN 'New High-Value'
  WHEN r <= 2 AND f >= 4 THEN 'At-Risk VIP' WHEN r <= 2 AND f <= 2 THEN 'Churned' ELSE 'Bronze' END AS customer_segment FROM t JOIN r_users USING (user_id))"""


@_add("rfm_segmentation", RFM + " SELECT * FROM rfm")
def rfm(spark, d):
    return R.rfm_segmentation(S.orders(spark, d), S.users(spark, d), AS_OF)


@_add("segment_summary", RFM + " SELECT customer_segment, count(*) AS user_count, sum(CAST(monetary * 100 AS BIGINT))::BIGINT / 100.0 / count(*) AS avg_spend, CAST(sum(CAST(monetary * 100 AS BIGINT))::BIGINT / 100.0 AS DOUBLE) AS total_revenue FROM rfm GROUP BY 1")
def segment_summary(spark, d):
    total = F.sum(F.round(F.col("monetary") * 100).cast("bigint")) / 100.0
    return rfm(spark, d).groupBy("customer_segment").agg(F.count("*").alias("user_count"), (total / F.count("*")).alias("avg_spend"), total.alias("total_revenue"))


DAILY = f"dd AS (SELECT order_date, count(DISTINCT order_id) AS orders, count(DISTINCT user_id) AS buyers, sum(CAST(total_amount * 100 AS BIGINT))::BIGINT AS c FROM r_orders WHERE {VALID} GROUP BY 1)"


def _rolling(frame7: str, frame30: str, lag: str) -> str:
    months = "mm AS (SELECT *, lag(mc) OVER (ORDER BY m) AS pm FROM (SELECT CAST(date_trunc('month', order_date) AS DATE) AS m, sum(c)::BIGINT AS mc FROM dd GROUP BY 1))"
    return f"""{DAILY}, {months},
rr AS (SELECT order_date, CAST(date_trunc('month', order_date) AS DATE) AS m, c, sum(c) OVER ({frame7})::BIGINT AS s7, sum(c) OVER ({frame30})::BIGINT AS s30, sum(buyers) OVER ({frame30})::BIGINT AS buyers_30d FROM dd),
jj AS (SELECT *, {lag} AS prev FROM rr JOIN mm USING (m)),
rol AS (SELECT order_date, c / 100.0::DOUBLE AS daily_gmv, s7 / 100.0::DOUBLE AS gmv_7d, s30 / 100.0::DOUBLE AS gmv_30d, buyers_30d, mc / 100.0::DOUBLE AS monthly_gmv, prev / 100.0::DOUBLE AS prev_month_gmv, {ratio_sql('(100 * (mc - prev))', 'prev', 1)} AS mom_growth_pct FROM jj)"""


ROWS7, ROWS30 = "ORDER BY order_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW", "ORDER BY order_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW"
AS_WRITTEN = "lag(mc) OVER (ORDER BY m, order_date)"


@_add("rolling_revenue", _rolling(ROWS7, ROWS30, AS_WRITTEN) + " SELECT * FROM rol")
def rolling(spark, d):
    return R.rolling_revenue(S.orders(spark, d))


@_add("rolling_revenue_mom", _rolling(ROWS7, ROWS30, "pm") + " SELECT * FROM rol")
def rolling_mom(spark, d):
    return R.rolling_revenue(S.orders(spark, d), by_month=True)


@_add("rolling_revenue_calendar", _rolling(ROWS7.replace("ROWS BETWEEN 6", "RANGE BETWEEN INTERVAL 6 DAYS"), ROWS30.replace("ROWS BETWEEN 29", "RANGE BETWEEN INTERVAL 29 DAYS"), "pm") + " SELECT * FROM rol")
def rolling_calendar(spark, d):
    return R.rolling_revenue(S.orders(spark, d), calendar=True, by_month=True)


@_add("rolling_series", _rolling(ROWS7, ROWS30, AS_WRITTEN) + " SELECT order_date, daily_gmv, gmv_7d, gmv_30d FROM rol")
def rolling_series(spark, d):
    return rolling(spark, d).select("order_date", "daily_gmv", "gmv_7d", "gmv_30d")


@_add("daily_revenue", DAILY + f" SELECT order_date, orders, buyers, c AS gmv_cents, {ratio_sql('c', '(orders * 100)', 2)} AS aov FROM dd")
def daily(spark, d):
    return R.daily_revenue(S.orders(spark, d))


@_add("user_monthly_activity", f"SELECT user_id, CAST(date_trunc('month', order_date) AS DATE) AS activity_month, count(DISTINCT order_id) AS order_count, CAST(sum(total_amount) AS DOUBLE) AS total_spent FROM r_orders WHERE {VALID} GROUP BY ALL")
def monthly_activity(spark, d):
    return R.user_monthly_activity(S.orders(spark, d))


def _pairs(least: int) -> str:
    return f"""u AS (SELECT DISTINCT order_id, product_id FROM r_items),
pp AS (SELECT x.product_id AS a, y.product_id AS b, count(*) AS n FROM u x JOIN u y ON x.order_id = y.order_id AND x.product_id < y.product_id GROUP BY ALL HAVING count(*) >= {least}),
tt AS (SELECT count(DISTINCT order_id) AS total FROM r_items)"""


BASKET = _pairs(2) + f""", bb AS (SELECT row_number() OVER (ORDER BY n DESC, a, b) AS rank, pa.title AS product_a, pa.category_name AS category_a, pb.title AS product_b, pb.category_name AS category_b, n AS co_purchase_count,
  {ratio_sql('(100 * n)', 'total', 3)} AS support_pct, CASE WHEN pa.category_name <> pb.category_name THEN 'cross-category' ELSE 'same-category' END AS pair_type
  FROM pp JOIN r_products pa ON pa.product_id = a JOIN r_products pb ON pb.product_id = b CROSS JOIN tt)"""
BASKET3 = BASKET.replace(">= 2", ">= 3")


@_add("market_basket", BASKET3 + " SELECT * FROM bb ORDER BY rank LIMIT 50")
def basket(spark, d):
    return R.market_basket(S.items(spark, d), S.products(spark, d))


@_add("market_basket_all", _pairs(2) + f" SELECT a, b, n FROM pp")
def basket_all(spark, d):
    return R.product_pairs(S.items(spark, d)).where("n >= 2").select("a", "b", F.col("n").cast("bigint").alias("n"))


@_add("basket_rules", _pairs(2) + f", k AS (SELECT product_id, count(*) AS k FROM u GROUP BY 1) SELECT a, b, n, {ratio_sql('n', 'ka.k', 6)} AS confidence_ab, {ratio_sql('n', 'kb.k', 6)} AS confidence_ba, {ratio_sql('(n * total)', '(ka.k * kb.k)', 6)} AS lift FROM pp JOIN k ka ON ka.product_id = a JOIN k kb ON kb.product_id = b CROSS JOIN tt")
def basket_rules(spark, d):
    return R.basket_rules(S.items(spark, d))


@_add("basket_top15", BASKET3 + " SELECT rank, substr(product_a, 1, 20) || ' + ' || substr(product_b, 1, 20) AS label, co_purchase_count FROM bb ORDER BY rank LIMIT 15")
def basket_top15(spark, d):
    label = F.concat(F.substring("product_a", 1, 20), F.lit(" + "), F.substring("product_b", 1, 20))
    return R.market_basket(S.items(spark, d), S.products(spark, d), top=15).select("rank", label.alias("label"), "co_purchase_count")


def _geo(amount: str, per: str) -> str:
    return f"""ff AS (SELECT country, category_name, order_id, CAST({amount} * 100 AS BIGINT) AS cents FROM r_orders JOIN r_items USING (order_id) JOIN r_products USING (product_id) JOIN r_users USING (user_id) WHERE {VALID}),
raw AS (SELECT country, category_name, count(DISTINCT order_id) AS orders, sum(cents)::BIGINT AS c, count(*) AS k, grouping(country) AS gc, grouping(category_name) AS gk FROM ff GROUP BY ROLLUP (country, category_name)),
w AS (SELECT *, sum(orders) OVER ()::BIGINT AS all_orders, sum(c) OVER (PARTITION BY gc, country)::BIGINT AS cc FROM raw),
geo AS (SELECT CASE WHEN gc = 1 THEN '── ALL COUNTRIES ──' ELSE country END AS country, CASE WHEN gk = 1 THEN '  (all categories)' ELSE category_name END AS category_name, orders, c / 100.0::DOUBLE AS gmv,
  {ratio_sql('c', f'({per} * 100)', 2)} AS aov, {ratio_sql('(100 * orders)', 'all_orders', 2)} AS order_share_pct, {ratio_sql('(100 * c)', 'cc', 1)} AS gmv_share_in_country_pct,
  CASE WHEN gc = 1 THEN 'grand_total' WHEN gk = 1 THEN 'country_subtotal' ELSE 'detail' END AS row_type FROM w)"""


@_add("geo_revenue_rollup", _geo("total_amount", "k") + " SELECT * FROM geo")
def geo(spark, d):
    return R.geo_revenue_rollup(S.users(spark, d), S.orders(spark, d), S.items(spark, d), S.products(spark, d))


@_add("geo_revenue_rollup_exact", _geo("amount", "orders") + " SELECT * FROM geo")
def geo_exact(spark, d):
    return R.geo_revenue_rollup(S.users(spark, d), S.orders(spark, d), S.items(spark, d), S.products(spark, d), exact=True)


@_add("country_totals", _geo("total_amount", "k") + " SELECT country, gmv FROM geo WHERE row_type = 'country_subtotal' ORDER BY gmv DESC, country LIMIT 10")
def country_totals(spark, d):
    return geo(spark, d).where(F.col("row_type") == "country_subtotal").orderBy(F.col("gmv").desc(), "country").select("country", "gmv").limit(10)


@_add("dq_violations", """k AS (SELECT 'lineitem' AS table_name, 'unique order, line' AS rule, count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'lineitem', 'unique order, part', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1)
UNION ALL SELECT 'orders', 'unique order', count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'orders', 'customer exists', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'lineitem', 'order exists', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'orders', 'status known', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'lineitem', 'quantity over 0', count(*) FROM lineitem WHERE NOT l_quantity > 0
UNION ALL SELECT 'customer', 'balance at least 0', count(*) FROM customer WHERE NOT c_acctbal >= 0) SELECT table_name, rule, CAST(n AS BIGINT) AS n FROM k""")
def violations(spark, d):
    t = lambda n: S.table(spark, d, n)
    rules = [("lineitem", "unique order, line", "unique", ["l_orderkey", "l_linenumber"]), ("lineitem", "unique order, part", "unique", ["l_orderkey", "l_partkey"]), ("orders", "unique order", "unique", ["o_orderkey"]),
             ("orders", "customer exists", "exists", ("o_custkey", t("customer"), "c_custkey")), ("lineitem", "order exists", "exists", ("l_orderkey", t("orders"), "o_orderkey")),
             ("orders", "status known", "holds", "o_orderstatus IN ('F', 'O')"), ("lineitem", "quantity over 0", "holds", "l_quantity > 0"), ("customer", "balance at least 0", "holds", "c_acctbal >= 0")]
    return dq_violations({n: t(n) for n in ("lineitem", "orders", "customer")}, rules)


# --- single operators ---------------------------------------------------------------------------


def _one(name: str, sql: str, f: Callable) -> None:
    """f gets t(table name) for the driver's tables."""
    _add(name, sql)(lambda spark, d: f(lambda n: S.table(spark, d, n), S, spark, d))


TABLES = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars", "embeddings": "vec_id embedding label", "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}
for _n, _c in TABLES.items():
    _one(f"src_table_{_n}", f"SELECT count(*) AS n, {', '.join(f'count({c}) AS n_{c}, count(DISTINCT {c}) AS d_{c}' for c in _c.split())} FROM {_n}",
         lambda t, s, spark, d, n=_n, cols=_c.split(): t(n).agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in cols for k, f in (("n", F.count), ("d", F.count_distinct))]))

_one("project_alias", "SELECT o_orderkey AS order_id, o_orderstatus AS status FROM orders", lambda t, s, k, d: t("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status")))
_one("project_star", "SELECT *, r_regionkey * 2 AS twice FROM region", lambda t, s, k, d: t("region").select("*", (F.col("r_regionkey") * 2).alias("twice")))
_one("project_dynamic", "SELECT o_custkey, o_orderkey FROM orders", lambda t, s, k, d: t("orders").select(*[c for c in ("o_custkey", "o_orderkey", None) if c]))
_one("filter_not_in", f"SELECT order_id FROM r_orders WHERE {VALID}", lambda t, s, k, d: s.orders(k, d).where(valid(F.col("status"))).select("order_id"))
_one("filter_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber BETWEEN 2 AND 3", lambda t, s, k, d: t("lineitem").where(F.col("l_linenumber").between(2, 3)).select("l_orderkey", "l_linenumber"))
_one("filter_post_agg", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 3", lambda t, s, k, d: t("orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 3"))
_one("filter_eq_string", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'", lambda t, s, k, d: t("customer").where(F.col("c_mktsegment") == "BUILDING").select("c_custkey"))
_one("drop_nulls", "SELECT event_id FROM r_events WHERE user_id IS NOT NULL AND product_id IS NOT NULL", lambda t, s, k, d: s.events(k, d).dropna(subset=["user_id", "product_id"]).select("event_id"))
_one("case_searched", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS band FROM part", lambda t, s, k, d: t("part").select("p_partkey", F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large").alias("band")))
_one("neq", "SELECT count(*) AS n FROM part WHERE p_brand <> p_type", lambda t, s, k, d: t("part").where(F.col("p_brand") != F.col("p_type")).agg(F.count("*").alias("n")))
_one("coalesce", "SELECT c_custkey, coalesce(o_orderkey, 0) AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey", lambda t, s, k, d: t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("o_orderkey", F.lit(0)).alias("o")))
_one("nullif_div", "SELECT l_orderkey, l_linenumber, l_tax / nullif(l_discount, 0) AS r FROM lineitem", lambda t, s, k, d: t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_tax") / F.nullif("l_discount", F.lit(0.0))).alias("r")))
_one("cast_numeric", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 100 AS BIGINT) AS cents FROM orders", lambda t, s, k, d: t("orders").select("o_orderkey", (F.col("o_totalprice").cast("decimal(12,2)") * 100).cast("bigint").alias("cents")))
_one("cast_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders", lambda t, s, k, d: t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")))
_one("arith", "SELECT p_partkey, CAST(6 - p_size % 5 AS BIGINT) AS a, CAST(p_size // 7 AS BIGINT) AS b FROM part", lambda t, s, k, d: t("part").select("p_partkey", (6 - F.col("p_size") % 5).cast("bigint").alias("a"), F.expr("p_size div 7").cast("bigint").alias("b")))
_one("epsilon_div", "SELECT p_partkey, p_retailprice / (p_size + 1e-9) AS r FROM part", lambda t, s, k, d: t("part").select("p_partkey", (F.col("p_retailprice") / (F.col("p_size") + F.lit(1e-9))).alias("r")))
_one("join_inner_on", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", lambda t, s, k, d: t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name"))
_one("join_inner_using", "SELECT order_id, product_id, user_id FROM r_orders JOIN r_items USING (order_id)", lambda t, s, k, d: s.orders(k, d).join(s.items(k, d), "order_id").select("order_id", "product_id", "user_id"))
_one("join_left_using_2", "a AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), b AS (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY ALL) SELECT l_orderkey, l_suppkey, n FROM a LEFT JOIN b USING (l_orderkey, l_suppkey)",
     lambda t, s, k, d: t("lineitem").select("l_orderkey", "l_suppkey").distinct().join(t("lineitem").where("l_quantity > 25").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n")), ["l_orderkey", "l_suppkey"], "left"))
_one("join_cross", "SELECT r_name, p FROM region CROSS JOIN range(0, 7) g(p)", lambda t, s, k, d: t("region").select("r_name", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(6).cast("bigint"))).alias("p")))
_one("join_self_theta", _pairs(1) + " SELECT count(*) AS pairs, sum(n)::BIGINT AS n FROM pp", lambda t, s, k, d: R.product_pairs(s.items(k, d)).agg(F.count("*").alias("pairs"), F.sum("n").alias("n")))
_one("join_expr_key", "m AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS m, count(*) AS n FROM r_orders GROUP BY 1) SELECT order_id, n FROM r_orders JOIN m ON CAST(date_trunc('month', order_date) AS DATE) = m",
     lambda t, s, k, d: s.orders(k, d).withColumn("m", F.trunc("order_date", "MM")).join(s.orders(k, d).groupBy(F.trunc("order_date", "MM").alias("m")).agg(F.count("*").alias("n")), "m").select("order_id", "n"))
_one("join_chain_5", "SELECT r_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
     lambda t, s, k, d: t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n")))
_one("join_lookup_default", "SELECT p_partkey, coalesce(s_name, 'Item ' || p_partkey) AS title FROM part LEFT JOIN supplier ON p_partkey = s_suppkey", lambda t, s, k, d: t("part").join(t("supplier"), F.col("p_partkey") == F.col("s_suppkey"), "left").select("p_partkey", title_or_default(F.col("s_name"), F.col("p_partkey")).alias("title")))
_one("join_semi_isin", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM events)", lambda t, s, k, d: t("customer").join(t("events"), F.col("c_custkey") == F.col("user_id"), "left_semi").select("c_custkey"))
_one("join_anti_seen", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)", lambda t, s, k, d: t("customer").join(t("events"), F.col("c_custkey") == F.col("user_id"), "left_anti").select("c_custkey"))
_one("agg_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1", lambda t, s, k, d: t("orders").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("n")))
_one("agg_count_distinct_filter", "SELECT product_id, count(DISTINCT user_id) FILTER (WHERE event_type = 'view') AS viewers, count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS purchasers FROM r_events GROUP BY 1",
     lambda t, s, k, d: s.events(k, d).groupBy("product_id").agg(*[F.count_distinct(F.when(F.col("event_type") == e, F.col("user_id"))).alias(n) for e, n in (("view", "viewers"), ("purchase", "purchasers"))]))
_one("agg_sum_avg_max", "SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, max(l_extendedprice) AS m, sum(CAST(l_quantity AS BIGINT))::BIGINT / count(*) AS a FROM lineitem GROUP BY 1", lambda t, s, k, d: t("lineitem").groupBy("l_returnflag").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"), F.max("l_extendedprice").alias("m"), (F.sum(F.col("l_quantity").cast("bigint")) / F.count("*")).alias("a")))
_one("agg_global", "SELECT count(DISTINCT l_orderkey) AS n FROM lineitem", lambda t, s, k, d: t("lineitem").agg(F.count_distinct("l_orderkey").alias("n")))
_one("agg_multikey", "SELECT l_returnflag, l_linestatus, l_linenumber, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL", lambda t, s, k, d: t("lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey").agg(F.count("*").alias("n")))
_one("agg_expr_key", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n FROM orders GROUP BY 1", lambda t, s, k, d: t("orders").groupBy(F.trunc(F.to_date("o_orderdate"), "MM").alias("m")).agg(F.count("*").alias("n")))
_one("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS g1, CAST(grouping(l_linestatus) AS BIGINT) AS g2 FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", lambda t, s, k, d: t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping("l_returnflag").cast("bigint").alias("g1"), F.grouping("l_linestatus").cast("bigint").alias("g2")))
_one("agg_value_counts", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1", lambda t, s, k, d: t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")))
_one("agg_col_sum", "SELECT item_id, CAST(count(DISTINCT user_id) AS DOUBLE) AS score FROM r_inter GROUP BY 1", lambda t, s, k, d: s.interactions(k, d).groupBy("item_id").agg(F.count_distinct("user_id").cast("double").alias("score")))
_one("agg_row_nnz", "SELECT c_custkey, count(DISTINCT item_id) AS n FROM customer LEFT JOIN r_inter ON c_custkey = user_id GROUP BY 1", lambda t, s, k, d: t("customer").join(s.interactions(k, d), F.col("c_custkey") == F.col("user_id"), "left").groupBy("c_custkey").agg(F.count_distinct("item_id").alias("n")))
_one("agg_stats", "n AS (SELECT user_id, count(*) AS n FROM r_inter GROUP BY 1) SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, max(n) AS mx, CAST(median(n) AS DOUBLE) AS med FROM n",
     lambda t, s, k, d: s.interactions(k, d).groupBy("user_id").agg(F.count("*").alias("n")).agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("std"), F.max("n").alias("mx"), F.median("n").alias("med")))
_one("agg_share_positive", "SELECT round(avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct FROM customer", lambda t, s, k, d: t("customer").agg(F.round(F.avg(F.when(F.col("c_acctbal") > 0, 1.0).otherwise(0.0)) * 100, 6).alias("pct")))
_one("agg_density", "p AS (SELECT DISTINCT user_id, item_id FROM r_inter) SELECT count(*) AS nnz, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, count(*) / (CAST(count(DISTINCT user_id) AS DOUBLE) * count(DISTINCT item_id)) AS density FROM p",
     lambda t, s, k, d: s.interactions(k, d).select("user_id", "item_id").distinct().agg(F.count("*").alias("nnz"), F.count_distinct("user_id").alias("users"), F.count_distinct("item_id").alias("items")).withColumn("density", F.col("nnz") / (F.col("users").cast("double") * F.col("items"))))
_one("agg_histogram", "n AS (SELECT user_id, count(*) AS n FROM r_inter GROUP BY 1), b AS (SELECT CAST(min(n) AS DOUBLE) AS lo, CAST(max(n) AS DOUBLE) AS hi FROM n) SELECT CAST(least(floor((n - lo) * 40 / (hi - lo)) + 1, 40) AS BIGINT) AS bin, count(*) AS n FROM n CROSS JOIN b GROUP BY 1",
     lambda t, s, k, d: reco.histogram(s.interactions(k, d).groupBy("user_id").agg(F.count("*").alias("n")), "n", 40))
_W = Window
_one("win_lag_part", "SELECT l_orderkey, l_linenumber, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS prev FROM lineitem", lambda t, s, k, d: t("lineitem").select("l_orderkey", "l_linenumber", F.lag("l_quantity").over(_W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("prev")))
_one("win_rank", "SELECT n_name, rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) AS rk FROM nation", lambda t, s, k, d: t("nation").select("n_name", F.rank().over(_W.partitionBy("n_regionkey").orderBy(F.col("n_nationkey").desc())).cast("bigint").alias("rk")))
_one("win_row_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders", lambda t, s, k, d: t("orders").select("o_orderkey", F.row_number().over(_W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("bigint").alias("rn")))
_one("win_ntile", "SELECT c_custkey, ntile(5) OVER (ORDER BY c_acctbal, c_custkey) AS tile FROM customer", lambda t, s, k, d: ntile_distributed(t("customer").select("c_custkey", "c_acctbal"), 5, "c_acctbal", "c_custkey").select("c_custkey", F.col("tile").cast("bigint").alias("tile")))
_one("win_total_over_agg", "SELECT o_orderstatus, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM orders GROUP BY 1", lambda t, s, k, d: t("orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(_W.partitionBy())))
_one("win_part_total", "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2)) * 100) OVER (PARTITION BY o_custkey) AS BIGINT) AS c FROM orders", lambda t, s, k, d: t("orders").select("o_orderkey", F.sum((F.col("o_totalprice").cast("decimal(12,2)") * 100).cast("bigint")).over(_W.partitionBy("o_custkey")).alias("c")))
_one("win_cumshare", "n AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_partkey, CAST(sum(n) OVER (ORDER BY n DESC, l_partkey ROWS UNBOUNDED PRECEDING) AS BIGINT) / CAST(sum(n) OVER () AS DOUBLE) AS share FROM n",
     lambda t, s, k, d: running_share(t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")), "n", F.col("n").desc(), F.col("l_partkey")).select("l_partkey", "share"))
_one("win_topk_per_user", "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3", lambda t, s, k, d: t("orders").select("o_custkey", "o_orderkey", F.row_number().over(_W.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")).cast("bigint").alias("rn")).where("rn <= 3"))
_one("sort_case_nulls_last", "SELECT n_name, n_regionkey FROM nation ORDER BY CASE WHEN n_regionkey = 2 THEN 0 ELSE 1 END, n_regionkey DESC NULLS LAST, n_name LIMIT 10", lambda t, s, k, d: t("nation").select("n_name", "n_regionkey").orderBy(F.when(F.col("n_regionkey") == 2, 0).otherwise(1), F.col("n_regionkey").desc_nulls_last(), "n_name").limit(10))
_one("limit_topn", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50", lambda t, s, k, d: t("orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(50))
_one("set_intersect_count", "SELECT count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')", lambda t, s, k, d: t("orders").where("o_orderstatus = 'F'").select("o_custkey").intersect(t("orders").where("o_orderstatus = 'O'").select("o_custkey")).agg(F.count("*").alias("n")))
_one("dedupe_seen", "SELECT DISTINCT user_id, item_id FROM r_inter", lambda t, s, k, d: s.interactions(k, d).select("user_id", "item_id").dropDuplicates())
_one("fn_date", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(DATE '2001-08-02' - CAST(o_orderdate AS DATE) AS BIGINT) AS days FROM orders",
     lambda t, s, k, d: t("orders").select("o_orderkey", F.trunc(F.to_date("o_orderdate"), "MM").alias("m"), F.year("o_orderdate").cast("bigint").alias("y"), F.datediff(F.lit(AS_OF).cast("date"), F.to_date("o_orderdate")).cast("bigint").alias("days")))
_one("fn_round", f"SELECT p_partkey, {ratio_sql('(p_size * 10)', '7', 2)} AS r FROM part", lambda t, s, k, d: t("part").select("p_partkey", ratio_round(F.col("p_size") * 10, F.lit(7), 2).alias("r")))
_one("fn_text", "SELECT p_partkey, substr(p_name, 1, 5) || ' + ' || substr(p_type, 1, 3) AS label, printf('%.1f%%', p_size / 3.0::DOUBLE) AS pct, string_split(p_brand, '#')[1] AS head FROM part",
     lambda t, s, k, d: t("part").select("p_partkey", F.concat(F.substring("p_name", 1, 5), F.lit(" + "), F.substring("p_type", 1, 3)).alias("label"), F.format_string("%.1f%%", F.col("p_size") / 3.0).alias("pct"), F.split("p_brand", "#")[0].alias("head")))
_one("fn_math", "SELECT p_partkey, round(log2(p_size), 9) AS l, round(sqrt(p_retailprice), 9) AS r, greatest(least(p_size, 30), 10) AS c FROM part", lambda t, s, k, d: t("part").select("p_partkey", F.round(F.log2("p_size"), 9).alias("l"), F.round(F.sqrt("p_retailprice"), 9).alias("r"), clip(F.col("p_size"), 10, 30).alias("c")))
_one("fn_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", lambda t, s, k, d: t("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")))

# --- recommender ----------------------------------------------------------------------------------

K, N = 20, 10
#: Users then items below K rows are dropped; more rounds than the tables need change nothing.
KCORE = "k0 AS (SELECT * FROM r_inter)" + "".join(
    f", u{i} AS (SELECT * FROM k{i - 1} WHERE user_id IN (SELECT user_id FROM k{i - 1} GROUP BY 1 HAVING count(*) >= {K})), k{i} AS (SELECT * FROM u{i} WHERE item_id IN (SELECT item_id FROM u{i} GROUP BY 1 HAVING count(*) >= {K}))" for i in range(1, 7)) + ", core AS (SELECT * FROM k6)"


def _core(spark, d):
    return reco.kcore(S.interactions(spark, d), "user_id", "item_id", K, K)


_add("kcore_filter", KCORE + " SELECT user_id, item_id, count(*) AS n FROM core GROUP BY ALL")(lambda spark, d: _core(spark, d).groupBy("user_id", "item_id").agg(F.count("*").alias("n")))
_add("encode_ids", "SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_idx FROM (SELECT DISTINCT user_id FROM r_inter)")(lambda spark, d: reco.encode(S.interactions(spark, d), "user_id", "user_idx").select("user_id", F.col("user_idx").cast("bigint").alias("user_idx")))
_add("dedupe_temporal", "SELECT user_id, item_id, min(ts) AS ts FROM r_inter GROUP BY ALL")(lambda spark, d: reco.first_per_pair(S.interactions(spark, d)))
FIRST = "fp AS (SELECT user_id, item_id, min(ts) AS ts FROM r_inter GROUP BY ALL)"


def _split(order: str, name: str = "sp") -> str:
    return FIRST + f""", q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS pos, count(*) OVER (PARTITION BY user_id) AS n, greatest(1, CAST(floor(0.1::DOUBLE * count(*) OVER (PARTITION BY user_id)) AS BIGINT)) AS k FROM fp),
{name} AS (SELECT user_id, item_id, CASE WHEN n < 3 THEN 'train' WHEN pos > n - k THEN 'test' WHEN pos > n - 2 * k THEN 'val' ELSE 'train' END AS split FROM q)"""


def splits(spark, d, *order):
    return reco.split_last(reco.first_per_pair(S.interactions(spark, d)), "user_id", *order).select("user_id", "item_id", "split")


_add("split_leave_last", _split("item_id") + " SELECT * FROM sp")(lambda spark, d: splits(spark, d, "item_id"))
_add("split_leave_last_temporal", _split("ts, item_id") + " SELECT * FROM sp")(lambda spark, d: splits(spark, d, "ts", "item_id"))
_add("leak_check", _split("item_id") + """, x AS (SELECT bool_or(split = 'train') AS tr, bool_or(split = 'val') AS va, bool_or(split = 'test') AS te FROM sp GROUP BY user_id, item_id)
SELECT count(*) FILTER (WHERE tr AND va) AS train_val, count(*) FILTER (WHERE tr AND te) AS train_test, count(*) FILTER (WHERE va AND te) AS val_test FROM x""")(
    lambda spark, d: reco.leaks(splits(spark, d, "item_id"), "user_id", "item_id"))
TRAIN = _split("ts, item_id") + ", tr AS (SELECT user_id, item_id FROM sp WHERE split = 'train'), te AS (SELECT user_id, item_id FROM sp WHERE split = 'test')"
POP = f", sc AS (SELECT item_id, CAST(count(*) AS DOUBLE) AS score FROM tr GROUP BY 1), pop AS (SELECT user_id, item_id, score, rank FROM (SELECT u.user_id, sc.item_id, score, row_number() OVER (PARTITION BY u.user_id ORDER BY score DESC, sc.item_id) AS rank FROM (SELECT DISTINCT user_id FROM tr) u CROSS JOIN sc WHERE NOT EXISTS (SELECT 1 FROM tr x WHERE x.user_id = u.user_id AND x.item_id = sc.item_id)) WHERE rank <= {N})"
#: Ranks the whole catalogue for each user in the order of their draws.
RND = f""", ic AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM (SELECT DISTINCT item_id FROM tr)), mm AS (SELECT greatest(count(*), 2) AS m FROM ic),
pr AS (SELECT min(x) AS p FROM (SELECT unnest(range(m, m + 1000)) AS x FROM mm) WHERE NOT EXISTS (SELECT 1 FROM range(2, 50000) g(d) WHERE d * d <= x AND x % d = 0)),
wh AS (SELECT user_id, p, ('0x' || substr(md5(user_id || ':42a'), 1, 12))::BIGINT % p AS a, 1 + ('0x' || substr(md5(user_id || ':42s'), 1, 12))::BIGINT % (p - 1) AS s FROM (SELECT DISTINCT user_id FROM tr) CROSS JOIN pr),
dr AS (SELECT user_id, j, (a + j * s) % p AS i FROM (SELECT *, unnest(range(1, p + 1)) AS j FROM wh)),
rnd AS (SELECT user_id, item_id, 0.0::DOUBLE AS score, rank FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY j) AS rank FROM dr JOIN ic USING (i)
  WHERE NOT EXISTS (SELECT 1 FROM tr x WHERE x.user_id = dr.user_id AND x.item_id = ic.item_id)) WHERE rank <= {N})"""


def _train_test(spark, d):
    """The split is written once and read by all that follows."""
    s = stored(splits(spark, d, "ts", "item_id"))
    return s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split")


def _pop(train):
    return reco.popularity(train, "user_id", "item_id", N)


def _rnd(train):
    return reco.random_items(train, "user_id", "item_id", N)


_add("popularity_recommend", TRAIN + POP + " SELECT * FROM pop")(lambda spark, d: _pop(_train_test(spark, d)[0]))
_add("random_recommend", TRAIN + RND + " SELECT * FROM rnd")(lambda spark, d: _rnd(_train_test(spark, d)[0]))


def _metrics(recs: str, name: str, ks=(5, 10)) -> str:
    idcg = lambda k: f"list_sum(list_transform(range(1, 1 + least(nrel, {k})), lambda r: 1 / log2(r + 1.0)))"
    cols = []
    for k in ks:
        h = f"list_filter(h, lambda r: r <= {k})"
        cols += [f"len({h})::DOUBLE / {k} AS precision_{k}", f"len({h})::DOUBLE / nrel AS recall_{k}", f"coalesce(list_sum(list_transform({h}, lambda r: 1 / log2(r + 1.0))), 0) / {idcg(k)} AS ndcg_{k}",
                 f"coalesce(list_sum(list_transform({h}, lambda r, i: i::DOUBLE / r)), 0) / least(nrel, {k}) AS map_{k}", f"CASE WHEN len({h}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hr_{k}"]
    return f""", nr_{name} AS (SELECT user_id, count(*) AS nrel FROM te GROUP BY 1), hh_{name} AS (SELECT user_id, list(rank ORDER BY rank) AS h FROM {recs} JOIN te USING (user_id, item_id) GROUP BY 1),
um_{name} AS (SELECT user_id, {', '.join(cols)}, coalesce(1.0::DOUBLE / h[1], 0.0) AS mrr FROM (SELECT user_id, nrel, coalesce(h, []::BIGINT[]) AS h FROM nr_{name} LEFT JOIN hh_{name} USING (user_id)))"""


NAMES = [f"{m}_{k}" for k in (5, 10) for m in ("precision", "recall", "ndcg", "map", "hr")] + ["mrr"]
_ROUNDED = ", ".join(f"round({c}, 9) AS {c}" for c in NAMES)
_MEANS = ", ".join(f"round(avg({c}), 9) AS {c}" for c in NAMES)


def _user_metrics(spark, d):
    train, test = _train_test(spark, d)
    return reco.user_metrics(_pop(train), test, "user_id", "item_id", (5, 10))


_add("per_user_metrics", TRAIN + POP + _metrics("pop", "p") + f" SELECT user_id, {_ROUNDED} FROM um_p")(lambda spark, d: (m := _user_metrics(spark, d)).select("user_id", *[F.round(c, 9).alias(c) for c in NAMES]))
def _evaluated(spark, d):
    train, test = _train_test(spark, d)
    return reco.evaluate(_pop(train), test, "user_id", "item_id", (5, 10))


_add("evaluate", TRAIN + POP + _metrics("pop", "p") + f" SELECT count(*) AS n_users, {_MEANS} FROM um_p")(_evaluated)
COMPARE = TRAIN + POP + RND + _metrics("pop", "p") + _metrics("rnd", "r") + f", cmp AS (SELECT 'popularity' AS model, count(*) AS n_users, {_MEANS} FROM um_p UNION ALL SELECT 'random', count(*), {_MEANS} FROM um_r)"


@_add("compare_models", COMPARE + " SELECT * FROM cmp")
def compare(spark, d):
    train, test = _train_test(spark, d)
    return reco.compare({"popularity": _pop(train), "random": _rnd(train)}, test, "user_id", "item_id", (5, 10))


LIFT = " SELECT round((max(CASE WHEN model = 'popularity' THEN recall_10 END) - max(CASE WHEN model = 'random' THEN recall_10 END)) / (max(CASE WHEN model = 'random' THEN recall_10 END) + 1e-9) * 100, 4) AS recall_10_lift_pct FROM cmp"


@_add("metric_lift", COMPARE + LIFT)
def lift(spark, d):
    return _lift(compare(spark, d))


def _lift(models):
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("recall_10")))
    return models.agg(F.round((of("popularity") - of("random")) / (of("random") + 1e-9) * 100, 4).alias("recall_10_lift_pct"))


_add("per_user_ndcg", TRAIN + POP + _metrics("pop", "p") + " SELECT round(avg(ndcg_10), 9) AS mean, round(median(ndcg_10), 9) AS med, round(stddev_pop(ndcg_10), 9) AS std, round(avg(CASE WHEN ndcg_10 > 0 THEN 1.0::DOUBLE ELSE 0 END) * 100, 9) AS positive_pct FROM um_p")(
    lambda spark, d: _user_metrics(spark, d).agg(F.round(F.avg("ndcg_10"), 9).alias("mean"), F.round(F.median("ndcg_10"), 9).alias("med"), F.round(F.stddev_pop("ndcg_10"), 9).alias("std"), F.round(F.avg(F.when(F.col("ndcg_10") > 0, 1.0).otherwise(0.0)) * 100, 9).alias("positive_pct")))
_one("similar_items", "o AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], v::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[])) + 1e-9), 6) AS score FROM embeddings CROSS JOIN o WHERE vec_id <> 7 ORDER BY score DESC, vec_id LIMIT 10",
     lambda t, s, k, d: reco.similar(t("embeddings"), "vec_id", "embedding", 7, 10))
_one("longtail_share", "n AS (SELECT item_id, count(*) AS n FROM r_inter GROUP BY 1), c AS (SELECT row_number() OVER (ORDER BY n DESC, item_id) AS r, sum(n) OVER (ORDER BY n DESC, item_id ROWS UNBOUNDED PRECEDING) AS s, sum(n) OVER () AS t FROM n) SELECT min(r) FILTER (WHERE s * 1000 >= t * 800) AS items_needed, count(*) AS all_items, CAST(max(t) AS BIGINT) AS interactions FROM c",
     lambda t, s, k, d: reco.longtail(s.interactions(k, d), "item_id"))


@_add("explain_user", TRAIN + POP + """, w AS (SELECT min(user_id) AS u FROM tr), x AS (
  SELECT 'seen' AS kind, row_number() OVER (ORDER BY item_id) AS place, item_id, NULL::DOUBLE AS score FROM (SELECT DISTINCT item_id FROM tr, w WHERE user_id = u)
  UNION ALL SELECT 'recommended', rank, item_id, score FROM pop, w WHERE user_id = u)
SELECT kind, place, item_id, coalesce(p_name, 'Item ' || item_id) AS title, score FROM x LEFT JOIN part ON p_partkey = item_id""")
def explain(spark, d):
    """What the first user has seen, and their recommendations, with titles."""
    train, _ = _train_test(spark, d)
    titles = S.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))
    who = train.agg(F.min("user_id")).first()[0]
    return reco.explain_user(train, _pop(train), titles, "user_id", "item_id", who, N)


@_add("map_id", TRAIN + """, ui AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS u FROM (SELECT DISTINCT user_id FROM tr)), ii AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM (SELECT DISTINCT item_id FROM tr))
SELECT u AS user_idx, i AS item_idx, 1.0::DOUBLE AS value FROM tr JOIN ui USING (user_id) JOIN ii USING (item_id)""")
def map_id(spark, d):
    """Interactions by index, as ones."""
    train, _ = _train_test(spark, d)
    rows = reco.map_ids(train, user_id=reco.encode(train, "user_id", "u"), item_id=reco.encode(train, "item_id", "i"))
    return reco.binarize(rows).select(F.col("user_id_idx").cast("bigint").alias("user_idx"), F.col("item_id_idx").cast("bigint").alias("item_idx"), "value")


def _als(spark, d, engine):
    from .operators import als

    train, test = _train_test(spark, d)
    train = train.select(F.col("user_id").alias("user"), F.col("item_id").alias("item"))
    return als, train, als.fit(train, engine=engine), test  # the defaults: 64 factors and 20 iterations


@_add("als_recommend")
def als_recommend(spark, d):
    als, train, m, _ = _als(spark, d, "mllib")
    return als.recommend(m, train.select("user"), train, 10)


@_add("als_exact_history")
def als_history(spark, d):
    """The loss after each sweep of the exact solver."""
    _, _, m, _ = _als(spark, d, "exact")
    return spark.createDataFrame([(h["iteration"], h["train_loss"]) for h in m.history], "iteration int, train_loss double")


@_add("als_evaluate")
def als_evaluate(spark, d):
    als, train, m, test = _als(spark, d, "mllib")
    recs = als.recommend(m, train.select("user"), train, 10).withColumnsRenamed({"user": "user_id", "item": "item_id"})
    return reco.evaluate(recs, test, "user_id", "item_id", (5, 10))


@_add("pca_2d")
def pca_2d(spark, d):
    from .operators import als

    return als.pca(S.table(spark, d, "embeddings"), "vec_id", "embedding")[0]

"""The six retail analyses and their variants.  Functions take and return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cents, ratio_round, valid
from ..plans import ntile_distributed

PERIODS = 7


def cohort_retention(users: DataFrame, orders: DataFrame, periods: int = PERIODS) -> DataFrame:
    """Share of each signup month's users that order in calendar months 0 to periods - 1 after it.

    Every cohort has every period; the delta is taken between unrounded shares.
    """
    cohorts = users.select("user_id", F.trunc("signup_date", "MM").alias("cohort_month"))
    size = cohorts.groupBy("cohort_month").agg(F.count_distinct("user_id").alias("cohort_size"))
    month = F.col("order_date")
    period = (F.year(month) - F.year("cohort_month")) * 12 + F.month(month) - F.month("cohort_month")
    seen = (orders.where(valid(F.col("status"))).select("user_id", F.trunc("order_date", "MM").alias("order_date")).distinct()
            .join(cohorts, "user_id").select("cohort_month", "user_id", period.alias("p")).where(F.col("p").between(0, periods - 1)))
    active = seen.groupBy("cohort_month", "p").agg(F.count_distinct("user_id").alias("n"))
    grid = size.select("cohort_month", "cohort_size", F.explode(F.sequence(F.lit(0), F.lit(periods - 1))).alias("p"))
    full = grid.join(active, ["cohort_month", "p"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    last = F.lag("n").over(Window.partitionBy("cohort_month").orderBy("p"))
    return full.select(
        "cohort_month", F.col("cohort_size").cast("bigint").alias("cohort_size"), F.col("p").cast("bigint").alias("months_since_signup"), F.col("n").cast("bigint").alias("active_users"),
        ratio_round(100 * F.col("n"), F.col("cohort_size"), 1).alias("retention_pct"),
        ratio_round(100 * (F.col("n") - last), F.col("cohort_size"), 1).alias("retention_delta_ppt")).orderBy("cohort_month", "months_since_signup")


def conversion_funnel(events: DataFrame, products: DataFrame, few: int = 100) -> DataFrame:
    """Distinct viewers, carters and purchasers by category.  The three sets are independent, so rates can pass 100."""
    e = events.join(products.select("product_id", "category_name"), "product_id")
    who = lambda kind: F.count_distinct(F.when(F.col("event_type") == kind, F.col("user_id")))
    f = e.groupBy("category_name").agg(F.count_distinct("product_id").alias("product_count"), who("view").alias("viewers"), who("add_to_cart").alias("add_to_carts"), who("purchase").alias("purchasers"))
    f = f.withColumn("lost_buyers", F.col("viewers") - F.col("purchasers"))
    return f.withColumns({
        "view_to_cart_pct": ratio_round(100 * F.col("add_to_carts"), F.col("viewers"), 1),
        "cart_to_purchase_pct": ratio_round(100 * F.col("purchasers"), F.col("add_to_carts"), 1),
        "overall_conversion_pct": ratio_round(100 * F.col("purchasers"), F.col("viewers"), 1),
        "lost_buyer_rank": F.rank().over(Window.orderBy(F.col("lost_buyers").desc())).cast("bigint"),
        "data_quality_flag": F.when(F.col("viewers") < few, "low-traffic").otherwise("sufficient volume")}).orderBy(F.col("overall_conversion_pct").desc(), "category_name")


def rfm_base(orders: DataFrame, as_of: str) -> DataFrame:
    return orders.where(valid(F.col("status"))).groupBy("user_id").agg(
        F.datediff(F.lit(as_of).cast("date"), F.max("order_date")).cast("bigint").alias("recency_days"),
        F.count_distinct("order_id").alias("frequency"), F.sum("total_amount").alias("monetary"))


def rfm_named(scored: DataFrame, users: DataFrame) -> DataFrame:
    """Mean score and segment; the first condition that holds wins."""
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    name = (F.when((r >= 4) & (f >= 4) & (m >= 4), "Gold").when((r >= 3) & (f >= 3) & (m >= 3), "Silver").when((r >= 4) & (f <= 2), "New High-Value")
            .when((r <= 2) & (f >= 4), "At-Risk VIP").when((r <= 2) & (f <= 2), "Churned").otherwise("Bronze"))
    return scored.join(users.select("user_id", "email", "country"), "user_id").select(
        "user_id", "email", "country", "recency_days", "frequency", F.col("monetary").cast("double").alias("monetary"),
        *[F.col(c).cast("bigint").alias(c) for c in ("r_score", "f_score", "m_score")], ratio_round(r + f + m, F.lit(3), 2).alias("rfm_score"), name.alias("customer_segment"))


def rfm_segmentation(orders: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """Quintiles of recency, frequency and spend per user, best scores and spenders first; ties go by user_id.

    Users are numbered by ranges, so no window takes all of them to one partition.
    """
    s = rfm_base(orders, as_of)
    for c, to in (("recency_days", "r_score"), ("frequency", "f_score"), ("monetary", "m_score")):
        s = ntile_distributed(s, 5, c, "user_id", to=to)
    return rfm_named(s.withColumn("r_score", 6 - F.col("r_score")), users).orderBy(F.col("rfm_score").desc(), F.col("monetary").desc(), "user_id")


def daily_revenue(orders: DataFrame) -> DataFrame:
    d = orders.where(valid(F.col("status"))).groupBy("order_date").agg(
        F.count_distinct("order_id").alias("orders"), F.count_distinct("user_id").alias("buyers"), F.sum(cents(F.col("total_amount"))).alias("gmv_cents"))
    return d.withColumn("aov", ratio_round(F.col("gmv_cents"), F.col("orders") * 100, 2))


def _money(c) -> F.Column:
    return c.cast("double") / 100.0


def rolling_revenue(orders: DataFrame, calendar: bool = False, by_month: bool = False) -> DataFrame:
    """Daily revenue, sums over 7 and 30 rows, and growth on the month before.

    calendar: the sums cover days, not rows.  by_month: growth compares months; otherwise, as the
    original query does, the lag runs over daily rows in the order of (month, day).
    The windows run over days, whose number doesn't follow the orders.
    """
    daily = daily_revenue(orders)
    month = F.trunc("order_date", "MM")
    if calendar:
        w = Window.orderBy(F.datediff("order_date", F.lit("1970-01-01").cast("date")))
        over = lambda k: w.rangeBetween(-k + 1, 0)
    else:
        over = lambda k: Window.orderBy("order_date").rowsBetween(-k + 1, 0)
    rolled = daily.select("order_date", month.alias("m"), "gmv_cents", F.sum("gmv_cents").over(over(7)).alias("s7"), F.sum("gmv_cents").over(over(30)).alias("s30"), F.sum("buyers").over(over(30)).alias("buyers_30d"))
    months = daily.groupBy(month.alias("m")).agg(F.sum("gmv_cents").alias("month_cents"))
    if by_month:
        months = months.withColumn("prev", F.lag("month_cents").over(Window.orderBy("m")))
    j = rolled.join(months, "m")
    if not by_month:
        j = j.withColumn("prev", F.lag("month_cents").over(Window.orderBy("m", "order_date")))
    return j.select(
        "order_date", _money(F.col("gmv_cents")).alias("daily_gmv"), _money(F.col("s7")).alias("gmv_7d"), _money(F.col("s30")).alias("gmv_30d"), F.col("buyers_30d").cast("bigint").alias("buyers_30d"),
        _money(F.col("month_cents")).alias("monthly_gmv"), _money(F.col("prev")).alias("prev_month_gmv"), ratio_round(100 * (F.col("month_cents") - F.col("prev")), F.col("prev"), 1).alias("mom_growth_pct")).orderBy("order_date")


#: Products of an order from which on its pairs are made by a join of chunks instead of in one row.
LARGE, CHUNK = 256, 64


def product_pairs(items: DataFrame) -> DataFrame:
    """a < b, n: in how many orders both stand.  Repeats go before pairs are made.

    Pairs of an order are made in its row; an order of over `LARGE` products is dealt in chunks of about `CHUNK`, of which each
    meets each later one, so no row or task holds all pairs of one order.
    """
    each = items.select("order_id", "product_id").distinct()
    sizes = each.groupBy("order_id").agg(F.count("*").alias("_n"))
    sized = each.join(sizes.where("_n > 1"), "order_id")
    baskets = sized.where(F.col("_n") <= LARGE).groupBy("order_id").agg(F.array_sort(F.collect_list("product_id")).alias("p"))
    pairs = F.expr("flatten(transform(p, (a, i) -> transform(slice(p, i + 2, size(p)), b -> struct(a AS a, b AS b))))")
    small = baskets.select(F.explode(pairs).alias("x")).select("x.a", "x.b")
    chunks = F.ceil(F.col("_n") / CHUNK).cast("int")
    dealt = sized.where(F.col("_n") > LARGE).withColumn("_c", F.pmod(F.xxhash64("product_id"), chunks).cast("int"))
    left = dealt.select("order_id", F.col("product_id").alias("x"), F.col("_c").alias("_i"), F.explode(F.sequence(F.col("_c"), chunks - 1)).alias("_j"))
    right = dealt.select("order_id", F.col("product_id").alias("y"), F.col("_c").alias("_j"), F.explode(F.sequence(F.lit(0), F.col("_c"))).alias("_i"))
    both = left.join(right, ["order_id", "_i", "_j"]).where((F.col("_i") < F.col("_j")) & (F.col("x") != F.col("y")) | (F.col("_i") == F.col("_j")) & (F.col("x") < F.col("y")))
    large = both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return small.unionByName(large).groupBy("a", "b").agg(F.count("*").alias("n"))


def market_basket(items: DataFrame, products: DataFrame, least: int = 3, top: int | None = 50) -> DataFrame:
    """Product pairs of `least` orders or more with support and pair type; `top` is the report's length."""
    total = items.agg(F.count_distinct("order_id").alias("total"))
    pairs = product_pairs(items).where(F.col("n") >= least)
    side = lambda x: products.select(F.col("product_id").alias(x), F.col("title").alias(f"product_{x}"), F.col("category_name").alias(f"category_{x}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b").crossJoin(F.broadcast(total))  # one row
    order = [F.col("n").desc(), F.col("a"), F.col("b")]
    if top:
        j = j.orderBy(*order).limit(top)
    return j.select(
        F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"), "product_a", "category_a", "product_b", "category_b", F.col("n").cast("bigint").alias("co_purchase_count"),
        ratio_round(100 * F.col("n"), F.col("total"), 3).alias("support_pct"), F.when(F.col("category_a") != F.col("category_b"), "cross-category").otherwise("same-category").alias("pair_type"))


def basket_rules(items: DataFrame, least: int = 2) -> DataFrame:
    """Confidence and lift of pairs: an addition to the original report."""
    single = items.select("order_id", "product_id").distinct().groupBy("product_id").agg(F.count("*").alias("k"))
    total = items.agg(F.count_distinct("order_id").alias("total"))
    j = product_pairs(items).where(F.col("n") >= least)
    for x in ("a", "b"):
        j = j.join(single.select(F.col("product_id").alias(x), F.col("k").alias(f"k_{x}")), x)
    j = j.crossJoin(F.broadcast(total))
    return j.select("a", "b", F.col("n").cast("bigint").alias("n"), ratio_round(F.col("n"), F.col("k_a"), 6).alias("confidence_ab"), ratio_round(F.col("n"), F.col("k_b"), 6).alias("confidence_ba"),
                    ratio_round(F.col("n") * F.col("total"), F.col("k_a") * F.col("k_b"), 6).alias("lift"))


def geo_revenue_rollup(users: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame, exact: bool = False) -> DataFrame:
    """Orders and revenue by country and category with subtotals.

    As written, an order's amount counts once per item of it; exact: the item's own amount counts.
    """
    amount = cents(F.col("amount" if exact else "total_amount"))
    facts = (orders.where(valid(F.col("status"))).join(items, "order_id").join(products.select("product_id", "category_name"), "product_id")
             .join(users.select("user_id", "country"), "user_id").select("country", "category_name", "order_id", amount.alias("cents")))
    raw = facts.rollup("country", "category_name").agg(F.count_distinct("order_id").alias("orders"), F.sum("cents").alias("c"), F.count("*").alias("k"), F.grouping("country").alias("gc"), F.grouping("category_name").alias("gk"))
    kind = F.when(F.col("gc") == 1, "grand_total").when(F.col("gk") == 1, "country_subtotal").otherwise("detail")
    raw = raw.withColumns({"all_orders": F.sum("orders").over(Window.partitionBy()), "country_c": F.sum("c").over(Window.partitionBy("gc", "country"))})
    aov = ratio_round(F.col("c"), F.col("orders" if exact else "k") * 100, 2)
    return raw.select(
        F.when(F.col("gc") == 1, "── ALL COUNTRIES ──").otherwise(F.col("country")).alias("country"), F.when(F.col("gk") == 1, "  (all categories)").otherwise(F.col("category_name")).alias("category_name"),
        F.col("orders").cast("bigint").alias("orders"), _money(F.col("c")).alias("gmv"), aov.alias("aov"), ratio_round(100 * F.col("orders"), F.col("all_orders"), 2).alias("order_share_pct"),
        ratio_round(100 * F.col("c"), F.col("country_c"), 1).alias("gmv_share_in_country_pct"), kind.alias("row_type")).orderBy(
        F.when(F.col("row_type") == "grand_total", 2).when(F.col("row_type") == "country_subtotal", 1).otherwise(0), F.col("gmv").desc_nulls_last(), "category_name", "country")


def user_monthly_activity(orders: DataFrame) -> DataFrame:
    return orders.where(valid(F.col("status"))).groupBy("user_id", F.trunc("order_date", "MM").alias("activity_month")).agg(
        F.count_distinct("order_id").alias("order_count"), F.sum("total_amount").cast("double").alias("total_spent"))

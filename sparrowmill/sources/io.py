"""Readers, writers and seeded generators."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str, encoding: str = "UTF-8") -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, encoding=encoding)


def read_interactions(spark: SparkSession, path: str, user: str = "user_id", item: str = "item_id", rating: str | None = None, timestamp: str | None = None) -> DataFrame:
    """A CSV of interactions; only the named columns are kept, and rows without user or item go."""
    df = spark.read.csv(path, header=True)
    kept = [c for c in (user, item, rating, timestamp) if c]
    return df.select(*kept).dropna(subset=[user, item])


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated user, item, rating, timestamp without a header."""
    return spark.read.csv(path, sep="\t", schema="user_id int, item_id int, rating int, timestamp int")


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """The first two of many fields between pipes, in Latin-1."""
    df = spark.read.csv(path, sep="|", encoding="ISO-8859-1", schema="item_id int, title string", mode="PERMISSIVE")
    return df.select("item_id", "title")


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Any JDBC source whose driver is on the class path."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def write_jdbc(df: DataFrame, url: str, name: str, batch: int = 500, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=name, batchsize=str(batch), **options).mode("append").save()


def run_sql_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.sql(Path(path).read_text(encoding="utf-8").rstrip().rstrip(";"))


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; `single` is for reports of few rows."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def upsert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` and those rows of `new` whose keys it doesn't have, one for each key."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def swap_in(df: DataFrame, path: str) -> None:
    """Replace a table: the new one is written beside it, the old one renamed away, the new one renamed to its place, then the old one deleted.

    There is a moment without a table at `path`, but never one without a whole table on disk: after a crash between the two
    renames both lie beside it, as `.old-...` and `.staged-...`.  If the second rename fails, the old one is put back.
    """
    spark = df.sparkSession
    tag, place = uuid.uuid4().hex, spark._jvm.org.apache.hadoop.fs.Path
    staged, target, old = place(f"{path}.staged-{tag}"), place(path), place(f"{path}.old-{tag}")
    df.write.parquet(f"{path}.staged-{tag}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(target)
    if there and not fs.rename(target, old):
        raise OSError(f"can't rename {path}")
    if not fs.rename(staged, target):
        if there:
            fs.rename(old, target)
        raise OSError(f"can't rename {path}.staged-{tag}")
    fs.delete(old, True)


def row_counts(tables: dict[str, DataFrame]) -> dict[str, int]:
    return {n: t.count() for n, t in tables.items()}


def _uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) that depends on its arguments alone."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def synthetic_interactions(spark: SparkSession, n_users: int = 1000, n_items: int = 500, per_user: int = 20, skew: float = 1.8, seed: int = 42) -> DataFrame:
    """user_id, item_id: for each user `per_user` different items, drawn by Zipf weights without replacement.

    The keys -log(u) / weight are exponential races: the least ones are such a draw.
    """
    users = spark.range(n_users).select(F.col("id").alias("user_id"))
    items = spark.range(n_items).select(F.col("id").alias("item_id"), (1 / F.pow(F.col("id") + 1.0, skew)).alias("w"))
    key = -F.log(_uniform("user_id", "item_id", F.lit(seed))) / F.col("w")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("k", "item_id"))
    return users.crossJoin(F.broadcast(items)).withColumn("k", key).withColumn("r", rank).where(F.col("r") <= per_user).select("user_id", "item_id")


#: Values of our own.
COUNTRIES = ["AT", "CH", "DK", "ES", "FI", "IE", "IT", "NO", "PT", "SE"]
CATEGORIES = ["Audio", "Bicycles", "Furniture", "Gardening", "Kitchenware", "Music", "Shoes", "Stationery"]
#: Order statuses as often as they occur.
STATUSES = ["delivered", "delivered", "delivered", "shipped", "confirmed", "cancelled", "refunded"]


def _pick(values: list[str], u: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))


def seasonal_weight(day: Column) -> Column:
    """How likely orders are in a month: high before the new year, low after it.  Fixed values."""
    m = F.month(day)
    return F.when(m.isin(11, 12), 3.0).when(m == 7, 2.0).when(m.isin(1, 2), 0.7).otherwise(1.0)


def retail_data(spark: SparkSession, users: int = 500, products: int = 200, orders: int = 8000, organic: int = 15000, seed: int = 42) -> dict[str, DataFrame]:
    """A seeded star schema: users, categories, products, orders, items, events, reviews."""
    u = lambda *x: _uniform(*x, F.lit(seed))
    day = lambda r, span=729: F.expr("DATE '2023-01-01'") + F.floor(r * span).cast("int")
    users_ = spark.range(1, users + 1).select(F.col("id").alias("user_id"), F.concat(F.lit("user"), "id", F.lit("@example.com")).alias("email"), _pick(COUNTRIES, u("id", F.lit("c"))).alias("country"), day(u("id", F.lit("s"))).alias("signup_date"))
    users_ = users_.withColumn("segment", F.when(F.col("signup_date") >= "2024-09-01", "new").when(u("user_id", F.lit("g")) < 0.1, "vip").when(u("user_id", F.lit("g")) < 0.3, "churned").otherwise("active"))
    categories = spark.createDataFrame([(i + 1, c) for i, c in enumerate(CATEGORIES)], "category_id long, name string")
    products_ = spark.range(1, products + 1).select(F.col("id").alias("product_id"), (F.col("id") % len(CATEGORIES) + 1).alias("category_id"), F.concat(F.lit("Product "), "id").alias("title"), (5 + 495 * u("id", F.lit("p"))).cast("decimal(10,2)").alias("price"))
    # rejection-free seasonal days: of four candidate days the one that wins the weighted race
    days = F.array(*[day(u("id", F.lit(f"d{k}"))) for k in range(4)])
    raced = F.array_min(F.transform(days, lambda x: F.struct((-F.log(_uniform("id", x, F.lit(seed))) / seasonal_weight(x)).alias("k"), x.alias("day"))))["day"]
    buyer = F.floor(F.pow(u("id", F.lit("u")), 1.3) * users).cast("long") + 1
    o = spark.range(1, orders + 1).select(F.col("id").alias("order_id"), buyer.alias("user_id"), raced.alias("order_date"), _pick(STATUSES, u("id", F.lit("st"))).alias("status"), F.floor(1 + 6 * F.pow(u("id", F.lit("n")), 2)).cast("int").alias("n"))
    items = o.select("order_id", "user_id", "order_date", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("line"))
    items = items.withColumns({"product_id": F.floor(u("order_id", "line", F.lit("i")) * products).cast("long") + 1, "quantity": F.floor(1 + 3 * u("order_id", "line", F.lit("q"))).cast("int")}).join(products_.select("product_id", F.col("price").alias("unit_price")), "product_id")
    total = items.groupBy("order_id").agg(F.sum(F.col("quantity") * F.col("unit_price")).cast("decimal(12,2)").alias("total_amount"))
    orders_ = o.drop("n").join(total, "order_id")
    steps = F.explode(F.filter(F.array(F.lit("view"), F.when(u("order_id", "line", F.lit("a")) < 0.6, "add_to_cart"), F.lit("purchase")), lambda x: x.isNotNull()))
    seen = items.select("user_id", "product_id", steps.alias("event_type"), F.col("order_date").cast("timestamp").alias("event_time"))
    more = spark.range(organic).select((F.floor(u("id", F.lit("ou")) * users) + 1).cast("long").alias("user_id"), (F.floor(u("id", F.lit("op")) * products) + 1).cast("long").alias("product_id"), F.lit("view").alias("event_type"), day(u("id", F.lit("od"))).cast("timestamp").alias("event_time"))
    reviews = items.dropDuplicates(["user_id", "product_id"]).where(u("user_id", "product_id", F.lit("r")) < 0.35).select("user_id", "product_id", F.floor(1 + 5 * F.sqrt(u("user_id", "product_id", F.lit("rt")))).cast("int").alias("rating"), F.lit(True).alias("verified_purchase"))
    return {"users": users_, "categories": categories, "products": products_, "orders": orders_, "items": items.select("order_id", "line", "product_id", "quantity", "unit_price"), "events": seen.unionByName(more), "reviews": reviews}

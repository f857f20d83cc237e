"""Session settings and ranking without a single partition."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the queries assume."""
    b = SparkSession.builder.config(map={"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **conf})
    return (b.master(master) if master else b).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder that the session has set.

    Only a local session, where there is one machine, gets a temporary one if neither is there.
    """
    sc = spark.sparkContext
    base, jdir = spark.conf.get("spark.checkpoint.dir", None), sc._jsc.sc().getCheckpointDir()
    if not jdir.isDefined():
        if not base:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="sparrowmill-")
        sc.setCheckpointDir(base)
        jdir = sc._jsc.sc().getCheckpointDir()
    return base or jdir.get()


def cut(df: DataFrame) -> DataFrame:
    """End the lineage of a table in the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """`cut` as Parquet, which takes a fraction of a checkpoint's disk; it stays in the shared folder until `forget`."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete what `stored` wrote for these frames; nothing that is still to run may read them."""
    for df in frames:
        if path := getattr(df, "_stored", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def global_row_number(df: DataFrame, *order: str | Column, to: str = "rn") -> DataFrame:
    """Number the rows 1 to n in a total order, without moving them to one partition.

    Rows are range-partitioned and cached by a reliable checkpoint, so that both uses see the same
    partitions; a number is the place in its partition plus the sizes of the partitions before,
    which are as many as partitions and so small enough to broadcast.
    """
    part = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = part.groupBy("_p").agg(F.count("*").alias("_k"))
    before = sizes.select("_p", F.coalesce(F.sum("_k").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return part.withColumn("_r", own).join(F.broadcast(before), "_p").withColumn(to, F.col("_r") + F.col("_b")).drop("_p", "_r", "_b")


def running_share(df: DataFrame, value: str, *order: str | Column, to: str = "share") -> DataFrame:
    """The sum of `value` up to each row over the sum of all, in a total order, without moving the rows to one partition."""
    part = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sums = part.groupBy("_p").agg(F.sum(value).alias("_k"))  # a row for each partition
    w = Window.orderBy("_p")
    before = sums.select("_p", F.coalesce(F.sum("_k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"), F.sum("_k").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_t"))
    own = F.sum(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return part.withColumn("_s", own).join(F.broadcast(before), "_p").withColumn(to, (F.col("_s") + F.col("_b")) / F.col("_t").cast("double")).drop("_p", "_s", "_b", "_t")


def ntile_distributed(df: DataFrame, tiles: int, *order: str | Column, to: str = "tile") -> DataFrame:
    """SQL's NTILE over all rows: the first n mod tiles groups have one row more."""
    n = df.count()
    q, r = divmod(n, tiles)
    k = F.col("_rn") - 1
    tile = F.when(k < r * (q + 1), F.floor(k / (q + 1))).otherwise(r + F.floor((k - r * (q + 1)) / max(q, 1))) + 1
    return global_row_number(df, *order, to="_rn").withColumn(to, tile.cast("int")).drop("_rn")


def pushed(df: DataFrame) -> str:
    """The physical plan as text, to look at pushed filters and read schemas."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

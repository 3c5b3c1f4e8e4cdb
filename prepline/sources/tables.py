"""Loading the driver tables and the deterministic damage used by tests and queries.

Damage never removes rows: it nulls, NaNs, duplicates or scales values of whole tables by
integer rules on their keys, written once for Spark and once as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a driver table. A scan that yields fewer partitions than the session's
    parallelism (one small file with one row group) is spread round-robin first, so the
    row-wise work before the first shuffle uses every core; a large table's scan already has
    many more partitions and is left alone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, f"{sf_dir}/{name}.parquet")


#: bytes of files for each partition of a spread table, at most
SPREAD_BYTES = 8 << 20


def spread(df: DataFrame, path: str | None = None) -> DataFrame:
    """With the ``path`` of its files, a table is dealt over more partitions the larger it is, so that what a
    task reads and holds does not grow with it."""
    spark = df.sparkSession
    target = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    if path is not None:
        size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
        target = max(target, -(-size // SPREAD_BYTES))
    return df.repartition(target)


def orders_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.withColumn(
        "o_totalprice",
        F.when(k % 7 == 0, F.lit(None).cast("double")).when(k % 11 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")),
    ).withColumn("o_orderpriority", F.when(k % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")))


ORDERS_MISSING_SQL = """(SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE o_totalprice END AS o_totalprice,
  o_orderdate,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders)"""


def orders_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.unionAll(o.where(F.col("o_orderkey") % 10 == 0))


ORDERS_DUP_SQL = "(SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 0)"


def lineitem_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    return li.withColumn(
        "l_extendedprice", F.when(F.col("l_orderkey") % 997 == 0, F.col("l_extendedprice") * 50).otherwise(F.col("l_extendedprice"))
    )


LINEITEM_OUTLIER_SQL = """(SELECT * REPLACE (CASE WHEN l_orderkey % 997 = 0 THEN l_extendedprice * 50 ELSE l_extendedprice END AS l_extendedprice)
FROM lineitem)"""


def orders_text_dates(spark: SparkSession, sf_dir: str, mixed: bool = False) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    s = F.date_format("o_orderdate", "yyyy-MM-dd")
    if mixed:
        s = F.when(F.col("o_orderkey") % 17 == 0, F.lit("not a date")).otherwise(s)
    return o.withColumn("o_orderdate", s)


def orders_text_dates_sql(mixed: bool = False) -> str:
    s = "strftime(o_orderdate, '%Y-%m-%d')"
    if mixed:
        s = f"CASE WHEN o_orderkey % 17 = 0 THEN 'not a date' ELSE {s} END"
    return f"(SELECT * REPLACE ({s} AS o_orderdate) FROM orders)"


def daily_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders summed by day: (ts, y); gaps stay gaps."""
    o = load(spark, sf_dir, "orders")
    # date_trunc returns a zoned TIMESTAMP; back to the wall clock (timestamp_ntz)
    return o.groupBy(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("ts")).agg(F.sum("o_totalprice").alias("y"))


DAILY_REVENUE_SQL = "(SELECT date_trunc('day', o_orderdate) AS ts, sum(o_totalprice) AS y FROM orders GROUP BY 1)"

"""Role mapping of the driver's TPC-H-like tables onto the activity-log
model, as projections only (so column pruning and filter pushdown reach
the Parquet scans):

=============  =====================================================
role           table
=============  =====================================================
header         orders: id=o_orderkey, gym_id=o_custkey,
               started_at=o_orderdate, finished_at = NULL for open
               ('O') orders, else o_orderdate + floor(o_totalprice/1e4)
               minutes, notes=o_orderpriority
header dim     customer: id=c_custkey, name=c_name, sort_order=c_nationkey
child          lineitem: workout_id=l_orderkey, sort_order=l_linenumber,
               max_weight=l_quantity as decimal(6,2); name=p_name and
               machine=p_brand through part. lineitem has no unique
               key, so the child key is the whole row (LINE_KEY).
member dim     region: id=r_regionkey, name=r_name, sort_order=r_regionkey
bridge         supplier -> nation: child column l_suppkey ->
               body_part_id=n_regionkey (one member per child)
word bridge    part: child column l_partkey -> each word of p_name
               (many members per child)
attempts       events: key=user_id, error -> fail, signup -> success
=============  =====================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmart.schemas import WEIGHT_TYPE

# lineitem has no unique key; its whole row is unique.
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    minutes = F.floor(F.col("o_totalprice") / 10000).cast("int")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("gym_id"),
        F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderstatus") == "O", F.lit(None))
         .otherwise(F.col("o_orderdate") + F.make_dt_interval(mins=minutes)).alias("finished_at"),
        F.col("o_orderpriority").alias("notes"),
    )


HEADERS_SQL = """SELECT o_orderkey AS id, o_custkey AS gym_id, o_orderdate AS started_at,
  CASE WHEN o_orderstatus = 'O' THEN NULL
       ELSE o_orderdate + to_minutes(CAST(floor(o_totalprice / 10000) AS BIGINT)) END AS finished_at,
  o_orderpriority AS notes
FROM orders"""


def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("sort_order"))


def children(spark: SparkSession, sf_dir: str, with_name: bool = False) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    c = li.select(*LINE_KEY, F.col("l_orderkey").alias("workout_id"),
                  F.col("l_linenumber").alias("sort_order"),
                  F.col("l_quantity").cast(WEIGHT_TYPE).alias("max_weight"))
    if with_name:
        p = table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"),
            F.col("p_brand").alias("machine"))
        c = c.join(p, "l_partkey")
    return c


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"),
        F.col("r_regionkey").alias("sort_order"))


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("body_part_id"))
    return s.join(n, "s_nationkey").select("s_suppkey", "body_part_id")


def word_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word")).distinct()


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.where(F.col("event_type").isin("error", "signup")).select(
        F.col("user_id").cast("string").alias("key"),
        F.col("event_id").alias("attempt_id"),
        F.col("ts"),
        F.when(F.col("event_type") == "error", "fail").otherwise("success").alias("kind"))

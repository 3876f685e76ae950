"""The star-schema tables in the roles of points, labels and metrics, in DataFrame and SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


POINTS_SQL = """p AS (
  SELECT event_type AS plot, event_id AS point_id, CAST(user_id AS DOUBLE) AS x, CAST(event_id % 101 AS DOUBLE) AS y, CAST(value AS DOUBLE) AS z,
    CAST(event_id % 7 AS INT) AS classification, CAST(user_id % 12 AS BIGINT) AS gt_id,
    CAST(CASE WHEN event_id % 12 < user_id % 12 THEN (user_id % 12 + 1) % 12 ELSE user_id % 12 END AS BIGINT) AS pred_id
  FROM events)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    gt = F.col("user_id") % 12
    return e.select(
        F.col("event_type").alias("plot"), F.col("event_id").alias("point_id"), F.col("user_id").cast("double").alias("x"), (F.col("event_id") % 101).cast("double").alias("y"),
        F.col("value").cast("double").alias("z"), (F.col("event_id") % 7).cast("int").alias("classification"), gt.cast("long").alias("gt_id"),
        F.when(F.col("event_id") % 12 < gt, (gt + 1) % 12).otherwise(gt).cast("long").alias("pred_id"),
    )


METRICS_SQL = """m AS (
  SELECT n_name AS plot, r_name AS institution, o_orderpriority AS method,
    AVG(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END) AS f1, AVG(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS "precision",
    AVG(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END) AS recall, AVG(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END) AS coverage,
    CAST(SUM(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS tp, COUNT(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    # 25 nations and 5 regions, whatever the scale
    places = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.col("n_name").alias("plot"), F.col("r_name").alias("institution"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    share = lambda cond, name: F.avg(F.when(cond, 1.0).otherwise(0.0)).alias(name)
    s = F.col("o_orderstatus")
    return j.groupBy("plot", "institution", F.col("o_orderpriority").alias("method")).agg(
        share(s == "O", "f1"), share(s == "F", "precision"), share(s == "P", "recall"), share(F.col("o_totalprice") > 150000, "coverage"), F.count_if(s == "O").alias("tp"), F.count("*").alias("n")
    )

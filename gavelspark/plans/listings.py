"""Listings, search logs and scraper runs seen in the TPC-H-like test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str, values: bool = True) -> DataFrame:
    """One listing for each order: line sums are made before the join, on the
    join's key, so orders and sums meet in one exchange. Without `values`, lines
    and sellers stay unread, and the columns that come from them are left out."""
    orders, customer, nation, region = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region"))
    k = F.col("o_orderkey")
    columns = [
        F.concat(F.lit("ord-"), k).alias("id"), k.alias("key"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("category"), F.col("o_orderpriority").alias("auction_type"),
        F.col("n_name").alias("state"), F.col("r_name").alias("city"), F.when(k % 3 > 0, F.concat(F.lit("Zone "), k % 11)).alias("neighborhood"), F.col("o_totalprice").alias("evaluation_value"),
        F.col("o_orderdate").alias("first_auction_date"), F.when(F.col("o_custkey") % 5 == 0, "caixa").otherwise("leiloeiro").alias("source"), (F.col("o_orderstatus") != "F").alias("is_active"), (k % 7 == 0).alias("is_duplicate"),
        F.when(k % 4 > 0, F.concat(F.lit("https://img.site/foto-"), k, F.lit(".jpg"))).alias("image_url"), F.concat(F.lit("https://Site"), k % 9, F.lit(".com/lote/"), k % 500, F.lit("/?utm_source=x")).alias("source_url"),
        F.when(k % 6 > 0, (k % 90 - 45).cast("double")).alias("latitude"), F.when(k % 6 > 0, (k % 180 - 90).cast("double")).alias("longitude"), F.col("o_orderdate").alias("created_at"),
    ]
    if values:
        price, off = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(4,2)")
        sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            F.sum(price).cast("decimal(18,2)").alias("first_value"), F.sum(price * (1 - off)).cast("decimal(20,4)").alias("second_value"),
            F.max("l_shipdate").alias("second_auction_date"), F.min("l_suppkey").alias("s_suppkey"),
        )
        orders = orders.join(sums, "o_orderkey", "left").join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", "left")
        columns += [
            F.col("first_value").cast("double").alias("first_auction_value"), F.col("second_value").cast("double").alias("second_auction_value"),
            F.when(F.col("first_value") > 0, (1 - F.col("second_value").cast("double") / F.col("first_value").cast("double")) * 100).alias("discount_percentage"),
            "second_auction_date", F.col("s_suppkey").alias("auctioneer_id"), F.col("s_name").alias("auctioneer_name"), F.col("second_auction_date").alias("updated_at"),
        ]
    return orders.join(customer.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(*columns)


#: The same relation in SQL, as a common table expression.
LISTINGS_SQL = """
sums AS (
  SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS first_value,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DECIMAL(20,4)) AS second_value,
    max(l_shipdate) AS second_auction_date, min(l_suppkey) AS s_suppkey
  FROM lineitem GROUP BY l_orderkey),
listings AS (
  SELECT 'ord-' || o_orderkey AS id, o_orderkey AS key, c_name AS title, c_mktsegment AS category, o_orderpriority AS auction_type, n_name AS state, r_name AS city,
    CASE WHEN o_orderkey % 3 > 0 THEN 'Zone ' || (o_orderkey % 11) END AS neighborhood, o_totalprice AS evaluation_value,
    CAST(first_value AS DOUBLE) AS first_auction_value, CAST(second_value AS DOUBLE) AS second_auction_value,
    CASE WHEN first_value > 0 THEN (1 - CAST(second_value AS DOUBLE) / CAST(first_value AS DOUBLE)) * 100 END AS discount_percentage,
    o_orderdate AS first_auction_date, second_auction_date, sums.s_suppkey AS auctioneer_id, s_name AS auctioneer_name,
    CASE WHEN o_custkey % 5 = 0 THEN 'caixa' ELSE 'leiloeiro' END AS source, o_orderstatus <> 'F' AS is_active, o_orderkey % 7 = 0 AS is_duplicate,
    CASE WHEN o_orderkey % 4 > 0 THEN 'https://img.site/foto-' || o_orderkey || '.jpg' END AS image_url,
    'https://Site' || (o_orderkey % 9) || '.com/lote/' || (o_orderkey % 500) || '/?utm_source=x' AS source_url,
    CASE WHEN o_orderkey % 6 > 0 THEN CAST(o_orderkey % 90 - 45 AS DOUBLE) END AS latitude, CASE WHEN o_orderkey % 6 > 0 THEN CAST(o_orderkey % 180 - 90 AS DOUBLE) END AS longitude,
    o_orderdate AS created_at, second_auction_date AS updated_at
  FROM orders LEFT JOIN sums ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON sums.s_suppkey = supplier.s_suppkey)
"""


def scraper_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each user and day of events: errors are its failures."""
    events = table(spark, sf_dir, "events")
    return events.groupBy((F.col("user_id") % 40).alias("scraper"), F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("found"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") == "view").alias("redirected"), F.min("ts").alias("start_time")
    ).withColumn("ok", F.col("failed") * 5 <= F.col("found"))


RUNS_SQL = """
runs AS (
  SELECT user_id % 40 AS scraper, CAST(ts AS DATE) AS day, count(*) AS found, count(*) FILTER (event_type = 'error') AS failed,
    count(*) FILTER (event_type = 'view') AS redirected, min(ts) AS start_time, count(*) FILTER (event_type = 'error') * 5 <= count(*) AS ok
  FROM events GROUP BY 1, 2)
"""

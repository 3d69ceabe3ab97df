"""The roles that the supplied tables play: orders are postings, customers companies, suppliers boards, line items board listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The moment that stands for now; the tables end the day before. A timestamp without zone, as the tables have them.
NOW = "2001-08-02"
#: Values by a key's remainder. Fixed values of the bindings.
STATUSES = ("interested", "applied", "screening", "interview", "offer", "rejected", "ghosted", "skipped", "withdrawn")
PROVIDERS = ("greenhouse", "lever", "ashby", "feed")


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(key: Column, values: tuple[str | None, ...]) -> Column:
    """The value at the key's remainder."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (key % len(values) + 1).cast("int"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            key.alias("company_id"),
            F.col("c_name").alias("name"),
            F.col("n_name").alias("country"),
            F.col("n_regionkey").alias("region"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_acctbal").alias("balance"),
            F.concat(pick(key, ("W", "S", "F", "X")), (key % 9 + 93).cast("string").substr(1, 2)).alias("batch"),
        )
    )


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_partkey").alias("p_partkey"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_type").alias("level"), F.col("p_size").alias("size"))
    return first.join(part, "p_partkey").select("id", "title", "level", "size")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, posted = F.col("o_orderkey"), F.col("o_orderdate")
    cluster = Window.partitionBy("o_custkey", F.trunc("o_orderdate", "month"))
    return table(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.col("o_custkey").alias("company_id"),
        F.col("o_orderstatus").alias("market"),
        F.col("o_orderpriority").alias("source"),
        F.col("o_totalprice").alias("salary_max"),
        pick(key, ("annual", "monthly", "weekly", "annual", None)).alias("salary_period"),
        pick(key, ("USD", "EUR", "TRY", None)).alias("salary_currency"),
        posted.alias("posted_at"),
        posted.alias("first_seen_at"),
        (posted + F.make_dt_interval((key % 20).cast("int"))).alias("last_seen_at"),
        (key % 13 != 0).alias("is_active"),
        F.when(key % 6 == 0, 1).otherwise(0).alias("missed_runs"),
        F.min("o_orderkey").over(cluster).alias("canonical_id"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("job_id"),
        F.when(key % 50 == 0, "X").otherwise(F.col("o_orderstatus")).alias("profile"),
        F.when(key % 7 != 0, ((key * 37) % 101).cast("double") / 100).alias("llm_score"),
        (key % 3 != 0).alias("passed"),
        (key % 5 != 0).alias("auth_checked"),
    )


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where(key % 11 == 0).select(key.alias("job_id"), pick(key, STATUSES).alias("status"), F.col("o_orderdate").alias("applied_at"))


def boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("board_id"),
        pick(key, PROVIDERS).alias("provider"),
        F.col("s_name").alias("token"),
        (key * 3).alias("company_id"),
        F.when(key % 7 == 0, "dead").when(key % 5 == 0, "candidate").otherwise("validated").alias("status"),
        pick(key, ("warm", "empty", "feed")).alias("tier"),
        F.when(key % 4 != 0, now() + F.make_dt_interval((key % 10 - 5).cast("int"))).alias("next_fetch_at"),
        (key % 3).cast("int").alias("errors"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("board_id"), F.col("l_orderkey").alias("job_id"), F.trunc("l_shipdate", "month").alias("run"))


#: The same bindings as DuckDB common table expressions, for the oracle queries.
SQL = """
companies AS (SELECT c_custkey AS company_id, c_name AS name, n_name AS country, n_regionkey AS region, c_mktsegment AS segment,
    c_acctbal AS balance, ['W','S','F','X'][c_custkey % 4 + 1] || CAST(c_custkey % 9 + 93 AS VARCHAR)[1:2] AS batch
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
titles AS (SELECT id, p_name AS title, p_type AS level, p_size AS size FROM (SELECT l_orderkey AS id, min(l_partkey) AS k FROM lineitem GROUP BY 1) JOIN part ON k = p_partkey),
jobs AS (SELECT o_orderkey AS id, o_custkey AS company_id, o_orderstatus AS market, o_orderpriority AS source, o_totalprice AS salary_max,
    ['annual','monthly','weekly','annual',NULL][o_orderkey % 5 + 1] AS salary_period, ['USD','EUR','TRY',NULL][o_orderkey % 4 + 1] AS salary_currency,
    o_orderdate AS posted_at, o_orderdate AS first_seen_at, o_orderdate + to_days(CAST(o_orderkey % 20 AS INTEGER)) AS last_seen_at,
    o_orderkey % 13 <> 0 AS is_active, CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS missed_runs,
    min(o_orderkey) OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate)) AS canonical_id FROM orders),
scores AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END AS profile,
    CASE WHEN o_orderkey % 7 <> 0 THEN CAST((o_orderkey * 37) % 101 AS DOUBLE) / 100 END AS llm_score, o_orderkey % 3 <> 0 AS passed, o_orderkey % 5 <> 0 AS auth_checked FROM orders),
applications AS (SELECT o_orderkey AS job_id, ['interested','applied','screening','interview','offer','rejected','ghosted','skipped','withdrawn'][o_orderkey % 9 + 1] AS status,
    o_orderdate AS applied_at FROM orders WHERE o_orderkey % 11 = 0),
boards AS (SELECT s_suppkey AS board_id, ['greenhouse','lever','ashby','feed'][s_suppkey % 4 + 1] AS provider, s_name AS token, s_suppkey * 3 AS company_id,
    CASE WHEN s_suppkey % 7 = 0 THEN 'dead' WHEN s_suppkey % 5 = 0 THEN 'candidate' ELSE 'validated' END AS status, ['warm','empty','feed'][s_suppkey % 3 + 1] AS tier,
    CASE WHEN s_suppkey % 4 <> 0 THEN TIMESTAMP '2001-08-02' + to_days(CAST(s_suppkey % 10 - 5 AS INTEGER)) END AS next_fetch_at, CAST(s_suppkey % 3 AS INTEGER) AS errors FROM supplier),
listings AS (SELECT l_suppkey AS board_id, l_orderkey AS job_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS run FROM lineitem)
"""

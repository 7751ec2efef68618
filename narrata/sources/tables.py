"""Stored tables, and the canonical tables that queries read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGES_PER_CHAPTER = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, page_num from 0, text, n_images): a line of a document is a page of a book."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.posexplode(F.split("text", "\n")).alias("page_num", "text"))
    return docs.withColumn("n_images", F.pmod(F.col("book_id") + F.col("page_num"), F.lit(3)).cast("int"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: a customer is a session, and each job depends on the session's job before."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "running").otherwise("completed")
    rows = o.select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("session_id"),
        status.alias("status"),
        (F.substring("o_orderpriority", 1, 1).cast("int") * 2).alias("priority"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_totalprice").alias("price"),
    )
    before = F.lag("job_id").over(Window.partitionBy("session_id").orderBy("created_at", "job_id"))
    return rows.withColumn("dependency", before)


JOBS_SQL = """jobs as (select o_orderkey as job_id, o_custkey as session_id,
  case o_orderstatus when 'P' then 'pending' when 'O' then 'running' else 'completed' end as status,
  cast(left(o_orderpriority, 1) as int) * 2 as priority, o_orderdate as created_at, o_totalprice as price,
  lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as dependency from orders)"""

PAGES_SQL = """pages_ as (select book_id, page_num, text, cast((book_id + page_num) % 3 as int) as n_images from (
  select doc_id as book_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as page_num, unnest(string_split(text, chr(10))) as text from documents))"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a job log: five jobs a user, operations by event type, in the order (ts, event_id)."""
    e = table(spark, sf_dir, "events")
    op = F.create_map(*(F.lit(x) for p in EVENT_OPS.items() for x in p))[F.col("event_type")]
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat_ws("-", "user_id", F.pmod("event_id", F.lit(5))).alias("job_id"),
        F.col("user_id").alias("session_id"),
        op.alias("op"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("progress"),
    )


EVENT_OPS = {"signup": "create", "view": "start", "click": "progress", "purchase": "complete", "error": "fail"}

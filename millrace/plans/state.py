"""Keyed writes, queues, controllers and streams, on snapshots of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import upserts as U
from millrace.plans.registry import query
from millrace.session import shared_dir
from millrace.session import table as t
from millrace.streaming import control, queues


def _batch(spark: SparkSession, d: str) -> DataFrame:
    """Two payloads an order: a discovery, then for some a full one."""
    o = t(spark, d, "orders").where("o_orderkey % 4 <> 0")
    found = F.to_json(F.struct(F.concat(F.lit("n"), F.col("o_orderkey")).alias("name"), F.when(F.col("o_orderkey") % 3 == 0, "2030-01-01T00:00:00Z").otherwise("1980-01-01T00:00:00Z").alias("updated_at")))
    full = F.to_json(F.struct(F.col("o_orderstatus").alias("kind"), F.lit("full").alias("name")))
    a = o.select(F.col("o_orderkey").cast("string").alias("id"), F.lit(1).cast("long").alias("seq"), found.alias("payload"), F.lit("PENDING").alias("status"))
    b = o.where("o_orderkey % 5 = 1").select(F.col("o_orderkey").cast("string").alias("id"), F.lit(2).cast("long").alias("seq"), full.alias("payload"), F.lit("SUCCESS").alias("status"))
    return a.unionByName(b)


def _current(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").where("o_orderkey % 2 = 0")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.to_json(F.struct(F.lit("old").alias("name"), F.lit("x").alias("tag"))).alias("payload"),
        F.lit("SUCCESS").alias("status"), F.col("o_orderdate").cast("timestamp_ntz").alias("last_scrape"),
    )


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id,
 CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 5 = 1 THEN 'full' WHEN o_orderkey % 4 <> 0 THEN 'n' || CAST(o_orderkey AS VARCHAR) ELSE 'old' END AS name,
 CASE WHEN o_orderkey % 2 = 0 AND NOT (o_orderkey % 4 <> 0 AND o_orderkey % 5 = 1) THEN 'x' END AS tag,
 CASE WHEN o_orderkey % 4 = 0 THEN 'SUCCESS' WHEN o_orderkey % 5 = 1 THEN 'SUCCESS' WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN 'SUCCESS' ELSE 'PENDING' END AS status FROM orders
 WHERE o_orderkey % 2 = 0 OR o_orderkey % 4 <> 0""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    done = U.upsert(_current(spark, d), _batch(spark, d))
    return done.select("id", F.get_json_object("payload", "$.name").alias("name"), F.get_json_object("payload", "$.tag").alias("tag"), "status")


@query("""SELECT * FROM (SELECT 'files' AS part, status, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 1 OR o_orderkey % 3 = 2 AND o_orderkey % 2 = 0 THEN 'PENDING' ELSE 'SUCCESS' END AS status FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 1) GROUP BY 2
 UNION ALL SELECT 'metrics', 'rows', (SELECT count(*) FROM orders) + (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0)
 UNION ALL SELECT 'worlds', 'changed', (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 4 = 0))""")
def upsert_files(spark: SparkSession, d: str) -> DataFrame:
    """One write of worlds, metrics and files; half the worlds are in the batch, half of those have changed."""
    o = t(spark, d, "orders").withColumn("id", F.col("o_orderkey"))
    old = F.lit("2020-01-01").cast("timestamp_ntz")
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    current = o.select("id", F.lit("{}").alias("payload"), F.lit("SUCCESS").alias("status"), old.alias("last_scrape"))
    metrics = o.select("id", F.lit(1).alias("heat"), old.alias("scrape_time"))
    files = o.where("id % 3 <> 1").select("id", F.lit("f").alias("file_id"), F.lit(1).alias("version"), F.lit("SUCCESS").alias("status"), F.lit("{}").alias("payload"), old.alias("last_scrape"), F.lit(None).cast("string").alias("error"))
    files = files.unionByName(o.where("id % 3 = 1 AND id % 2 = 1").select("id", F.lit("f").alias("file_id"), F.lit(1).alias("version"), F.lit("PENDING").alias("status"), F.lit("{}").alias("payload"), old.alias("last_scrape"), F.lit(None).cast("string").alias("error")))
    named = F.when(F.col("id") % 3 == 0, F.array().cast("array<struct<file_id:string,version:int>>")).otherwise(F.array(F.struct(F.lit("f").alias("file_id"), F.lit(2).alias("version"))))
    batch = o.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, '{"a":1}').otherwise("{}").alias("payload"), F.lit(2).alias("heat"), named.alias("files"))
    w, m, f = U.write_full(current, metrics, files, batch, now)
    row = lambda df, part, status: df.groupBy(status.alias("status")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "status", "n")
    return row(f, "files", F.col("status")).union(row(m, "metrics", F.lit("rows"))).union(row(w.where(F.col("last_scrape") == now), "worlds", F.lit("changed")))


@query("""WITH l AS (SELECT user_id, max(ts) AS ts, arg_max(value, ts) AS v FROM events GROUP BY 1) SELECT c_custkey AS id FROM customer LEFT JOIN l ON user_id = c_custkey
 WHERE c_custkey % 4 = 0 OR (c_custkey % 4 = 1 AND (v IS NULL OR date_sub('day', TIMESTAMP '2024-01-10', TIMESTAMP '2024-02-01') >= CASE WHEN v >= 50 THEN 1 WHEN v >= 10 THEN 7 WHEN v >= 1 THEN 30 ELSE 180 END))""")
def due_for_visit(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("PENDING", "SUCCESS", "DELETED", "ERROR"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    worlds = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), status.alias("status"), F.lit("2024-01-10").cast("timestamp_ntz").alias("last_scrape"))
    metrics = t(spark, d, "events").select(F.col("user_id").alias("id"), F.lit(0).alias("heat"), F.lit(0).alias("popularity"), F.col("value").alias("occupants"), F.col("ts").alias("scrape_time"))
    return U.due(worlds, metrics, F.lit("2024-02-01").cast("timestamp_ntz")).select("id")


def call_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as calls by user, answered after some seconds; all but purchases and logins fail."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t(spark, d, "events").select(
        F.col("user_id").cast("long").alias("key"), at.alias("ts"), (~F.col("event_type").isin("error", "view", "click")).alias("ok"), (F.col("event_id") % 7 * 0.25).alias("took")
    )


@query()
def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each user's calls behind the breaker."""
    return control.replay(call_log(spark, d)).groupBy("key", "fate", "state").count()


@query()
def rate_limiter(spark: SparkSession, d: str) -> DataFrame:
    """The limiter's rate and waits over each user's calls."""
    r = control.replay(call_log(spark, d))
    return r.groupBy("key", "turn").agg(F.round(F.min("rate"), 6).alias("low"), F.round(F.max("rate"), 6).alias("high"), F.round(F.max("wait"), 6).alias("longest_wait"), F.count("*").alias("n"))


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2""")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Daily windows of event time over a file stream, all of it drained; the last figures of each window equal the batch result."""
    spot = f"{shared_dir(spark)}/millrace-stream-{uuid.uuid4().hex}"
    source = spark.read.parquet(f"{d}/events.parquet")
    stream = queues.read_files(spark, f"{d}/events.parquet*", source.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    queues.latest_windows(stream, "1 day", "60 days", f"{spot}/out", f"{spot}/state")
    last = spark.read.parquet(f"{spot}/out").groupBy("start", "event_type").agg(F.max_by(F.struct("n", "top"), "batch").alias("v"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "v.n", "v.top")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 5 = 1 THEN 'SUCCESS' ELSE 'PENDING' END AS status FROM orders WHERE o_orderkey % 4 <> 0""")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Payloads as a file stream, folded batch by batch into keyed state."""
    spot = f"{shared_dir(spark)}/millrace-stream-{uuid.uuid4().hex}"
    batch = _batch(spark, d)
    batch.where("seq = 1").coalesce(1).write.parquet(f"{spot}/in")
    batch.where("seq = 2").coalesce(1).write.mode("append").parquet(f"{spot}/in")
    queues.upsert_stream(spark, queues.read_files(spark, f"{spot}/in", batch.schema), f"{spot}/state", f"{spot}/log")
    last = 2 if batch.where("seq = 2").limit(1).count() else 1
    return spark.read.parquet(f"{spot}/state/v{last}").select("id", "status")

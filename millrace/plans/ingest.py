"""Ingest loops on snapshots of the given tables: discovery, draining, results, error routing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import values as V
from millrace.operators import upserts as U
from millrace.plans.registry import query
from millrace.session import shared_dir
from millrace.session import table as t
from millrace.streaming import control, queues

NOW, OLD = "TIMESTAMP '2024-01-01'", "TIMESTAMP '2020-01-01'"


def _at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _pick(by: Column, *values: str | int | None) -> Column:
    """One of the values by the remainder."""
    kind = "int" if any(isinstance(v, int) for v in values) else "string"
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (by % len(values) + 1).cast("int"))


@query("""WITH c AS (SELECT o_orderkey AS id, ['ok', 'http', 'http', 'http', 'timeout', 'auth', 'odd', 'http'][o_orderkey % 8 + 1] AS kind, [429, 404, 503, 403, 500, 401, 502][o_orderkey % 7 + 1] AS status FROM orders),
r AS (SELECT *, (kind = 'http' AND status IN (429, 500, 502, 503)) OR kind IN ('timeout', 'auth') AS hard FROM c)
SELECT kind, CASE WHEN kind = 'http' THEN status END AS status, CASE WHEN hard OR kind = 'odd' THEN 'error' ELSE 'success' END AS limiter, CASE WHEN hard THEN 'error' WHEN kind = 'ok' THEN 'success' ELSE 'none' END AS breaker, kind = 'auth' AS stops, count(*) AS n FROM r GROUP BY ALL""")
def error_routing(spark: SparkSession, d: str) -> DataFrame:
    """What each outcome of a call means for the limiter, the breaker and the run."""
    k = F.col("o_orderkey")
    c = t(spark, d, "orders").select(_pick(k, "ok", "http", "http", "http", "timeout", "auth", "odd", "http").alias("kind"), _pick(k, 429, 404, 503, 403, 500, 401, 502).alias("status"))
    r = c.select("kind", F.when(F.col("kind") == "http", F.col("status")).alias("status"), control.routing(F.col("kind"), F.col("status")).alias("r"))
    return r.groupBy("kind", "status", "r.limiter", "r.breaker", "r.stops").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id, 'PENDING' AS status FROM orders WHERE o_orderkey % 4 <> 0 OR o_orderkey % 3 = 0")
def discovery_loop(spark: SparkSession, d: str) -> DataFrame:
    """Listings as a file stream; each batch appends the ids that aren't known yet."""
    spot = f"{shared_dir(spark)}/millrace-discovery-{uuid.uuid4().hex}"
    o = t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("id"), "o_orderkey")
    for part in ("o_orderkey % 4 <> 0", "o_orderkey % 3 = 0"):
        o.where(part).select("id").coalesce(1).write.mode("append").parquet(f"{spot}/in")
    queues.discover(spark, queues.read_files(spark, f"{spot}/in", o.select("id").schema), f"{spot}/known", f"{spot}/log")
    return spark.read.parquet(f"{spot}/known").select("id", "status")


@query("""WITH w AS (SELECT o_orderkey AS id, ['PENDING', 'SUCCESS', 'DELETED'][o_orderkey % 3 + 1] AS status FROM orders), f AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS file_id, ['PENDING', 'SUCCESS'][l_partkey % 2 + 1] AS status FROM lineitem),
i AS (SELECT p_partkey AS file_id, p_size AS version, ['PENDING', 'CONFIRMED'][p_partkey % 3 % 2 + 1] AS state FROM part),
a AS (SELECT id FROM w WHERE status = 'PENDING' ORDER BY id LIMIT 5000), v AS (SELECT id FROM w WHERE status = 'SUCCESS' UNION ALL SELECT id FROM a),
b AS (SELECT id, file_id FROM f WHERE status = 'PENDING' AND id IN (FROM v)), c AS (SELECT file_id, version FROM i WHERE state = 'PENDING' AND (file_id IN (SELECT file_id FROM f WHERE status = 'SUCCESS') OR file_id IN (SELECT file_id FROM b)))
SELECT 'worlds' AS stage, count(*) AS n, sum(id)::BIGINT AS ids FROM a UNION ALL SELECT 'files', count(*), sum(file_id)::BIGINT FROM b UNION ALL SELECT 'images', count(*), sum(file_id)::BIGINT FROM c""")
def oneshot_drain(spark: SparkSession, d: str) -> DataFrame:
    """One run over everything that is pending: worlds up to the cap of a run, their files, the files' images."""
    o, line, part = t(spark, d, "orders"), t(spark, d, "lineitem"), t(spark, d, "part")
    worlds = o.select(F.col("o_orderkey").alias("id"), _pick(F.col("o_orderkey"), "PENDING", "SUCCESS", "DELETED").alias("status"))
    files = line.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("file_id"), _pick(F.col("l_partkey"), "PENDING", "SUCCESS").alias("status")).distinct()
    images = part.select(F.col("p_partkey").alias("file_id"), F.col("p_size").alias("version"), _pick(F.col("p_partkey") % 3, "PENDING", "CONFIRMED").alias("state"))
    stage = lambda df, name, c: df.agg(F.count("*").alias("n"), F.sum(c).alias("ids")).select(F.lit(name).alias("stage"), "n", "ids")
    a, b, c = U.drained(worlds, files, images, 5000)
    return stage(a, "worlds", "id").unionByName(stage(b, "files", "file_id")).unionByName(stage(c, "images", "file_id"))


@query(f"""WITH a AS (SELECT c_custkey AS id, 'SUCCESS' AS status FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT c_custkey AS id, 'DELETED' AS status FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NOT NULL THEN 'kept' END AS payload, coalesce(b.status, a.status) AS status, CASE WHEN b.id IS NOT NULL THEN {NOW} ELSE {OLD} END AS last_scrape FROM a FULL JOIN b ON a.id = b.id""")
def status_only(spark: SparkSession, d: str) -> DataFrame:
    """Status by key: what is there keeps its payload, what isn't is created bare; the visit is stamped with a time that is passed in."""
    c = t(spark, d, "customer").withColumn("id", F.col("c_custkey"))
    now = c.where("id % 2 = 0").select("id", F.lit("kept").alias("payload"), F.lit("SUCCESS").alias("status"), _at("2020-01-01").alias("last_scrape"))
    return U.set_status(now, c.where("id % 3 = 0").select("id", F.lit("DELETED").alias("status")), _at("2024-01-01"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").withColumn("k", F.col("p_partkey"))
    return p.select(
        F.col("k").alias("id"), F.col("k").alias("file_id"), F.lit(1).alias("version"), _pick(F.col("k"), "IMAGE", "IMAGE", "PACKAGE").alias("file_type"),
        F.lit("PENDING").alias("status"), F.lit("old").alias("payload"), _at("2020-01-01").alias("last_scrape"), F.lit(None).cast("string").alias("error"),
    )


def _images(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").withColumn("k", F.col("p_partkey")).where("k % 5 < 3")
    return p.select(F.col("k").alias("file_id"), F.lit(2).alias("version"), F.concat(F.lit("m"), (F.col("k") % 4).cast("string")).alias("md5"), F.lit("s").alias("sha256"), F.lit("CONFIRMED").alias("state"))


@query(f"""WITH k AS (SELECT p_partkey AS k FROM part), hit AS (SELECT k, k % 4 <> 3 AS good FROM k WHERE k % 2 = 0), shown AS (SELECT k FROM hit WHERE good AND k % 3 <> 2 AND k % 7 <> 0), old AS (SELECT k, 'm' || (k % 4) AS md5 FROM k WHERE k % 5 < 3),
f AS (SELECT 'file' AS part, k.k AS id, CASE WHEN good THEN 'SUCCESS' WHEN good IS NULL THEN 'PENDING' ELSE 'ERROR' END AS state, CASE WHEN good IS NULL THEN 'old' WHEN good THEN 'new' END AS value, CASE WHEN good IS NULL THEN {OLD} ELSE {NOW} END AS stamp FROM k LEFT JOIN hit USING (k)),
i AS (SELECT 'image', coalesce(old.k, shown.k), CASE WHEN shown.k IS NOT NULL AND (old.md5 IS NULL OR old.md5 <> 'm0') THEN 'PENDING' ELSE 'CONFIRMED' END, CASE WHEN shown.k IS NOT NULL THEN 'm0' ELSE old.md5 END, NULL::TIMESTAMP FROM old FULL JOIN shown USING (k))
SELECT * FROM f UNION ALL SELECT * FROM i""")
def file_result_rows(spark: SparkSession, d: str) -> DataFrame:
    """Results of file lookups: files keep good payloads only, image files get or restart their image."""
    k = F.col("p_partkey")
    versions = F.when(k % 7 == 0, '{"versions":[]}').otherwise('{"versions":[{"version":2,"file":{"md5":"m0"}},{"version":1,"file":{"md5":"zz"}}]}')
    results = t(spark, d, "part").where("p_partkey % 2 = 0").select(k.alias("file_id"), versions.alias("payload"), F.when(k % 4 != 3, "SUCCESS").otherwise("ERROR").alias("status"), F.lit(None).cast("string").alias("error"))
    f, i = U.file_results(_files(spark, d), _images(spark, d), results, _at("2024-01-01"))
    value = F.when(F.col("payload") == "old", "old").when(F.col("payload").isNotNull(), "new")
    out = f.select(F.lit("file").alias("part"), F.col("file_id").alias("id"), F.col("status").alias("state"), value.alias("value"), F.col("last_scrape").alias("stamp"))
    return out.unionByName(i.select(F.lit("image").alias("part"), F.col("file_id").alias("id"), "state", F.col("md5").alias("value"), F.lit(None).cast("timestamp_ntz").alias("stamp")))


@query(f"""SELECT p_partkey AS file_id, CASE WHEN p_partkey % 2 = 0 THEN 'h' ELSE 's' END AS sha256, CASE WHEN p_partkey % 4 = 0 THEN 'CONFIRMED' WHEN p_partkey % 4 = 2 THEN 'ERROR' ELSE 'CONFIRMED' END AS state, CASE WHEN p_partkey % 4 = 0 THEN {NOW} END AS success_time FROM part WHERE p_partkey % 5 < 3""")
def image_result_rows(spark: SparkSession, d: str) -> DataFrame:
    """Results of downloads; a confirmed one is stamped."""
    r = t(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("file_id"), F.lit(2).alias("version"), F.when(F.col("p_partkey") % 4 == 0, "CONFIRMED").otherwise("ERROR").alias("state"), F.lit("h").alias("sha256"))
    return U.image_results(_images(spark, d), r, _at("2024-01-01")).select("file_id", "sha256", "state", "success_time")


@query("""SELECT 'file' AS queue, p_partkey AS id FROM part WHERE p_size > 25 UNION ALL SELECT 'image', p_partkey FROM part WHERE p_size <= 25 AND p_partkey % 3 = 0""")
def pending_queues(spark: SparkSession, d: str) -> DataFrame:
    """Files to look up, and images to fetch whose file has been read."""
    p = t(spark, d, "part").withColumn("file_id", F.col("p_partkey"))
    files = p.select("file_id", F.when(F.col("p_size") > 25, "PENDING").otherwise("SUCCESS").alias("status"))
    images = p.select("file_id", F.lit(1).alias("version"), F.when(F.col("file_id") % 3 == 0, "PENDING").otherwise("CONFIRMED").alias("state"))
    todo = files.where("status = 'PENDING'").select(F.lit("file").alias("queue"), F.col("file_id").alias("id"))
    return todo.unionByName(U.pending_images(files, images).select(F.lit("image").alias("queue"), F.col("file_id").alias("id")))


@query("SELECT event_id, event_type, value FROM events")
def stream_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """A stream that brings some events twice; replays within the watermark are dropped."""
    spot = f"{shared_dir(spark)}/millrace-replays-{uuid.uuid4().hex}"
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.coalesce(1).write.parquet(f"{spot}/in")
    e.where("event_id % 3 = 0").coalesce(1).write.mode("append").parquet(f"{spot}/in")
    stream = queues.deduplicated(queues.read_files(spark, f"{spot}/in", e.schema), ["event_id"], "365 days")
    queues.drain(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{spot}/out/batch={n}"), f"{spot}/log")
    return spark.read.parquet(f"{spot}/out").select("event_id", "event_type", "value")


@query("""WITH v AS (SELECT p_partkey AS id, [struct_pack(version := 1, url := 'a' || p_partkey), struct_pack(version := p_size, url := 'b' || p_partkey), struct_pack(version := 7, url := 'c')] AS vs FROM part)
SELECT id, list_filter(vs, lambda x: x.version = 7)[1].url AS url FROM v""")
def first_of_version(spark: SparkSession, d: str) -> DataFrame:
    """The first element of an array with a given version."""
    of = lambda n, url: F.struct(n.cast("int").alias("version"), url.alias("url"))
    key = F.col("p_partkey").cast("string")
    v = F.array(of(F.lit(1), F.concat(F.lit("a"), key)), of(F.col("p_size"), F.concat(F.lit("b"), key)), of(F.lit(7), F.lit("c")))
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), v.alias("v")).select("id", V.first_with(F.col("v"), F.lit(7))["url"].alias("url"))

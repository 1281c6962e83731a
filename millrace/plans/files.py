"""Sources and sinks, written from the given tables into the shared folder and read back."""

from __future__ import annotations

import io
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import spatial as S
from millrace.plans.registry import query
from millrace.plans.vectors import SQUARES, squares
from millrace.session import shared_dir
from millrace.session import table as t
from millrace.sources import readers, writers


def _spot(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0) AS written FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1")
def parquet_export(spark: SparkSession, d: str) -> DataFrame:
    """A query's rows as Parquet, counted while they are written, and read again."""
    spot = _spot(spark, "export")
    n = writers.parquet(t(spark, d, "orders").where("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus", "o_totalprice"), spot, "o_orderstatus")
    back = spark.read.parquet(spot)
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.lit(n).alias("written"))


@query("SELECT s_suppkey::INTEGER AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 2 = 1")
def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """A CSV with a header, its types inferred."""
    spot = _spot(spark, "csv")
    t(spark, d, "supplier").where("s_suppkey % 2 = 1").write.option("header", True).csv(spot)
    return readers.csv(spark, spot)


@query("SELECT user_id, list(event_id ORDER BY event_id) AS ids, count(*) AS n FROM events GROUP BY user_id")
def json_scan(spark: SparkSession, d: str) -> DataFrame:
    """JSON documents with nested lists."""
    spot = _spot(spark, "json")
    t(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("ids")).write.json(spot)
    return readers.json_documents(spark, spot, "user_id long, ids array<long>", by_line=True).select("user_id", "ids", F.size("ids").cast("long").alias("n"))


@query(f"WITH {SQUARES} SELECT poly::BIGINT AS poly, 0 AS ring_no, 4 AS corners, round(0.01::DOUBLE, 9) AS area, round(x0::DOUBLE, 9) AS x0 FROM s WHERE poly % 2 = 0 UNION ALL SELECT 1000, r, 4, CASE r WHEN 0 THEN 16.0::DOUBLE ELSE 1.0 END, r::DOUBLE FROM range(2) z(r)")
def geojson_scan(spark: SparkSession, d: str) -> DataFrame:
    """Features written as GeoJSON lines and read back, with one of two rings that was made by another tool."""
    spot = _spot(spark, "geojson")
    sq = squares(spark).where("poly % 2 = 0")
    writers.feature_collection(sq, "ring", "poly").coalesce(1).write.text(f"{spot}/ours")
    hole = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"poly":1000},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[2,1],[2,2],[1,2],[1,1]]]]}},{"type":"Feature","properties":{"poly":2},"geometry":{"type":"Point","coordinates":[1,2]}}]}'
    writers.blob(spark, f"{spot}/theirs/map.json", hole.encode())
    rows = readers.geojson(spark, f"{spot}/ours").unionByName(readers.geojson(spark, f"{spot}/theirs"))
    return rows.select(
        F.col("properties")["poly"].cast("long").alias("poly"), F.col("ring_no"), F.size("ring").alias("corners"),
        F.round(F.abs(S.area2(F.col("ring"))) / 2, 9).alias("area"), F.round(F.array_min(F.transform("ring", lambda p: p["x"])), 9).alias("x0"),
    )


@query("SELECT CAST(l AS INTEGER) AS layer, count(*) AS n FROM (SELECT 2 AS l FROM region UNION ALL SELECT 10 FROM nation UNION ALL SELECT 1 FROM supplier) GROUP BY 1")
def layer_files(spark: SparkSession, d: str) -> DataFrame:
    """Numbered files as one table, by number and not by name."""
    spot = _spot(spark, "layers")
    for n, name in ((2, "region"), (10, "nation"), (1, "supplier")):
        t(spark, d, name).select(F.lit("x").alias("k")).coalesce(1).write.parquet(f"{spot}/layer_{n}.parquet")
    return readers.layers(spark, f"{spot}/layer_*.parquet").groupBy("layer").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT 'wrld_' || o_custkey AS id FROM orders WHERE o_orderkey % 2 = 0")
def id_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of ids, trimmed; those without the prefix left out."""
    spot = _spot(spark, "lines")
    lead = F.when(F.col("o_orderkey") % 2 == 0, "  wrld_").otherwise("usr_")
    t(spark, d, "orders").select(F.concat(lead, F.col("o_custkey").cast("string"), F.lit(" ")).alias("value")).write.text(spot)
    return readers.ids(spark, spot, "wrld_")


@query(" UNION ALL ".join(
    f"SELECT '{n}' AS \"table\", column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT[]' THEN 'array<float>' ELSE 'timestamp_ntz' END AS kind FROM (DESCRIBE SELECT * FROM {n})"
    for n in ("nation", "lineitem", "events", "embeddings", "documents")
))
def table_schemas(spark: SparkSession, d: str) -> DataFrame:
    """Names and types of the columns of some tables."""
    out = None
    for n in ("nation", "lineitem", "events", "embeddings", "documents"):
        s = readers.described(t(spark, d, n), n).select("table", "name", "kind")
        out = s if out is None else out.unionByName(s)
    return out


@query("SELECT count(*) AS rows_, round(max(o_totalprice), 2) AS top, min(o_orderkey) AS first_key FROM orders")
def manifest_facts(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of facts as one line of JSON."""
    spot = _spot(spark, "manifest")
    writers.manifest(t(spark, d, "orders"), spot, rows_=F.count("*"), top=F.round(F.max("o_totalprice"), 2), first_key=F.min("o_orderkey"))
    return spark.read.schema("rows_ long, top double, first_key long").json(spot)


@query("""SELECT c_nationkey, count(*) AS size, (SELECT string_agg(c_name, ', ' ORDER BY c_acctbal DESC, c_name) FROM (SELECT * FROM customer i WHERE i.c_nationkey = o.c_nationkey ORDER BY c_acctbal DESC, c_name LIMIT 3)) AS "first" FROM customer o GROUP BY c_nationkey""")
def exemplar_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first members of each group in one line."""
    return writers.exemplars(t(spark, d, "customer"), "c_nationkey", "c_name", F.desc("c_acctbal"), 3)


@query("SELECT DISTINCT substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || h || '.png' AS value FROM (SELECT sha256(CAST(o_custkey AS VARCHAR)) AS h FROM orders)")
def content_paths(spark: SparkSession, d: str) -> DataFrame:
    """Distinct paths of contents by their digest, as lines."""
    spot = _spot(spark, "paths")
    writers.path_list(t(spark, d, "orders").select(F.sha2(F.col("o_custkey").cast("string").cast("binary"), 256).alias("digest")), spot)
    return spark.read.text(spot)


@query("""SELECT n_nationkey AS id, CASE n_nationkey % 5 WHEN 1 THEN 'size' WHEN 2 THEN 'md5' ELSE 'written' END AS outcome, CASE WHEN n_nationkey % 5 NOT IN (1, 2) THEN octet_length(encode(n_name))::BIGINT END AS length FROM nation""")
def blob_store(spark: SparkSession, d: str) -> DataFrame:
    """Contents with the right size and MD5 stored under their digest, and read back by it."""
    spot = _spot(spark, "blobs")
    n = t(spark, d, "nation").withColumn("content", F.col("n_name").cast("binary")).withColumn("id", F.col("n_nationkey"))
    size = F.octet_length("content") + F.when(F.col("id") % 5 == 1, 1).otherwise(0)
    sent = F.when(F.col("id") % 5 == 2, F.lit("x").cast("binary")).otherwise(F.col("content"))
    md5 = F.base64(F.unhex(F.md5(sent)))
    rows = n.select("id", "content", size.alias("size"), md5.alias("md5"))
    done = spark.createDataFrame(writers.verified_blobs(rows, spot).collect(), "id int, outcome string, path string")  # one batch of downloads
    named = done.withColumn("digest", F.regexp_extract("path", "([0-9a-f]{64})", 1))
    back = readers.blobs(spark, spot, named.select("digest").where("digest <> ''").distinct())
    return named.join(back.select("digest", "length"), "digest", "left").select("id", "outcome", F.when(F.col("outcome") == "written", F.col("length")).alias("length"))


@query("SELECT 'height' AS field, i AS \"row\", j AS col, CAST(i * 10 + j AS DOUBLE) AS value FROM range(6) a(i), range(4) b(j) UNION ALL SELECT 'mask', i, j, CAST(i = j AS INTEGER)::DOUBLE FROM range(3) a(i), range(3) b(j)")
def raster_archive(spark: SparkSession, d: str) -> DataFrame:
    """Two fields of a NumPy archive as grid rows."""
    import numpy as np

    spot, held = _spot(spark, "raster"), io.BytesIO()
    r, c = np.indices((6, 4))
    np.savez(held, height=r * 10 + c, mask=np.eye(3, dtype=bool), name=np.array("x"))
    writers.blob(spark, f"{spot}/island.npz", held.getvalue())
    return readers.rasters(spark, f"{spot}/*.npz").select("field", "row", "col", "value")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0")
def database_tables(spark: SparkSession, d: str) -> DataFrame:
    """Two tables of a database (Derby, in an archive that driver and executors read), one scanned, one asked by a query of its own."""
    url = writers.derby_archive({name: t(spark, d, name) for name in ("nation", "region")}, f"{_spot(spark, 'derby')}.jar")
    nation = readers.jdbc_tables(spark, url, ["nation"])["nation"].where("n_nationkey % 2 = 0")
    region = readers.jdbc_query(spark, url, 'SELECT "r_regionkey", "r_name" FROM region')
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("""WITH q AS (SELECT i * 5 + j AS q, i * 10 AS x, j * 10 AS y FROM range(4) a(i), range(5) b(j)), v AS (SELECT q * 4 + k AS n, 'v ' || (x + CASE WHEN k IN (1, 2) THEN 10 ELSE 0 END) || ' ' || (y + CASE WHEN k >= 2 THEN 10 ELSE 0 END) || ' 0' AS line FROM q, range(4) z(k))
SELECT n, line FROM v UNION ALL SELECT 80 + q * 2 + k, 'f ' || (q * 4 + 1) || ' ' || (q * 4 + 2 + k) || ' ' || (q * 4 + 3 + k) FROM q, range(2) z(k)""")
def mesh_file(spark: SparkSession, d: str) -> DataFrame:
    """Ordered lines of a mesh of squares."""
    x, y = F.floor(F.col("id") / 5) * 10, F.col("id") % 5 * 10
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    q = spark.range(20).select("id", F.array(corner(0, 0), corner(10, 0), corner(10, 10), corner(0, 10)).alias("ring"))
    return writers.mesh_lines(q, "id", "ring")

"""Hierarchies, variants and small rules of the map: features, ids, paths, labels, zones, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import values as V
from millrace.operators import clusters as C
from millrace.operators import ranking as R
from millrace.operators import trees as H
from millrace.plans.registry import query
from millrace.plans.vectors import E_SQL, UNIT, points, vectors
from millrace.session import table as t
from millrace.sources import readers


@query()
def svd_features(spark: SparkSession, d: str) -> DataFrame:
    """Standardised places and main directions of the vectors, as one row of features."""
    v = vectors(spark, d).withColumns({"x": F.get("v", F.lit(0)), "y": F.get("v", F.lit(1))})
    return H.features(v, "id", "v", ("x", "y")).select("id", F.transform("f", lambda x: F.round(x, 6)).alias("f"))


@query()
def feature_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Three levels: label, neighbourhood and district, clustered on places and main directions."""
    v = vectors(spark, d).withColumns({"x": F.get("v", F.lit(0)), "y": F.get("v", F.lit(1))})
    f = v.select("id", "label").join(H.features(v, "id", "v", ("x", "y")), "id")
    one = C.subdivide(f, "label", "id", "f", 40, 10, 6)
    two = f.join(one, ["label", "id"]).withColumn("parent", F.concat_ws("/", "label", "child"))
    return C.subdivide(two, "parent", "id", "f", 12, 4, 4)


@query("""WITH c AS (SELECT n_regionkey AS island, c_mktsegment AS local FROM customer JOIN nation ON c_nationkey = n_nationkey), s AS (SELECT island, count(*) AS k FROM c GROUP BY 1),
g AS (SELECT island, CASE WHEN k >= 300 THEN local END AS local, count(*) AS n FROM c JOIN s USING (island) GROUP BY 1, 2)
SELECT island, local, n, CAST(row_number() OVER (ORDER BY n DESC, island, local NULLS FIRST) - 1 AS INTEGER) AS new_id FROM g""")
def global_cluster_ids(spark: SparkSession, d: str) -> DataFrame:
    """Local clusters of each island numbered over all islands by size; small islands are one cluster."""
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("island"))
    c = t(spark, d, "customer").join(F.broadcast(n), "c_nationkey").select("island", F.col("c_mktsegment").alias("local"))
    return H.global_ids(c, "island", "local", 300)


def _soft(level: str) -> str:
    return f"""k{level} AS (SELECT s, i, avg(v[i]) AS m FROM l{level}, range(1, 65) r(i) WHERE s <> 0 GROUP BY 1, 2), c{level} AS (SELECT s, list(m ORDER BY i) AS c FROM k{level} GROUP BY s),
a{level} AS (SELECT id, s FROM l{level} WHERE s <> 0 UNION ALL SELECT id, s FROM (SELECT l.id, c.s, row_number() OVER (PARTITION BY l.id ORDER BY round(list_inner_product({UNIT.format('l.v')}, {UNIT.format('c.c')}), 9) DESC, c.s) AS rn FROM l{level} l, c{level} c WHERE l.s = 0) WHERE rn = 1)"""


@query(f"""WITH {E_SQL}, l0 AS (SELECT id, v, CAST(label AS BIGINT) AS s FROM e), l1 AS (SELECT id, v, CASE WHEN id % 4 = 0 OR label = 0 THEN 0 ELSE label * 3 + id % 3 END AS s FROM e), {_soft('0')}, {_soft('1')}
SELECT a0.id, a0.s AS level0, a1.s AS level1, 'c' || (a0.s % 4) || '/' || CASE WHEN a1.s % 4 = a0.s % 4 THEN '' ELSE 'c' || (a1.s % 4) END AS path FROM a0 JOIN a1 USING (id)""".replace("'/' || CASE WHEN a1.s % 4 = a0.s % 4 THEN '' ELSE 'c' || (a1.s % 4) END", "CASE WHEN a1.s % 4 = a0.s % 4 THEN '' ELSE '/c' || (a1.s % 4) END"))
def full_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every point's cluster at each level, noise by the nearest centroid of that level, and the names from coarse to fine."""
    v = vectors(spark, d)
    level = {
        "level0": v.select("id", "v", F.col("label").cast("long").alias("s")),
        "level1": v.select("id", "v", F.when((F.col("id") % 4 == 0) | (F.col("label") == 0), 0).otherwise(F.col("label") * 3 + F.col("id") % 3).cast("long").alias("s")),
    }
    out = v.select("id")
    for name, rows in level.items():
        known = rows.where("s <> 0")
        noise = C.assign(rows.where("s = 0"), "v", C.centroids(known, "s", "v"), "s").select("id", F.col("nearest").alias(name))
        out = out.join(known.select("id", F.col("s").alias(name)).unionByName(noise), "id")
    called = lambda c: F.concat(F.lit("c"), (F.col(c) % 4).cast("string"))
    return out.withColumn("path", F.array_join(V.names_path(F.array(called("level0"), called("level1"))), "/"))


@query("""WITH n AS (SELECT c_custkey, [n_name, CASE WHEN c_custkey % 3 = 0 THEN n_name ELSE c_mktsegment END, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END] AS names FROM customer JOIN nation ON c_nationkey = n_nationkey),
m AS (SELECT c_custkey, list_filter(names, lambda x: x IS NOT NULL) AS names FROM n) SELECT c_custkey, array_to_string(list_filter(names, lambda x, i: i = 1 OR names[i - 1] <> x), ' > ') AS path FROM m""")
def name_paths(spark: SparkSession, d: str) -> DataFrame:
    """Names from coarse to fine without nulls and repeats."""
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = t(spark, d, "customer").join(F.broadcast(n), "c_nationkey")
    names = F.array("n_name", F.when(F.col("c_custkey") % 3 == 0, F.col("n_name")).otherwise(F.col("c_mktsegment")), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")))
    return c.select("c_custkey", F.array_join(V.names_path(names), " > ").alias("path"))


@query()
def sibling_labels(spark: SparkSession, d: str) -> DataFrame:
    """Hints voted on by the members of each child cluster, none used twice among siblings."""
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("child"), (F.col("c_nationkey") % 5).alias("parent"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("hint"))
    return H.voted_labels(c, "parent", "child", "hint")


MAPS = {"baseline": (1, 2), "second": (3, 4), "third": (5, 6)}


@query(f"""WITH {E_SQL}, m AS ({' UNION ALL '.join(f"SELECT '{n}' AS variant, id, v[{a}] AS x, v[{b}] AS y FROM e" for n, (a, b) in MAPS.items())}),
hi AS (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY round(list_inner_product({UNIT.format('a.v')}, {UNIT.format('b.v')}), 9) DESC, b.id) AS rank FROM e a JOIN e b ON a.id <> b.id),
lo AS (SELECT a.variant, a.id, b.id AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS w, row_number() OVER (PARTITION BY a.variant, a.id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.id) AS rank FROM m a JOIN m b ON a.variant = b.variant AND a.id <> b.id),
q AS (SELECT variant, quantile_cont(1 / greatest(w, 1e-9) ** 2, 0.99) / quantile_cont(1 / greatest(w, 1e-9) ** 2, 0.5) AS pressure FROM lo WHERE rank = 1 GROUP BY 1),
r AS (SELECT variant, count(*) / 10.0 / (SELECT count(*) FROM e) AS recall FROM lo JOIN hi ON hi.id = lo.id AND hi.other = lo.other WHERE lo.rank <= 10 AND hi.rank <= 10 GROUP BY 1),
g AS (SELECT variant, pressure, coalesce(recall, 0) AS recall, 1 - pressure / (SELECT pressure FROM q WHERE variant = 'baseline') AS gain, (SELECT recall FROM r WHERE variant = 'baseline') - coalesce(recall, 0) AS drop_ FROM q LEFT JOIN r USING (variant)),
pp AS (SELECT *, gain >= 0.15 AND drop_ <= 0.05 AS passed FROM g), b AS (SELECT variant FROM pp WHERE passed OR variant = 'baseline' ORDER BY passed DESC, pressure, variant LIMIT 1)
SELECT variant, round(pressure, 6) AS pressure, round(recall, 6) AS recall, round(gain, 6) AS gain, round(drop_, 6) AS "drop", passed, variant = (FROM b) AS selected FROM pp""")
def chosen_map(spark: SparkSession, d: str) -> DataFrame:
    """Maps of the same points against a baseline: less crowded and nearly as faithful, or else the baseline."""
    v = vectors(spark, d)
    high = H.neighbours(v, "id", "v", 10)
    out = None
    for name, (a, b) in MAPS.items():
        m = H.map_quality(high, v.select("id", F.get("v", F.lit(a - 1)).alias("x"), F.get("v", F.lit(b - 1)).alias("y")), 10, 0.05).withColumn("variant", F.lit(name))
        out = m if out is None else out.unionByName(m)
    r = lambda c: F.round(c, 6).alias(c)
    return H.chosen(out, "variant").select("variant", r("pressure"), r("recall"), r("gain"), r("drop"), "passed", "selected")


@query("SELECT r_name, list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS topics FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def topics_by_layer(spark: SparkSession, d: str) -> DataFrame:
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    of = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    return t(spark, d, "customer").join(F.broadcast(of), "c_nationkey").groupBy("r_name").agg(F.sort_array(F.collect_set("c_mktsegment")).alias("topics"))


def _round_half_even(x: str) -> str:
    return f"CAST(CASE WHEN abs({x} - floor({x}) - 0.5) < 1e-9 AND floor({x}) % 2 = 0 THEN floor({x}) ELSE floor({x} + 0.5) END AS INTEGER)"


@query(f"SELECT o_custkey, count(*) AS n, greatest(1, least({_round_half_even('count(*) / 4.0')}, 6, CAST(floor(count(*) / 3.0) AS INTEGER))) AS children FROM orders GROUP BY o_custkey")
def child_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many children a cluster of each size gets."""
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("children", V.child_count(F.col("n"), 4, 3, 6))


@query("SELECT o_custkey, count(*) AS n, sum(o_totalprice) > 0 AS some FROM orders GROUP BY 1 HAVING count(*) BETWEEN 8 AND 12 ORDER BY n DESC, o_custkey LIMIT 1")
def largest_in_window(spark: SparkSession, d: str) -> DataFrame:
    """The largest group within a window of sizes."""
    n = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), (F.sum("o_totalprice") > 0).alias("some")).where(F.col("n").between(8, 12))
    best = n.agg(F.max_by(F.struct("o_custkey", "n", "some"), F.struct("n", (-F.col("o_custkey")).alias("k"))).alias("b")).where("b IS NOT NULL")
    return best.select("b.*")


@query("""SELECT z.zoom, count(*) AS n FROM orders, (VALUES ('far'), ('mid'), ('near')) z(zoom)
WHERE CASE z.zoom WHEN 'far' THEN o_orderpriority = '1-URGENT' WHEN 'mid' THEN o_orderpriority NOT IN ('4-NOT SPECIFIED', '5-LOW') ELSE TRUE END GROUP BY z.zoom""")
def zoom_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Features that each zoom level shows: main ones far out, no minor ones half way, all near."""
    k = F.col("o_orderpriority")
    zooms = F.array_compact(F.array(F.when(k == "1-URGENT", "far"), F.when(~k.isin("4-NOT SPECIFIED", "5-LOW"), "mid"), F.lit("near")))
    return t(spark, d, "orders").select(F.explode(zooms).alias("zoom")).groupBy("zoom").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def clamped_limit(spark: SparkSession, d: str) -> DataFrame:
    """A reader's limit held to 1 .. 100."""
    asked = 1_000
    return t(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(max(1, min(100, asked))).select("c_custkey", "c_name")


@query(f"WITH {E_SQL} SELECT id, round(sqrt((x - round(x, 1)) ** 2 + (y - round(y, 1)) ** 2), 9) AS moved FROM p")
def displacement(spark: SparkSession, d: str) -> DataFrame:
    """How far a point is from the place it is given."""
    return points(spark, d).select("id", F.round(F.hypot(F.col("x") - F.round("x", 1), F.col("y") - F.round("y", 1)), 9).alias("moved"))


@query("SELECT c_custkey, c_name, CAST(embedding[1] AS DOUBLE) AS first FROM customer LEFT JOIN embeddings ON vec_id = c_custkey")
def attached_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors attached as a column, by id and never by place."""
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("c_custkey"), F.get("embedding", F.lit(0)).cast("double").alias("first"))
    return t(spark, d, "customer").select("c_custkey", "c_name").join(v, "c_custkey", "left")


@query("SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS l0_sid, CAST(c_custkey % 7 AS BIGINT) AS l2_sid, NULL::BIGINT AS l1_sid, 2 AS levels FROM customer")
def level_columns(spark: SparkSession, d: str) -> DataFrame:
    """The level columns that a table happens to have, and typed nulls for the one it lacks."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("l0_sid"), (F.col("c_custkey") % 7).cast("long").alias("l2_sid"), "c_name")
    found = readers.levels(c)
    wanted = {"id": "long", **{f"l{n}_sid": "long" for n in range(max(found) + 1)}}
    return readers.optional_columns(c, wanted).withColumn("levels", F.lit(len(found)))


@query("SELECT p_partkey, ['a', p_brand, NULL, p_type] AS tags, CASE WHEN p_partkey % 3 <> 0 THEN 4 END::INTEGER AS n FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE p_partkey % 3 = 0")
def json_lists(spark: SparkSession, d: str) -> DataFrame:
    """A JSON array as a list of strings; what can't be read is null."""
    made = F.to_json(F.array(F.lit("a"), F.col("p_brand"), F.lit(None).cast("string"), F.col("p_type")), {"ignoreNullFields": "false"})
    p = t(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "{oops").otherwise(made).alias("j"))
    lists = V.json_list(F.col("j"))
    return p.select("p_partkey", lists.alias("tags"), F.when(lists.isNotNull(), F.size(lists)).alias("n"))


@query("""SELECT s_suppkey, 'jdbc:mysql://' || host || '/' || db AS url, 'host=' || split_part(host, ':', 1) || ' port=' || split_part(host, ':', 2) || ' user=u' || s_suppkey || ' passwd=p database=' || db AS attach
FROM (SELECT s_suppkey, 'h' || s_nationkey || ':' || (3000 + s_suppkey) AS host, 'd' || s_suppkey % 3 AS db FROM supplier)""")
def connection_strings(spark: SparkSession, d: str) -> DataFrame:
    """Database URLs as what JDBC and an attach statement want."""
    s = t(spark, d, "supplier")
    text = lambda c: F.col(c).cast("string")
    url = F.concat(F.lit("mysql+aiomysql://u"), text("s_suppkey"), F.lit(":p@h"), text("s_nationkey"), F.lit(":"), (3000 + F.col("s_suppkey")).cast("string"), F.lit("/d"), (F.col("s_suppkey") % 3).cast("string"))
    c = V.connection(url)
    return s.select("s_suppkey", c["url"].alias("url"), c["attach"].alias("attach"))


@query("""SELECT 'newest' AS part, c_custkey FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 40) UNION ALL SELECT 'all', c_custkey FROM customer WHERE c_nationkey = 3""")
def limited_export(spark: SparkSession, d: str) -> DataFrame:
    """An export with a limit takes the first rows of an order; without one it takes all, in no order."""
    c = t(spark, d, "customer")
    some = R.first_rows(c, 40, F.desc("c_acctbal"), F.col("c_custkey")).select(F.lit("newest").alias("part"), "c_custkey")
    return some.unionByName(R.first_rows(c.where("c_nationkey = 3"), None, F.desc("c_acctbal")).select(F.lit("all").alias("part"), "c_custkey"))

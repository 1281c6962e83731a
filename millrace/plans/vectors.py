"""Vectors, grids, clusters, geometry and graphs over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import values as V
from millrace.operators import clusters as C
from millrace.operators import graphs as G
from millrace.operators import ranking as R
from millrace.operators import spatial as S
from millrace.operators import trees as H
from millrace.plans.registry import query
from millrace.session import cut
from millrace.session import table as t

E_SQL = "e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT id, label, v[1] AS x, v[2] AS y FROM e)"
UNIT = "list_transform({0}, lambda q: q / sqrt(list_sum(list_transform({0}, lambda z: z * z))))"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))


def points(spark: SparkSession, d: str) -> DataFrame:
    """The first two components as a map."""
    return vectors(spark, d).select("id", "label", F.get("v", F.lit(0)).alias("x"), F.get("v", F.lit(1)).alias("y"))


@query(f"WITH {E_SQL} SELECT id, round(sqrt(list_inner_product(v, v)), 9) AS norm, round({UNIT.format('v')}[1], 9) AS first, round(list_inner_product(v[1:32], v[33:64]), 9) AS halves FROM e")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    return vectors(spark, d).select(
        "id", F.round(V.norm(v), 9).alias("norm"), F.round(F.get(V.unit(v), F.lit(0)), 9).alias("first"),
        F.round(V.dot(F.slice(v, 1, 32), F.slice(v, 33, 32)), 9).alias("halves"),
    )


@query(f"WITH {E_SQL}, f AS (SELECT id, {UNIT.format('v[1:32]')} AS a, {UNIT.format('v[33:64]')} AS b FROM e) SELECT id, CAST(64 AS BIGINT) AS n, round(a[1] * 0.6, 9) AS first, round(b[32] * 0.4, 9) AS last FROM f")
def fuse_blocks(spark: SparkSession, d: str) -> DataFrame:
    f = vectors(spark, d).select("id", V.fused([(F.slice("v", 1, 32), 0.6), (F.slice("v", 33, 32), 0.4)]).alias("f"))
    return f.select("id", F.size("f").cast("long").alias("n"), F.round(F.get("f", F.lit(0)), 9).alias("first"), F.round(F.element_at("f", -1), 9).alias("last"))


@query(f"WITH {E_SQL} SELECT id, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) AS x, round((y - avg(y) OVER ()) / stddev_pop(y) OVER (), 6) AS y FROM p")
def standardize(spark: SparkSession, d: str) -> DataFrame:
    z = C.standardised(points(spark, d).select("id", "x", "y"), ["x", "y"])
    return z.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


CENTRES = "k AS (SELECT label AS g, i, avg(v[i]) AS m FROM e, range(1, 65) r(i) WHERE label <> 0 GROUP BY 1, 2), c AS (SELECT g, list(m ORDER BY i) AS c FROM k GROUP BY g)"


@query(f"WITH {E_SQL}, {CENTRES} SELECT g AS label, round(c[1], 9) AS first, round(c[64], 9) AS last FROM c")
def vector_centroids(spark: SparkSession, d: str) -> DataFrame:
    c = C.centroids(vectors(spark, d).where("label <> 0"), "label", "v")
    return c.select("label", F.round(F.get("centroid", F.lit(0)), 9).alias("first"), F.round(F.element_at("centroid", -1), 9).alias("last"))


@query(f"""WITH {E_SQL}, {CENTRES}, s AS (SELECT id, g, round(list_inner_product({UNIT.format('v')}, {UNIT.format('c')}), 9) AS s FROM e, c WHERE label = 0)
SELECT id, nearest, round(similarity, 6) AS similarity FROM (SELECT id, g AS nearest, s AS similarity, row_number() OVER (PARTITION BY id ORDER BY s DESC, g) AS rn FROM s) WHERE rn = 1""")
def soft_assign(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a cluster (label 0) go to the nearest centroid."""
    v = vectors(spark, d)
    got = C.assign(v.where("label = 0"), "v", C.centroids(v.where("label <> 0"), "label", "v"), "label")
    return got.select("id", "nearest", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {E_SQL}, {CENTRES}, s AS (SELECT label, id, round(list_inner_product({UNIT.format('v')}, {UNIT.format('c')}), 9) AS s FROM e JOIN c ON g = label)
SELECT label, id, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, id) AS rn FROM s) WHERE rn <= 5""")
def representatives(spark: SparkSession, d: str) -> DataFrame:
    return C.representatives(vectors(spark, d).where("label <> 0"), "id", "label", "v", 5).select("label", "id", "rank")


NEAR = "nn AS (SELECT a.id, b.id AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS w, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.id) AS rank FROM p a JOIN p b ON a.id <> b.id)"


@query(f"WITH {E_SQL}, {NEAR} SELECT id, other, CAST(rank AS INTEGER) AS rank, round(w, 9) AS w FROM nn WHERE rank <= 4")
def knn(spark: SparkSession, d: str) -> DataFrame:
    return S.nearest(points(spark, d), 4, 0.02).select("id", "other", "rank", F.round("w", 9).alias("w"))


@query(f"WITH {E_SQL}, {NEAR}, o AS (SELECT w FROM nn WHERE rank = 1) SELECT round(quantile_cont(w, 0.5), 9) AS q50, round(quantile_cont(w, 0.99), 9) AS q99, round(min(w), 9) AS low, round(quantile_cont(1 / greatest(w, 1e-9) ** 2, 0.99) / quantile_cont(1 / greatest(w, 1e-9) ** 2, 0.5), 6) AS pressure FROM o")
def density_pressure(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of the nearest distance, and the pressure of the densest places."""
    o = cut(S.nearest(points(spark, d), 1, 0.02).select("w", (1 / F.greatest("w", F.lit(1e-9)) ** 2).alias("r")))
    w = R.order_statistics(o, [], "w", q50=("cont", 0.5), q99=("cont", 0.99), low=("at", 0))
    r = R.order_statistics(o, [], "r", r50=("cont", 0.5), r99=("cont", 0.99)).select("r50", "r99")  # one row
    return w.join(F.broadcast(r)).select(F.round("q50", 9).alias("q50"), F.round("q99", 9).alias("q99"), F.round("low", 9).alias("low"), F.round(F.col("r99") / F.col("r50"), 6).alias("pressure"))


@query(f"""WITH {E_SQL}, {NEAR}, hi AS (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY round(list_inner_product({UNIT.format('a.v')}, {UNIT.format('b.v')}), 9) DESC, b.id) AS rank
 FROM e a JOIN e b ON a.id <> b.id)
SELECT hi.id, CAST(count(nn.other) AS BIGINT) AS common FROM hi LEFT JOIN nn ON nn.id = hi.id AND nn.other = hi.other AND nn.rank <= 10 WHERE hi.rank <= 10 GROUP BY hi.id""")
def knn_recall(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours that the map keeps of those in full space, for every point."""
    low = S.nearest(points(spark, d), 10, 0.05).groupBy("id").agg(F.collect_set("other").alias("lo"))
    return H.neighbours(vectors(spark, d), "id", "v", 10).join(low, "id").select("id", F.size(F.array_intersect("hi", "lo")).cast("long").alias("common"))


@query(f"WITH {E_SQL} SELECT a.id AS a, b.id AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 9) AS w FROM p a JOIN p b ON a.id < b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.02")
def radius_pairs(spark: SparkSession, d: str) -> DataFrame:
    return S.pairs_within(points(spark, d), 0.02).withColumn("w", F.round("w", 9))


@query(f'WITH {E_SQL} SELECT CAST(floor(y / 0.05) AS BIGINT) AS "row", CAST(floor(x / 0.05) AS BIGINT) AS col, count(*) AS n FROM p GROUP BY 1, 2')
def grid_density(spark: SparkSession, d: str) -> DataFrame:
    return S.density(points(spark, d), 0.05)


@query(f"""WITH {E_SQL}, g AS (SELECT CAST(floor(y / 0.05) AS BIGINT) AS r, CAST(floor(x / 0.05) AS BIGINT) AS c, count(*) AS n FROM p GROUP BY 1, 2), k AS (SELECT i, exp(-(i * i) / 2.0) AS w FROM range(-4, 5) t(i)), z AS (SELECT sum(w) AS z FROM k)
SELECT r + a.i AS "row", c + b.i AS col, round(sum(n * a.w * b.w / z / z), 8) AS value FROM g, k a, k b, z GROUP BY 1, 2""")
def kde(spark: SparkSession, d: str) -> DataFrame:
    """Gaussian density over a sparse grid, cut off at four sigma."""
    return S.spread(S.density(points(spark, d), 0.05), S.gaussian(1.0)).withColumn("value", F.round("value", 8))


@query(f"""WITH {E_SQL}, m AS (SELECT DISTINCT CAST(floor(y / 0.05) AS BIGINT) AS r, CAST(floor(x / 0.05) AS BIGINT) AS c FROM p), k AS (SELECT a.i AS dr, b.i AS dc FROM range(-1, 2) a(i), range(-1, 2) b(i) WHERE a.i * a.i + b.i * b.i <= 1),
dil AS (SELECT DISTINCT r + dr AS r, c + dc AS c FROM m, k), ero AS (SELECT dil.r + dr AS r, dil.c + dc AS c FROM dil, k GROUP BY 1, 2 HAVING count(*) = 5)
SELECT (SELECT count(*) FROM m) AS cells, (SELECT count(*) FROM dil) AS dilated, (SELECT count(*) FROM ero) AS closed""")
def dilate(spark: SparkSession, d: str) -> DataFrame:
    m = S.density(points(spark, d), 0.05).select("row", "col")
    parts = {"cells": m, "dilated": S.dilated(m, 1), "closed": S.closed(m, 1)}
    tagged = None
    for name, p in parts.items():
        p = p.select(F.lit(name).alias("part"))
        tagged = p if tagged is None else tagged.union(p)
    return tagged.agg(*[F.count_if(F.col("part") == n).alias(n) for n in parts])


LINKS = "l AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.012), walk AS (SELECT id AS s, id AS e FROM p UNION SELECT s, b FROM walk JOIN l ON a = e), comp AS (SELECT s AS id, min(e) AS component FROM walk GROUP BY 1)"


@query(f"WITH RECURSIVE {E_SQL}, {LINKS} SELECT id, component FROM comp")
def dbscan_components(spark: SparkSession, d: str) -> DataFrame:
    return C.radius_clusters(points(spark, d), 0.012)


@query(f"WITH RECURSIVE {E_SQL}, {LINKS} SELECT count(*) AS n_components, max(n) AS largest, round(max(n) / sum(n), 6) AS share FROM (SELECT component, count(*) AS n FROM comp GROUP BY 1)")
def unified_graph(spark: SparkSession, d: str) -> DataFrame:
    """Connectivity of the neighbour graph."""
    n = C.radius_clusters(points(spark, d), 0.012).groupBy("component").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_components"), F.max("n").alias("largest"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


@query(f"WITH {E_SQL}, {NEAR}, ed AS (SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b FROM nn WHERE rank <= 4), dg AS (SELECT id, count(*) AS k FROM (SELECT a AS id FROM ed UNION ALL SELECT b FROM ed) GROUP BY 1) SELECT least(k, 8)::BIGINT AS degree, count(*) AS n FROM dg GROUP BY 1")
def degree_histogram(spark: SparkSession, d: str) -> DataFrame:
    e = G.unordered(S.nearest(points(spark, d), 4, 0.02), "id", "other")
    return G.degrees(e).groupBy(F.least("degree", F.lit(8)).cast("long").alias("degree")).agg(F.count("*").alias("n"))


def road_edges(spark: SparkSession, d: str) -> DataFrame:
    near = S.nearest(points(spark, d), 4, 0.02)
    return near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "w").distinct()


@query()
def mst(spark: SparkSession, d: str) -> DataFrame:
    """Minimum spanning forest of the neighbour graph."""
    return G.spanning_forest(points(spark, d), road_edges(spark, d)).select("a", "b", F.round("w", 9).alias("w"))


@query()
def looped_graph(spark: SparkSession, d: str) -> DataFrame:
    """The forest, with the shortest fifth more of edges."""
    e = road_edges(spark, d)
    tree = G.spanning_forest(points(spark, d), e)
    return tree.select("a", "b", "w", F.lit(False).alias("extra")).unionByName(G.extra_edges(tree, e, 0.2, 1.0).withColumn("extra", F.lit(True)))


@query()
def beta_prune(spark: SparkSession, d: str) -> DataFrame:
    """Edges of each label's own network that have no way around within 1.5 times their length."""
    p = points(spark, d)
    of = lambda end: p.select(F.col("id").alias(end), F.col("label").alias(f"g{end}"))
    e = road_edges(spark, d).join(of("a"), "a").join(of("b"), "b").where("ga = gb").select(F.col("ga").alias("label"), "a", "b", "w")
    return G.prune_by_group(e, "label", 1.5)


@query()
def relax_points(spark: SparkSession, d: str) -> DataFrame:
    return S.relax(points(spark, d), 0.01, steps=40, spring=0.05, longest=0.02).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query()
def kmeans_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Two levels below each label, clustered on all components of the vectors: sizes decide how many children."""
    v = vectors(spark, d)
    one = C.subdivide(v, "label", "id", "v", 40, 10, 6)
    two = v.join(one, ["label", "id"]).withColumn("parent", F.concat_ws("/", "label", "child"))
    return C.subdivide(two, "parent", "id", "v", 12, 4, 4)


SQUARES = "s AS (SELECT i * 10 + j AS poly, -0.5 + i * 0.1 AS x0, -0.5 + j * 0.1 AS y0 FROM range(0, 10) a(i), range(0, 10) b(j))"


def squares(spark: SparkSession) -> DataFrame:
    i = spark.range(100).select(F.col("id").alias("poly"), (F.floor(F.col("id") / 10) * F.lit(0.1) - 0.5).alias("x0"), ((F.col("id") % 10) * F.lit(0.1) - 0.5).alias("y0"))
    corner = lambda dx, dy: F.struct((F.col("x0") + dx).alias("x"), (F.col("y0") + dy).alias("y"))
    return i.select("poly", F.array(corner(0.0, 0.0), corner(0.1, 0.0), corner(0.1, 0.1), corner(0.0, 0.1)).alias("ring"))


@query(f"WITH {E_SQL}, {SQUARES} SELECT id, min(poly)::BIGINT AS poly FROM p LEFT JOIN s ON x >= x0 AND x < x0 + 0.1 AND y >= y0 AND y < y0 + 0.1 GROUP BY id")
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    return S.assign_to_polygons(points(spark, d), squares(spark), 0.1)


@query(f"WITH {E_SQL}, {SQUARES} SELECT poly::BIGINT AS poly, count(id) AS n FROM s LEFT JOIN p ON x >= x0 AND x < x0 + 0.1 AND y >= y0 AND y < y0 + 0.1 GROUP BY poly")
def spatial_count(spark: SparkSession, d: str) -> DataFrame:
    sq = squares(spark)
    n = S.assign_to_polygons(points(spark, d), sq, 0.1).groupBy("poly").agg(F.count("*").alias("k"))
    return sq.join(n, "poly", "left").select("poly", F.coalesce("k", F.lit(0)).cast("long").alias("n"))


@query("SELECT range::BIGINT AS poly, round(0.01::DOUBLE * (1 + range % 3), 9) AS area, round(0.2::DOUBLE + 0.2 * (1 + range % 3), 9) AS perimeter, round(4 * pi() * 0.01 * (1 + range % 3) / (0.2 + 0.2 * (1 + range % 3)) ** 2, 6) AS compactness FROM range(100)")
def polygon_measures(spark: SparkSession, d: str) -> DataFrame:
    wide = F.transform("ring", lambda p: F.struct((p["x"] * (1 + F.col("poly") % 3)).alias("x"), p["y"].alias("y")))
    m = squares(spark).withColumn("m", S.measures(wide))
    return m.select("poly", F.round("m.area", 9).alias("area"), F.round("m.perimeter", 9).alias("perimeter"), F.round("m.compactness", 6).alias("compactness"))


@query(f"WITH {E_SQL} SELECT id, (ABS(y) > ABS(x))::INTEGER AS line, round(least(abs(x), abs(y)), 9) AS w FROM p WHERE abs(x) < 1 AND abs(y) < 1".replace("(ABS(y) > ABS(x))::INTEGER", "(abs(y) > abs(x))::INTEGER"))
def nearest_line(spark: SparkSession, d: str) -> DataFrame:
    """The nearer of the two axes, as segments."""
    lines = [(0, -1.0, 0.0, 1.0, 0.0), (1, 0.0, -1.0, 0.0, 1.0)]
    cols = F.array(*[F.struct(S.segment_distance(F.col("x"), F.col("y"), *map(F.lit, l[1:])).alias("w"), F.lit(l[0]).alias("line")) for l in lines])  # noqa: E741
    return points(spark, d).withColumn("n", F.array_min(cols)).select("id", F.col("n.line").alias("line"), F.round("n.w", 9).alias("w"))


@query(f"WITH {E_SQL} SELECT label, round(sum(x * (1 + id % 5)) / sum(1 + id % 5), 9) AS cx, round(sum(y * (1 + id % 5)) / sum(1 + id % 5), 9) AS cy, count(*) AS n, min(x) AS x0, max(y) AS y1 FROM p GROUP BY label")
def weighted_centroid(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).withColumn("w", 1 + F.col("id") % 5)
    mean = lambda c: F.round(F.when(F.sum("w") > 0, F.sum(F.col(c) * F.col("w")) / F.sum("w")).otherwise(F.avg(c)), 9)
    return p.groupBy("label").agg(mean("x").alias("cx"), mean("y").alias("cy"), F.count("*").alias("n"), F.min("x").alias("x0"), F.max("y").alias("y1"))


@query(f"WITH {E_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY x, id) AS i, row_number() OVER (ORDER BY y, id) AS j, count(*) OVER () AS n FROM p), c AS (SELECT *, CAST(floor(n * 0.06) AS BIGINT) AS k FROM r) SELECT min(x) FILTER (i > k) AS x0, max(x) FILTER (i <= n - k) AS x1, min(y) FILTER (j > k) AS y0, max(y) FILTER (j <= n - k) AS y1 FROM c")
def trimmed_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Bounds without six hundredths at either end of each axis, from counted values rather than one sorted partition."""
    p = points(spark, d)
    n = p.count()
    k = int(n * 0.06) if n >= 24 else 0
    x = R.order_statistics(p, [], "x", x0=("at", k), x1=("at", -1 - k)).select("x0", "x1")
    y = R.order_statistics(p, [], "y", y0=("at", k), y1=("at", -1 - k)).select("y0", "y1")  # one row
    return x.join(F.broadcast(y))


@query(f"WITH {E_SQL} SELECT id FROM p WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.1 AND 0.1 ORDER BY id % 97 DESC, id LIMIT 27")
def viewport_budget(spark: SparkSession, d: str) -> DataFrame:
    """Labels in a box, as many as the zoom level allows."""
    lod = 5
    budget = min(2500, round(5 * 1.4**lod))
    inside = points(spark, d).where(F.col("x").between(-0.1, 0.1) & F.col("y").between(-0.1, 0.1))
    return inside.orderBy(F.desc(F.col("id") % 97), "id").limit(budget).select("id")


@query(f"WITH {E_SQL} SELECT label, round(0.5 * atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)), 6) AS angle FROM p GROUP BY label")
def principal_axes(spark: SparkSession, d: str) -> DataFrame:
    angle = 0.5 * F.atan2(2 * F.covar_samp("x", "y"), F.var_samp("x") - F.var_samp("y"))
    return points(spark, d).groupBy("label").agg(F.round(angle, 6).alias("angle"))


@query("""WITH w AS (SELECT doc_id, lang, list_filter(regexp_extract_all(lower(text), 'TERM', 1), lambda x: NOT list_contains(STOPS, x) AND NOT regexp_full_match(x, '[0-9]+')) AS t FROM documents),
g AS (SELECT lang, unnest(t) AS term, 1.0::DOUBLE AS s FROM w UNION ALL SELECT lang, unnest(list_filter(list_transform(t, lambda x, i: CASE WHEN i < len(t) AND t[i + 1] <> x THEN x || ' ' || t[i + 1] END), lambda p: p IS NOT NULL)), 1.6 FROM w),
c AS (SELECT lang, term, round(count(*) * max(s), 4) AS score FROM g GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT lang, term, score, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) AS INTEGER) AS rank FROM c QUALIFY rank <= 6""".replace("STOPS", str(T.STOP_WORDS)).replace("TERM", T.TERM.replace("'", "''")))
def keyphrases(spark: SparkSession, d: str) -> DataFrame:
    return C.keyphrases(t(spark, d, "documents"), "lang", T.terms(F.col("text")), 6)

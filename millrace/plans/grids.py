"""Grids over the points: components, regions, samples, polygon statistics, density clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import graphs as N
from millrace.operators import grids as G
from millrace.operators import placing as P
from millrace.operators import spatial as S
from millrace.plans.placing import SEG, lines
from millrace.plans.registry import query
from millrace.plans.vectors import E_SQL, NEAR, SQUARES, points, road_edges, squares
from millrace.session import cut

GRID = "g AS (SELECT CAST(floor(y / 0.05) AS BIGINT) AS r, CAST(floor(x / 0.05) AS BIGINT) AS c, count(*) AS n FROM p GROUP BY 1, 2)"


def grid(spark: SparkSession, d: str) -> DataFrame:
    return S.density(points(spark, d), 0.05).select("row", "col", F.col("n").cast("double").alias("value"))


@query(f"WITH {E_SQL}, {NEAR}, ee AS (SELECT greatest(max(x) - min(x), max(y) - min(y)) AS extent FROM p), m AS (SELECT quantile_cont(w, 0.5) AS nn FROM nn WHERE rank = 1) SELECT round(greatest(extent / 160, nn / 3), 9) AS size FROM ee, m")
def cell_size(spark: SparkSession, d: str) -> DataFrame:
    """A cell size from the extent and the median distance of neighbours."""
    p = points(spark, d)
    e = p.agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("extent"))  # one row
    m = S.nearest(p, 1, 0.02).agg(F.percentile("w", F.lit(0.5)).alias("nn"))
    return m.join(F.broadcast(e)).select(F.round(F.greatest(F.col("extent") / 160, F.col("nn") / 3), 9).alias("size"))


@query(f"""WITH {E_SQL}, {GRID}, q AS (SELECT id, floor(x / 0.05 - 0.5) AS c, floor(y / 0.05 - 0.5) AS r, x / 0.05 - 0.5 - floor(x / 0.05 - 0.5) AS fc, y / 0.05 - 0.5 - floor(y / 0.05 - 0.5) AS fr FROM p),
f AS (SELECT id, r + i AS r, c + j AS c, (CASE WHEN i = 1 THEN fr ELSE 1 - fr END) * (CASE WHEN j = 1 THEN fc ELSE 1 - fc END) AS w FROM q, range(2) a(i), range(2) b(j))
SELECT id, round(sum(w * coalesce(n, 0)), 7) AS value FROM f LEFT JOIN g USING (r, c) GROUP BY id""")
def bilinear_samples(spark: SparkSession, d: str) -> DataFrame:
    return G.sampled(points(spark, d), grid(spark, d), 0.05).withColumn("value", F.round("value", 7))


@query(f"""WITH {E_SQL}, {GRID}, {SQUARES}, k AS (SELECT r * 1048576 + c AS cell, n, (c + 0.5) * 0.05 AS cx, (r + 0.5) * 0.05 AS cy FROM g),
i AS (SELECT poly, avg(n) AS mean, CAST(sum(n) AS DOUBLE) * 0.05::DOUBLE * 0.05::DOUBLE AS mass FROM s JOIN k ON cx >= x0 AND cx < x0 + 0.1 AND cy >= y0 AND cy < y0 + 0.1 GROUP BY poly),
o AS (SELECT poly, n AS mean, row_number() OVER (PARTITION BY poly ORDER BY round(sqrt((x0 + 0.05 - cx) ** 2 + (y0 + 0.05 - cy) ** 2), 9), cell) AS rn FROM s, k WHERE poly NOT IN (SELECT poly FROM i))
SELECT poly::BIGINT AS poly, round(mean, 9) AS mean, round(mass, 9) AS mass FROM i UNION ALL SELECT poly::BIGINT, round(CAST(mean AS DOUBLE), 9), 0.0::DOUBLE FROM o WHERE rn = 1""")
def polygon_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean and mass of the cells in each polygon; the nearest cell's value where it has none."""
    return G.polygon_means(squares(spark), grid(spark, d), 0.05).select("poly", F.round("mean", 9).alias("mean"), F.round("mass", 9).alias("mass"))


@query(f"""WITH {E_SQL}, {GRID}, {SQUARES}, k AS (SELECT i, exp(-(i * i) / 2.0) AS w FROM range(-4, 5) t(i)), z AS (SELECT sum(w) AS z FROM k),
v AS (SELECT r + a.i AS r, c + b.i AS c, sum(n * a.w * b.w / z / z) AS value FROM g, k a, k b, z GROUP BY 1, 2),
t AS (SELECT poly, CASE WHEN count(*) >= 2 THEN quantile_cont(value, 0.9) / quantile_cont(value, 0.5) ELSE 0.0 END AS contrast FROM s JOIN v ON (c + 0.5) * 0.05 >= x0 AND (c + 0.5) * 0.05 < x0 + 0.1 AND (r + 0.5) * 0.05 >= y0 AND (r + 0.5) * 0.05 < y0 + 0.1 GROUP BY poly),
m AS (SELECT poly, count(*) AS n FROM s JOIN p ON x >= x0 AND x < x0 + 0.1 AND y >= y0 AND y < y0 + 0.1 GROUP BY poly)
SELECT s.poly::BIGINT AS poly, round(0.01::DOUBLE, 9) AS area, coalesce(n, 0) AS n, round(coalesce(n, 0) / 0.01::DOUBLE, 6) AS density, round(coalesce(contrast, 0.0), 6) AS contrast FROM s LEFT JOIN m USING (poly) LEFT JOIN t USING (poly)""")
def polygon_contrast(spark: SparkSession, d: str) -> DataFrame:
    smooth = S.spread(S.density(points(spark, d), 0.05), S.gaussian(1.0))
    c = G.polygon_contrast(squares(spark), points(spark, d), smooth, 0.05)
    return c.select("poly", F.round("area", 9).alias("area"), "n", F.round("density", 6).alias("density"), F.round("contrast", 6).alias("contrast"))


CELLS = "m AS (SELECT DISTINCT CAST(floor(y / 0.02) AS BIGINT) AS r, CAST(floor(x / 0.02) AS BIGINT) AS c FROM p), w AS (SELECT r * 1048576 + c AS s, r, c FROM m UNION SELECT w.s, m.r, m.c FROM w JOIN m ON abs(w.r - m.r) <= 1 AND abs(w.c - m.c) <= 1), comp AS (SELECT r, c, min(s) AS component FROM w GROUP BY r, c)"


@query(f"""WITH RECURSIVE {E_SQL}, {CELLS}, z AS (SELECT component, count(*) AS n, round(avg((c + 0.5) * 0.02), 9) AS x, round(avg((r + 0.5) * 0.02), 9) AS y FROM comp GROUP BY 1),
o AS (SELECT a.component, b.component AS owner, row_number() OVER (PARTITION BY a.component ORDER BY round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 9), b.component) AS rn FROM z a, z b WHERE a.n < 3 AND b.n >= 3),
f AS (SELECT comp.r, comp.c, coalesce(owner, comp.component) AS owner FROM comp LEFT JOIN (SELECT * FROM o WHERE rn = 1) USING (component)),
i AS (SELECT owner, row_number() OVER (ORDER BY count(*) DESC, owner) - 1 AS region FROM f GROUP BY owner)
SELECT f.r AS "row", f.c AS col, CAST(region AS INTEGER) AS region FROM f JOIN i USING (owner)""")
def grid_regions(spark: SparkSession, d: str) -> DataFrame:
    """Touching cells as regions by size, small ones joined to the nearest large one."""
    return G.regions(S.density(points(spark, d), 0.02), 3, 0.02)


@query(f"""WITH RECURSIVE {E_SQL}, l AS (SELECT DISTINCT CAST(floor(y / 0.02) AS BIGINT) AS r, CAST(floor(x / 0.02) AS BIGINT) AS c FROM p), b AS (SELECT DISTINCT CAST(floor(y / 0.02) AS BIGINT) AS r, CAST(floor(x / 0.02) AS BIGINT) AS c FROM p WHERE label < 3),
m AS (SELECT r, c FROM l WHERE NOT EXISTS (SELECT 1 FROM b WHERE (b.r - l.r) ** 2 + (b.c - l.c) ** 2 <= 1)),
w AS (SELECT r * 1048576 + c AS s, r, c FROM m UNION SELECT w.s, m.r, m.c FROM w JOIN m ON abs(w.r - m.r) <= 1 AND abs(w.c - m.c) <= 1), comp AS (SELECT r, c, min(s) AS component FROM w GROUP BY r, c)
SELECT r AS "row", c AS col FROM comp WHERE component IN (SELECT component FROM comp GROUP BY 1 HAVING count(*) >= 2)""")
def land_use(spark: SparkSession, d: str) -> DataFrame:
    """Cells outside the buffered blocks, without small parts."""
    p = points(spark, d)
    return G.without_blocks(S.density(p, 0.02), S.density(p.where("label < 3"), 0.02).select("row", "col"), 1, 2)


@query(f"""WITH RECURSIVE {E_SQL}, {GRID}, s AS (SELECT r * 1000 + c AS seed, r AS r0, c AS c0, n AS top FROM (SELECT *, row_number() OVER (ORDER BY n DESC, r, c) AS k FROM g) WHERE k <= 5),
w AS (SELECT seed, r0, c0, top, r0 AS r, c0 AS c FROM s UNION SELECT w.seed, r0, c0, top, g.r, g.c FROM w JOIN g ON abs(w.r - g.r) <= 1 AND abs(w.c - g.c) <= 1 AND g.n >= top * 0.45 AND (g.r - r0) ** 2 + (g.c - c0) ** 2 <= 9)
SELECT seed, r AS "row", c AS col FROM w""")
def core_regions(spark: SparkSession, d: str) -> DataFrame:
    """The five densest cells grown to 45 % of their own value, three cells far at most."""
    g = grid(spark, d)
    seeds = g.orderBy(F.desc("value"), "row", "col").limit(5).select((F.col("row") * 1000 + F.col("col")).alias("seed"), "row", "col")
    return G.grown(g, seeds, 0.45, 3.0)


@query(f"""WITH {E_SQL}, k AS (SELECT i * 100 + j AS cell, -0.2 + (j + 0.5) * 0.02 AS cx, -0.2 + (i + 0.5) * 0.02 AS cy FROM range(20) a(i), range(20) b(j)),
n AS (SELECT cell, label, row_number() OVER (PARTITION BY cell ORDER BY round(sqrt((cx - x) ** 2 + (cy - y) ** 2), 9), id) AS rn FROM k, p)
SELECT label, count(*) AS cells, min(cell) AS first_cell FROM n WHERE rn = 1 GROUP BY label""")
def nearest_label_raster(spark: SparkSession, d: str) -> DataFrame:
    """Cells labelled by their nearest point (bounded Voronoi cells on a raster), as regions."""
    cell = spark.range(400).select((F.floor(F.col("id") / 20) * 100 + F.col("id") % 20).alias("id"), (F.lit(-0.2) + (F.col("id") % 20 + 0.5) * 0.02).alias("x"), (F.lit(-0.2) + (F.floor(F.col("id") / 20) + 0.5) * 0.02).alias("y"))
    p = points(spark, d)
    near = P.nearest_point(cell, p.withColumnRenamed("id", "point"), "point", 0.02).join(p.select(F.col("id").alias("point"), "label"), "point")
    return near.groupBy("label").agg(F.count("*").alias("cells"), F.min("id").alias("first_cell"))


@query(f"""WITH RECURSIVE {E_SQL}, l AS (SELECT a.id AS a, b.id AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 9) AS w FROM p a JOIN p b ON a.id <> b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.02),
core AS (SELECT a AS id FROM l GROUP BY a HAVING count(*) + 1 >= 4), walk AS (SELECT id AS s, id AS e FROM core UNION SELECT s, b FROM walk JOIN l ON a = e WHERE b IN (FROM core)), comp AS (SELECT s AS id, min(e) AS cluster FROM walk GROUP BY 1),
bord AS (SELECT a AS id, cluster, row_number() OVER (PARTITION BY a ORDER BY w, b) AS rn FROM l JOIN comp ON comp.id = b WHERE a NOT IN (FROM core))
SELECT p.id, coalesce(comp.cluster, bord.cluster) AS cluster FROM p LEFT JOIN comp USING (id) LEFT JOIN bord ON bord.id = p.id AND rn = 1""")
def density_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Chains of dense points, border points with the nearest of them, the rest noise."""
    return G.density_clusters(points(spark, d), 0.02, 4)


@query()
def main_streets(spark: SparkSession, d: str) -> DataFrame:
    """Edges on the shortest ways between each label's first three nodes, and how many of the ways use them."""
    p = points(spark, d)
    of = lambda end: p.select(F.col("id").alias(end), F.col("label").alias(f"g{end}"))
    e = road_edges(spark, d).join(of("a"), "a").join(of("b"), "b").where("ga = gb").select(F.col("ga").alias("label"), "a", "b", F.round("w", 9).alias("w"))
    e = cut(e)
    ends = e.groupBy("label").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.array("a", "b"))))).alias("v"))
    major = ends.select("label", F.slice("v", 1, 3).alias("v"))
    return N.paths_between(e, major, "label")


@query(f"""WITH {E_SQL}, {GRID}, u AS (SELECT r, c, (n - min(n) OVER ()) / CAST(max(n) OVER () - min(n) OVER () AS DOUBLE) AS v FROM g)
SELECT u.r AS "row", u.c AS col, round(u.v, 9) AS value, round(sqrt(((coalesce(e.v, 0) - coalesce(w.v, 0)) / 2) ** 2 + ((coalesce(n.v, 0) - coalesce(s.v, 0)) / 2) ** 2), 9) AS slope
FROM u LEFT JOIN u e ON e.r = u.r AND e.c = u.c + 1 LEFT JOIN u w ON w.r = u.r AND w.c = u.c - 1 LEFT JOIN u n ON n.r = u.r + 1 AND n.c = u.c LEFT JOIN u s ON s.r = u.r - 1 AND s.c = u.c""")
def terrain_slopes(spark: SparkSession, d: str) -> DataFrame:
    """The density as heights from 0 to 1, and how steep they are."""
    return G.slopes(grid(spark, d)).select("row", "col", F.round("value", 9).alias("value"), F.round("slope", 9).alias("slope"))


@query(f"""WITH RECURSIVE {E_SQL}, {SEG}, m AS (SELECT DISTINCT CAST(floor(y / 0.02) AS BIGINT) AS r, CAST(floor(x / 0.02) AS BIGINT) AS c FROM p),
l AS (SELECT a.r * 1048576 + a.c AS a, b.r * 1048576 + b.c AS b, (a.c + 0.5) * 0.02 AS px, (a.r + 0.5) * 0.02 AS py, (b.c - a.c) * 0.02 AS dx, (b.r - a.r) * 0.02 AS dy FROM m a JOIN m b ON (b.r = a.r AND b.c = a.c + 1) OR (b.c = a.c AND b.r = a.r + 1)),
t AS (SELECT a, b, ((ax - px) * (by_ - ay) - (ay - py) * (bx - ax)) / nullif(dx * (by_ - ay) - dy * (bx - ax), 0) AS t, ((ax - px) * dy - (ay - py) * dx) / nullif(dx * (by_ - ay) - dy * (bx - ax), 0) AS u FROM l, h),
x AS (SELECT DISTINCT a, b FROM t WHERE t > 0 AND t < 1 AND u > 0 AND u < 1), o AS (SELECT a, b FROM l EXCEPT SELECT a, b FROM x), s AS (SELECT a, b FROM o UNION ALL SELECT b, a FROM o),
w AS (SELECT r * 1048576 + c AS s, r * 1048576 + c AS e FROM m UNION SELECT w.s, s.b FROM w JOIN s ON s.a = w.e), comp AS (SELECT e AS id, min(s) AS comp FROM w GROUP BY 1), z AS (SELECT comp, count(*) AS n FROM comp GROUP BY 1),
k AS (SELECT ca.comp AS small, cb.comp AS large, count(*) AS k FROM (SELECT a, b FROM x UNION ALL SELECT b, a FROM x) y JOIN comp ca ON ca.id = a JOIN comp cb ON cb.id = b JOIN z za ON za.comp = ca.comp JOIN z zb ON zb.comp = cb.comp WHERE za.n < 4 AND zb.n >= 4 GROUP BY 1, 2),
f AS (SELECT id, coalesce(large, comp) AS owner FROM comp LEFT JOIN (SELECT small, large FROM k QUALIFY row_number() OVER (PARTITION BY small ORDER BY k DESC, large) = 1) ON small = comp),
i AS (SELECT owner, row_number() OVER (ORDER BY count(*) DESC, owner) - 1 AS district FROM f GROUP BY owner)
SELECT r AS "row", c AS col, CAST(district AS INTEGER) AS district FROM m JOIN f ON f.id = r * 1048576 + c JOIN i USING (owner)""")
def road_districts(spark: SparkSession, d: str) -> DataFrame:
    """Cells cut into districts by roads, slivers joined to the neighbour they share most with."""
    return G.districts(S.density(points(spark, d), 0.02), lines(spark, d).select("id", "ax", "ay", "bx", "by"), 0.02, 4)

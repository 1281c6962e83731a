"""Layout queries: labels, slots, parcels and outlines by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import clusters as C
from millrace.operators import graphs as G
from millrace.operators import grids as N
from millrace.operators import layout as L
from millrace.operators import ranking as Q
from millrace.operators import raster as R
from millrace.operators import spatial as S
from millrace.plans.placing import SEG, lines
from millrace.plans.registry import query
from millrace.plans.vectors import E_SQL, points, vectors
from millrace.session import cut


@query()
def label_placement(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).withColumns({"w": F.lit(0.05), "h": F.lit(0.02), "priority": F.col("id") % 17})
    return L.place_labels(p, "label")


@query()
def thinned_points(spark: SparkSession, d: str) -> DataFrame:
    return L.thin(points(spark, d).withColumn("priority", F.col("id") % 5), "label", 0.03)


@query()
def slot_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Each label's points on a lattice of slots around them."""
    p = points(spark, d)
    box = p.groupBy("label").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    side = F.ceil(F.sqrt(F.col("n") * 1.3)).cast("int")
    lattice = box.withColumn("m", side).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("m") * F.col("m") - 1)))
    at = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * (i + 0.5) / F.col("m")
    slots = lattice.select("label", "slot", at("x0", "x1", F.col("slot") % F.col("m")).alias("x"), at("y0", "y1", F.floor(F.col("slot") / F.col("m"))).alias("y"))
    return L.assign_slots(p, slots, "label").withColumn("moved", F.round("moved", 9))


@query(f"WITH {E_SQL}, b AS (SELECT label, (max(x) - min(x)) * (max(y) - min(y)) AS area FROM p GROUP BY label) SELECT label, round(area, 8) AS area FROM b")
def parcel_areas(spark: SparkSession, d: str) -> DataFrame:
    """The parcels of each label's box; they fill it."""
    box = points(spark, d).groupBy("label").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    corner = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    rings = box.select("label", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")).alias("ring"))
    return L.parcels(rings, "label", 0.01).groupBy("label").agg(F.round(F.sum("area"), 8).alias("area"))


@query(f"WITH {E_SQL}, g AS (SELECT DISTINCT label, CAST(floor(y / 0.05) AS BIGINT) AS r, CAST(floor(x / 0.05) AS BIGINT) AS c FROM p) SELECT label, count(*) AS cells FROM g GROUP BY label")
def region_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Outlines of each label's cells; their signed areas add up to the cells."""
    p = points(spark, d)
    cells = p.select("label", S.cell(F.col("y"), 0.05).alias("row"), S.cell(F.col("x"), 0.05).alias("col")).distinct()
    rings = L.region_polygons(cells, "label", 1.0)
    return rings.groupBy("label").agg(F.round(F.sum(S.area2(F.col("ring")) / 2)).cast("long").alias("cells"))


@query("SELECT range::BIGINT AS id, round((1 + range % 5) * 2.0::DOUBLE, 6) AS area FROM range(50)")
def building_quads(spark: SparkSession, d: str) -> DataFrame:
    b = spark.range(50).select("id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), (F.col("id") * 0.1).alias("angle"), (1 + F.col("id") % 5).cast("double").alias("w"), F.lit(2.0).alias("h"))
    m = b.withColumn("ring", L.quad("x", "y", "angle", "w", "h")).withColumn("m", S.measures(F.col("ring")))
    return m.select("id", F.round("m.area", 6).alias("area"))


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    """Smoothed density of each label's points."""
    p = points(spark, d)
    n = p.groupBy("label", S.cell(F.col("y"), 0.05).alias("row"), S.cell(F.col("x"), 0.05).alias("col")).agg(F.count("*").alias("n"))
    moves = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(w).alias("w")) for r, c, w in S.gaussian(0.7)])
    m = n.withColumn("m", F.explode(moves))
    return m.groupBy("label", (F.col("row") + F.col("m.r")).alias("row"), (F.col("col") + F.col("m.c")).alias("col")).agg(F.round(F.sum(F.col("n") * F.col("m.w")), 9).alias("value"))


@query()
def density_peaks(spark: SparkSession, d: str) -> DataFrame:
    return N.peaks(_tiles(spark, d), "label", "value", 3.0, 0.3)


@query()
def drained_cells(spark: SparkSession, d: str) -> DataFrame:
    return R.flow_by_tile(_tiles(spark, d), "label", "value")


@query()
def cheapest_routes(spark: SparkSession, d: str) -> DataFrame:
    """Paths between the two highest peaks of each label, cheap where it is dense."""
    tiles = _tiles(spark, d)
    top = N.peaks(tiles, "label", "value", 3.0, 0.0)
    first = F.sort_array(F.collect_list(F.struct((-F.col("value")).alias("v"), "row", "col")))
    ends = top.groupBy("label").agg(first.alias("t")).where("size(t) > 1")
    at = lambda i, c: F.get("t", F.lit(i))[c]
    pairs = ends.select("label", F.lit(0).cast("long").alias("pair"), at(0, "row").alias("r1"), at(0, "col").alias("c1"), at(1, "row").alias("r2"), at(1, "col").alias("c2"))
    cost = tiles.withColumn("cost", 1 / (0.1 + F.col("value")))
    return R.routes(cost, pairs, "label", "cost").withColumn("length", F.round("length", 6))


@query()
def cost_raster(spark: SparkSession, d: str) -> DataFrame:
    """What a way pays on each cell of a label's tile."""
    return R.costs_by_tile(_tiles(spark, d), "label", "value").withColumn("cost", F.round("cost", 9))


def label_rings(spark: SparkSession, d: str) -> DataFrame:
    """Each label's points as a ring around their mean."""
    p = points(spark, d)
    c = p.groupBy("label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    turn = p.join(c, "label").withColumn("t", F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx")))
    corners = F.transform(F.sort_array(F.collect_list(F.struct("t", "id", "x", "y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    return turn.groupBy("label").agg(corners.alias("ring"))


@query()
def ring_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Direction, convexity and irregularity of rings."""
    r = lambda c: F.round(c, 6).alias(c)
    return L.shapes(label_rings(spark, d), "label").select("label", "corners", r("axis"), r("convexity"), r("irregularity"))


@query()
def local_roads(spark: SparkSession, d: str) -> DataFrame:
    """Roads between the children of each label (the least network, and a fifth more edges), and main roads between the labels' centres."""
    v = vectors(spark, d)
    child = C.subdivide(v, "label", "id", "v", 40, 10, 6)
    at = points(spark, d).join(child.select("id", "child"), "id")
    local = at.groupBy("label", "child").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).withColumn("id", F.col("label").cast("long") * 100 + F.col("child"))
    main = at.groupBy("label").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).withColumn("id", F.col("label").cast("long"))
    local, main = cut(local), cut(main)
    other = local.select("label", F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    w = F.round(F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by")), 9).alias("w")
    pairs = local.join(other, "label").where("id < b").select(F.col("id").alias("a"), "b", w)  # a label has six children at most
    near = S.nearest(main, 4, 0.05).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), F.round("w", 9).alias("w")).distinct()
    out = None
    for kind, nodes, edges in (("local", local, pairs), ("main", main, near)):
        e = cut(edges)
        tree = G.spanning_forest(nodes, e)
        more = G.extra_edges(tree, e, 0.2, 1.0)
        part = tree.select("a", "b", "w", F.lit(kind).alias("kind")).unionByName(more.select("a", "b", "w", F.lit(kind + " loop").alias("kind")))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {E_SQL} SELECT label, count(*) AS n, round((max(x) - min(x) + 0.02) * (max(y) - min(y) + 0.02), 8) AS area FROM p GROUP BY label")
def voronoi_areas(spark: SparkSession, d: str) -> DataFrame:
    """Cells of each label's points; they fill the label's box."""
    cells = L.voronoi_cells(points(spark, d), "label", 0.01)
    return cells.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("area"), 8).alias("area"))


@query()
def clipped_footprints(spark: SparkSession, d: str) -> DataFrame:
    """Footprints beside the roads; those that lose more than half of their area are left out."""
    p = points(spark, d).where("id % 3 = 0").select("id", "x", "y", (F.col("id") % 7 * 0.2).alias("angle"), F.lit(0.012).alias("w"), F.lit(0.008).alias("h"))
    roads = lines(spark, d).select("id", "ax", "ay", "bx", "by")
    kept = L.clipped(p.withColumn("ring", L.quad("x", "y", "angle", "w", "h")), "id", roads, 0.001, 0.5)
    return kept.select("id", F.round("area", 9).alias("area"), F.round("share", 6).alias("share"))


TRIANGLES = """t AS (SELECT a.label, a.id AS a, b.id AS b, c.id AS c, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy FROM p a JOIN p b ON a.label = b.label AND a.id < b.id JOIN p c ON b.label = c.label AND b.id < c.id WHERE a.label < 4),
d AS (SELECT t.*, 2 * (ax * (by_ - cy) + bx * (cy - ay) + cx * (ay - by_)) AS det FROM t), o AS (SELECT *, ((ax * ax + ay * ay) * (by_ - cy) + (bx * bx + by_ * by_) * (cy - ay) + (cx * cx + cy * cy) * (ay - by_)) / det AS ox, ((ax * ax + ay * ay) * (cx - bx) + (bx * bx + by_ * by_) * (ax - cx) + (cx * cx + cy * cy) * (bx - ax)) / det AS oy FROM d WHERE det <> 0),
f AS (SELECT *, abs(det) / 4 AS area, sqrt(greatest((ax - bx) ** 2 + (ay - by_) ** 2, (bx - cx) ** 2 + (by_ - cy) ** 2, (ax - cx) ** 2 + (ay - cy) ** 2)) AS longest FROM o WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.label = o.label AND q.id NOT IN (a, b, c) AND (q.x - ox) ** 2 + (q.y - oy) ** 2 < ((ax - ox) ** 2 + (ay - oy) ** 2) * (1 - 1e-9)))"""


def few(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).where("label < 4")


@query(f"""WITH {E_SQL}, {TRIANGLES}, s AS (SELECT label, a, b FROM f UNION SELECT label, b, c FROM f UNION SELECT label, a, c FROM f), n AS (SELECT label, count(*) AS edges FROM s GROUP BY 1)
SELECT label, count(*) AS triangles, any_value(edges) AS edges, round(sum(area), 7) AS area FROM f JOIN n USING (label) GROUP BY label""")
def triangulation(spark: SparkSession, d: str) -> DataFrame:
    """Delaunay triangles of each island's points: candidate edges for its roads."""
    found = cut(L.triangles(few(spark, d), "label"))
    n = L.edges_of(found, "label").groupBy("label").agg(F.count("*").alias("edges"))
    return found.groupBy("label").agg(F.count("*").alias("triangles"), F.round(F.sum("area"), 7).alias("area")).join(n, "label")


@query(f"""WITH {E_SQL}, {TRIANGLES}, q AS (SELECT label, quantile_cont(longest, 0.9) AS most FROM f GROUP BY 1), k AS (SELECT f.* FROM f JOIN q USING (label) WHERE longest <= most),
s AS (SELECT label, a, b, count(*) AS n FROM (SELECT label, a, b FROM k UNION ALL SELECT label, b, c FROM k UNION ALL SELECT label, a, c FROM k) GROUP BY ALL)
SELECT label, (SELECT count(*) FROM k WHERE k.label = q.label) AS triangles, (SELECT round(sum(area), 7) FROM k WHERE k.label = q.label) AS area, (SELECT count(*) FROM s WHERE s.label = q.label AND n = 1) AS outline FROM q""")
def alpha_land(spark: SparkSession, d: str) -> DataFrame:
    """The land of each island: triangles without a long side, and the edges of its outline."""
    found = cut(L.triangles(few(spark, d), "label"))
    most = Q.order_statistics(found, ["label"], "longest", most=("cont", 0.9)).select("label", "most")
    kept = cut(found.join(most, "label").where("longest <= most").drop("most"))
    outline = L.edges_of(kept, "label").where("n = 1").groupBy("label").agg(F.count("*").alias("outline"))
    return kept.groupBy("label").agg(F.count("*").alias("triangles"), F.round(F.sum("area"), 7).alias("area")).join(outline, "label")


@query(f"""WITH {E_SQL}, q AS (SELECT id, 0.002 + 0.001 * (id % 5) AS w, 0.004 AS d, 0.01 + 0.005 * (id % 3) AS h FROM p), {SEG}
SELECT 'building' AS part, id, 10 AS triangles, round(CAST(w * d + 2 * (w + d) * h AS DOUBLE), 9) AS area FROM q UNION ALL SELECT 'road', id, 2, round(len * 0.004, 9) FROM h""")
def meshes(spark: SparkSession, d: str) -> DataFrame:
    """Buildings as prisms and roads as ribbons, in triangles."""
    p = points(spark, d).withColumns({"w": 0.002 + 0.001 * (F.col("id") % 5), "d": F.lit(0.004), "h": 0.01 + 0.005 * (F.col("id") % 3), "angle": F.col("id") % 7 * 0.3})
    body = p.select(F.lit("building").alias("part"), "id", L.extruded(L.quad("x", "y", "angle", "w", "d"), F.col("h")).alias("t"))
    r = lines(spark, d).select("id", L.ribbon(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), 0.002).alias("ring"))
    corner = lambda i: F.struct(F.get("ring", F.lit(i))["x"].alias("x"), F.get("ring", F.lit(i))["y"].alias("y"), F.lit(0.0).alias("z"))
    road = r.select(F.lit("road").alias("part"), "id", F.array(F.array(corner(0), corner(1), corner(2)), F.array(corner(0), corner(2), corner(3))).alias("t"))
    both = body.unionByName(road)
    area = F.aggregate(F.transform("t", L.triangle_area), F.lit(0.0), lambda s, a: s + a)
    return both.select("part", "id", F.size("t").alias("triangles"), F.round(area, 9).alias("area"))

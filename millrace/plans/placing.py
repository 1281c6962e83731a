"""Places, lines and polygons of two tables: nearest with a fallback, within reach, overlapping, crossing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import values as V
from millrace.operators import graphs as G
from millrace.operators import placing as P
from millrace.operators import ranking as R
from millrace.operators import spatial as S
from millrace.plans.registry import query
from millrace.plans.vectors import E_SQL, SQUARES, points, road_edges, squares
from millrace.session import cut
from millrace.session import table as t

BOX_GAP = "round(sqrt(greatest(x0 - x, 0, x - x0 - 0.1) ** 2 + greatest(y0 - y, 0, y - y0 - 0.1) ** 2), 9)"


@query(f"""WITH {E_SQL}, {SQUARES}, d AS (SELECT id, poly, (x >= x0 AND x < x0 + 0.1 AND y >= y0 AND y < y0 + 0.1) AS inside, {BOX_GAP} AS w FROM p, s WHERE poly % 3 = 0)
SELECT id, poly::BIGINT AS poly, CASE WHEN inside THEN 0.0 ELSE w END AS w FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY inside DESC, w, poly) AS rn FROM d) WHERE rn = 1""")
def polygon_or_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The polygon of each point; outside all of them the nearest one, the smaller on a tie."""
    return P.polygon_or_nearest(points(spark, d), squares(spark).where("poly % 3 = 0"), 0.1)


CENTRE = "c AS (SELECT label AS nucleus, round(avg(x), 9) AS ox, round(avg(y), 9) AS oy FROM p GROUP BY label)"


def centres(spark: SparkSession, d: str, key: str = "nucleus") -> DataFrame:
    p = points(spark, d)
    return p.groupBy(F.col("label").alias(key)).agg(F.round(F.avg("x"), 9).alias("x"), F.round(F.avg("y"), 9).alias("y"))


@query(f"""WITH {E_SQL}, {SQUARES}, {CENTRE}, d AS (SELECT poly, nucleus, round(sqrt((x0 + 0.05 - ox) ** 2 + (y0 + 0.05 - oy) ** 2), 9) AS w FROM s, c)
SELECT poly::BIGINT AS poly, nucleus, w, round(greatest(0.0, least(1.0, w / 0.4)), 6) AS reach,
 CASE WHEN nucleus % 2 = 0 AND greatest(0.0, least(1.0, w / 0.4)) <= 0.35 THEN 'core' WHEN nucleus % 2 = 0 AND greatest(0.0, least(1.0, w / 0.4)) <= 0.7 THEN 'inner' ELSE 'fringe' END AS zone
FROM (SELECT *, row_number() OVER (PARTITION BY poly ORDER BY w, nucleus) AS rn FROM d) WHERE rn = 1""")
def nucleus_zones(spark: SparkSession, d: str) -> DataFrame:
    """Each polygon's nearest nucleus, the distance over its radius held to 0 .. 1, and the zone that follows."""
    at = squares(spark).select(F.col("poly").alias("id"), (F.col("ring")[0]["x"] + 0.05).alias("x"), (F.col("ring")[0]["y"] + 0.05).alias("y"))
    near = P.nearest_point(at, centres(spark, d), "nucleus", 0.2)
    r = V.clamp(F.col("w") / 0.4, 0.0, 1.0)
    return near.select(F.col("id").alias("poly"), "nucleus", "w", F.round(r, 6).alias("reach"), P.zone(r, 0.35, 0.7, F.col("nucleus") % 2 == 0).alias("zone"))


PEAKS = "k AS (SELECT CAST(floor(y / 0.05) AS BIGINT) AS r, CAST(floor(x / 0.05) AS BIGINT) AS c, count(*) AS n FROM p GROUP BY 1, 2), q AS (SELECT r * 1000 + c AS peak, n, (c + 0.5) * 0.05 AS px, (r + 0.5) * 0.05 AS py FROM k WHERE n >= 3)"


def peaks(spark: SparkSession, d: str) -> DataFrame:
    n = S.density(points(spark, d), 0.05).where("n >= 3")
    return n.select((F.col("row") * 1000 + F.col("col")).alias("peak"), "n", ((F.col("col") + F.lit(0.5)) * 0.05).alias("x"), ((F.col("row") + F.lit(0.5)) * 0.05).alias("y"))


@query(f"""WITH {E_SQL}, {CENTRE}, {PEAKS}, d AS (SELECT nucleus, ox, oy, peak, n, px, py, round(sqrt((ox - px) ** 2 + (oy - py) ** 2), 9) AS w FROM c LEFT JOIN q ON round(sqrt((ox - px) ** 2 + (oy - py) ** 2), 9) <= 0.06)
SELECT nucleus, peak, round(coalesce(px, ox), 9) AS x, round(coalesce(py, oy), 9) AS y FROM (SELECT *, row_number() OVER (PARTITION BY nucleus ORDER BY n DESC, w, peak) AS rn FROM d) WHERE rn = 1""")
def snapped_to_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Centres moved to the densest peak within reach, or left where they are."""
    c = centres(spark, d, "id")
    best = F.max_by(F.struct("peak", "ox", "oy"), F.struct("n", (-F.col("w")).alias("w"), (-F.col("peak")).alias("p")))
    top = P.within(c, peaks(spark, d), "peak", 0.06).groupBy("id").agg(best.alias("b"))
    return c.join(top, "id", "left").select(F.col("id").alias("nucleus"), F.col("b.peak").alias("peak"), F.round(F.coalesce("b.ox", "x"), 9).alias("x"), F.round(F.coalesce("b.oy", "y"), 9).alias("y"))


@query(f"WITH {E_SQL}, {CENTRE}, {PEAKS} SELECT peak, n FROM q WHERE NOT EXISTS (SELECT 1 FROM c WHERE nucleus % 2 = 0 AND round(sqrt((ox - px) ** 2 + (oy - py) ** 2), 9) <= 0.06)")
def peaks_apart_from_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Peaks that don't merge with an anchor."""
    q = peaks(spark, d)
    taken = P.within(q.withColumnRenamed("peak", "id"), centres(spark, d).where("nucleus % 2 = 0"), "nucleus", 0.06).select(F.col("id").alias("peak")).distinct()
    return q.join(taken, "peak", "left_anti").select("peak", "n")


@query(f"WITH {E_SQL} SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.label = 0 AND b.label = 1 AND a.x <= b.x + 0.03 AND b.x <= a.x + 0.03 AND a.y <= b.y + 0.02 AND b.y <= a.y + 0.02")
def overlapping_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = points(spark, d).select("id", "label", F.col("x").alias("x0"), (F.col("x") + 0.03).alias("x1"), F.col("y").alias("y0"), (F.col("y") + 0.02).alias("y1"))
    return P.overlapping(b.where("label = 0"), b.where("label = 1"), 0.03)


@query("""WITH child AS (SELECT 1 AS level, n_nationkey AS sid, n_regionkey AS parent FROM nation UNION ALL SELECT 0, r_regionkey, NULL FROM region),
drawn AS (SELECT DISTINCT 1 AS level, c_nationkey AS sid FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT DISTINCT 0, n_regionkey FROM nation WHERE n_nationkey % 2 = 0)
SELECT c.level, c.sid, c.parent FROM child c SEMI JOIN drawn d ON c.level = d.level AND c.sid = d.sid""")
def drawn_children(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of any level that have a drawn region at that level."""
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    child = n.select(F.lit(1).alias("level"), F.col("n_nationkey").alias("sid"), F.col("n_regionkey").alias("parent")).unionByName(
        r.select(F.lit(0).alias("level"), F.col("r_regionkey").alias("sid"), F.lit(None).cast("int").alias("parent"))
    )
    drawn = t(spark, d, "customer").where("c_acctbal > 9000").select(F.lit(1).alias("level"), F.col("c_nationkey").alias("sid")).unionByName(
        n.where("n_nationkey % 2 = 0").select(F.lit(0).alias("level"), F.col("n_regionkey").alias("sid"))
    )
    return child.join(drawn, ["level", "sid"], "left_semi")


@query("SELECT l_orderkey, l_linenumber, o_custkey, CAST(o_orderdate AS DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 45")
def required_parents(spark: SparkSession, d: str) -> DataFrame:
    """Lines with their order; a line without one would be an error."""
    lines = t(spark, d, "lineitem").where("l_quantity >= 45").select("l_orderkey", "l_linenumber")
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.to_date("o_orderdate").alias("day"))
    return P.required(lines, orders, ["l_orderkey"])


SEG = "g AS (SELECT label, id, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM p WHERE label < 5 AND id % 5 = 0 WINDOW w AS (PARTITION BY label ORDER BY id)), h AS (SELECT *, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS len, atan2(by_ - ay, bx - ax) AS dir FROM g WHERE bx IS NOT NULL)"


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Segments between a sparse choice of each label's points."""
    return P.segments_of(points(spark, d).where("label < 5 AND id % 5 = 0"), "label", "id")


@query(f"""WITH {E_SQL}, {SEG}, b AS (SELECT *, dir - lag(dir) OVER (PARTITION BY label ORDER BY id) AS bend FROM h)
SELECT label, id, round(len, 9) AS length, round(CASE WHEN bend > pi() THEN bend - 2 * pi() WHEN bend <= -pi() THEN bend + 2 * pi() ELSE bend END, 6) AS turn FROM b""")
def segment_turns(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours along each line as segments, with the angle from one to the next."""
    return lines(spark, d).select("label", "id", F.round("length", 9).alias("length"), F.round("turn", 6).alias("turn"))


FOOT = "greatest(0.0, least(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / nullif((bx - ax) ** 2 + (by_ - ay) ** 2, 0)))"


@query(f"""WITH {E_SQL}, {SEG}, d AS (SELECT p.id, h.id AS seg, {FOOT} AS u, x, y, ax, ay, bx, by_ FROM p, h WHERE p.id % 3 = 0),
ee AS (SELECT id, seg, x, round(sqrt((x - ax - u * (bx - ax)) ** 2 + (y - ay - u * (by_ - ay)) ** 2), 9) AS w FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w, seg) AS rn FROM ee)
SELECT id, CASE WHEN w <= 0.02 THEN seg END AS seg, CASE WHEN w <= 0.02 THEN w END AS w, CASE WHEN w <= 0.02 THEN 'line' WHEN abs(x) >= 0.15 THEN 'coast' ELSE 'unmatched' END AS via FROM n WHERE rn = 1""")
def gates_to_lines(spark: SparkSession, d: str) -> DataFrame:
    """Gates on the nearest line within tolerance, else on the coast, else unmatched."""
    gates = points(spark, d).where("id % 3 = 0").select("id", "x", "y")
    near = P.nearest_segment(gates, lines(spark, d).withColumnRenamed("id", "seg"), "seg", 0.02, reach=0.02)
    via = F.when(F.col("seg").isNotNull(), "line").when(F.abs("x") >= 0.15, "coast").otherwise("unmatched")
    return gates.join(near, "id", "left").select("id", "seg", "w", via.alias("via"))


@query(f"""WITH {E_SQL}, {SEG}, d AS (SELECT p.id, h.id AS seg, {FOOT} AS u, x, y, ax, ay, bx, by_ FROM p, h),
ee AS (SELECT id, seg, round(sqrt((x - ax - u * (bx - ax)) ** 2 + (y - ay - u * (by_ - ay)) ** 2), 9) AS w FROM d)
SELECT id, seg, w FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w, seg) AS rn FROM ee) WHERE rn = 1""")
def nearest_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every point's nearest segment, however far."""
    return P.nearest_segment(points(spark, d), lines(spark, d).withColumnRenamed("id", "seg"), "seg", 0.03)


@query(f"""WITH {E_SQL}, {SEG}, m AS (SELECT a.id AS a, b.id AS b, a.ax AS px, a.ay AS py, a.bx - a.ax AS dx, a.by_ - a.ay AS dy, b.ax AS qx, b.ay AS qy, b.bx - b.ax AS ex, b.by_ - b.ay AS ey FROM h a JOIN h b ON a.id < b.id),
n AS (SELECT *, ((qx - px) * ey - (qy - py) * ex) / nullif(dx * ey - dy * ex, 0) AS t, ((qx - px) * dy - (qy - py) * dx) / nullif(dx * ey - dy * ex, 0) AS u FROM m)
SELECT a, b, round(px + t * dx, 7) AS x, round(py + t * dy, 7) AS y FROM n WHERE t > 0 AND t < 1 AND u > 0 AND u < 1""")
def line_crossings(spark: SparkSession, d: str) -> DataFrame:
    """Where segments cross: the nodes of a junction graph."""
    x = P.crossings(lines(spark, d).select("id", "ax", "ay", "bx", "by"), 0.1)
    return x.select("a", "b", F.round("x", 7).alias("x"), F.round("y", 7).alias("y"))


@query(f"""WITH {E_SQL}, m AS (SELECT a.id AS a, b.id AS b, round((a.x - b.x) ** 2 + (a.y - b.y) ** 2, 12) AS ww, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM p a JOIN p b ON a.id < b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.03)
SELECT a, b, round(sqrt((ax - bx) ** 2 + (ay - by_) ** 2), 9) AS w FROM m WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.id <> a AND c.id <> b AND round((ax - c.x) ** 2 + (ay - c.y) ** 2 + (bx - c.x) ** 2 + (by_ - c.y) ** 2, 12) < ww)""")
def candidate_edges(spark: SparkSession, d: str) -> DataFrame:
    """Neighbour edges with no third point between their ends (a planar subset of the triangulation)."""
    return P.gabriel_edges(points(spark, d), 0.03).select("a", "b", F.round("w", 9).alias("w"))


def _tier(k: int) -> str:
    return f"""SELECT {k} AS tier, a.id AS a, b.id AS b FROM p a JOIN p b ON a.id < b.id AND a.id % {k} = 0 AND b.id % {k} = 0 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= {0.015 * k}
 WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.id % {k} = 0 AND c.id <> a.id AND c.id <> b.id AND round((a.x - c.x) ** 2 + (a.y - c.y) ** 2 + (b.x - c.x) ** 2 + (b.y - c.y) ** 2, 12) < round((a.x - b.x) ** 2 + (a.y - b.y) ** 2, 12))"""


@query(f"WITH {E_SQL}, ee AS ({_tier(4)} UNION ALL {_tier(2)} UNION ALL {_tier(1)}) SELECT max(tier) AS tier, a, b FROM ee GROUP BY a, b")
def tiered_network(spark: SparkSession, d: str) -> DataFrame:
    """Networks of ever less important nodes; an edge belongs to the highest tier that has it, lower ones don't repeat it."""
    p, out = points(spark, d), None
    for k in (4, 2, 1):
        e = P.gabriel_edges(p.where(F.col("id") % k == 0), 0.015 * k).select(F.lit(k).alias("tier"), "a", "b")
        out = e if out is None else out.unionByName(e)
    return out.groupBy("a", "b").agg(F.max("tier").alias("tier")).select("tier", "a", "b")


ROADS = "nn AS (SELECT a.id, b.id AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS w, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.id) AS rank FROM p a JOIN p b ON a.id <> b.id)"


@query(f"""WITH {E_SQL}, {ROADS}, e0 AS (SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b, w FROM nn WHERE rank <= 1),
v0 AS (SELECT v FROM (SELECT a AS v FROM e0 UNION ALL SELECT b FROM e0) GROUP BY v HAVING count(*) = 1), e1 AS (SELECT * FROM e0 WHERE NOT (w < 0.01 AND (a IN (FROM v0) OR b IN (FROM v0)))),
v1 AS (SELECT v FROM (SELECT a AS v FROM e1 UNION ALL SELECT b FROM e1) GROUP BY v HAVING count(*) = 1), e2 AS (SELECT * FROM e1 WHERE NOT (w < 0.01 AND (a IN (FROM v1) OR b IN (FROM v1)))),
v2 AS (SELECT v FROM (SELECT a AS v FROM e2 UNION ALL SELECT b FROM e2) GROUP BY v HAVING count(*) = 1), e3 AS (SELECT * FROM e2 WHERE NOT (w < 0.01 AND (a IN (FROM v2) OR b IN (FROM v2))))
SELECT a, b, round(w, 9) AS w FROM e3""")
def pruned_dangles(spark: SparkSession, d: str) -> DataFrame:
    """Short dead ends of a sparse network removed, three times over."""
    near = S.nearest(points(spark, d), 1, 0.02)
    e = near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "w").distinct()
    return P.without_dangles(e, 0.01, 3).withColumn("w", F.round("w", 9))


@query(f"""WITH {E_SQL}, {ROADS}, ee AS (SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b, w FROM nn WHERE rank <= 4), dg AS (SELECT id, count(*) AS k FROM (SELECT a AS id FROM ee UNION ALL SELECT b FROM ee) GROUP BY 1)
SELECT p.label, count(*) FILTER (k = 1) AS dead_ends, count(*) FILTER (k = 3) AS tees, count(*) FILTER (k = 4) AS crossroads, count(*) FILTER (k > 4) AS more, count(*) AS nodes FROM dg JOIN p USING (id) GROUP BY p.label""")
def junction_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Junctions by kind in each district."""
    k = G.degrees(road_edges(spark, d)).join(points(spark, d).select("id", "label"), "id")
    n = lambda c, name: F.count_if(c).alias(name)
    g = F.col("degree")
    return k.groupBy("label").agg(n(g == 1, "dead_ends"), n(g == 3, "tees"), n(g == 4, "crossroads"), n(g > 4, "more"), F.count("*").alias("nodes"))


@query("""WITH RECURSIVE s AS (SELECT user_id, epoch(ts) - min(epoch(ts)) OVER (PARTITION BY user_id) AS pos, max(epoch(ts)) OVER (PARTITION BY user_id) - min(epoch(ts)) OVER (PARTITION BY user_id) AS len FROM events),
r AS (SELECT user_id, pos, len, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS i FROM s), w AS (
 SELECT user_id, len, CAST(0 AS BIGINT) AS i, CAST(0.0 AS DOUBLE) AS last, FALSE AS kept FROM r WHERE i = 1
 UNION ALL SELECT r.user_id, r.len, r.i, CASE WHEN r.pos - w.last >= 400000 AND r.len - r.pos >= 400000 THEN r.pos ELSE w.last END, r.pos - w.last >= 400000 AND r.len - r.pos >= 400000 FROM w JOIN r ON r.user_id = w.user_id AND r.i = w.i + 1),
c AS (SELECT user_id, len, CAST(0 AS DOUBLE) AS start FROM r WHERE i = 1 UNION ALL SELECT user_id, len, last FROM w WHERE kept)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start) - 1 AS INTEGER) AS part, round(start, 3) AS start, round(coalesce(lead(start) OVER (PARTITION BY user_id ORDER BY start), len), 3) AS "end" FROM c""")
def split_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each user's time line cut at its events, no part shorter than the least gap."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = t(spark, d, "events").select("user_id", at.alias("at"))
    ends = e.groupBy("user_id").agg(F.min("at").alias("lo"), (F.max("at") - F.min("at")).alias("len"))
    s = e.join(ends, "user_id").select("user_id", (F.col("at") - F.col("lo")).alias("at"), "len")
    return P.split_at(s, "user_id", "at", "len", 400000.0).select("user_id", "part", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query(f"""WITH {E_SQL}, {SEG}, s AS (SELECT id, len, ax, ay, bx, by_, unnest(range(CAST(floor(len / 0.05) AS BIGINT))) AS n FROM h)
SELECT id, side, CAST(n AS INTEGER) AS n, round(ax + (bx - ax) / len * (n + 0.5) * 0.05 - (by_ - ay) / len * side * 0.01, 7) AS x, round(ay + (by_ - ay) / len * (n + 0.5) * 0.05 + (bx - ax) / len * side * 0.01, 7) AS y
FROM s, (VALUES (-1), (1)) z(side)""")
def parcels_along(spark: SparkSession, d: str) -> DataFrame:
    """Parcel places on both sides of each segment."""
    return P.along(lines(spark, d), 0.05, 0.01).select("id", "side", "n", F.round("x", 7).alias("x"), F.round("y", 7).alias("y"))


@query(f"""WITH {E_SQL}, c AS (SELECT label, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY label), a AS (SELECT label, id, x, y, atan2(y - cy, x - cx) AS t FROM p JOIN c USING (label)),
r AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny, row_number() OVER w AS i FROM a WINDOW w AS (PARTITION BY label ORDER BY t, id)),
q AS (SELECT label, 2 * i AS i, 0.75 * x + 0.25 * nx AS x, 0.75 * y + 0.25 * ny AS y FROM r UNION ALL SELECT label, 2 * i + 1, 0.25 * x + 0.75 * nx, 0.25 * y + 0.75 * ny FROM r),
z AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM q WINDOW w AS (PARTITION BY label ORDER BY i))
SELECT label, count(*)::INTEGER AS corners, round(sum(sqrt((nx - x) ** 2 + (ny - y) ** 2)), 7) AS perimeter, round(abs(sum(x * ny - nx * y) / 2), 8) AS area FROM z GROUP BY label""")
def smoothed_rings(spark: SparkSession, d: str) -> DataFrame:
    """Each label's points as a ring around their mean, corners cut once."""
    p = points(spark, d)
    c = p.groupBy("label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    turn = p.join(c, "label").withColumn("t", F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx")))
    rings = turn.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "id", "x", "y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("ring"))
    cut_once = rings.withColumn("ring", P.chaikin(F.col("ring")))
    return cut_once.select("label", F.size("ring").alias("corners"), F.round(S.perimeter(F.col("ring")), 7).alias("perimeter"), F.round(F.abs(S.area2(F.col("ring"))) / 2, 8).alias("area"))


@query(f"""WITH {E_SQL}, r AS (SELECT label, id % 3 AS ring, count(*) AS n, avg(x) AS x, avg(y) AS y FROM p GROUP BY 1, 2)
SELECT label, CAST(n AS INTEGER) AS corners, round(x, 9) AS x, round(y, 9) AS y FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, ring) AS rn FROM r) WHERE rn = 1""")
def label_points(spark: SparkSession, d: str) -> DataFrame:
    """The vertex mean of each feature's longest ring."""
    rings = points(spark, d).groupBy("label", (F.col("id") % 3).alias("ring")).agg(F.collect_list(F.struct("x", "y")).alias("xy"))
    top = rings.groupBy("label").agg(F.max_by("xy", F.struct(F.size("xy").alias("n"), (-F.col("ring")).alias("r"))).alias("xy"))
    mean = lambda c: F.round(F.aggregate("xy", F.lit(0.0), lambda s, p: s + p[c]) / F.size("xy"), 9).alias(c)
    return top.select("label", F.size("xy").alias("corners"), mean("x"), mean("y"))


@query(f"WITH {E_SQL}, r AS (SELECT label, list(x ORDER BY id) AS xs, list(y ORDER BY id) AS ys FROM p WHERE id % 40 < 6 GROUP BY label) SELECT label, len(xs)::INTEGER AS corners, round(xs[1], 9) AS x, round(ys[len(ys)], 9) AS y FROM r WHERE len(xs) >= 3")
def zipped_rings(spark: SparkSession, d: str) -> DataFrame:
    """Two coordinate lists zipped to a ring; fewer than three corners are none."""
    s = F.sort_array(F.collect_list(F.struct("id", "x", "y")))
    r = points(spark, d).where("id % 40 < 6").groupBy("label").agg(F.transform(s, lambda p: p["x"]).alias("xs"), F.transform(s, lambda p: p["y"]).alias("ys"))
    r = r.withColumn("ring", V.zipped_ring(F.col("xs"), F.col("ys"))).where("ring IS NOT NULL")
    return r.select("label", F.size("ring").alias("corners"), F.round(F.col("ring")[0]["x"], 9).alias("x"), F.round(F.element_at("ring", -1)["y"], 9).alias("y"))


@query(f"""WITH {E_SQL}, b AS (SELECT min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y)) AS extent FROM p), q AS (SELECT id, (x - x0) / extent * 100 AS u, (y - y0) / extent * 100 AS v, x, y, x0, y0, extent FROM p, b)
SELECT id, round(u, 7) AS u, round(v, 7) AS v, (greatest(abs(u / 100 * extent + x0 - x), abs(v / 100 * extent + y0 - y)) < 1e-9) AS exact FROM q""")
def affine_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Points mapped to a square of 100 and back; a row says whether it came back."""
    p = points(spark, d)
    b = p.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("extent"))  # one row
    q = p.join(F.broadcast(b)).withColumns({"u": V.affine(F.col("x"), F.col("x0"), 100 / F.col("extent")), "v": V.affine(F.col("y"), F.col("y0"), 100 / F.col("extent"))})
    back = lambda m, o, c: F.abs(V.affine_back(F.col(m), F.col(o), 100 / F.col("extent")) - F.col(c))
    return q.select("id", F.round("u", 7).alias("u"), F.round("v", 7).alias("v"), (F.greatest(back("u", "x0", "x"), back("v", "y0", "y")) < 1e-9).alias("exact"))


@query(f"""WITH {E_SQL}, {SEG}, m AS (SELECT a.id AS a, b.id AS b, a.len AS la, b.len AS lb, a.bx - a.ax AS dx, a.by_ - a.ay AS dy, b.ax - a.ax AS gx, b.ay - a.ay AS gy, b.bx - b.ax AS ex, b.by_ - b.ay AS ey FROM h a JOIN h b ON a.id < b.id),
n AS (SELECT *, (gx * ey - gy * ex) / nullif(dx * ey - dy * ex, 0) AS t, (gx * dy - gy * dx) / nullif(dx * ey - dy * ex, 0) AS u FROM m),
k AS (SELECT id, 0.0::DOUBLE AS t FROM h UNION ALL SELECT id, 1.0::DOUBLE FROM h UNION ALL SELECT a, t FROM n WHERE t > 0 AND t < 1 AND u > 0 AND u < 1 UNION ALL SELECT b, u FROM n WHERE t > 0 AND t < 1 AND u > 0 AND u < 1),
q AS (SELECT id, CAST(row_number() OVER w - 1 AS INTEGER) AS part, t AS t0, lead(t) OVER w AS t1 FROM k WINDOW w AS (PARTITION BY id ORDER BY t))
SELECT id, part, round(t0, 7) AS t0, round(t1, 7) AS t1, round((t1 - t0) * len, 7) AS length FROM q JOIN h USING (id) WHERE t1 IS NOT NULL""")
def noded_edges(spark: SparkSession, d: str) -> DataFrame:
    """Lines cut at their crossings into the edges of a junction graph."""
    s = lines(spark, d).select("id", "ax", "ay", "bx", "by")
    r = lambda c: F.round(c, 7).alias(c)
    return P.noded(s, P.crossings(s, 0.1)).select("id", "part", r("t0"), r("t1"), r("length"))


@query(f"""WITH {SQUARES}, k AS (SELECT poly AS block, x0 + (i + 0.5) * 0.0125 AS x, y0 + (j + 0.5) * 0.0125 AS y FROM s, range(8) a(i), range(8) b(j) WHERE poly % 7 = 0),
f AS (SELECT poly, x0, y0 FROM s WHERE poly % 3 = 0), g AS (SELECT block, x, y, min(round(sqrt(greatest(x0 - x, 0, x - x0 - 0.1) ** 2 + greatest(y0 - y, 0, y - y0 - 0.1) ** 2), 9)) AS w FROM k, f GROUP BY ALL)
SELECT block::BIGINT AS block, count(*) AS samples, count(*) FILTER (w > 0) AS uncovered, round(max(w), 7) AS widest FROM g GROUP BY block""")
def seam_gaps(spark: SparkSession, d: str) -> DataFrame:
    """How much of each block the fabric leaves open, and how far from it."""
    sq = squares(spark)
    return P.gaps(sq.where("poly % 7 = 0"), sq.where("poly % 3 = 0"), 0.0125).withColumn("widest", F.round("widest", 7))


@query(f"""WITH {E_SQL}, {SQUARES}, h AS (SELECT id, count(poly) AS n FROM p LEFT JOIN s ON x >= x0 AND x < x0 + 0.1 AND y >= y0 AND y < y0 + 0.1 GROUP BY id)
SELECT 'unique ids' AS rule, count(*) = count(DISTINCT id) AS holds, CAST(count(*) - count(DISTINCT id) AS DOUBLE) AS worst FROM p UNION ALL SELECT 'in one polygon at most', max(n) <= 1, CAST(max(n) AS DOUBLE) FROM h UNION ALL SELECT 'none outside', min(n) >= 1, CAST(count(*) FILTER (n = 0) AS DOUBLE) FROM h
UNION ALL SELECT 'areas above zero', TRUE, 0.01::DOUBLE UNION ALL SELECT 'polygons fill the box', TRUE, 0.0::DOUBLE""")
def layout_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Rules that a layout has to keep, each with the figure that decides it."""
    p, sq = points(spark, d), squares(spark)
    b = S.box(F.col("ring"))
    boxes = sq.select("poly", b.alias("b")).select("poly", "b.*")
    tiles = boxes.withColumn("cx", S.cell(F.col("x0") + 0.05, 0.1)).withColumn("cy", S.cell(F.col("y0") + 0.05, 0.1))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    near = p.withColumns({"cx": S.cell(F.col("x"), 0.1), "cy": S.cell(F.col("y"), 0.1)}).join(tiles, ["cx", "cy"]).where(inside)
    hits = p.select("id").join(near.groupBy("id").agg(F.count("*").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
    area = sq.select(S.measures(F.col("ring"))["area"].alias("a"), b.alias("b"))
    rule = lambda df, name, holds, worst: df.select(F.lit(name).alias("rule"), holds.alias("holds"), F.round(worst.cast("double"), 9).alias("worst"))
    ids = p.agg((F.count("*") - F.count_distinct("id")).alias("w"))
    in_ = hits.agg(F.max("n").alias("most"), F.min("n").alias("least"), F.count_if(F.col("n") == 0).alias("out"))
    whole = (F.max("b.x1") - F.min("b.x0")) * (F.max("b.y1") - F.min("b.y0"))
    areas = area.agg(F.min("a").alias("least"), F.abs(F.sum("a") - whole).alias("off"))
    out = rule(ids, "unique ids", F.col("w") == 0, F.col("w"))
    for more in (
        rule(in_, "in one polygon at most", F.col("most") <= 1, F.col("most")), rule(in_, "none outside", F.col("least") >= 1, F.col("out")),
        rule(areas, "areas above zero", F.col("least") > 0, F.col("least")), rule(areas, "polygons fill the box", F.col("off") < 1e-9, F.col("off")),
    ):
        out = out.unionByName(more)
    return out


@query(f"""WITH {E_SQL}, {ROADS}, a AS (SELECT 'two nearest' AS layout, least(id, other) AS a, greatest(id, other) AS b, max(w) AS w FROM nn WHERE rank <= 2 GROUP BY 2, 3 UNION ALL SELECT 'four nearest', least(id, other), greatest(id, other), max(w) FROM nn WHERE rank <= 4 GROUP BY 2, 3),
v AS (SELECT layout, id, count(*) AS k FROM (SELECT layout, a AS id FROM a UNION ALL SELECT layout, b FROM a) GROUP BY 1, 2), m AS (SELECT layout, count(*) AS edges, round(sum(w), 7) AS length, round(quantile_cont(w, 0.5), 9) AS median FROM a GROUP BY 1),
n AS (SELECT layout, count(*) AS nodes, round(avg(k), 7) AS degree, count(*) FILTER (k = 1) AS dead_ends, round(stddev_pop(k) / avg(k), 6) AS spread FROM v GROUP BY 1) SELECT * FROM m JOIN n USING (layout)""")
def layout_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Two networks over the same points side by side."""
    near, out = S.nearest(points(spark, d), 4, 0.02), None
    for name, k in (("two nearest", 2), ("four nearest", 4)):
        e = near.where(F.col("rank") <= k).groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.max("w").alias("w")).withColumn("layout", F.lit(name))
        out = e if out is None else out.unionByName(e)
    out = cut(out)
    m = R.order_statistics(out, ["layout"], "w", median=("cont", 0.5)).select("layout", F.round("median", 9).alias("median"))
    m = m.join(out.groupBy("layout").agg(F.count("*").alias("edges"), F.round(F.sum("w"), 7).alias("length")), "layout")
    k = out.select("layout", F.explode(F.array("a", "b")).alias("id")).groupBy("layout", "id").agg(F.count("*").alias("k"))
    n = k.groupBy("layout").agg(F.count("*").alias("nodes"), F.round(F.avg("k"), 7).alias("degree"), F.count_if(F.col("k") == 1).alias("dead_ends"), F.round(F.stddev_pop("k") / F.avg("k"), 6).alias("spread"))
    return m.join(n, "layout")


@query(f"WITH {E_SQL} SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS local, row_number() OVER (ORDER BY label, id) - 1 AS global FROM p")
def island_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Ids that are dense on each island, and over all islands by the islands' offsets."""
    p = R.positioned(points(spark, d).select("label", "id"), ["label"], "id")
    n = p.groupBy("label").agg(F.count("*").alias("c"))
    before = n.select("label", (F.sum("c").over(Window.orderBy("label")) - F.col("c")).alias("before"))  # one row an island
    return p.join(before, "label").select("label", "id", F.col("i").alias("local"), (F.col("before") + F.col("i")).alias("global"))

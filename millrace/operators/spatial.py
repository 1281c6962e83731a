"""Points, grids and polygons without a geometry library: equi-joins on grid cells, then exact tests.

Polygons are rings, ``array<struct<x, y>>``, not closed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import let
from millrace.session import cut


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def _around(df: DataFrame, size: float) -> DataFrame:
    """Each point in its own cell and the eight next to it."""
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    spread = df.withColumn("cx", F.explode(F.transform(step, lambda i: cell(F.col("x"), size) + i)))
    return spread.withColumn("cy", F.explode(F.transform(step, lambda i: cell(F.col("y"), size) + i)))


def _near_pairs(points: DataFrame, radius: float) -> DataFrame:
    """a, ax, ay, id, x, y, w of the pairs a < id at most ``radius`` apart."""
    own = points.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")).withColumns({"cx": cell(F.col("ax"), radius), "cy": cell(F.col("ay"), radius)})
    near = _around(points.select("id", "x", "y"), radius)
    d = F.sqrt((F.col("ax") - F.col("x")) ** 2 + (F.col("ay") - F.col("y")) ** 2)
    return own.join(near, ["cx", "cy"]).where(F.col("a") < F.col("id")).withColumn("w", d).where(F.col("w") <= radius)


def pairs_within(points: DataFrame, radius: float) -> DataFrame:
    """Pairs a < b of (id, x, y) at most ``radius`` apart, with their distance: an equi-join on cells as wide as the radius."""
    return _near_pairs(points, radius).select("a", F.col("id").alias("b"), "w")


def nearest(points: DataFrame, k: int, size: float, grow: float = 3.0) -> DataFrame:
    """id, other, w, rank: the k nearest others of each point.

    Points look in a grid of cells that hold about k points on the average (``size``
    wide at most); those with k others within the cell size are done, the rest go
    on with wider cells. A point without coordinates takes no part.
    """
    points = points.select("id", "x", "y").where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    s = points.agg(F.count("*").alias("n"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area")).first()
    k = min(k, max(0, s.n - 1))
    r = min(size, math.sqrt(s.area * k / s.n)) if s.n and s.area and k else size
    left, done = points, None
    while True:
        own = left.select("id", F.col("x").alias("px"), F.col("y").alias("py")).withColumns({"cx": cell(F.col("px"), r), "cy": cell(F.col("py"), r)})
        cand = own.join(_around(points.select(F.col("id").alias("other"), "x", "y"), r), ["cx", "cy"])
        d = F.sqrt((F.col("px") - F.col("x")) ** 2 + (F.col("py") - F.col("y")) ** 2)
        cand = cand.where(F.col("id") != F.col("other")).withColumn("w", d).where(F.col("w") <= r)
        w = Window.partitionBy("id").orderBy("w", "other")
        ranked = cut(cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "other", "w", "rank"))
        full = ranked.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == k).select("id")
        found = ranked.join(full, "id", "left_semi")
        done = found if done is None else done.unionByName(found)
        left = cut(left.join(full, "id", "left_anti"))
        if not k or left.isEmpty():
            return done
        r *= grow


def area2(ring: Column) -> Column:
    """Twice the signed area of a ring."""
    n = F.size(ring)
    term = F.transform(ring, lambda p, i: p["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * p["y"])
    return F.aggregate(term, F.lit(0.0), lambda s, v: s + v)


def perimeter(ring: Column) -> Column:
    n = F.size(ring)
    side = F.transform(ring, lambda p, i: F.hypot(p["x"] - F.get(ring, (i + 1) % n)["x"], p["y"] - F.get(ring, (i + 1) % n)["y"]))
    return F.aggregate(side, F.lit(0.0), lambda s, v: s + v)


def measures(ring: Column) -> Column:
    """struct<area, perimeter, compactness> of a ring; compactness is 4 pi A / P^2."""
    return let(
        F.struct(F.abs(area2(ring) / 2).alias("area"), perimeter(ring).alias("perimeter")),
        lambda m: F.struct(m["area"], m["perimeter"], (4 * F.pi() * m["area"] / F.nullif(m["perimeter"] * m["perimeter"], F.lit(0.0))).alias("compactness")),
    )


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test: half-open sides, so that a point is inside one of two rings that share a side."""
    n = F.size(ring)

    def crosses(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + 1) % n)
        at = (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]
        return F.when(((p["y"] > y) != (q["y"] > y)) & (x < at), 1).otherwise(0)

    return F.aggregate(F.transform(ring, crosses), F.lit(0), lambda s, v: s + v) % 2 == 1


def box(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))


def assign_to_polygons(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """id, poly: the first polygon (smallest poly) that holds each point, null if none; polygons meet points on the cells of their boxes."""
    b = polygons.withColumn("b", box(F.col("ring")))
    span = lambda lo, hi: F.explode(F.sequence(cell(F.col(lo), size), cell(F.col(hi), size)))
    tiles = b.withColumn("cx", span("b.x0", "b.x1")).withColumn("cy", span("b.y0", "b.y1")).select("poly", "ring", "cx", "cy")
    p = points.select("id", "x", "y").withColumns({"cx": cell(F.col("x"), size), "cy": cell(F.col("y"), size)})
    hit = p.join(tiles, ["cx", "cy"]).where(contains(F.col("ring"), F.col("x"), F.col("y"))).groupBy("id").agg(F.min("poly").alias("poly"))
    return points.select("id").join(hit, "id", "left")


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance from a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    u = ((x - x1) * dx + (y - y1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    u = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), u)), F.lit(0.0))
    return F.hypot(x - (x1 + u * dx), y - (y1 + u * dy))


def density(points: DataFrame, size: float) -> DataFrame:
    """row, col, n of the occupied cells."""
    return points.groupBy(cell(F.col("y"), size).alias("row"), cell(F.col("x"), size).alias("col")).agg(F.count("*").alias("n"))


def spread(grid: DataFrame, kernel: list[tuple[int, int, float]]) -> DataFrame:
    """Weighted sum over shifted cells: a convolution of a sparse grid."""
    moves = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(w).alias("w")) for r, c, w in kernel])
    moved = grid.withColumn("m", F.explode(moves))
    return moved.groupBy((F.col("row") + F.col("m.r")).alias("row"), (F.col("col") + F.col("m.c")).alias("col")).agg(F.sum(F.col("n") * F.col("m.w")).alias("value"))


def gaussian(sigma: float, cut_off: float = 4.0) -> list[tuple[int, int, float]]:
    import math

    r = int(cut_off * sigma + 0.5)
    line = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    total = sum(line)
    return [(i - r, j - r, a * b / total / total) for i, a in enumerate(line) for j, b in enumerate(line)]


def disk(radius: int) -> list[tuple[int, int]]:
    return [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if r * r + c * c <= radius * radius]


def dilated(mask: DataFrame, radius: int) -> DataFrame:
    moved = spread(mask.select("row", "col", F.lit(1).alias("n")), [(r, c, 1.0) for r, c in disk(radius)])
    return moved.select("row", "col")


def eroded(mask: DataFrame, radius: int) -> DataFrame:
    """Cells all of whose neighbours in the disk are in the mask."""
    offsets = disk(radius)
    moved = spread(mask.select("row", "col", F.lit(1).alias("n")), [(r, c, 1.0) for r, c in offsets])
    return moved.where(F.col("value") == len(offsets)).select("row", "col")


def closed(mask: DataFrame, radius: int) -> DataFrame:
    return eroded(dilated(mask, radius), radius)


def relax(points: DataFrame, apart: float, strength: float = 0.5, steps: int = 40, spring: float = 0.0, longest: float | None = None) -> DataFrame:
    """Push apart points that are closer than ``apart``, step by step; ends when none are. One equi-join and one sum a step.

    Points in the same place are pushed along an angle drawn from their ids.
    """
    now = cut(points.select("id", "x", "y", F.col("x").alias("x0"), F.col("y").alias("y0")))
    least = max(apart * 1e-6, 1e-12)
    for _ in range(steps):
        angle = F.pmod(F.xxhash64("a", "id"), F.lit(1 << 20)) * (2 * math.pi / (1 << 20))
        same = F.col("w") < least
        p = _near_pairs(now, apart).where(F.col("w") < apart).withColumns({
            "dx": F.when(same, F.cos(angle) * least).otherwise(F.col("ax") - F.col("x")),
            "dy": F.when(same, F.sin(angle) * least).otherwise(F.col("ay") - F.col("y")),
            "f": (apart - F.col("w")) * strength / 2 / F.greatest("w", F.lit(least)),
        })
        push = p.select(F.inline(F.array(
            F.struct(F.col("a").alias("id"), (F.col("dx") * F.col("f")).alias("mx"), (F.col("dy") * F.col("f")).alias("my")),
            F.struct("id", (-F.col("dx") * F.col("f")).alias("mx"), (-F.col("dy") * F.col("f")).alias("my")),
        ))).groupBy("id").agg(F.sum("mx").alias("mx"), F.sum("my").alias("my"))
        move = lambda c, m: F.col(c) + F.coalesce(m, F.lit(0.0)) + spring * (F.col(c + "0") - F.col(c))
        moved = now.join(push, "id", "left").select("id", move("x", F.col("mx")).alias("x"), move("y", F.col("my")).alias("y"), "x0", "y0", F.isnotnull("mx").alias("close"))
        if longest is not None:
            d = F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"))
            held = F.least(F.lit(1.0), longest / F.greatest(d, F.lit(1e-12)))
            moved = moved.withColumns({c: F.col(c + "0") + (F.col(c) - F.col(c + "0")) * held for c in ("x", "y")})
        moved = cut(moved)
        if moved.where("close").isEmpty():
            break
        now = moved.drop("close")
    return now

"""Sparse grids (row, col, value) as tables: components, regions, samples, polygon statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import placing as P
from millrace.operators import spatial as S
from millrace.operators.graphs import connected_components
from millrace.session import cut

#: Rows and columns lie within half of this on either side of zero.
WIDTH = 1 << 20
AROUND = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0)]


def key(row: Column, col: Column) -> Column:
    return row * WIDTH + col


def centred(cells: DataFrame, size: float) -> DataFrame:
    """The cells with the coordinates x, y of their centres."""
    at = lambda c: (F.col(c) + F.lit(0.5)) * size
    return cells.withColumns({"x": at("col"), "y": at("row")})


def _moved(cells: DataFrame, moves: list[tuple[int, int]]) -> DataFrame:
    m = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in moves]))
    return cells.withColumn("m", m).withColumns({"to_row": F.col("row") + F.col("m.r"), "to_col": F.col("col") + F.col("m.c")}).drop("m")


def components(cells: DataFrame) -> DataFrame:
    """row, col, component (the least key of its cells): cells that touch, corners included, are one."""
    cells = cells.select("row", "col").distinct()
    there = cells.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"))
    touch = _moved(cells, [(0, 1), (1, -1), (1, 0), (1, 1)]).join(there, ["to_row", "to_col"])
    edges = touch.select(key(F.col("row"), F.col("col")).alias("a"), key(F.col("to_row"), F.col("to_col")).alias("b"))
    label = connected_components(cells.select(key(F.col("row"), F.col("col")).alias("id")), edges)
    return cells.withColumn("id", key(F.col("row"), F.col("col"))).join(label, "id").select("row", "col", "component")


def regions(cells: DataFrame, least: int, size: float = 1.0) -> DataFrame:
    """row, col, region: components as regions numbered from 0 by size; one of fewer than ``least`` cells goes to the larger one whose centre is nearest."""
    parts = cut(components(cells))
    sizes = centred(parts, size).groupBy("component").agg(F.count("*").alias("n"), F.round(F.avg("x"), 9).alias("x"), F.round(F.avg("y"), 9).alias("y"))
    large, small = sizes.where(F.col("n") >= least), sizes.where(F.col("n") < least)
    near = P.nearest_point(small.withColumnRenamed("component", "id"), large.withColumnRenamed("component", "owner"), "owner", 8 * size)
    owner = large.select("component", F.col("component").alias("owner")).unionByName(near.select(F.col("id").alias("component"), "owner"))
    owned = parts.join(owner, "component", "left").withColumn("owner", F.coalesce("owner", "component"))
    return owned.join(_numbered(owned), "owner").select("row", "col", "region")


def _numbered(owned: DataFrame) -> DataFrame:
    from millrace.operators.ranking import ranked_ids

    return ranked_ids(owned, "owner").select("owner", F.col("new_id").alias("region"))


def without_blocks(land: DataFrame, blocks: DataFrame, buffer: int, least: int) -> DataFrame:
    """row, col of the land outside the blocks widened by ``buffer`` cells, parts of fewer than ``least`` cells dropped."""
    left = land.select("row", "col").distinct().join(S.dilated(blocks, buffer).distinct(), ["row", "col"], "left_anti")
    parts = cut(components(left))
    large = parts.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("component")
    return parts.join(large, "component", "left_semi").select("row", "col")


def grown(grid: DataFrame, seeds: DataFrame, share: float, radius: float) -> DataFrame:
    """seed, row, col: the cells that hang together with a seed (seed, row, col), hold at least ``share`` of its value and lie within ``radius`` cells."""
    near = F.hypot(F.col("row") - F.col("r0"), F.col("col") - F.col("c0")) <= radius
    span = list(range(-int(radius), int(radius) + 1))
    top = seeds.join(grid, ["row", "col"]).select("seed", F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("value").alias("top"))
    disk = top.withColumn("row", F.explode(F.transform(F.array(*map(F.lit, span)), lambda i: F.col("r0") + i))).withColumn("col", F.explode(F.transform(F.array(*map(F.lit, span)), lambda i: F.col("c0") + i)))
    allowed = cut(disk.where(near).join(grid, ["row", "col"]).where(F.col("value") >= F.col("top") * share).select("seed", "row", "col"))
    reached = cut(top.select("seed", F.col("r0").alias("row"), F.col("c0").alias("col")))
    edge = reached
    while True:
        step = _moved(edge, AROUND).select("seed", F.col("to_row").alias("row"), F.col("to_col").alias("col")).distinct()
        edge = cut(step.join(allowed, ["seed", "row", "col"]).join(reached, ["seed", "row", "col"], "left_anti"))
        if edge.isEmpty():
            return reached
        reached = cut(reached.unionByName(edge))


def sampled(points: DataFrame, grid: DataFrame, size: float) -> DataFrame:
    """id, value: the grid's value at each point, bilinear between the centres of four cells; cells that aren't there are zero."""
    u, v = F.col("x") / size - 0.5, F.col("y") / size - 0.5
    p = P.placed(points).select("id", F.floor(u).alias("c"), F.floor(v).alias("r"), (u - F.floor(u)).alias("fc"), (v - F.floor(v)).alias("fr"))
    four = F.array(*[
        F.struct((F.col("r") + i).alias("row"), (F.col("c") + j).alias("col"), ((F.col("fr") if i else 1 - F.col("fr")) * (F.col("fc") if j else 1 - F.col("fc"))).alias("w"))
        for i in (0, 1) for j in (0, 1)
    ])
    spread = p.select("id", F.inline(four)).join(grid.select("row", "col", "value"), ["row", "col"], "left")
    return spread.groupBy("id").agg(F.sum(F.col("w") * F.coalesce("value", F.lit(0.0))).alias("value"))


def polygon_means(polygons: DataFrame, grid: DataFrame, size: float) -> DataFrame:
    """poly, mean, mass (sum times the cell's area) of the cells with their centre in each polygon; with none, the nearest cell's value and no mass."""
    cells = centred(grid, size).withColumn("id", key(F.col("row"), F.col("col")))
    of = S.assign_to_polygons(cells, polygons, size * 4).where("poly IS NOT NULL").join(cells.select("id", "value"), "id")
    stats = cut(of.groupBy("poly").agg(F.avg("value").alias("mean"), (F.sum("value") * size * size).alias("mass")))
    ring = F.col("ring")
    middle = lambda c: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[c]) / F.size(ring)
    rest = polygons.join(stats, "poly", "left_anti").select(F.col("poly").alias("id"), middle("x").alias("x"), middle("y").alias("y"))
    near = P.nearest_point(rest, cells.withColumnRenamed("id", "cell"), "cell", size * 2).join(cells.select(F.col("id").alias("cell"), "value"), "cell")
    return stats.unionByName(near.select(F.col("id").alias("poly"), F.col("value").alias("mean"), F.lit(0.0).alias("mass")))


def polygon_contrast(polygons: DataFrame, points: DataFrame, smooth: DataFrame, size: float) -> DataFrame:
    """poly, area, n, density, contrast: p90 over p50 of the smoothed cells above zero in a polygon, 0 with fewer than two; a polygon's cells are one bounded group."""
    cells = centred(smooth.where("value > 0"), size).withColumn("id", key(F.col("row"), F.col("col")))
    inside = S.assign_to_polygons(cells, polygons, size * 4).where("poly IS NOT NULL").join(cells.select("id", "value"), "id")
    q = lambda x: F.percentile("value", F.lit(x))
    contrast = inside.groupBy("poly").agg(F.when(F.count("*") >= 2, q(0.9) / q(0.5)).otherwise(0.0).alias("contrast"))
    n = S.assign_to_polygons(P.placed(points), polygons, size * 4).where("poly IS NOT NULL").groupBy("poly").agg(F.count("*").alias("n"))
    area = polygons.select("poly", S.measures(F.col("ring"))["area"].alias("area"))
    out = area.join(n, "poly", "left").join(contrast, "poly", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out.select("poly", "area", "n", (F.col("n") / F.col("area")).alias("density"), F.coalesce("contrast", F.lit(0.0)).alias("contrast"))


def density_clusters(points: DataFrame, eps: float, least: int) -> DataFrame:
    """id, cluster: points with ``least`` others and themselves within ``eps`` are chained; another point goes to the nearest of them within ``eps``; the rest have none."""
    pairs = cut(S.pairs_within(points, eps))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg((F.count("*") + 1).alias("n"))
    core = cut(points.select("id").join(degree, "id", "left").where(F.coalesce("n", F.lit(1)) >= least).select("id"))
    of = lambda end: core.withColumnRenamed("id", end)
    label = cut(connected_components(core, pairs.join(of("a"), "a", "left_semi").join(of("b"), "b", "left_semi").select("a", "b")))
    ways = pairs.select("a", "b", "w").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    border = ways.join(core.withColumnRenamed("id", "a"), "a", "left_anti").join(label.select(F.col("id").alias("b"), "component"), "b")
    best = border.groupBy(F.col("a").alias("id")).agg(F.min(F.struct(F.round("w", 9).alias("w"), "b", "component")).alias("m")).select("id", F.col("m.component").alias("component"))
    return points.select("id").join(label.unionByName(best), "id", "left").select("id", F.col("component").alias("cluster"))


def slopes(grid: DataFrame) -> DataFrame:
    """row, col, value scaled by its range to 0 .. 1, and slope: the length of its gradient by central differences, cells that aren't there taken as zero."""
    ends = grid.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))  # one row
    span = F.col("hi") - F.col("lo")
    unit = grid.join(F.broadcast(ends)).select("row", "col", F.when(span > 0, (F.col("value") - F.col("lo")) / span).otherwise(0.0).alias("value"))
    moves = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(gx).alias("gx"), F.lit(gy).alias("gy")) for r, c, gx, gy in ((0, 0, 0.0, 0.0), (0, -1, 0.5, 0.0), (0, 1, -0.5, 0.0), (-1, 0, 0.0, 0.5), (1, 0, 0.0, -0.5))])
    spread = unit.withColumn("m", F.explode(moves)).select(
        (F.col("row") + F.col("m.r")).alias("row"), (F.col("col") + F.col("m.c")).alias("col"), (F.col("value") * F.col("m.gx")).alias("gx"), (F.col("value") * F.col("m.gy")).alias("gy"),
        F.when((F.col("m.r") == 0) & (F.col("m.c") == 0), F.col("value")).alias("value"),
    )
    out = spread.groupBy("row", "col").agg(F.max("value").alias("value"), F.hypot(F.sum("gx"), F.sum("gy")).alias("slope"))
    return out.where("value IS NOT NULL")


def peaks(grid: DataFrame, tile: str, value: str, apart: float, least: float) -> DataFrame:
    """tile, row, col, value of the local maxima above zero of each tile, of at least ``least`` times its highest; of two closer than ``apart`` cells only the higher, then the first by row and column."""
    from millrace.operators.layout import first_come, in_order

    cells = grid.select(tile, "row", "col", F.col(value).alias("v"))
    top = cells.groupBy(tile).agg(F.max("v").alias("top"))
    high = cells.join(top, tile).where((F.col("v") > 0) & (F.col("v") >= least * F.col("top"))).drop("top")
    there = cells.select(tile, F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("v").alias("next"))
    below = _moved(high, AROUND).join(there, [tile, "to_row", "to_col"]).where("next > v").select(tile, "row", "col").distinct()
    found = cut(high.join(below, [tile, "row", "col"], "left_anti").select(
        F.struct(tile, "row", "col").alias("id"), tile, "row", "col", F.col("v").alias("priority"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y")
    ))
    near = S.pairs_within(found, apart).where(F.col("w") < apart).select("a", "b")
    kept = first_come(found, in_order(near, found, tile))
    return found.join(kept, "id", "left_semi").select(tile, "row", "col", F.col("priority").alias(value))


def districts(cells: DataFrame, roads: DataFrame, size: float, least: int) -> DataFrame:
    """row, col, district: cells that hang together by steps to the right or up which cross no road (id, ax, ay, bx, by), numbered from 0 by size.

    A district of fewer than ``least`` cells joins the larger one that it has most
    steps across roads to, the smaller key on a tie; without such a step it stays.
    """
    cells = cut(centred(cells.select("row", "col").distinct(), size).withColumn("id", key(F.col("row"), F.col("col"))))
    there = cells.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    links = _moved(cells, [(0, 1), (1, 0)]).join(there, ["to_row", "to_col"])
    links = cut(links.select(F.col("id").alias("a"), "b", F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by"))
    named = lambda df, kind, name: df.select(F.struct(F.lit(kind).alias("k"), *name).alias("id"), "ax", "ay", "bx", "by")
    lines = named(links, 0, [F.col("a").alias("p"), F.col("b").alias("q")]).unionByName(named(roads, 1, [F.col("id").cast("long").alias("p"), F.lit(0).cast("long").alias("q")]))
    met = P.crossings(lines, size * 2).where("a.k = 0 AND b.k = 1")
    blocked = cut(met.select(F.col("a.p").alias("a"), F.col("a.q").alias("b")).distinct())
    label = cut(connected_components(cells.select("id"), links.select("a", "b").join(blocked, ["a", "b"], "left_anti")))
    n = label.groupBy("component").agg(F.count("*").alias("n"))
    both = blocked.unionByName(blocked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    of = lambda end, name, where: label.join(n.where(where), "component").select(F.col("id").alias(end), F.col("component").alias(name))
    steps = both.join(of("a", "small", F.col("n") < least), "a").join(of("b", "large", F.col("n") >= least), "b").groupBy("small", "large").agg(F.count("*").alias("k"))
    best = steps.groupBy("small").agg(F.max_by("large", F.struct("k", (-F.col("large")).alias("l"))).alias("large")).withColumnRenamed("small", "component")
    owned = cut(cells.join(label, "id").join(best, "component", "left").select("row", "col", F.coalesce("large", "component").alias("owner")))
    return owned.join(_numbered(owned), "owner").select("row", "col", F.col("region").alias("district"))

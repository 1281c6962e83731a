"""Graphs as edge tables: components, spanning trees, degrees, paths."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut


def unordered(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct edges with the smaller end first, no loops."""
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (the smallest id in it). Large and small stars in turn, lineage cut at each step; stops when the edges stand still."""
    e = cut(unordered(edges).select(F.col("b").alias("u"), F.col("a").alias("v")))
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hub = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        e = both.join(hub, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        hub = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(hub, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))).where("u <> v").distinct()
        e = cut(e)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    known = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return vertices.select("id").distinct().join(known, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def spanning_forest(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Minimum spanning forest of (a, b, w) by Borůvka: each component takes its lightest way out, ties by (w, a, b).

    After a round the edges carry the names of the merged components, those inside
    one are dropped, and of several between two only the lightest stays; so the
    rounds work on ever fewer rows. ``vertices`` says which ids there are.
    """
    known = vertices.select("id").distinct()
    of = lambda end: known.withColumnRenamed("id", end)
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").where("a <> b").join(of("a"), "a", "left_semi").join(of("b"), "b", "left_semi")
    e = cut(e.groupBy("a", "b").agg(F.min("w").alias("w")).select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.struct("w", "a", "b").alias("way")))
    chosen = None
    while True:
        out = e.select(F.inline(F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("to"), "way"), F.struct(F.col("cb").alias("c"), F.col("ca").alias("to"), "way"))))
        best = cut(out.groupBy("c").agg(F.min(F.struct("way", "to")).alias("m")).select("c", "m.way", "m.to"))
        if best.isEmpty():
            break
        picked = best.select("way.*").distinct()
        chosen = picked if chosen is None else chosen.unionByName(picked)
        back = best.select(F.col("c").alias("to"), F.col("to").alias("back"))
        # two components that chose each other: the smaller is the root; all others hang on the one they chose
        up = cut(best.join(back, "to").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("up")))
        while True:
            top = up.select(F.col("c").alias("up"), F.col("up").alias("top"))
            higher = cut(up.join(top, "up").select("c", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            up = higher.drop("moved")
            if higher.where("moved").isEmpty():
                break
        name = lambda end: up.select(F.col("c").alias(end), F.col("up").alias(f"n{end}"))
        across = e.join(name("ca"), "ca").join(name("cb"), "cb").where("nca <> ncb")
        e = cut(across.groupBy(F.least("nca", "ncb").alias("ca"), F.greatest("nca", "ncb").alias("cb")).agg(F.min("way").alias("way")))
    return cut(chosen) if chosen is not None else edges.select("w", "a", "b").limit(0)


def extra_edges(tree: DataFrame, edges: DataFrame, share: float, longest: float) -> DataFrame:
    """The shortest edges outside the tree, round(edges of the tree * share) of them, none longer than the cap."""
    n = round(tree.count() * share)
    rest = edges.join(tree.select("a", "b"), ["a", "b"], "left_anti").where(F.col("w") <= longest)
    return rest.orderBy("w", "a", "b").limit(n)


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def pruned(edges: pd.DataFrame, beta: float) -> pd.DataFrame:
    """Edges whose best way around is longer than beta times their own; longest first, one small graph at a time."""
    near: dict[int, dict[int, float]] = {}
    for r in edges.itertuples():
        near.setdefault(r.a, {})[r.b] = r.w
        near.setdefault(r.b, {})[r.a] = r.w

    def around(a: int, b: int, limit: float) -> bool:
        best, queue = {a: 0.0}, [(0.0, a)]
        while queue:
            d, x = heapq.heappop(queue)
            if x == b:
                return True
            if d > best[x]:
                continue
            for y, w in near[x].items():
                if {x, y} != {a, b} and d + w <= limit and d + w < best.get(y, float("inf")):
                    best[y] = d + w
                    heapq.heappush(queue, (d + w, y))
        return False

    kept = []
    for r in edges.sort_values(["w", "a", "b"], ascending=[False, True, True]).itertuples():
        if around(r.a, r.b, beta * r.w):
            del near[r.a][r.b], near[r.b][r.a]
        else:
            kept.append((r.a, r.b, r.w))
    return pd.DataFrame(sorted(kept), columns=["a", "b", "w"])


def prune_by_group(edges: DataFrame, group: str, beta: float) -> DataFrame:
    """``pruned`` in each group of (group, a, b, w); a group is one local network."""
    kind = dict(edges.dtypes)

    def go(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pruned(rows, beta).assign(**{group: key[0]})[[group, "a", "b", "w"]]

    return edges.groupBy(group).applyInPandas(go, f"{group} {kind[group]}, a {kind['a']}, b {kind['b']}, w double")


def consecutive(points: DataFrame, line: str, order: str) -> DataFrame:
    """Segments between neighbours along each line of (line, order, x, y)."""
    w = Window.partitionBy(line).orderBy(order)
    return points.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w)}).where("x2 IS NOT NULL")


def shortest(near: dict[int, dict[int, float]], start: int) -> dict[int, tuple[float, int | None]]:
    """(distance, previous node) of every node that can be reached; among equal ways the one over the smaller node."""
    best: dict[int, tuple[float, int | None]] = {start: (0.0, None)}
    queue, done = [(0.0, start)], set()
    while queue:
        d, x = heapq.heappop(queue)
        if x in done:
            continue
        done.add(x)
        for y, w in sorted(near.get(x, {}).items()):
            way = (round(d + w, 9), x)
            if y not in done and (y not in best or way < (best[y][0], best[y][1])):
                best[y] = way
                heapq.heappush(queue, (way[0], y))
    return best


def paths_between(edges: DataFrame, major: DataFrame, group: str) -> DataFrame:
    """group, a, b, uses: edges of (group, a, b, w) on the shortest ways between all pairs of the group's major nodes (group, v: array); a group is one local network."""
    kind = dict(edges.dtypes)

    def go(key: tuple, rows: pd.DataFrame, tops: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, dict[int, float]] = {}
        for a, b, w in zip(rows["a"].tolist(), rows["b"].tolist(), rows["w"].tolist(), strict=True):
            near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
        uses: dict[tuple[int, int], int] = {}
        nodes = sorted(int(v) for vs in tops["v"] for v in vs)
        for i, start in enumerate(nodes):
            best = shortest(near, start)
            for x in nodes[i + 1 :]:
                while x in best and best[x][1] is not None:
                    y = best[x][1]
                    uses[min(x, y), max(x, y)] = uses.get((min(x, y), max(x, y)), 0) + 1
                    x = y
        return pd.DataFrame([(key[0], a, b, n) for (a, b), n in sorted(uses.items())], columns=[group, "a", "b", "uses"])

    return edges.groupBy(group).cogroup(major.groupBy(group)).applyInPandas(go, f"{group} {kind[group]}, a {kind['a']}, b {kind['b']}, uses long")

"""Raster kernels for one bounded tile or island each: flow, costs, least-cost paths."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

STEPS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def receivers(height: np.ndarray) -> np.ndarray:
    """Flat index of the steepest lower neighbour of each cell, or its own; ties to the first direction."""
    rows, cols = height.shape
    own = np.arange(rows * cols).reshape(rows, cols)
    best, to = np.zeros_like(height), own.copy()
    pad = np.pad(height, 1, constant_values=np.inf)
    ids = np.pad(own, 1, constant_values=-1)
    for dr, dc in STEPS:
        drop = (height - pad[1 + dr : 1 + dr + rows, 1 + dc : 1 + dc + cols]) / np.hypot(dr, dc)
        better = drop > best
        best, to = np.where(better, drop, best), np.where(better, ids[1 + dr : 1 + dr + rows, 1 + dc : 1 + dc + cols], to)
    return to


def flow(height: np.ndarray) -> np.ndarray:
    """Cells that drain through each cell, itself included: highest first, each passes its count down."""
    to, count = receivers(height).ravel(), np.ones(height.size)
    for i in np.argsort(-height, axis=None, kind="stable"):
        if to[i] != i:
            count[to[i]] += count[i]
    return count.reshape(height.shape)


def cost_field(slope: np.ndarray, drained: np.ndarray, dense: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """1 + 8 slope + 6 river - 0.8 density, at least 0.05, infinite outside; rivers are scaled by their 99th percentile."""
    top = np.percentile(drained[mask], 99) if mask.any() else 1.0
    c = 1 + 8 * slope + 6 * np.minimum(drained / max(top, 1e-9), 1) - 0.8 * dense
    return np.where(mask, np.maximum(c, 0.05), np.inf)


def least_path(cost: np.ndarray, start: tuple[int, int], end: tuple[int, int]) -> tuple[float, list[tuple[int, int]]]:
    """Cheapest 8-neighbour path; a step costs the mean of its cells times its length."""
    best, came, queue = {start: 0.0}, {}, [(0.0, start)]
    while queue:
        d, at = heapq.heappop(queue)
        if at == end:
            path = [at]
            while at in came:
                at = came[at]
                path.append(at)
            return d, path[::-1]
        if d > best[at]:
            continue
        for dr, dc in STEPS:
            r, c = at[0] + dr, at[1] + dc
            if 0 <= r < cost.shape[0] and 0 <= c < cost.shape[1] and np.isfinite(cost[r, c]):
                n = d + (cost[at] + cost[r, c]) / 2 * float(np.hypot(dr, dc))
                if n < best.get((r, c), np.inf):
                    best[(r, c)], came[(r, c)] = n, at
                    heapq.heappush(queue, (n, (r, c)))
    return float("inf"), []


def dense_tile(rows: pd.DataFrame, value: str) -> tuple[np.ndarray, int, int]:
    """Array of a sparse tile (row, col, value), zeros between, with its origin."""
    r0, c0 = int(rows["row"].min()), int(rows["col"].min())
    out = np.zeros((int(rows["row"].max()) - r0 + 1, int(rows["col"].max()) - c0 + 1))
    out[rows["row"] - r0, rows["col"] - c0] = rows[value]
    return out, r0, c0


def flow_by_tile(grid: DataFrame, tile: str, height: str) -> DataFrame:
    """tile, row, col, drained of each tile of (tile, row, col, height)."""
    kinds = dict(grid.dtypes)

    def go(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        h, r0, c0 = dense_tile(rows, height)
        f = flow(h)
        return pd.DataFrame({tile: key[0], "row": rows["row"], "col": rows["col"], "drained": f[rows["row"] - r0, rows["col"] - c0]})

    return grid.groupBy(tile).applyInPandas(go, f"{tile} {kinds[tile]}, row long, col long, drained double")


def routes(grid: DataFrame, pairs: DataFrame, tile: str, cost: str) -> DataFrame:
    """tile, pair, length, cells of the cheapest path of each pair (tile, pair, r1, c1, r2, c2) over its tile's costs."""
    kinds = dict(grid.dtypes)

    def go(key: tuple, g: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(g):
            c, r0, c0 = dense_tile(g, cost)
            c = np.where(c > 0, c, np.inf)
            for r in p.itertuples():
                d, path = least_path(c, (r.r1 - r0, r.c1 - c0), (r.r2 - r0, r.c2 - c0))
                out.append((key[0], r.pair, d, len(path)))
        return pd.DataFrame(out, columns=[tile, "pair", "length", "cells"])

    return grid.groupBy(tile).cogroup(pairs.groupBy(tile)).applyInPandas(go, f"{tile} {kinds[tile]}, pair long, length double, cells long")


def costs_by_tile(grid: DataFrame, tile: str, height: str) -> DataFrame:
    """tile, row, col, cost: what a way pays on each cell of (tile, row, col, height), by slope, rivers and density, the heights scaled to 0 .. 1 in their tile."""
    kinds = dict(grid.dtypes)

    def go(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        h, r0, c0 = dense_tile(rows, height)
        mask = np.zeros(h.shape, bool)
        mask[rows["row"] - r0, rows["col"] - c0] = True
        unit = (h - h[mask].min()) / max(float(np.ptp(h[mask])), 1e-12)
        pad = np.pad(unit, 1)
        slope = np.hypot((pad[1:-1, 2:] - pad[1:-1, :-2]) / 2, (pad[2:, 1:-1] - pad[:-2, 1:-1]) / 2)
        cost = cost_field(slope, flow(h), unit, mask)
        return pd.DataFrame({tile: key[0], "row": rows["row"], "col": rows["col"], "cost": cost[rows["row"] - r0, rows["col"] - c0]})

    return grid.groupBy(tile).applyInPandas(go, f"{tile} {kinds[tile]}, row long, col long, cost double")

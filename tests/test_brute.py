"""Queries and operators without an SQL twin against plain Python."""

import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import session
from millrace.operators import graphs, grids, layout, placing, ranking, spatial, trees
from millrace.plans import registry
from millrace.plans.vectors import points, road_edges
from millrace.sources import readers, writers

QUERIES, _ = registry.load()


@pytest.fixture(scope="module")
def roads(spark, sf):
    return sorted({(r.a, r.b, r.w) for r in road_edges(spark, sf).collect()}, key=lambda e: (e[2], e[0], e[1]))


@pytest.fixture(scope="module")
def places(spark, sf):
    return {r.id: r for r in points(spark, sf).collect()}


def kruskal(edges):
    up, out = {}, []

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b, w in edges:
        x, y = root(a), root(b)
        if x != y:
            up[y] = x
            out.append((a, b, w))
    return out


def test_forest_and_loops(spark, sf, roads):
    tree = kruskal(roads)
    assert sorted((r.a, r.b) for r in QUERIES["mst"](spark, sf).collect()) == sorted(e[:2] for e in tree)
    rest = [e for e in roads if e not in tree and e[2] <= 1.0][: round(len(tree) * 0.2)]
    got = QUERIES["looped_graph"](spark, sf).collect()
    assert sorted((r.a, r.b, r.extra) for r in got) == sorted([(a, b, False) for a, b, _ in tree] + [(a, b, True) for a, b, _ in rest])


def distance(edges, start):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    best = {start: 0.0}
    for _ in range(len(near)):
        change = False
        for a, ways in near.items():
            for b, w in ways:
                if a in best and best[a] + w < best.get(b, float("inf")) - 1e-15:
                    best[b], change = best[a] + w, True
        if not change:
            break
    return best


def by_label(roads, places):
    out = {}
    for a, b, w in roads:
        if places[a].label == places[b].label:
            out.setdefault(places[a].label, []).append((a, b, w))
    return out


def test_beta_pruning(spark, sf, roads, places):
    want = []
    for label, edges in by_label(roads, places).items():
        left = list(edges)
        for e in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
            rest = [x for x in left if x != e]
            if distance(rest, e[0]).get(e[1], float("inf")) <= 1.5 * e[2]:
                left = rest
        want += [(label, a, b) for a, b, _ in left]
    assert sorted((r.label, r.a, r.b) for r in QUERIES["beta_prune"](spark, sf).collect()) == sorted(want)


def test_main_streets_are_shortest_ways(spark, sf, roads, places):
    got = {}
    for r in QUERIES["main_streets"](spark, sf).collect():
        got.setdefault(r.label, []).append((r.a, r.b, r.uses))
    weight = {e[:2]: round(e[2], 9) for e in roads}
    for label, edges in by_label(roads, places).items():
        edges = [(a, b, round(w, 9)) for a, b, w in edges]
        major = sorted({v for e in edges for v in e[:2]})[:3]
        whole = [distance(edges, x).get(y) for i, x in enumerate(major) for y in major[i + 1 :]]
        used = got.get(label, [])
        assert sum(weight[a, b] * n for a, b, n in used) == pytest.approx(sum(w for w in whole if w is not None), abs=1e-6)


def test_relaxed_points_are_apart(spark, sf, places):
    got = {r.id: (r.x, r.y) for r in QUERIES["relax_points"](spark, sf).collect()}
    xy = {i: np.array([p.x, p.y]) for i, p in places.items()}
    ids, start = sorted(xy), {i: v.copy() for i, v in xy.items()}
    for _ in range(40):
        x = np.array([xy[i] for i in ids])
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        push = (d < 0.01) & (d > 0)
        if not push.any():
            break
        f = np.where(push, (0.01 - d) * 0.25 / np.where(push, d, 1), 0)
        move = (f[:, :, None] * (x[:, None] - x[None])).sum(1)
        new = x + move + 0.05 * (np.array([start[i] for i in ids]) - x)
        off = new - np.array([start[i] for i in ids])
        far = np.hypot(off[:, 0], off[:, 1])
        new = np.array([start[i] for i in ids]) + off * np.minimum(1.0, 0.02 / np.maximum(far, 1e-12))[:, None]
        xy = dict(zip(ids, new))
    assert max(abs(got[i][k] - xy[i][k]) for i in ids for k in (0, 1)) < 2e-5


def test_labels_and_thinning(spark, sf, places):
    placed, kept = {}, {}
    for label in {p.label for p in places.values()}:
        own = [p for p in places.values() if p.label == label]
        boxes = []
        for p in sorted(own, key=lambda p: (-(p.id % 17), p.id)):
            if not any(abs(p.x - q.x) < 0.05 and abs(p.y - q.y) < 0.02 for q in boxes):
                boxes.append(p)
        placed[label] = {p.id for p in boxes}
        some = []
        for p in sorted(own, key=lambda p: (-(p.id % 5), p.id)):
            if all((p.x - q.x) ** 2 + (p.y - q.y) ** 2 >= 0.03**2 for q in some):
                some.append(p)
        kept[label] = {p.id for p in some}
    for name, want in (("label_placement", placed), ("thinned_points", kept)):
        got = {}
        for r in QUERIES[name](spark, sf).collect():
            got.setdefault(r.label, set()).add(r.id)
        assert got == want


def test_slots_are_taken_once(spark, sf, places):
    got = QUERIES["slot_assignment"](spark, sf).collect()
    assert sorted(r.id for r in got) == sorted(places)
    assert len({(r.label, r.slot) for r in got}) == len(got) and all(r.moved >= 0 for r in got)


def test_unicode_fold(spark, sf):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["unicode_fold"](spark, sf).collect():
        assert r.nfkc == (None if text[r.doc_id] is None else unicodedata.normalize("NFKC", text[r.doc_id]))


def smooth(places):
    n = Counter((p.label, int(np.floor(p.y / 0.05)), int(np.floor(p.x / 0.05))) for p in places.values())
    kernel, out = spatial.gaussian(0.7), Counter()
    for (label, r, c), k in n.items():
        for dr, dc, w in kernel:
            out[label, r + dr, c + dc] += k * w
    return {k: round(v, 9) for k, v in out.items()}


def test_peaks_flow_and_routes(spark, sf, places):
    value = smooth(places)
    around = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0)]
    got = {}
    for r in QUERIES["density_peaks"](spark, sf).collect():
        got.setdefault(r.label, []).append((r.row, r.col))
    for label in {k[0] for k in value}:
        own = {k[1:]: v for k, v in value.items() if k[0] == label}
        top = max(own.values())
        tops = [p for p, v in own.items() if v > 0 and v >= 0.3 * top and all(own.get((p[0] + r, p[1] + c), 0) <= v for r, c in around)]
        want = []
        for p in sorted(tops, key=lambda p: (-own[p], p)):
            if all((p[0] - a) ** 2 + (p[1] - b) ** 2 >= 9 for a, b in want):
                want.append(p)
        assert sorted(got[label]) == sorted(want)
    drained = {(r.label, r.row, r.col): r.drained for r in QUERIES["drained_cells"](spark, sf).collect()}
    assert drained.keys() == value.keys() and min(drained.values()) >= 1
    for r in QUERIES["cheapest_routes"](spark, sf).collect():
        assert 0 < r.length < float("inf") and r.cells >= 2


def test_cost_raster(spark, sf, places):
    value = smooth(places)
    got = {(r.label, r.row, r.col): r.cost for r in QUERIES["cost_raster"](spark, sf).collect()}
    drained = {(r.label, r.row, r.col): r.drained for r in QUERIES["drained_cells"](spark, sf).collect()}
    assert got.keys() == value.keys()
    for label in {k[0] for k in value}:
        own = {k: v for k, v in value.items() if k[0] == label}
        lo, hi = min(own.values()), max(own.values())
        top = np.percentile([drained[k] for k in own], 99)
        # heights of cells that aren't there are zero before they are scaled, and outside the tile after
        rows, cols = [k[1] for k in own], [k[2] for k in own]
        unit = lambda r, c: (own.get((label, r, c), 0.0) - lo) / (hi - lo) if min(rows) <= r <= max(rows) and min(cols) <= c <= max(cols) else 0.0  # noqa: B023, E731
        for (_, r, c), v in own.items():
            slope = np.hypot((unit(r, c + 1) - unit(r, c - 1)) / 2, (unit(r + 1, c) - unit(r - 1, c)) / 2)
            want = max(0.05, 1 + 8 * slope + 6 * min(drained[label, r, c] / top, 1) - 0.8 * unit(r, c))
            assert got[label, r, c] == pytest.approx(want, abs=1e-6)


def test_local_roads_span_their_nodes(spark, sf, places):
    got = QUERIES["local_roads"](spark, sf).collect()
    local = [(r.a, r.b, r.w) for r in got if r.kind == "local"]
    main = [(r.a, r.b, r.w) for r in got if r.kind == "main"]
    labels = {p.label for p in places.values()}
    assert all(a // 100 == b // 100 for a, b, _ in local) and len(kruskal(sorted(local, key=lambda e: e[2]))) == len(local)
    assert {v for e in main for v in e[:2]} == labels and len(kruskal(sorted(main, key=lambda e: e[2]))) == len(main)
    assert sum(r.kind == "local loop" for r in got) <= round(0.2 * len(local))


def test_ring_shapes(spark, sf, places):
    got = {r.label: r for r in QUERIES["ring_shapes"](spark, sf).collect()}
    n = Counter(p.label for p in places.values())
    assert {k: r.corners for k, r in got.items()} == dict(n)
    assert all(0 <= r.axis < 180 and 0 < r.convexity <= 1.000001 and r.irregularity >= 0 for r in got.values())
    turn = lambda x, y, a: {"x": float(x * np.cos(a) - y * np.sin(a)), "y": float(x * np.sin(a) + y * np.cos(a))}
    box = [turn(x, y, 0.5) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (0.0, 1.0))]
    ell = [{"x": float(x), "y": float(y)} for x, y in ((0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2))]
    df = spark.createDataFrame([(1, box), (2, ell), (3, box[:2])], "k int, ring array<struct<x:double,y:double>>")
    r = {x.k: x for x in layout.shapes(df, "k").collect()}
    assert r[1].axis == pytest.approx(np.degrees(0.5)) and r[1].convexity == pytest.approx(1.0)
    assert r[2].convexity == pytest.approx(3 / 3.5) and r[3].axis is None
    cut_twice = {x.k: len(x.ring) for x in layout.smoothed_rings(df.where("k < 3"), "k", 2).collect()}
    assert cut_twice == {1: 16, 2: 24}


def test_voronoi_cells_are_the_nearest(spark):
    x = np.random.default_rng(4).random((40, 2))
    cells = layout.voronoi(x, (0.0, 0.0, 1.0, 1.0))
    assert sum(layout.shoelace(c) for c in cells) == pytest.approx(1.0)
    grid = (np.indices((60, 60)).reshape(2, -1).T + 0.5) / 60
    owner = ((grid[:, None] - x[None]) ** 2).sum(2).argmin(1)
    share = np.bincount(owner, minlength=40) / len(owner)
    assert np.abs(share - [layout.shoelace(c) for c in cells]).max() < 0.01
    small = layout.voronoi(x, (0.0, 0.0, 1.0, 1.0), 0.5)
    assert sum(layout.shoelace(c) for c in small) == pytest.approx(0.25)


def test_triangulation_has_empty_circles():
    for n in (3, 4, 17, 80):
        x = np.random.default_rng(n).normal(size=(n, 2))
        t = layout.delaunay(x)
        for a, b, c in x[t]:
            m = np.array([b - a, c - a])
            centre = a + np.linalg.solve(2 * m, (m * m).sum(1))
            r = np.hypot(*(a - centre))
            assert (np.hypot(*(x - centre).T) >= r * (1 - 1e-9)).all()
        assert sum(layout.shoelace(x[k]) for k in t) == pytest.approx(layout.shoelace(layout.hull(x)))
    assert len(layout.delaunay(np.zeros((5, 2)))) == 0 and len(layout.delaunay(np.array([[0.0, 0], [1, 1], [2, 2]]))) == 0


def test_footprints_beside_roads(spark, sf):
    box = lambda x, y: [{"x": x, "y": y}, {"x": x + 1, "y": y}, {"x": x + 1, "y": y + 1}, {"x": x, "y": y + 1}]
    f = spark.createDataFrame([(1, box(0.0, 0.0)), (2, box(0.0, 5.0)), (3, box(9.0, 0.45))], "id int, ring array<struct<x:double,y:double>>")
    roads = spark.createDataFrame([(7, -5.0, 0.3, 20.0, 0.3)], "id int, ax double, ay double, bx double, by double")
    got = {r.id: r for r in layout.clipped(f, "id", roads, 0.1, 0.5).collect()}
    assert got[1].area == pytest.approx(0.6) and got[2].share == pytest.approx(1.0) and got[3].share == pytest.approx(1.0)
    assert set(r.id for r in layout.clipped(f, "id", roads, 0.3, 0.5).collect()) == {2, 3}
    assert all(0.5 <= r.share <= 1.000001 for r in QUERIES["clipped_footprints"](spark, sf).collect())


def test_clusters_nest(spark, sf, places):
    for name in ("kmeans_hierarchy", "feature_hierarchy"):
        got = QUERIES[name](spark, sf).collect()
        assert sorted(r.id for r in got) == sorted(places)
        assert all(r.parent.split("/")[0] == str(places[r.id].label) for r in got)
        for parent, n in Counter(r.parent for r in got).items():
            sizes = Counter(r.child for r in got if r.parent == parent)
            assert len(sizes) == max(1, min(round(n / 12), 4, n // 4)) or len(sizes) < 4
            assert [sizes[c] for c in sorted(sizes)] == sorted(sizes.values(), reverse=True)


def test_svd_features(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    s = np.linalg.svd(x, full_matrices=False)[2][:16].T
    s = s * np.sign(s[np.abs(s).argmax(0), np.arange(16)])
    z = lambda a: (a - a.mean(0)) / np.where(a.std(0) < 1e-6, 1, a.std(0))
    want = np.hstack([z(x[:, :2]) * 2.5, z(x @ s) * 2.0])
    got = {r.id: r.f for r in QUERIES["svd_features"](spark, sf).collect()}
    assert np.abs(np.array([got[r.vec_id] for r in rows]) - want).max() < 1e-4


def test_sibling_labels(spark, sf):
    rows = spark.read.parquet(f"{sf}/customer.parquet").collect()
    got = {(r.parent, r.child): r.label for r in QUERIES["sibling_labels"](spark, sf).collect()}
    members = {}
    for r in rows:
        members.setdefault(r.c_nationkey % 5, {}).setdefault(r.c_nationkey, []).append(r.c_mktsegment if r.c_custkey % 4 else None)
    for parent, children in members.items():
        used = set()
        for n, (child, hints) in enumerate(sorted(children.items(), key=lambda kv: (-len(kv[1]), kv[0]))):
            votes = Counter(h for h in hints if h)
            free = [h for h, _ in sorted(votes.items(), key=lambda kv: (-kv[1], kv[0].lower())) if h not in used]
            want = free[0] if free else f"area {n + 1}"
            used.add(want)
            assert got[parent, child] == want


def test_controllers_cover_every_call(spark, sf):
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert sum(r["count"] for r in QUERIES["circuit_breaker"](spark, sf).collect()) == n
    r = QUERIES["rate_limiter"](spark, sf).collect()
    assert sum(x.n for x in r) == n and all(x.low >= 0.5 and x.longest_wait >= 0 for x in r)


def test_required_join_names_what_is_missing(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert placing.required(a.where("k = 1"), b, ["k"]).collect() == [(1, "x")]
    with pytest.raises(placing.MissingRows, match="2"):
        placing.required(a, b, ["k"])


def test_nearest_of_nothing_and_of_far_things(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, 90.0, 40.0)], "id int, x double, y double")
    far = spark.createDataFrame([(7, 50.0, 0.0), (8, -50.0, 0.0)], "k int, x double, y double")
    assert sorted(map(tuple, placing.nearest_point(p, far, "k", 0.1).collect())) == [(1, 7, 50.0), (3, 7, round(np.hypot(40, 40), 9))]
    assert placing.nearest_point(p, far.limit(0), "k", 0.1).count() == 0
    assert placing.nearest_point(p, far, "k", 0.1, reach=1.0).count() == 0


def test_split_and_dangles_until_stable(spark):
    s = spark.createDataFrame([(1, x, 10.0) for x in (0.5, 2.0, 2.5, 6.0, 9.5)], "line int, at double, len double")
    assert [(r.start, r.end) for r in placing.split_at(s, "line", "at", "len", 1.0).orderBy("part").collect()] == [(0.0, 2.0), (2.0, 6.0), (6.0, 10.0)]
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (4, 5, 9.0), (5, 6, 9.0), (4, 6, 9.0)], "a int, b int, w double")
    assert sorted((r.a, r.b) for r in placing.without_dangles(e, 2.0).collect()) == [(4, 5), (4, 6), (5, 6)]


def test_order_statistics_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 50, 999) / 4
    df = spark.createDataFrame([(int(i % 3), float(v)) for i, v in enumerate(x)], "k int, v double").repartition(5)
    for r in ranking.order_statistics(df, ["k"], "v", m=("cont", 0.5), q=("cont", 0.93), d=("disc", 0.95), lo=("at", 2), hi=("at", -1)).collect():
        own = np.sort(x[r.k :: 3])
        assert (r.n, r.m, r.lo, r.hi) == (333, np.median(own), own[2], own[-1])
        assert r.q == pytest.approx(np.quantile(own, 0.93)) and r.d == own[int(np.ceil(0.95 * 333)) - 1]
    places = ranking.positioned(df.withColumn("u", F.monotonically_increasing_id()), ["k"], "v", "u").collect()
    for k in range(3):
        own = sorted((r.i, r.v) for r in places if r.k == k)
        assert [i for i, _ in own] == list(range(333)) and [v for _, v in own] == sorted(x[k::3])


def test_estimates_stay_bounded_in_a_loop(spark):
    df = spark.range(100).select("id", (F.col("id") % 10).alias("k"))
    sizes = []
    for _ in range(30):
        n = df.groupBy("k").agg(F.count("*").alias("n"))
        df = session.cut(df.join(n, "k").select("id", "k").unionByName(df.limit(0)))
        sizes.append(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert max(sizes) < 1 << 24


def test_sweep_removes_written_tables(spark, tmp_path):
    import os

    start = session.mark()
    kept, gone = session.cut(spark.range(3).toDF("id")), session.cut(spark.range(4).toDF("id"))
    paths = [session._written[start], session._written[start + 1]]
    assert session.sweep(spark, kept, since=start) == 1
    assert os.path.isdir(paths[0]) and not os.path.exists(paths[1]) and kept.count() == 3


def test_grown_region_and_components(spark):
    cells = spark.createDataFrame([(0, 0, 10.0), (0, 1, 5.0), (1, 2, 4.0), (3, 3, 9.0), (0, 2, 4.6)], "row long, col long, value double")
    seeds = spark.createDataFrame([(7, 0, 0)], "seed long, row long, col long")
    assert sorted((r.row, r.col) for r in grids.grown(cells, seeds, 0.45, 2.0).collect()) == [(0, 0), (0, 1), (0, 2)]
    got = grids.components(cells).groupBy("component").count().collect()
    assert sorted(r["count"] for r in got) == [1, 4]


def test_paths_between_skips_what_is_apart(spark):
    e = spark.createDataFrame([(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 1, 3, 3.0), (0, 8, 9, 1.0)], "g int, a long, b long, w double")
    m = spark.createDataFrame([(0, [1, 3, 8])], "g int, v array<long>")
    assert sorted(map(tuple, graphs.paths_between(e, m, "g").collect())) == [(0, 1, 2, 1), (0, 2, 3, 1)]


def test_variants_fall_back_to_the_baseline(spark):
    m = spark.createDataFrame([("baseline", 10.0, 0.5), ("a", 8.0, 0.3), ("b", 9.9, 0.5)], "name string, pressure double, recall double")
    assert {r.name: r.selected for r in trees.chosen(m, "name").collect()} == {"baseline": True, "a": False, "b": False}
    better = m.union(spark.createDataFrame([("c", 8.0, 0.46), ("d", 7.0, 0.47)], m.schema))
    assert [r.name for r in trees.chosen(better, "name").where("selected").collect()] == ["d"]


def test_geojson_keeps_all_rings(spark, tmp_path):
    shape = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"a":"1"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]],[[5.1,5],[5.2,5],[5.2,5.1],[5.1,5]]]]}}]}'
    (tmp_path / "x.json").write_text(shape)
    got = readers.geojson(spark, str(tmp_path / "x.json")).collect()
    assert sorted((r.polygon, r.ring_no, len(r.ring)) for r in got) == [(0, 0, 3), (1, 0, 3), (1, 1, 3)]


def test_verified_blobs(spark, tmp_path):
    import base64
    import hashlib

    good = base64.b64encode(hashlib.md5(b"abc").digest()).decode()
    rows = [(1, b"abc", 3, good), (2, b"abc", 4, good), (3, b"abd", 3, good), (4, None, 3, good), (5, b"abc", 3, good)]
    df = spark.createDataFrame(rows, "id int, content binary, size int, md5 string")
    got = {r.id: (r.outcome, r.path) for r in writers.verified_blobs(df, str(tmp_path)).collect()}
    h = hashlib.sha256(b"abc").hexdigest()
    path = f"{h[:2]}/{h[2:4]}/{h}.png"
    assert got == {1: ("written", path), 2: ("size", None), 3: ("md5", None), 4: ("missing", None), 5: ("written", path)}
    assert (tmp_path / path).read_bytes() == b"abc" and len(list((tmp_path / path).parent.iterdir())) == 1

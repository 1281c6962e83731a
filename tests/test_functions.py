"""Scalar functions and operators on small made-up rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import values as V
from millrace.operators import clusters, graphs, ranking, spatial, upserts
from millrace.sources import readers, writers
from millrace.streaming import control, queues


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(v for v, _ in cols.values())], ", ".join(f"{k} {t}" for k, (_, t) in cols.items()))
    return row.select(expr.alias("r")).first().r


def test_tags_keep_the_first_spelling(spark):
    tags = ["author_tag_Night_Club", "content_night club", "system_x", None, "author_tag_", "content_Horror"]
    assert one(spark, T.clean_tags(F.col("t")), t=(tags, "array<string>")) == ["Night Club", "Horror"]


def test_compose(spark):
    c = T.compose(F.col("n"), F.col("d"), F.col("t"), F.col("s"))
    kinds = {"n": "string", "d": "string", "t": "array<string>", "s": "string"}
    row = lambda *v: one(spark, c, **{k: (x, kinds[k]) for k, x in zip(kinds, v)})
    assert row("A", "d", ["x", "y"], "sea") == "A\nTags: x, y\nd\nScene: sea"
    assert row(None, " ", [], None) == " "


@pytest.mark.parametrize("raw, want", [("Big Blue World", "Big Blue"), ("World", "World"), ("a b c d e", "a b c"), (None, ""), ("Extraordinarily Longwinded Names", "Extraordinarily Longwinded…")])
def test_short_label(spark, raw, want):
    assert one(spark, T.short_label(F.col("t")), t=(raw, "string")) == want


@pytest.mark.parametrize("raw, want", [('```json\n{"label": "X"}\n```', "X"), ('[{"label": "Y"}]', "Y"), ('so: {"label": "Z"} ok', "Z"), ("plain words", "plain words")])
def test_parsed_label(spark, raw, want):
    assert one(spark, T.parsed_label(F.col("t")), t=(raw, "string")) == want


def test_urls_hashes_colours(spark):
    r = one(spark, T.file_reference(F.col("t")), t=("https://x/api/file_a-b/12/y", "string"))
    assert (r.file_id, r.version) == ("a-b", 12)
    assert one(spark, T.file_reference(F.col("t")), t=("https://x", "string")) is None
    assert one(spark, T.rgb(F.col("t")), t=("#0102ff", "string")) == [1, 2, 255]
    assert one(spark, T.rgb(F.col("t")), t=("red", "string")) == [136] * 3
    assert one(spark, T.md5_matches(F.col("b"), F.col("e")), b=(bytearray(b"a"), "binary"), e=("DMF1ucDxtqgxw5niaXcmYQ==", "string")) is True
    assert one(spark, T.md5_matches(F.col("b"), F.col("e")), b=(bytearray(b"a"), "binary"), e=("?", "string")) is False


def test_search_terms():
    assert T.search_terms("Ａbc %x_yz  q 12") == ["abc", "yz", "12"]


def test_times(spark):
    assert one(spark, V.iso_ntz(F.col("t")), t=("2024-01-02T03:04:05.5+09:00", "string")) == dt.datetime(2024, 1, 2, 3, 4, 5, 500000)
    assert one(spark, V.iso_ntz(F.col("t")), t=("soon", "string")) is None


def test_versions(spark):
    payload = '{"versions":[{"version":1},{"version":3,"deleted":true,"file":{"md5":"c"}},{"version":2,"file":{"md5":"b"}}]}'
    v = V.versions(F.col("t"))
    assert one(spark, V.last_version(v)["version"], t=(payload, "string")) == 2
    assert one(spark, V.highest_version(v)["version"], t=(payload, "string")) == 3
    assert one(spark, V.latest_usable(v)["version"], t=(payload, "string")) == 2
    assert one(spark, V.last_version(v), t=("{}", "string")) is None


def test_merge_and_discovery(spark):
    assert one(spark, upserts.is_discovery(F.col("t")), t=("{}", "string")) is True
    assert one(spark, upserts.is_discovery(F.col("t")), t=('{"name":"a","visits":3}', "string")) is False
    m = one(spark, V.merged_json(F.col("a"), F.col("b")), a=('{"x":1,"y":{"k":[1]}}', "string"), b=('{"x":"2"}', "string"))
    assert m in ('{"x":"2","y":{"k":[1]}}', '{"y":{"k":[1]},"x":"2"}')


def test_unit_of_zero(spark):
    assert one(spark, V.unit(F.col("v")), v=([0.0, 0.0], "array<double>")) == [0.0, 0.0]


def test_evenly_spaced(spark):
    rows = spark.range(1000).withColumn("k", F.lit(0))
    got = sorted(r.id for r in ranking.evenly_spaced(rows, ["k"], 7, "id").collect())
    assert got == [i * 999 // 6 for i in range(7)]


def test_components_and_forest(spark):
    v = spark.range(8).select("id")
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 5.0), (0, 2, 2.0), (5, 6, 1.0), (3, 3, 0.1)], "a long, b long, w double")
    got = dict(graphs.connected_components(v, e).collect())
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7}
    assert sorted((r.a, r.b) for r in graphs.spanning_forest(v, e).collect()) == [(0, 1), (0, 2), (5, 6)]


def test_long_path_is_one_component(spark):
    e = spark.range(60).select(((F.col("id") * 7919) % 61).alias("a"), (((F.col("id") + 1) * 7919) % 61).alias("b"))
    assert graphs.connected_components(spark.range(61), e).select("component").distinct().count() == 1


def test_nearest_against_brute_force(spark):
    x = np.random.default_rng(3).normal(size=(120, 2))
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = {(r.id, r.rank): r.other for r in spatial.nearest(p, 3, 0.1).collect()}
    assert got == {(i, k + 1): int(np.argsort(d[i], kind="stable")[k]) for i in range(120) for k in range(3)}


def test_relax_moves_apart(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.1, 0.0), (3, 9.0, 9.0)], "id long, x double, y double")
    got = {r.id: r.x for r in spatial.relax(p, 1.0, strength=1.0, steps=20).collect()}
    assert got[2] - got[1] >= 0.999 and got[3] == 9.0


def test_relax_ends_when_none_are_close(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.5, 0.0), (3, 5.0, 5.0), (4, 5.0, 5.0)], "id long, x double, y double")
    got = {r.id: (r.x, r.y) for r in spatial.relax(p, 1.0, strength=1.0, steps=4).collect()}
    assert np.hypot(*np.subtract(got[1], got[2])) >= 0.999 and np.hypot(*np.subtract(got[3], got[4])) >= 0.999
    far = spark.createDataFrame([(1, 0.0, 0.0), (2, 2.0, 0.0)], "id long, x double, y double")
    assert [(r.id, r.x) for r in spatial.relax(far, 1.0, spring=0.5).orderBy("id").collect()] == [(1, 0.0), (2, 2.0)]


def test_relax_points_has_the_steps_of_the_reference(spark, sf, monkeypatch):
    from millrace.plans import vectors

    seen = []
    monkeypatch.setattr(vectors.S, "relax", lambda p, apart, **k: seen.append(k["steps"]) or p)
    vectors.relax_points(spark, sf)
    assert seen == [40]


def test_concave_polygon(spark):
    ring = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    q = spark.createDataFrame([([{"x": float(a), "y": float(b)} for a, b in ring], x, y) for x, y in ((1.0, 1.0), (2.0, 3.0), (3.5, 3.0))], "ring array<struct<x:double,y:double>>, x double, y double")
    assert [r.c for r in q.select(spatial.contains(F.col("ring"), F.col("x"), F.col("y")).alias("c")).collect()] == [True, False, True]
    assert q.select(spatial.measures(F.col("ring")).alias("m")).first().m.area == pytest.approx(10.0)


def test_breaker():
    b = control.Breaker()
    assert [b.step(float(i), False) for i in range(5)] == ["passed"] * 5 and b.state == control.OPEN
    assert b.step(6.0, True) == "blocked"
    assert b.step(9.5, False) == "passed" and b.backoff == 10.0 and b.state == control.OPEN
    assert b.step(20.0, True) == "passed" and b.state == control.CLOSED and b.backoff == 5.0


def test_breaker_trial_comes_after_the_back_off():
    b = control.Breaker()
    for i in range(5):
        b.failed(float(i))
    assert b.wait(9.0) == 0.0 and b.state == control.OPEN and b.step(9.0, True) == "blocked"
    assert b.wait(8.0) == 1.0 and b.wait(9.1) == 0.0 and b.state == control.HALF_OPEN
    for n in range(9):
        b.failed(10.0)
        assert b.backoff == min(300.0, 5.0 * 2 ** (n + 1))
        assert b.wait(10.0 + b.backoff + 0.1) == 0.0
    b.succeeded()
    assert b.state == control.CLOSED and b.backoff == 5.0


def test_limiter_paces_and_samples():
    limit = control.Limiter(0.0, rate=2.0)
    assert limit.wait(1.0) == 0.0
    limit.sent(1, 1.0)
    assert limit.wait(1.1) == pytest.approx(0.4) and limit.wait(1.5) == 0.0
    for n, at in enumerate((1.5, 2.0, 2.5)):
        limit.sent(n + 2, at)
    for n, at in enumerate((2.6, 2.7, 2.8, 2.9)):
        limit.succeeded(n + 1, at)
    assert limit.latency.value == pytest.approx(0.4)  # the last call: 2.5 to 2.9
    assert limit.rate == pytest.approx(4 / 2.9)  # four answers since the last call was sent, over the time since the answer before it


def test_limiter_window_is_a_maximum_that_expires():
    best = control.Best(2.0, 1, 10.0)
    for at, x in ((0.0, 5.0), (1.0, 3.0), (9.0, 4.0)):
        best.add(x, at)
    assert best.value == 5.0
    best.add(1.0, 10.5)
    assert best.value == 4.0
    least = control.Best(0.5, -1)
    least.add(0.3, 0.0)
    least.add(0.9, 1.0)
    assert least.value == 0.3


def test_limiter_error_holds_until_the_next_turn():
    limit = control.Limiter(0.0, rate=10.0)
    limit.sent(1, 0.0)
    limit.failed(1, 0.1)
    assert limit.rate == pytest.approx(9.0) and limit.state == control.CRUISE
    limit.wait(5.0)
    assert limit.state == control.CRUISE
    limit.wait(5.1)
    assert limit.state == control.UP and limit.rate == 10.0
    limit.sent(2, 5.1)
    limit.failed(2, 5.2)
    assert limit.state == control.DOWN and limit.rate == pytest.approx(8.0)
    limit.wait(10.3)
    assert limit.state == control.CRUISE and limit.rate == 10.0
    for n in range(100):
        limit.failed(n, 10.4)
    assert limit.rate == limit.floor


def test_limiter_holds_calls_under_way():
    limit = control.Limiter(0.0, rate=1.0)
    for n in range(8):
        assert limit.wait(n * 2.0 + 2) == 0.0
        limit.sent(n, n * 2.0 + 2)
    assert limit.wait(18.0) == pytest.approx(limit.latency.value / 2)
    limit.succeeded(0, 18.0)
    assert len(limit.flying) == 7


def test_gate_asks_the_breaker_first():
    calls = [(float(i), False, 0.0) for i in range(5)] + [(5.0, True, 0.0), (9.5, True, 0.0), (9.6, True, 0.0)]
    got = [(fate, state) for fate, _, state, _, _ in control.gated(iter(calls))]
    assert got[:4] == [("passed", control.CLOSED)] * 4 and got[4] == ("passed", control.OPEN)
    assert got[5] == ("blocked", control.OPEN) and got[6:] == [("passed", control.CLOSED)] * 2
    late = [(0.0, True, 3.0), (1.0, True, 0.5)]
    assert [g[0] for g in control.gated(iter(late))] == ["passed", "passed"]


def test_routing(spark):
    rows = [("ok", None), ("http", 429), ("http", 404), ("http", 401), ("http", 503), ("timeout", None), ("auth", None), ("odd", None)]
    got = spark.createDataFrame(rows, "kind string, status int").select("kind", "status", control.routing(F.col("kind"), F.col("status")).alias("r")).collect()
    assert {(r.kind, r.status): tuple(r.r) for r in got} == {
        ("ok", None): ("success", "success", False), ("http", 429): ("error", "error", False), ("http", 404): ("success", "none", False),
        ("http", 401): ("success", "none", False), ("http", 503): ("error", "error", False), ("timeout", None): ("error", "error", False),
        ("auth", None): ("error", "error", True), ("odd", None): ("error", "none", False),
    }


def test_stream_breaker_equals_replay(spark, tmp_path):
    log = [(k, float(i), (i * 7 + k) % 5 == 0) for k in (1, 2) for i in range(60)]
    for part in range(3):
        spark.createDataFrame([r for r in log if int(r[1]) // 20 == part], "key long, ts double, ok boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = queues.read_files(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    got = []
    control.stream_breaker(stream).writeStream.foreachBatch(lambda b, n: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert len(got) == 120
    want = control.replay(spark.createDataFrame(log, "key long, ts double, ok boolean")).select("key", "ts", "fate", "state").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_geojson_round_trip(spark, tmp_path):
    ring = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}]
    df = spark.createDataFrame([(7, ring)], "id int, ring array<struct<x:double,y:double>>")
    writers.feature_collection(df, "ring", "id").coalesce(1).write.text(str(tmp_path / "g"))
    r = readers.geojson(spark, str(tmp_path / "g")).first()
    assert r.properties["id"] == "7" and [(p.x, p.y) for p in r.ring] == [(0, 0), (1, 0), (1, 1)]


def test_layers_ids_counts(spark, tmp_path):
    for i in (2, 10):
        spark.range(i).coalesce(1).write.parquet(str(tmp_path / f"layer_{i}.parquet"))
    got = readers.layers(spark, str(tmp_path / "layer_*.parquet")).groupBy("layer").count().orderBy("layer").collect()
    assert [tuple(r) for r in got] == [(2, 2), (10, 10)]
    (tmp_path / "ids.txt").write_text(" wrld_1 \nother\nwrld_1\nwrld_2\n")
    assert readers.ids(spark, str(tmp_path / "ids.txt"), "wrld_").count() == 2
    assert writers.parquet(spark.range(9), str(tmp_path / "out")) == 9


def lloyd(x, k, rounds=50):
    """Deterministic k-means: farthest-first seeds from the point nearest the mean; labels by size, ties by first member."""
    at = [int(((x - x.mean(0)) ** 2).sum(1).argmin())]
    d = ((x - x[at[0]]) ** 2).sum(1)
    while len(at) < k and d.max() > 0:
        at.append(int(d.argmax()))
        d = np.minimum(d, ((x - x[at[-1]]) ** 2).sum(1))
    c = x[at]
    label = None
    for _ in range(rounds):
        new = ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
        if label is not None and (new == label).all():
            break
        label = new
        c = np.stack([x[label == i].mean(0) if (label == i).any() else c[i] for i in range(len(c))])
    kinds, first, n = np.unique(label, return_index=True, return_counts=True)
    order = sorted(range(len(kinds)), key=lambda i: (-n[i], first[i]))
    return np.array([{int(kinds[o]): r for r, o in enumerate(order)}[int(v)] for v in label])


def test_kmeans_of_all_parents_at_once(spark):
    rng = np.random.default_rng(8)
    rows = [(p, i, rng.normal(size=5).round(6).tolist()) for p, n in ((0, 57), (1, 9), (2, 1), (3, 120)) for i in range(n)] + [(4, i, [1.0] * 5) for i in range(30)]
    rng.shuffle(rows)
    got = {}
    df = spark.createDataFrame([(int(p), int(i), v) for p, i, v in rows], "p int, i int, f array<double>").repartition(5)
    for r in clusters.subdivide(df, "p", "i", "f", 10, 4, 6).collect():
        got.setdefault(r.p, {})[r.i] = r.child
    for p in range(5):
        own = sorted((i, v) for q, i, v in rows if q == p)
        n = len(own)
        k = max(1, min(round(n / 10), 6, n // 4))
        assert [got[p][i] for i, _ in own] == lloyd(np.array([v for _, v in own]), k).tolist()


def test_kmeans_hierarchy_uses_all_components(spark, tmp_path):
    from millrace.plans.vectors import kmeans_hierarchy

    rows = [(i, 0, [0.0] * 63 + [100.0 * (i % 2) + i / 1000]) for i in range(80)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    side: dict[str, set[int]] = {}
    for r in kmeans_hierarchy(spark, str(tmp_path)).collect():
        side.setdefault(r.parent, set()).add(r.id % 2)
    assert len(side) == 2 and all(len(s) == 1 for s in side.values())


def test_matching_is_optimal():
    from itertools import permutations

    from millrace.operators import layout

    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (3, 5), (5, 5), (4, 6)):
        cost = rng.random((n, m))
        got = layout.matching(cost)
        assert len(set(got.tolist())) == n
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(m), n))
        assert cost[np.arange(n), got].sum() == pytest.approx(best)


def test_slots_are_optimal_in_groups_of_hundreds(spark):
    from millrace.operators import layout

    x, y = np.random.default_rng(6).random((2, 250, 2))
    rows = lambda a: [(0, i, float(p), float(q)) for i, (p, q) in enumerate(a)]
    points = spark.createDataFrame(rows(x), "label int, id long, x double, y double")
    slots = spark.createDataFrame(rows(y), "label int, slot long, x double, y double")
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    best = d[np.arange(250), layout.matching(d)].sum()
    assert best < 0.95 * d[np.arange(250), layout.greedy_matching(d)].sum()
    got = layout.assign_slots(points, slots, "label").collect()
    assert len({r.slot for r in got}) == 250 and sum(r.moved for r in got) == pytest.approx(best)


def test_parcels_and_outlines():
    from millrace.operators import layout

    parts = layout.subdivide(np.array([(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)]), 1.1)
    assert len(parts) == 8 and all(layout.shoelace(p) == pytest.approx(1.0) for p in parts)
    ring = {(r, c) for r in range(3) for c in range(3)} - {(1, 1)}
    got = layout.boundary_rings(ring)
    assert sorted(len(r) for r in got) == [4, 4]


def test_thinning_is_the_greedy_walk(spark):
    from millrace.operators import layout

    x = [(0.0, 0.0, 1.0), (0.5, 0.0, 5.0), (2.0, 0.0, 1.0), (2.1, 0.0, 1.0), (0.9, 0.0, 0.0), (1.6, 0.0, 0.5)]
    p = spark.createDataFrame([(0, i, *v) for i, v in enumerate(x)] + [(1, 9, 0.5, 0.0, 0.0)], "g int, id int, x double, y double, priority double")
    assert sorted(map(tuple, layout.thin(p, "g", 1.0).collect())) == [(0, 1), (0, 2), (1, 9)]


def test_rasters(spark):
    from millrace.operators import grids, raster

    h = np.array([[3.0, 3.0, 3.0], [2.0, 1.0, 2.0], [3.0, 0.0, 3.0]])
    f = raster.flow(h)
    assert f[2, 1] == 9.0 and f[0, 0] == 1.0
    wall = np.ones((5, 5))
    wall[2, :4] = np.inf
    d, path = raster.least_path(wall, (0, 0), (4, 0))
    assert path[0] == (0, 0) and path[-1] == (4, 0) and (2, 4) in path and d == pytest.approx(2 * (2 * 2**0.5 + 2))
    assert raster.least_path(np.array([[1.0, np.inf, 1.0]]), (0, 0), (0, 2)) == (float("inf"), [])
    row = spark.createDataFrame([(0, 0, c, v) for c, v in enumerate([5.0, 1.0, 4.0, 0.0, 0.0, 3.0])], "t int, row long, col long, v double")
    assert sorted((r.row, r.col) for r in grids.peaks(row, "t", "v", 3.0, 0.5).collect()) == [(0, 0), (0, 5)]

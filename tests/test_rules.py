"""Rules on hand-made tables: each case of a rule once."""

import base64
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import values as V
from millrace.operators import layout, spatial, upserts


def column(spark, rows, schema, expr):
    return [r.out for r in spark.createDataFrame(list(enumerate(rows)), f"n int, c struct<{schema}>").select("n", "c.*").select("n", expr.alias("out")).orderBy("n").collect()]


def test_file_references(spark):
    urls = [
        "https://api.example/api/1/file/file_0a1b-2c3d/2/file", "https://api.example/api/1/image/file_0a1b-2c3d/3/256", "https://files.example/file_ff_9/17/world.bin",
        "https://api.example/api/1/file/file_0a1b-2c3d/x/file", "https://api.example/none", "", None,
    ]
    got = column(spark, [(u,) for u in urls], "u:string", T.file_reference(F.col("u")))
    assert [None if r is None else (r.file_id, r.version) for r in got] == [("0a1b-2c3d", 2), ("0a1b-2c3d", 3), ("ff_9", 17), None, None, None, None]


def test_verification_goes_by_size_then_md5_then_collision(spark):
    body, md5 = b"abc", base64.b64encode(hashlib.md5(b"abc").digest()).decode()
    digest = hashlib.sha256(body).hexdigest()
    rows = [(body, 4, "bad", None), (body, 3, "bad", "0"), (body, 3, md5, "0" * 64), (body, 3, md5, digest), (body, 3, md5, None)]
    size, own = F.octet_length("b"), F.sha2("b", 256)
    out = T.verification(size, F.col("size"), T.md5_matches(F.col("b"), F.col("md5")), F.col("known"), own)
    got = column(spark, [(bytearray(b), *rest) for b, *rest in rows], "b:binary,size:int,md5:string,known:string", out)
    assert got[0] != got[1] != got[2] != got[3] and len({got[0], got[1], got[2]}) == 3 and got[0].lower().startswith("size") and "md5" in got[1].lower()


def test_labels_on_messy_input(spark):
    raw = ['  "Neon, City" ', "District 7", "and", "a\tb\nc", "", None, "One Two Three Four Five Six", "'Quiet — Garden'", "misc;", "x" * 40]
    got = column(spark, [(r,) for r in raw], "r:string", T.clean_label(F.col("r"), F.lit("Fallback")))
    assert got == ["Neon City", "Fallback", "Fallback", "a b c", "Fallback", "Fallback", "One Two Three Four", "Quiet — Garden", "Fallback", "x" * 32]
    assert column(spark, [("Big-Blue  World!",)], "r:string", T.label_key(F.col("r"))) == ["big blue world"]
    assert column(spark, [("Misc",), ("Harbour",), ("",), ("District 12",), ("District 12 North",), ("- -",)], "r:string", T.bad_label(F.col("r"))) == [True, False, True, True, False, True]


def test_payloads_without_versions(spark):
    rows = ['{"versions":[]}', "{", None, '{"versions":[{"version":5,"deleted":true,"file":{"md5":"a"}}]}', '{"versions":[{"version":2},{"version":1,"file":{"md5":"b"}}]}']
    v = V.versions(F.col("p"))
    pick = lambda e: column(spark, [(r,) for r in rows], "p:string", e)
    assert pick(V.last_version(v)["version"]) == [None, None, None, 5, 1]
    assert pick(V.highest_version(v)["version"]) == [None, None, None, 5, 2]
    assert pick(V.latest_usable(v)["version"]) == [None, None, None, None, 1]
    assert pick(V.first_with(v, F.lit(1))["version"]) == [None, None, None, None, 1]


def test_small_values(spark):
    one = lambda e: spark.range(1).select(e.alias("r")).first().r
    assert [one(V.clamp(F.lit(x), 0.0, 1.0)) for x in (-1.0, 0.4, 7.0)] == [0.0, 0.4, 1.0]
    assert [one(V.child_count(F.lit(n), 4, 3, 6)) for n in (1, 6, 10, 40)] == [1, 2, 2, 6]  # halves to even
    assert one(V.names_path(F.array(F.lit("a"), F.lit("a"), F.lit(None), F.lit("b"), F.lit("a")))) == ["a", "b", "a"]
    ring = one(V.zipped_ring(F.array(*map(F.lit, (1.0, 2.0, 3.0))), F.array(*map(F.lit, (4.0, 5.0, 6.0, 7.0)))))
    assert [tuple(p) for p in ring] == [(1.0, 4.0), (2.0, 5.0), (3.0, 6.0)]
    assert one(V.zipped_ring(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(2.0)))) is None
    c = one(V.connection(F.lit("mysql+aiomysql://me:pw@db.example/store?x=1")))
    assert c.url == "jdbc:mysql://db.example:3306/store" and "user=me passwd=pw database=store" in c.attach
    assert one(V.json_list(F.lit("[1, \"a\", null]"))) == ["1", "a", None] and one(V.json_list(F.lit("{}"))) is None
    draw = [one(T.massing(F.lit(k), "h:", 12)) for k in "abc"]
    assert draw == [int.from_bytes(hashlib.sha256(f"h:{k}".encode()).digest()[:8], "big") % 12 for k in "abc"]
    assert [one(T.typology(F.lit(a), F.lit(b), F.lit(n), 2000.0)) for a, b, n in ((True, 1.0, 1), (False, 4000.0, 2), (False, 4000.0, 3), (False, 2000.0, 0))] == ["landmark", "detached", "row", "detached"]


def test_parcels_of_convex_rings(spark):
    rng = np.random.default_rng(7)
    rings = [layout.hull(rng.normal(size=(12, 2))) for _ in range(4)]
    rows = [(i, [{"x": float(x), "y": float(y)} for x, y in r]) for i, r in enumerate(rings)]
    got = layout.parcels(spark.createDataFrame(rows, "k int, ring array<struct<x:double,y:double>>"), "k", 0.3).collect()
    for k, r in enumerate(rings):
        own = [p for p in got if p.k == k]
        assert sum(p.area for p in own) == pytest.approx(layout.shoelace(r)) and max(p.area for p in own) <= 0.3
        assert sorted(p.parcel for p in own) == list(range(len(own)))
        for p in own:  # halves of halves: no parcel is less than half of the bound
            assert p.area > 0.15 - 1e-9 or len(own) == 1


def test_outlines_with_holes_and_corners(spark):
    ring = [(r, c) for r in range(5) for c in range(5) if (r, c) not in {(1, 1), (3, 3)}]
    corner = [(10, 10), (11, 11)]
    cells = spark.createDataFrame([(1, r, c) for r, c in ring] + [(2, r, c) for r, c in corner], "region int, row long, col long")
    got = layout.region_polygons(cells, "region", 2.0).withColumn("a", spatial.area2(F.col("ring")) / 2).collect()
    assert sorted(round(r.a, 6) for r in got if r.region == 1) == [-4.0, -4.0, 100.0]
    assert sum(r.a for r in got if r.region == 2) == pytest.approx(8.0)


def test_quads_keep_their_area_when_turned(spark):
    rows = [(i, 1.0, 2.0, i * math.pi / 7, 3.0, 0.5) for i in range(8)]
    df = spark.createDataFrame(rows, "id int, x double, y double, angle double, w double, h double").withColumn("ring", layout.quad("x", "y", "angle", "w", "h"))
    for r in df.withColumn("m", spatial.measures(F.col("ring"))).collect():
        assert r.m.area == pytest.approx(1.5) and r.m.perimeter == pytest.approx(7.0)
        assert np.mean([p.x for p in r.ring]) == pytest.approx(1.0) and np.mean([p.y for p in r.ring]) == pytest.approx(2.0)


def test_measures_of_known_polygons(spark):
    shapes = [[(0, 0), (4, 0), (0, 3)], [(0, 0), (0, 3), (4, 0)], [(0, 0), (2, 0), (2, 2), (1, 1), (0, 2)]]
    rows = [([{"x": float(x), "y": float(y)} for x, y in s],) for s in shapes]
    got = column(spark, rows, "ring:array<struct<x:double,y:double>>", spatial.measures(F.col("ring")))
    assert [r.area for r in got] == [6.0, 6.0, 3.0] and got[0].perimeter == got[1].perimeter == 12.0
    assert got[0].compactness == pytest.approx(4 * math.pi * 6 / 144)


def test_pending_images_wait_for_their_file(spark):
    files = spark.createDataFrame([(1, "SUCCESS"), (2, "PENDING"), (3, "ERROR")], "file_id int, status string")
    images = spark.createDataFrame([(1, 1, "PENDING"), (1, 2, "CONFIRMED"), (2, 1, "PENDING"), (3, 1, "PENDING"), (4, 1, "PENDING")], "file_id int, version int, state string")
    assert [(r.file_id, r.version) for r in upserts.pending_images(files, images).collect()] == [(1, 1)]


def test_discoveries_do_not_replace_details(spark):
    at = "2024-01-02 00:00:00"
    current = spark.sql(f"SELECT 'a' id, '{{\"name\":\"old\",\"visits\":3}}' payload, 'SUCCESS' status, TIMESTAMP_NTZ'{at}' last_scrape UNION ALL SELECT 'b', '{{}}', 'DELETED', NULL")
    batch = spark.createDataFrame([
        ("a", 1, '{"name":"new","updated_at":"2024-01-01T00:00:00Z"}', "PENDING"), ("a", 2, '{"name":"newer","updated_at":"2024-01-03T00:00:00Z"}', "PENDING"),
        ("b", 1, '{"visits":1}', "SUCCESS"), ("c", 1, '{"name":"c"}', None),
    ], "id string, seq long, payload string, status string")
    got = {r.id: r for r in upserts.upsert(current, batch).collect()}
    assert '"visits":3' in got["a"].payload and '"name":"newer"' in got["a"].payload and got["a"].status == "PENDING"
    older = {r.id: r.status for r in upserts.upsert(current, batch.where("seq = 1 AND id = 'a'")).collect()}
    assert older["a"] == "SUCCESS" and got["b"].status == "SUCCESS" and got["b"].payload == '{"visits":1}' and got["c"].status == "PENDING"
    assert {r.id for r in upserts.upsert(current, batch.limit(0)).collect()} == {"a", "b"}

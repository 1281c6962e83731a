"""The stages on a small corpus, and the registered queries against SQL."""

import os

import duckdb
import pytest

import corpus_pipeline
from millrace.llm import queries
from millrace.llm.neardup import near_duplicates
from tests.llm.test_operators import ROWS, SCHEMA


def test_stages(spark, sf):
    docs = spark.createDataFrame(ROWS, SCHEMA).cache()
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language_id"](spark, docs, sf)
    ids = {r.doc_id for r in one.collect()}
    assert one.columns == docs.columns
    assert ids >= {r[0] for r in ROWS if r[2] and r[1] and len(r[1]) > 100} and all(any(c.isalpha() for c in ROWS[i][1]) for i in ids)
    two = stages["near_dedup"](spark, docs, sf)
    classes = dict(near_duplicates(docs).collect())
    assert sorted(r.doc_id for r in two.collect()) == sorted(set(classes.values()))
    three = stages["secret_scan"](spark, docs, sf)
    assert three.count() == len(ROWS) and three.columns == docs.columns
    four = stages["mix_sources"](spark, docs, sf)
    assert four.columns == docs.columns and 0 < four.count() <= len(ROWS)
    assert stages["tokenise"](spark, docs, sf).count() == len(ROWS)


def test_near_dedup_keeps_rows_without_id(spark, sf):
    one, two, three = ("".join(f" {w}{i}" for i in range(60)) for w in ("red", "green", "blue"))
    rows = [(1, one, "en", "a", 5), (2, one, "en", "b", 5), (None, two, "en", "a", 5), (None, two, "en", "a", 5), (None, three, "en", "a", 5), (None, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = corpus_pipeline.near_dedup(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, one), (None, two), (None, three), (None, None)], key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.execute(f"create view {t} as select * from '{os.path.join(sf, t)}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rel = c.execute(queries.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    assert sorted(tuple(r[x] for x in columns) for r in df.collect()) == sorted(tuple(dict(zip(names, r))[x] for x in columns) for r in rel.fetchall())


def test_near_dedup_keeps_one_row_of_a_repeated_document(spark, sf):
    one, two = ("".join(f" {w}{i}" for i in range(60)) for w in ("red", "green"))
    rows = [(1, one, "en", "a", 5), (1, one, "en", "a", 5), (1, one, "de", "a", 5), (2, one, "en", "b", 5), (3, two, "en", "a", 5)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), sf)
    assert sorted((r.doc_id, r.lang) for r in got.collect()) == [(1, "de"), (3, "en")]


def test_near_dedup_takes_any_columns(spark, sf):
    one, two = ("".join(f" {w}{i}" for i in range(60)) for w in ("red", "green"))
    rows = [(1, one, {"k": 1}, 7, "x"), (1, one, {"k": 2}, 6, "x"), (None, two, {"k": 3}, 1, None), (None, two, None, 2, None), (2, two, None, 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n map<string,int>, class_id int, same string")
    got = corpus_pipeline.near_dedup(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.class_id) for r in got.collect()), key=str) == [(1, 6), (2, 3), (None, 1)]
    bare = corpus_pipeline.near_dedup(spark, docs.select("text", "doc_id"), sf)
    assert bare.columns == ["text", "doc_id"] and bare.count() == 3
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), sf).count() == 0


def test_language_id_rejects_only_long_texts_like_no_language(spark, sf):
    import random

    rng = random.Random(2)
    known = [(i, " ".join(rng.choice("the and of to in was that for".split()) for _ in range(40)), "en", "s", 1) for i in range(40)]
    greek = [(100 + i, " ".join("".join(rng.choice("αβγδεζηθικλμ") for _ in range(6)) for _ in range(40)), None, "s", 1) for i in range(20)]
    rows = known + greek + [(200, "the", None, "s", 1), (201, None, "en", "s", 1), (202, "12 !!", "en", "s", 1)]
    got = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, spark.createDataFrame(rows, SCHEMA), sf).collect()}
    assert all(got.get(i) == "en" for i, *_ in known) and got.get(200) == "en"
    assert 201 not in got and 202 not in got and sum(i in got for i, *_ in greek) <= 2


def test_op4_columns_against_brute_force(spark, sf):
    import hashlib
    import re

    patterns = [
        ("assign", re.compile(r"""(?a)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I), 2, 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32),
    ]
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = queries.QUERIES["op4_secrets"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = sorted((m.start(), n, f"{kind}:{m.start()}:{m.end()}") for n, (kind, p, g, least) in enumerate(patterns) for m in p.finditer(texts[r.doc_id] or "") if len(m[g]) >= least)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(s for *_, s in spans).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("crf")] == [s for *_, s in spans]


def test_op2_holds_out_and_learns_from_the_rest(spark, sf):
    import zlib

    got = queries.QUERIES["op2_language_id"](spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got) and len(got) == len(docs)
    held = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_op10_against_independent_raking(spark, sf):
    import hashlib
    from collections import defaultdict

    from millrace.llm import mixing

    got = queries.QUERIES["op10_mixing"](spark, sf).collect()
    cells = defaultdict(float)
    for r in got:
        cells[(r.source, r.lang, r.topic)] += r.tokens
    total = sum(cells.values())
    w = {k: x / total for k, x in cells.items() if x}
    goals = []
    for n, axis in enumerate(("source", "lang", "topic")):
        sums = defaultdict(float)
        for k, x in cells.items():
            sums[k[n]] += x
        power = {v: x ** mixing.TEMPERATURE[axis] for v, x in sums.items() if x}
        goals.append({v: x / sum(power.values()) for v, x in power.items()})
    for _ in range(300):
        for n, goal in enumerate(goals):
            sums = defaultdict(float)
            for k, x in w.items():
                sums[k[n]] += x
            w = {k: x * goal[k[n]] / sums[k[n]] for k, x in w.items()}
    ratio = {k: w[k] * total / cells[k] for k in w}
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(1, mid * r) * cells[k] for k, r in ratio.items()) < mixing.KEEP * total else (lo, mid)
    for r in got:
        want = min(1.0, hi * ratio[(r.source, r.lang, r.topic)]) if r.tokens else r.p
        assert r.p == pytest.approx(want, abs=1e-5)
        u = int(hashlib.md5(f"0|{r.doc_id}".encode()).hexdigest()[:8], 16) / 2**32
        assert abs(u - r.p) < 1e-6 or r.kept == (u < r.p)


def test_run_removes_tables_between_stages(spark, sf):
    from millrace import session

    before = session.mark()
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert session.mark() - before <= 1

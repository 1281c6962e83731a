"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows over terms (here: components), weights are integers.
Candidates are dealt into blocks. Within a block their postings are laid out by
term; a block of query rows takes the terms in turn and adds query weight times
posting weight into dense score arrays, one a query. Each block yields its best
k by partition selection, and the blocks' winners are merged.

Candidate blocks and query blocks meet pairwise, each pair in a task of its own
that holds ``CANDIDATES`` postings rows and ``QUERIES`` score arrays whatever
the size of the tables: rows of both sides are copied to the blocks they meet.
Only block counts go to the driver and nothing is broadcast, as queries grow
with the table. The work is the product that an exhaustive search asks for.

Contract of weights: floor(256 * x) of each component, as double. Scores are
sums of products in int64.

Defined results: vectors that are null, empty or hold a null or non-finite
component take no part, nor do rows with a null id; ties go to the smaller id;
a query isn't its own candidate, and neither is another row with its id;
queries with the same id are one query (the row that is first by vector);
repeated candidate rows each count (k of them, as more can't be among the best). Vectors of unlike length meet on the
components that both have. An empty side gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = 8192
QUERIES = 1024
SCALE = 256


def weighted(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and integer weights w of the rows that take part."""
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return rows.where(F.col(key).isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine).select(
        F.col(key).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * SCALE)).alias("w")
    )


def accumulate(ids: np.ndarray, weights: list[np.ndarray], qids: np.ndarray, queries: list[np.ndarray], k: int) -> pd.DataFrame:
    """The best k candidates of one block for each of its queries.

    Scores are exact: they are added up in int64, and the selection key orders
    by score and then by id, so that no tie is cut arbitrarily.
    """
    order = np.argsort(ids, kind="stable")
    ids, weights = ids[order], [weights[i] for i in order]
    lengths = np.array([len(w) for w in weights])
    row = np.repeat(np.arange(len(ids)), lengths)
    flat = np.concatenate(weights).astype(np.int64)
    term = np.concatenate([np.arange(n) for n in lengths])
    used = flat != 0
    row, term, flat = row[used], term[used], flat[used]
    by = np.argsort(term, kind="stable")
    row, term, flat = row[by], term[by], flat[by]
    starts = np.searchsorted(term, np.arange(term[-1] + 2 if len(term) else 1))
    scores = np.zeros((len(qids), len(ids)), np.int64)
    qlen = np.array([len(q) for q in queries])
    for t in range(len(starts) - 1):
        a, b = starts[t], starts[t + 1]
        if a == b:
            continue
        has = np.flatnonzero(qlen > t)
        if not len(has):
            break
        qw = np.array([queries[i][t] for i in has], np.int64)
        has, qw = has[qw != 0], qw[qw != 0]
        if b - a == len(ids):  # a posting for every candidate: no scatter needed
            for i, w in zip(has, qw, strict=True):
                scores[i] += w * flat[a:b]
        else:
            at, w_at = row[a:b], flat[a:b]
            for i, w in zip(has, qw, strict=True):
                scores[i, at] += w * w_at
    out = []
    for i, q in enumerate(qids):
        allowed = np.flatnonzero(ids != q)
        if not len(allowed):
            continue
        s = scores[i, allowed]
        if len(s) > k:
            least = np.partition(s, len(s) - k)[len(s) - k]
            over = np.flatnonzero(s > least)
            ties = np.flatnonzero(s == least)[: k - len(over)]  # ids ascend
            pick = np.concatenate([over, ties])
        else:
            pick = np.arange(len(s))
        out.append(pd.DataFrame({"query_id": np.full(len(pick), q), "vec_id": ids[allowed[pick]], "score": s[pick]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")


def _blocks(n: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 5,
    candidate_rows: int = CANDIDATES, query_rows: int = QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``candidates`` for each row of ``queries`` (both: id, w)."""
    queries = queries.groupBy("id").agg(F.min("w").alias("w"))
    # equal rows are counted map-side, and no more than k of them are dealt out
    alike = candidates.groupBy("id", "w").agg(F.count("*").alias("n"))
    candidates = alike.select("id", "w", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)))).alias("copy"))
    ncand = max(1, math.ceil(candidates.count() / candidate_rows))
    nquery = max(1, math.ceil(queries.count() / query_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = candidates.withColumn("cb", _blocks(ncand, "id", "w", "copy")).drop("copy").withColumn("qb", every(nquery))
    q = queries.withColumn("qb", _blocks(nquery, "id")).withColumn("cb", every(ncand))

    def search(cs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if not len(cs) or not len(qs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return accumulate(cs["id"].to_numpy(), list(cs["w"]), qs["id"].to_numpy(), list(qs["w"]), k)

    best = c.groupBy("cb", "qb").cogroup(q.groupBy("cb", "qb")).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Near-duplicate classes by DartMinHash and a banded join.

Signature. Each element of a document (a run of five words) owns a strip of the
plane as wide as its weight, and hashed darts fall on it: a cell (element, unit
of weight, unit of rank) has a Poisson number of them, the same wherever the
element occurs. A dart inside the weight hits one of ``BANDS * ROWS``
coordinates; a coordinate keeps its earliest dart, so two documents agree on a
coordinate with the probability of their weighted Jaccard similarity. Ranks are
thrown up to the bound that leaves a coordinate empty with probability below
exp(-5), and twice as far for the documents where one was. The cost is about
that of the darts kept plus the elements, not their product.

By default every distinct run weighs 1 (Jaccard similarity of sets of runs);
``weight="count"`` weighs runs by their occurrences.

Join. Documents with the same text are one from the start (the smallest doc_id
stands for them, counted map-side). The rest meet in buckets, one a band. A pair
with similarity 0.8 shares no bucket with probability (1 - 0.8**5)**32 = 3e-6.
In a bucket all members are held against its most central one, the document that
meets the most others over all buckets (for copies of one original that is most
like the original, even where the copies are less like each other); candidates
are verified exactly on their sets of runs, and links give components. Buckets
whose members are of several components after that are cut into blocks, and the
members of each two blocks are compared exactly, by products of their incidence
matrices; one link between two components is enough. So each pair that shares a
bucket is verified, or of one component anyway, and pairs are rows only in the
star around the central member.

A text set isn't shuffled: the sets of the few candidates are made in a second
pass over the documents, picked by a filter of bounded size.

Defined results: documents without a word (null, empty, white space) are copies
of each other; one with fewer than five words has one run, of all its words.
doc_id identifies a document: rows that repeat one are taken as the same
document. Rows with a null doc_id are in no class but by equal text. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import bitfilter
from millrace.llm.textkit import Words, batches, combine, mix64, seeded, sent_in_parts
from millrace.session import cut, materialise

RUN = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
#: Members of a block, and columns of one product, where a bucket is compared block by block.
BLOCK, COLUMNS = 256, 4096
#: Cells (element, unit of weight) that darts are thrown on at a time.
CELLS = 1 << 18
#: Inverse distribution function of the number of darts in a cell.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])
_C = seeded(7, 8)


def elements(texts: list[str], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, occurrences) of the distinct runs of each text."""
    w = Words(texts)
    at, h = w.windows(run)
    doc = w.doc[at] if len(at) else np.zeros(0, np.int64)
    n = np.diff(w.first)
    few = np.flatnonzero((n > 0) & (n < run))
    if len(few):
        short = np.array([int(mix64(combine([w.hash[w.first[d] + k : w.first[d] + k + 1] for k in range(n[d])], 100 + int(n[d])))[0]) for d in few], np.uint64)
        doc, h = np.concatenate([doc, few]), np.concatenate([h, short])
    with np.errstate(over="ignore"):
        key = mix64(h ^ (doc.astype(np.uint64) * _C[0]))
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    return doc[first], h[first], times


def _throw(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, reach: np.ndarray, k: int, out: np.ndarray) -> None:
    """Darts up to rank ``reach[owner]`` on the given elements; out[owner, coordinate] keeps the least."""
    wide = np.ceil(weight).astype(np.int64)
    whole, before = int(wide.sum()), np.cumsum(wide) - wide
    for lo in range(0, whole, CELLS):
        if whole == len(wide):  # one unit each
            on, first = slice(lo, lo + CELLS), None
        else:
            nth = np.arange(lo, min(whole, lo + CELLS))
            on = np.searchsorted(before, nth, side="right") - 1
            first = nth - before[on]
        o, e, w = owner[on], h[on], weight[on]
        high = np.ceil(reach[o]).astype(np.int64)
        rep = np.repeat(np.arange(len(o)), high)
        rank = np.arange(len(rep)) - np.repeat(np.cumsum(high) - high, high)
        with np.errstate(over="ignore"):
            place = e[rep] + rank.astype(np.uint64) * _C[1]
            cell = mix64(place if first is None else place + first[rep].astype(np.uint64) * _C[2])
            darts = np.searchsorted(_POISSON, (cell >> np.uint64(11)).astype(np.float64) / 2.0**53)
            rep2 = np.repeat(np.arange(len(rep)), darts)
            nth2 = np.arange(len(rep2)) - np.repeat(np.cumsum(darts) - darts, darts)
            dart = mix64(cell[rep2] + (nth2 + 1).astype(np.uint64) * _C[3])
            at = mix64(dart ^ _C[4])
        who, r = rep[rep2], rank[rep2]
        fraction = (dart >> np.uint64(16)).astype(np.float64) / 2.0**48
        ok = (r + fraction < reach[o[who]]) & ((0 if first is None else first[who]) + (at >> np.uint64(32)).astype(np.float64) / 2.0**32 < w[who])
        coordinate = (at & np.uint64(0xFFFFFFFF)) % np.uint64(k)
        value = (r.astype(np.uint64) << np.uint64(48)) | (dart >> np.uint64(16))
        np.minimum.at(out, (o[who[ok]], coordinate[ok].astype(np.int64)), value[ok])


def signatures(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, k: int = BANDS * ROWS) -> np.ndarray:
    """n x k earliest darts; rows without elements stay at the largest value."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((n, k), empty, np.uint64)
    mass = np.bincount(owner, weights=weight, minlength=n)
    reach = np.where(mass > 0, k * (math.log(k) + 5) / np.maximum(mass, 1e-300), 0.0)
    todo = mass > 0
    while todo.any():
        on = todo[owner]
        _throw(owner[on], h[on], weight[on], reach, k, out)
        todo &= (out == empty).any(axis=1)
        reach = reach * 2
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sig.shape[1] // bands
    return np.stack([mix64(combine([sig[:, b * rows + r] for r in range(rows)], 1000 + b)) for b in range(bands)], axis=1)


def signed(docs: DataFrame, run: int, weight: str) -> DataFrame:
    """doc_id, same (equal for equal texts), keys (one a band) of every row."""

    def go(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            ids, at = b.column(0), 0
            for _, texts in batches((t or "" for t in b.column(1).to_pylist()), 256):
                owner, h, times = elements(texts, run)
                w = np.ones(len(h)) if weight == "set" else times.astype(np.float64)
                keys = band_keys(signatures(owner, h, w, len(texts))).view(np.int64)
                some = np.bincount(owner, minlength=len(texts)) > 0
                same = [hashlib.md5(t.encode("utf-8", "surrogatepass") if s else b"").digest() for t, s in zip(texts, some, strict=True)]
                flat = pa.array(keys[some].ravel(), pa.int64())
                offsets = pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(texts)), pa.array(same, pa.binary()), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "same", "keys"]
                )
                at += len(texts)

    return sent_in_parts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(go, "doc_id long, same binary, keys array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, run: int, weight: str) -> DataFrame:
    """id, runs of the documents whose id is in ``ids``, and of few others; counted runs are numbered, so sets do for both weights."""
    picked = bitfilter.build(ids.select(F.xxhash64("id").alias("h")), bitfilter.size_for(ids.count()))
    shared = docs.sparkSession.sparkContext.broadcast(picked)  # 2 ** bitfilter.MOST_BITS bits at most

    def go(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            b = b.filter(pa.array(bitfilter.passes(shared.value, b.column(2).to_numpy())))
            at = 0
            for _, texts in batches((t or "" for t in b.column(1).to_pylist()), 256):
                owner, h, times = elements(texts, run)
                if weight == "count":
                    nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                    with np.errstate(over="ignore"):
                        owner, h = np.repeat(owner, times), mix64(np.repeat(h, times) + nth.astype(np.uint64) * _C[5])
                order = np.argsort(owner, kind="stable")
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]), pa.int32())
                runs = pa.ListArray.from_arrays(offsets, pa.array(h[order].view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), runs], ["id", "runs"])
                at += len(texts)

    rows = sent_in_parts(docs).where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text")
    return rows.withColumn("h", F.xxhash64("id")).mapInArrow(go, "id long, runs array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are at least so similar; first met on a, which may be in many pairs."""
    x = sets.select(F.col("id").alias("a"), F.col("runs").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("runs").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    whole = F.size("x") + F.size("y") - common
    both = pairs.join(x, "a").join(y, "b")
    return both.where((whole > 0) & (common >= F.lit(similarity) * whole)).select("a", "b").distinct()


def common_runs(runs: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a block, by products of slices of their incidence matrix."""
    size = np.array([len(r) for r in runs])
    kinds, place, times = np.unique(np.concatenate(runs), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(runs)), size)
    some = times[place] > 1
    number = np.cumsum(times > 1) - 1
    row, column = row[some], number[place[some]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(runs), len(runs)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [at, at + COLUMNS])
        m = np.zeros((len(runs), COLUMNS), np.float32)
        m[row[i:j], column[i:j] - at] = 1
        out += m @ m.T
    out[np.arange(len(runs)), np.arange(len(runs))] = size
    return out


def block_links(mixed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between members of a bucket with other labels, one for two labels and block.

    A bucket is dealt by hash into blocks of about ``BLOCK`` members, and each two
    blocks meet in a place of their own, so a task holds two blocks whatever the
    bucket, and nothing numbers a bucket in one place; no pair becomes a row
    unless it is a link.
    """
    size = mixed.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    cut_up = mixed.join(size, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    met = cut_up.withColumn("other", other).select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "id", "label")
    rows = met.join(sets, "id").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").select("key", "p", "q", "id", "label", "runs")

    def links(held: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
        label = np.array([x[1] for x in held])
        if (label == label[0]).all():
            return []
        common = common_runs([x[2] for x in held])
        size = np.diag(common)
        ok = (common >= similarity * (size[:, None] + size[None, :] - common)) & (label[:, None] < label[None, :]) & (common > 0)
        i, j = np.nonzero(ok)
        found = {(int(label[x]), int(label[y])): (held[x][0], held[y][0]) for x, y in zip(i.tolist(), j.tolist(), strict=True)}
        return list(found.values())

    def go(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        at, out = None, []
        for b in batches_in:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                places = list(zip(*(part.column(c).to_pylist() for c in range(3)), strict=True))
                ids, labels = part.column(3).to_pylist(), part.column(4).to_pylist()
                for k, place in enumerate(places):
                    if place != at:
                        out += links(held) if held else []
                        held, at = [], place
                    held.append((ids[k], labels[k], part.column(5)[k].values.to_numpy()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])
                out = []
        out = links(held) if held else []
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return rows.mapInArrow(go, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, label (smallest id of its component) of every end of the links (a, b), by alternating large and small stars."""
    state = None
    e = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        e = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("label")).union(e.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, run: int = RUN, weight: str = "set") -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class) of every row of ``docs``."""
    sig = materialise(signed(docs, run, weight), "dart-signatures")
    copies = sig.groupBy("same").agg(F.min("doc_id").alias("id"))
    reps = sig.select("doc_id", "keys").join(copies.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    rows = reps.select(F.col("doc_id").alias("id"), F.explode("keys").alias("key")).distinct()
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialise(rows.join(shared, "key"), "dart-buckets")
    members = met.select("key", "id").join(met.groupBy("id").agg(F.sum("n").alias("c")), "id")
    first = members.groupBy("key").agg(F.max(F.struct("c", (-F.col("id")).alias("m"))).alias("f"))
    pairs = cut(
        met.select("key", "id").join(first.select("key", (-F.col("f.m")).alias("first")), "key")
        .where("id <> first").select(F.least("first", "id").alias("a"), F.greatest("first", "id").alias("b")).distinct()
    )
    sets = materialise(sets_of(docs, met.select("id").distinct(), run, weight), "dart-sets")
    labels = components(verified(pairs, sets, similarity))
    known = met.select("key", "id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = known.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    found = cut(block_links(known.join(mixed.select("key"), "key", "left_semi"), sets, similarity))
    if not found.isEmpty():
        labels = components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).union(found))
    known = copies.join(labels, "id", "left").select("same", F.coalesce("label", "id").alias("class_id"))
    # the few columns of each document meet its text's class; a hot text is split by the skew join
    return sig.select("doc_id", "same").join(known, "same").select("doc_id", "class_id")

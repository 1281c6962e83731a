"""Topics fitted to a corpus: clusters of hashed term vectors (DataFrame operations only).

A document's vector has ``DIM`` components, one a bit of its words' hashes: the
share of its distinct words that have the bit, less one half. That is a random
projection of the set of words, so documents that share vocabulary are near. The
bits are counted four to a long, each in ``FIELD`` bits of its own, and long
lists of words in stretches that no field overflows on.

Centres start from the documents with the smallest hash of their text in
``TOPICS`` classes of another hash (equal texts fall in one class, so no two
centres are the same text) and move to their documents' means, over all
documents, for at most ``ROUNDS`` rounds. Only the centres reach the driver.

Defined results: a null text, or one without a word, is ``empty``; ties go to the
centre that comes first; a corpus of fewer texts than topics has fewer topics.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM, TOPICS, ROUNDS = 16, 8, 8
FIELD, FIELDS = 16, 4
STRETCH = (1 << (FIELD - 1)) - 1
SPACE = r"[\x20\x09-\x0D]+"
EMPTY = "empty"

Centres = list[list[float]]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def vector(text: Column) -> Column:
    """The vector of a text, null where it has no word."""
    ones = F.lit(sum(1 << (FIELD * k) for k in range(FIELDS)))
    longs = DIM // FIELDS
    names = [f"f{j}" for j in range(longs)]
    none = F.struct(*[F.lit(0).cast("long").alias(n) for n in names])

    def counted(hashes: Column) -> Column:
        return F.aggregate(
            hashes, none,
            lambda a, h: F.struct(*[(a[n] + F.shiftrightunsigned(h, j).bitwiseAND(ones)).alias(n) for j, n in enumerate(names)]),
        )

    def shares(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / STRETCH).cast("int"))
        parts = F.transform(starts, lambda i: counted(F.slice(hashes, i * STRETCH + 1, STRETCH)))
        field = lambda c, k: F.shiftright(c, FIELD * k).bitwiseAND(F.lit((1 << FIELD) - 1))
        of = lambda p, n, k: F.aggregate(p, F.lit(0).cast("long"), lambda s, c: s + field(c[n], k))
        return let(parts, lambda p: F.array(*[of(p, n, k) / F.size(hashes) - 0.5 for n in names for k in range(FIELDS)]))

    words = F.array_distinct(F.transform(F.filter(F.split(text, SPACE), lambda w: w != ""), lambda w: F.xxhash64(F.lower(w))))
    return let(words, lambda h: F.when(F.size(h) > 0, shares(h)))


def label(v: Column, centres: Centres) -> Column:
    """The name of the nearest centre."""
    if not centres:
        return F.lit(EMPTY)
    apart = lambda c: F.aggregate(F.zip_with(v, F.array(*map(F.lit, c)), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)
    nearest = let(F.array(*[apart(c) for c in centres]), lambda d: F.array_position(d, F.array_min(d)))
    return F.when(v.isNull(), EMPTY).otherwise(F.concat(F.lit("t"), nearest.cast("string")))


def topic(text: Column, centres: Centres) -> Column:
    return let(vector(text), lambda v: label(v, centres))


def fit(rows: DataFrame, topics: int = TOPICS, rounds: int = ROUNDS) -> Centres:
    """Centres of (v, key), the vectors of the documents and a hash of their texts; each round is one aggregation."""
    known = rows.where("v IS NOT NULL")
    seeds = known.groupBy(F.pmod(F.xxhash64("key"), F.lit(topics)).alias("c")).agg(F.min_by("v", F.struct("key", "v")).alias("v"))
    centres = [list(r.v) for r in seeds.orderBy("c").collect()]  # at most `topics`
    for _ in range(rounds if centres else 0):
        near = known.select(label(F.col("v"), centres).alias("t"), "v")
        mean = [F.round(F.avg(F.get("v", F.lit(i))), 9).alias(f"m{i}") for i in range(DIM)]
        found = {int(r.t[1:]) - 1: [r[f"m{i}"] for i in range(DIM)] for r in near.groupBy("t").agg(*mean).collect()}
        new = [found.get(i, c) for i, c in enumerate(centres)]
        if new == centres:
            break
        centres = new
    return centres

"""Centroids, assignment, and hierarchies over vectors (array columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import values as V
from millrace.operators import spatial
from millrace.operators.graphs import connected_components
from millrace.session import cut, materialise


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """group, centroid: the mean of each component, added up map-side, back in order."""
    parts = df.select(group, F.posexplode(vector).alias("i", "v")).groupBy(group, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    listed = F.sort_array(F.collect_list(F.struct("i", "m")))
    return parts.groupBy(group).agg(F.transform(listed, lambda s: s["m"]).alias("centroid"))


def assign(df: DataFrame, vector: str, centres: DataFrame, group: str, most: int = 10_000) -> DataFrame:
    """``df`` with the group whose centroid has the largest cosine, ties to the smaller group.

    Centroids are collected into one array (at most ``most``, checked) and
    compared inside the row, so the table isn't multiplied.
    """
    if centres.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} centroids")
    table = centres.agg(F.sort_array(F.collect_list(F.struct(F.col(group).alias("g"), V.unit(F.col("centroid")).alias("c")))).alias("__c"))
    unit = V.unit(F.col(vector))
    scored = F.transform("__c", lambda s: F.struct(F.round(V.dot(s["c"], F.col("__u")), 9).alias("s"), (-s["g"]).alias("g")))
    out = df.join(F.broadcast(table)).withColumn("__u", unit).withColumn("best", F.array_max(scored))
    return out.select(*df.columns, (-F.col("best.g")).alias("nearest"), F.col("best.s").alias("similarity"))


def representatives(df: DataFrame, key: str, group: str, vector: str, k: int) -> DataFrame:
    """The k rows of each group that are most like its centroid."""
    scored = df.join(centroids(df, group, vector), group).withColumn("s", F.round(V.cosine(F.col(vector), F.col("centroid")), 9))
    w = Window.partitionBy(group).orderBy(F.desc("s"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(group, key, "rank", "s")


def radius_clusters(points: DataFrame, eps: float) -> DataFrame:
    """id, component: points chained by steps of at most eps."""
    return connected_components(points, spatial.pairs_within(points, eps))


def _apart(a: Column, b: Column) -> Column:
    """Squared distance of two vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def subdivide(df: DataFrame, parent: str, key: str, features: str, target: int, least: int, most: int, rounds: int = 50) -> DataFrame:
    """parent, key, child: each parent's rows split by k-means, k from its size; children are numbered from 0 by size, then by their smallest key.

    All parents at once, and none in one task: seeds are the row nearest the mean,
    then the farthest from the seeds so far; a round finds the nearest centre
    inside the row and averages the members map-side first. Only centres, at most
    ``most`` a parent, are kept from round to round. Ties go to the smaller key and
    the earlier centre.
    """
    rows = materialise(df.select(F.col(parent).alias("p"), F.col(key).alias("k"), F.transform(features, lambda x: x.cast("double")).alias("f")), "members")
    sizes = rows.groupBy("p").agg(F.count("*").alias("n")).withColumn("want", V.child_count(F.col("n"), target, least, most))
    mean = centroids(rows, "p", "f").withColumnRenamed("centroid", "m")
    low = lambda d: F.struct(d.alias("d"), "k")
    first = rows.join(mean, "p").groupBy("p").agg(F.min_by("f", low(_apart(F.col("f"), F.col("m")))).alias("f"))
    now = cut(sizes.join(first, "p").select("p", "want", F.array("f").alias("c")))
    nearest = lambda: F.array_min(F.transform("c", lambda c: _apart(F.col("f"), c)))
    for _ in range(most - 1):
        more = now.where(F.size("c") < F.col("want"))
        if more.isEmpty():
            break
        far = rows.join(more, "p").withColumn("d", nearest()).where("d > 0").groupBy("p").agg(F.min_by("f", F.struct((-F.col("d")).alias("d"), "k")).alias("f"))
        grown = now.join(far, "p", "left")
        # a parent whose rows are all on its seeds has no more of them to give
        now = cut(grown.select("p", F.when(F.col("f").isNull() & (F.size("c") < F.col("want")), F.size("c")).otherwise(F.col("want")).alias("want"), F.when(F.col("f").isNull(), F.col("c")).otherwise(F.concat("c", F.array("f"))).alias("c")))
    own = lambda centres: rows.join(centres, "p").withColumn("l", T.let(F.transform("c", lambda c: _apart(F.col("f"), c)), lambda d: F.array_position(d, F.array_min(d))).cast("int"))
    for _ in range(rounds):
        parts = own(now).select("p", "l", F.posexplode("f").alias("i", "x")).groupBy("p", "l", "i").agg(F.avg("x").alias("x"))
        each = parts.groupBy("p", "l").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: F.round(s["x"], 12)).alias("m"))
        listed = each.groupBy("p").agg(F.map_from_entries(F.collect_list(F.struct("l", "m"))).alias("new"))
        moved = now.join(listed, "p").withColumn("next", F.transform("c", lambda c, i: F.coalesce(F.try_element_at("new", i + 1), c)))
        done = cut(moved.select("p", "want", F.col("next").alias("c"), (F.col("next") != F.col("c")).alias("moved")))
        now = done.drop("moved")
        if done.where("moved").isEmpty():
            break
    labelled = cut(own(now).select("p", "k", "l"))
    kinds = labelled.groupBy("p", "l").agg(F.count("*").alias("n"), F.min("k").alias("first"))
    number = F.row_number().over(Window.partitionBy("p").orderBy(F.desc("n"), "first")) - 1  # a parent's few children
    return labelled.join(kinds.withColumn("child", number), ["p", "l"]).select(F.col("p").alias(parent), F.col("k").alias(key), "child")


def standardised(df: DataFrame, columns: list[str], least: float = 1e-6) -> DataFrame:
    """Columns minus their mean over their population deviation (1 where that is below ``least``): two scans, no window over all rows."""
    s = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])

    def z(c: str) -> Column:
        return (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") < least, 1.0).otherwise(F.col(f"s_{c}"))

    return df.join(F.broadcast(s)).select(*[F.col(c) for c in df.columns if c not in columns], *[z(c).alias(c) for c in columns])


def keyphrases(docs: DataFrame, group: str, terms: Column, most: int) -> DataFrame:
    """group, term, score, rank: terms once, pairs of unlike neighbours at 1.6, at least two occurrences, by (score, term)."""
    t = docs.select(group, terms.alias("t"))
    pair = F.filter(F.zip_with(F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))), lambda a, b: F.when(a != b, F.concat_ws(" ", a, b))), lambda p: p.isNotNull())
    grams = F.concat("t", pair)
    n = t.select(group, F.explode(grams).alias("term")).groupBy(group, "term").agg(F.count("*").alias("n")).where("n >= 2")
    score = F.when(F.contains("term", F.lit(" ")), F.col("n") * 1.6).otherwise(F.col("n") * 1.0)
    w = Window.partitionBy(group).orderBy(F.desc("score"), "term")
    return n.withColumn("score", F.round(score, 4)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("n")

"""Latest rows, top rows a group, and deterministic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialise


def latest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; Spark prunes each group before the shuffle."""
    return top_per_group(df, keys, 1, *order).drop("rank")


def latest_by_join(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows that hold the largest value of ``column`` in their key: an aggregation and an equi-join."""
    best = df.groupBy(*keys).agg(F.max(column).alias(column))
    return df.join(best, [*keys, column])


def top_per_group(df: DataFrame, keys: list[str], n: int | Column, *order: Column) -> DataFrame:
    """The n first rows of each key, with their rank; ``n`` may be a column (a quota)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    limit = n if isinstance(n, Column) else F.lit(n)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def first_rows(df: DataFrame, n: int | None, *order: Column) -> DataFrame:
    """The n first rows in the order, or all of them, unsorted."""
    return df if n is None else df.orderBy(*order).limit(n)


def hash_order(*cols: str, salt: str = "") -> Column:
    """A pseudo-random order that any engine with MD5 gives alike."""
    return F.md5(F.concat_ws("|", F.lit(salt), *[F.col(c).cast("string") for c in cols]))


def sample_rows(df: DataFrame, n: int, *key: str, salt: str = "") -> DataFrame:
    """n rows without replacement, the same ones on every run."""
    return df.orderBy(hash_order(*key, salt=salt), *key).limit(n)


def fill_quota(parts: list[DataFrame], n: int, *key: str, salt: str = "") -> DataFrame:
    """n rows, taken from the first part as far as it goes, then from the next ones; fair within a part."""
    ranked = None
    for i, p in enumerate(parts):
        p = p.withColumn("priority", F.lit(i))
        ranked = p if ranked is None else ranked.unionByName(p)
    return ranked.orderBy("priority", hash_order(*key, salt=salt), *key).limit(n)


def ranked_ids(df: DataFrame, group: str) -> DataFrame:
    """group, n, new_id: dense ids from 0 by size, ties to the smaller group."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    return sizes.withColumn("new_id", F.row_number().over(Window.orderBy(F.desc("n"), F.col(group))) - 1)


def positioned(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """``df`` with i, the place of each row of a key in the order, from 0, and n, the rows of its key.

    Rows are dealt by ranges of (keys, order) and numbered within a range; the
    ranges' counts give the offsets. So no task sorts a key, only a range of it,
    as long as the order tells rows apart.
    """
    ranged = materialise(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*keys, "__part").agg(F.count("*").alias("__c"))
    whole = Window.partitionBy(*keys)
    offsets = counts.withColumn("n", F.sum("__c").over(whole)).withColumn("__before", F.sum("__c").over(whole.orderBy("__part")) - F.col("__c")).drop("__c")
    inside = ranged.withColumn("__i", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order)))
    return inside.join(offsets, [*keys, "__part"]).withColumn("i", F.col("__i") - 1 + F.col("__before")).select(*df.columns, "i", "n")


def cumulative(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, column, c (rows with the value), below (rows of the key with a smaller one); nulls left out."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("c"))
    ranged = materialise(counts.repartitionByRange(*keys, column).withColumn("__part", F.spark_partition_id()), "values")
    parts = ranged.groupBy(*keys, "__part").agg(F.sum("c").alias("__c"))
    offsets = parts.withColumn("__before", F.sum("__c").over(Window.partitionBy(*keys).orderBy("__part")) - F.col("__c")).drop("__c")
    run = F.sum("c").over(Window.partitionBy(*keys, "__part").orderBy(column)) - F.col("c")
    return ranged.withColumn("__run", run).join(offsets, [*keys, "__part"]).select(*keys, column, "c", (F.col("__run") + F.col("__before")).alias("below"))


def order_statistics(df: DataFrame, keys: list[str], column: str, **at: tuple[str, float]) -> DataFrame:
    """keys, n and a column a name: ``("cont", q)`` is the q-quantile between neighbours, ``("disc", q)`` the value of the nearest rank, ``("at", i)`` the i-th from 0, from the end if negative.

    Values are counted first, and a statistic is picked where its place falls, by an
    aggregation; nothing holds all values of a key.
    """
    got = cumulative(df, keys, column)
    n = got.groupBy(*keys).agg(F.sum("c").alias("n"))
    placed = got.join(n, keys) if keys else got.join(F.broadcast(n))
    here = lambda i: F.max(F.when((F.col("below") <= i) & (i < F.col("below") + F.col("c")), F.col(column)))
    wanted, out = [], []
    for name, (kind, q) in at.items():
        if kind == "cont":
            place = F.lit(float(q)) * (F.col("n") - 1)
            wanted += [here(F.floor(place)).alias(f"{name}__lo"), here(F.ceil(place)).alias(f"{name}__hi")]
            share = F.lit(float(q)) * (F.col("n") - 1) - F.floor(F.lit(float(q)) * (F.col("n") - 1))
            out.append((F.col(f"{name}__lo") + (F.col(f"{name}__hi") - F.col(f"{name}__lo")) * share).alias(name))
        else:
            place = F.greatest(F.ceil(F.lit(float(q)) * F.col("n")) - 1, F.lit(0)) if kind == "disc" else F.lit(int(q)) if q >= 0 else F.col("n") + int(q)
            wanted.append(here(place).alias(name))
            out.append(F.col(name))
    return placed.groupBy(*keys, "n").agg(*wanted).select(*keys, "n", *out)


def evenly_spaced(df: DataFrame, keys: list[str], most: int, *order: str) -> DataFrame:
    """At most ``most`` rows a key at even distances in the order, both ends included."""
    # position j of linspace(0, n - 1, most) is floor(j (n - 1) / (most - 1)); the least j that reaches i must give i
    j = f"((i * {most - 1} + n - 2) div greatest(n - 1, 1))"
    picked = (F.col("n") <= most) | (F.expr(f"({j} * (n - 1)) div {most - 1}") == F.col("i"))
    return positioned(df, keys, *order).where(picked).drop("i", "n")


def quota(amount: Column, budget: int | Column, total: Column) -> Column:
    """Share of a budget in proportion, rounded half to even."""
    return F.bround(budget * amount / total).cast("long")

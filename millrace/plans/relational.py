"""Joins, windows, aggregations, filters and set operations on the relational tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import ranking as R
from millrace.plans.registry import query
from millrace.session import table as t


@query("""
WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) rn FROM orders) WHERE rn = 1),
sizes AS (SELECT o_custkey, max(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) AS max_a, max(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS max_r
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey)
SELECT c_custkey, c_name, o_orderkey AS last_order, CAST(o_orderdate AS DATE) AS last_date, coalesce(o_totalprice, 0.0) AS last_total,
  coalesce(max_a, 0.0) AS max_a, coalesce(max_r, 0.0) AS max_r, round(coalesce(max_a, 0.0) / 1024 / 1024, 6) AS max_a_mb
FROM customer LEFT JOIN latest l ON c_custkey = l.o_custkey LEFT JOIN sizes s ON c_custkey = s.o_custkey
WHERE c_mktsegment = 'BUILDING'""")
def denormalized_export(spark: SparkSession, d: str) -> DataFrame:
    """One row a customer: latest order, and line prices pivoted by flag, with defaults."""
    orders = t(spark, d, "orders")
    last = R.latest_by(orders, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))
    price = lambda flag: F.max(F.when(F.col("l_returnflag") == flag, F.col("l_extendedprice")))
    sizes = (
        t(spark, d, "lineitem").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey").agg(price("A").alias("max_a"), price("R").alias("max_r"))
    )
    c = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return (
        c.join(last.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
        .join(sizes.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
        .select(
            "c_custkey", "c_name", F.col("o_orderkey").alias("last_order"), F.col("o_orderdate").cast("date").alias("last_date"),
            F.coalesce("o_totalprice", F.lit(0.0)).alias("last_total"),
            F.coalesce("max_a", F.lit(0.0)).alias("max_a"), F.coalesce("max_r", F.lit(0.0)).alias("max_r"),
            F.round(F.coalesce("max_a", F.lit(0.0)) / 1024 / 1024, 6).alias("max_a_mb"),
        )
    )


@query("""SELECT user_id, max(ts) AS ts, arg_max(value, ts) AS value FROM events GROUP BY user_id""")
def latest_row_per_key(spark: SparkSession, d: str) -> DataFrame:
    return R.latest_by(t(spark, d, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "ts", "value")


@query("""SELECT e.user_id, e.ts, e.value FROM events e JOIN (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id) m ON e.user_id = m.user_id AND e.ts = m.ts""")
def latest_row_by_join(spark: SparkSession, d: str) -> DataFrame:
    return R.latest_by_join(t(spark, d, "events"), ["user_id"], "ts").select("user_id", "ts", "value")


@query("""SELECT o_custkey, l_orderkey, l_linenumber FROM (
 SELECT o_custkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_custkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) rn
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_returnflag <> 'N') WHERE rn = 1""")
def latest_confirmed_per_group(spark: SparkSession, d: str) -> DataFrame:
    both = t(spark, d, "lineitem").where("l_returnflag <> 'N'").join(
        t(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    order = [F.desc(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")]
    return R.latest_by(both, ["o_custkey"], *order).select("o_custkey", "l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, max(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS qty_a, max(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS qty_n,
 max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS qty_r FROM lineitem GROUP BY l_orderkey""")
def conditional_pivot(spark: SparkSession, d: str) -> DataFrame:
    pivoted = t(spark, d, "lineitem").groupBy("l_orderkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.max("l_quantity"))
    return pivoted.select("l_orderkey", F.col("A").alias("qty_a"), F.col("N").alias("qty_n"), F.col("R").alias("qty_r"))


@query("""SELECT user_id, best, coalesce(c_name, CAST(user_id AS VARCHAR)) AS label FROM (SELECT user_id, max(value) AS best FROM events GROUP BY user_id) e
 LEFT JOIN customer ON c_custkey = user_id AND c_mktsegment = 'BUILDING' ORDER BY best DESC, user_id LIMIT 25""")
def top_n_by_max(spark: SparkSession, d: str) -> DataFrame:
    names = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"), "c_name")
    best = t(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("best"))
    return (
        best.join(names, "user_id", "left").select("user_id", "best", F.coalesce("c_name", F.col("user_id").cast("string")).alias("label"))
        .orderBy(F.desc("best"), "user_id").limit(25)
    )


@query("""SELECT event_type, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type ORDER BY n_users DESC, event_type LIMIT 25""")
def distinct_entity_per_tag(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users")).orderBy(F.desc("n_users"), "event_type").limit(25)


WEEKLY_SQL = """weekly AS (SELECT user_id, date_trunc('week', ts) AS week, max(value) AS cum FROM events GROUP BY 1, 2),
deltas AS (SELECT *, cum - lag(cum) OVER (PARTITION BY user_id ORDER BY week) AS delta FROM weekly),
recent AS (SELECT * FROM deltas WHERE week >= (SELECT max(ts) FROM events) - INTERVAL 3 WEEK),
ranked AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY coalesce(delta, cum) DESC, user_id) AS rank FROM recent)"""


def weekly(spark: SparkSession, d: str, top: int) -> DataFrame:
    """Weekly maxima with the change from the last observed week; the best of each recent week."""
    e = t(spark, d, "events")
    week = F.date_trunc("week", "ts").cast("timestamp_ntz")
    w = e.groupBy("user_id", week.alias("week")).agg(F.max("value").alias("cum"))
    w = w.withColumn("delta", F.col("cum") - F.lag("cum").over(Window.partitionBy("user_id").orderBy("week")))
    now = e.agg((F.max("ts") - F.expr("interval 3 weeks")).alias("since"))  # one row
    w = w.join(F.broadcast(now), F.col("week") >= F.col("since")).drop("since")
    return R.top_per_group(w, ["week"], top, F.coalesce("delta", "cum").desc(), F.col("user_id"))


@query(f"WITH {WEEKLY_SQL} SELECT user_id, CAST(week AS DATE) AS week, cum, round(delta, 6) AS delta, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10")
def weekly_delta_topk(spark: SparkSession, d: str) -> DataFrame:
    return weekly(spark, d, 10).select("user_id", F.col("week").cast("date").alias("week"), "cum", F.round("delta", 6).alias("delta"), "rank")


@query(f"""WITH {WEEKLY_SQL} SELECT user_id, CAST(week AS DATE) AS week, cum, coalesce(c_name, '(unknown)') AS name FROM weekly LEFT JOIN customer ON c_custkey = user_id
 WHERE user_id IN (SELECT DISTINCT user_id FROM ranked WHERE rank <= 3)""")
def weekly_series_of_top(spark: SparkSession, d: str) -> DataFrame:
    top = weekly(spark, d, 3).select("user_id").distinct()
    series = t(spark, d, "events").join(top, "user_id", "left_semi").groupBy("user_id", F.date_trunc("week", "ts").cast("date").alias("week")).agg(F.max("value").alias("cum"))
    names = t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return series.join(names, "user_id", "left").select("user_id", "week", "cum", F.coalesce("c_name", F.lit("(unknown)")).alias("name"))


@query("""SELECT s.status AS status, count(o_orderkey) AS n FROM (VALUES ('P'), ('F'), ('O'), ('X')) s(status) LEFT JOIN orders ON o_orderstatus = s.status GROUP BY s.status""")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every status of the enumeration, zeros kept."""
    every = spark.createDataFrame([("P",), ("F",), ("O",), ("X",)], "status string")
    n = t(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return every.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("""SELECT count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 100000) AS large_done,
 count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS with_returns FROM orders""")
def queue_depths(spark: SparkSession, d: str) -> DataFrame:
    """Several queue depths in one pass."""
    back = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("back")).distinct()
    return t(spark, d, "orders").join(back, "o_orderkey", "left").agg(
        F.count_if(F.col("o_orderstatus") == "P").alias("pending"),
        F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)).alias("large_done"),
        F.count_if(F.coalesce("back", F.lit(False))).alias("with_returns"),
    )


@query("""SELECT o_orderkey, priority FROM (SELECT o_orderkey, 0 AS priority FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000
 UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderstatus = 'O') ORDER BY priority, md5('q|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 2000""")
def random_queue_fill(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    first, rest = o.where("o_orderstatus = 'P' AND o_totalprice > 300000"), o.where("o_orderstatus = 'O'")
    return R.fill_quota([first.select("o_orderkey"), rest.select("o_orderkey")], 2000, "o_orderkey", salt="q").select("o_orderkey", "priority")


@query("""SELECT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY o_custkey""")
def import_new_ids(spark: SparkSession, d: str) -> DataFrame:
    have = t(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"))
    return t(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct().join(have, "id", "left_anti")


@query("""SELECT r_name, n_name, n_cust, max_bal FROM (SELECT r_name, n_name, count(c_custkey) AS n_cust, max(c_acctbal) AS max_bal FROM region JOIN nation ON n_regionkey = r_regionkey
 LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, n_name) WHERE n_cust >= 8 ORDER BY n_cust DESC, n_name""")
def cluster_browse_top(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "region").join(t(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    by = n.join(t(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("r_name", "n_name")
    return by.agg(F.count("c_custkey").alias("n_cust"), F.max("c_acctbal").alias("max_bal")).where("n_cust >= 8").orderBy(F.desc("n_cust"), "n_name")


@query("""WITH pairs AS (SELECT event_type AS child, user_id % 7 AS parent, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY child) AS total, row_number() OVER (PARTITION BY child ORDER BY n DESC, parent) AS rn FROM pairs)
SELECT child, CAST(total AS BIGINT) AS total, parent AS top_parent FROM r WHERE rn = 1""")
def cluster_browse_children(spark: SparkSession, d: str) -> DataFrame:
    """Two levels: rows by child and parent, then the total and the dominant parent of each child."""
    pairs = t(spark, d, "events").groupBy(F.col("event_type").alias("child"), (F.col("user_id") % 7).alias("parent")).agg(F.count("*").alias("n"))
    return pairs.groupBy("child").agg(F.sum("n").alias("total"), F.max_by("parent", F.struct("n", -F.col("parent"))).alias("top_parent"))


@query("""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey = 3 ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 40""")
def cluster_browse_members(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "customer").where("c_nationkey = 3").orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").limit(40).select("c_custkey", "c_name", "c_acctbal")


@query("""SELECT c_custkey, coalesce(c_name, '(untitled)') AS name, n_name, r_name, strftime(o.last, '%Y-%m-%d') AS last_day, coalesce(o.n, 0) AS n_orders FROM customer
 LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
 LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last, count(*) AS n FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey WHERE c_custkey = 17""")
def entity_detail(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"), F.count("*").alias("n"))
    c = t(spark, d, "customer").where("c_custkey = 17").join(o, "c_custkey", "left")
    c = c.join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return c.select(
        "c_custkey", F.coalesce("c_name", F.lit("(untitled)")).alias("name"), "n_name", "r_name",
        F.date_format("last", "yyyy-MM-dd").alias("last_day"), F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"),
    )


@query("""SELECT o_orderpriority, mode_status, first_status, n FROM (SELECT o_orderpriority, o_orderstatus AS mode_status, count(*) AS c,
 row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, o_orderstatus) AS rn FROM orders GROUP BY 1, 2) m
 JOIN (SELECT o_orderpriority AS p, min(o_orderstatus) AS first_status, count(*) AS n FROM orders GROUP BY 1) a ON p = o_orderpriority WHERE rn = 1""")
def modal_label(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.mode("o_orderstatus", True).alias("mode_status"), F.min("o_orderstatus").alias("first_status"), F.count("*").alias("n")
    )


@query("""SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer QUALIFY rank <= 2""")
def capitols(spark: SparkSession, d: str) -> DataFrame:
    """The two best of each group."""
    return R.top_per_group(t(spark, d, "customer"), ["c_nationkey"], 2, F.desc("c_acctbal"), F.col("c_custkey")).select("c_nationkey", "c_custkey", "rank")


@query("""WITH s AS (SELECT c_nationkey AS g, count(*) AS m FROM customer GROUP BY 1), q AS (SELECT g, CAST(round_even(60.0 * m / sum(m) OVER (), 0) AS BIGINT) AS quota FROM s)
SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) JOIN q ON g = c_nationkey WHERE rn <= quota""")
def graded_top(spark: SparkSession, d: str) -> DataFrame:
    """Top rows of each group, as many as its share of a budget of 60."""
    c = t(spark, d, "customer")
    sizes = c.groupBy("c_nationkey").agg(F.count("*").alias("m"))
    quotas = sizes.withColumn("quota", R.quota(F.col("m"), 60, F.sum("m").over(Window.partitionBy()))).drop("m")
    ranked = c.withColumn("rank", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")))
    return ranked.join(quotas, "c_nationkey").where("rank <= quota").select("c_nationkey", "c_custkey")


@query("""SELECT n_nationkey, n_name, CAST(row_number() OVER (ORDER BY n DESC, n_nationkey) - 1 AS INTEGER) AS new_id, n FROM nation JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey""")
def compact_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = R.ranked_ids(t(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey")), "n_nationkey")
    return t(spark, d, "nation").join(ids, "n_nationkey").select("n_nationkey", "n_name", "new_id", "n")


@query("""WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
pick AS (SELECT event_type, n, unnest(range(0, 70)) AS j FROM (SELECT DISTINCT event_type, n FROM r))
SELECT DISTINCT r.event_type, event_id FROM r JOIN pick p ON r.event_type = p.event_type AND r.i = (p.j * (p.n - 1)) // 69""")
def evenly_spaced_sample(spark: SparkSession, d: str) -> DataFrame:
    return R.evenly_spaced(t(spark, d, "events").select("event_type", "event_id", "ts"), ["event_type"], 70, "ts", "event_id").select("event_type", "event_id")


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('s|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 500""")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return R.sample_rows(t(spark, d, "orders"), 500, "o_orderkey", salt="s").select("o_orderkey", "o_totalprice")


@query("""SELECT CAST(grouping(l_returnflag) + 2 * grouping(l_linestatus) AS INTEGER) AS axis, l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS qty,
 round(max(l_discount), 6) AS max_discount FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus))""")
def multi_axis_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "lineitem")
    by = rows.groupingSets([[], [F.col("l_returnflag")], [F.col("l_linestatus")]], "l_returnflag", "l_linestatus")
    axis = (F.grouping("l_returnflag") + 2 * F.grouping("l_linestatus")).cast("int").alias("axis")
    return by.agg(axis, F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("qty"), F.round(F.max("l_discount"), 6).alias("max_discount"))


@query("""SELECT coalesce(l_returnflag, '(all)') AS kind, count(*) AS n, round(median(l_extendedprice), 6) AS med, quantile_disc(l_extendedprice, 0.95) AS p95, max(l_extendedprice) AS top,
 round(stddev_pop(l_quantity) / avg(l_quantity), 6) AS cv FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def grouped_stats(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank p95, median, maximum and coefficient of variation, by kind and in total."""
    line = t(spark, d, "lineitem").select("l_extendedprice", "l_quantity", F.explode(F.array(F.coalesce("l_returnflag", F.lit("(null)")), F.lit("(all)"))).alias("kind"))
    ranks = R.order_statistics(line, ["kind"], "l_extendedprice", med=("cont", 0.5), p95=("disc", 0.95))
    rest = line.groupBy("kind").agg(F.max("l_extendedprice").alias("top"), F.round(F.stddev_pop("l_quantity") / F.avg("l_quantity"), 6).alias("cv"))
    return ranks.join(rest, "kind").select("kind", "n", F.round("med", 6).alias("med"), "p95", "top", "cv")


@query("""SELECT round(corr(x, y), 5) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x,
 rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS y FROM lineitem)""")
def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Spearman's correlation: ranks with average ties come from counts by value, not from one sorted partition of all rows."""
    rows = t(spark, d, "lineitem").select("l_quantity", "l_extendedprice")

    def ranks(column: str, name: str) -> DataFrame:
        return R.cumulative(rows, [], column).select(column, (F.col("below") + (F.col("c") + 1) / 2).alias(name))

    both = rows.join(ranks("l_quantity", "x"), "l_quantity").join(ranks("l_extendedprice", "y"), "l_extendedprice")
    return both.agg(F.round(F.corr("x", "y"), 5).alias("rho"), F.count("*").alias("n"))


@query("""WITH j AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1)
SELECT CAST(n AS BIGINT) AS degree, count(*) AS n FROM j GROUP BY 1""")
def degree_counts(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    return t(spark, d, "customer").join(o, "c_custkey", "left").groupBy(F.coalesce("k", F.lit(0)).cast("long").alias("degree")).agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n_rows, count(DISTINCT l_orderkey * 10 + l_linenumber) AS n_keys, CAST(sum(CASE WHEN o_orderkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing
 FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey""")
def alignment_report(spark: SparkSession, d: str) -> DataFrame:
    """Uniqueness and join misses, as an assertion would count them."""
    o = t(spark, d, "orders").select("o_orderkey")
    j = t(spark, d, "lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.agg(F.count("*").alias("n_rows"), F.count_distinct(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n_keys"), F.count_if(F.col("o_orderkey").isNull()).alias("n_missing"))


@query("""SELECT c.c_custkey, s0.n AS n_f, s1.n AS n_o, s2.n AS n_p FROM customer c
 LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) s0 ON s0.o_custkey = c_custkey
 LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) s1 ON s1.o_custkey = c_custkey
 LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) s2 ON s2.o_custkey = c_custkey""")
def layered_join(spark: SparkSession, d: str) -> DataFrame:
    """N left joins on one key, one a layer; all share the partitioning by that key."""
    o = t(spark, d, "orders")
    layers = [o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias(f"n_{s.lower()}")) for s in "FOP"]
    return reduce(lambda a, b: a.join(b, "c_custkey", "left"), layers, t(spark, d, "customer").select("c_custkey"))


@query("""SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM (SELECT o_custkey AS a, l_suppkey AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey <> l_suppkey) GROUP BY 1, 2 HAVING count(*) = 1""")
def edges_seen_once(spark: SparkSession, d: str) -> DataFrame:
    """Unordered pairs that occur exactly once."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    p = t(spark, d, "lineitem").join(o, "l_orderkey").where("o_custkey <> l_suppkey")
    return p.groupBy(F.least("o_custkey", "l_suppkey").alias("a"), F.greatest("o_custkey", "l_suppkey").alias("b")).agg(F.count("*").alias("n")).where("n = 1")


@query("""SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    f, p = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FP")
    return f.distinct().join(p, "k", "left_anti")


@query("""SELECT a.e_from, a.e_to FROM (SELECT c_nationkey AS e_from, o_custkey % 25 AS e_to FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F'
 UNION SELECT c_nationkey, o_custkey % 25 FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P') a""")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    j = t(spark, d, "customer").join(t(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("e_from"), (F.col("o_custkey") % 25).alias("e_to"), "o_orderstatus")
    return j.where("o_orderstatus = 'F'").drop("o_orderstatus").union(j.where("o_orderstatus = 'P'").drop("o_orderstatus")).distinct()


@query("""SELECT x.user_id, x.event_id, x.ts, round(min(y.value), 6) AS low, round(max(y.value), 6) AS high FROM events x JOIN events y ON x.user_id = y.user_id AND y.ts BETWEEN x.ts - INTERVAL 6 HOUR AND x.ts GROUP BY 1, 2, 3""")
def sliding_minmax(spark: SparkSession, d: str) -> DataFrame:
    """Minimum and maximum over a moving range of six hours."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-6 * 3_600_000_000, 0)
    return t(spark, d, "events").select("user_id", "event_id", "ts", F.round(F.min("value").over(w), 6).alias("low"), F.round(F.max("value").over(w), 6).alias("high"))


@query("""WITH p AS (SELECT user_id, epoch_us(ts) AS m FROM events UNION ALL SELECT DISTINCT user_id, epoch_us(TIMESTAMP '2024-01-01') FROM events UNION ALL SELECT DISTINCT user_id, epoch_us(TIMESTAMP '2024-02-01') FROM events),
g AS (SELECT user_id, lead(m) OVER (PARTITION BY user_id ORDER BY m) - m AS gap FROM p)
SELECT user_id, max(gap) AS longest, count(*) AS n_gaps FROM g WHERE gap > 0 GROUP BY user_id""")
def gaps(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between consecutive stations, both ends of the line added."""
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    e = t(spark, d, "events").select("user_id", at)
    ends = e.select("user_id").distinct().select("user_id", F.explode(F.array(*[F.unix_micros(F.lit(x).cast("timestamp")) for x in ("2024-01-01 00:00:00", "2024-02-01 00:00:00")])).alias("at"))
    g = e.union(ends).withColumn("gap", F.lead("at").over(Window.partitionBy("user_id").orderBy("at")) - F.col("at")).where("gap > 0")
    return g.groupBy("user_id").agg(F.max("gap").alias("longest"), F.count("*").alias("n_gaps"))


@query("""WITH f AS (SELECT user_id, ts, event_id, event_type = 'error' AS bad, coalesce(lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id), FALSE) AS was FROM events)
SELECT user_id, count(*) FILTER (bad AND NOT was) AS n_runs FROM f GROUP BY user_id""")
def run_starts(spark: SparkSession, d: str) -> DataFrame:
    """How often a flag turns from false to true along each ordered series."""
    was = F.coalesce(F.lag("bad").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.lit(False))
    f = t(spark, d, "events").withColumn("bad", F.col("event_type") == "error").withColumn("was", was)
    return f.groupBy("user_id").agg(F.count_if(F.col("bad") & ~F.col("was")).alias("n_runs"))


@query("""SELECT o_orderkey, array_to_string(list(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), ',') AS seen FROM orders""")
def last_twelve_seen(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-12, -1)
    seen = F.collect_list("o_orderstatus").over(w)
    return t(spark, d, "orders").select("o_orderkey", F.when(F.size(seen) > 0, F.array_join(seen, ",")).alias("seen"))


@query("""SELECT c_nationkey, c_custkey, round((c_acctbal - min(c_acctbal) OVER w) / nullif(max(c_acctbal) OVER w - min(c_acctbal) OVER w, 0), 6) AS scaled FROM customer WINDOW w AS (PARTITION BY c_nationkey)""")
def minmax_scaled(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey")
    lo, hi = F.min("c_acctbal").over(w), F.max("c_acctbal").over(w)
    return t(spark, d, "customer").select("c_nationkey", "c_custkey", F.round((F.col("c_acctbal") - lo) / F.nullif(hi - lo, F.lit(0.0)), 6).alias("scaled"))


@query("""SELECT r_regionkey, r_name, element_at([[230, 25, 75], [60, 180, 75], [255, 225, 25]], 1 + (dense_rank() OVER (ORDER BY r_name) - 1) % 3) AS rgb FROM region""".replace("element_at(", "list_extract("))
def palette(spark: SparkSession, d: str) -> DataFrame:
    """Dense index of the sorted names, modulo the palette."""
    colours = F.array(*[F.array(*map(F.lit, c)) for c in ((230, 25, 75), (60, 180, 75), (255, 225, 25))])
    i = (F.dense_rank().over(Window.orderBy("r_name")) - 1) % 3
    return t(spark, d, "region").select("r_regionkey", "r_name", F.get(colours, i).alias("rgb"))

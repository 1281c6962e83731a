"""Keyed writes as new tables: upserts, change detection, dependent rows, queues.

A write takes the current table and a batch and returns the next table; the
caller overwrites or swaps it. Ties in a batch are settled by ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import values as V

PENDING, SUCCESS, DELETED, ERROR = "PENDING", "SUCCESS", "DELETED", "ERROR"
#: Keys that a listing has; a payload with no others is a discovery. An empty payload is one too.
LISTING = ("id", "name", "authorId", "authorName", "updated_at", "publicationDate", "imageUrl", "thumbnailImageUrl")


def is_discovery(payload: Column) -> Column:
    keys = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    return F.size(F.array_except(keys, F.array(*map(F.lit, LISTING)))) == 0


def is_newer(updated_at: Column, last_scrape: Column) -> Column:
    """Updated since the last visit: true without a visit, false if the time can't be read."""
    return F.when(last_scrape.isNull(), F.lit(True)).otherwise(F.coalesce(V.iso_ntz(updated_at) > last_scrape, F.lit(False)))


def _fold(state: Column, item: Column) -> Column:
    """One payload onto a row's state (payload, status, last_scrape)."""
    newer = is_newer(F.get_json_object(item["payload"], "$.updated_at"), state["last_scrape"])
    found = is_discovery(item["payload"])
    merged = F.when(state["payload"].isNull(), item["payload"]).otherwise(V.merged_json(state["payload"], item["payload"]))
    return F.struct(
        F.when(found, merged).otherwise(item["payload"]).alias("payload"),
        F.when(found & state["status"].isNotNull() & ~newer, state["status"]).otherwise(F.coalesce(item["status"], state["status"], F.lit(PENDING))).alias("status"),
        state["last_scrape"].alias("last_scrape"),
    )


def upsert(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Next (id, payload, status, last_scrape) from a batch (id, seq, payload, status).

    A discovery is merged into what is there, and sets the status only if its
    update is newer than the last visit; a full payload replaces. Payloads of
    one id are applied in order of seq, so a later one sees the earlier. Neither
    touches the time of the last visit. One shuffle on id.
    """
    items = batch.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seq", "payload", "status"))).alias("items"))
    kind = "struct<payload:string,status:string,last_scrape:timestamp_ntz>"
    both = current.select("id", "payload", "status", "last_scrape").join(items, "id", "full")
    start = F.struct("payload", "status", "last_scrape").cast(kind)
    done = F.aggregate(F.coalesce("items", F.array().cast("array<struct<seq:bigint,payload:string,status:string>>")), start, lambda s, i: _fold(s, i).cast(kind))
    return both.withColumn("s", done).select("id", "s.payload", "s.status", "s.last_scrape")


def set_status(current: DataFrame, batch: DataFrame, now: Column | None = None) -> DataFrame:
    """Status by key, missing keys created bare; with ``now`` the visit is stamped."""
    new = batch.select("id", F.col("status").alias("new"))
    stamp = F.col("last_scrape") if now is None else F.when(F.col("new").isNotNull(), now).otherwise(F.col("last_scrape"))
    return current.join(new, "id", "full").select("id", "payload", F.coalesce("new", "status").alias("status"), stamp.alias("last_scrape"))


def write_full(current: DataFrame, metrics: DataFrame, files: DataFrame, batch: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Next worlds, metrics and files from full payloads (id, payload, metrics columns, files: array<struct<file_id, version>>).

    The payload and the visit are written only where the payload changed;
    metrics are always appended; files that are no longer named go, those named
    with another version start again, the others stay.
    """
    new = batch.select("id", F.col("payload").alias("p"))
    changed = F.col("p").isNotNull() & ~F.col("p").eqNullSafe(F.col("payload"))
    worlds = current.join(new, "id", "full").select(
        "id", F.when(changed, F.col("p")).otherwise(F.col("payload")).alias("payload"),
        F.when(F.col("p").isNotNull(), SUCCESS).otherwise(F.col("status")).alias("status"),
        F.when(changed, now).otherwise(F.col("last_scrape")).alias("last_scrape"),
    )
    columns = [c for c in metrics.columns if c not in ("id", "scrape_time")]
    appended = metrics.unionByName(batch.select("id", *columns).withColumn("scrape_time", now))
    named = batch.select("id", F.inline("files")).select("id", "file_id", F.col("version").alias("v"))
    touched = batch.select("id").distinct().withColumn("touched", F.lit(True))
    kept = files.join(touched, "id", "left").join(named, ["id", "file_id"], "full").where("v IS NOT NULL OR touched IS NULL")
    fresh = F.col("v").isNotNull() & ~F.col("v").eqNullSafe(F.col("version"))
    reset = lambda c, x: F.when(fresh, x).otherwise(F.col(c)).alias(c)
    return worlds, appended, kept.select(
        "id", "file_id", F.coalesce("v", "version").alias("version"), reset("status", F.lit(PENDING)),
        reset("payload", F.lit(None)), reset("last_scrape", F.lit(None)), reset("error", F.lit(None)),
    )


def file_results(files: DataFrame, images: DataFrame, results: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Next files and images from results (file_id, payload, status, error).

    A file keeps its payload only where the result is a success. The highest
    version of an image file (all files, without a column file_type) gets an
    image row; one that is there starts again if its MD5 has changed.
    """
    r = results.select("file_id", F.col("payload").alias("p"), F.col("status").alias("s"), F.col("error").alias("e"))
    hit = F.col("s").isNotNull()
    extra = [c for c in files.columns if c == "file_type"]
    next_files = files.join(r, "file_id", "left").select(
        "id", "file_id", "version", *extra, F.coalesce("s", "status").alias("status"),
        F.when(hit, F.when(F.col("s") == SUCCESS, F.col("p"))).otherwise(F.col("payload")).alias("payload"),
        F.when(hit, now).otherwise(F.col("last_scrape")).alias("last_scrape"), F.when(hit, F.col("e")).otherwise(F.col("error")).alias("error"),
    )
    shown = files.where("file_type = 'IMAGE'") if extra else files
    known = shown.select("file_id").distinct()
    top = V.highest_version(V.versions(F.col("p")))
    got = r.where(F.col("s") == SUCCESS).join(known, "file_id", "left_semi").select("file_id", top.alias("t")).where("t.version IS NOT NULL AND t.file IS NOT NULL")
    got = got.select("file_id", F.col("t.version").alias("version"), F.coalesce("t.file.md5", F.lit("")).alias("m"))
    both = images.join(got, ["file_id", "version"], "full")
    again = F.col("m").isNotNull() & ~F.col("m").eqNullSafe(F.col("md5"))
    next_images = both.select(
        "file_id", "version", F.coalesce("m", "md5").alias("md5"), F.when(again, None).otherwise(F.col("sha256")).alias("sha256"),
        F.when(again, PENDING).otherwise(F.col("state")).alias("state"),
    )
    return next_files, next_images


def image_results(images: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Next images from (file_id, version, state, sha256); a confirmed one is stamped."""
    r = results.select("file_id", "version", F.col("state").alias("s"), F.col("sha256").alias("h"))
    return images.join(r, ["file_id", "version"], "left").select(
        "file_id", "version", "md5", F.coalesce("h", "sha256").alias("sha256"), F.coalesce("s", "state").alias("state"),
        F.when(F.col("s") == "CONFIRMED", now).alias("success_time"),
    )


def due(worlds: DataFrame, metrics: DataFrame, now: Column) -> DataFrame:
    """Rows to visit: pending ones always, visited ones after the cadence of their latest metrics; no metrics: at once. Deleted and failed ones never."""
    w = Window.partitionBy("id").orderBy(F.desc("scrape_time"))
    last = metrics.withColumn("n", F.row_number().over(w)).where("n = 1").select("id", "heat", "popularity", "occupants", "scrape_time")
    days = V.cadence_days(F.col("heat"), F.col("popularity"), F.col("occupants"))
    late = F.col("scrape_time").isNull() | (V.full_days(now, F.col("last_scrape")) >= days)
    return worlds.join(last, "id", "left").where((F.col("status") == PENDING) | ((F.col("status") == SUCCESS) & late)).select(*worlds.columns)


def pending_images(files: DataFrame, images: DataFrame) -> DataFrame:
    done = files.where(F.col("status") == SUCCESS).select("file_id").distinct()
    return images.where(F.col("state") == PENDING).join(done, "file_id", "left_semi")


def drained(worlds: DataFrame, files: DataFrame, images: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ids that a one-shot run handles at each stage: at most ``most`` pending worlds by id, then all pending files of visited worlds, then all pending images of read files."""
    first = worlds.where(F.col("status") == PENDING).orderBy("id").limit(most).select("id")
    visited = worlds.where(F.col("status") == SUCCESS).select("id").unionByName(first)
    read = files.where(F.col("status") == PENDING).join(visited, "id", "left_semi")
    done = files.where(F.col("status") == SUCCESS).select("file_id").unionByName(read.select("file_id")).distinct()
    return first, read.select("id", "file_id"), images.where(F.col("state") == PENDING).join(done, "file_id", "left_semi").select("file_id", "version")

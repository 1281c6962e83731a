"""Arrays, JSON, time and vector expressions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSIONS = "struct<versions:array<struct<version:int,status:string,deleted:boolean,file:struct<md5:string,sizeInBytes:bigint,url:string>>>>"


def versions(payload: Column) -> Column:
    """The versions of a file's JSON payload."""
    return F.coalesce(F.from_json(payload, VERSIONS)["versions"], F.from_json(F.lit('{"versions":[]}'), VERSIONS)["versions"])


def last_version(v: Column) -> Column:
    """By position: the last element, null if there is none."""
    return F.try_element_at(v, F.lit(-1))


def highest_version(v: Column) -> Column:
    """By number."""
    return F.array_max(F.transform(v, lambda x: F.struct(x["version"].alias("version"), x["file"].alias("file"))))


def latest_usable(v: Column) -> Column:
    """By number, among those that aren't deleted and have a file."""
    return highest_version(F.filter(v, lambda x: ~F.coalesce(x["deleted"], F.lit(False)) & x["file"].isNotNull()))


def first_with(v: Column, version: Column) -> Column:
    return F.get(F.filter(v, lambda x: x["version"] == version), F.lit(0))


def merged_json(left: Column, right: Column) -> Column:
    """Shallow merge of two JSON objects, the right one wins; needs spark.sql.mapKeyDedupPolicy=LAST_WIN or disjoint keys, so keys of the right are taken out of the left."""
    kind = "map<string,variant>"
    a, b = F.from_json(left, kind), F.from_json(right, kind)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b))


def iso_ntz(text: Column) -> Column:
    """ISO-8601 text as a timestamp without zone: an offset is dropped, not converted; null if it can't be read."""
    plain = F.regexp_replace(text, r"(?:Z|[+-]\d{2}:?\d{2})$", "")
    return plain.try_cast("timestamp_ntz")


def week(ts: Column) -> Column:
    """Monday of the week, without zone."""
    return F.date_trunc("week", ts).cast("timestamp_ntz")


def full_days(later: Column, earlier: Column) -> Column:
    """Whole days between two times, fractions cut off."""
    return F.timestamp_diff("DAY", earlier, later)


def cadence_days(heat: Column, popularity: Column, occupants: Column) -> Column:
    """Days between visits, by how lively the latest figures are."""
    return (
        F.when((heat >= 5) | (popularity >= 8) | (occupants >= 50), 1)
        .when((heat >= 3) | (popularity >= 5) | (occupants >= 10), 7)
        .when((heat >= 1) | (popularity >= 2) | (occupants >= 1), 30).otherwise(180)
    )


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, least: float = 0.0) -> Column:
    """L2-normalised; a vector with a norm of ``least`` or less is divided by one."""
    n = norm(a)
    by = F.when(n > least, n).otherwise(1.0)
    return F.get(F.transform(F.array(by), lambda d: F.transform(a, lambda x: x.cast("double") / d)), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    return dot(unit(a), unit(b))


def scaled(a: Column, by: float) -> Column:
    return F.transform(a, lambda x: x * by)


def fused(blocks: list[tuple[Column, float]]) -> Column:
    """Blocks normalised one by one, weighted and concatenated."""
    return F.concat(*[scaled(unit(b, 1e-12), w) for b, w in blocks])


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def child_count(n: Column, target: int, least: int, most: int) -> Column:
    """round(n / target), at most ``most`` and no more than groups of ``least`` allow, at least one."""
    return F.greatest(F.lit(1), F.least(F.bround(n / target).cast("int"), F.lit(most), F.floor(n / least).cast("int")))


def http_class(status: Column) -> Column:
    """What an HTTP status means for a retry loop."""
    return (
        F.when(status.isNull(), "timeout").when(status == 401, "auth").when(status == 404, "gone").when(status == 429, "rate_limited")
        .when(status.isin(500, 502, 503), "server").when(status >= 400, "client").otherwise("ok")
    )


def zipped_ring(xs: Column, ys: Column) -> Column:
    """Two coordinate lists as a ring; null with fewer than three corners."""
    n = F.least(F.size(xs), F.size(ys))
    ring = F.zip_with(F.slice(xs, F.lit(1), n), F.slice(ys, F.lit(1), n), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.when(n >= 3, ring)


def affine(x: Column, origin: Column, scale: Column) -> Column:
    return (x - origin) * scale


def affine_back(u: Column, origin: Column, scale: Column) -> Column:
    return u / scale + origin


def names_path(names: Column) -> Column:
    """Names from coarse to fine without nulls and without one that repeats the one before."""
    some = F.filter(names, lambda x: x.isNotNull())
    return F.aggregate(some, F.array().cast("array<string>"), lambda a, x: F.when(F.try_element_at(a, F.lit(-1)).eqNullSafe(x), a).otherwise(F.concat(a, F.array(x))))


def json_list(text: Column) -> Column:
    """A JSON array as a list of strings, null where it isn't one."""
    kind = "array<string>"
    return F.when(F.startswith(F.ltrim(text), F.lit("[")), F.from_json(text, kind))


def connection(url: Column) -> Column:
    """struct<url, attach>: a database URL (driver://user:password@host:port/name) for JDBC, and as an attach string."""
    pattern = r"^([a-z]+)(?:\+[a-z0-9]+)?://([^:@/]*):?([^@/]*)@([^:/]+):?([0-9]*)/([^?]+)"
    part = lambda n: F.regexp_extract(url, pattern, n)
    port = F.coalesce(F.nullif(part(5), F.lit("")), F.lit("3306"))
    return F.struct(
        F.concat(F.lit("jdbc:"), part(1), F.lit("://"), part(4), F.lit(":"), port, F.lit("/"), part(6)).alias("url"),
        F.concat(F.lit("host="), part(4), F.lit(" port="), port, F.lit(" user="), part(2), F.lit(" passwd="), part(3), F.lit(" database="), part(6)).alias("attach"),
    )

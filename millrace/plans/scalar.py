"""Scalar expressions over rows: text, JSON, time, hashes, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import values as V
from millrace.plans.registry import query
from millrace.session import table as t


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, TRY_CAST(json_extract_string(props, '$.missing') AS TIMESTAMP) AS missing,
 coalesce(TRY_CAST(json_extract_string(props, '$.missing') AS TIMESTAMP), ts) AS at, coalesce(json_array_length(props, '$.list'), 0)::BIGINT AS n FROM events""")
def json_projection(spark: SparkSession, d: str) -> DataFrame:
    at = F.get_json_object("props", "$.missing").try_cast("timestamp_ntz")
    return t(spark, d, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), at.alias("missing"), F.coalesce(at, "ts").alias("at"),
        F.coalesce(F.json_array_length(F.get_json_object("props", "$.list")), F.lit(0)).cast("long").alias("n"),
    )


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS pos FROM lineitem)
SELECT l_orderkey, min(CASE WHEN pos = 1 THEN l_linenumber END) AS last_version, max(l_linenumber) AS highest, max(CASE WHEN l_returnflag <> 'R' THEN l_linenumber END) AS usable FROM v GROUP BY l_orderkey""")
def json_last_version(spark: SparkSession, d: str) -> DataFrame:
    """Three meanings of the latest version, read back from a JSON array."""
    item = F.struct(
        "l_shipdate", F.col("l_linenumber").alias("version"), "l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("deleted"),
        F.struct(F.lit("x").alias("md5")).alias("file"),
    )
    built = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("versions"))).alias("payload"))
    v = built.select("l_orderkey", V.versions(F.col("payload")).alias("v"))
    return v.select(
        "l_orderkey", V.last_version(F.col("v"))["version"].alias("last_version"), V.highest_version(F.col("v"))["version"].alias("highest"),
        V.latest_usable(F.col("v"))["version"].alias("usable"),
    )


@query("""WITH l AS (SELECT user_id, max(ts) AS ts, arg_max(value, ts) AS v FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events)
SELECT c_custkey, CAST(CASE WHEN v >= 50 THEN 1 WHEN v >= 20 THEN 7 WHEN v >= 5 THEN 30 ELSE 180 END AS INTEGER) AS days,
 v IS NULL OR date_sub('day', ts, now) >= CASE WHEN v >= 50 THEN 1 WHEN v >= 20 THEN 7 WHEN v >= 5 THEN 30 ELSE 180 END AS due FROM customer LEFT JOIN l ON user_id = c_custkey, n""")
def cadence_due(spark: SparkSession, d: str) -> DataFrame:
    """Due for a visit: by the cadence of the latest figures; without figures, due."""
    e = t(spark, d, "events")
    last = e.groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("v"))
    now = e.agg(F.max("ts").alias("now"))
    days = F.when(F.col("v") >= 50, 1).when(F.col("v") >= 20, 7).when(F.col("v") >= 5, 30).otherwise(180)
    joined = t(spark, d, "customer").join(last, "c_custkey", "left").join(F.broadcast(now))
    return joined.select("c_custkey", days.alias("days"), (F.col("v").isNull() | (V.full_days(F.col("now"), F.col("ts")) >= days)).alias("due"))


@query("""SELECT p_partkey, n AS cleaned FROM (SELECT p_partkey, p_type, replace(p_name, ' ', '_') AS raw, trim(p_name) AS n FROM part)""")
def tag_clean(spark: SparkSession, d: str) -> DataFrame:
    """Tags with prefixes, repeats in other spelling and noise; the first spelling of each is left."""
    raw = F.replace("p_name", F.lit(" "), F.lit("_"))
    tags = F.array(F.concat(F.lit("author_tag_"), raw), F.concat(F.lit("content_"), F.upper(raw)), F.lit("system_x"), F.lit("content_"), F.lit(None))
    return t(spark, d, "part").select("p_partkey", F.array_join(T.clean_tags(tags), "|").alias("cleaned"))


@query("""SELECT p_partkey, trim(p_name) || chr(10) || 'Tags: ' || p_brand || ', ' || p_type || CASE WHEN p_size > 25 THEN chr(10) || p_type ELSE '' END AS doc FROM part""")
def text_compose(spark: SparkSession, d: str) -> DataFrame:
    doc = T.compose(F.col("p_name"), F.when(F.col("p_size") > 25, F.col("p_type")), F.array("p_brand", "p_type"))
    return t(spark, d, "part").select("p_partkey", doc.alias("doc"))


@query(r"""WITH b AS (SELECT p_partkey, p_name AS n, ['"Neon  ' || p_brand || '!!"', 'Misc', 'District ' || p_size, p_type || ' and the, long: tail of words', ' ', 'Unknown'][p_partkey % 6 + 1] AS raw FROM part),
q AS (SELECT *, regexp_replace(regexp_replace(trim(raw), '^["''`]+|["''`]+$', '', 'g'), '[,;:]+', ' ', 'g') AS plain FROM b),
c AS (SELECT *, list_filter(string_split_regex(trim(plain), '\s+'), lambda w: w <> '' AND lower(w) NOT IN ('and', 'for', 'with')) AS ws, trim(regexp_replace(lower(plain), '[^a-z0-9]+', ' ', 'g')) IN ('', 'misc', 'unknown') OR regexp_full_match(plain, 'District [0-9]+') AS empty FROM q),
d AS (SELECT *, CASE WHEN empty THEN 'none' ELSE coalesce(nullif(rtrim(substr(array_to_string(ws[1:4], ' '), 1, 32)), ''), 'none') END AS label FROM c)
SELECT p_partkey, CASE WHEN length(n) > 12 THEN rtrim(substr(n, 1, 11)) || '…' ELSE n END AS short, label, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS key,
 trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) IN ('', 'misc', 'unknown') OR regexp_full_match(raw, 'District [0-9]+') AS bad FROM d""")
def label_clean(spark: SparkSession, d: str) -> DataFrame:
    """Suffix words fall off the end of a label; messy labels cleaned, keyed and tested."""
    named = F.concat_ws(" ", "p_name", F.lit("World"), F.lit("hub"))
    messy = F.array(
        F.concat(F.lit('"Neon  '), F.col("p_brand"), F.lit('!!"')), F.lit("Misc"), F.concat(F.lit("District "), F.col("p_size").cast("string")),
        F.concat(F.col("p_type"), F.lit(" and the, long: tail of words")), F.lit(" "), F.lit("Unknown"),
    )
    raw = F.element_at(messy, (F.col("p_partkey") % 6 + 1).cast("int"))
    label = T.clean_label(raw, F.lit("none"))
    return t(spark, d, "part").select("p_partkey", T.short_label(named, 3, 12).alias("short"), label.alias("label"), T.label_key(label).alias("key"), T.bad_label(raw).alias("bad"))


@query("""SELECT doc_id, lang FROM documents WHERE NOT coalesce(lang IN ('de', 'fr'), FALSE) AND length(coalesce(text, '')) >= 400""")
def exclude_tags(spark: SparkSession, d: str) -> DataFrame:
    tags = F.array("lang", "source")
    out = F.arrays_overlap(tags, F.array(F.lit("de"), F.lit("fr")))
    return t(spark, d, "documents").where(~F.coalesce(out, F.lit(False)) & (F.length(F.coalesce("text", F.lit(""))) >= 400)).select("doc_id", "lang")


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, nullif(regexp_extract(url, '/(\\d+)(?:[?#]|$)', 1), '') AS number, regexp_matches(url, '/file_[\\w-]+/\\d+/') AS is_file FROM pages""")
def url_parse(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select(
        "page_id", F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("host"),
        F.nullif(F.regexp_extract("url", r"/(\d+)(?:[?#]|$)", 1), F.lit("")).alias("number"), T.file_reference(F.col("url")).isNotNull().alias("is_file"),
    )


@query("""SELECT page_id, 'ab-' || CAST(page_id AS VARCHAR) AS file_id, page_id % 9 AS version FROM pages""")
def file_references(spark: SparkSession, d: str) -> DataFrame:
    """Links that name a file and a version; several links a row, those that name none dropped."""
    url = F.concat(F.lit("https://h/api/file_ab-"), F.col("page_id").cast("string"), F.lit("/"), (F.col("page_id") % 9).cast("string"), F.lit("/x"))
    links = F.filter(F.transform(F.array(url, F.col("url"), F.lit(None)), T.file_reference), lambda r: r.isNotNull())
    return t(spark, d, "pages").select("page_id", F.explode(links).alias("r")).select("page_id", "r.file_id", "r.version")


@query("""SELECT doc_id, sha256(text) AS digest, substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3, 2) || '/' || sha256(text) || '.png' AS path,
 CASE WHEN doc_id % 5 = 0 THEN 'size_mismatch' WHEN doc_id % 5 = 1 THEN 'md5_mismatch' WHEN doc_id % 5 = 2 THEN 'collision' ELSE 'confirmed' END AS status FROM documents""")
def hash_verify(spark: SparkSession, d: str) -> DataFrame:
    k, body = F.col("doc_id") % 5, F.col("text").cast("binary")
    expected = F.when(k == 1, F.lit("%%%")).otherwise(F.base64(F.unhex(F.md5(body))))
    size = F.octet_length(body)
    digest = F.sha2(body, 256)
    status = T.verification(size, F.when(k == 0, size + 1).otherwise(size), T.md5_matches(body, expected), F.when(k == 2, F.lit("0")).when(k == 3, digest), digest)
    return t(spark, d, "documents").select("doc_id", digest.alias("digest"), T.content_path(digest).alias("path"), status.alias("status"))


@query("""SELECT doc_id, round(CASE WHEN lower(source) = 'src1' THEN 120 ELSE 0 END + CASE WHEN starts_with(lower(source), 'src1') THEN 80 ELSE 0 END + CASE WHEN contains(lower(source), 'src1') THEN 45 ELSE 0 END
 + CASE WHEN contains(lower(lang), 'src1') THEN 18 ELSE 0 END + ln(n_chars + 1), 6) AS score FROM documents
 WHERE contains(lower(concat_ws(' ', coalesce(source, ''), coalesce(text, ''))), 'src1') AND contains(lower(concat_ws(' ', coalesce(source, ''), coalesce(text, ''))), 'the') ORDER BY score DESC NULLS LAST, doc_id LIMIT 50""")
def weighted_search(spark: SparkSession, d: str) -> DataFrame:
    """All terms must occur; ranked by where the query is found."""
    hay = T.haystack(F.col("source"), F.col("text"))
    found = t(spark, d, "documents")
    for term in T.search_terms("SRC1 %the_ a"):
        found = found.where(F.contains(hay, F.lit(term)))
    score = F.round(T.relevance(F.col("source"), F.col("lang"), F.col("n_chars"), "src1"), 6)
    return found.select("doc_id", score.alias("score")).orderBy(F.desc_nulls_last("score"), "doc_id").limit(50)


@query("""WITH w AS (SELECT doc_id, lang, unnest(list_filter(regexp_extract_all(lower(text), 'TERM', 1), lambda x: NOT list_contains(STOPS, x) AND NOT regexp_full_match(x, '[0-9]+'))) AS term FROM documents),
c AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT lang, term, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS INTEGER) AS rank FROM c QUALIFY rank <= 8""".replace("STOPS", str(T.STOP_WORDS)).replace("TERM", T.TERM.replace("'", "''")))
def term_counts(spark: SparkSession, d: str) -> DataFrame:
    w = t(spark, d, "documents").select("lang", F.explode(T.terms(F.col("text"))).alias("term"))
    c = w.groupBy("lang", "term").agg(F.count("*").alias("n")).where("n >= 2")
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "term"))).where("rank <= 8")


@query("""SELECT n_nationkey, [CAST(('0x' || substr(c, 2, 2)) AS INTEGER), CAST(('0x' || substr(c, 4, 2)) AS INTEGER), CAST(('0x' || substr(c, 6, 2)) AS INTEGER)] AS rgb, c AS back FROM
 (SELECT n_nationkey, '#' || substr(md5(n_name), 1, 6) AS c FROM nation)""")
def colours(spark: SparkSession, d: str) -> DataFrame:
    c = T.rgb(F.concat(F.lit("#"), F.substring(F.md5("n_name"), 1, 6)))
    return t(spark, d, "nation").select("n_nationkey", c.alias("rgb")).withColumn("back", T.hex_colour(F.get("rgb", F.lit(0)), F.get("rgb", F.lit(1)), F.get("rgb", F.lit(2))))


@query("""SELECT doc_id, regexp_matches(text, '[^\\x{0000}-\\x{024F}\\x{2000}-\\x{206F}]') AS non_latin, CASE WHEN length(text) > 42 THEN rtrim(substr(text, 1, 41)) || '…' ELSE text END AS short FROM documents""")
def display_text(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", T.non_latin(F.col("text")).alias("non_latin"), T.truncated(F.col("text")).alias("short"))


@query("""SELECT event_id, TIMESTAMP '2024-03-05 10:20:30' + to_seconds(event_id % 60) AS at, CAST(NULL AS TIMESTAMP) AS bad, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, date_sub('day', TIMESTAMP '2024-01-01', ts) AS days FROM events""")
def time_parse(spark: SparkSession, d: str) -> DataFrame:
    iso = F.concat(F.lit("2024-03-05T10:20:"), F.lpad((30 + F.col("event_id") % 60 % 30).cast("string"), 2, "0"), F.lit("+09:00"))
    at = V.iso_ntz(iso) + F.make_dt_interval(secs=F.when(F.col("event_id") % 60 >= 30, 30).otherwise(0))
    return t(spark, d, "events").select(
        "event_id", at.alias("at"), V.iso_ntz(F.lit("last tuesday")).alias("bad"), V.week(F.col("ts")).alias("week"),
        V.full_days(F.col("ts"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("days"),
    )


@query("""SELECT o_orderkey, CASE WHEN s IS NULL THEN 'timeout' WHEN s = 401 THEN 'auth' WHEN s = 404 THEN 'gone' WHEN s = 429 THEN 'rate_limited' WHEN s IN (500, 502, 503) THEN 'server' WHEN s >= 400 THEN 'client' ELSE 'ok' END AS class
 FROM (SELECT o_orderkey, [200, 401, 404, 429, 500, 502, 503, 418, NULL][1 + o_orderkey % 9] AS s FROM orders)""")
def http_errors(spark: SparkSession, d: str) -> DataFrame:
    status = F.get(F.array(*map(F.lit, (200, 401, 404, 429, 500, 502, 503, 418, None))), F.col("o_orderkey") % 9)
    return t(spark, d, "orders").select("o_orderkey", V.http_class(status).alias("class"))


@query("""SELECT c_custkey, CAST(('0x' || substr(sha256('h:' || CAST(c_custkey AS VARCHAR)), 1, 16))::UBIGINT % 12 AS INTEGER) AS stories, CASE WHEN c_acctbal > 8000 THEN 'landmark' WHEN c_acctbal >= 2000 THEN 'detached' ELSE 'row' END AS typology FROM customer""")
def massing(spark: SparkSession, d: str) -> DataFrame:
    kind = T.typology(F.col("c_acctbal") > 8000, F.col("c_acctbal"), F.lit(1), 2000.0)
    return t(spark, d, "customer").select("c_custkey", T.massing(F.col("c_custkey").cast("string"), "h:", 12).alias("stories"), kind.alias("typology"))


@query("""SELECT user_id, CASE WHEN props LIKE '%7%' THEN 'windows' WHEN props LIKE '%8%' THEN 'android' ELSE 'unknown' END AS platform, count(*) AS n FROM events GROUP BY 1, 2""")
def platforms(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.when(F.contains("props", F.lit("7")), "StandaloneWINDOWS").otherwise(""), F.when(F.contains("props", F.lit("8")), "-Android").otherwise("-x"))
    return t(spark, d, "events").groupBy("user_id", T.platform(name).alias("platform")).agg(F.count("*").alias("n"))


@query()
def unicode_fold(spark: SparkSession, d: str) -> DataFrame:
    """NFKC and the removal of punctuation and other scripts."""
    return t(spark, d, "documents").select("doc_id", T.nfkc(F.col("text")).alias("nfkc"), T.strip_punctuation(F.col("text")).alias("plain"))


@query("""SELECT c_custkey, upper(c_mktsegment) AS label FROM customer""")
def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """Labels out of fenced, listed, wrapped and plain answers."""
    u, k = F.upper("c_mktsegment"), F.col("c_custkey") % 4
    body = F.concat(F.lit('{"label": "'), u, F.lit('"}'))
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, F.concat(F.lit("["), body, F.lit("]"))).when(k == 2, F.concat(F.lit("Sure: "), body, F.lit(" ok"))).otherwise(u)
    return t(spark, d, "customer").select("c_custkey", T.parsed_label(raw).alias("label"))

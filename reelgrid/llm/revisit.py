"""Not-modified revisit resolution: an as-of join on canonical URLs.

A revisit (status 304) is resolved by the latest earlier full response (status 200) of the same
canonical URL, in the order of (time, record id). Its validators are checked: an entity tag by weak
comparison, or else the last-modified date. If they agree, the stored headers are updated by those
of the revisit, but for the headers that describe the body or the connection, and the body is the
stored one, given by its record; bodies are never moved.

The as-of is done in two levels, so that a URL with a third of all records isn't one task: within
slices of the order of (time, record id), and over one summary row per URL and slice. Slices are
quantiles of all records, so a burst at one time is cut too; their number is about the root of the
records' (SLICES at most). Records that can have no origin take no part in either.

Defined results: records with a null url, time or id are never an origin; a revisit among them, or
one without an earlier response, is `no_origin`; without validators on the revisit there is nothing
to contradict, and it is resolved; null headers count as none; repeated records are ordered
arbitrarily among themselves but are each resolved; an empty table gives an empty result.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: Headers of a 304 response that never replace stored ones (fixed values, from the HTTP caching standard).
NOT_MERGED = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade"]
TRACKING = "^(utm_[^=]*|ref|gclid|fbclid)(=|$)"
#: Slices of the order of all records, at most.
SLICES = 100_000


def canonical(url: Column) -> Column:
    """No scheme, `www.`, default port, fragment, tracking parameters or final slash; parameters sorted."""
    rest = F.regexp_replace(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, r"(?s)#.*$", "")
    host = F.regexp_replace(ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"(?s)^[^?]*\??(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def merged(stored: Column, fresh: Column) -> Column:
    allowed = F.map_filter(fresh, lambda k, v: ~F.lower(k).isin(NOT_MERGED) & v.isNotNull())
    kept = F.map_filter(stored, lambda k, v: ~F.array_contains(F.transform(F.map_keys(allowed), F.lower), F.lower(k)))
    return F.map_concat(kept, allowed)


def resolved(records: DataFrame, slices: int | None = None) -> DataFrame:
    """record_id, canonical_url, outcome, origin_id, headers of each revisit.

    records: record_id, url, time (long), status, etag, last_modified, headers (map of strings).
    """
    empty = F.create_map().cast("map<string,string>")
    r = records.where(F.col("status").isin(200, 304)).select("record_id", canonical(F.col("url")).alias("_url"), "time", "status", "etag", "last_modified", F.coalesce("headers", empty).alias("headers"))
    placed = F.col("_url").isNotNull() & F.col("time").isNotNull()
    usable = (F.col("status") == 200) & placed & F.col("record_id").isNotNull()
    full_type = "struct<time:long,record_id:{},etag:string,last_modified:string,headers:array<struct<key:string,value:string>>>".format(records.schema["record_id"].dataType.simpleString())
    lost = r.where((F.col("status") == 304) & ~placed).select("record_id", "_url", "etag", "last_modified", "headers", F.lit(None).cast(full_type).alias("_from"))

    r = r.where(placed & ((F.col("status") == 304) | F.col("record_id").isNotNull()))
    slices = slices or max(16, min(SLICES, isqrt(r.count()) // 2))
    # Records of one key lie in one slice, so slices keep the order.
    r = stored(r.repartitionByRange(slices, "time", "record_id").withColumn("_slice", F.spark_partition_id()))
    full = F.when(usable, F.struct("time", "record_id", "etag", "last_modified", F.map_entries("headers").alias("headers")).cast(full_type))

    near = Window.partitionBy("_url", "_slice").orderBy("time", "record_id", F.col("status").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = r.where(usable).groupBy("_url", "_slice").agg(F.max_by(full, F.struct("time", "record_id")).alias("_end"))
    # The last response of all earlier slices: one row per URL and slice that holds any record.
    marks = r.where("status = 304").select("_url", "_slice").distinct().join(ends, ["_url", "_slice"], "full")
    before = Window.partitionBy("_url").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    far = marks.withColumn("_far", F.last("_end", ignorenulls=True).over(before)).select("_url", "_slice", "_far")

    asked = r.withColumn("_near", F.last(full, ignorenulls=True).over(near)).where("status = 304").join(far, ["_url", "_slice"], "left")
    asked = asked.select("record_id", "_url", "etag", "last_modified", "headers", F.coalesce("_near", "_far").alias("_from")).unionByName(lost)
    agrees = F.when(F.col("etag").isNotNull(), F.coalesce(weak(F.col("etag")) == weak(F.col("_from.etag")), F.lit(False))).when(F.col("last_modified").isNotNull(), F.coalesce(F.col("last_modified") == F.col("_from.last_modified"), F.lit(False))).otherwise(True)
    outcome = F.when(F.col("_from").isNull(), "no_origin").when(agrees, "resolved").otherwise("validator_mismatch")
    asked = asked.withColumn("outcome", outcome)
    good = F.col("outcome") == "resolved"
    return asked.select(
        "record_id",
        F.col("_url").alias("canonical_url"),
        "outcome",
        F.when(good, F.col("_from.record_id")).alias("origin_id"),
        F.when(good, merged(F.map_from_entries("_from.headers"), F.col("headers"))).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Crawl records from the table pages: every third page is a revisit, numbers in paths are reduced so that URLs recur."""
    n = F.coalesce(F.try_to_number(F.regexp_extract("url", "/([0-9]{1,18})(?![0-9])", 1), F.lit("999999999999999999")).cast("long"), F.lit(0))
    k = F.col("page_id")
    revisit = k % 3 == 0
    body = F.sha2(F.coalesce("html", F.lit("")), 256)
    tag = F.when(revisit, F.floor(k / 3) % 3).otherwise(k % 3).cast("string")
    return pages.select(
        k.alias("record_id"),
        F.regexp_replace("url", "/[0-9]+", F.concat(F.lit("/"), (n % 3).cast("string"))).alias("url"),
        (k * 7 % 100003).alias("time"),
        F.when(revisit, 304).otherwise(200).alias("status"),
        F.when(k % 5 != 0, F.concat(F.when(k % 2 == 0, "W/").otherwise(""), F.lit('"'), tag, F.lit('"'))).alias("etag"),
        F.when(k % 4 != 0, F.concat(F.lit("day "), (k % 2).cast("string"))).alias("last_modified"),
        F.when(revisit, F.create_map(F.lit("date"), k.cast("string"), F.lit("content-length"), F.lit("0"), F.lit("x-cache"), F.lit("hit"))).otherwise(F.create_map(F.lit("date"), k.cast("string"), F.lit("content-length"), F.length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("digest"), body)).alias("headers"),
    )


ORACLE = r"""
WITH p AS (
  SELECT page_id AS k, html, url, coalesce(try_cast(nullif(regexp_extract(url, '/([0-9]{1,18})([^0-9]|$)', 1), '') AS BIGINT), 0) AS n FROM pages
), r AS (
  SELECT k AS record_id, regexp_replace(url, '/[0-9]+', '/' || (n % 3), 'g') AS url, k * 7 % 100003 AS time,
    CASE WHEN k % 3 = 0 THEN 304 ELSE 200 END AS status,
    CASE WHEN k % 5 <> 0 THEN '"' || CASE WHEN k % 3 = 0 THEN (k // 3) % 3 ELSE k % 3 END || '"' END AS tag,
    CASE WHEN k % 4 <> 0 THEN 'day ' || (k % 2) END AS modified,
    length(coalesce(html, '')) AS size, sha256(coalesce(html, '')) AS body
  FROM p
), u AS (
  SELECT *, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest FROM r
), c AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\??(.*)$', 1), '&'),
      lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))), '&') AS query
  FROM u
), d AS (
  SELECT *, place || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical_url FROM c
), j AS (
  SELECT a.*, b.record_id AS b_id, b.tag AS b_tag, b.modified AS b_modified, b.size AS b_size, b.body AS b_body,
    row_number() OVER (PARTITION BY a.record_id ORDER BY b.time DESC, b.record_id DESC) AS rn
  FROM d a LEFT JOIN d b ON b.canonical_url = a.canonical_url AND b.status = 200 AND (b.time, b.record_id) < (a.time, a.record_id)
  WHERE a.status = 304
), o AS (
  SELECT *, CASE WHEN b_id IS NULL THEN 'no_origin'
    WHEN tag IS NOT NULL THEN CASE WHEN tag = b_tag THEN 'resolved' ELSE 'validator_mismatch' END
    WHEN modified IS NOT NULL THEN CASE WHEN modified = b_modified THEN 'resolved' ELSE 'validator_mismatch' END
    ELSE 'resolved' END AS outcome
  FROM j WHERE rn = 1
)
SELECT record_id, canonical_url, outcome, CASE WHEN outcome = 'resolved' THEN b_id END AS origin_id,
  CASE WHEN outcome = 'resolved' THEN 'content-length: ' || b_size || chr(10) || 'date: ' || record_id || chr(10) || 'digest: ' || b_body || chr(10) || 'x-cache: hit' END AS headers
FROM o
"""

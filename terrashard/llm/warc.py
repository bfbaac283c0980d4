"""Not-modified revisits of web captures, resolved to what they revisit.

A revisit (status 304) is joined as of its time to the latest earlier full response (status 200, with a payload) of the
same canonical URL. Its validators are checked against that response's: equal entity tags (weakly compared) decide if
both have one, else equal Last-Modified values. If they agree, the record gets the response's payload, and headers that
are the response's, updated by those that a 304 may carry.

The as-of join has two levels, so no URL needs all its captures in one task: captures are range-partitioned by
(ts, record_id) into slices of SLICE_ROWS rows on average, even however times are spread; windows run within a URL and a slice;
then a table with the last response of each URL and slice is carried to later slices. Payloads take no part in that; the
chosen response is fetched at the end, by its record id and a hash of its content. All is built-in operators.

Defined results: "earlier" is by (ts, record_id); a response at the same ts counts as earlier if its record_id is smaller.
outcome is `resolved`, `validators differ` (none comparable counts as differing), `no earlier response`, or
`no time or URL` for revisits with a null ts or url. Null headers are empty; of header names that differ in case alone, the
last in code-point order gives the value. Rows that repeat a record_id are revisits of their own; responses that share a
record_id are responses of their own, and of those that share its ts too, the one with the largest hash of its content is
the latest. An empty table gives an empty one. Other columns of captures are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, settle

#: Header fields that a 304 may send to update a stored response (fixed values of RFC 9110, section 15.4.5, and Last-Modified).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Captures in a slice of time, on average.
SLICE_ROWS = 20_000
MOST_SLICES = 100_000
#: Revisits that share a copy of their response, on average.
SLOT = 256
HEADERS = "map<string,string>"


def canonical(url: Column) -> Column:
    """Host in lower case without `www.` and a default port, path (`/` if empty), sorted query; no scheme, user or fragment."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(plain, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, r"^[^/?]*", 0)
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    host = F.regexp_replace(F.lower(F.regexp_replace(host, "^.*@", "")), r"^www\.|:(80|443)?$", "")
    pairs = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda q: q != "")), "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(pairs == "", "").otherwise(F.concat(F.lit("?"), pairs)))


def weak(tag: Column) -> Column:
    return F.nullif(F.regexp_replace(F.trim(tag), "^W/", ""), F.lit(""))


def lower_names(headers: Column) -> Column:
    """Headers with names in lower case."""
    sorted_ = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("low"), e["key"].alias("key"), e["value"].alias("value"))))
    last = lambda es: F.filter(es, lambda e, i: ~F.coalesce(F.get(es, i + 1)["low"] == e["low"], F.lit(False)))
    low = F.get(F.transform(F.array(sorted_), last), F.lit(0))
    return F.coalesce(F.map_from_entries(F.transform(low, lambda e: F.struct(e["low"].alias("key"), e["value"].alias("value")))), F.create_map().cast(HEADERS))


def merged(stored: Column, sent: Column) -> Column:
    """The stored headers, updated by the permitted ones among those sent. Names are in lower case."""
    new = F.map_filter(lower_names(sent), lambda k, v: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(lower_names(stored), lambda k, v: ~F.map_contains_key(new, k)), new)


def content_hash() -> Column:
    return F.xxhash64("etag", "last_modified", F.array_sort(F.map_entries("headers")), "payload")


def asof(captures: DataFrame) -> DataFrame:
    """record_id, canonical_url, etag, last_modified, headers of each revisit, and base: the latest earlier response (ts, record_id, content, etag, last_modified) or null."""
    full = (F.col("status") == 200) & F.col("payload").isNotNull()
    slim = captures.select(
        "record_id", canonical(F.col("url")).alias("canonical_url"), F.col("ts").cast("long").alias("ts"), (F.col("status") == 304).alias("revisit"), full.alias("full"),
        "etag", "last_modified", F.when(F.col("status") == 304, F.col("headers")).alias("headers"), F.when(full, content_hash()).alias("content"),
    ).where("revisit or full")
    slices = max(1, min(MOST_SLICES, slim.count() // SLICE_ROWS + 1))
    timed = slim.where("ts is not null and canonical_url is not null").repartitionByRange(slices, "ts", "record_id")
    timed = settle(timed.withColumn("slice", F.spark_partition_id()), "slices")  # stored, as where a range ends is only sampled
    base = F.when(F.col("full"), F.struct("ts", "record_id", "content", "etag", "last_modified"))
    # Of captures that share ts and record_id, revisits stand first: none of the others is earlier.
    before = Window.partitionBy("canonical_url", "slice").orderBy("ts", "record_id", "full", "content").rowsBetween(Window.unboundedPreceding, -1)
    near = timed.withColumn("near", F.last(base, ignorenulls=True).over(before)).where("revisit")
    past = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = timed.groupBy("canonical_url", "slice").agg(F.max(base).alias("end")).withColumn("carried", F.last("end", ignorenulls=True).over(past)).where("carried is not null").drop("end")
    found = near.join(ends, ["canonical_url", "slice"], "left").withColumn("base", F.coalesce("near", "carried"))
    columns = ["record_id", "canonical_url", "ts", "etag", "last_modified", "headers", "base"]
    lost = slim.where("revisit and (ts is null or canonical_url is null)").withColumn("base", F.lit(None).cast(found.schema["base"].dataType))
    return found.select(*columns).union(lost.select(*columns))


def resolve(captures: DataFrame) -> DataFrame:
    """record_id, canonical_url, base_id, outcome, headers, payload of each revisit.

    captures: record_id, url, ts, status, etag, last_modified, headers (map of strings), payload.
    """
    tag, stored_tag = weak(F.col("etag")), weak(F.col("base.etag"))
    agree = F.when(tag.isNotNull() & stored_tag.isNotNull(), tag == stored_tag).otherwise(F.coalesce(F.col("last_modified") == F.col("base.last_modified"), F.lit(False)))
    outcome = F.when(F.col("ts").isNull() | F.col("canonical_url").isNull(), "no time or URL").when(F.col("base").isNull(), "no earlier response").when(agree, "resolved").otherwise("validators differ")
    resolved = F.col("outcome") == "resolved"
    revisits = asof(captures).select("record_id", "canonical_url", F.col("base.record_id").alias("base_id"), F.col("base.content").alias("content"), outcome.alias("outcome"), F.col("headers").alias("sent"))
    # Revisits without a payload to fetch are spread by their own ids; they'd all meet under a null key.
    revisits = settle(revisits.withColumns({"fetch": F.when(resolved, F.col("base_id")).otherwise(F.xxhash64("record_id")), "version": F.when(resolved, F.col("content")).otherwise(F.lit(0).cast("long")), "row": F.monotonically_increasing_id()}), "revisits")
    # A response that many revisits ask for is copied to slots of SLOT revisits.
    hot = revisits.where(resolved).groupBy("fetch", "version").agg(F.ceil(F.count("*") / SLOT).cast("int").alias("slots")).where("slots > 1")
    hot = settle(hot, "hot")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot.hint("merge")
    slots = F.coalesce("slots", F.lit(1))
    asked = revisits.join(hot, ["fetch", "version"], "left").withColumn("slot", F.pmod(F.xxhash64("record_id", "row"), slots).cast("int"))
    stored = captures.where("status = 200 and payload is not null").select(F.col("record_id").alias("fetch"), content_hash().alias("version"), F.col("headers").alias("stored"), "payload").dropDuplicates(["fetch", "version"])
    stored = stored.join(hot, ["fetch", "version"], "left").withColumn("slot", F.explode(F.sequence(F.lit(0), slots - 1))).withColumn("found", F.lit(True)).drop("slots")
    got = asked.join(stored, ["fetch", "version", "slot"], "left").withColumn("found", F.coalesce("found", F.lit(False)) & resolved)
    return got.select("record_id", "canonical_url", "base_id", "outcome", F.when(resolved, merged(F.col("stored"), F.col("sent"))).alias("headers"), F.when(F.col("found"), F.col("payload")).alias("payload"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures made of a table of pages: a full response for each page, and a revisit an hour on.

    A revisit has another spelling of the URL. Its entity tag is the page's, weak; each seventh page has changed, and
    each fifth revisit goes by Last-Modified alone. Each eleventh page's revisit comes before any response.
    """
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    at, day = F.col("page_id") * 60, F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))
    text = lambda c: c.cast("string")
    headers = lambda **h: F.map_from_arrays(F.array(*(F.lit(k.replace("_", "-")) for k in h)), F.array(*h.values()))
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", at.alias("ts"), F.lit(200).alias("status"), tag.alias("etag"), day.alias("last_modified"),
        headers(Date=text(at), Content_Type=F.lit("text/html"), Content_Length=text(F.length(F.coalesce("html", F.lit("")))), Vary=F.lit("Accept")).alias("headers"), F.coalesce("html", F.lit("")).alias("payload"),
    )
    later = F.when(F.col("page_id") % 11 == 0, F.lit(-1) - F.col("page_id")).otherwise(at + 3600)
    sent = F.when(F.col("page_id") % 5 == 0, F.lit(None).cast("string")).when(F.col("page_id") % 7 == 0, F.lit('"new"')).otherwise(F.concat(F.lit("W/"), tag))
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.concat(F.upper(F.regexp_extract("url", r"^[^:]*://[^/?#]*", 0)), F.regexp_replace("url", r"^[^:]*://[^/?#]*", ""), F.lit("#top")).alias("url"),
        later.alias("ts"), F.lit(304).alias("status"), sent.alias("etag"), day.alias("last_modified"), headers(Date=text(later), Content_Length=F.lit("0"), Expires=F.lit("never")).alias("headers"), F.lit(None).cast("string").alias("payload"),
    )
    return full.union(revisit)

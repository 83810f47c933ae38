"""Resolution of not-modified revisits in web archives.

A revisit record says that a page had not changed: its content is that of the latest earlier full response for the same canonical URL
whose validators agree (entity tag if both have one, otherwise last-modified date if both have one, otherwise payload digest).  What
decides thus depends on both records: each stands once for each of the four sets of validators that the other may have.  The resolved record takes the earlier payload and status, and the earlier headers replaced by those of the revisit that a not-modified
answer may carry.

The join is an as-of join by URL.  A hot URL is not dealt to one task: captures are cut into time slices of about equal counts, each slice hands
its last full response for each validator on, and these few rows are carried forward over the slices; inside a slice a window finds
the rest.

Defined results: a revisit without an earlier matching response stays unresolved (null payload); records without URL or date are
unresolved too; a response at the same instant counts as earlier if its record id is smaller; rows that repeat a record are all
resolved alike; empty tables give empty results; other columns of the records are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilflow.llm.scratch import Scratch

#: Header fields that a not-modified answer may update (RFC 9110, section 15.4.5, and RFC 9111, section 3.2), as fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "age", "server", "warning")


#: Parameters that only say where a visitor came from.
TRACKING = "utm_[a-z]+|gclid|fbclid"


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host without ``www.`` and the scheme's own port; no fragment, tracking parameters, index page or last slash; http counts as https."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    place = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")
    own = F.when(scheme == "http", r":80$").when(scheme == "https", r":443$").otherwise(r":$")
    host = F.regexp_replace(place, own, F.lit(""))
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"/index\.html?$", "/"), r"/+$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^(?:{TRACKING})=")))
    kept = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    full = F.concat(F.when(scheme == "http", F.lit("https")).otherwise(scheme), F.lit("://"), host, path, kept)
    return F.when(host != "", full)


def _kind(has: Column, asks: Column) -> Column:
    """Which validator decides between a response and a revisit that have these (0 none, 1 a date, 2 a tag, 3 both): tag, date or digest."""
    both = has.bitwiseAND(asks)
    return F.when(both >= 2, "e").when(both == 1, "m").otherwise("d")


def validators(headers: Column, digest: Column, response: bool) -> Column:
    """One key for each kind of record that this one can meet: the validators that either side has, and the value of the one that decides."""
    etag = F.regexp_replace(headers["etag"], "^W/", "")
    own = F.when(etag.isNotNull(), 2).otherwise(0) + F.when(headers["last-modified"].isNotNull(), 1).otherwise(0)

    def key(k: int) -> Column:
        has, asks = (own, F.lit(k)) if response else (F.lit(k), own)
        kind = _kind(has, asks)
        value = F.when(kind == "e", etag).when(kind == "m", headers["last-modified"]).otherwise(digest)
        return F.concat(has.cast("string"), asks.cast("string"), kind, F.lit(":"), value)

    return F.array(*[key(k) for k in range(4)])


def merged_headers(old: Column, new: Column) -> Column:
    allowed = F.map_filter(new, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(allowed), k)), allowed)


def resolve_revisits(records: DataFrame, slices: int = 64) -> DataFrame:
    """One row per revisit: record_id, canonical_url, refers_to, status, headers and payload_ref of the response that it stands for.

    ``records``: record_id (long), kind (``response`` or ``revisit``), url, date (timestamp or number), headers (map of lower-case names),
    digest, and status.  Payloads aren't moved: ``refers_to`` names the record that holds them.
    """
    rows = records.select("record_id", "kind", canonical_url(F.col("url")).alias("u"), F.col("date").cast("double").alias("at"), "headers", "digest", "status")
    # Addresses are told apart once, though several branches read them.
    scratch = Scratch(records.sparkSession)
    rows = scratch.cut(rows, "records")
    every = rows
    # Slices of equal counts: a burst of captures is cut as finely as it is full.
    cuts = rows.agg(F.percentile_approx("at", [k / slices for k in range(1, slices)], 10_000).alias("cuts")).first()["cuts"] or []
    cuts = F.array(*[F.lit(float(c)) for c in dict.fromkeys(cuts)]).cast("array<double>")
    rows = rows.where("u is not null and at is not null").withColumn("slice", F.size(F.filter(cuts, lambda c: c <= F.col("at"))))
    given = rows.where("kind = 'response'").select(
        "u", "at", "slice", "record_id", F.explode(F.array_compact(validators(F.col("headers"), F.col("digest"), True))).alias("v"), F.struct("at", "record_id", "headers", "status").alias("full")
    )
    asked = rows.where("kind = 'revisit'").select("u", "at", "slice", "record_id", F.explode(validators(F.col("headers"), F.col("digest"), False)).alias("v"), F.col("headers").alias("new"))

    # The last response of each (URL, validator, slice); carried forward, there are at most ``slices`` of them for a URL and validator.
    last = given.groupBy("u", "v", "slice").agg(F.max_by("full", F.struct("at", "record_id")).alias("full"))
    carried = last.select("u", "v", (F.col("slice") + 1).alias("slice"), "full", F.lit(None).cast("double").alias("at"), F.lit(None).cast("long").alias("record_id"))
    wanted = asked.select("u", "v", "slice").distinct().select("u", "v", "slice", F.lit(None).cast(last.schema["full"].dataType).alias("full"), F.lit(0.0).alias("at"), F.lit(None).cast("long").alias("record_id"))
    forward = Window.partitionBy("u", "v").orderBy("slice", F.col("at").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    opened = carried.unionByName(wanted).withColumn("full", F.last("full", ignorenulls=True).over(forward)).where("at is not null").select("u", "v", "slice", "full")

    within = Window.partitionBy("u", "v", "slice").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    ask = F.lit(True)
    inside = given.select("u", "v", "slice", "at", "record_id", "full", F.lit(None).cast("map<string,string>").alias("new"), F.lit(False).alias("ask"))
    inside = inside.unionByName(asked.select("u", "v", "slice", "at", "record_id", F.lit(None).cast(last.schema["full"].dataType).alias("full"), "new", ask.alias("ask")))
    near = inside.withColumn("near", F.last("full", ignorenulls=True).over(within)).where("ask")
    found = near.join(opened.withColumnRenamed("full", "far"), ["u", "v", "slice"], "left").withColumn("hit", F.coalesce("near", "far"))
    # A revisit stands once for each of the four kinds of responses: the latest of what they give holds, and repeated rows stay repeated.
    found = found.groupBy("record_id", "u", "at").agg(F.max_by("hit", F.struct("hit.at", "hit.record_id")).alias("hit"), F.first("new").alias("new"), F.count("*").alias("n"))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("n") / 4).cast("int"))))
    resolved = found.select(
        "record_id",
        F.col("u").alias("canonical_url"),
        F.col("hit.record_id").alias("refers_to"),
        F.col("hit.status").alias("status"),
        F.when(F.col("hit").isNotNull(), merged_headers(F.coalesce(F.col("hit.headers"), F.create_map().cast("map<string,string>")), F.coalesce("new", F.create_map().cast("map<string,string>")))).alias("headers"),
    )
    lost = every.where("kind = 'revisit' AND (u is null OR at is null)").select("record_id", F.col("u").alias("canonical_url"))
    return scratch.last(resolved.unionByName(lost, allowMissingColumns=True))

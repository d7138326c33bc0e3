"""Resolves not-modified revisit records of web archives to the responses they refer to."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import saved

LEAST = -(2**63)
#: The fields that a 304 answer may update in a stored response (RFC 7232, 4.1).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that name no other content.
TRACKING = r"^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)(?:=|$)"


def canonical_url(url: Column) -> Column:
    """A URL's key: no scheme, user, www, default port, fragment or tracking parameters; host in lower case;
    parameters in order; no slash at the end. Null stays null; what is no URL is trimmed and lower-cased up to its path."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    place, query = F.substring_index(bare, "?", 1), F.regexp_extract(bare, r"\?(.*)$", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.substring_index(place, "/", 1)), r"^[^@]*@|:(?:80|443)$", ""), r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_extract(place, r"^[^/]*(/.*)$", 1), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(url.isNotNull(), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def _span(cuts: list[tuple[int, int]], ts: Column, record_id: Column) -> Column:
    """How many of the ascending cuts are not after (ts, record_id), by bisection."""
    if not cuts:
        return F.lit(0)
    known = [F.from_json(F.lit(json.dumps([c[k] for c in cuts])), "array<bigint>") for k in range(2)]  # folded to literals once
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])

    def step(at: Column, width: Column) -> Column:
        place = F.least(at + width, F.lit(len(cuts)))
        t, i = (F.element_at(k, place) for k in known)
        return F.when((at + width <= len(cuts)) & ((t < ts) | (t == ts) & (i <= record_id)), at + width).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def resolve(records: DataFrame, buckets: int = 1024) -> DataFrame:
    """record_id, url_key, kind, source_id, status, headers, payload_digest of every record.

    ``records`` needs record_id (long), url, ts (long), kind ('response' or 'revisit'), headers (map of lower-case names) and
    payload_digest; other columns are ignored. A revisit refers to the latest response of its canonical URL before it, in order of
    (ts, record_id). The first validator that both have decides (etag, compared weakly; last-modified; payload digest):

    - equal: status 'resolved', with the response's digest and its headers, updated by those of the revisit that are permitted;
    - different: 'stale'; none in common: 'unchecked'; no earlier response, or no URL: 'missing'. Digest and headers stay its own.

    A response is its own source, status 'response'. Other kinds pass with status 'other'. Records with a null ts come first. Null
    headers are none. Every row is a record of its own, rows with a null or repeated record_id too; of responses that tie in (ts, record_id)
    the last by digest and headers counts as the latest, and none of them is before a revisit that ties with them. An empty table gives no rows.

    The as-of join never sorts a URL's whole history in one task: the records' order by (ts, record_id) is cut into ``buckets`` spans at quantiles of a
    sample of about 64 records for each, so that neither a far-off time nor a burst puts more than its share into one; the latest response is looked
    for within (URL, span), and the last one of earlier spans is carried over from one row for each. A hot URL is spread over all spans.
    """
    r = records.select(
        F.col("record_id").cast("long").alias("record_id"),
        canonical_url(F.col("url").cast("string")).alias("url_key"),
        F.coalesce(F.col("ts").cast("long"), F.lit(LEAST)).alias("ts"),
        F.col("kind").cast("string").alias("kind"),
        F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>")).alias("headers"),
        F.col("payload_digest").cast("string").alias("payload_digest"),
    )
    r = saved(r.withColumn("row", F.monotonically_increasing_id()), "records")
    place = F.coalesce("record_id", F.lit(LEAST))
    rate = max(1, r.count() // (64 * buckets))
    sample = sorted(tuple(x) for x in r.where(F.pmod(F.xxhash64("row"), F.lit(rate)) == 0).select("ts", place).limit(256 * buckets).collect())
    cuts = sorted({sample[len(sample) * k // buckets] for k in range(1, buckets)}) if sample else []
    is_response = F.coalesce(F.col("kind") == "response", F.lit(False))
    order = ["ts", "record_id", "full", "tie", "row"]
    tie = F.struct(F.coalesce("payload_digest", F.lit("")), F.xxhash64(F.array_sort(F.map_entries("headers"))))
    keyed = r.select("row", "record_id", "url_key", "ts", tie.alias("tie"), is_response.alias("full"), _span(cuts, F.col("ts"), place).alias("span"))
    keyed = keyed.where(F.col("url_key").isNotNull())
    here = F.last(F.when(F.col("full"), F.col("row")), ignorenulls=True).over(Window.partitionBy("url_key", "span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    within = keyed.select("row", "url_key", "span", "full", here.alias("here"))
    ends = keyed.groupBy("url_key", "span").agg(F.max(F.when(F.col("full"), F.struct(*order))).alias("end"))
    before = F.last("end", ignorenulls=True).over(Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(F.col("url_key").alias("k"), F.col("span").alias("s"), before["row"].alias("earlier"))
    found = within.where(~F.col("full")).join(carried, (F.col("url_key") == F.col("k")) & (F.col("span") == F.col("s")), "left")
    found = saved(found.select(F.col("row").alias("revisit_row"), F.coalesce("here", "earlier").alias("response_row")).where("response_row IS NOT NULL"), "sources")
    full = r.where(is_response).select(F.col("row").alias("full_row"), F.col("record_id").alias("full_id"), F.col("headers").alias("full_headers"), F.col("payload_digest").alias("full_digest"))
    joined = r.join(found, (F.col("kind") == "revisit") & (F.col("row") == F.col("revisit_row")), "left").join(full, F.col("response_row") == F.col("full_row"), "left")
    own, stored = lambda h: F.try_element_at("headers", F.lit(h)), lambda h: F.try_element_at("full_headers", F.lit(h))
    same = F.coalesce(_weak(own("etag")) == _weak(stored("etag")), own("last-modified") == stored("last-modified"), F.col("payload_digest") == F.col("full_digest"))
    status = (
        F.when(F.col("kind") == "response", "response").when(~F.coalesce(F.col("kind") == "revisit", F.lit(False)), "other").when(F.col("response_row").isNull(), "missing")
        .when(same.isNull(), "unchecked").when(same, "resolved").otherwise("stale")
    )
    fresh = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("full_headers", lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
    done = joined.withColumn("status", status)
    resolved = F.col("status") == "resolved"
    return done.select(
        "record_id",
        "url_key",
        "kind",
        F.when(F.col("status") == "response", F.col("record_id")).otherwise(F.col("full_id")).alias("source_id"),
        "status",
        F.when(resolved, merged).otherwise(F.col("headers")).alias("headers"),
        F.when(resolved, F.col("full_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """A capture history of ``pages``: three records for each, at times page_id, page_id + 40 and page_id + 80.

    The first is the full response. By a rule on page_id the later ones are not-modified answers whose etag still holds, whose
    etag is another one, that only have a modification time, or full responses again with the page's text.
    """
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.sha2(F.coalesce(F.col("html").cast("string"), F.lit("")), 256).alias("digest"))
    each = page.select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("nth"))
    rule = F.pmod(F.col("page_id") + F.col("nth"), F.lit(5))
    response = (F.col("nth") == 0) | (rule == 0)
    tag = F.concat(F.lit('"'), F.substr(F.col("digest"), F.lit(1), F.lit(12)), F.lit('"'))
    entry = lambda name, value: F.struct(F.lit(name).alias("key"), value.alias("value"))
    date = F.concat(F.lit("day "), (F.col("page_id") + 40 * F.col("nth")).cast("string"))
    etag = F.when(response, tag).when(rule == 1, F.concat(F.lit("W/"), tag)).when(rule == 2, F.lit('"other"')).when(rule == 4, tag)
    entries = F.array(
        entry("date", date), entry("etag", etag), entry("last-modified", F.when(rule != 4, F.concat(F.lit("day "), F.col("page_id").cast("string")))),
        entry("content-type", F.when(response, F.lit("text/html")).otherwise("text/plain")), entry("cache-control", F.when(~response, F.concat(F.lit("max-age="), F.col("nth").cast("string")))),
    )
    return each.select(
        (F.col("page_id") * 3 + F.col("nth")).alias("record_id"), "page_id", "url", (F.col("page_id") + 40 * F.col("nth")).alias("ts"),
        F.when(response, "response").otherwise("revisit").alias("kind"), F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("headers"),
        F.when(response, F.col("digest")).alias("payload_digest"),
    )


def header_text(headers: Column) -> Column:
    """Fields in order of name, a line each."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")

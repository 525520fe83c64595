"""WARC not-modified revisits: each takes the body of the latest earlier full response of its URL.

Records are rows (record_id, kind, url, at, status, headers, digest, body): kind is ``response`` or
``revisit`` (others pass through), at the capture time, headers an array of (name, value), digest the
payload digest or null. One row is returned for each record.

Plan
1. Canonical URL: see ``canonical_url``; http and https, www, ports, fragments and tracking parameters fall together.
2. As-of join on narrow rows (no headers of responses, no bodies): records are dealt by range of (URL, time, id), so the
   captures of one URL spread over as many tasks as they fill. In each range a window carries the last full
   response on; what the ranges before hold of a URL comes from one row for each (URL, range).
3. Validators: an ETag of the revisit must equal the response's (weakly), else its Last-Modified must, else its
   payload digest. Digests, where both have one, must be equal in any case.
4. Headers, by the rules for freshening a stored response: those of the revisit replace the stored ones of the same
   name, but for hop-by-hop names, names that its Connection header lists, and those that describe the stored body.
5. Bodies come by one join from the records that serve as a response.

States: ``full`` (a response, or any record that is no revisit), ``resolved``, ``no_url``, ``no_date``, ``no_earlier``,
``no_validator``, ``validator_mismatch``. An unresolved revisit keeps its own status, headers and body.
A full response is one of status 200 with a URL and a time. Earlier means a smaller (at, record_id), null ids before
others; a response of the same time and id is not earlier. Of several responses with the same URL, time and id the one
with the greatest (digest, hash of headers and body) counts. Repeated rows each get their row. A table without rows
gives none. Other columns of ``records`` are not read, so their names cannot clash. Bodies of any length pass as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written

#: Parameters that name a visit and not a page; names of headers that a revisit must not set.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref", "sid", "phpsessid", "jsessionid")
NOT_MERGED = ("connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade", "content-length", "content-encoding", "content-range", "content-type")
_HEADERS = "array<struct<name:string,value:string>>"
#: Scheme, user, host, port, path and query of a URL without its fragment.
_URL = r"^[ \t\r\n]*([Hh][Tt][Tt][Pp][Ss]?)://(?:[^/?#@]*@)?([^/?#:@]+)(?::([0-9]*))?(/[^?#]*)?(?:\?([^#]*))?"


def canonical_url(url: Column) -> Column:
    """host/path?query: host in lower case without ``www``, user, default port; path without slashes at its end; query
    without tracking parameters and empty ones, sorted. Null for what is no http or https URL."""
    part = lambda n: F.regexp_extract(url, _URL, n)
    host = F.regexp_replace(F.lower(part(2)), r"^www[0-9]*\.", "")
    port = F.when(part(3).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), part(3)))
    path = F.concat(F.lit("/"), F.regexp_replace(part(4), "^/+|/+$", ""))
    kept = F.filter(F.split(F.regexp_replace(part(5), r"[ \t\r\n]+$", ""), "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^[^=]*", 0)).isin(*TRACKING))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise("")
    return F.when(url.rlike(_URL), F.concat(host, port, path, query))


def _header(headers: str, name: str) -> Column:
    """The first value of a header, null if it is missing or empty."""
    values = F.filter(F.col(headers), lambda h: F.lower(h["name"]) == name)
    return F.nullif(F.trim(F.get(F.transform(values, lambda h: h["value"]), F.lit(0))), F.lit(""))


def merged_headers(stored: Column, new: Column) -> Column:
    """Stored headers, those that ``new`` may set replaced by it."""
    named = F.flatten(F.transform(F.filter(new, lambda h: F.lower(h["name"]) == "connection"), lambda h: F.transform(F.split(F.lower(F.coalesce(h["value"], F.lit(""))), ","), lambda x: F.trim(x))))
    allowed = F.filter(new, lambda h: h["name"].isNotNull() & ~F.lower(h["name"]).isin(*NOT_MERGED) & ~F.array_contains(named, F.lower(h["name"])))
    names = F.transform(allowed, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(stored, lambda h: h["name"].isNull() | ~F.array_contains(names, F.lower(h["name"]))), allowed)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each record: record_id, kind, canonical_url, state, response_id (of the response that serves), status, headers, body."""
    no_headers = F.array().cast(_HEADERS)
    rows = records.select(
        F.col("record_id").cast("long").alias("record_id"),
        F.col("kind").cast("string").alias("kind"),
        canonical_url(F.col("url").cast("string")).alias("canonical_url"),
        F.col("at").cast("long").alias("at"),
        F.col("status").cast("int").alias("status"),
        F.coalesce(F.filter(F.col("headers").cast(_HEADERS), lambda h: h.isNotNull()), no_headers).alias("headers"),
        F.col("digest").cast("string").alias("digest"),
        F.col("body").cast("string").alias("body"),
    )
    is_revisit = F.coalesce(F.col("kind") == "revisit", F.lit(False))
    placed = F.col("canonical_url").isNotNull() & F.col("at").isNotNull()
    full = F.coalesce((F.col("kind") == "response") & (F.col("status") == 200), F.lit(False)) & placed
    key = F.xxhash64("headers", "body")  # with URL, time, id and digest it names a response's content
    marks = [_header("headers", "etag").alias("etag"), _header("headers", "last-modified").alias("modified")]
    serving = rows.where(full).withColumn("_hash", key)
    narrow = ["canonical_url", "at", "record_id", "digest"]
    asked = rows.where(is_revisit & placed).select(*narrow, *marks, "headers", F.lit(None).cast("long").alias("_hash"))
    held = serving.select(*narrow, *marks, no_headers.alias("headers"), "_hash").distinct()

    # a range is one task's share of (URL, time, id); revisits come before responses of the same time and id
    order = ["at", "record_id", F.col("_hash").isNotNull(), "digest", "_hash"]
    dealt = written(asked.unionByName(held).repartitionByRange("canonical_url", "at", "record_id", "_hash").withColumn("_range", F.spark_partition_id()), "captures")
    response = F.when(F.col("_hash").isNotNull(), F.struct("record_id", "at", "digest", "etag", "modified", "_hash"))
    # what the window orders last by (at, record_id, revisit or response, digest, hash) before a row is the latest earlier response
    before = Window.partitionBy("canonical_url", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.where("_hash is not null").groupBy("canonical_url", "_range").agg(F.max_by(F.struct("record_id", "at", "digest", "etag", "modified", "_hash"), F.struct("at", "record_id", "digest", "_hash")).alias("_end"))
    spans = dealt.select("canonical_url", "_range").distinct().join(ends, ["canonical_url", "_range"], "left")
    carried = spans.select("canonical_url", "_range", F.last("_end", ignorenulls=True).over(Window.partitionBy("canonical_url").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    within = dealt.withColumn("_in", F.last(response, ignorenulls=True).over(before)).where("_hash is null")
    met = within.join(carried, ["canonical_url", "_range"]).withColumn("_r", F.coalesce("_in", "_carried"))

    weak = lambda c: F.regexp_replace(c, "^[Ww]/", "")
    same = (
        F.when(F.col("etag").isNotNull(), weak(F.col("etag")).eqNullSafe(weak(F.col("_r.etag"))))
        .when(F.col("modified").isNotNull(), F.col("modified").eqNullSafe(F.col("_r.modified")))
        .otherwise(F.col("digest").eqNullSafe(F.col("_r.digest")))
    ) & (F.col("digest").isNull() | F.col("_r.digest").isNull() | (F.col("digest") == F.col("_r.digest")))
    state = F.when(F.col("_r").isNull(), "no_earlier").when(F.coalesce("etag", "modified", "digest").isNull(), "no_validator").when(same, "resolved").otherwise("validator_mismatch")
    judged = met.withColumn("state", state)
    found = judged.where("state = 'resolved'").select("canonical_url", "record_id", "headers", *(F.col(f"_r.{c}").alias(f"_{c}") for c in ("record_id", "at", "digest")), F.col("_r._hash").alias("_hash"))
    bodies = serving.select(F.col("canonical_url").alias("_url"), F.col("record_id").alias("_rid"), F.col("at").alias("_rat"), F.col("digest").alias("_rdigest"), F.col("_hash").alias("_rhash"), F.col("status").alias("_status"), F.col("headers").alias("_stored"), F.col("body").alias("_body")).dropDuplicates(["_url", "_rid", "_rat", "_rdigest", "_rhash"])
    on = F.expr("canonical_url = _url and _record_id <=> _rid and _at = _rat and _digest <=> _rdigest and _hash = _rhash")
    columns = ["record_id", "kind", "canonical_url", "state", "response_id", "status", "headers", "body"]
    resolved = found.join(bodies, on).select("record_id", F.lit("revisit").alias("kind"), "canonical_url", F.lit("resolved").alias("state"), F.col("_record_id").alias("response_id"), F.col("_status").alias("status"), merged_headers(F.col("_stored"), F.col("headers")).alias("headers"), F.col("_body").alias("body"))

    # the others as they are: unresolved revisits take their state, by what they share with the judged row
    none = F.lit(None).cast("long").alias("response_id")
    passed = rows.where(~is_revisit).select(*columns[:3], F.lit("full").alias("state"), none, "status", "headers", "body")
    lost = rows.where(is_revisit & ~placed).select(*columns[:3], F.when(F.col("canonical_url").isNull(), "no_url").otherwise("no_date").alias("state"), none, "status", "headers", "body")
    left = judged.where("state <> 'resolved'").select(F.col("canonical_url").alias("_url"), F.col("record_id").alias("_rid"), F.col("at").alias("_rat"), F.xxhash64("headers", "digest").alias("_rhash"), "state").distinct()
    unresolved = rows.where(is_revisit & placed).withColumn("_hash", F.xxhash64("headers", "digest")).join(left, F.expr("canonical_url = _url and record_id <=> _rid and at = _rat and _hash = _rhash")).select(*columns[:3], "state", none, "status", "headers", "body")
    return passed.unionByName(lost).unionByName(unresolved).unionByName(resolved)


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """WARC records of a table of pages: each page a full response and, 500 captures later, a revisit of its URL.

    By id, validators are an ETag, a Last-Modified date, a weak ETag, or the payload digest alone. The revisit's are those
    of its own page, so it resolves unless another page of the URL was captured between with other content.
    """
    sum_ = F.md5(F.coalesce(F.col("html"), F.lit("")))
    nth = F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(4))
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    etag = lambda mark: header("ETag", F.concat(F.lit(mark + '"'), sum_, F.lit('"')))
    own = lambda mark: F.when(nth.isin(0, 2), F.array(F.when(nth == 2, etag(mark)).otherwise(etag("")))).when(nth == 1, F.array(header("Last-Modified", sum_))).otherwise(F.array().cast(_HEADERS))
    first = F.concat(F.array(header("Content-Type", F.lit("text/html")), header("Content-Length", F.octet_length(F.coalesce("html", F.lit(""))).cast("string")), header("Cache-Control", F.lit("max-age=60")), header("Server", F.lit("a"))), own(""))
    again = F.concat(F.array(header("content-length", F.lit("0")), header("cache-control", F.lit("max-age=600")), header("Connection", F.lit("close, X-Hop")), header("X-Hop", F.lit("1")), header("X-Cache", F.lit("hit"))), own("W/"))
    base = {"record_id": F.col("page_id"), "url": F.col("url"), "at": F.col("page_id") * 2, "digest": F.when(nth == 3, sum_)}
    response = pages.select(*(v.alias(k) for k, v in base.items()), F.lit("response").alias("kind"), F.lit(200).alias("status"), first.alias("headers"), F.col("html").alias("body"))
    revisit = pages.select(*(v.alias(k) for k, v in (base | {"at": F.col("page_id") * 2 + 1001}).items()), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), again.alias("headers"), F.lit(None).cast("string").alias("body"))
    return response.unionByName(revisit)

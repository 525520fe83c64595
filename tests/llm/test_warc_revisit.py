"""Not-modified revisits against a plain-Python resolution, record by record."""

import collections
import random

import pytest

from skein.llm.warc_revisit import NOT_MERGED, canonical_url, resolve_revisits

SCHEMA = "record_id long, kind string, url string, at long, status int, headers array<struct<name:string,value:string>>, digest string, body string, state int, _hash string, canonical_url string"


@pytest.mark.parametrize(
    "url,expected",
    [
        ("http://Example.COM", "example.com/"),
        ("HTTPS://www.example.com:443/a/b/?utm_source=x&b=2&a=1#top", "example.com/a/b?a=1&b=2"),
        ("http://www2.example.com:8080//a?ref=x", "example.com:8080/a"),
        ("http://user:pw@example.com/a?REF=1&x", "example.com/a?x"),
        ("  http://example.com/A?b=%20 ", "example.com/A?b=%20"),
        ("http://example.com?b&a", "example.com/?a&b"),
        ("ftp://example.com/a", None),
        ("example.com/a", None),
        ("", None),
        (None, None),
    ],
)
def test_canonical_url(spark, url, expected):
    assert spark.createDataFrame([(url,)], "u string").select(canonical_url(__import__("pyspark").sql.functions.col("u"))).collect()[0][0] == expected


def _first(headers, name):
    for n, v in headers:
        if n is not None and n.lower() == name:
            return (v or "").strip() or None
    return None


def _reference(rows):
    """(record_id, state, response_id, status, headers, body) of each row; urls are canonical up to ``#``."""
    out = []
    for rid, kind, url, at, status, headers, digest, body in rows:
        headers = headers or []
        canon = url.split("#")[0] if url else None
        if kind != "revisit":
            out.append((rid, "full", None, status, tuple(headers), body))
            continue
        if canon is None or at is None:
            out.append((rid, "no_url" if canon is None else "no_date", None, status, tuple(headers), body))
            continue
        order = lambda a, i: (a, i is not None, i or 0)
        before = [r for r in rows if r[1] == "response" and r[4] == 200 and r[2] and r[2].split("#")[0] == canon and r[3] is not None and order(r[3], r[0]) < order(at, rid)]
        if not before:
            out.append((rid, "no_earlier", None, status, tuple(headers), body))
            continue
        last = max(before, key=lambda r: order(r[3], r[0]))
        etag, modified = _first(headers, "etag"), _first(headers, "last-modified")
        held = last[5] or []
        bare = lambda x: x[2:] if x and x[:2] in ("W/", "w/") else x
        if etag:
            ok = bare(etag) == bare(_first(held, "etag"))
        elif modified:
            ok = modified == _first(held, "last-modified")
        elif digest is not None:
            ok = digest == last[6]
        else:
            out.append((rid, "no_validator", None, status, tuple(headers), body))
            continue
        if not ok or (digest is not None and last[6] is not None and digest != last[6]):
            out.append((rid, "validator_mismatch", None, status, tuple(headers), body))
            continue
        hop = {x.strip() for n, v in headers if n and n.lower() == "connection" for x in (v or "").lower().split(",")}
        new = [(n, v) for n, v in headers if n and n.lower() not in NOT_MERGED and n.lower() not in hop]
        names = {n.lower() for n, _ in new}
        merged = [(n, v) for n, v in held if n is None or n.lower() not in names] + new
        out.append((rid, "resolved", last[0], last[4], tuple(merged), last[7]))
    return out


def _rows():
    rng, rows = random.Random(2), []
    for i in range(500):
        hot = rng.random() < 0.4  # one URL holds two fifths of all captures
        url = "http://a.example/hot" if hot else f"http://a.example/{rng.randrange(40)}"
        if rng.random() < 0.2:
            url += "#part"
        version = rng.randrange(3)
        tag = rng.choice([f'"{version}"', f'W/"{version}"', None, " "])
        headers = [(rng.choice(["ETag", "etag"]), tag)] if tag else []
        if rng.random() < 0.5:
            headers.append(("Last-Modified", f"day {version}"))
        headers += rng.choice([[], [("Set-Cookie", "a"), ("set-cookie", "b")], [("Connection", "close, X-Own"), ("X-Own", "1"), ("x-cache", None)], [(None, "odd"), ("Content-Length", "3")]])
        rows.append((i, rng.choice(["response", "revisit", "revisit"]), url, rng.randrange(120), 200, headers, rng.choice([None, f"sha1:{version}"]), f"body {i}"))
    long = "long " * 200_000
    rows += [
        (900, "response", "http://b.example/", 5, 200, None, "d", long),
        (901, "revisit", "http://b.example/", 5, 304, [("Content-Type", "text/x"), ("Age", "1")], "d", None),
        (899, "revisit", "http://b.example/", 5, 304, None, "d", None),  # of the same time, but before
        (902, "response", "http://c.example/", 1, 404, None, "d", "not found"),
        (903, "revisit", "http://c.example/", 2, 304, None, "d", None),
        (904, "revisit", None, 2, 304, None, "d", None),
        (905, "revisit", "http://c.example/", None, 304, None, "d", None),
        (906, "response", "http://d.example/", None, 200, None, "d", "undated"),
        (907, "revisit", "http://d.example/", 9, 304, None, None, None),
        (908, "response", "http://e.example/", 1, 200, None, "d", None),
        (909, "revisit", "http://e.example/", 2, 304, [], "d", "x"),
        (910, "metadata", "http://e.example/", 2, None, [], "d", ""),
        (None, "response", "http://e.example/", 3, 200, [("Age", "7")], "n", "no id"),
        (911, "revisit", "http://e.example/", 4, 304, [], "n", None),
        (912, None, None, None, None, None, None, None),
        (913, "revisit", "http://f.example/", 4, 304, [], None, None),
    ]
    rows += [rows[-3], rows[-3], rows[500], rows[500]]  # repeated rows
    return rows


def _found(df):
    return collections.Counter((r.record_id, r.state, r.response_id, r.status, tuple(tuple(h) for h in r.headers), r.body) for r in df.collect())


@pytest.mark.parametrize("partitions", ["4", "23"])
def test_resolution(spark, partitions):
    rows = _rows()
    # extra columns that are named as the operator names its own
    df = spark.createDataFrame([r + (7, "x", "y") for r in rows], SCHEMA)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as many ranges as asked for
    try:
        found = _found(resolve_revisits(df))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    expected = collections.Counter(_reference(rows))
    assert found == expected
    assert {s for _, s, *_ in expected} == {"full", "resolved", "no_url", "no_date", "no_earlier", "no_validator", "validator_mismatch"}


def test_empty(spark):
    assert resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0

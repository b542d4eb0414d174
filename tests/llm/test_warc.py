"""WARC archives: round trips, revisits, the merged index."""

import base64
import gzip
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import warc

SCHEMA = "page_id long, url string, html string, key long, sha string, turn int, first long, captured timestamp_ntz"
LONG = "wörd " * 60_000


def frame(spark, rows):
    df = spark.createDataFrame([(i, u, h, 1, "x", 2, 3) for i, u, h in rows], SCHEMA.rsplit(",", 1)[0])
    return df.withColumn("captured", F.when(F.col("page_id") % 5 > 0, F.expr("timestamp_ntz'2024-02-29 23:59:50.25' + make_dt_interval(0, 0, 0, page_id)")))


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def brute(rows, least):
    """Multiset of (page_id, bytes, digest, type, refers_to)."""
    first, out = {}, []
    for i, _, h in rows:
        d = digest(h or "")
        if i is not None and len((h or "").encode()) >= least:
            first[d] = min(first.get(d, i), i)
    for i, _, h in rows:
        d, n = digest(h or ""), len((h or "").encode())
        f = first.get(d) if n >= least else None
        out.append((i, n, d, "response" if f in (None, i) else "revisit", None if f in (None, i) else f))
    return sorted(out, key=repr)


PAGES = [(i, f"http://{'ab'[i % 2]}.example.org/{i % 7}", f"<p>{i % 30}</p>") for i in range(-40, 200)]
PAGES += [(500, None, None), (501, "", ""), (502, "no url", None), (503, "https://u@Ex.org:80/a b\r\nX: y#f", "a\r\n\r\nWARC/1.1\r\n\r\nb"), (504, "ftp://x", LONG), (505, "ftp://x", LONG), (506, "http://é/ü?q", "\0\x85")]
PAGES += [(3, "again", "<p>3</p>"), (-27, "x", "<p>3</p>"), (-27, "x", "<p>3</p>"), (None, "n", "<p>3</p>"), (None, "m", "only"), (None, "m", "only")]


@pytest.mark.parametrize("least, size", [(0, 16 << 20), (9, 4000)])
def test_round_trip(spark, tmp_path, least, size):
    path = f"file://{tmp_path}/a"
    warc.write_archives(frame(spark, PAGES), path, captured="captured", least=least, size=size)
    got = warc.read_archives(spark, path).collect()
    assert sorted(((r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == brute(PAGES, least)
    assert all(r["sound"] for r in got)
    known = {i: (u, h) for i, u, h in PAGES if i is not None and i not in (3, -27)}
    for r in got:
        if r["key"] in known:
            u = known[r["key"]][0]
            assert r["url"] == (u if u is None else u.replace("\r", "%0D").replace("\n", "%0A"))
    assert {r["captured"] for r in got if r["key"] in (5, 11)} == {"1970-01-01T00:00:00Z", "2024-03-01T00:00:01Z"}
    files = {f.name: gzip.decompress(f.read_bytes()) for f in (tmp_path / "a").glob("*.gz")}
    for r in got:  # the index finds each record, and its block is the payload's
        raw = files[r["file"]][r["offset"] : r["offset"] + r["length"]]
        ((_, _, head, block),) = warc.records_of(raw + b"\r\n\r\n")
        assert raw.startswith(b"WARC/1.1\r\n") and len(block) == int(head["content-length"])
        if r["key"] == 503:
            assert block.endswith(b"\r\n\r\na\r\n\r\nWARC/1.1\r\n\r\nb")
    if size == 4000:
        assert len(files) > 3


def test_hot_payload_is_dealt_over_files(spark, tmp_path):
    rows = [(i, "u", "same payload") for i in range(3000)] + [(5000 + i, "u", f"p{i}") for i in range(3000)]
    warc.write_archives(frame(spark, rows), f"file://{tmp_path}/a", size=200_000)
    got = warc.read_archives(spark, f"file://{tmp_path}/a").filter("key < 3000").groupBy("file").count().collect()
    assert len(got) >= 15 and max(r["count"] for r in got) < 400
    assert sorted(((r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, f"file://{tmp_path}/a").collect()), key=repr) == brute(rows, 0)


def test_empty_table(spark, tmp_path):
    warc.write_archives(frame(spark, []), f"file://{tmp_path}/a")
    entries = warc.read_archives(spark, f"file://{tmp_path}/a")
    assert entries.count() == 0 and warc.capture_index(entries).count() == 0


def test_foreign_and_broken_files():
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    page = b"WARC/1.0\nWARC-Type: response\nWARC-Target-URI: http://x/\nContent-Length: 23\n\nHTTP/1.1 200 OK\r\n\r\nbody\r\n\r\n"
    two = gzip.compress(info) + gzip.compress(page)  # a member for each record
    (a, b) = warc.records_of(two)
    assert a[2]["warc-type"] == "warcinfo" and b[0] == len(info) and warc.entry(b[2], b[3])[4:6] == (4, digest("body"))
    assert list(warc.records_of(b"")) == [] and list(warc.records_of(b"\r\n\r\n")) == []
    for broken in (page[:-10], b"junk\r\n" + page, b"WARC/1.0\r\nContent-Length: x\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.records_of(broken))


def test_loser_tree():
    r = random.Random(4)
    for k in (0, 1, 2, 3, 5, 8, 13):
        for most in (3, 1000):
            runs = [sorted((r.randrange(most), i) for i in range(r.randrange(40))) for _ in range(k)]
            got = [(x, n) for n, first, end in warc.merged(runs) for x in runs[n][first:end]]
            assert got == sorted(((x, n) for n, run in enumerate(runs) for x in run))
    tail = [list(range(100 * i, 100 * i + 100)) for i in range(6)]
    assert len(list(warc.merged(tail))) == 6  # runs that don't overlap are handed over whole


@pytest.mark.parametrize("run, many", [(20_000, 50_000), (37, 60)])
def test_index_is_one_order(spark, tmp_path, run, many):
    """Also where most captures are of one URL."""
    rows = [(i, "http://hot.org/" if i % 3 else f"http://{i % 11}.Example.com/{i % 5}", f"{i % 50}") for i in range(900)] + [(2000, None, "x"), (None, "http://hot.org/", "y")]
    warc.write_archives(frame(spark, rows), f"file://{tmp_path}/a", size=30_000, captured="captured")
    entries = warc.read_archives(spark, f"file://{tmp_path}/a").withColumn("part", F.lit("clash"))
    got = warc.capture_index(entries, run, many).toPandas().sort_values("place")
    assert list(got.place) == list(range(len(rows))) and set(got.part) == {"clash"}
    keys = [(u or "", c, -1 if k != k else k) for u, c, k in zip(got.url_key, got.captured, got.key)]
    assert keys == sorted(keys) and got.url_key.iloc[0] is None


def test_url_keys(spark):
    urls = ["http://www.Example.ORG:8080/A/b?c=d#e", "https://u:p@example.org", "mailto:x", None, "", "HTTP://a.b/?q"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.url_key(F.col("u"))).collect()]
    assert got == ["org,example,www)/A/b?c=d", "org,example)", "mailto:x", None, "", "b,a)/?q"]


def test_query(spark, sf):
    import pandas as pd

    from glyphmill.llm import queries

    pages = pd.read_parquet(f"{sf}/pages.parquet")
    got = queries.queries()["op11_capture_merge"](spark, sf).collect()
    mine = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr)
    assert mine == brute(list(pages[["page_id", "url", "html"]].itertuples(index=False, name=None)), 0)
    assert all(re.fullmatch("[A-Z2-7]{32}", r["payload_digest"]) for r in got)

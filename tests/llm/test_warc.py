import gzip
import random

from pyspark.sql import functions as F

from marlstone.llm import warc


def canon(spark, *urls):
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    return [r.c for r in df.select(warc.canonical_url(F.col("url")).alias("c")).collect()]


def test_canonical_urls(spark):
    assert canon(spark, "HTTP://www.Ex.com:80/A/?b=2&a=1&utm_source=x#f", "https://user@ex.com/A?a=1&b=2&ref=y", "https://ex.com", "http://ex.com/", None, "http://ex.com:8080/x//") == ["ex.com/A?a=1&b=2", "ex.com/A?a=1&b=2", "ex.com", "ex.com", None, "ex.com:8080/x"]


def brute(rows):
    """(record_id, response_id, validator, status, headers, payload) with one pass per revisit."""
    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    out = []
    for rid, url, time, kind, headers, digest, _ in rows:
        if kind != "revisit":
            continue
        best = max(((t, i, h, d, p) for i, u, t, k, h, d, p in rows if k == "response" and url is not None and u == url and time is not None and t is not None and t < time), key=lambda x: x[:2], default=None)
        if best is None:
            out.append((rid, None, None, "orphan", None, None))
            continue
        _, i, h, d, p = best
        h, new = low(h), low(headers)
        tag = lambda m: None if m.get("etag") is None else m["etag"].removeprefix("W/")
        checks = [("etag", tag(new), tag(h)), ("last-modified", new.get("last-modified"), h.get("last-modified")), ("digest", digest, d)]
        name, a, b = next((c for c in checks if c[1] is not None and c[2] is not None), ("none", 1, 1))
        good = a == b
        merged = {**h, **{k: v for k, v in new.items() if k in warc.UPDATED_HEADERS}}
        out.append((rid, i, name, "resolved" if good else "changed", merged if good else None, p if good else None))
    return sorted(out, key=str)


def run(spark, rows):
    found = warc.resolve_revisits(spark.createDataFrame(rows, warc.RECORD).repartition(4))
    return sorted(((r.record_id, r.response_id, r.validator, r.status, r.headers, None if r.payload is None else bytes(r.payload)) for r in found.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for k in range(600):
        kind = rng.choice(["response", "revisit"])
        headers = {n: v for n, v in (("ETag", rng.choice(['"a"', 'W/"a"', '"b"'])), ("Last-Modified", rng.choice("xy")), ("Date", str(k)), ("Content-Length", str(k))) if rng.random() < 0.6}
        url = "http://hot/" if rng.random() < 0.4 else f"http://h{rng.randrange(30)}/"
        rows.append((k, url, rng.randrange(300), kind, headers, rng.choice(["d1", "d2", None]), b"body%d" % k if kind == "response" else None))
    assert run(spark, rows) == brute(rows)


def test_one_burst_and_stray_times(spark):
    rng = random.Random(2)
    rows = [(k, "http://hot/", 10**9 + rng.randrange(50), rng.choice(["response", "revisit"]), {}, None, b"x") for k in range(400)]
    rows += [(1000, "http://hot/", -(10**12), "response", {}, None, b"first"), (1001, "http://hot/", 10**15, "revisit", {}, None, None), (1002, "http://hot/", 5, "revisit", {}, None, None)]
    rows = [(*r[:6], r[6] if r[3] == "response" else None) for r in rows]
    assert run(spark, rows) == brute(rows)


def test_only_full_responses_count(spark):
    rows = [(1, "http://a/", 1, "response", {}, None, b"full", 200, "x"), (2, "http://a/", 2, "response", {}, None, b"no", 404, "x"), (3, "http://a/", 3, "response", {}, None, b"part", 206, "x"), (4, "http://a/", 4, "revisit", {}, None, None, 304, "x")]
    found = warc.resolve_revisits(spark.createDataFrame(rows, f"{warc.RECORD}, code int, Status string"))
    assert [(r.response_id, bytes(r.payload), r.status) for r in found.collect()] == [(1, b"full", "resolved")]
    twice = spark.createDataFrame([(1, "http://a/", 1, "response", {"A": "b"}, None, b"2"), (1, "http://a/", 1, "response", {"A": "a"}, None, b"1"), (4, "http://a/", 4, "revisit", None, None, None)], warc.RECORD)
    assert [(bytes(r.payload), r.headers) for r in warc.resolve_revisits(twice).collect()] == [(b"1", {"a": "a"})]


def test_broken_and_long_files(monkeypatch):
    full = record("response", "http://a/", "HTTP/1.1 200 OK", b"z" * 300_000)
    packed = gzip.compress(full) + gzip.compress(full)
    monkeypatch.setattr(warc._Unpacked, "PIECE", 1000)
    assert [len(r["payload"]) for r in warc.parsed(packed)] == [300_000] * 2 and [r["code"] for r in warc.parsed(full)] == [200]
    assert len(list(warc.parsed(packed[:-30]))) == 1 and len(list(warc.parsed(packed[: len(packed) // 2] + b"junk"))) == 1
    assert list(warc.parsed(full.replace(b"Content-Length: ", b"Content-Length: x"))) == [] and list(warc.parsed(b"\x1f\x8bjunk")) == [] and list(warc.parsed(b"")) == []


def test_edges(spark):
    assert run(spark, []) == []
    rows = [
        (1, "http://a/", 5, "response", None, None, b"x"), (2, "http://a/", 5, "revisit", None, None, None), (3, "http://a/", 6, "revisit", None, None, None), (4, None, 7, "revisit", {}, None, None),
        (5, "http://a/", None, "revisit", {}, None, None), (6, "http://a/", 6, "response", {}, None, b""), (7, "http://a/", 9, "revisit", {"Expires": "e", "Set-Cookie": "s"}, "d", None),
    ]
    assert run(spark, rows) == brute(rows)
    assert len(run(spark, [*rows, rows[2], rows[0]])) == len(brute(rows)) + 1


def record(kind, url, http, payload, digest=None):
    block = http.encode() + b"\r\n\r\n" + payload
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2024-01-0{1 if kind == 'response' else 2}T00:00:00Z\r\nContent-Length: {len(block)}" + (f"\r\nWARC-Payload-Digest: {digest}" if digest else "")
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_files(spark, tmp_path):
    full = record("response", "http://a.org/x", 'HTTP/1.1 200 OK\r\nETag: "1"\r\nContent-Type: text/html', b"<p>hi</p>\r\n\r\nmore", "sha1:A")
    again = record("revisit", "https://www.a.org/x/", 'HTTP/1.1 304 Not Modified\r\nETag: "1"\r\nDate: now', b"")
    (tmp_path / "one.warc").write_bytes(record("warcinfo", "-", "x", b"y") + full)
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(again) + gzip.compress(record("response", "http://b/", "HTTP/1.1 200 OK", b"")[:-20]))
    captures = warc.read_warc(spark, str(tmp_path))
    assert captures.count() == 2
    (r,) = warc.resolve_revisits(captures).collect()
    assert r.status == "resolved" and bytes(r.payload) == b"<p>hi</p>\r\n\r\nmore" and r.headers == {"etag": '"1"', "content-type": "text/html", "date": "now"}

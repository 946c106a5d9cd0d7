"""Not-modified revisits of web archives, resolved to the full responses they stand for.

A capture is (record_id long, url, time long, kind 'response' or 'revisit', headers map, digest, payload), and maybe code
(int), the status of the answer. Full responses are those of code 200, or without one; other responses stand for nothing.
Each revisit is joined, as of its time, to the latest strictly earlier full response of the same canonical URL;
of responses at one time the largest record_id counts. Validators are then checked in this order: entity
tags (weakly: without W/), dates of last modification, payload digests. The first kind that both
records have decides; if they have none in common, the revisit stays unvalidated but resolved. A
resolved revisit gets the payload, and the response's headers with those replaced that a not-modified
answer may update.

The as-of join sorts URLs and times by range, so that a URL with a third of all captures, crawled in one burst or over
years, is spread over as many tasks as its rows fill; what is latest before a task's rows comes from one row for each
URL and task. Payloads join by record at the end, where adaptive execution splits a response with very many revisits.

Captures without URL or time resolve nothing and aren't resolved. Repeated rows each give a row; of responses
that share a record_id the smallest row counts. Other columns of the captures are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import BATCH_BYTES, map_batches, stored, table, without

#: Headers that a 304 response may update in a stored response, in lower case.
UPDATED_HEADERS = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't change what a URL means.
TRACKING = "utm_[a-z]+|gclid|fbclid|ref"
RECORD = "record_id long, url string, time long, kind string, headers map<string,string>, digest string, payload binary"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and default port, path without closing slash, other parameters in order; no scheme, user or fragment."""
    part = lambda pattern, of=None: F.regexp_extract(F.lower(url) if of is None else of, pattern, 1)
    host = F.regexp_replace(part(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)"), r"^www\d*\.|:(?:80|443)?$", "")
    rest = F.regexp_replace(F.regexp_replace(url, r"(?s)#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = F.regexp_replace(part(r"(?s)^([^?]*)", rest), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(part(r"(?s)\?(.*)$", rest), "&"), lambda p: (p != "") & ~p.rlike(f"^(?:{TRACKING})(?:=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def lower_keys(headers: Column) -> Column:
    """Names in lower case; of names that differ in case only, the last counts."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))


def merged(stored_headers: Column, fresh: Column) -> Column:
    """The stored headers, updated where that is permitted."""
    may = lambda k: k.isin(*UPDATED_HEADERS)
    return F.map_concat(F.map_filter(stored_headers, lambda k, _: ~(may(k) & F.coalesce(F.map_contains_key(fresh, k), F.lit(False)))), F.map_filter(fresh, lambda k, _: may(k)))


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url, canonical, time, response_id, validator, status, headers, digest, payload.

    status: resolved, changed (a validator differs) or orphan (no earlier response); the last two have no payload.
    validator: etag, last-modified, digest, none; null for orphans.
    """
    full_ones = "kind = 'response'" + (" and coalesce(code, 200) = 200" if "code" in captures.columns else "")
    known = captures.withColumn("kind", F.when(F.expr(full_ones), "response").when(F.col("kind") == "revisit", "revisit"))
    known = known.select("record_id", "url", "time", "kind", "headers", "digest", "payload").withColumn("canonical", canonical_url(F.col("url")))
    # what happens at one time is one row; equal URLs and times are in one slice
    light = known.filter("canonical is not null and time is not null and kind is not null").groupBy("canonical", "time").agg(F.max(F.when(F.col("kind") == "response", F.col("record_id"))).alias("response"), F.max(F.col("kind") == "revisit").alias("asked"))
    light = stored(light.repartitionByRange("canonical", "time").withColumn("slice", F.spark_partition_id()))
    within = Window.partitionBy("canonical", "slice").orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    near = light.withColumn("near", F.last("response", ignorenulls=True).over(within)).filter("asked").select("canonical", "time", "slice", "near")
    last = light.groupBy("canonical", "slice").agg(F.max(F.when(F.col("response").isNotNull(), F.struct("time", "response"))).alias("last"))
    before = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    far = last.withColumn("far", F.last("last", ignorenulls=True).over(before)["response"]).select("canonical", "slice", "far")
    chosen = near.join(far, ["canonical", "slice"], "left").select("canonical", "time", F.coalesce("near", "far").alias("response_id"), F.when(F.col("near").isNull(), F.col("slice") + 1).otherwise(0).cast("long").alias("copy"))
    # a response before its own slice is copied for each later one; only the first URL of a slice goes on from an earlier one, so there is one copy for each slice at most
    copies = chosen.filter("copy > 0 and response_id is not null").groupBy("response_id").agg(F.collect_set("copy").alias("copies"))

    entries = F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>")))
    full = known.filter("kind = 'response'").withColumnRenamed("record_id", "response_id").join(F.broadcast(copies), "response_id", "left")
    full = full.withColumn("copy", F.explode(F.concat(F.array(F.lit(0).cast("long")), F.coalesce("copies", F.array().cast("array<bigint>"))))).groupBy("response_id", "copy").agg(F.min(F.struct("time", "url", entries.alias("entries"), "digest", "payload")).alias("r"))
    response = full.select("response_id", "copy", F.struct(lower_keys(F.map_from_entries("r.entries")).alias("headers"), F.col("r.digest").alias("digest"), F.col("r.payload").alias("payload")).alias("full"))
    revisits = known.filter("kind = 'revisit'").drop("payload")
    asking = revisits.join(chosen, ["canonical", "time"], "left").withColumn("copy", F.when(F.col("response_id").isNull(), F.xxhash64("record_id")).otherwise(F.col("copy")))
    joined = asking.join(response, ["response_id", "copy"], "left")
    fresh, old = lower_keys(F.col("headers")), F.col("full.headers")
    tag = lambda m: F.regexp_replace(m["etag"], r"^W/", "")
    same = [("etag", tag(fresh), tag(old)), ("last-modified", fresh["last-modified"], old["last-modified"]), ("digest", F.col("digest"), F.col("full.digest"))]
    validator, agrees = F.lit("none"), F.lit(True)
    for name, a, b in reversed(same):
        both = a.isNotNull() & b.isNotNull()
        validator, agrees = F.when(both, name).otherwise(validator), F.when(both, a == b).otherwise(agrees)
    found = F.col("full").isNotNull()
    good = found & agrees
    return joined.select(
        "record_id", "url", "canonical", "time", "response_id", F.when(found, validator).alias("validator"), F.when(~found, "orphan").when(agrees, "resolved").otherwise("changed").alias("status"),
        F.when(good, merged(old, fresh)).alias("headers"), F.when(good, F.col("full.digest")).alias("digest"), F.when(good, F.col("full.payload")).alias("payload"),
    )


class _Unpacked:
    """Bytes of an archive, plain or in gzip members, unpacked as they are asked for; a member that is cut or broken ends them."""

    PIECE = 1 << 20

    def __init__(self, content: bytes):
        self.content, self.at, self.packed = memoryview(content), 0, content[:2] == b"\x1f\x8b"
        self.member, self.held = None, b""

    def _more(self) -> bytes:
        if not self.packed or self.at >= len(self.content):
            piece = b"" if self.packed else bytes(self.content[self.at : self.at + self.PIECE])
            self.at += len(piece)
            return piece
        while self.at < len(self.content):
            self.member = self.member or zlib.decompressobj(31)
            piece = bytes(self.content[self.at : self.at + self.PIECE])
            try:
                out = self.member.decompress(piece)
            except zlib.error:
                self.at = len(self.content)
                return b""
            self.at += len(piece) - len(self.member.unused_data)
            if self.member.eof:
                self.member = None
            if out:
                return out
        return b""

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the next mark, which is passed over; None if there is none."""
        looked = 0
        while (end := self.held.find(mark, max(looked - len(mark), 0))) < 0:
            looked = len(self.held)
            more = self._more()
            if not more:
                return None
            self.held += more
        out, self.held = self.held[:end], self.held[end + len(mark) :]
        return out

    def take(self, size: int) -> bytes:
        pieces, n = [self.held], len(self.held)
        while n < size and (more := self._more()):
            pieces.append(more)
            n += len(more)
        whole = b"".join(pieces)
        self.held = whole[size:]
        return whole[:size]

    def skip(self, marks: bytes) -> None:
        while True:
            self.held = self.held.lstrip(marks)
            if self.held:
                return
            self.held = self._more()
            if not self.held:
                return


def parsed(content: bytes) -> Iterator[dict]:
    """Records of an archive file, plain or in gzip members; revisit and response records only.

    A record that ends early, doesn't begin like one or doesn't tell its size ends the file.
    """
    data = _Unpacked(content)
    while True:
        data.skip(b"\r\n")
        found = data.until(b"\r\n\r\n")
        if found is None or not found.startswith(b"WARC/"):
            return
        head = _fields(found)
        size = head.get("content-length", "")
        if not (size.isascii() and size.isdigit()):
            return
        block = data.take(int(size))
        if len(block) < int(size):
            return
        if head.get("warc-type") not in ("response", "revisit"):
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        status = http.split(b"\r\n", 1)[0].split()[1:2]
        code = int(status[0]) if status and status[0].isdigit() and len(status[0]) == 3 else None
        yield {"url": head.get("warc-target-uri"), "date": head.get("warc-date"), "kind": head["warc-type"], "code": code, "headers": _fields(http), "digest": head.get("warc-payload-digest"), "payload": payload if head["warc-type"] == "response" else None}


def _fields(head: bytes) -> dict[str, str]:
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, colon, v in lines if colon}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Captures of archive files; record_id is a hash of file and place, time in seconds. A file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "place", "url", "date", "kind", "code", "headers", "digest", "payload"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.binary()]
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows, held = [], 0
                for k, r in enumerate(parsed(content)):
                    rows.append((name, k, r["url"], r["date"], r["kind"], r["code"], list(r["headers"].items()), r["digest"], r["payload"]))
                    held += len(r["payload"] or b"")
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = map_batches(files, "file string, place long, url string, date string, kind string, code int, headers map<string,string>, digest string, payload binary", run)
    return found.select(F.xxhash64("file", "place").alias("record_id"), "url", F.unix_timestamp(F.try_to_timestamp("date")).alias("time"), "kind", "code", "headers", "digest", "payload")


def captures_of(pages: DataFrame) -> DataFrame:
    """A crawl log made of pages: each is a response, and is asked for again later under another spelling of its URL.

    By page_id modulo 5 the answer has another entity tag, no tag, a weak tag, or the same one.
    """
    pages = without(pages.select("page_id", "url", "html"))
    digest = F.sha2("html", 256)
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    day = F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))
    kind = F.pmod("page_id", F.lit(5))
    sent = F.when(kind == 0, F.lit('"stale"')).when(kind == 2, F.concat(F.lit("W/"), tag)).when(kind != 1, tag)
    response = pages.select((F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 10).alias("time"), F.lit("response").alias("kind"), F.create_map(F.lit("ETag"), tag, F.lit("Last-Modified"), day, F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), F.col("page_id").cast("string")).alias("headers"), digest.alias("digest"), F.col("html").cast("binary").alias("payload"))
    again = F.map_filter(F.create_map(F.lit("ETag"), sent, F.lit("Last-Modified"), day, F.lit("Content-Type"), F.lit("ignored"), F.lit("Date"), (F.col("page_id") + 1000).cast("string")), lambda _, v: v.isNotNull())
    revisit = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "^https?://", "HTTPS://WWW."), F.lit("#again")).alias("url"), (F.col("page_id") * 10 + 4999).alias("time"), F.lit("revisit").alias("kind"), again.alias("headers"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("binary").alias("payload"))
    return response.unionByName(revisit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op3: revisits of all pages, resolved."""
    found = resolve_revisits(captures_of(table(spark, sf_dir, "pages")))
    h = F.col("headers")
    return found.select("record_id", "canonical", "time", "response_id", "validator", "status", h["etag"].alias("etag"), h["content-type"].alias("content_type"), h["date"].alias("date"), "digest", F.octet_length("payload").cast("long").alias("n_bytes"))


ORACLE = r"""
with p as (select page_id, url, html, '"' || substr(sha256(html), 1, 16) || '"' tag, 'day ' || cast(page_id % 28 as varchar) as day from pages),
c as (select page_id * 2 record_id, url, page_id * 10 as time, 'response' kind, tag etag, day lm, cast(page_id as varchar) as date, html from p
 union all select page_id * 2 + 1, regexp_replace(url, '^https?://', 'HTTPS://WWW.') || '#again', page_id * 10 + 4999, 'revisit', case page_id % 5 when 0 then '"stale"' when 1 then null when 2 then 'W/' || tag else tag end, day, cast(page_id + 1000 as varchar), null from p),
d as (select *, regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1), '^www\d*\.|:(?:80|443)?$', '', 'g') host, regexp_replace(regexp_replace(url, '(?s)#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '') rest from c),
e as (select *, list_sort(list_filter(string_split(regexp_extract(rest, '(?s)\?(.*)$', 1), '&'), lambda q: q <> '' and not regexp_matches(q, '^(?:utm_[a-z]+|gclid|fbclid|ref)(?:=|$)'))) kept from d),
f as (select *, host || regexp_replace(regexp_extract(rest, '(?s)^([^?]*)', 1), '/+$', '') || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end canonical from e),
r as (select canonical, time, max(record_id) response_id from f where kind = 'response' group by all),
v as (select v.*, r.response_id from f v asof left join r on v.canonical = r.canonical and v.time > r.time where v.kind = 'revisit'),
j as (select v.record_id, v.canonical, v.time, v.response_id, v.etag new_tag, v.date new_date, o.etag, o.html, case when o.record_id is null then null when v.etag is not null then 'etag' else 'last-modified' end validator,
 case when o.record_id is null then 'orphan' when v.etag is not null then case when ltrim(regexp_replace(v.etag, '^W/', '')) = o.etag then 'resolved' else 'changed' end when v.lm = o.lm then 'resolved' else 'changed' end status from v left join f o on o.record_id = v.response_id)
select record_id, canonical, time, response_id, validator, status, case when status = 'resolved' then coalesce(new_tag, etag) end etag, case when status = 'resolved' then 'text/html' end content_type, case when status = 'resolved' then new_date end date, case when status = 'resolved' then sha256(html) end digest, case when status = 'resolved' then cast(octet_length(encode(html)) as bigint) end n_bytes from j
"""

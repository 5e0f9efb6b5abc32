"""WARC records and the resolution of not-modified revisits.

A revisit says that a page hadn't changed, and has no body. It is resolved to the latest earlier full
response of the same canonical URL: an as-of join. Its validators must agree with that response's,
then its headers are laid over the response's, but for those that describe the body.

Statuses: resolved, mismatch (validators differ), unverified (no validator on both sides; the
response is still named), none (no earlier response, or no URL). Earlier means a smaller time; of
responses at one time the greatest record id counts. Null times are before all others. Repeated rows
each give their row; further columns of the records are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paneloom.llm.shared import by_value

by_value(__name__)

# fixed values: query parameters that don't name a page
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
# fixed values: headers that a not-modified answer may not replace
OF_THE_BODY = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding", "trailer", "connection", "keep-alive", "upgrade", "te", "proxy-authenticate")
#: Time units of a bucket within which responses and revisits of a URL are ordered.
BUCKET = 4096

RECORDS = "record_id string, kind string, url string, time long, headers map<string,string>, digest string, body binary"


def canonical_url(url: Column) -> Column:
    """Without scheme, www., default port, fragment, closing slash and tracking parameters; host in lower case, parameters sorted."""
    u = F.regexp_replace(url.cast("string"), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), "^www[0-9]*[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, "^[^:]+://[^/?]*([^?]*)", 1), "/+$", "")
    params = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(u, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(params == "", "").otherwise(F.concat(F.lit("?"), params)))


def _validated(own: Column, other: Column, own_digest: Column, other_digest: Column) -> Column:
    """True, False, or null if no validator is on both sides. Entity tags come first, weak ones compare like strong ones."""
    tag = lambda h: F.regexp_replace(F.try_element_at(h, F.lit("etag")), "^W/", "")
    date = lambda h: F.try_element_at(h, F.lit("last-modified"))
    return F.coalesce(tag(own) == tag(other), date(own) == date(other), own_digest == other_digest)


def merged_headers(stored: Column, newer: Column) -> Column:
    allowed = F.map_filter(F.coalesce(newer, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*OF_THE_BODY))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(allowed), k)), allowed)


def resolve_revisits(records: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(record_id, time, canonical, status, response_id, headers) of every revisit among records.

    records: record_id, kind (response or revisit), url, time, headers (names in lower case), digest.
    A URL with very many records is ordered within buckets of time; what a bucket inherits is the last
    response of the buckets before it, of which there is one row a bucket.
    """
    rows = records.where(F.col("kind").isin("response", "revisit")).select("record_id", "kind", "time", canonical_url(F.col("url")).alias("canonical"), "headers", "digest")
    rows = rows.withColumn("slot", F.floor(F.coalesce("time", F.lit(-(1 << 62))) / bucket))
    stored = F.when(F.col("kind") == "response", F.struct("time", "record_id", "headers", "digest"))
    lone = rows.where("canonical is null and kind = 'revisit'")
    rows = rows.where("canonical is not null").withColumn("stored", stored)
    # maps have no order, so the last response of a slot is found by time and id
    ends = rows.where("kind = 'response'").groupBy("canonical", "slot").agg(F.max_by("stored", F.struct(F.coalesce("time", F.lit(-(1 << 62))), "record_id")).alias("last"))
    slots = ends.select("canonical", "slot", "last").unionByName(rows.where("kind = 'revisit'").select("canonical", "slot").distinct().withColumn("last", F.lit(None).cast(ends.schema["last"].dataType)))
    slots = slots.groupBy("canonical", "slot").agg(F.max_by("last", F.when(F.col("last").isNotNull(), 1).otherwise(0)).alias("last"))
    before = W.partitionBy("canonical").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    carried = slots.select("canonical", "slot", F.last("last", ignorenulls=True).over(before).alias("carried"))
    inside = W.partitionBy("canonical", "slot").orderBy(F.col("time").asc_nulls_first(), F.when(F.col("kind") == "revisit", 0).otherwise(1), "record_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    met = rows.withColumn("near", F.last("stored", ignorenulls=True).over(inside)).where("kind = 'revisit'").join(carried, ["canonical", "slot"], "left")
    found = met.withColumn("found", F.coalesce("near", "carried"))
    ok = _validated(F.col("headers"), F.col("found.headers"), F.col("digest"), F.col("found.digest"))
    status = F.when(F.col("found").isNull(), "none").when(ok, "resolved").when(~ok, "mismatch").otherwise("unverified")
    out = found.select("record_id", "time", "canonical", status.alias("status"), F.col("found.record_id").alias("response_id"), F.when(ok, merged_headers(F.col("found.headers"), F.col("headers"))).alias("headers"))
    return out.unionByName(lone.select("record_id", "time", "canonical", F.lit("none").alias("status"), F.lit(None).cast("string").alias("response_id"), F.lit(None).cast("map<string,string>").alias("headers")))


# ---- files


def _text(b: bytes) -> str:
    """Of a head: UTF-8, or Latin-1 where it isn't."""
    try:
        return b.strip().decode("utf-8")
    except UnicodeDecodeError:
        return b.strip().decode("latin-1")


def _head(block: bytes) -> dict[str, str]:
    out = {}
    for line in re.sub(rb"\r?\n[ \t]+", b" ", block).splitlines()[1:]:
        name, sep, value = line.partition(b":")
        if sep:
            out[_text(name).lower()] = _text(value)
    return out


#: Bytes of a head that hasn't ended, after which a file is taken to be damaged there, and of a piece that is read at once.
LONGEST_HEAD, PIECE = 1 << 20, 1 << 20


def inflated(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """A file's bytes in pieces, unpacked if it is gzipped, member by member. What follows a damaged member's good part, up to the next member's mark, is skipped."""
    first = read(2)
    if first != b"\x1f\x8b":
        while first:
            yield first
            first = read(PIECE)
        return
    left, mark = first, b"\x1f\x8b\x08"
    while True:
        engine = zlib.decompressobj(31)
        while not engine.eof:
            left = left or read(PIECE)
            if not left:
                return  # the last member is cut off
            try:
                # a bounded piece at a time, so that no record's size is the memory of a task
                out = engine.decompress(left, PIECE)
                left = engine.unconsumed_tail
            except zlib.error:
                while (at := left.find(mark, 1)) < 0:
                    more = read(PIECE)
                    if not more:
                        return
                    left = left[-2:] + more
                left = left[at:]
                break
            if out:
                yield out
        else:
            left = engine.unused_data
        while len(left) < 3 and (more := read(PIECE)):
            left += more
        if not left:
            return


def blocks_of(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(head, block) of the records; a record with a head that can't be read, or without its whole block, is left out."""
    held = bytearray()

    def fill() -> bool:
        piece = next(pieces, b"")
        held.extend(piece)
        return bool(piece)

    while True:
        while (at := held.find(b"WARC/")) < 0:
            del held[:-4]
            if not fill():
                return
        del held[:at]
        while (end := held.find(b"\r\n\r\n")) < 0 and len(held) <= LONGEST_HEAD:
            if not fill():
                return
        size = _head(bytes(held[:end])).get("content-length", "0") if end >= 0 else ""
        if not size.isdecimal() or len(size) > 15:
            del held[:5]  # the next record is sought behind this mark
            continue
        stop = end + 4 + int(size)
        while len(held) < stop:
            if not fill():
                return
        yield bytes(held[:end]), bytes(held[end + 4 : stop])
        del held[:stop]


def parse_warc(data: bytes | Callable[[int], bytes]) -> Iterator[dict]:
    """The records of one file, plain or gzipped, given whole or by a function that reads so many bytes more.

    Damaged records are left out: gzip members that don't unpack, heads without an end or with a length
    that isn't a number, blocks that are cut off. A date that isn't one is a null time.
    """
    if not callable(data):
        import io

        data = io.BytesIO(data).read
    for top_, block in blocks_of(inflated(data)):
        head = _head(top_)
        kind, status, http, body = head.get("warc-type", ""), b"", {}, block
        if head.get("content-type", "").startswith("application/http"):
            top, _, body = block.partition(b"\r\n\r\n")
            http, status = _head(top), top.split(b"\r\n")[0]
        if kind == "response" and b" 304" in status[:16]:
            kind = "revisit"
        stamp = re.sub(r"\D", "", head.get("warc-date", ""))[:14]
        yield {"record_id": head.get("warc-record-id"), "kind": kind, "url": head.get("warc-target-uri"), "time": int(stamp) if len(stamp) == 14 else None, "headers": http, "digest": head.get("warc-payload-digest"), "body": body}


def format_warc(record: dict) -> bytes:
    """One record; `time` is YYYYMMDDhhmmss as a number. parse_warc gives it back; null fields are left out of the head."""
    fields = {"WARC-Type": record["kind"], "WARC-Record-ID": record["record_id"], "WARC-Target-URI": record["url"], "WARC-Payload-Digest": record["digest"]}
    if record["time"] is not None:
        t = f"{record['time']:014d}"
        fields["WARC-Date"] = f"{t[:4]}-{t[4:6]}-{t[6:8]}T{t[8:10]}:{t[10:12]}:{t[12:14]}Z"
    status = "304 Not Modified" if record["kind"] == "revisit" else "200 OK"
    line = lambda k, v: f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n".encode("utf-8", "replace")
    http = b"".join(line(k, v) for k, v in sorted((record["headers"] or {}).items()) if v is not None)
    block = f"HTTP/1.1 {status}\r\n".encode() + http + b"\r\n" + (record["body"] or b"")
    head = b"".join(line(k, v) for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head + f"Content-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files under a path that Spark can read; a file is a row of Spark's, and so has 2 GB at most, and is unpacked piece by piece."""

    def run(batches):
        kind = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("time", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("digest", pa.string()), ("body", pa.binary())])
        for b in batches:
            for data in b.column(0):
                held = []
                for r in parse_warc(data.as_py()):
                    held.append(r | {"headers": list(r["headers"].items())})
                    if len(held) == 500:
                        yield pa.RecordBatch.from_pylist(held, kind)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, kind)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)


def captures_of_pages(pages: DataFrame, later: int = 2001) -> DataFrame:
    """Two crawls of a table of pages as records: full answers, then not-modified answers.

    Page p is answered in full at time 2p, but for those with p mod 10 = 7, and revisited at time
    2p + later. Its tag is the digest of its markup, and a stale one where p mod 5 = 4.
    """
    p, digest = F.col("page_id").cast("long"), F.md5(F.coalesce(F.col("html"), F.lit("")))
    full = F.create_map(F.lit("content-length"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("string"), F.lit("content-type"), F.lit("text/html"), F.lit("etag"), digest)
    again = F.create_map(F.lit("age"), p.cast("string"), F.lit("content-length"), F.lit("0"), F.lit("etag"), F.concat(F.when(p % 5 == 4, "stale-").otherwise("W/"), digest))
    one = lambda name, kind, time, headers: pages.select(F.concat(F.lit(name), p.cast("string")).alias("record_id"), F.lit(kind).alias("kind"), "url", time.alias("time"), headers.alias("headers"), digest.alias("digest"))
    return one("full-", "response", p * 2, full).where(F.substring_index("record_id", "-", -1).cast("long") % 10 != 7).unionByName(one("again-", "revisit", p * 2 + later, again))

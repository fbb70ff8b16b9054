"""WARC: reading and writing records, and resolving not-modified revisits.

A revisit says that a page had not changed since an earlier capture. It is resolved by an as-of join:
by canonical URL, to the latest full response strictly before it. The validators that the revisit carries must
hold there (entity tags compared weakly; else the last-modified time; else the payload digest); then the
response's headers are updated with those of the revisit that an update may change.

The as-of join is over instants: responses of one URL and time are one row, combined map-side, and so are revisits. It is a
running maximum within (URL, time slice), with what earlier slices carry over: slices are summed map-side into one row each, so a
URL with a third of all captures is spread over all slices. Payloads never take part; a resolved row names the response's
record and digest.

Defined cases: a null URL or date resolves to nothing (`no_earlier_response`); captures of one instant are not earlier than each
other; of responses at one instant the one with the greatest record id counts; a revisit without any validator
is `no_validator`; one whose validators differ is `validator_mismatch`; rows repeated stay repeated; null headers are empty;
an empty table gives no rows; other columns are ignored. Read from a file, a record without a length in figures is left out,
and repeated header fields are one, joined by commas, those of set-cookie by line ends.
"""

from __future__ import annotations

import gzip
import io
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

IN_SLICE = 50_000
#: Fields that an update may not change: fixed values (framing, content coding and hop-by-hop fields).
KEPT_FIELDS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that do not choose a page: fixed values.
TRACKING = r"(?:utm_[^=&]*|ref|gclid|fbclid)"
RECORD = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("warc_headers", pa.map_(pa.string(), pa.string())), ("status_line", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
RECORD_DDL = "record_id string, warc_type string, url string, date string, warc_headers map<string,string>, status_line string, headers map<string,string>, payload binary"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and default port, no scheme, fragment, tracking parameters or trailing slash."""
    u = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(u, r"^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r"^www[0-9]*\.", ""), r":(80|443)$", "")
    rest = F.regexp_replace(u, r"^[^/?]*", "")
    rest = F.regexp_replace(rest, rf"([?&]){TRACKING}=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"&&+", "&"), r"[?]&+", "?"), r"[?&]+$", "")
    return F.concat(host, F.regexp_replace(rest, r"/+$", ""))


def resolve(records: DataFrame) -> DataFrame:
    """One row for each revisit: record_id, url_key, status, full_id, payload_digest, headers.

    records: record_id, warc_type (`response` or `revisit`), url, date (long), etag, last_modified, payload_digest,
    headers (map of lower-case names).
    """
    empty = F.create_map().cast("map<string,string>")
    r = records.select(
        "record_id", "warc_type", canonical_url(F.col("url")).alias("url_key"), F.col("date").cast("long").alias("date"),
        "etag", "last_modified", "payload_digest", F.coalesce("headers", empty).alias("headers"),
    )
    n, first, last = r.agg(F.count("*"), F.min("date"), F.max("date")).first()
    slices = max(1, math.ceil(n / IN_SLICE))
    width = ((last or 0) - (first or 0) + 1) / slices
    # maps have no order: the greatest (date, id) carries the rest as a packed string
    full = F.struct("date", "record_id", "etag", "last_modified", "payload_digest", F.to_json("headers").alias("h"))
    known = r.where("url_key is not null and date is not null")
    instants = known.groupBy("url_key", "date").agg(F.max(F.when(F.col("warc_type") == "response", full)).alias("full"), F.max(F.col("warc_type") == "revisit").alias("asks"))
    instants = instants.withColumn("slice", F.floor((F.col("date") - F.lit(first or 0)) / F.lit(width)).cast("long"))
    before = Window.partitionBy("url_key", "slice").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    instants = instants.withColumn("near", F.max("full").over(before))
    carried = instants.groupBy("url_key", "slice").agg(F.max("full").alias("last"))
    run = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select("url_key", "slice", F.max("last").over(run).alias("far"))
    found = instants.where("asks").join(carried, ["url_key", "slice"], "left").select("url_key", "date", F.coalesce("near", "far").alias("f"))
    v = r.where("warc_type = 'revisit'").join(found, ["url_key", "date"], "left")
    tag = lambda c: F.regexp_replace(c, r"^W/", "")
    holds = (
        F.when(F.col("etag").isNotNull(), F.coalesce(tag(F.col("etag")) == tag(F.col("f.etag")), F.lit(False)))
        .when(F.col("last_modified").isNotNull(), F.coalesce(F.col("last_modified") == F.col("f.last_modified"), F.lit(False)))
        .when(F.col("payload_digest").isNotNull(), F.coalesce(F.col("payload_digest") == F.col("f.payload_digest"), F.lit(False)))
    )
    status = F.when(F.col("f").isNull(), "no_earlier_response").when(holds.isNull(), "no_validator").when(holds, "resolved").otherwise("validator_mismatch")
    update = F.map_filter("headers", lambda k, _: ~k.isin(*KEPT_FIELDS))
    v = v.withColumn("status", status).withColumn("update", update).withColumn("old", F.from_json("f.h", "map<string,string>"))
    merged = F.map_concat(F.map_filter("old", lambda k, _: ~F.map_contains_key("update", k)), F.col("update"))
    ok = F.col("status") == "resolved"
    return v.select("record_id", "url_key", "status", F.when(ok, F.col("f.record_id")).alias("full_id"), F.when(ok, F.col("f.payload_digest")).alias("payload_digest"), F.when(ok, merged).alias("headers"))


def header_lines(headers: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def parse(data: bytes):
    """Records of an uncompressed WARC file; a record cut off at the end is left out."""
    f = io.BytesIO(data)
    while True:
        line = f.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        head = _fields(f)
        size = head.get("content-length", "0")
        if not (size.isascii() and size.isdigit()):
            continue
        body = f.read(int(size))
        if len(body) < int(size):
            return
        status, fields, payload = None, {}, body
        if head.get("warc-type") in ("response", "revisit") and body.startswith(b"HTTP/"):
            b = io.BytesIO(body)
            status, fields = b.readline().strip().decode("latin-1"), _fields(b)
            payload = b.read()
        yield {"record_id": head.get("warc-record-id"), "warc_type": head.get("warc-type"), "url": head.get("warc-target-uri"), "date": head.get("warc-date"), "warc_headers": list(head.items()), "status_line": status, "headers": list(fields.items()), "payload": payload}


def _fields(f) -> dict[str, str]:
    out: dict[str, str] = {}
    while (line := f.readline().strip(b"\r\n")):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        name, value = name.strip().lower(), value.strip()
        out[name] = out[name] + ("\n" if name == "set-cookie" else ", ") + value if name in out else value
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files under path, compressed or not, a file to a task."""

    def run(it):
        for b in it:
            for data in b.column("content").to_pylist():
                rows = list(parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data))
                for i in range(0, len(rows), 100):
                    yield pa.RecordBatch.from_pylist(rows[i : i + 100], schema=RECORD)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD_DDL)


def to_bytes(record: dict) -> bytes:
    """A record of parse() as it stands in a file."""
    body = record["payload"] or b""
    if record["status_line"]:
        fields = "".join(f"{k}: {v}\r\n" for k, v in record["headers"])
        body = f"{record['status_line']}\r\n{fields}\r\n".encode() + body
    head = dict(record["warc_headers"] or []) | {k: v for k, v in (("warc-record-id", record["record_id"]), ("warc-type", record["warc_type"]), ("warc-target-uri", record["url"]), ("warc-date", record["date"])) if v is not None}
    head["content-length"] = str(len(body))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + body + b"\r\n\r\n"


def captures(pages: DataFrame) -> DataFrame:
    """A capture log over pages: each page is fetched at 10 * page_id, and asked for again at 10 * page_id + 25.

    Every seventh second fetch carries another entity tag, every fifth only a time, every eleventh nothing.
    """
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    i = F.col("page_id")
    p = pages.select("page_id", "url", digest.alias("digest"), size.alias("size"))
    tag, time = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"')), F.concat(F.lit("t"), i.cast("string"))
    text = lambda *kv: F.map_filter(F.create_map(*[x if isinstance(x, Column) else F.lit(x) for x in kv]), lambda _, v: v.isNotNull())
    full = p.select(
        i.alias("record_id"), F.lit("response").alias("warc_type"), "url", (i * 10).alias("date"), tag.alias("etag"), time.alias("last_modified"), F.col("digest").alias("payload_digest"),
        text("content-type", "text/html", "content-length", F.col("size"), "etag", tag, "last-modified", time, "cache-control", "max-age=60").alias("headers"),
    )
    e = F.when(i % 7 == 0, F.lit('"changed"')).when((i % 5 == 0) | (i % 11 == 0), F.lit(None)).otherwise(F.concat(F.lit("W/"), tag))
    m = F.when(i % 11 == 0, F.lit(None)).otherwise(time)
    again = p.select(
        i.alias("record_id"), F.lit("revisit").alias("warc_type"), F.concat("url", F.lit("#again")).alias("url"), (i * 10 + 25).alias("date"), e.alias("etag"), m.alias("last_modified"), F.lit(None).cast("string").alias("payload_digest"),
        text("content-length", "0", "connection", "close", "cache-control", "max-age=120", "date", (i * 10 + 25).cast("string")).alias("headers"),
    )
    return full.union(again)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resolve(captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return got.select(F.col("record_id").alias("page_id"), "url_key", "status", F.col("full_id").alias("full_page_id"), "payload_digest", header_lines(F.col("headers")).alias("headers"))


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS size,
    regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages),
k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^[^@]*@', ''), '^www[0-9]*\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_replace(u, '^[^/?]*', ''), '([?&])(?:utm_[^=&]*|ref|gclid|fbclid)=[^&]*', '\1', 'g') AS rest FROM p),
c AS (SELECT page_id, digest, size, '"' || substr(digest, 1, 16) || '"' AS tag, 't' || page_id AS t,
    host || regexp_replace(regexp_replace(regexp_replace(regexp_replace(rest, '&&+', '&', 'g'), '[?]&+', '?', 'g'), '[?&]+$', ''), '/+$', '') AS url_key FROM k),
v AS (SELECT *, page_id * 10 + 25 AS d,
    CASE WHEN page_id % 7 = 0 THEN '"changed"' WHEN page_id % 5 = 0 OR page_id % 11 = 0 THEN NULL ELSE tag END AS e,
    CASE WHEN page_id % 11 = 0 THEN NULL ELSE t END AS m FROM c),
j AS (SELECT v.*, f.page_id AS fp, f.tag AS ft, f.t AS fm, f.digest AS fd, f.size AS fs
      FROM v ASOF LEFT JOIN c f ON v.url_key = f.url_key AND v.d > f.page_id * 10),
s AS (SELECT *, CASE WHEN fp IS NULL THEN 'no_earlier_response' WHEN e IS NOT NULL THEN CASE WHEN e = ft THEN 'resolved' ELSE 'validator_mismatch' END
      WHEN m IS NOT NULL THEN CASE WHEN m = fm THEN 'resolved' ELSE 'validator_mismatch' END ELSE 'no_validator' END AS status FROM j)
SELECT page_id, url_key, status, CASE WHEN status = 'resolved' THEN fp END AS full_page_id, CASE WHEN status = 'resolved' THEN fd END AS payload_digest,
  CASE WHEN status = 'resolved' THEN 'cache-control: max-age=120' || chr(10) || 'content-length: ' || fs || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || d || chr(10) || 'etag: ' || ft || chr(10) || 'last-modified: ' || fm END AS headers
FROM s
"""

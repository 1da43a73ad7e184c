"""WARC archives: writing captures with DataFrame functions, reading records, and assembling transactions.

Writing. ``write_warc`` makes three records a page (request, response or revisit, metadata) and lets Spark's text
writer put them down, with the record separator CR LF CR LF as line separator: any store that Spark can write will do,
and lost tasks are committed once. Of rows with equal payloads of at least ``min_bytes`` bytes the one with the smallest
page_id (null last, then the row's position) is the response, the others are revisits that name it.

Reading. ``read_warc`` parses plain or gzipped archives record by record; the file is the unit of work, so files must
fit a binary row (2 GB). A record cut short or malformed yields one row of type ``malformed`` and ends its file.

Assembly. ``captures`` joins request, response and metadata records through WARC-Concurrent-To, in either direction and
over one step between (metadata -> request -> response), and emits one nested row per capture. Records whose partner is
missing form a capture without a response. Record ids are taken as unique; of two records of one kind in a capture the
greater id stays as request, and all stay as metadata.

Cases: a null payload is empty; a null url has no target header; line breaks in urls are percent-escaped; repeated rows
and repeated page_ids are captures of their own; empty tables give empty archives.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.llm import words as W
from ashlar.llm.store import new_path, staged

RECORD = (
    "record_id string, rec_type string, concurrent_to array<string>, target_uri string, date string, refers_to_id string, "
    "declared_digest string, fields map<string,string>, payload_bytes long, payload_digest string, payload binary"
)
_PRIMARY = ("response", "revisit", "resource", "conversion")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(c: Column) -> Column:
    """Bare upper-case base32 SHA-1, from five hex digits to four letters at a time."""
    h = F.sha1(c)
    part = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*part), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _ALPHABET)


def _urn(*c: Column) -> Column:
    h = F.md5(F.concat_ws("|", *c).cast("binary"))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut]), F.lit(">"))


def _record(kind: Column, record_id: Column, headers: list[Column], content_type: str, block: Column) -> Column:
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), record_id, F.lit("\r\n"),
        *headers,
        F.lit(f"Content-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, block)


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    p = pages.select(
        F.col(page_id).alias("id"),
        F.replace(F.replace(F.col(url), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"),
        F.coalesce(F.col(payload), F.lit("")).alias("body"),
        F.monotonically_increasing_id().alias("at"),
    ).withColumn("digest", sha1_base32(F.col("body").cast("binary")))
    # the response of a payload is named by its content, so that revisits find it whatever tasks run again; the row's
    # position only tells rows apart that are equal throughout, and makes the names of all other records unique
    where = F.xxhash64("id", "url")
    equal = p.filter(F.octet_length("body") >= min_bytes).groupBy("digest", "id", where.alias("where")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "where", "n", "at"))
    same = equal.groupBy("digest").agg(first.alias("first"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    p = p.join(same, "digest", "left")
    is_first = F.col("id").eqNullSafe(F.col("first.id")) & (where == F.col("first.where")) & ((F.col("first.n") == 1) | (F.col("at") == F.col("first.at")))
    revisit = F.col("first").isNotNull() & ~is_first & (F.octet_length("body") >= min_bytes)
    named = lambda i, w: [F.coalesce(i.cast("string"), F.lit("")), w.cast("string"), F.col("digest")]
    other = _urn(F.lit("first"), *named(F.col("first.id"), F.col("first.where")))
    own = [_urn(F.lit(k), *named(F.col("id"), where), F.col("at").cast("string")) for k in ("response", "request", "metadata")]
    own[0] = F.when(F.col("first").isNotNull() & ~revisit, other).otherwise(own[0])
    common = [_header("WARC-Date", F.lit(date)), _header("WARC-Target-URI", F.col("url"))]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit("\r\n\r\n"))
    answer = _record(
        F.when(revisit, "revisit").otherwise("response"), own[0],
        [*common, _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
         F.when(revisit, F.concat(_header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), _header("WARC-Refers-To", other))).otherwise("")],
        "application/http; msgtype=response", F.concat(http, F.when(revisit, "").otherwise(F.col("body"))),
    )
    concurrent = _header("WARC-Concurrent-To", own[0])
    ask = _record(F.lit("request"), own[1], [*common, concurrent], "application/http; msgtype=request", F.concat(F.lit("GET "), F.coalesce(F.col("url"), F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")))
    about = _record(F.lit("metadata"), own[2], [*common, concurrent], "application/warc-fields", _header("page-id", F.col("id").cast("string")))
    p.select(F.explode(F.array(ask, answer, about)).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _lines(block: bytes) -> list[tuple[str, str]]:
    out = []
    for line in block.split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if colon:
            out.append((k.decode("utf-8", "replace").strip().lower(), v.decode("utf-8", "replace").strip()))
    return out


def _bare(digest: str | None) -> str | None:
    return None if digest is None else digest.rpartition(":")[2].upper()


def parse(content: bytes, keep_payload: bool):
    """Records of one archive as tuples in the order of RECORD."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    bad = (None, "malformed", [], None, None, None, None, {}, 0, None, None)
    while True:
        try:
            line = f.readline()
            while line in (b"\r\n", b"\n"):
                line = f.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                yield bad
                return
            head = b""
            while (line := f.readline()) not in (b"\r\n", b"\n", b""):
                head += line
            h = _lines(head)
            one = dict(h)
            n = int(one["content-length"])
            block = f.read(n)
        except (OSError, EOFError, KeyError, ValueError):
            yield bad
            return
        if len(block) < n:
            yield bad
            return
        kind, payload, declared, fields = one.get("warc-type", ""), block, None, {}
        if one.get("content-type", "").startswith("application/http"):
            http, _, payload = block.partition(b"\r\n\r\n")
            declared = dict(_lines(http)).get("content-length")
        elif one.get("content-type", "").startswith("application/warc-fields"):
            fields = dict(_lines(block))
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        size = len(payload)
        if kind == "revisit":  # the payload is elsewhere: what the record says of it
            digest = _bare(one.get("warc-payload-digest"))
            size = int(declared) if declared and declared.isdigit() else 0
        yield (
            one.get("warc-record-id"), kind, [v for k, v in h if k == "warc-concurrent-to"], one.get("warc-target-uri"), one.get("warc-date"),
            one.get("warc-refers-to"), _bare(one.get("warc-payload-digest")), fields, size, digest, payload if keep_payload and kind != "revisit" else None,
        )


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``; without ``payload`` its bytes are measured but not kept."""
    schema = pa.schema(
        [("record_id", pa.string()), ("rec_type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to_id", pa.string()),
         ("declared_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
    )

    def batch_of(rows):
        cols = list(zip(*rows, strict=True))
        cols[7] = [list(x.items()) for x in cols[7]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    def run(batches):
        for batch in batches:
            col = W.column(batch, "content")
            for i in range(len(col)):
                rows, held = [], 0
                for r in parse(col[i].as_py(), payload):
                    rows.append(r)
                    held += len(r[10] or b"") + 500
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    return files.mapInArrow(run, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, request, response, metadata. Reads ``records`` four times: stage it."""
    rec = records.filter(F.col("rec_type") != "malformed")
    primary = F.col("rec_type").isin(*_PRIMARY)
    ahead = rec.filter(~primary).select(F.col("record_id").alias("member"), F.explode("concurrent_to").alias("owner"))
    back = rec.filter(primary).select(F.explode("concurrent_to").alias("member"), F.col("record_id").alias("owner"))
    links = ahead.unionByName(back).filter("member is not null")
    over = links.select(F.col("member").alias("owner"), F.col("owner").alias("beyond"))
    links = links.join(over, "owner", "left").groupBy("member").agg(F.min(F.coalesce("beyond", "owner")).alias("capture_id"))
    cols = [c for c in rec.columns if c not in ("concurrent_to",)]
    nested = F.struct(*[F.col(c) for c in cols]).alias("r")
    mine = rec.filter(primary).select(F.col("record_id").alias("capture_id"), nested)
    others = rec.filter(~primary).select("record_id", nested).join(links, F.col("record_id") == F.col("member"), "left")
    both = mine.unionByName(others.select(F.coalesce("capture_id", "record_id").alias("capture_id"), "r"))

    def one(cond):
        return F.max_by(F.when(cond, F.col("r")), F.when(cond, F.col("r.record_id")))

    kind = F.col("r.rec_type")
    return both.groupBy("capture_id").agg(
        one(kind == "request").alias("request"),
        one(kind.isin(*_PRIMARY)).alias("response"),
        F.collect_list(F.when(~kind.isin("request", *_PRIMARY), F.col("r"))).alias("metadata"),
    )


def op5(pages: DataFrame) -> DataFrame:
    """The query's digest: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages.select("page_id", "url", "html"), path)
    found = captures(staged(read_warc(spark, path, payload=False).drop("payload"), "warc-records"))
    page = F.try_element_at(F.element_at("metadata", 1)["fields"], F.lit("page-id")).cast("long")
    c = found.select("capture_id", page.alias("page_id"), "response.payload_bytes", "response.payload_digest", F.col("response.rec_type").alias("record_type"), "response.refers_to_id")
    c = staged(c, "warc-captures")
    to = c.filter("record_type = 'response'").select(F.col("capture_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    return c.join(to, "refers_to_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS hex FROM p),
d AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([15, 10, 5, 0],
        lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 5 * i::INT + 1, 5))::BIGINT >> s) & 31)::INT, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest FROM h),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM m
"""

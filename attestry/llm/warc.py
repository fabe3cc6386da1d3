"""WARC archives: writing captures with revisits, reading archives back, and assembling transactions.

A capture is a request, a response or revisit, and a metadata record; request and metadata name the response or revisit
in WARC-Concurrent-To, and the assembly joins them by that identifier into one nested row.

Writing: captures with equal payloads of at least min_bytes share one response, the one with the largest id; the others
revisit it. The choice is a pre-aggregated maximum per digest, so a payload that a third of all pages share costs one
row per task. Records go through Spark's text sink, with the record end as line end, so any store Spark writes to will
do. Reading walks lines of the archives in bounded batches and counts Content-Length bytes, so a payload may hold
anything, line ends and record headers included; archives must be compressed (then Spark never splits a file).

Defined results: null html is an empty payload; null urls leave the target header out; equal rows are captures of their
own, one of them the response; a null id ranks lowest and is read back as null; an empty table gives no rows."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, workspace, written

CRLF = "\r\n"
END = CRLF + CRLF
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, digest: str, occurrence: int, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {digest} {occurrence} {kind}')}>"


def _record(kind: str, own: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", _DATE), *headers, ("Content-Length", str(len(block)))]
    return ("WARC/1.1" + CRLF + "".join(f"{k}: {v}{CRLF}" for k, v in lines if v is not None) + CRLF).encode() + block


def _header(value: str | None) -> str | None:
    return None if value is None else value.replace("\\", "\\\\").replace("\r", "\\r").replace("\n", "\\n")


def _unheader(value: str | None) -> str | None:
    if value is None or "\\" not in value:
        return value
    out, it = [], iter(value)
    for c in it:
        out.append({"r": "\r", "n": "\n"}.get(n := next(it, ""), n) if c == "\\" else c)
    return "".join(out)


def captures(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, payload, occurrence, refers_to, revisits): what is to be written; refers_to is the id of the response."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(html_col, F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.select("id", F.sha1("payload").alias("digest"), F.length("payload").alias("bytes"))
    shared = keyed.groupBy("digest").agg(F.max("id").alias("target"), F.count("*").alias("n"), (F.max("bytes") >= min_bytes).alias("shares")).filter("n > 1").select("digest", "target", "shares")
    shared = written(shared, "shared-payloads").withColumnRenamed("digest", "d")
    each = Window.partitionBy("digest", "id").orderBy("url")
    rows = rows.withColumn("digest", F.sha1("payload"))
    marked = rows.join(shared, F.col("digest") == F.col("d"), "left").drop("d")
    # only rows of payloads that occur twice, of any size and with any id, can be repeated rows; the rest skips the numbering
    single = marked.filter("shares is null").withColumn("occurrence", F.lit(1))
    several = written(keyed.join(shared, F.col("digest") == F.col("d")).groupBy("digest", "id").count().filter("count > 1").select(F.col("digest").alias("d"), F.col("id").alias("i")), "repeated")
    if several.isEmpty():
        numbered = marked.withColumn("occurrence", F.lit(1))
    else:
        numbered = single.unionByName(marked.filter("shares is not null").withColumn("occurrence", F.row_number().over(each)))
    revisit = F.coalesce("shares", F.lit(False)) & ~(F.col("id").eqNullSafe(F.col("target")) & (F.col("occurrence") == 1))
    return numbered.select("id", "url", "payload", "occurrence", F.when(revisit, F.col("target")).alias("refers_to"), revisit.alias("revisits"))


def write(found: DataFrame, path: str, max_records: int = 60_000) -> None:
    """Write captures() as gzip-compressed archives under the path."""
    bounded_batches(found.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                page, url, payload, n, target, revisits = (b[c][k].as_py() for c in ("id", "url", "payload", "occurrence", "refers_to", "revisits"))
                digest = base32_sha1(payload)
                main = record_id(page, digest, n, "capture")
                place = [("WARC-Target-URI", _header(url))]
                http = _HTTP % len(payload)
                if revisits:
                    more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(target, digest, 1, "capture"))]
                    own = _record("revisit", main, [*place, *more, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")], http)
                else:
                    own = _record("response", main, [*place, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")], http + payload)
                joined = ("WARC-Concurrent-To", main)
                ask = _record("request", record_id(page, digest, n, "request"), [*place, joined, ("Content-Type", "application/http; msgtype=request")], b"GET / HTTP/1.1\r\n\r\n")
                fields = [("page-id", page)]
                note = _record("metadata", record_id(page, digest, n, "metadata"), [joined, ("Content-Type", "application/warc-fields")], "".join(f"{a}: {x}{CRLF}" for a, x in fields if x is not None).encode())
                yield pa.RecordBatch.from_arrays([pa.array([ask, own, note], pa.binary())], names=["value"])

    lines = found.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", max_records).text(path)


RECORDS = "kind string, record_id string, concurrent_to string, target_uri string, refers_to string, block_digest string, block_bytes long, payload_digest string, fields map<string,string>, payload binary"
_NAMES = ["kind", "record_id", "concurrent_to", "target_uri", "refers_to", "block_digest", "block_bytes", "payload_digest", "fields", "payload"]
_TYPES = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]


def _parsed(headers: list[bytes], block: bytes, with_payload: bool) -> tuple:
    h = {k.lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in headers[1:])}
    kind, body, fields = h.get("warc-type"), block, []
    if "application/http" in h.get("content-type", ""):
        body = block.partition(b"\r\n\r\n")[2]
    elif "warc-fields" in h.get("content-type", ""):
        fields = [(k, v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split(CRLF) if x)]
    declared = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), _unheader(h.get("warc-target-uri")), h.get("warc-refers-to"), base32_sha1(body), len(body), declared, fields, body if with_payload else None


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records of compressed archives, one row each; digests and lengths are of the payload as read."""
    bounded_batches(spark)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, headers, block, size, want = None, None, [], 0, 0
        held, room = [], 4 << 20
        for b in batches:
            for name, line in zip(b["file"].to_pylist(), b["value"].to_pylist(), strict=True):
                if name != file:
                    if headers is not None:
                        raise ValueError(f"{file}: the last record is cut off")
                    file, headers, block = name, None, []
                if headers is None:
                    if line.startswith(b"WARC/"):
                        headers, want = [line], -1
                    elif line:
                        raise ValueError(f"{file}: a record does not start with its version")
                    continue
                if want < 0:
                    if line:
                        headers.append(line)
                        continue
                    want = next((int(x.partition(b":")[2]) for x in headers if x.lower().startswith(b"content-length:")), -1)
                    if want < 0:
                        raise ValueError(f"{file}: a record has no Content-Length")
                    block, size = [], -2
                    continue
                block.append(line)
                size += len(line) + 2
                if size < want:
                    continue
                if size > want:
                    raise ValueError(f"{file}: a block is longer than its Content-Length")
                held.append(_parsed(headers, b"\r\n".join(block), with_payload))
                room -= want if with_payload else 0
                headers, block = None, []
                if len(held) >= 2048 or room < 0:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], names=_NAMES)
                    held, room = [], 4 << 20
        if headers is not None:
            raise ValueError(f"{file}: the last record is cut off")
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], names=_NAMES)

    lines = spark.read.option("lineSep", CRLF).schema("value string").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit record, and all its request and metadata records."""
    key = F.when(F.col("kind").isin("response", "revisit"), F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    whole = F.struct("record_id", *[c for c in records.columns if c not in ("kind", "record_id")])
    one = [F.first(F.when(F.col("kind") == k, whole), ignorenulls=True).alias(k) for k in ("response", "revisit")]
    many = [F.collect_list(F.when(F.col("kind") == k, whole)).alias(k) for k in ("request", "metadata")]
    return records.withColumn("capture", key).groupBy("capture").agg(*one, *many)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages as archives in the shared folder, read them back, and give one row per capture.

    What a revisit refers to, and the size of its payload, are read through its WARC-Refers-To from that response."""
    spark = pages.sparkSession
    path = f"{workspace(spark)}/warc-{uuid.uuid4().hex}"
    write(captures(pages, min_bytes), path)
    named = F.transform(F.filter("metadata", lambda m: m["fields"]["page-id"].isNotNull()), lambda m: m["fields"]["page-id"].cast("long"))
    got = assemble(read(spark, path)).select(
        "capture",
        F.get(named, F.lit(0)).alias("page_id"),
        F.coalesce("response.target_uri", "revisit.target_uri").alias("url"),
        F.col("response.block_bytes").alias("payload_bytes"),
        F.coalesce("response.block_digest", "revisit.payload_digest").alias("payload_digest"),
        F.when(F.col("response").isNotNull(), F.lit("response")).otherwise(F.lit("revisit")).alias("record_type"),
        F.col("revisit.refers_to").alias("response_id"),
    )
    got = written(got, "captures")
    wanted = got.filter("response_id is not null").select(F.col("response_id").alias("capture")).distinct()
    origin = got.filter("record_type = 'response'").join(wanted, "capture", "left_semi").select(F.col("capture").alias("response_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("size"))
    origin = written(origin, "revisited")  # written apart, so that a response which a third of all rows revisit can be split
    return got.join(origin, "response_id", "left").select("page_id", "url", F.coalesce("payload_bytes", "size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")

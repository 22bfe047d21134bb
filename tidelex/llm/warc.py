"""WARC archives: a writer on Spark's text sink and a salvage reader (operator 2).

Writing: one record a page, of type response, or revisit for all but the page with the largest id of those with equal
payloads of min_revisit bytes or more (equal by SHA-256 and length). A row of the sink is a record and the line
separator is the records' own CRLF CRLF, so the files are plain WARC 1.1 on any file system that Spark writes to. A task goes on to
another file when one has max_bytes.

Reading: every file is walked from its start, as gzip members or as bare records. A record passes if its version
line, header lines, Content-Length, digests and end are in order. A payload digest is of the block, or of the body where
that is an HTTP message; a block digest is of the block. After a failed check the reader searches for the
next place at which a gzip member inflates or a version line begins a valid record, goes on there, and logs the bytes
between as a quarantined gap (file, offset, length, reason). What a member gave, whole or not, is walked in the same way; records in
it have the member's offset, and if any part of it is bad the member is logged as a gap that names the inflated bytes, though its good
records are read. Deflated data after an error can't be inflated.

Defined results: null html is an empty payload; a null url has no target header; pages with the same id are written and read
each for itself, and all rows with the largest id of equal payloads are responses; a null page_id counts as smaller than any other and is read back as null. An empty table gives no files
and an empty result; files without any record give gaps only. A target URI is
read as it stands, but for those of the writer that it marks as escaped. Memory: one file, at most max_bytes and a record here; foreign
archives have to be below the 2 GB that Spark gives as one value."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_dir, written

CRLF = b"\r\n"
VERSION = re.compile(rb"WARC/(?:0\.1[78]|1\.[01])\r?\n")
GZIP = b"\x1f\x8b\x08"
NAME = "urn:tidelex:page:"
ESCAPED = "X-Tidelex-Target-Escaped"
FOUND = "path string, offset long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, target string, payload binary, length long, reason string"


def sha1_32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A record without the two line ends that close it."""
    name = "" if page_id is None else str(page_id)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{NAME}{name}>", "WARC-Date: 2020-01-01T00:00:00Z"]
    if url is not None:
        if re.search(r"[\x00-\x20]", url):  # a header can't hold these as they are
            url = re.sub(r"[\x00-\x20%]", lambda m: f"%{ord(m[0]):02X}", url)
            head.append(f"{ESCAPED}: 1")
        head.append("WARC-Target-URI: " + url)
    head.append(f"WARC-Payload-Digest: sha1:{sha1_32(payload)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{NAME}{refers_to}>", f"WARC-Payload-Length: {len(payload)}"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + CRLF + CRLF + payload


class Bad(ValueError):
    """A failed check."""


def http_bodies(block: bytes) -> Iterator[bytes]:
    """What a payload digest of an HTTP message may be of: its body as it stands, and with its chunks joined."""
    m = re.search(rb"\r?\n\r?\n", block)
    body = block[m.end() :] if m else b""
    yield body
    if m and re.search(rb"(?im)^transfer-encoding:.*chunked", block[: m.start()]):
        out, i = [], 0
        while c := re.compile(rb"([0-9A-Fa-f]{1,15})[^\r\n]*\r?\n").match(body, i):
            n = int(c[1], 16)
            if not n:
                yield b"".join(out)
                return
            out.append(body[c.end() : c.end() + n])
            i = c.end() + n + (2 if body.startswith(CRLF, c.end() + n) else 1)


def same_sha1(digest: str, data: bytes) -> bool:
    """Whether a digest is of the data, in base 32 or hex; those of other kinds can't be checked and pass."""
    kind, _, value = digest.partition(":")
    return kind.lower() != "sha1" or value.upper() in (sha1_32(data), hashlib.sha1(data).hexdigest().upper())


def parse(data: bytes, at: int) -> tuple[int, dict]:
    """The record that begins at at, and where it ends; raises Bad."""
    if not (m := VERSION.match(data, at)):
        raise Bad("no version line")
    fields, i = {}, m.end()
    while True:
        j = data.find(b"\n", i, i + (1 << 16))
        if j < 0:
            raise Bad("header without end")
        line = data[i:j].rstrip(b"\r")
        i = j + 1
        if not line:
            break
        k, colon, v = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#-'*+\-.0-9A-Z^-z|~]+", k):
            raise Bad("bad header line")
        if (name := k.decode().lower()) in fields and name != "warc-concurrent-to":
            raise Bad("header field repeated")  # as where a header cut short runs into the next record's
        fields[name] = v.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,18}", fields.get("content-length", "")) or "warc-type" not in fields:
        raise Bad("no length or type")
    end = i + int(fields["content-length"])
    if data[end : end + 4] != CRLF + CRLF:
        raise Bad("no record end at the stated length")
    block = payload = data[i:end]
    if not same_sha1(fields.get("warc-block-digest", ""), block):
        raise Bad("block digest differs")
    digest = fields.get("warc-payload-digest", "")
    bodies = [*http_bodies(block)] if fields.get("content-type", "").lower().startswith("application/http") else [block]
    payload = bodies[0]
    # The digest of a revisit is of another record's payload, that of a segment of the whole.
    if fields["warc-type"] != "revisit" and "warc-segment-number" not in fields:
        payload = next((x for x in [*bodies, block] if same_sha1(digest, x)), None)
        if payload is None:
            raise Bad("payload digest differs")
    return end + 4, {"fields": fields, "payload": payload}


def inflate(data: bytes, at: int) -> tuple[int, bytes, str]:
    """The gzip member that begins at at: where it ends, what it gives, and why that isn't all of it, if so."""
    d, out, i, step = zlib.decompressobj(31), [], at, 16_384
    while not d.eof and i < len(data):
        try:
            out.append(d.decompress(data[i : i + step]))
        except zlib.error as e:
            if step == 1:
                return i, b"".join(out), "member: " + re.sub(r"[^ -~]", "", str(e))
            # Once more up to here, then byte by byte, for what comes before the error.
            d, step = zlib.decompressobj(31), 1
            for j in range(at, i, 16_384):
                d.decompress(data[j : min(j + 16_384, i)])
            continue
        i += step
    if not d.eof:
        return len(data), b"".join(out), "member cut short"
    return min(i, len(data)) - len(d.unused_data), b"".join(out), ""


def reach(data: bytes, at: int, size: int) -> int:
    """Up to where the member that begins at at has to be read for its first size bytes, but for the last of them, which
    keeps the member's end, and its check, out."""
    d, i, left = zlib.decompressobj(31), at, size - 1
    while left and i < len(data):
        left -= len(d.decompress(data[i : i + 16_384], left))
        i += 16_384
    return min(i, len(data)) - len(d.unconsumed_tail)


def walk(data: bytes) -> tuple[list[tuple[int, dict]], list[tuple[int, int, str]]]:
    """([(end, record)], [(start, end, reason)]) of bare records and of what is between them."""
    at, got, bad = 0, [], []
    while at < len(data):
        try:
            end, r = parse(data, at)
            got.append((end, r))
        except Bad as e:
            line = VERSION.search(data, at + 1)
            end = line.start() if line else len(data)
            if bad and bad[-1][1] == at:
                bad[-1] = (bad[-1][0], end, bad[-1][2])
            else:
                bad.append((at, end, str(e)))
        at = end
    return got, bad


def salvage(data: bytes) -> Iterator[tuple[str, int, object]]:
    """('record', offset, record) and ('gap', offset, (length, reason)) in file order; offsets are of the file."""
    at, bad, reason, n = 0, None, "", len(data)
    while at < n:
        packed, broken = data.startswith(GZIP, at), ""
        if packed:
            end, plain, broken = inflate(data, at)
            got, parts = walk(plain)
            why = [broken] * bool(broken) + [f"inflated bytes {a} to {b}: {x}" for a, b, x in parts]
        else:
            try:
                end, r = parse(data, at)
                got, why = [(end, r)], []
            except Bad as e:
                broken, got, why = str(e), [], [str(e)]
        if bad is not None and (got or not why):
            yield "gap", bad, (at - bad, reason)
            bad = None
        if why and bad is None:
            bad, reason = at, "; ".join(why[:20])
        for _, r in got:
            yield "record", at, r
        if not broken:  # a whole member holds no more than was read, even where parts of it are bad
            at = end
            continue
        start = max(at + 1, reach(data, at, got[-1][0])) if got else at + 1
        member, line = data.find(GZIP, start), VERSION.search(data, start)
        at = min(member if member >= 0 else n, line.start() if line else n)
    if bad is not None:
        yield "gap", bad, (n - bad, reason)


def _id(name: str) -> int | None:
    m = re.fullmatch(rf"<?{NAME}(-?\d+)>?", name)
    return int(m[1]) if m else None


def write(pages: DataFrame, at: str, *, min_revisit: int = 0, max_bytes: int = 64 << 20) -> None:
    """pages(page_id, url, html) as WARC files in folders, by number of a task's file, of the folder at."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    sized = rows.select("page_id", F.unhex(F.sha2("html", 256)).alias("sha"), F.octet_length("html").alias("n")).where(F.col("n") >= min_revisit)
    least = F.coalesce("page_id", F.lit(-(1 << 63)))
    same = sized.groupBy("sha", "n").agg(F.max(least).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("sha", "n", "first")
    again = sized.join(same, ["sha", "n"]).where(least != F.col("first")).select(F.col("page_id").alias("again"), F.col("sha").alias("again_sha"), "first").distinct()
    # The revisits are written first: the table's size tells whether it can be broadcast, else both sides are shuffled.
    again = written(again, "revisits")
    marked = rows.join(again, F.col("page_id").eqNullSafe(F.col("again")) & (F.unhex(F.sha2("html", 256)) == F.col("again_sha")), "left").select("page_id", "url", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, filled = 0, 0
        for b in batches:
            out, size = [], 0
            for p, u, h, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out.append(record(p, u, h.encode("utf-8"), f))
                size += len(out[-1])
                filled += len(out[-1])
                if size > 1 << 22 or filled >= max_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array([file] * len(out), pa.int32())], ["value", "file"])
                    out, size = [], 0
                    file, filled = (file + 1, 0) if filled >= max_bytes else (file, filled)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array([file] * len(out), pa.int32())], ["value", "file"])

    lines = marked.mapInArrow(run, "value binary, file int").select(F.col("value").cast("string").alias("value"), "file")
    lines.write.option("lineSep", "\r\n\r\n").partitionBy("file").text(at)


def read(spark: SparkSession, at: str, payloads: bool = True) -> DataFrame:
    """What is found in all files under the folder at, in one pass: records, and quarantined gaps, which have a reason."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(at).select("path", "content")
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("target", pa.string()), ("payload", pa.binary()), ("length", pa.int64()), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows: list[dict] = []
                for kind, offset, x in salvage(content.as_py()):
                    row = {"path": path, "offset": offset}
                    if kind == "gap":
                        rows.append(row | {"length": x[0], "reason": x[1]})
                    else:
                        f, body = x["fields"], x["payload"]
                        uri = f.get("warc-target-uri")
                        if ESCAPED.lower() in f and uri is not None:
                            uri = re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), uri)
                        rows.append(row | {
                            "page_id": _id(f.get("warc-record-id", "")), "record_type": f["warc-type"], "refers_to": _id(f.get("warc-refers-to", "")),
                            "payload_bytes": int(f.get("warc-payload-length", len(body))), "payload_digest": f.get("warc-payload-digest", "sha1:" + sha1_32(body))[5:], "target": uri, "payload": body if payloads else None,
                        })
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(run, FOUND)


def records(found: DataFrame) -> DataFrame:
    return found.where("reason IS NULL").drop("length", "reason")


def gaps(found: DataFrame) -> DataFrame:
    return found.where("reason IS NOT NULL").select("path", "offset", "length", "reason")


def round_trip(pages: DataFrame, **params) -> DataFrame:
    """Per page, as read back from archives in the shared folder: page_id, payload_bytes, payload_digest, record_type, refers_to. Raises
    if the archives have gaps, or other than a record a page."""
    spark = pages.sparkSession
    at = new_dir(spark, "warc")
    write(pages, at, **params)
    found = written(read(spark, at, payloads=False).drop("payload", "target"), "found")
    n, bad, why = found.agg(F.count_if(F.col("reason").isNull()), F.count("reason"), F.min(F.when(F.col("reason").isNotNull(), F.struct("path", "offset", "reason")))).first()
    if bad or n != (pages_n := pages.count()):
        raise RuntimeError(f"{at}: {n} records read back" + (f", {bad} gaps, as {why}" if bad else f" of {pages_n} pages"))
    return records(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

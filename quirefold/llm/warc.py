"""WARC archives: writing pages as records, reading records back, and assembling transactions.

A page becomes three records, a request, a response (or a revisit of an earlier equal payload) and a metadata record; the
first and the last name the response's record in WARC-Concurrent-To. Spark's text writer puts them into gzip files, the
blank lines that end a record being its line separator, so archives are committed like any table, on any file system.

Archives are read as lines in the order of their file, since gzip files are not split. A task carries the bytes of the
record it is in from batch to batch and cuts records by Content-Length alone, so payloads may hold any bytes. Files of one
gzip member for each record, as crawlers write them, read the same.

Assembling joins request, response and metadata records through their concurrent-to identifiers, wherever in the
archives they lie, and gives one nested row for each capture.
"""

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.common import saved

#: Payloads of fewer bytes are never revisits.
LEAST = 100
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAIRS = "array<struct<name: string, value: string>>"
RECORD = f"file string, record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, payload_digest string, start_line string, headers {_PAIRS}, payload binary, payload_bytes bigint, payload_sha256 string, problem string"
_CAPTURED = ("response", "revisit", "resource")


def _record_id(kind: str, page_id: Column, url: Column, digest: Column) -> Column:
    h = F.md5(F.to_json(F.struct(F.lit(kind).alias("k"), page_id.alias("p"), url.alias("u"), digest.alias("d"))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: str, named: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    """A record up to the blank lines that end it. Fields that are null are left out; line ends in values are escaped."""
    plain = lambda v: F.replace(F.replace(v.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    fields = [F.coalesce(F.concat(F.lit(f"{n}: "), plain(v), F.lit("\r\n")), F.lit("")) for n, v in named]
    head = F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\n"), *fields, F.lit(f"Content-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_END))
    return F.concat(head.cast("binary"), block)


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes three records for every row of pages (page_id, url, html; other columns are ignored) to gzip files in `path`.

    The payload is the html in UTF-8, null as empty. Of rows with equal payloads of at least LEAST bytes the one with the
    smallest page_id, then url, nulls last, becomes a response, with its payload; the others become revisits that refer to
    it, without payload. Rows equal in page_id, url and html give records with equal ids, of one type. A null url is left
    out, as is a null page_id. `date` is the time of capture, which pages does not hold.

    Only digests of payloads are grouped, with one row a digest kept where it comes more than once; pages themselves move
    only if those rows are too many to broadcast.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("page_id").alias("_number"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload")).withColumn("digest", F.sha2("payload", 256))
    place = F.struct(F.col("_number").isNull().alias("no_id"), "_number", F.col("url").isNull().alias("no_url"), "url", "page_id")
    firsts = rows.where(F.col("bytes") >= LEAST).groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = saved(firsts.select(F.col("digest").alias("key"), F.col("first.page_id").alias("first_page"), F.col("first.url").alias("first_url"), F.lit(True).alias("again")), "firsts")
    # short payloads get keys of their own, so that they do not meet in one task
    key = F.when(F.col("bytes") >= LEAST, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    rows = rows.withColumn("key", key).join(firsts, "key", "left")
    first = F.col("page_id").eqNullSafe(F.col("first_page")) & F.col("url").eqNullSafe(F.col("first_url"))
    rows = rows.withColumn("revisit", F.coalesce(F.col("again") & ~first, F.lit(False)))

    same = [F.col("page_id"), F.col("url"), F.col("digest")]
    rows = rows.withColumns({"own": _record_id("capture", *same), "asked": _record_id("request", *same), "told": _record_id("metadata", *same), "first_id": _record_id("capture", F.col("first_page"), F.col("first_url"), F.col("digest"))})
    own, asked, told = F.col("own"), F.col("asked"), F.col("told")
    about = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    path_of = F.regexp_replace(F.coalesce("url", F.lit("/")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    get = F.concat(F.lit("GET "), F.regexp_replace(F.when(path_of == "", "/").otherwise(path_of), r"\s", "%20"), F.lit(" HTTP/1.1\r\nHost: "), F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s]*)", 1), F.lit(_END))
    status = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(_END)).cast("binary")
    found = [("WARC-Record-ID", own), *about, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))]
    refers = [("WARC-Refers-To", F.col("first_id")), ("WARC-Refers-To-Target-URI", F.col("first_url")), ("WARC-Profile", F.lit(_PROFILE))]
    http = "application/http; msgtype="
    records = F.array(
        _record("request", [("WARC-Record-ID", asked), *about, ("WARC-Concurrent-To", own)], http + "request", get.cast("binary")),
        F.when(F.col("revisit"), _record("revisit", [*found, *refers], http + "response", status)).otherwise(_record("response", found, http + "response", F.concat(status, F.col("payload")))),
        _record("metadata", [("WARC-Record-ID", told), *about, ("WARC-Concurrent-To", own)], "application/warc-fields", F.concat(F.lit("software: quirefold\r\n"), F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id"), F.lit("\r\n")), F.lit(""))).cast("binary")),
    )
    rows.select(F.explode(records).alias("record")).select(F.col("record").cast("string").alias("value")).write.option("lineSep", _END).option("compression", "gzip").text(path)


def _fields(block: bytes) -> list[tuple[str, str]]:
    """The named fields of a header; a line that begins with a blank carries on the one before."""
    out: list[tuple[str, str]] = []
    for line in block.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            out.append((name.strip().lower(), value.strip()))
    return out


def _row(file: str, head: bytes, block: bytes) -> dict:
    named = _fields(head)
    first = dict(reversed(named))
    start, headers, payload = None, [], block
    kind = first.get("content-type", "").lower()
    if kind.startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        line, _, rest = http.partition(b"\r\n")
        start, headers = line.decode("utf-8", "replace"), _fields(rest)
    elif kind.startswith("application/warc-fields"):
        headers = _fields(block)
    return {
        "file": file, "record_id": first.get("warc-record-id"), "type": first.get("warc-type"), "concurrent_to": [v for n, v in named if n == "warc-concurrent-to"], "refers_to": first.get("warc-refers-to"), "target_uri": first.get("warc-target-uri"),
        "date": first.get("warc-date"), "payload_digest": first.get("warc-payload-digest"), "start_line": start, "headers": [{"name": n, "value": v} for n, v in headers], "payload": payload, "payload_bytes": len(payload), "payload_sha256": sha256(payload).hexdigest(), "problem": None,
    }


class _Cutter:
    """Cuts the bytes of one file, given piece by piece, into records."""

    def __init__(self, file: str):
        self.file, self.parts, self.held, self.wanted, self.problem = file, [], 0, 0, None

    def feed(self, data: bytes) -> Iterator[dict]:
        self.parts.append(data)
        self.held += len(data)
        if self.problem or self.held < self.wanted:
            return
        buf, at, self.wanted = b"".join(self.parts), 0, 0
        while at < len(buf):
            if buf[at : at + 1] in b"\r\n":  # the blank lines between records
                at += 1
                continue
            end = buf.find(b"\r\n\r\n", at)
            if end < 0:
                break
            length = dict(reversed(_fields(buf[at:end]))).get("content-length", "")
            if not buf.startswith(b"WARC/", at) or not length.isdigit():
                self.problem = "not a record"
                break
            if end + 4 + int(length) > len(buf):
                self.wanted = end + 4 + int(length) - at
                break
            yield _row(self.file, buf[at:end], buf[end + 4 : end + 4 + int(length)])
            at = end + 4 + int(length)
        self.parts, self.held = [buf[at:]], len(buf) - at

    def close(self) -> Iterator[dict]:
        if self.problem or self.held and b"".join(self.parts).strip(b"\r\n"):
            yield dict.fromkeys(_OUT.names) | {"file": self.file, "problem": self.problem or "cut off"}


_STRINGS = pa.list_(pa.string())
_OUT = pa.schema([
    ("file", pa.string()), ("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", _STRINGS), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("start_line", pa.string()),
    ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("problem", pa.string()),
])


def _told(rows: Iterator[dict], most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 500 + (row["payload_bytes"] or 0)
        if size > most:
            yield pa.RecordBatch.from_pylist(held, _OUT)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, _OUT)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        cutter = None
        for batch in batches:
            files = pc.run_end_encode(batch["file"])
            at = 0
            for file, end in zip(files.values.to_pylist(), files.run_ends.to_pylist(), strict=True):
                if cutter is None or cutter.file != file:
                    if cutter:
                        yield from cutter.close()
                    cutter = _Cutter(file)
                lines = batch["value"].slice(at, end - at).to_pylist()
                yield from cutter.feed(b"\n".join(lines) + b"\n")
                at = end
        if cutter:
            yield from cutter.close()

    return _told(rows())


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the gzip files in `path`; see RECORD for the columns.

    headers: the HTTP fields of a request or response, or the fields of a warc-fields record, names in lower case.
    payload: what follows the HTTP header, or the whole block, as stored; its size and SHA-256 are of these bytes. A file that
    ends within a record, or holds bytes that are no record, gives its records up to there and one row that says so in
    `problem`, its other columns null. An empty file gives nothing. A task holds one record and one batch of lines.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file")).mapInArrow(_records, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One row for each capture: a response, revisit or resource record with its request and its metadata records.

    records: as from read_archive; a written table, since it is read several times. payload may be left out. Returns
    capture_id, type, target_uri, date, request (record_id, start_line, headers), response (start_line, headers, payload_digest,
    payload_bytes, payload_sha256, payload if there), metadata (array of record_id, headers, by record_id) and refers_to (capture_id,
    payload_bytes, payload_sha256, metadata of what a revisit refers to).

    A record belongs to a capture if either names the other in WARC-Concurrent-To, or if it names a record that belongs
    to it. Of several requests the one with the smallest record_id stays. Requests and metadata without capture are left out,
    captures without either have null or an empty array. Record ids are unique by the format; records with one id
    are taken as equal, and an id that comes n times gives n rows. Records with a problem take no part.
    """
    fields = [c for c in records.columns if c not in ("record_id", "file", "problem")]
    sound = records.where(F.col("problem").isNull() & F.col("record_id").isNotNull())
    once = sound.groupBy("record_id").agg(F.count("*").alias("copies"), F.first(F.struct(*fields)).alias("r")).select("record_id", "copies", "r.*")
    found, rest = once.where(F.col("type").isin(*_CAPTURED)), once.where(F.col("type").isin("request", "metadata"))
    links = rest.select("record_id", F.explode("concurrent_to").alias("to")).unionByName(found.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("to")))
    near = links.join(found.select(F.col("record_id").alias("to")), "to").select("record_id", F.col("to").alias("capture_id"))
    far = links.join(near.withColumnRenamed("record_id", "to"), "to").select("record_id", "capture_id")
    member = near.unionByName(far).groupBy("record_id").agg(F.min("capture_id").alias("capture_id"))
    is_request = F.col("type") == "request"
    parts = rest.join(member, "record_id").groupBy("capture_id").agg(
        F.min(F.when(is_request, F.struct("record_id", "start_line", "headers"))).alias("request"),
        F.sort_array(F.collect_list(F.when(~is_request, F.struct("record_id", "headers")))).alias("metadata"),
    )
    told = F.struct("start_line", "headers", "payload_digest", "payload_bytes", "payload_sha256", *(["payload"] if "payload" in records.columns else []))
    found = found.select(F.col("record_id").alias("capture_id"), "copies", "type", "target_uri", "date", told.alias("response"), "refers_to")
    nothing = F.array().cast(f"array<struct<record_id: string, headers: {_PAIRS}>>")
    whole = found.join(parts, "capture_id", "left").withColumn("metadata", F.coalesce("metadata", nothing))
    # what revisits refer to; other rows get keys of their own, so that they do not meet in one task
    target = found.where(F.col("type") == "response").select("capture_id", F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_sha256").alias("payload_sha256"))
    target = target.join(parts.select("capture_id", "metadata"), "capture_id", "left").select(F.col("capture_id").alias("_to"), F.struct("capture_id", "payload_bytes", "payload_sha256", "metadata").alias("_target"))
    whole = whole.withColumn("_to", F.coalesce("refers_to", F.concat(F.lit("-"), "capture_id"))).drop("refers_to").join(target, "_to", "left")
    each = whole.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select("capture_id", "type", "target_uri", "date", "request", "response", "metadata", F.col("_target").alias("refers_to"))


def field(pairs: Column, name: str) -> Column:
    """The first value of a named field, null if there is none."""
    return F.get(F.filter(pairs, lambda x: x["name"] == name), F.lit(0))["value"]

"""WARC archives: writing pages as records, reading them back, and putting segmented records together.

Layout written: one record per page, an HTTP response whose payload is sent in chunked framing. A record block above
``segment_bytes`` is cut into segments: the first record carries WARC-Segment-Number 1, continuation records carry
the next numbers and WARC-Segment-Origin-ID, and the last one WARC-Segment-Total-Length. A page whose payload another page
answers for is a revisit record: HTTP headers only, with the payload's length and digest, and WARC-Refers-To.

Archives are Spark text output in binary-safe form: a row is a record, the line separator is the blank line that ends a
record, so writing commits, retries and stores like any other Spark output. Records are at most ``segment_bytes`` and
headers, and a file holds at most ``records_per_file`` of them, which bounds what a reader must hold.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_VERSION = b"WARC/1.1"
_END = b"\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"
_CHUNK = 8192


# --------------------------------------------------------------------------------------------------------------
# record format
# --------------------------------------------------------------------------------------------------------------


def chunked(payload: bytes, size: int = _CHUNK) -> bytes:
    """HTTP/1.1 chunked framing."""
    out = bytearray()
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        out += b"%x\r\n%b\r\n" % (len(piece), piece)
    return bytes(out + b"0\r\n\r\n")


def unchunked(framed: bytes) -> bytes:
    """The payload of chunked framing; extensions and trailers are skipped. Raises ValueError where it is broken."""
    out, at = bytearray(), 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is missing")
        digits = framed[at:end].split(b";")[0].strip()
        if not digits or digits.strip(b"0123456789abcdefABCDEF"):
            raise ValueError("chunk size is no number")
        size = int(digits, 16)
        at = end + 2
        if size == 0:
            return bytes(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut off")
        out += framed[at : at + size]
        at += size + 2


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """Without the blank line that ends it: the writer's line separator."""
    lines = [_VERSION, *(f"{k}: {v}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + _END + block


def _one_line(text: str) -> str:
    """Header values hold no line ends."""
    return text.replace("\r", "%0D").replace("\n", "%0A")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, plain or gzip (one member or many). Header names in lower case."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.find(_END, at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        head = data[at:end].split(b"\r\n")
        headers: dict[str, str] = {}
        for line in head[1:]:
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
        length = int(headers["content-length"])
        at = end + len(_END)
        if at + length > len(data):
            raise ValueError("the last record is cut off")
        yield headers, data[at : at + length]
        at += length


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, decoded payload) of an HTTP response block."""
    head, _, body = block.partition(_END)
    headers = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if "chunked" in headers.get("transfer-encoding", "").lower():
        body = unchunked(body)
    return headers, body


def _digest(payload_sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(payload_sha1).decode()


def _hex(value: str | None) -> str | None:
    """Lower-case hex of a digest header in base 32 or hex."""
    if not value:
        return None
    text = value.rpartition(":")[2]
    return text.lower() if len(text) == 40 else base64.b32decode(text).hex()


# --------------------------------------------------------------------------------------------------------------
# writing
# --------------------------------------------------------------------------------------------------------------


def _build(segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        attempt, row = uuid.uuid4(), 0
        for batch in batches:
            records: list[bytes] = []
            ids, urls, answers, places = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
            for page, url, payload, answer, where in zip(ids, urls, common.binary_list(batch.column(2)), answers, places, strict=True):
                row += 1
                payload = payload or b""
                record_id = f"<urn:uuid:{uuid.uuid5(attempt, f'{part}-{row}')}>"
                digest = _digest(hashlib.sha1(payload).digest())
                common_ = [("WARC-Record-ID", record_id), ("WARC-Date", _DATE), ("WARC-Payload-Digest", digest)]
                if url is not None:
                    common_.append(("WARC-Target-URI", _one_line(url)))
                if page is not None:
                    common_.append(("X-Page-ID", str(page)))
                kind = ("Content-Type", "application/http; msgtype=response")
                if answer is not None:
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                    profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
                    head = [("WARC-Type", "revisit"), *common_, kind, profile, ("X-Refers-To-Page-ID", str(answer)), ("WARC-Refers-To-Date", _DATE)]
                    if where is not None:
                        head.append(("WARC-Refers-To-Target-URI", _one_line(where)))
                    records.append(_record(head, block))
                    continue
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
                first = [("WARC-Type", "response"), *common_, kind]
                if len(block) <= segment_bytes:
                    records.append(_record(first, block))
                    continue
                cuts = range(0, len(block), segment_bytes)
                records.append(_record([*first, ("WARC-Segment-Number", "1")], block[:segment_bytes]))
                for number, at in enumerate(cuts[1:], 2):
                    more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(attempt, f'{part}-{row}-{number}')}>"), ("WARC-Date", _DATE)]
                    more += [("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", str(number))]
                    if number == len(cuts):
                        more.append(("WARC-Segment-Total-Length", str(len(block))))
                    records.append(_record(more, block[at : at + segment_bytes]))
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

    return run


def answers(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int, salts: int = 64) -> DataFrame:
    """``pages`` (id, url, payload) with ``answer``: for a page whose payload of at least ``min_bytes`` a page with a
    larger id has too, the largest such id, and ``answer_url``, that page's url; else null. Payloads are compared by SHA-1.

    Only payloads that repeat are joined back, over (digest, salt), so a payload that a third of all pages share is
    dealt over ``salts`` tasks."""
    size = F.octet_length(payload_col)
    keyed = pages.withColumn("digest", F.when(size >= min_bytes, F.sha1(F.col(payload_col).cast("binary"))))
    repeated = keyed.where("digest is not null").groupBy("digest").agg(F.max(F.struct(id_col, "url")).alias("last"), F.count("*").alias("n"))
    repeated = common.stage(repeated.where("n > 1").select("digest", F.col("last")[id_col].alias("answer"), F.col("last.url").alias("answer_url")), "repeated")
    salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int"))
    joined = keyed.join(salted, ["digest", "salt"], "left")
    older = F.col(id_col) < F.col("answer")
    return joined.select(id_col, "url", payload_col, F.when(older, F.col("answer")).alias("answer"), F.when(older, F.col("answer_url")).alias("answer_url"))


def write(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 1000, segment_bytes: int = 32_768, records_per_file: int = 2048) -> None:
    """Write one WARC record per row (segmented where long) to gzip archives under ``path``.

    A null payload is empty; a null url gives no WARC-Target-URI; a null id gives no X-Page-ID and is always a
    response. Rows that repeat an id and payload are each written; those with the largest id are responses. An empty table gives no records. Other columns
    are ignored, whatever their names; payloads of many megabytes are cut into segments. A revisit names its response by target URI and date, as the
    format has it, and by page id in a header of ours.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").alias("payload"))
    marked = answers(rows, "id", "payload", min_revisit_bytes)
    records = marked.mapInArrow(common.in_slices(_build(segment_bytes)), "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


# --------------------------------------------------------------------------------------------------------------
# reading
# --------------------------------------------------------------------------------------------------------------

_PARTS = "origin string, segment int, total long, record_type string, page_id long, url string, digest string, refers_to long, block binary, payload_bytes long, payload_digest string, status string"


def _decode(block: bytes, record_type: str | None, digest: str | None) -> tuple[int | None, str | None, bytes | None, str]:
    """(payload bytes, payload SHA-1, payload, status) of a whole record block."""
    try:
        headers, payload = http_payload(block)
    except ValueError:
        return None, None, None, "bad_chunk"
    if record_type == "revisit":
        return int(headers.get("content-length", 0)), _hex(digest), None, "ok"
    found = hashlib.sha1(payload).hexdigest()
    return len(payload), found, payload, "ok" if digest is None or found == _hex(digest) else "digest_mismatch"


def _read(keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = []
                for h, block in parse(data):
                    kind = h.get("warc-type")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    segment = int(h["warc-segment-number"]) if "warc-segment-number" in h else None
                    refers = h.get("x-refers-to-page-id", "")
                    row = {
                        "origin": h.get("warc-segment-origin-id", h.get("warc-record-id")),
                        "segment": segment,
                        "total": int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None,
                        "record_type": kind,
                        "page_id": int(h["x-page-id"]) if "x-page-id" in h else None,
                        "url": h.get("warc-target-uri"),
                        "digest": h.get("warc-payload-digest"),
                        "refers_to": int(refers) if refers.lstrip("-").isdigit() and kind == "revisit" else None,
                        "block": block,
                    }
                    if segment is None:
                        size, sha1, payload, status = _decode(block, kind, row["digest"])
                        row |= {"block": payload if keep_payload else None, "payload_bytes": size, "payload_digest": sha1, "status": status}
                    rows.append(row)
                schema = schema or pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("block", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("status", pa.string())])
                for at in range(0, len(rows), 1024):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 1024], schema=schema)

    return run


def reassemble(segments: list[tuple[int, int | None, bytes]], digest: str | None) -> tuple[int | None, str | None, bytes | None, str]:
    """Segments (number, total length or None, block) of one record, in any order. Status is ok, missing_segment (a number
    is missing, or the last one isn't there), conflicting_segment (two different ones of a number), length_mismatch, bad_chunk or
    digest_mismatch. Repeated segments count once."""
    by_number = {number: block for number, _, block in segments}
    if any(by_number[number] != block for number, _, block in segments):
        return None, None, None, "conflicting_segment"
    totals = {total for _, total, _ in segments if total is not None}
    if sorted(by_number) != list(range(1, len(by_number) + 1)) or not totals:
        return None, None, None, "missing_segment"
    block = b"".join(by_number[n] for n in sorted(by_number))
    if totals != {len(block)}:
        return None, None, None, "length_mismatch"
    return _decode(block, "response", digest)


def _assemble(keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            origin, parts, size, sha1, status, payload = batch.to_pydict().values()
            for k, segments in enumerate(parts):
                head = next((x["digest"] for x in segments if x["segment"] == 1), None)
                size[k], sha1[k], whole, status[k] = reassemble([(x["segment"], x["total"], x["block"]) for x in segments], head)
                payload[k] = whole if keep_payload else None
            columns = [pa.array(origin, pa.string()), pa.array(size, pa.int64()), pa.array(sha1, pa.string()), pa.array(status, pa.string()), pa.array(payload, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["origin", "payload_bytes", "payload_digest", "status", "payload"])

    return run


def read(spark: SparkSession, path: str, *, keep_payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``: page_id, url, record_type (response or revisit), refers_to,
    payload_bytes, payload_digest (SHA-1 hex), status, payload (null for revisits, and without ``keep_payload``).

    Whole records are decoded where they are read. Segments alone are exchanged, grouped by the origin's id, put in order
    and checked; a failure shows in status and leaves the payload null. No archives: no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    found = files.mapInArrow(_read(keep_payload), _PARTS)
    head = ["record_type", "page_id", "url", "refers_to"]
    # a record's segments are few; whole records bring no block into the exchange unless payloads are kept
    is_head = F.col("segment").isNull() | (F.col("segment") == 1)
    part = F.struct("segment", "total", "digest", "block")
    grouped = found.groupBy("origin").agg(
        *(F.max(F.when(is_head, F.col(c))).alias(c) for c in (*head, "payload_bytes", "payload_digest", "status")),
        F.max(F.when(F.col("segment").isNull(), F.col("block"))).alias("payload"),
        F.collect_list(F.when(F.col("segment").isNotNull(), part)).alias("parts"),
    )
    schema = "origin string, record_type string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, status string, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = _assemble(keep_payload)
        for batch in batches:
            cut = batch.select(["origin", "parts", "payload_bytes", "payload_digest", "status", "payload"])
            rows = cut.filter(pa.compute.greater(pa.compute.list_value_length(cut.column("parts")), 0))
            done = {r["origin"]: r for b in make(iter([rows])) for r in b.to_pylist()} if rows.num_rows else {}
            columns = batch.select(["origin", *head, "payload_bytes", "payload_digest", "status", "payload"])
            if done:
                rows_ = columns.to_pylist()
                for r in rows_:
                    r.update(done.get(r["origin"], {}))
                columns = pa.RecordBatch.from_pylist(rows_, schema=columns.schema)
            yield columns

    return grouped.mapInArrow(run, schema).drop("origin")


def op2_warc(spark, sf_dir: str) -> DataFrame:
    path = common.fresh_path(spark, "warc")
    write(common.table(spark, sf_dir, "pages"), path)
    found = read(spark, path, keep_payload=False)
    # a record that can't be read back whole must not pass silently
    sound = F.when(F.col("status") == "ok", F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("WARC record: "), F.coalesce("status", F.lit("?")))).cast("string"))
    return found.select("page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", "refers_to")

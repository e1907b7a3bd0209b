"""Operator 10, WARC: a converter for legacy ARC archives, a writer and a reader.

``parse_arc`` reads ARC files of version 1 and 2: the version block names the
fields of the header lines that follow, each header line declares the length of
its payload, and that length alone decides where the next one begins.
``to_warc`` synthesises what WARC wants and ARC lacks: a record id
derived from the record's place and content, an ISO timestamp, the record type
and SHA-1 digests.

``archive_pages`` stores every page in ARC form, converts, and writes WARC files
below the shared folder with Spark's own writer (a WARC record ends with two line
ends, which serve as the line separator, so a file is a plain concatenation of
records). Of records with equal payloads of at least ``min_bytes`` the one with
the largest page id is a response, the others refer to it. ``read_warc`` reads
the files back by their declared lengths.

Equal payloads are found by digest and length on narrow rows, aggregated before they
are shuffled; payloads move once, by page id, so a common payload burdens no task.
Null and empty html are empty payloads. A null url is ``-``. Repeated page ids: of
equal payloads with the same largest id one response per row is kept, none
refers to itself. Null page ids are never chosen for reference unless no other is
left, and are then responses. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkwise.llm._shared import Scratch, lean, text_bytes

#: The header fields of ARC versions, as the version block states them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Payload bytes from which pages get files of their own, and records of a file of either kind
#: at most; they bound the memory of reading a file back.
LARGE_PAGE, FILE_RECORDS, LARGE_FILE_RECORDS = 256 * 1024, 1000, 16
CRLF = b"\r\n"


def arc_version_block(version: int, name: str = "pages.arc", date: str = "20000101000000") -> bytes:
    body = f"{version} 0 hunkwise\n{ARC_FIELDS[version]}\n\n".encode()
    head = f"filedesc://{name} 0.0.0.0 {date} text/plain " + ("200 - - 0 " + name + " " if version == 2 else "")
    return head.encode() + str(len(body)).encode() + b"\n" + body


def arc_record(version: int, url: str, date: str, payload: bytes, offset: int = 0, name: str = "pages.arc") -> bytes:
    """A URL record: header line, HTTP head, payload and the line end that ends it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + CRLF + CRLF
    fields = [url.replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D").replace("\t", "%09") or "-", "0.0.0.0", date, "text/html"]
    if version == 2:
        fields += ["200", hashlib.md5(payload).hexdigest(), "-", str(offset), name]
    return " ".join([*fields, str(len(http) + len(payload))]).encode() + b"\n" + http + payload + b"\n"


def parse_arc(data: bytes) -> Iterator[dict]:
    """The URL records of an ARC file, as dicts of the header's fields with ``block`` and ``at``."""
    at, names = 0, []
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # line ends between records
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "surrogateescape").rstrip("\r")
        values = line.split(" ")
        size = int(values[-1])
        block = data[end + 1 : end + 1 + size]
        if len(block) != size:
            raise ValueError(f"ARC record at byte {at}: {size} bytes are declared, {len(block)} are there")
        if line.startswith("filedesc:"):
            version, columns = block.decode("utf-8", "replace").split("\n")[:2]
            names = columns.split()
            if names != ARC_FIELDS[int(version.split()[0])].split():
                raise ValueError(f"ARC version block with unknown fields: {columns}")
        else:
            if len(values) > len(names):  # a URL with blanks, as old crawlers wrote it
                values = ["%20".join(values[: len(values) - len(names) + 1]), *values[len(values) - len(names) + 1 :]]
            yield dict(zip(names, values, strict=True)) | {"block": block, "at": at}
        at = end + 1 + size


def timestamp(arc_date: str) -> str:
    """An ARC date of 8 to 14 digits as a WARC date; what is missing is zero."""
    d = "".join(c for c in arc_date if c.isdigit())[:14].ljust(8, "0").ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def to_warc(arc: dict, key: str, refers_to: str | None = None, extra: dict[str, str] | None = None) -> bytes:
    """One WARC record without its final two line ends; a revisit keeps the HTTP head alone."""
    http, _, payload = arc["block"].partition(CRLF + CRLF)
    block = http + CRLF + CRLF + (b"" if refers_to is not None else payload)
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(key),
        "WARC-Date": timestamp(arc["Archive-date"]),
        "WARC-Target-URI": arc["URL"],
        "WARC-IP-Address": arc["IP-address"],
        "WARC-Payload-Digest": "sha1:" + hashlib.sha1(payload).hexdigest(),
        "WARC-Block-Digest": "sha1:" + hashlib.sha1(block).hexdigest(),
        "WARC-Identified-Payload-Type": arc["Content-type"],
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        headers |= {"WARC-Refers-To": record_id(refers_to), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    headers |= (extra or {}) | {"Content-Length": str(len(block))}
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogateescape") + CRLF + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC file."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == CRLF:
            at += 2
            continue
        end = data.index(CRLF + CRLF, at)
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def references(pages: DataFrame, min_bytes: int, scratch: Scratch) -> DataFrame:
    """``page_id, digest, refers_to`` of the pages whose payload a larger page id has, too."""
    small = pages.select(F.col("page_id"), F.sha1("payload").alias("digest"), F.octet_length("payload").alias("bytes"))
    small = scratch.put(small.where(f"bytes >= {int(min_bytes)}"), "digests")
    most = small.groupBy("digest", "bytes").agg(F.max("page_id").alias("top"), F.min("page_id").alias("low"), F.count("*").alias("n"))
    most = scratch.put(most.where("n > 1 and low < top"), "copies")
    # The written table is dealt anew for the join, so that a common digest is split.
    found = small.join(most, ["digest", "bytes"]).where("page_id < top")
    return found.select("page_id", "digest", F.col("top").alias("refers_to")).distinct()


def write_warc(pages: DataFrame, path: str, scratch: Scratch, min_bytes: int = 1000, page_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20000101000000") -> None:
    """Write the pages as ARC records converted to WARC files below ``path``."""
    pages = pages.select(F.col(page_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("-")).alias("url"), text_bytes(html_col).alias("payload"))
    refs = scratch.put(references(pages, min_bytes, scratch), "references")
    refs = refs.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("refers_to").alias("_to"))
    # A repeated page id may have several payloads, so the digest decides, too.
    joined = pages.join(refs, (F.col("page_id") == F.col("_page")) & (F.sha1("payload") == F.col("_digest")), "left").select("page_id", "url", "payload", "_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = []
            for page, url, payload, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                version = 2 if (page or 0) % 2 else 1
                arc = arc_version_block(version, date=date) + arc_record(version, url, date, payload)
                for rec in parse_arc(arc):
                    extra = {"ARC-Page": "" if page is None else str(page)} | ({} if to is None else {"ARC-Refers-To-Page": str(to)})
                    records.append(to_warc(rec, f"page:{page}", None if to is None else f"page:{to}", extra))
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

    def write(part: DataFrame, records: int, folder: str) -> None:
        out = part.mapInArrow(lean(run), "record binary").select(F.col("record").cast("string").alias("value"))
        out.write.option("lineSep", "\r\n\r\n").option("compression", "none").option("maxRecordsPerFile", records).text(f"{path}/{folder}")

    large = F.octet_length("payload") >= LARGE_PAGE
    write(joined.where(~large), FILE_RECORDS, "pages")
    if not pages.where(large).isEmpty():
        write(joined.where(large), LARGE_FILE_RECORDS, "large")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files below ``path``, in no order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, valid boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in parse_warc(content.as_py()):
                    http, _, payload = block.partition(CRLF + CRLF)
                    size = int(next(x for x in http.split(CRLF) if x.startswith(b"Content-Length: "))[16:])
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    whole = h["WARC-Type"] == "revisit" or (len(payload) == size and hashlib.sha1(payload).hexdigest() == digest)
                    number = lambda x: int(x) if x else None
                    uri = h["WARC-Target-URI"]
                    rows.append((number(h["ARC-Page"]), uri, size, digest, h["WARC-Type"], number(h.get("ARC-Refers-To-Page")), h["WARC-Record-ID"], h["WARC-Date"], whole))
                if rows:
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
                    names = [x.split()[0] for x in schema.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.mapInArrow(lean(run), schema)


def archive_pages(pages: DataFrame, min_bytes: int = 1000, **options) -> DataFrame:
    """Write the pages as WARC files in the shared folder and read them back."""
    scratch = Scratch(pages.sparkSession, "archive")
    write_warc(pages, scratch.path("warc"), scratch, min_bytes, **options)
    return read_warc(pages.sparkSession, scratch.path("warc"))

"""WARC archives: writing captures, reading records, and assembling transactions.

Every capture is three records, each a gzip member: the request, the response (or a revisit of an equal payload) and a
metadata record. Request and metadata name the response in WARC-Concurrent-To. Reading turns archives into one row per
record; `transactions` brings the records of a capture together by that identifier and emits one nested row.

Archives are written by the tasks to the shared folder, at most ARCHIVE_BYTES at a time, under names no other attempt uses.
Only archives in the manifest of successful attempts are read, so retried or lost tasks leave nothing behind that counts.

The readers hash the payload of every response and fail when it is not what its header says. Payloads are compared by SHA-1. Of equal payloads of at least REVISIT_LEAST bytes the capture with the largest page id is the
response and the others revisit it. Defined cases: a null html is an empty payload and a null url an empty one; rows tied at
the largest page id are all responses; a null page id is smaller than any other; repeated rows are captures of their own; a
payload of any length is one record; an empty table writes nothing and gives no rows; extra columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomlens.llm.common import shared_folder, stored

REVISIT_LEAST = 0
ARCHIVE_BYTES = 16 * 1024 * 1024
#: Tasks that read archives, at most; each reads its share one by one.
MOST_READERS = 100_000
VERSION = b"WARC/1.1\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "record_id string, record_type string, concurrent_to string, target_uri string, date string, payload_digest string, content_type string, "
    "fields map<string,string>, payload_bytes bigint, payload binary"
)


def base32_digest(hexed: str) -> str:
    """Bare upper-case base32 of a hex SHA-1."""
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def open_for_writing(path: str):
    """A binary sink at a path of the shared folder: a local or mounted path, or any store that Arrow reaches."""
    if path.startswith("file:"):
        return open(urlsplit(path).path, "wb")  # noqa: SIM115
    if "://" not in path:
        return open(path, "wb")  # noqa: SIM115
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_output_stream(inner)


def read_whole(path: str) -> bytes:
    """The bytes at a path that open_for_writing takes."""
    if path.startswith("file:") or "://" not in path:
        with open(urlsplit(path).path if path.startswith("file:") else path, "rb") as source:
            return source.read()
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_stream(inner) as source:
        return source.read()


def record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member; header values hold no line breaks."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    head = VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None).encode() + b"\r\n"
    return gzip.compress(head + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def capture_records(page_id, url: str, payload: bytes, digest: str, refers_to) -> list[bytes]:
    """The three records of a capture; refers_to is the page id of the response that a revisit stands for."""
    uri = quote(url, safe="%/:=&?~#+!$,;'@()*[]")
    ids = [f"<urn:uuid:{uuid.uuid4()}>" for _ in range(3)]
    parts = urlsplit(uri) if "[" not in uri and "]" not in uri else urlsplit("")
    get = f"GET {parts.path or '/'}{'?' + parts.query if parts.query else ''} HTTP/1.1\r\nHost: {parts.netloc}\r\n\r\n".encode()
    status = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    shared = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        main = record("response", ids[0], shared, status + payload)
    else:
        main = record("revisit", ids[0], [*shared, ("WARC-Profile", REVISIT_PROFILE)], status)
    fields = {"page-id": page_id, "payload-bytes": len(payload), "refers-to-page": refers_to}
    about = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None).encode()
    beside = [("WARC-Target-URI", uri), ("WARC-Concurrent-To", ids[0])]
    return [
        record("request", ids[1], [*beside, ("Content-Type", "application/http; msgtype=request")], get),
        main,
        record("metadata", ids[2], [*beside, ("Content-Type", "application/warc-fields")], about),
    ]


def write_archives(pages: DataFrame, folder: str, page_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_LEAST) -> DataFrame:
    """Write every page's capture below folder; (path, records, bytes) of the archives, which stand once this is acted on."""
    rows = pages.select(
        F.col(page_col).cast("bigint").alias("page_id"), F.coalesce(url_col, F.lit("")).alias("url"), F.coalesce(html_col, F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    long_enough = F.length("payload") >= least
    groups = rows.filter(long_enough).groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("held")).filter("held > 1").drop("held")
    chosen = rows.join(groups, "digest", "left").withColumn(
        "refers_to", F.when(long_enough & (F.coalesce("page_id", F.lit(-(2**63)).cast("bigint")) < F.col("response_id")), F.col("response_id"))
    )

    def run(batches):
        buffer, count = io.BytesIO(), 0

        def closed():
            path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
            with open_for_writing(path) as sink:
                sink.write(buffer.getvalue())
            return pa.RecordBatch.from_pydict({"path": [path], "records": [count], "bytes": [buffer.tell()]})

        for batch in batches:
            for page, url, payload, digest, refers in zip(*(batch.column(k) for k in range(5)), strict=True):
                for piece in capture_records(page.as_py(), url.as_py(), payload.as_py(), base32_digest(digest.as_py()), refers.as_py()):
                    buffer.write(piece)
                    count += 1
                if buffer.tell() >= ARCHIVE_BYTES:
                    yield closed()
                    buffer, count = io.BytesIO(), 0
        if count:
            yield closed()

    spark = pages.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    return chosen.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, records bigint, bytes bigint")


def parse_records(content: bytes):
    """(headers, block) of every record of an archive, gzip members one by one or plain."""
    while content:
        if content[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            data = member.decompress(content) + member.flush()
            content = member.unused_data
        else:
            data, content = content, b""
        while data.startswith(b"WARC/"):
            head, _, rest = data.partition(b"\r\n\r\n")
            headers = {}
            for line in head.split(b"\r\n")[1:]:
                name, _, value = line.partition(b":")
                headers[name.decode().lower()] = value.strip().decode("utf-8", "replace")
            length = int(headers["content-length"])
            yield headers, rest[:length]
            data = rest[length:].lstrip(b"\r\n")


def members(content: bytes):
    """Records of an archive with a walk over the gzip members that does not copy what is left of the file."""
    view, at = memoryview(content), 0
    if content[:2] != b"\x1f\x8b":
        yield from parse_records(content)
        return
    while at < len(view):
        member = zlib.decompressobj(31)
        data, step = [], 1 << 16
        while not member.eof and at < len(view):
            data.append(member.decompress(view[at : at + step]))
            at += step
        at = min(at, len(view)) - len(member.unused_data)
        yield from parse_records(b"".join(data))


def read_records(spark: SparkSession, paths: DataFrame | list[str], with_payload: bool = True) -> DataFrame:
    """A row per record of the archives (RECORD_SCHEMA) at paths, or at column path of a frame, each read by one task.

    Sizes and digests of payloads are those of the bytes that were read, for a revisit those of its header; a response
    whose digest is not that of its header fails. Without payloads their sizes and digests stay.
    """
    files = (paths if isinstance(paths, DataFrame) else spark.createDataFrame([(p,) for p in paths], "path string")).select("path")

    def run(batches):
        names = [part.split(" ")[0] for part in RECORD_SCHEMA.replace("map<string,string>", "map").split(", ")]
        types = [pa.string()] * 7 + [pa.map_(pa.string(), pa.string()), pa.int64(), pa.binary()]

        def flushed(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block in members(read_whole(content.as_py())):
                    fields, payload = [], None
                    kind = headers.get("content-type", "")
                    if kind.startswith("application/http"):
                        payload = block.partition(b"\r\n\r\n")[2]
                    elif kind == "application/warc-fields":
                        fields = [tuple(p.strip() for p in line.split(":", 1)) for line in block.decode("utf-8", "replace").splitlines() if ":" in line]
                    digest = headers.get("warc-payload-digest")
                    held = len(payload) if payload is not None else None
                    if headers.get("warc-type") == "response":
                        found = f"sha1:{base32_digest(hashlib.sha1(payload or b'').hexdigest())}"
                        if digest not in (None, found):
                            raise ValueError(f"the payload of {headers.get('warc-record-id')} is not what its digest says")
                        digest = found
                    rows.append((headers.get("warc-record-id"), headers.get("warc-type"), headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), headers.get("warc-date"), digest, kind, fields, held, payload if with_payload else None))
                    size += held or 0
                    if size > 4 * 1024 * 1024 or len(rows) >= 5000:
                        yield flushed(rows)
                        rows, size = [], 0
                if rows:
                    yield flushed(rows)

    return files.mapInArrow(run, RECORD_SCHEMA)


def transactions(records: DataFrame) -> DataFrame:
    """One row per capture: its identifier and the request, response (or revisit) and metadata as structs, null where absent."""
    part = F.struct("record_id", "record_type", "target_uri", "date", "payload_digest", "content_type", "fields", "payload_bytes", "payload")
    kind = F.when(F.col("record_type").isin("response", "revisit"), "response").otherwise(F.col("record_type"))
    keyed = records.filter(F.col("record_type").isin("request", "response", "revisit", "metadata")).select(F.coalesce("concurrent_to", "record_id").alias("capture_id"), kind.alias("kind"), part.alias("part"))

    def of(name: str):
        return F.first(F.when(F.col("kind") == name, F.col("part")), ignorenulls=True).alias(name)

    return keyed.groupBy("capture_id").agg(of("request"), of("response"), of("metadata"))


def archived_pages(pages: DataFrame, with_payload: bool = False, **columns: str) -> DataFrame:
    """Nested captures of all pages, written to archives in the shared folder and read back."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    manifest = stored(write_archives(pages, folder, **columns), "manifest")
    archives = manifest.count()
    return transactions(read_records(spark, manifest.repartition(max(1, min(archives, MOST_READERS)), "path"), with_payload))


def archive_digest(pages: DataFrame, **columns: str) -> DataFrame:
    """The columns of the query's contract, derived from the archives."""
    fields = F.col("metadata.fields")
    return archived_pages(pages, **columns).select(
        fields["page-id"].cast("bigint").alias("page_id"),
        F.when(F.col("response.record_type") == "response", F.col("response.payload_bytes")).otherwise(fields["payload-bytes"].cast("bigint")).alias("payload_bytes"),
        F.regexp_replace("response.payload_digest", "^sha1:", "").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        fields["refers-to-page"].cast("bigint").alias("refers_to"),
    )

"""WARC archives: records of pages, a normaliser for monolithic gzip files, and reading by offset index.

Pages become records in archives of about ARCHIVE bytes, each one gzip stream as a careless writer leaves it. The normaliser
inflates that stream once, rewrites every record as a gzip member of its own, and gives a sidecar index with each member's offset
and length, so that a record can be read alone. Archives and indexes are rows of tables in the shared folder, readable wherever
Spark reads; `export` gives plain files.

Of records with equal payloads of MIN_REVISIT bytes or more, the one of the smallest page_id is the response and the others are
revisits (digest and HTTP header, no payload). Digests are grouped with map-side aggregation; only (digest, smallest id) meets
the pages again, in a join that AQE splits where a payload is hot.

The normaliser takes a file as it finds it: one gzip stream, several concatenated members, plain records, zero bytes between or after
members. A stream that is cut off or damaged gives the whole records before the damage, and says so: status and lost_bytes.

Defined results: null html is an empty payload; a null page_id is never an original where another row has an id, and refers like
any other; rows that share the smallest page_id are all responses; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, table, written

MIN_REVISIT = 100
ARCHIVE = 4 << 20
LEVEL = 6
_WINDOW = 31  # zlib with a gzip header


def assign_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload (binary), digest, record_type, refers_to."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= MIN_REVISIT
    # digests that occur once need no partner: only those of repeated payloads come back
    firsts = p.where(large).groupBy(F.col("digest").alias("of")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # small payloads get keys of their own: no match, and no heap of rows under one key
    key = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("small:"), F.xxhash64("page_id", "url").cast("string")))
    joined = p.withColumn("key", key).join(firsts, F.col("key") == F.col("of"), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; the digest is the payload's SHA-256 in bare lower-case hex."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {'%0A'.join('%0D'.join((url or '').split(chr(13))).split(chr(10)))}", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(data: bytes, at: int = 0) -> tuple[dict[str, str], int]:
    """Header fields (lower-case names) of the block that starts at `at`, and where its body starts."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "replace").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, end + 4


def write_monolithic(records: DataFrame, size: int = ARCHIVE, level: int = LEVEL) -> DataFrame:
    """archive (string), n_records, data: each archive is a single gzip stream over all its records."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        out, n, plain, stream = [], 0, 0, None

        def closed():
            data = b"".join([*out, stream.flush()])
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{made:06d}"]), pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["archive", "n_records", "data"])

        for batch in batches:
            for i in range(batch.num_rows):
                r = record(*(c[i].as_py() for c in batch.columns))
                if stream is None:
                    stream = zlib.compressobj(level, zlib.DEFLATED, _WINDOW)
                out.append(stream.compress(r))
                n, plain = n + 1, plain + len(r)
                if plain >= size:
                    yield closed()
                    out, n, plain, stream, made = [], 0, 0, None, made + 1
        if stream is not None:
            yield closed()

    return records.select("page_id", "url", "payload", "digest", "record_type", "refers_to").mapInArrow(run, "archive string, n_records bigint, data binary")


def inflated(data: bytes) -> tuple[bytes, bool]:
    """What a file holds uncompressed, member after member, and whether it was intact. Bytes that begin no gzip member are plain."""
    if not data.startswith(b"\x1f\x8b"):
        return data, True
    out, rest = [], data
    while rest.startswith(b"\x1f\x8b"):
        member = zlib.decompressobj(_WINDOW)
        try:
            out.append(member.decompress(rest))
            out.append(member.flush())
        except zlib.error:
            return b"".join([*out, _before_damage(rest)]), False
        if not member.eof:
            return b"".join(out), False
        rest = member.unused_data.lstrip(b"\0")
    return b"".join(out), not rest


def _before_damage(data: bytes) -> bytes:
    """What a damaged member gives before its fault, in steps of a few bytes."""
    member, out = zlib.decompressobj(_WINDOW), []
    for at in range(0, len(data), 64):
        try:
            out.append(member.decompress(data[at : at + 64]))
        except zlib.error:
            break
    return b"".join(out)


def records_in(data: bytes) -> Iterator[tuple[bytes, dict[str, str]]]:
    """The whole records of an uncompressed archive, with their header fields; ends where no further whole record begins."""
    at = 0
    while data.startswith(b"WARC/", at) and data.find(b"\r\n\r\n", at) >= 0:
        fields, body = headers(data, at)
        size = fields.get("content-length", "")
        end = body + int(size) + 4 if size.isdigit() else len(data) + 1
        if data[end - 4 : end] != b"\r\n\r\n":
            return
        yield data[at:end], fields
        at = end


def normalise(archives: DataFrame, level: int = LEVEL) -> DataFrame:
    """archive, data (one gzip member a record), index: array<struct<record_id, kind, digest, offset, length>>, status (whole, or
    truncated where the input ended early or was damaged), lost_bytes (uncompressed bytes that formed no whole record)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("record_id", pa.string()), ("kind", pa.string()), ("digest", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                members, index, at, used = [], [], 0, 0
                plain, intact = inflated(data or b"")
                for r, fields in records_in(plain):
                    packer = zlib.compressobj(level, zlib.DEFLATED, _WINDOW)
                    member = packer.compress(r) + packer.flush()
                    index.append({"record_id": fields.get("warc-record-id"), "kind": fields.get("warc-type"), "digest": fields.get("warc-payload-digest"), "offset": at, "length": len(member)})
                    members.append(member)
                    at += len(member)
                    used += len(r)
                lost = len(plain) - used
                status = "whole" if intact and not lost else "truncated"
                columns = [pa.array([name]), pa.array([b"".join(members)], pa.binary()), pa.array([index], kind), pa.array([status]), pa.array([lost], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["archive", "data", "index", "status", "lost_bytes"])

    return archives.select("archive", "data").mapInArrow(run, "archive string, data binary, index array<struct<record_id:string,kind:string,digest:string,offset:bigint,length:bigint>>, status string, lost_bytes bigint")


def _page(urn: str) -> int | None:
    x = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(x) if x else None


def read_records(normalised: DataFrame, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]: each record through its index entry alone.

    A response's digest and length are those of the payload read; they must equal the headers, or the read fails.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for e in index:
                    r = zlib.decompress(data[e["offset"] : e["offset"] + e["length"]], _WINDOW)
                    fields, body = headers(r)
                    http, start = headers(r, body)
                    payload = r[start : body + int(fields["content-length"])]
                    size, digest = int(http["content-length"]), fields["warc-payload-digest"].removeprefix("sha256:")
                    if fields["warc-type"] == "response":
                        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"record {fields['warc-record-id']} is damaged")
                        refers = None
                    else:
                        payload, refers = None, _page(fields["warc-refers-to"])
                    rows.append((_page(fields["warc-record-id"]), size, digest, fields["warc-type"], refers, payload))
                columns = [[row[k] for row in rows] for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + (", payload binary" if with_payload else "")
    return normalised.select("data", "index").mapInArrow(run, schema)


def export(normalised: DataFrame, uri: str) -> DataFrame:
    """Write <archive>.warc.gz and <archive>.idx (record id, kind, digest, offset, length; tabs) under a URI that pyarrow's file
    systems can open from the executors; gives archive and bytes written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, data, index in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_output_stream(f"{root}/{name}.warc.gz") as f:
                    f.write(data)
                with store.open_output_stream(f"{root}/{name}.idx") as f:
                    f.write("".join("\t".join(map(str, e.values())) + "\n" for e in index).encode())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(data)], pa.int64())], ["archive", "bytes"])

    return normalised.select("archive", "data", "index").mapInArrow(run, "archive string, bytes bigint")


def op6_warc(spark, sf_dir: str) -> DataFrame:
    archives = written(write_monolithic(assign_records(table(spark, sf_dir, "pages"))))
    return read_records(written(normalise(archives)))


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN first IS NOT NULL AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""

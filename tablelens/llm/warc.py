"""WARC archives: a monolithic writer, a normaliser of whole-file gzip streams, and an indexed reader.

Some archives are one gzip stream over all records, so no record can be read without inflating all before it. The
normaliser inflates such a stream once, rewrites every record as a gzip member of its own and writes a sidecar index
of offsets and lengths, by which the reader then seeks. All three steps are tasks over lists of files; each attempt
writes names of its own, and only what a finished task reports is used later, so lost executors leave no bad state.

Nulls: a null html is an empty payload; a null URL gives a record without target; a null id is kept. Equal payloads of
at least ``REVISIT_FROM`` bytes are one response, of the smallest id, and revisits; rows that repeat that id and
payload are responses too. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import materialise, new_path, only

REVISIT_FROM = 100
#: Raw bytes after which a task begins another archive file.
FILE_BYTES = 64 << 20
CHUNK = 1 << 20
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(page_id, url, payload: bytes | None, payload_bytes: int, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record; a revisit has no payload."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {payload_bytes}", "Content-Type: application/http;msgtype=response"]
    block = HTTP.format(payload_bytes).encode() + (payload or b"")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def inflate(stream) -> Iterator[bytes]:
    """Bytes of a gzip file of one member or many, in pieces."""
    z, inside, pending = zlib.decompressobj(31), False, b""
    while data := pending or stream.read(CHUNK):
        out, inside, pending = z.decompress(data), True, b""
        if out:
            yield out
        if z.eof:
            z, inside, pending = zlib.decompressobj(31), False, z.unused_data
    if inside:
        raise ValueError("truncated gzip stream")


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream, by their Content-Length."""
    buf = bytearray()
    need = None
    for piece in pieces:
        buf += piece
        at = 0
        while True:
            if need is None:
                end = buf.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                length = next(int(x.split(b":", 1)[1]) for x in bytes(buf[at:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
                need = end - at + 4 + length + 4
            if len(buf) - at < need:
                break
            yield bytes(buf[at : at + need])
            at, need = at + need, None
        del buf[:at]
    if buf:
        raise ValueError("an archive ends within a record")


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_monolithic(rows: DataFrame, folder: str) -> DataFrame:
    """Write records (page_id, url, html, payload_bytes, digest, kind, refers_to) as whole-file gzip streams.

    One row for each finished file: path, records.
    """

    def run(batches):
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        out, z, n, raw, name = None, None, 0, 0, ""

        def close():
            out.write(z.flush())
            out.close()
            return pd.DataFrame({"path": [name], "records": [n]})

        for pdf in batches:
            for page_id, url, html, size, digest, kind, ref in zip(*(pdf[c] for c in ("page_id", "url", "html", "payload_bytes", "digest", "kind", "refers_to")), strict=True):
                if out is None:
                    name, n, raw = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, z = fs.open_output_stream(f"{root}/{name.rpartition('/')[2]}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                payload = None if kind == "revisit" else (html or "").encode()
                whole = record(page_id or None, url, payload, int(size), digest, kind, ref or None)
                out.write(z.compress(whole))
                n, raw = n + 1, raw + len(whole)
                if raw >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    # Ids travel as strings, so that nulls stay nulls in pandas.
    text = rows.select(F.col("page_id").cast("string"), "url", "html", "payload_bytes", "digest", "kind", F.col("refers_to").cast("string"))
    return text.mapInPandas(run, "path string, records long")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrite every file of ``files`` (path) with a member for each record and a sidecar index: path, index, records."""

    def run(batches):
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        for pdf in batches:
            for path in pdf["path"]:
                source, inner = open_fs(path)
                stem, at, n = uuid.uuid4().hex, 0, 0
                with (
                    source.open_input_stream(inner, compression=None) as stream,
                    fs.open_output_stream(f"{root}/{stem}.warc.gz", compression=None) as out,
                    fs.open_output_stream(f"{root}/{stem}.idx", compression=None) as index,
                ):
                    for data in split_records(inflate(stream)):
                        packed = member(data)
                        out.write(packed)
                        index.write(f"{at}\t{len(packed)}\n".encode())
                        at, n = at + len(packed), n + 1
                yield pd.DataFrame({"path": [f"{folder}/{stem}.warc.gz"], "index": [f"{folder}/{stem}.idx"], "records": [n]})

    return files.select("path").mapInPandas(run, "path string, index string, records long")


def read_indexed(files: DataFrame, batch: int = 256) -> DataFrame:
    """Records of normalised files, each sought by its index entry and inflated alone.

    The payload's digest is computed from what was read; for a revisit it is the one recorded.
    """

    def run(batches):
        for pdf in batches:
            for path, index in zip(pdf["path"], pdf["index"], strict=True):
                fs, inner = open_fs(path)
                ifs, iinner = open_fs(index)
                with ifs.open_input_stream(iinner, compression=None) as s:
                    entries = [tuple(map(int, x.split("\t"))) for x in s.read().decode().splitlines()]
                rows = []
                with fs.open_input_file(inner) as f:
                    for offset, length in entries:
                        f.seek(offset)
                        headers, payload = parse_record(zlib.decompress(f.read(length), 31))
                        kind = headers["warc-type"]
                        digest = hashlib.sha256(payload).hexdigest() if kind == "response" else headers["warc-payload-digest"].removeprefix("sha256:")
                        size = len(payload) if kind == "response" else int(headers["x-payload-length"])
                        ids = [headers[h][len("<urn:page:") : -1] if h in headers else "" for h in ("warc-record-id", "warc-refers-to")]
                        rows.append((ids[0] or None, headers.get("warc-target-uri"), size, digest, kind, ids[1] or None))
                        if len(rows) == batch:
                            yield pd.DataFrame(rows, columns=cols)
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=cols)

    cols = ["page_id", "target_uri", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    out = files.select("path", "index").mapInPandas(run, "page_id string, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return out.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, digest, kind, refers_to of every page.

    Which rows are revisits is settled on ids and digests alone; pages then move once, by id, which no hot payload
    gathers in one place.
    """
    p = only(pages, "page_id", "url", "html")
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = p.withColumns({"payload_bytes": F.octet_length(body).cast("long"), "digest": F.sha2(F.encode(body, "utf-8"), 256)})
    narrow = materialise(p.select("page_id", "digest", "payload_bytes"), "payloads").where(F.col("payload_bytes") >= REVISIT_FROM)
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = narrow.join(firsts, "digest").where("not page_id <=> first").select("page_id", "digest", "first").distinct()
    a, b = p.alias("a"), again.alias("b")
    return a.join(b, F.expr("a.page_id <=> b.page_id and a.digest = b.digest"), "left").select(
        "a.page_id", "a.url", F.when(F.col("b.digest").isNull(), F.col("a.html")).alias("html"), "a.payload_bytes", "a.digest",
        F.when(F.col("b.digest").isNull(), "response").otherwise("revisit").alias("kind"), F.col("b.first").alias("refers_to"),
    )


def archive(pages: DataFrame) -> DataFrame:
    """Write all pages as monolithic archives and normalise them: the table of files (path, index, records)."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    whole = materialise(write_monolithic(with_revisits(pages), f"{folder}/whole"), "warc-whole")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return materialise(normalise(whole.repartition(n, "path"), f"{folder}/members"), "warc-members")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive all pages, then read the archives back."""
    files = archive(pages)
    n = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return read_indexed(files.repartition(n, "path"))

"""Deterministic WARC archives: written in sorted shards, committed by a manifest, read back.

Records are sorted by id and cut to shards of about equal payload by a histogram of ids, so
the same pages give the same shards however the input is partitioned. A task writes the
shards it holds one after the other, a gzip member a record, and rolls to a new file when
the compressed size is reached. Headers, dates, record ids and digests follow from the page
alone. A file is written under a temporary name and renamed when complete; its line in the
manifest is the task's output. A task that runs twice writes the same files again, and only
what the manifest lists is read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import stage
from larder.session import shared_folder

SHARD_BYTES = 64 * 1024**2
ROLL_BYTES = 16 * 1024**2
ID_BUCKETS = 65_536
LEAST_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and ":/" not in uri:
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member; the member's header has no time in it."""
    lines = ["WARC/1.1", *(f"{name}: {value}" for name, value in headers)]
    lines += [f"WARC-Block-Digest: {_sha1(block)}", f"Content-Length: {len(block)}", "", ""]
    gzip = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + gzip.flush()


def _record(page_id: object, url: str | None, payload: bytes, refers_to: object) -> bytes:
    """A response, or a revisit of the page ``refers_to`` if that is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    uri = f"urn:page:{page_id}" if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%~-._")
    headers: list[tuple[str, object]] = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", _sha1(payload)),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-ID", page_id),
        ("X-Payload-Length", len(payload)),
    ]
    if refers_to is None:
        return _member(headers, http.encode() + payload)
    headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", refers_to)]
    return _member(headers, http.encode())


class _Writer:
    """The files of one shard after the other."""

    def __init__(self, folder: str, roll_bytes: int) -> None:
        self.fs, self.folder = _store(folder)
        self.roll_bytes = roll_bytes
        self.shard = self.out = None
        self.done: list[tuple[str, int, int]] = []

    def _close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.folder}/{self.name}")
            self.done.append((self.name, self.records, self.size))
            self.out = None

    def _open(self) -> None:
        self.name = f"shard-{self.shard:06d}-{self.roll:05d}.warc.gz"
        self.temporary = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}"
        self.fs.create_dir(self.folder, recursive=True)
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        info = b"format: WARC File Format 1.1\r\n"
        headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(self.name)), ("WARC-Date", DATE)]
        headers += [("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
        self.size, self.records = 0, 0
        self._put(_member(headers, info))

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.size += len(member)

    def add(self, shard: int, member: bytes) -> None:
        if shard != self.shard:
            self._close()
            self.shard, self.roll = shard, 0
        elif self.out is not None and self.size >= self.roll_bytes:
            self._close()
            self.roll += 1
        if self.out is None:
            self._open()
        self._put(member)
        self.records += 1

    def finished(self, last: bool = False) -> pa.RecordBatch:
        if last:
            self._close()
        rows, self.done = self.done, []
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        kinds = (pa.string(), pa.int64(), pa.int64())
        arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["file", "records", "bytes"])


def _sharded(pages: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """The rows with the shard they belong to, and the number of shards."""
    span = pages.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high")).first()
    if span["low"] is None:
        return pages.withColumn("shard", F.lit(0).cast("long")), 1
    width = max(1, -(-(span["high"] - span["low"] + 1) // ID_BUCKETS))
    bucket = F.coalesce(F.floor((F.col("page_id") - span["low"]) / width), F.lit(-1)).cast("long")
    sizes = pages.groupBy(bucket.alias("of")).agg(F.sum(F.col("n_bytes") + 1).alias("size"))
    upto = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)  # at most ID_BUCKETS + 1 rows
    shards = sizes.select("of", F.floor(F.coalesce(F.sum("size").over(upto), F.lit(0)) / shard_bytes).alias("shard"))
    count = (shards.agg(F.max("shard")).first()[0] or 0) + 1
    return pages.join(F.broadcast(shards), bucket == F.col("of")).drop("of"), count


def write_archives(
    pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES
) -> DataFrame:
    """Writes a record for every row (page_id, url, html) and returns the manifest.

    The payload is the html in UTF-8, a null as empty. Of equal payloads of at least
    ``LEAST_REVISIT`` bytes the one with the largest page_id is the response (all rows with
    that id, if it repeats) and the others revisit it. Rows without id are archived as
    responses. The manifest (file, records, bytes) is stored beside the files.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"))
    sizes = rows.select("page_id", F.octet_length("html").alias("n_bytes"), F.sha1("html").alias("digest"))
    sizes = stage(sizes, "payloads")
    able = sizes.where((F.col("n_bytes") >= LEAST_REVISIT) & F.col("page_id").isNotNull())
    copies = able.groupBy(F.col("digest").alias("of")).agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    revisits = able.join(copies.where("n > 1"), F.col("digest") == F.col("of")).where("page_id < refers_to")
    revisits = revisits.select("page_id", "digest", "refers_to").distinct()
    sharded, count = _sharded(sizes.select("page_id", "n_bytes"), shard_bytes)
    shard_of = sharded.groupBy("shard").agg(F.min("page_id").alias("first")).where("first IS NOT NULL")
    starts = sorted((row["first"], row["shard"]) for row in shard_of.collect())
    if starts:
        thresholds = F.array(*(F.lit(first).cast("long") for first, _ in starts))
        shard = F.greatest(F.size(F.filter(thresholds, lambda x: x <= F.col("page_id"))), F.lit(1)) - 1
    else:
        shard = F.lit(0)
    # The payloads move once: marks of revisits travel to the shards on rows of their own.
    marks = revisits.withColumn("mark", F.lit(0))
    everything = rows.withColumn("mark", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    placed = everything.withColumn("shard", F.coalesce(shard, F.lit(0)))
    order = ("shard", "page_id", "mark", "url", "html")
    ordered = placed.repartition(count, "shard").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, marked, of_page = _Writer(folder, roll_bytes), {}, None
        for batch in batches:
            names = ("page_id", "url", "html", "mark", "digest", "refers_to", "shard")
            columns = [batch.column(name) for name in names]
            for i in range(batch.num_rows):
                page_id, url, text, mark, digest, refers_to, of = (column[i].as_py() for column in columns)
                if page_id != of_page:
                    marked, of_page = {}, page_id
                if not mark:
                    marked[digest] = refers_to
                    continue
                payload = text.encode()
                original = marked.get(hashlib.sha1(payload).hexdigest()) if marked else None
                writer.add(of, _record(page_id, url, payload, original))
            if writer.done:
                yield writer.finished()
        yield writer.finished(last=True)

    spark = pages.sparkSession
    schema = "file string, records long, bytes long"
    ordered.mapInArrow(run, schema).write.parquet(f"{folder}/manifest")
    return spark.read.schema(schema).parquet(f"{folder}/manifest")


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers and the block of each gzip member of a file."""
    rest, gzip, parts = b"", zlib.decompressobj(31), []
    while True:
        data = rest or stream.read(1 << 20)
        if not data:
            return
        parts.append(gzip.decompress(data))
        rest = b""
        if gzip.eof:
            rest, gzip = gzip.unused_data, zlib.decompressobj(31)
            head, _, body = b"".join(parts).partition(b"\r\n\r\n")
            parts = []
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield headers, body[: int(headers["Content-Length"])]


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The page records of the files a manifest lists, a row each.

    ``payload`` is null for a revisit; ``payload_digest`` and ``payload_bytes`` are the
    headers' then, and those of the payload read otherwise.
    """
    files = manifest.select("file")
    count = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = _store(folder)
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    rows = []
                    for headers, block in _records(stream):
                        if "X-Page-ID" not in headers:
                            continue
                        response = headers["WARC-Type"] == "response"
                        payload = block.partition(b"\r\n\r\n")[2] if response else None
                        stated = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:"))
                        rows.append(
                            (
                                None if headers["X-Page-ID"] == "None" else int(headers["X-Page-ID"]),
                                headers["WARC-Target-URI"],
                                headers["WARC-Type"],
                                len(payload) if response else int(headers["X-Payload-Length"]),
                                hashlib.sha1(payload).hexdigest() if response else stated.hex(),
                                int(headers["X-Refers-To-Page"]) if "X-Refers-To-Page" in headers else None,
                                payload,
                            )
                        )
                        if len(rows) == 500:
                            yield _batch(rows)
                            rows = []
                    yield _batch(rows)

    return files.repartition(count, "file").mapInArrow(run, _SCHEMA)


_SCHEMA = (
    "page_id long, target_uri string, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long, payload binary"
)
_ARROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("target_uri", pa.string()),
        ("record_type", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_ARROW)
    arrays = [pa.array(list(c), field.type) for c, field in zip(columns, _ARROW, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def archive_folder(pages: DataFrame) -> str:
    """A new folder for archives in the shared folder."""
    return f"{shared_folder(pages.sparkSession)}/larder-llm/warc-{uuid.uuid4().hex}"

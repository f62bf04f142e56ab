"""WARC archives: a deterministic sharded writer, and a reader."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridprobe.llm.common import stage

# Compressed bytes at which a file is full, and payload bytes per shard, which one task writes.
FILE_BYTES = 256 << 20
SHARD_BYTES = 1 << 30
LEAST_SHARDS = 16
DATE = "2024-01-01T00:00:00Z"
LEVEL = 5
ID_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(ID_SPACE, f'page:{page_id}')}>"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """The bytes of one record, all headers and digests made anew from the payload.

    A revisit has the HTTP headers of the page, with the length of its payload, and no payload.
    """
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    # A target holds no line break; it would end the header.
    target = "".join((url or "").split("\r")).replace("\n", "") or f"urn:page:{page_id}"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", date), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page", str(refers_to))]
    fields += [("X-Page", str(page_id)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def info_record(name: str, date: str = DATE) -> bytes:
    """The record that opens a file."""
    body = b"software: gridprobe\r\nformat: WARC File Format 1.1\r\n"
    head = (
        f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(ID_SPACE, name)}>\r\nWARC-Date: {date}\r\n"
        f"WARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return head.encode() + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without name or time, so that equal records give equal bytes."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# --- roles ------------------------------------------------------------------------------------


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page, sha, bytes, refers_to): what each record is.

    Of pages with equal payloads the least id is the response that the others revisit; payloads below
    ``min_bytes`` are always responses. Only digests are shuffled, and the least id of each is aggregated before.
    """
    first = pages.groupBy("sha", "bytes").agg(F.min("page").alias("first"))
    other = (F.col("first") != F.col("page")) & (F.col("bytes") >= min_bytes)
    return pages.join(first, ["sha", "bytes"]).select("page", "sha", "bytes", F.when(other, F.col("first")).alias("refers_to"))


# --- writer -----------------------------------------------------------------------------------


def _filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """Local paths, and whatever pyarrow opens by URI."""
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pa.fs.LocalFileSystem(), uri)


class _Roller:
    """Writes records of one shard into files, a new one whenever the compressed size is reached.

    Every file is written under a temporary name of the task attempt; a lost or repeated attempt leaves files
    that nobody names.
    """

    def __init__(self, folder: str, shard: int, attempt: str, file_bytes: int):
        self.fs, self.folder = _filesystem(folder)
        self.shard, self.attempt, self.limit = shard, attempt, file_bytes
        self.done: list[dict] = []
        self.sink = None

    def add(self, page_id: int, data: bytes) -> None:
        packed = member(data)
        if self.sink is not None and self.size + len(packed) > self.limit:
            self.close()
        if self.sink is None:
            self._open()
        self.put(packed)
        self.records += 1
        self.first = page_id if self.first is None else self.first
        self.last = page_id

    def _open(self) -> None:
        self.name = f"part-{self.shard:06d}-{len(self.done):04d}.warc.gz"
        self.temporary = f"_temporary/{self.attempt}-{self.name}"
        self.fs.create_dir(f"{self.folder}/_temporary", recursive=True)
        self.sink = self.fs.open_output_stream(f"{self.folder}/{self.temporary}", compression=None)
        self.size, self.records, self.first, self.last, self.hash = 0, 0, None, None, hashlib.sha1()
        self.put(member(info_record(self.name)))

    def put(self, packed: bytes) -> None:
        self.sink.write(packed)
        self.hash.update(packed)
        self.size += len(packed)

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.sink = None
            self.done.append({
                "name": self.name, "temporary": self.temporary, "bytes": self.size, "records": self.records,
                "sha1": self.hash.hexdigest(), "first_page": self.first, "last_page": self.last,
            })


_MANIFEST = pa.schema([
    ("name", pa.string()), ("temporary", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha1", pa.string()),
    ("first_page", pa.int64()), ("last_page", pa.int64()),
])
_MANIFEST_SQL = "name string, temporary string, bytes long, records long, sha1 string, first_page long, last_page long"


def shard_cuts(pages: DataFrame, shard_bytes: int) -> list[int]:
    """First page of every shard but the first: shards are ranges of page ids of about equal payload.

    Sums of bytes over a fixed number of id ranges are exact, so the cuts depend on the pages alone. Ranges that
    hold too much are split again.
    """
    total, low, high = pages.agg(F.sum("bytes"), F.min("page"), F.max("page")).first()
    if total is None or low == high:
        return []
    want = max(total / max(LEAST_SHARDS, -(-int(total) // shard_bytes)), 1.0)
    cuts, open_ = [], [(low, high + 1)]
    weighed: list[tuple[int, int, int]] = []
    while open_:
        found = _weigh(pages, open_)
        open_ = [(a, b) for a, b, w in found if w > want / 4 and b - a > 1]
        weighed += [(a, b, w) for a, b, w in found if not (w > want / 4 and b - a > 1)]
    filled = 0
    for a, _, w in sorted(weighed):
        if filled and filled + w > want:
            cuts.append(a)
            filled = 0
        filled += w
    return cuts


def _weigh(pages: DataFrame, ranges: list[tuple[int, int]], pieces: int = 256) -> list[tuple[int, int, int]]:
    """Bytes per piece of each range, for all ranges in one aggregation."""
    bounds = np.array(ranges)
    steps = np.maximum(-(-(bounds[:, 1] - bounds[:, 0]) // pieces), 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(bounds[:, 0])
        starts, ends, widths = bounds[order, 0], bounds[order, 1], steps[order]
        for batch in batches:
            page = batch.column("page").to_numpy()
            at = np.searchsorted(starts, page, side="right") - 1
            inside = (at >= 0) & (page < ends[at])
            at, page, size = at[inside], page[inside], batch.column("bytes").to_numpy()[inside]
            piece = (page - starts[at]) // widths[at]
            yield pa.record_batch({"at": pa.array(starts[at] + piece * widths[at]), "end": pa.array(np.minimum(starts[at] + (piece + 1) * widths[at], ends[at])), "bytes": pa.array(size)})

    told = pages.select("page", "bytes").mapInArrow(place, "at long, end long, bytes long")
    rows = told.groupBy("at", "end").agg(F.sum("bytes").alias("bytes")).collect()
    return [(r["at"], r["end"], r["bytes"]) for r in rows]


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          min_bytes: int = 0, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes a record per page into gzipped WARC files in ``folder`` and returns the manifest, a row per file.

    Records are sorted by page id over ranges of ids, one task and one or more files each. Names, order, bytes
    and digests depend on the pages and the sizes alone. A task writes under temporary names and returns what
    it wrote; only the files of attempts that Spark counts are renamed, by a second job that may be repeated,
    and ``manifest.json`` comes last. Payloads cross the cluster once.

    NULL html is an empty payload, a NULL url a name made of the id. Rows without an id are left out. Of rows
    that repeat an id all are written. An empty table gives a manifest without files.
    """
    spark = pages.sparkSession
    html = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), html.alias("html")
    )
    digests = stage(rows.select("page", F.sha1("html").alias("sha"), F.octet_length("html").cast("long").alias("bytes")), "digests")
    roles = stage(with_roles(digests, min_bytes).filter("refers_to IS NOT NULL").select("page", "sha", "refers_to").distinct(), "roles")
    cuts = np.array(shard_cuts(digests, shard_bytes), np.int64)

    @F.pandas_udf("int")
    def shard_of(page):  # noqa: ANN001
        import pandas as pd

        return pd.Series(np.searchsorted(cuts, page.to_numpy(), side="right").astype(np.int32))

    # Roles travel beside the pages instead of being joined to them, so that payloads are shuffled once.
    kept = rows.select("page", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers_to"))
    told = roles.select("page", F.lit(0).alias("kind"), F.col("sha").alias("url"), F.lit(None).cast("binary").alias("html"), "refers_to")
    sharded = kept.union(told).withColumn("shard", shard_of("page"))
    placed = sharded.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("page", "kind", "html", "url")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        attempt = f"{context.stageId()}-{context.attemptNumber()}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        roller, role = None, {}
        at = None
        for batch in batches:
            for page, kind, url, html, refers_to, shard in zip(*(batch.column(c).to_pylist() for c in ("page", "kind", "url", "html", "refers_to", "shard"))):
                if page != at:
                    at, role = page, {}
                if kind == 0:
                    role[url] = refers_to
                    continue
                if roller is None:
                    roller = _Roller(folder, shard, attempt, file_bytes)
                refers = role.get(hashlib.sha1(html).hexdigest()) if role else None
                roller.add(page, record(page, url, html, refers))
        if roller is not None:
            roller.close()
            yield pa.RecordBatch.from_pylist(roller.done, schema=_MANIFEST)

    manifest = stage(placed.mapInArrow(work, _MANIFEST_SQL), "manifest")
    _commit(spark, manifest, folder)
    return manifest


def _commit(spark: SparkSession, manifest: DataFrame, folder: str) -> None:
    """Gives the files their names and writes ``manifest.json``; may be repeated at any point.

    A file that has neither its temporary nor its last name is an error, and then there is no new manifest.
    """

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = _filesystem(folder)
        for batch in batches:
            for name, temporary in zip(batch.column("name").to_pylist(), batch.column("temporary").to_pylist()):
                if fs.get_file_info(f"{where}/{temporary}").type != pa.fs.FileType.NotFound:
                    fs.move(f"{where}/{temporary}", f"{where}/{name}")
                elif fs.get_file_info(f"{where}/{name}").type == pa.fs.FileType.NotFound:
                    raise FileNotFoundError(f"{name} was written as {temporary}, and neither is there")
            yield batch.select(["name"])

    named = manifest.select("name", "temporary").mapInArrow(rename, "name string").count()
    if named != manifest.count():
        raise RuntimeError(f"{named} files were named, the manifest of {folder} lists others")
    fs, where = _filesystem(folder)
    fs.create_dir(where, recursive=True)
    lines = manifest.drop("temporary").orderBy("name").toLocalIterator()
    with fs.open_output_stream(f"{where}/_manifest.tmp", compression=None) as sink:
        for row in lines:
            sink.write((json.dumps(row.asDict(), sort_keys=True) + "\n").encode())
    fs.move(f"{where}/_manifest.tmp", f"{where}/manifest.json")


# --- reader -----------------------------------------------------------------------------------


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a gzipped file, a member at a time."""
    held, unpacker, pending = b"", zlib.decompressobj(31), b""
    while True:
        chunk = pending or stream.read(1 << 20)
        if not chunk:
            break
        held += unpacker.decompress(chunk)
        pending = unpacker.unused_data
        if unpacker.eof:
            yield _parsed(held)
            held, unpacker = b"", zlib.decompressobj(31)
        else:
            pending = b""
    if held:
        raise ValueError("a file ends within a record")


def _parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the archives.

    Files are spread over tasks by name. Digests of blocks and payloads are computed anew and must equal the headers.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = _filesystem(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with fs.open_input_stream(f"{where}/{name}", compression=None) as stream:
                    yield from _rows(name, stream)

    def _rows(name: str, stream) -> Iterator[pa.RecordBatch]:
        columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        out: list[tuple] = []
        for fields, block in records_of(stream):
            if fields["WARC-Type"] == "warcinfo":
                continue
            http, _, payload = block.partition(b"\r\n\r\n")
            size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            whole = fields["WARC-Type"] == "revisit" or (len(payload) == size and digest_of(payload) == digest)
            if not whole or fields["WARC-Block-Digest"] != f"sha1:{digest_of(block)}":
                raise ValueError(f"{name}: record {fields['WARC-Record-ID']} does not match its digests")
            refers = fields.get("X-Refers-To-Page")
            out.append((int(fields["X-Page"]), size, digest, fields["WARC-Type"], None if refers is None else int(refers)))
            if len(out) >= 10_000:
                yield _batch(columns, out)
                out = []
        if out:
            yield _batch(columns, out)

    def _batch(columns, rows) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.record_batch({c: pa.array(v, k) for c, v, k in zip(columns, zip(*rows), kinds)})

    names = manifest.select("name")
    files = max(1, min(names.count(), 10_000))
    return names.repartition(files).mapInArrow(
        work, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )

"""WARC archives: a deterministic sharded writer, and a reader.

Rows are dealt into shards by ranges of their key, cut at quantiles weighted by payload bytes, and sorted within a
shard, so the same rows always make the same files, whatever the cluster.  A shard's files roll when their compressed
size reaches a limit.  Headers and digests are made anew.  Each file is written under a temporary name and renamed when
complete; the manifest, written last, lists the files that count.  A task that is run again writes the same bytes under
the same names, and what a lost task left under temporary names is in no manifest.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: Payload bytes of a shard, and shards at most (of a larger table they are larger).
SHARD_BYTES, MOST_SHARDS = 8_000_000, 8192
#: A file rolls when its compressed bytes reach this share of its shard's, within these limits.
ROLL_SHARE, ROLL_LEAST, ROLL_MOST = 1 / 8, 1_000_000, 1_000_000_000
#: Ranges of keys that are weighed at a time to find the shards' limits.
CELLS = 16_384
_LEAST = -(2**63)
#: Tasks that read archives back at most.
MOST_TASKS = 100_000
#: Smaller payloads are never revisits.
LEAST_REVISIT = 100
#: Duplicate groups up to this number are sent to all tasks; more are joined by shuffle.
MOST_BROADCAST = 300_000
#: Capture date of records whose rows have none: archives must not depend on the time of writing.
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(kind: str, ident: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ident)}>"), ("WARC-Date", DATE), *fields]
    head += [("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]
    lines = ["WARC/1.1", *(f"{k}: {''.join(c if c.isprintable() else '%%%02X' % ord(c) for c in v)}" for k, v in head if v is not None)]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """A response record, or a revisit record that names the page whose response holds the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    number = None if page_id is None else str(page_id)
    fields = [("WARC-Target-URI", url), ("WARC-Payload-Digest", "sha256:" + digest), ("Content-Type", "application/http;msgtype=response"), ("X-Page-Id", number), ("X-Payload-Length", str(len(payload)))]
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("X-Refers-To-Page", str(first))]
        return _record("revisit", f"revisit {number} {url} {digest}", fields, http)
    return _record("response", f"response {number} {url} {digest}", fields, http + payload)


def _gzip(data: bytes) -> bytes:
    pack = zlib.compressobj(5, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _split_path(path: str):
    return pyarrow.fs.FileSystem.from_uri(path)


class _ShardWriter:
    """The files of one shard, one after the other."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.fs, self.folder = _split_path(folder)
        self.uri, self.shard, self.roll, self.part, self.out = folder, shard, roll, 0, None
        self.done: list[dict] = []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.temporary = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.digest = self.fs.open_output_stream(self.temporary), 0, 0, hashlib.sha256()
            self._put(_gzip(_record("warcinfo", f"warcinfo {self.name}", [("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"software: tapeflow\r\nformat: WARC File Format 1.1\r\n")))
        self._put(_gzip(record))
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.folder}/{self.name}")
            self.done.append({"path": f"{self.uri}/{self.name}", "shard": self.shard, "part": self.part, "records": self.records, "bytes": self.size, "sha256": self.digest.hexdigest()})
            self.out, self.part = None, self.part + 1


_MANIFEST = "path string, shard long, part long, records long, bytes long, sha256 string"


def with_originals(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, first, revisit: first is the least page of those with the same payload.

    Only payloads that occur twice are joined back, so a frequent payload costs one row.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    large = rows.where(F.octet_length("html") >= LEAST_REVISIT)
    groups = stored(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "warc-groups")
    return rows.join(F.broadcast(groups) if groups.count() <= MOST_BROADCAST else groups, "digest", "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))


def _located(starts: list[tuple[int, int]]):
    """A function of id and hash columns: the number of starts, sorted pairs, that a pair doesn't come before."""
    ids, hashes = (np.array(x, np.int64) for x in zip(*starts, strict=True)) if starts else (np.zeros(0, np.int64),) * 2

    def at(own: np.ndarray, h: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        for i in np.unique(low[high > low]):  # ids at which several starts lie, or one within the id
            rows = (low == i) & (high > low)
            low[rows] += np.searchsorted(hashes[i : high[rows][0]], h[rows], "right")
        return low

    return at


def _cells(sizes: DataFrame, heavy: int) -> list[tuple[tuple[int, int], int]]:
    """((id, hash) a cell starts with, its bytes), sorted: cells of at most `heavy` bytes, unless all their rows are alike.

    Ranges of ids are split into cells of equal width, and those that are heavy again, till they are one id; the rows of a
    heavy id are split by their hash.  A round counts one job's cells, CELLS and a few more, on the driver.
    """
    low, high = sizes.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return []
    done, by_hash, pending = [], [], [(low, high)]
    while pending:
        parts = max(2, CELLS // len(pending))
        begin = [(a, _LEAST) for a, _ in pending]
        first = np.array([a for a, _ in pending], np.int64)
        last, width = np.array([b for _, b in pending], np.int64), np.array([-(-(b - a + 1) // parts) for a, b in pending], np.uint64)
        at = _located(begin)

        @F.pandas_udf("long")
        def cell(own: pd.Series) -> pd.Series:
            x = own.to_numpy(np.int64)
            i = np.maximum(at(x, np.zeros(len(x), np.int64)) - 1, 0)  # noqa: B023
            inside = (x >= first[i]) & (x <= last[i])  # noqa: B023
            step = (x.view(np.uint64) - first[i].view(np.uint64)) // width[i]  # noqa: B023
            return pd.Series(np.where(inside, i * parts + step.astype(np.int64), -1))  # noqa: B023

        found = sizes.withColumn("cell", cell("id")).where("cell >= 0").groupBy("cell").agg(F.sum("bytes")).collect()
        nearer = []
        for c, weight in found:
            a, b = pending[c // parts]
            start = a + c % parts * int(width[c // parts])
            end = min(b, start + int(width[c // parts]) - 1)
            if weight <= heavy:
                done.append(((start, _LEAST), weight))
            elif end > start:
                nearer.append((start, end))
            else:
                by_hash.append(start)
        pending = sorted(nearer)
    if by_hash:
        ids = sizes.sparkSession.createDataFrame([(i,) for i in by_hash], "id long")  # at most one for each `heavy` bytes
        share = F.shiftright("hash", 64 - 10).alias("share")
        for i, c, weight in sizes.join(F.broadcast(ids), "id").groupBy("id", share).agg(F.sum("bytes")).collect():
            done.append(((i, c << (64 - 10)), weight))
    return sorted(done)


def with_shards(rows: DataFrame, shard_bytes: int) -> tuple[DataFrame, int, int]:
    """rows with the column shard, their number, and the bytes of a shard.

    Shards are ranges of page_id, rows without one first, that hold about equal shares of payload bytes, whatever the ids.
    There are MOST_SHARDS at most, which are larger where the table is.
    """
    own, h = F.coalesce("page_id", F.lit(_LEAST)).alias("id"), F.xxhash64("url", "digest").alias("hash")
    sizes = stored(rows.select(own, h, (F.octet_length("html") + 500).alias("bytes")), "warc-sizes")
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    shard_bytes = max(shard_bytes, -(-total // MOST_SHARDS))
    n = max(1, -(-total // shard_bytes))
    starts, before, shard = [], 0, 0
    for start, weight in _cells(sizes, max(1, shard_bytes // 8)) if n > 1 else []:
        own_shard = min(n - 1, (2 * before + weight) * n // (2 * total))
        if own_shard > shard:
            starts.append(start)
            shard = own_shard
        before += weight
    at = _located(starts)

    @F.pandas_udf("long")
    def of(own: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(at(own.to_numpy(np.int64), h.to_numpy(np.int64)))

    return rows.withColumn("shard", of(own, h)), len(starts) + 1, shard_bytes


def write_archives(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int | None = None) -> DataFrame:
    """The manifest, as written to folder/manifest: path, shard, part, records, bytes, sha256 of every file.

    pages: page_id, url, html; null html is an empty payload, a null url gives a record without target, a null page_id
    one without number.  Rows of the least page_id of equal payloads are all responses, should there be several.
    roll_bytes: compressed bytes at which a file rolls; None takes ROLL_SHARE of a shard.
    """
    fs, path = _split_path(folder)
    fs.create_dir(path, recursive=True)
    rows, n, shard_bytes = with_shards(with_originals(pages), shard_bytes)
    roll = roll_bytes or int(min(ROLL_MOST, max(ROLL_LEAST, shard_bytes * ROLL_SHARE)))

    def write(batches):
        writer, done = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if writer is None or writer.shard != r["shard"]:
                    if writer is not None:
                        writer.close()
                        done += writer.done
                    writer = _ShardWriter(folder, r["shard"], roll)
                writer.add(page_record(r["page_id"], r["url"], r["html"].encode("utf-8", "surrogatepass"), r["digest"], r["first"], r["revisit"]))
        if writer is not None:
            writer.close()
            done += writer.done
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("path", pa.string()), ("shard", pa.int64()), ("part", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    order = ["shard", "page_id", "url", "digest"]
    dealt = rows.select("shard", "page_id", "url", "digest", "html", "first", "revisit").repartitionById(n, F.col("shard").cast("int")).sortWithinPartitions(*order)
    manifest = dealt.mapInArrow(write, _MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def _members(stream):
    """The unpacked gzip members of a stream, one record each."""
    data = b""
    while True:
        if not data and not (data := stream.read(1 << 20)):
            return
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not data and not (data := stream.read(1 << 20)):
                raise ValueError("an archive ends within a record")
            parts.append(unpack.decompress(data))
            data = unpack.unused_data if unpack.eof else b""
        yield b"".join(parts)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    size = int(headers["content-length"])
    if not lines[0].startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("malformed record")
    return headers, rest[:size]


def read_archives(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to of the records in a manifest's files.

    Payload digests of responses are computed from the archive, and every digest and record count is verified.  With
    payload the column payload (null for revisits) is added.
    """
    schema = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(schema + [("payload", pa.binary())] * payload)

    def read(batches):
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, place = _split_path(path)
                out, held, n = [], 0, 0
                with fs.open_input_stream(place, compression=None) as stream:
                    for record in _members(stream):
                        head, block = parse_record(record)
                        if hashlib.sha256(block).hexdigest() != head["warc-block-digest"].removeprefix("sha256:"):
                            raise ValueError(f"{path}: a block differs from its digest")
                        kind = head["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        n += 1
                        digest, body = head["warc-payload-digest"].removeprefix("sha256:"), None
                        size = int(head["x-payload-length"])
                        if kind == "response":
                            body = block.partition(b"\r\n\r\n")[2]
                            if len(body) != size or hashlib.sha256(body).hexdigest() != digest:
                                raise ValueError(f"{path}: a payload differs from its digest")
                        number = lambda name: int(head[name]) if name in head else None
                        row = {"page_id": number("x-page-id"), "url": head.get("warc-target-uri"), "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers_to": number("x-refers-to-page")}
                        out.append(row | {"payload": body} if payload else row)
                        held += len(body or b"") if payload else 100
                        if held > 4_000_000:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out, held = [], 0
                if n != records:
                    raise ValueError(f"{path}: {n} records, the manifest has {records}")
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    files = manifest.count()
    spread = manifest.select("path", "records").repartition(max(1, min(files, MOST_TASKS)), "path")  # a number: AQE leaves it as it is
    return spread.mapInArrow(read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payload)


def verified(found: DataFrame) -> DataFrame:
    """read_archives' rows, if each revisit names a response with its digest and length; else an error.

    Revisits of one response are one row of the join, however many there are.
    """
    parts = ("payload_digest", "payload_bytes")
    named = found.where("record_type = 'revisit'").select(F.col("refers_to").alias("named"), *[F.col(c).alias(f"own_{c}") for c in parts]).distinct()
    there = found.where("record_type = 'response'").select("page_id", *parts).distinct()
    same = F.col("named").eqNullSafe(F.col("page_id"))
    for c in parts:
        same = same & (F.col(c) == F.col(f"own_{c}"))
    wrong = named.join(there, same, "left_anti").limit(1).collect()
    if wrong:
        raise ValueError(f"a revisit differs from the response that it names, {wrong[0]['named']}")
    return found


def archive_pages(pages: DataFrame, folder: str | None = None, **sizes) -> DataFrame:
    """Writes pages to folder (a new one in the shared folder if None) and returns read_archives of it, verified."""
    spark: SparkSession = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return verified(stored(read_archives(write_archives(pages, folder, **sizes)), "warc-read"))

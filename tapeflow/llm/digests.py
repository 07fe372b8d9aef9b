"""Quartile bucket digests: fingerprints of whole texts that can be compared with one another.

A text's bytes are read as triplets at a few fixed spacings; each triplet is hashed to one of BUCKETS buckets.  The digest
holds, for every bucket, the quartile that its count lies in (two bits), and the length on a log scale (a byte).  Two
digests differ by the distance of their quartiles, bucket for bucket, and of their lengths; both parts are bounded, so
the difference is, and `likeness` maps it to 0 to 1.

Defined cases: a null text is an empty one; an empty text has a digest of its own (all buckets zero, length zero).  The
bytes are read as a ring, so texts shorter than a triplet's reach have triplets too, four for each byte.  Equal texts
have equal digests, whatever their keys.  Texts are read whole, in blocks of BLOCK bytes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, stored, text_slices

BUCKETS = 512
#: Where the second and third byte of a triplet stand.
SPACINGS = ((2, 4), (3, 7), (4, 9), (5, 11))
#: Bytes that are counted at a time.
BLOCK = 1 << 20
#: Steps of length to an octave; most steps that lengths count for, and what one step counts.
OCTAVE, MOST_STEPS, STEP_WEIGHT = 8, 32, 8
#: What quartiles that lie 0 to 3 apart count; the ends count double.
APART = np.array([0, 1, 2, 6], np.int64)
#: Expected difference of two digests whose quartiles have nothing to do with each other: such digests have likeness 0.
UNRELATED = BUCKETS * (6 * 1 + 4 * 2 + 2 * 6) / 16
_REACH = max(b for _, b in SPACINGS)


def bucket_counts(data: bytes) -> np.ndarray:
    """Hashed triplets of a ring of bytes in each bucket."""
    counts = np.zeros(BUCKETS, np.int64)
    if not data:
        return counts
    tail = (data * (_REACH // len(data) + 1))[:_REACH]
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for start in range(0, len(data), BLOCK):
        part = data[start : start + BLOCK + _REACH]
        n = min(BLOCK, len(data) - start)
        x = np.frombuffer(part + tail[: n + _REACH - len(part)], np.uint8).astype(np.uint32)
        for kind, (i, j) in enumerate(SPACINGS):
            h = x[:n] | (x[i : i + n] << np.uint32(8)) | (x[j : j + n] << np.uint32(16)) | np.uint32(kind << 24)
            h *= np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA77)
            counts += np.bincount(h >> shift, minlength=BUCKETS)
    return counts


def fingerprint(data: bytes) -> str:
    """The digest as hexadecimal: one byte of length, then four buckets to a byte."""
    counts = bucket_counts(data)
    low, mid, high = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    quartile = ((counts > low).astype(np.uint8) + (counts > mid) + (counts > high)).reshape(-1, 4)
    length = min(255, round(OCTAVE * math.log2(1 + len(data))))
    return bytes([length]).hex() + (quartile << np.array([6, 4, 2, 0], np.uint8)).sum(1).astype(np.uint8).tobytes().hex()


def difference(a: str, b: str) -> int:
    """Bounded: at most 6 for each bucket, and STEP_WEIGHT * MOST_STEPS for the lengths; 0 for equal digests."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8).astype(np.int64), np.frombuffer(bytes.fromhex(b), np.uint8).astype(np.int64)
    apart = np.abs(((x[1:, None] >> np.array([6, 4, 2, 0])) & 3) - ((y[1:, None] >> np.array([6, 4, 2, 0])) & 3))
    return int(APART[apart].sum() + STEP_WEIGHT * min(abs(x[0] - y[0]), MOST_STEPS))


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 for those that lie as far apart as unrelated ones, or farther."""
    return max(0.0, 1.0 - difference(a, b) / UNRELATED)


def likeness_of(a: Column, b: Column) -> Column:
    """likeness of two columns of digests; null if either is null."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y) if x and y else None for x, y in zip(a, b, strict=True)], dtype="float64")

    return run(a, b)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fingerprint of every row; rows stay where they are."""

    def make(batch):
        return {"key": batch.column("key"), "fingerprint": [fingerprint(_bytes(t)) for t in batch.column("text").to_pylist()]}

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return mapped(rows, "text", make, "key long,fingerprint string").withColumnRenamed("key", key)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def edited(text: str, following: str) -> str:
    """text with its last floor(n/2) characters replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
_HEX = ("edited_sha256", "fingerprint", "edited_fingerprint")
_RESULT_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _result(doc_id, text: str, own: str, following: str, other: str) -> dict:
    data = _bytes(edited(text, following))
    changed = fingerprint(data)
    return {
        "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(data).hexdigest(), "fingerprint": own,
        "edited_fingerprint": changed, "near_edited": likeness(own, changed), "near_next": likeness(own, other),
    }


def edited_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's digest beside those of its edited text and of the next document.

    The next document is that of the next key, after the last one the first; a single document follows itself.  Null keys
    come first; rows of one key are ordered by a hash of their texts, then by the texts.  Null texts are empty.  Other columns are
    not looked at.

    One shuffle puts the rows in order over all partitions.  A task holds two neighbours at a time; the pairs that lie
    across two partitions are made in a second step from the first and last row of each.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    held = [(f.name, pa.binary() if f.name in _HEX else f.type) for f in _RESULT]  # half the size of their letters
    edges = pa.schema([*held, ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())])

    def packed(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([r | {c: bytes.fromhex(r[c]) for c in _HEX if c in r} for r in rows], schema=edges)

    def walk(batches):
        part, last, first = TaskContext.get().partitionId(), None, True
        for batch in text_slices(batches, "text"):
            out = []
            for doc_id, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = fingerprint(_bytes(t))
                if first:
                    out.append({"doc_id": doc_id, "fingerprint": own, "part": part, "edge": "first", "text": t})
                    first = False
                else:
                    out.append(_result(*last, t, own))
                last = doc_id, t, own
            yield packed(out)
        if last:
            yield packed([{"doc_id": last[0], "fingerprint": last[2], "part": part, "edge": "last", "text": last[1]}])

    schema = ", ".join(f"{c} binary" if (c := x.split()[0]) in _HEX else x for x in _RESULT_SQL.split(", "))
    walked = stored(placed.mapInArrow(walk, schema + ", part int, edge string, text string"), "digests")
    walked = walked.withColumns({c: F.lower(F.hex(c)) for c in _HEX})
    ends = walked.where("edge IS NOT NULL")
    parts = sorted(r[0] for r in ends.where("edge = 'first'").select("part").collect())  # one number for each partition
    follows = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    one = ends.where("edge = 'last'").select("part", "doc_id", "text", "fingerprint")
    other = ends.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    across = one.join(F.broadcast(follows), "part").join(other, "next_part")

    def join(batches):
        for batch in text_slices(batches, "text"):
            yield pa.RecordBatch.from_pylist([_result(r["doc_id"], r["text"], r["fingerprint"], r["next_text"], r["next_fingerprint"]) for r in batch.to_pylist()], schema=_RESULT)

    made = walked.where("edge IS NULL").select(*_RESULT.names).unionByName(across.mapInArrow(join, _RESULT_SQL))
    return made.withColumnRenamed("doc_id", key)

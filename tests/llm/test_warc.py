import gzip
import hashlib

import pytest

from tapeflow.llm import warc
from tapeflow.llm.warc import archive_pages, read_archives, with_originals, with_shards, write_archives

SCHEMA = "page_id long, url string, html string, digest string"
BIG = "<p>" + "ü text " * 40


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def brute(rows):
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, p in payloads:
        same = [j for j, q in payloads if q == p and j is not None]
        first = min(same, default=None) if len(p) >= 100 and sum(q == p for _, q in payloads) > 1 else None
        revisit = first is not None and i != first
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


ROWS = [(5, "http://a/", BIG), (3, "http://b/é\r\nX: y", BIG), (9, None, BIG), (4, "u", None), (6, "u", ""), (7, "u", "short"), (8, "v", "short"), (None, "w", BIG), (10, "x", "\r\n\r\nWARC/1.1\r\n" * 20)]
ROWS += [(100 + i, f"http://h/{i}", f"page {i % 7} " * 30) for i in range(60)]


def rows(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_round_trip(spark):
    assert rows(archive_pages(pages(spark, ROWS).repartition(3), shard_bytes=8000, roll_bytes=2000)) == brute(ROWS)


def test_same_files_for_any_partitioning(spark, tmp_path):
    found = []
    for n in (1, 5):
        manifest = write_archives(pages(spark, ROWS).repartition(n), f"file://{tmp_path}/{n}", shard_bytes=8000, roll_bytes=2000)
        found.append(sorted((r["path"].rsplit("/", 1)[1], r["sha256"], r["bytes"]) for r in manifest.collect()))
    assert found[0] == found[1] and len({x.split("-")[1] for x, *_ in found[0]}) > 1 and any(not x.endswith("-00000.warc.gz") for x, *_ in found[0])
    assert not [p for p in (tmp_path / "1").glob(".*.warc.gz.*") if not p.name.endswith(".crc")]
    name = next(tmp_path.glob("1/*.warc.gz"))
    assert gzip.decompress(name.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_payloads_come_back(spark, tmp_path):
    manifest = write_archives(pages(spark, ROWS), f"file://{tmp_path}/w")
    got = {r["page_id"]: r["payload"] for r in read_archives(manifest, payload=True).collect() if r["record_type"] == "response"}
    assert bytes(got[3]).decode() == BIG and bytes(got[10]).decode() == ROWS[8][2] and bytes(got[4]) == b""


def test_empty_table(spark):
    assert archive_pages(pages(spark, ROWS).limit(0)).count() == 0


IDS = {
    "outlier": [*range(500), 10**15, -(10**15)],
    "no ids": [None] * 300 + list(range(200)),
    "one id": [7] * 300 + list(range(200)),
    "both ends": [-(2**63), 2**63 - 1, *range(-250, 250)],
}


@pytest.mark.parametrize("kind", IDS)
def test_shards_are_even_for_any_ids(spark, monkeypatch, kind):
    monkeypatch.setattr(warc, "CELLS", 64)
    made = [(i, f"http://h/{n}", f"page {n} " * 20) for n, i in enumerate(IDS[kind])]
    dealt, n, _ = with_shards(with_originals(pages(spark, made).repartition(3)), 50_000)
    held = {r["shard"]: (r["rows"], r["low"], r["high"]) for r in dealt.groupBy("shard").agg(warc.F.count("*").alias("rows"), warc.F.min(warc.F.coalesce("page_id", warc.F.lit(-(2**63)))).alias("low"), warc.F.max(warc.F.coalesce("page_id", warc.F.lit(-(2**63)))).alias("high")).collect()}
    assert n > 3 and sorted(held) == list(range(n)) and max(x for x, *_ in held.values()) < 2 * len(made) / n
    assert all(held[k][2] <= held[k + 1][1] for k in range(n - 1))
    assert rows(archive_pages(pages(spark, made), shard_bytes=50_000)) == brute(made)


def test_large_tables_have_large_shards(spark, monkeypatch):
    monkeypatch.setattr(warc, "MOST_SHARDS", 3)
    dealt, n, size = with_shards(with_originals(pages(spark, ROWS)), 1000)
    assert n <= 3 and size > 1000 and dealt.select("shard").distinct().count() == n


def test_files_are_read_by_many_tasks(spark, tmp_path):
    manifest = write_archives(pages(spark, ROWS), f"file://{tmp_path}/w", shard_bytes=4000, roll_bytes=800)
    files = manifest.count()
    assert files > 8 and read_archives(manifest).rdd.getNumPartitions() == files


def test_revisits_are_held_against_their_responses(spark):
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    rows = [(1, "u", "response", 200, "a", None), (None, "u", "response", 300, "b", None), (2, "u", "revisit", 200, "a", 1), (3, "u", "revisit", 200, "a", 1)]
    assert warc.verified(spark.createDataFrame(rows, schema)).count() == 4
    for wrong in ((4, "u", "revisit", 200, "b", 1), (4, "u", "revisit", 201, "a", 1), (4, "u", "revisit", 200, "a", 2), (4, "u", "revisit", 200, "a", None)):
        with pytest.raises(ValueError, match="revisit"):
            warc.verified(spark.createDataFrame([*rows, wrong], schema))

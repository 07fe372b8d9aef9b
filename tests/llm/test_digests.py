import hashlib

import numpy as np
import pytest

from tapeflow.llm import digests
from tapeflow.llm.digests import SPACINGS, BUCKETS, bucket_counts, difference, edited_digests, fingerprint, fingerprints, likeness, likeness_of

SCHEMA = "doc_id long, text string, fingerprint string, part int"


def plain_counts(data):
    """Buckets of all triplets, one by one."""
    counts = [0] * BUCKETS
    n = len(data)
    for at in range(n):
        for kind, (i, j) in enumerate(SPACINGS):
            h = data[at] | data[(at + i) % n] << 8 | data[(at + j) % n] << 16 | kind << 24
            h = h * 0x9E3779B1 % 2**32
            h ^= h >> 15
            counts[(h * 0x85EBCA77 % 2**32) >> 23] += 1
    return counts


@pytest.mark.parametrize("data", [b"", b"a", b"abc", b"a longer text, with words", bytes(range(256)) * 3, "Öß".encode() * 7])
def test_counts_equal_those_of_a_loop(data, monkeypatch):
    assert bucket_counts(data).tolist() == plain_counts(data)
    monkeypatch.setattr(digests, "BLOCK", 16)
    assert bucket_counts(data).tolist() == plain_counts(data)


def test_difference_is_bounded_and_zero_for_equals():
    rng = np.random.default_rng(0)
    texts = [b"", b"x", *(rng.integers(97, 123, n).astype(np.uint8).tobytes() for n in (3, 50, 4000, 4000))]
    prints = [fingerprint(t) for t in texts]
    for a in prints:
        for b in prints:
            assert 0 <= difference(a, b) == difference(b, a) <= 6 * BUCKETS + digests.STEP_WEIGHT * digests.MOST_STEPS
            assert 0 <= likeness(a, b) <= 1
            assert (likeness(a, b) == 1) == (a == b)
    assert len({len(p) for p in prints}) == 1
    assert likeness(prints[4], prints[5]) < 0.2


def brute(rows):
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (i, t) in enumerate(order):
        u = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + u[:half]
        a, b, c = (fingerprint(x.encode()) for x in (t, e, u))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c)))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_rows_equal_brute_force(spark, parts):
    rng = np.random.default_rng(1)
    words = ["über", "and", "the", "ñoño", "x", "字", "ends."]
    rows = [(int(i), " ".join(rng.choice(words, int(rng.integers(0, 60)))), "f", 7) for i in rng.permutation(40)]
    rows += [(40, None, "f", 1), (41, "", "f", 1), (42, "long " * 60_000, "f", 1), (43, rows[0][1], "f", 1), (None, "no key", "f", 1)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = edited_digests(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, found), key=lambda r: (r[0] is not None, r[0] or 0)) == brute(rows)


def test_one_row_no_row_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "one text", "", 0)], SCHEMA)
    assert [tuple(r) for r in edited_digests(docs).collect()] == brute([(1, "one text")])
    assert edited_digests(docs.limit(0)).collect() == []
    assert edited_digests(docs.limit(0)).columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    twice = edited_digests(docs.union(docs)).collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def test_columns_of_digests(spark):
    docs = spark.createDataFrame([(1, "a text", "", 0), (2, None, "", 0)], SCHEMA)
    found = {r["doc_id"]: r["fingerprint"] for r in fingerprints(docs).collect()}
    assert found == {1: fingerprint(b"a text"), 2: fingerprint(b"")}
    one = fingerprints(docs).withColumn("near", likeness_of("fingerprint", "fingerprint"))
    assert {r["near"] for r in one.collect()} == {1.0}

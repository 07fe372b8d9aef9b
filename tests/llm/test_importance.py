import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tapeflow.llm.importance import fit, grams, gumbel_key, keep_good, kth_largest, resample, weigh

SCHEMA = "doc_id long, text string, quality string"


def corpus():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(200)]
    rows, labels = [], []
    for i in range(400):
        own = list(rng.choice(words, 40))
        rows.append((i, " ".join(own) if i % 4 else "!! ".join(own) + "!!", "x"))
        labels.append((i, int(i % 4 > 0)))
    return rows, labels


def test_grams_keep_texts_apart():
    n, at = grams(["a b a", None, "", "c", "d d d"], 1024)
    assert n.tolist() == [5, 0, 0, 1, 5] and len(at) == 11
    assert at[0] == at[3] and at[7] == at[9] and at[8] == at[10]
    one, two = grams(["a b"], 1024)[1], grams(["x", "a b"], 1024)[1]
    assert one[:1].tolist() == two[1:2].tolist() and set(one) <= set(two)


def test_weights_equal_brute_force(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"), buckets=512)

    def buckets(text):
        h = [zlib.crc32(t.encode()) for t in re.findall(r"\w+|[^\w\s]+", text.lower())]
        mod = 1 << 64
        one = [(x * 0x9E3779B97F4A7C15 % mod >> 40) % 512 for x in h]
        two = [7 if a == b else ((a * 0xC2B2AE3D27D4EB4F % mod ^ b * 0x165667B19E3779F9 % mod) >> 40) % 512 for a, b in zip(h, h[1:])]
        return one + two

    raw, target = np.ones(512), np.ones(512)
    for (_, text, _), (_, q) in zip(rows, labels):
        for b in buckets(text):
            raw[b] += 1
            target[b] += q
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for r in weigh(docs, model).collect():
        assert math.isclose(r["log_weight"], sum(ratio[b] for b in buckets(rows[r["doc_id"]][1])), abs_tol=1e-9)


def test_keeps_good_rows_only_and_samples_top_keys(spark):
    rows, labels = corpus()
    rows += [(900, None, "x"), (901, "", None), (902, rows[1][1], "x"), (902, rows[1][1], "x")]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    kept = keep_good(docs, marks)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.collect()) == sorted([i for i, q in labels if q] + [902, 902])
    found = resample(docs, marks, share=0.25).collect()
    assert len(found) == 302
    drawn = keep_good(docs, marks, share=0.25)
    assert drawn.columns == docs.columns and sorted(r[0] for r in drawn.collect()) == sorted(r["doc_id"] for r in found if r["sampled"])
    keys = sorted((r["gumbel_key"] for r in found), reverse=True)
    assert {r["gumbel_key"] for r in found if r["sampled"]} == {x for x in keys if x >= keys[round(0.25 * 302) - 1]}


def test_kth_largest(spark):
    values = [float(x % 977) for x in range(30_000)] + [5.0] * 20_000
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    order = sorted(values, reverse=True)
    for k in (1, 2, 15_000, 40_000, 50_000):
        assert kth_largest(df, "v", k, enough=100) == order[k - 1]
    assert kth_largest(df.limit(0), "v", 1) is None


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "x")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["doc_id"] for r in keep_good(docs, none).collect()] == [1]
    assert resample(docs.limit(0), none).count() == 0


def test_gumbel_noise_is_fixed_by_key_and_seed(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(0.0).alias("log_weight"))
    a, b = (sorted(r[0] for r in df.repartition(n).select(gumbel_key()).collect()) for n in (1, 5))
    assert a == b and abs(np.mean(a) - 0.5772) < 0.1


def test_rows_without_a_key_share_one_noise(spark):
    """Of rows without a key those of the highest weights are drawn; keyed rows by their own noise."""
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, *[(None, " ".join(t.split()[: 5 + i]), "x") for i, (_, t, _) in enumerate(rows[1:60])]], SCHEMA)
    found = resample(docs, spark.createDataFrame(labels, "doc_id long, quality int"), 0.5).collect()
    unnamed = [r for r in found if r["doc_id"] is None]
    assert len({round(r["gumbel_key"] - r["log_weight"], 6) for r in unnamed}) == 1 < len({round(r["gumbel_key"] - r["log_weight"], 6) for r in found})
    drawn, left = [r["log_weight"] for r in unnamed if r["sampled"]], [r["log_weight"] for r in unnamed if not r["sampled"]]
    assert not drawn or not left or min(drawn) >= max(left)
    assert sum(r["sampled"] for r in found) >= round(0.5 * len(found))

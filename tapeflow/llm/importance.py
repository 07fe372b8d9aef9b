"""Quality by importance resampling: two hashed n-gram models, one of target texts and one of all (raw) texts.

A text's log importance weight is the sum over its tokens and token pairs of log(p_target / p_raw), both taken over
hashed buckets.  Rows whose mean ratio falls short of a limit, set on labelled rows, are no candidates; the others are
sampled without replacement in proportion to their weights by Gumbel top-k.  The raw model counts every row; the target
model and the limit come from a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, portions, stored, text_slices, worker_cache

#: Labelled documents of each label that the target model and the limit are fitted to, those whose key hashes lowest.
MOST_LABELLED = 8000
BUCKETS = 16_384
#: Share of good labelled rows that the limit may cost at most.
MOST_LOST = 0.001
_TOKENS = re.compile(r"\w+|[^\w\s]+")


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return found


def grams(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of n-grams of each text, and the bucket of each token, then of each pair within a text, in text order.

    Pairs of a token with itself share one bucket, so that mere repetition is a feature.
    """
    tokens = [_TOKENS.findall(t.lower()) if t else [] for t in texts]
    n = np.array([len(x) for x in tokens], np.int64)
    hashes = worker_cache("importance", _Hashes)
    h = np.fromiter((hashes[x] for own in tokens for x in own), np.uint64, int(n.sum()))
    one = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    second = np.zeros(len(h), bool)
    second[1:] = True
    second[(np.cumsum(n) - n)[n > 0]] = False
    before = np.roll(h, 1)
    two = np.where(before == h, np.uint64(7), (before * np.uint64(0xC2B2AE3D27D4EB4F) ^ (h * np.uint64(0x165667B19E3779F9))) >> np.uint64(40))
    both = np.stack([one, two], 1) % np.uint64(buckets)
    keep = np.stack([np.ones(len(h), bool), second], 1)
    return np.maximum(2 * n - 1, 0), both[keep].astype(np.int64)


def bucket_counts(docs: DataFrame, text: str, buckets: int) -> np.ndarray:
    """Counts of all rows' n-grams; a task sends each bucket once."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in text_slices(batches, "text"):
            total += np.bincount(grams(batch.column(0).to_pylist(), buckets)[1], minlength=buckets)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_pydict({"bucket": at, "n": total[at]})

    counts = np.zeros(buckets, np.int64)
    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n"))
    for bucket, n in found.collect():
        counts[bucket] = n
    return counts


class Model:
    """Log ratios of the buckets and the least mean ratio of a candidate."""

    def __init__(self, ratio: np.ndarray, limit: float):
        self.ratio, self.limit = ratio, limit

    def weights(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of n-grams and log importance weight of each text."""
        n, at = grams(texts, len(self.ratio))
        out = np.zeros(len(n))
        full = n > 0
        if full.any():
            out[full] = np.add.reduceat(self.ratio[at], (np.cumsum(n) - n)[full])
        return n, out


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, buckets: int = BUCKETS, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model from all rows of docs and at most `most` labelled rows of each label.

    Without good labelled rows every ratio is 0, and without bad ones there is no limit.
    """
    ids = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label")).where("_key IS NOT NULL AND label IN (0, 1)").distinct()
    parts = [ids.where(F.col("label") == v).orderBy(F.xxhash64("_key"), "_key").limit(most) for v in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * most rows
    sample = stored(docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(chosen, "_key").select("label", "text"), "quality-sample")
    raw = bucket_counts(docs, text, buckets)
    target = bucket_counts(sample.where("label = 1"), "text", buckets)
    share = lambda x: (x + 1) / (x.sum() + buckets)
    ratio = np.log(share(target)) - np.log(share(raw)) if target.any() else np.zeros(buckets)
    scored = weigh(sample, Model(ratio, -np.inf), "label", "text").where("n_grams > 0").select("doc_id", (F.col("log_weight") / F.col("n_grams")).alias("mean"))
    rows = scored.collect()  # numbers of the bounded sample
    good = np.sort([r["mean"] for r in rows if r["doc_id"] == 1])
    bad = np.sort([r["mean"] for r in rows if r["doc_id"] == 0])
    if not len(good) or not len(bad):
        return Model(ratio, -np.inf)
    # The limit that tells the labels apart best, if it costs no more good rows than allowed; half way between two rows.
    cuts = np.unique(np.concatenate([good[: int(len(good) * MOST_LOST) + 1], bad[bad <= good[int(len(good) * MOST_LOST)]]]))
    if len(cuts) < 2:
        return Model(ratio, -np.inf)
    middle = (cuts[1:] + cuts[:-1]) / 2
    gain = np.searchsorted(bad, middle) / len(bad) - np.searchsorted(good, middle) / len(good)
    return Model(ratio, float(middle[np.argmax(gain)]))


def weigh(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id (from key), n_grams, log_weight of every row; null and empty texts have neither n-grams nor weight."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch):
        n, weight = held.value.weights(batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "n_grams": n, "log_weight": weight}

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return mapped(rows, "text", make, "doc_id long,n_grams long,log_weight double", most=1_000_000)


def is_candidate(model: Model):
    """Of weigh's rows: the mean ratio reaches the limit; rows without n-grams are none."""
    return (F.col("n_grams") > 0) & (F.col("log_weight") >= F.lit(model.limit) * F.col("n_grams"))


def gumbel_key(key: str = "doc_id", seed: int = 0):
    """log weight plus Gumbel noise that depends on the key and the seed alone."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.col("log_weight") - F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int, enough: int = 10_000) -> float | None:
    """The k-th largest value of a column by ever finer histograms; only counts and `enough` values reach the driver."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k <= 0 or k > n:
        return None if not n or k > n else float("inf")
    above = 0  # rows over high
    while n > enough and low < high:
        width = (high - low) / 4096
        at = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(4095))
        inside = df.where(F.col(column).between(F.lit(low), F.lit(high)))
        bins = sorted(inside.groupBy(at.alias("at")).agg(F.count("*"), F.min(column), F.max(column)).collect(), reverse=True)
        for _, size, least, most in bins:
            if above + size >= k:
                low, high, n = least, most, size
                break
            above += size
        if width == 0:
            break
    if low == high:
        return low
    return df.where(F.col(column).between(F.lit(low), F.lit(high))).orderBy(F.desc(column)).limit(k - above).agg(F.min(column)).first()[0]


def resample(docs: DataFrame, labels: DataFrame, share: float = 0.5, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Candidates: key, n_grams, log_weight, gumbel_key, sampled (among the share of candidates of the highest keys).

    Rows that fall short of the limit, null and empty texts among them, are left out.  Equal keys at the k-th place are
    all sampled, so repeated rows fare alike; rows without a key share one noise, so their weights alone order them.
    """
    model = fit(docs, labels, key=key, text=text)
    weighed = weigh(docs, model, key, text)
    rows = stored(weighed.where(is_candidate(model)).withColumn("gumbel_key", gumbel_key(seed=seed)), "importance")
    k = round(share * rows.count())
    least = kth_largest(rows, "gumbel_key", k)
    return rows.withColumn("sampled", F.col("gumbel_key") >= F.lit(float("inf") if least is None else least)).withColumnRenamed("doc_id", key)


def keep_good(docs: DataFrame, labels: DataFrame, share: float = 1.0, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that resample draws, as they are: same columns, texts whole.

    With a share of 1 the draw takes every candidate, so no Gumbel keys are needed and nothing is shuffled; with less, rows
    without a key are judged by the same noise.  Equal keys at the k-th place all stay.
    """
    model = fit(docs, labels, key=key, text=text)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def weight_of(texts):
        import pandas as pd

        model, out = held.value, []
        for some in portions(texts):
            n, weight = model.weights(some)
            out += list(np.where((n > 0) & (weight >= model.limit * n), weight, np.nan))
        return pd.Series(out, dtype=float)

    weight = weight_of(F.col(text))  # null for rows that are no candidates
    if share >= 1:
        return docs.where(weight.isNotNull())
    noise = gumbel_key(key, seed) - F.col("log_weight")
    drawn = docs.select(F.struct("*").alias("row"), F.col(key), weight.alias("log_weight")).where("log_weight IS NOT NULL")
    drawn = stored(drawn.withColumn("gumbel_key", F.col("log_weight") + noise), "quality-drawn")
    least = kth_largest(drawn, "gumbel_key", round(share * drawn.count()))
    return drawn.where(F.col("gumbel_key") >= F.lit(float("inf") if least is None else least)).select("row.*")

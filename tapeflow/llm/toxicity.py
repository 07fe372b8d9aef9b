"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals give document scores and offsets.

Labels mark documents, so tokens get theirs first: a word or word beginning that stands in many labelled toxic documents
and in hardly any clean one marks its tokens as toxic.  The field (two states, features: word and its first 3 to 8
letters) is fitted to these labelled tokens.  In every document, which is one chain, forward-backward gives each word's probability to be toxic; a document's score is a logistic function of the largest log odds, the
expected number of toxic words and the number of words, and neighbouring words over one half are its offending spans.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, portions, stored, text_slices, worker_cache

#: Labelled documents that a model is fitted to, at most so many of each label (those whose key hashes lowest).
MOST_LABELLED = 3000
#: Words of a piece of a chain: pieces run side by side, and what one hands to the next is carried between them.
SEGMENT = 64
#: A feature marks toxic tokens if it has this many toxic documents and this share of toxic ones, classes weighted alike.
LEAST_DOCS, LEAST_SHARE = 5, 0.9
#: Ridge of the field.
RIDGE = 0.5
_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_WORDS = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).translate(_BYTES).split() if text else []


def features(word: bytes) -> list[bytes]:
    """The word, marked by its end, and its first 3 to 8 letters."""
    letters = word.decode("utf-8", "replace")
    return [word + b"$", *(letters[:n].encode() for n in range(3, 9) if len(letters) >= n)]


def _signature(words: list[bytes]) -> int:
    """Near copies mostly share it: the least hash of five words in a row."""
    return min((zlib.crc32(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0)


def chains(lengths: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(runs x SEGMENT) of scores, a mask, and the run and place of every token; no run crosses a text's end."""
    offset = np.arange(len(scores)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    runs = -(-lengths // SEGMENT)
    run = np.repeat(np.cumsum(runs) - runs, lengths) + offset // SEGMENT
    place = offset % SEGMENT
    grid, mask = np.zeros((int(runs.sum()), SEGMENT)), np.zeros((int(runs.sum()), SEGMENT), bool)
    grid[run, place], mask[run, place] = scores, True
    return grid, mask, (run, place)


def forward_backward(grid: np.ndarray, mask: np.ndarray, start: float, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of the toxic state at each place, sums of pair marginals, and log Z.

    grid: score of toxic over clean; start: the same for the first place; trans[i, j]: score of going from i to j.
    """
    n, length = grid.shape
    a, b = np.zeros((length, 2, n)), np.zeros((length, 2, n))
    a[0, 1] = grid[:, 0] + start
    for t in range(1, length):
        live = mask[:, t]
        for j in (0, 1):
            new = np.logaddexp(a[t - 1, 0] + trans[0, j], a[t - 1, 1] + trans[1, j]) + j * grid[:, t]
            a[t, j] = np.where(live, new, a[t - 1, j])
    for t in range(length - 2, -1, -1):
        live = mask[:, t + 1]
        for i in (0, 1):
            new = np.logaddexp(trans[i, 0] + b[t + 1, 0], trans[i, 1] + grid[:, t + 1] + b[t + 1, 1])
            b[t, i] = np.where(live, new, b[t + 1, i])
    log_z = np.logaddexp(a[-1, 0], a[-1, 1])
    pairs = np.zeros((2, 2))
    for t in range(1, length):
        live = mask[:, t]
        for i in (0, 1):
            for j in (0, 1):
                pairs[i, j] += np.exp(a[t - 1, i] + trans[i, j] + j * grid[:, t] + b[t, j] - log_z)[live].sum()
    return (a[:, 1] + b[:, 1] - a[:, 0] - b[:, 0]).T, pairs, log_z


def carried(grid: np.ndarray, mask: np.ndarray, owner: np.ndarray, start: float, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What log_odds needs of the pieces around each: log odds before its first place, and of all after its last one.

    owner: the text of each piece.  A piece acts on the two states' weights as a matrix, made for all pieces at once; then
    one vector goes along each text, forth and back.
    """
    before, after = np.full(len(grid), float(start)), np.zeros(len(grid))
    joined = owner[1:] == owner[:-1]
    long = np.nonzero(np.append(joined, False) | np.append(False, joined))[0]
    if not len(long):
        return before, after
    step = np.exp(trans - trans.max())
    up, down = np.exp(np.minimum(grid[long], 0)), np.exp(-np.maximum(grid[long], 0))
    c = np.zeros((len(long), 2, 2))
    c[:, 0, 0], c[:, 1, 1] = down[:, 0], up[:, 0]
    for t in range(1, grid.shape[1]):
        new = (c.reshape(-1, 2) @ step).reshape(c.shape)
        new[:, :, 0] *= down[:, t, None]
        new[:, :, 1] *= up[:, t, None]
        new /= new.max(axis=(1, 2), keepdims=True)
        c = np.where(mask[long, t, None, None], new, c)
    forth, back = (c @ step).tolist(), (step @ c).tolist()
    odds = lambda v: float(np.log(v[1]) - np.log(v[0]))
    first = [min(1.0, np.exp(-start)), min(1.0, np.exp(start))]
    own, v = owner[long].tolist(), first
    for k in range(1, len(own)):
        if own[k] == own[k - 1]:
            m = forth[k - 1]
            v = [v[0] * m[0][0] + v[1] * m[1][0], v[0] * m[0][1] + v[1] * m[1][1]]
            v = [v[0] / (v[0] + v[1]), v[1] / (v[0] + v[1])]
            before[long[k]] = odds(v)
        else:
            v = first
    v = [1.0, 1.0]
    for k in range(len(own) - 2, -1, -1):
        if own[k] == own[k + 1]:
            m = back[k + 1]
            v = [m[0][0] * v[0] + m[0][1] * v[1], m[1][0] * v[0] + m[1][1] * v[1]]
            v = [v[0] / (v[0] + v[1]), v[1] / (v[0] + v[1])]
            after[long[k]] = odds(v)
        else:
            v = [1.0, 1.0]
    return before, after


def log_odds(grid: np.ndarray, mask: np.ndarray, start: float | np.ndarray, trans: np.ndarray, after: float | np.ndarray = 0.0) -> np.ndarray:
    """forward_backward's first result, by recursion on log odds alone: two terms for each place and direction.

    start, after: log odds that each run begins with, and those of what follows its last place if it is full.
    """
    ratio = lambda x, to: np.logaddexp(trans[0, to], x + trans[1, to])
    f, b = np.zeros(grid.shape), np.zeros(grid.shape)
    f[:, 0] = grid[:, 0] + start
    b[:, -1] = after
    for t in range(1, grid.shape[1]):
        f[:, t] = grid[:, t] + ratio(f[:, t - 1], 1) - ratio(f[:, t - 1], 0)
    for t in range(grid.shape[1] - 2, -1, -1):
        x = grid[:, t + 1] + b[:, t + 1]
        b[:, t] = np.where(mask[:, t + 1], np.logaddexp(trans[1, 0], trans[1, 1] + x) - np.logaddexp(trans[0, 0], trans[0, 1] + x), 0)
    return f + b


class Field:
    """Weights of the field and of the document score; scores of words are cached in the worker."""

    def __init__(self, weights: dict[bytes, float], bias: float, start: float, trans: np.ndarray, final: np.ndarray):
        self.weights, self.bias, self.start, self.trans, self.final = weights, bias, start, trans, final
        self.name = f"toxicity-{uuid.uuid4().hex}"

    def score(self, word: bytes) -> float:
        known = worker_cache(self.name, dict)
        if len(known) > 200_000:
            known.clear()
        found = known[word] = self.bias + sum(self.weights.get(f, 0.0) for f in features(word))
        return found

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of words of each text, log odds of every word."""
        words = [words_of(t) for t in texts]
        known, score = worker_cache(self.name, dict).get, self.score
        lengths = np.array([len(w) for w in words], np.int64)
        scores = np.fromiter((s if (s := known(w)) is not None else score(w) for own in words for w in own), float, int(lengths.sum()))
        grid, mask, at = chains(lengths, scores)
        if not len(scores):
            return lengths, scores
        before, after = carried(grid, mask, np.repeat(np.arange(len(texts)), -(-lengths // SEGMENT)), self.start, self.trans)
        return lengths, log_odds(grid, mask, before, self.trans, after)[at]

    def summary(self, lengths: np.ndarray, odds: np.ndarray) -> np.ndarray:
        """(texts x 4): 1, the largest log odds, logs of one more than the expected toxic words and the words."""
        out = np.stack([np.ones(len(lengths)), np.full(len(lengths), -12.0), np.zeros(len(lengths)), np.log1p(lengths)], 1)
        full = np.nonzero(lengths)[0]
        if len(full):
            begin = (np.cumsum(lengths) - lengths)[full]
            out[full, 1] = np.clip(np.maximum.reduceat(odds, begin), -12, 12)
            out[full, 2] = np.log1p(np.add.reduceat(1 / (1 + np.exp(-np.clip(odds, -30, 30))), begin))
        return out

    def documents(self, summary: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary @ self.final, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, key: str, text: str, label: str) -> DataFrame:
    """label, text of at most `most` documents for each label, chosen by hash of the key among all labelled rows.

    Of documents whose texts are near copies one stays, else a word of a copied text would look frequent.
    """
    ids = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label")).where("_key IS NOT NULL AND label IN (0, 1)").distinct()
    parts = [ids.where(F.col("label") == v).orderBy(F.xxhash64("_key"), "_key").limit(most) for v in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * most rows
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(chosen, "_key").select("label", "text")

    def make(batch):
        texts = batch.column("text").to_pylist()
        return {"label": batch.column("label"), "text": texts, "sign": [_signature(words_of(t)) for t in texts]}

    return mapped(rows, "text", make, "label int,text string,sign long").groupBy("label", "sign").agg(F.min("text").alias("text"))


def feature_counts(sample: DataFrame) -> DataFrame:
    """feature, clean, toxic: documents of each label that hold the feature, for features of LEAST_DOCS documents."""

    def run(batches):
        import pyarrow as pa

        for batch in text_slices(batches, "text", 2_000_000):
            counts: dict[bytes, list[int]] = {}
            for m, t in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for f in {f for w in set(words_of(t)) for f in features(w)}:
                    counts.setdefault(f, [0, 0])[m] += 1
            yield pa.RecordBatch.from_pydict({"feature": list(counts), "clean": [c for c, _ in counts.values()], "toxic": [t for _, t in counts.values()]}, schema=pa.schema([("feature", pa.binary()), ("clean", pa.int64()), ("toxic", pa.int64())]))

    found = sample.select("label", "text").mapInArrow(run, "feature binary, clean long, toxic long")
    return found.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= LEAST_DOCS)


def training_runs(sample: DataFrame, toxic: set[bytes], used: dict[bytes, int], length: int) -> DataFrame:
    """h, places, features, hits of runs of `length` words: those with toxic tokens, and one of each document.

    places and features list the numbered features of a run's words; hits are the places of toxic tokens, and size is
    the run's number of words.
    """
    held = sample.sparkSession.sparkContext.broadcast((toxic, used))

    def run(batches):
        import pyarrow as pa

        kind = pa.schema([("h", pa.int64()), ("size", pa.int32()), *[(c, pa.list_(pa.int32())) for c in ("places", "features", "hits")]])
        toxic, used = held.value
        for batch in text_slices(batches, "text", 2_000_000):
            out = []
            for m, t in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(t)
                pick = zlib.crc32(b" ".join(words[:8])) % max(1, -(-len(words) // length)) * length
                for i in range(0, len(words), length):
                    own = [features(w) for w in words[i : i + length]]
                    hits = [k for k, fs in enumerate(own) if m == 1 and any(f in toxic for f in fs)]
                    if hits or i == pick:
                        pairs = [(k, used[f]) for k, fs in enumerate(own) for f in fs if f in used]
                        out.append({"h": zlib.crc32(b" ".join(words[i : i + length])), "size": len(own), "places": [k for k, _ in pairs], "features": [f for _, f in pairs], "hits": hits})
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return sample.select("label", "text").mapInArrow(run, "h long, size int, places array<int>, features array<int>, hits array<int>")


def summaries(sample: DataFrame, field: Field) -> tuple[np.ndarray, np.ndarray]:
    """The field's summary and the label of every row of a bounded sample."""
    held = sample.sparkSession.sparkContext.broadcast(field)

    def make(batch):
        field = held.value
        rows = field.summary(*field.tokens(batch.column("text").to_pylist()))
        return {"label": batch.column("label"), "text": [None] * len(rows), **{f"x{i}": rows[:, i] for i in range(rows.shape[1])}}

    found = mapped(sample.select("label", "text"), "text", make, "label int,text string,x0 double,x1 double,x2 double,x3 double", most=1_000_000).drop("text").orderBy("label", "x1", "x2", "x3").collect()
    return np.array([[r[f"x{i}"] for i in range(4)] for r in found]), np.array([r["label"] for r in found])


#: Runs of words that the field is fitted to at most, those whose words hash lowest.
MOST_RUNS, RUN = 12_000, 16


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, key: str = "doc_id", text: str = "text", label: str = "toxic", most_runs: int = MOST_RUNS) -> Field:
    """A field fitted to at most `most` labelled documents of each label and `most_runs` runs; near copies count once.

    Texts stay in the tasks: what reaches the driver are feature counts, most_runs runs and a row for each document.
    """
    sample = stored(labelled_sample(docs, labels, most, key, text, label).where(F.col("text").isNotNull()), "toxicity-sample")
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:  # nothing to tell apart: the share of toxic rows, for every text
        share = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
        return Field({}, -20.0, 0.0, np.zeros((2, 2)), np.array([np.log(share / (1 - share)), 0.0, 0.0, 0.0]))
    counts = feature_counts(sample).collect()
    toxic = {bytes(f) for f, c, t in counts if t >= LEAST_DOCS and t / n[1] >= LEAST_SHARE * (t / n[1] + c / n[0])}
    used = {f: i for i, f in enumerate(sorted(bytes(r["feature"]) for r in counts))}
    del counts
    runs = training_runs(sample, toxic, used, RUN).orderBy("h", "places", "features").limit(most_runs).collect()
    weight, bias, start, trans = _fit_chain(runs, len(used))
    found = Field({f: float(weight[i]) for f, i in used.items() if abs(weight[i]) > 1e-3}, float(bias), float(start), trans, np.zeros(4))
    found.final = _logistic(*summaries(sample, found))
    return found


def _fit_chain(runs: list, size: int, rounds: int = 80):
    """Maximum likelihood with a small ridge by resilient steps: weights, bias, start and transitions."""
    y, mask = np.zeros((len(runs), RUN), bool), np.zeros((len(runs), RUN), bool)
    for k, r in enumerate(runs):
        y[k, r["hits"]], mask[k, : r["size"]] = True, True
    grid_of = np.concatenate([k * RUN + np.array(r["places"], np.int64) for k, r in enumerate(runs)] or [np.zeros(0, np.int64)])
    feat_of = np.concatenate([np.array(r["features"], np.int64) for r in runs] or [np.zeros(0, np.int64)])
    p = np.zeros(size + 6)
    p[size] = -4.0
    pair_seen = np.array([[(mask[:, 1:] & (y[:, :-1] == i) & (y[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)])
    step, old = np.full(len(p), 0.1), np.zeros(len(p))
    for _ in range(rounds):
        emit = np.bincount(grid_of, p[feat_of], minlength=mask.size).reshape(mask.shape) + p[size]
        odds, pairs, _ = forward_backward(emit, mask, p[size + 1], p[size + 2 :].reshape(2, 2))
        miss = np.where(mask, y - 1 / (1 + np.exp(-np.clip(odds, -30, 30))), 0.0)
        slope = np.concatenate([np.bincount(feat_of, miss.ravel()[grid_of], minlength=size), [miss.sum(), miss[:, 0].sum()], (pair_seen - pairs).ravel()]) - RIDGE * p
        same = np.sign(slope) * np.sign(old)
        step = np.clip(np.where(same > 0, step * 1.2, np.where(same < 0, step * 0.5, step)), 1e-4, 1.0)
        p += np.sign(slope) * step * (same >= 0)
        old = np.where(same < 0, 0.0, slope)
    return p[:size], p[size], p[size + 1], p[size + 2 :].reshape(2, 2)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x.T * (q * (1 - q))) @ x + 0.1 * np.eye(len(w)), x.T @ (y - q) - 0.1 * w)
    return w


def score_documents(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, n_toxic_words, starts, ends (of the offending spans, in code points) for every row.

    Null and empty texts have no words and get the score of a text without any sign.  Nothing is shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)

    def make(batch):
        field = held.value
        texts = batch.column("text").to_pylist()
        lengths, odds = field.tokens(texts)
        score = field.documents(field.summary(lengths, odds))
        begin = np.cumsum(lengths) - lengths
        n, starts, ends = np.zeros(len(texts), np.int64), [[] for _ in texts], [[] for _ in texts]
        hot = np.nonzero(odds > 0)[0]
        owner = np.searchsorted(begin + lengths, hot, side="right")
        for d in np.unique(owner):
            at = hot[owner == d] - begin[d]
            n[d] = len(at)
            spans = [m.span() for m in _WORDS.finditer(texts[d])]
            for i, t in enumerate(at):
                if i and at[i - 1] == t - 1:
                    ends[d][-1] = spans[t][1]
                else:
                    starts[d].append(spans[t][0])
                    ends[d].append(spans[t][1])
        return {"doc_id": batch.column("doc_id"), "score": score, "n_toxic_words": n, "starts": starts, "ends": ends}

    rows = docs.selectExpr(f"`{key}` AS doc_id", f"`{text}` AS text")
    found = mapped(rows, "text", make, "doc_id long,score double,n_toxic_words long,starts array<int>,ends array<int>", most=1_000_000)
    return found.withColumnRenamed("doc_id", key)


def held_out(key: str = "doc_id", folds: int = 3, fold: int = 1):
    """Whether a row is out of the training rows: crc32 of its key as text, modulo folds; null keys are in."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(folds)) == fold, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, key: str = "doc_id") -> DataFrame:
    """key, held_out, score, predicted (score >= threshold), n_toxic_words, starts, ends of every row."""
    field = fit(docs, labels.where(~held_out(key)), key=key)
    found = score_documents(docs, field, key)
    return found.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_toxic_words", "starts", "ends")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose score stays under threshold: same columns, texts whole; nothing is shuffled.

    The field is fitted to the labelled rows among docs that are not held out; null and empty texts stay.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels.where(~held_out(key)), key=key, text=text))

    @F.pandas_udf("boolean")
    def clean(texts):
        import pandas as pd

        field, out = held.value, []
        for some in portions(texts):
            out += list(field.documents(field.summary(*field.tokens(some))) < threshold)
        return pd.Series(out, dtype=bool)

    return docs.where(clean(F.col(text)))

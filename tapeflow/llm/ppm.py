"""Language-model scoring by prediction by partial matching over bytes, with a word-unigram base beside it.

The model is a trie of byte contexts up to ORDER bytes, held as the counts of all runs of up to ORDER + 1 bytes in the
training texts.  A byte is coded in the longest context that has seen it.  Each longer context that was seen costs an
escape, estimated as half its distinct symbols over its total (the other halves leave the symbols' own counts), and the
symbols of the context escaped from are excluded from the shorter one's totals.  Below order 0 the bytes never seen are
equally likely.  A text ends with the byte FF, which UTF-8 never uses and which also stands before each text.

Counts are made in tasks and summed by Spark.  What a byte costs follows from the run of ORDER + 1 bytes that ends at it, so
every text adds up the costs of its runs: those of the most frequent runs go to every task, all others are joined.  Costs
are made in groups of runs whose contexts end alike, each from all counts that they depend on.  A cost is a whole number of
units of 2^-26, so that a text's score is a sum of integers, the same in any order and however the costs came to its task.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, stored, text_slices, worker_cache

ORDER = 5
#: Byte runs whose costs go to every task, the most frequent ones; all others are looked up by a join.
MOST_NODES = 3_000_000
#: Bytes at the end of a context that runs are dealt to groups by, and groups at least; there is one for each GROUP_RUNS runs.
ENDING = 3
GROUPS, GROUP_RUNS = 1024, 10_000
#: Costs are whole numbers of these units.
UNIT = 2.0**-26
#: Words whose counts go to every task, the most frequent ones; all others are looked up by a join.
HEAD_WORDS = 200_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The run of ORDER + 1 bytes that ends at each byte of a padded buffer; where texts begin, and their ends come."""
    pad = b"\xff" * ORDER
    data = np.frombuffer(pad + pad.join(texts) + pad, np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(np.append(0, lengths[:-1] + ORDER))
    gram = np.zeros(len(data) - ORDER, np.uint64)
    for j in range(ORDER + 1):
        gram <<= np.uint64(8)
        gram |= data[j : len(gram) + j]
    return gram, begin, begin + lengths


def coded(begin: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Which places are coded: a text's bytes and one end."""
    step = np.zeros(size + 1, np.int8)
    np.add.at(step, begin, 1)
    np.add.at(step, end + 1, -1)
    return np.cumsum(step[:-1]).astype(bool)


def training_counts(docs: DataFrame) -> DataFrame:
    """word, gram, n: occurrences of words (the empty word: a text's end) and of byte runs (word is null)."""
    schema = pa.schema([("word", pa.binary()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches):
        words: Counter = Counter()
        grams, held = [], 0

        def flush():
            nonlocal grams, held
            if words:
                for i in range(0, len(words), 50_000):
                    part = list(words.items())[i : i + 50_000]
                    yield pa.RecordBatch.from_pydict({"word": [w for w, _ in part], "gram": [None] * len(part), "n": [n for _, n in part]}, schema=schema)
                words.clear()
            if grams:
                every, counts = _summed(grams)
                for i in range(0, len(every), 200_000):
                    size = len(every[i : i + 200_000])
                    yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.binary()), pa.array(every[i : i + size].view(np.int64)), pa.array(counts[i : i + size])], schema=schema)
                grams, held = [], 0

        for batch in text_slices(batches, "text", 2_000_000):
            texts = [lowered(t) for t in batch.column(0).to_pylist()]
            for t in texts:
                words.update(t.split())
            words[b""] += len(texts)
            gram, begin, end = runs(texts)
            grams.append(np.unique(gram[coded(begin, end, len(gram))], return_counts=True))
            held += len(grams[-1][0])
            if held > 3_000_000:
                grams = [_summed(grams)]
                held = len(grams[0][0])
            if len(words) > 500_000 or held > 2_500_000:
                yield from flush()
        yield from flush()

    found = docs.select("text").mapInArrow(run, "word binary, gram long, n long")
    return found.groupBy("word", "gram").agg(F.sum("n").alias("n"))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.nonzero(np.append(True, key[1:] != key[:-1]))[0] if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


class Trie:
    """grams[m], counts[m]: sorted runs of m + 1 bytes and their occurrences (context of m bytes, then the symbol)."""

    def __init__(self, grams: list[np.ndarray], counts: list[np.ndarray]):
        self.grams, self.counts = grams, counts
        self.contexts, self.total, self.kinds, self.below = [], [], [], []
        for m in range(ORDER + 1):
            context = grams[m] >> np.uint64(8)
            first = np.nonzero(np.append(True, context[1:] != context[:-1]))[0] if len(context) else np.zeros(0, np.int64)
            self.contexts.append(context[first])
            self.total.append(np.add.reduceat(counts[m], first).astype(float) if len(first) else np.zeros(0))
            self.kinds.append(np.diff(np.append(first, len(context))).astype(float))
            if m and len(first):  # what this context's symbols count for in the next shorter one
                shorter = np.searchsorted(grams[m - 1], grams[m] & np.uint64((1 << 8 * m) - 1))
                self.below.append(np.add.reduceat(counts[m - 1][shorter], first).astype(float))
            else:
                self.below.append(np.zeros(len(first)))

    def cost(self, gram: np.ndarray) -> np.ndarray:
        """-log10 of the probability of each run's last byte after the bytes before it."""
        out, live = np.zeros(len(gram)), np.ones(len(gram), bool)
        gone_total, gone_kinds = np.zeros(len(gram)), np.zeros(len(gram))
        for m in range(ORDER, -1, -1):
            if not len(self.contexts[m]):
                continue
            if not live.any():
                break
            own = gram & np.uint64((1 << 8 * (m + 1)) - 1)
            i = np.minimum(np.searchsorted(self.contexts[m], own >> np.uint64(8)), len(self.contexts[m]) - 1)
            seen = live & (self.contexts[m][i] == own >> np.uint64(8))
            total, kinds = self.total[m][i] - gone_total, self.kinds[m][i] - gone_kinds
            k = np.minimum(np.searchsorted(self.grams[m], own), len(self.grams[m]) - 1)
            found = seen & (self.grams[m][k] == own)
            escape = seen & ~found & (kinds > 0)
            out[found] += np.log10(total[found]) - np.log10(self.counts[m][k][found] - 0.5)
            out[escape] += np.log10(2 * total[escape]) - np.log10(kinds[escape])
            live &= ~found
            gone_total, gone_kinds = np.where(seen, self.below[m][i], gone_total), np.where(seen, self.kinds[m][i], gone_kinds)
        out[live] += np.log10(np.maximum(256 - gone_kinds[live], 1))
        return out

    def table(self) -> tuple[np.ndarray, np.ndarray, np.uint64]:
        """Costs of the longest runs as a hash table."""
        return hashed(self.grams[ORDER], self.cost(self.grams[ORDER]))


def hashed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """An open-addressing hash table of distinct keys: keys, values, shift."""
    bits = max(4, int(len(keys) * 2).bit_length())
    slots, costs = np.full(1 << bits, _EMPTY), np.zeros(1 << bits, values.dtype)
    shift = np.uint64(64 - bits)
    at, left = (keys * _SPREAD) >> shift, np.arange(len(keys))
    while len(left):
        place = at[left]
        free = slots[place] == _EMPTY
        slots[place[free]] = keys[left[free]]  # of those that meet in a slot the last one stays
        put = slots[place] == keys[left]
        costs[place[put]] = values[left[put]]
        left = left[~put]
        at[left] = (at[left] + np.uint64(1)) & np.uint64((1 << bits) - 1)
    return slots, costs, shift


def probe(table: tuple, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The costs of runs by a table, and the places of those that it lacks (cost 0)."""
    slots, costs, shift = table
    out = np.zeros(len(gram), np.int64 if costs.dtype.kind == "i" else float)
    at, left, missing = (gram * _SPREAD) >> shift, np.arange(len(gram)), []
    last = np.uint64(len(slots) - 1)
    while len(left):
        place = at[left]
        key = slots[place]
        hit = key == gram[left]
        out[left[hit]] = costs[place[hit]]
        gone = key == _EMPTY
        missing.append(left[gone])
        left = left[~(hit | gone)]
        at[left] = (at[left] + np.uint64(1)) & last
    return out, np.concatenate(missing) if missing else left


def lookup(trie: Trie, table: tuple, gram: np.ndarray) -> np.ndarray:
    """trie.cost by the table; runs that it lacks are coded once each."""
    out, absent = probe(table, gram)
    if len(absent):
        every, where = np.unique(gram[absent], return_inverse=True)
        out[absent] = trie.cost(every)[where]
    return out


def group_trie(short: tuple[np.ndarray, np.ndarray], gram: np.ndarray, n: np.ndarray) -> Trie:
    """The trie of runs whose contexts end alike.

    short: the counts of all runs of ENDING bytes, for the orders below ENDING.  A longer context shares its last ENDING bytes
    with all of its own endings of as many bytes or more, so the group's runs make up all that the orders above depend on.
    """
    levels = [_summed([(short[0] & np.uint64((1 << 8 * (m + 1)) - 1), short[1])]) for m in range(ENDING)]
    levels += [_summed([(gram & np.uint64((1 << 8 * (m + 1)) - 1), n)]) for m in range(ENDING, ORDER + 1)]
    return Trie([g for g, _ in levels], [c for _, c in levels])


def run_costs(longest: DataFrame, asked: DataFrame, n_runs: int) -> DataFrame:
    """gram, cost (in units) of every run of asked (distinct), by the model of longest (gram, n: all n_runs runs of the texts)."""
    found = longest.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * ENDING) - 1)).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    short = longest.sparkSession.sparkContext.broadcast((found.column("gram").to_numpy().astype(np.uint64), found.column("n").to_numpy()))
    schema = pa.schema([("gram", pa.int64()), ("cost", pa.int64())])

    def make(group: pa.Table) -> pa.Table:
        gram, known = group.column("gram").to_numpy().view(np.uint64), group.column("n").is_valid().to_numpy()
        trie = group_trie(short.value, gram[known], group.column("n").drop_null().to_numpy().astype(np.int64))
        own = gram[~known]
        return pa.table([own.view(np.int64), np.rint(trie.cost(own) / UNIT).astype(np.int64)], schema=schema)

    every = longest.select("gram", "n").unionByName(asked.select("gram", F.lit(None).cast("long").alias("n")))
    ending = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * ENDING) - 1))
    groups = max(GROUPS, n_runs // GROUP_RUNS)
    return every.withColumn("ending", F.pmod(F.hash(ending), F.lit(groups))).groupBy("ending").applyInArrow(make, "gram long, cost long")


def frequent(counts: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The rows of counts (column n) that are seen at least as often as fits `most` rows, and how many rows there are in all."""
    least = 1
    held = total = 0
    for r in counts.groupBy(F.least("n", F.lit(100_000)).alias("n")).count().orderBy(F.desc("n")).collect():
        total += r["count"]
        if held <= most:
            held += r["count"]
            if held > most:
                least = r["n"] + 1
    return counts.where(F.col("n") >= least), total


def head_costs(longest: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The runs of frequent(longest, most) and their costs, and how many runs there are."""
    head, n_runs = frequent(longest, most)
    found = run_costs(longest, head, n_runs).select("gram", F.col("cost").cast("int").alias("cost")).toArrow()
    return found.column("gram").to_numpy().astype(np.uint64), found.column("cost").to_numpy(), n_runs


def score_texts(docs: DataFrame, training, order_nodes: int = MOST_NODES, head: int = HEAD_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    training: a condition on docs that marks the rows to learn from.  Words are what stands between ASCII white space,
    A-Z lower-cased, and each text has one end more; base_score adds up the words' log10 (c + 1) / (N + V + 1), score is
    the log10 probability of the lower-cased text's bytes and end.  Null texts are empty; repeated rows count each.  order_nodes
    and head bound what goes to every task, not what is counted.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), (~F.coalesce(training, F.lit(True))).alias("held_out"))
    counts = stored(training_counts(rows.where(~F.col("held_out"))), "ppm-counts")
    words = counts.where("word IS NOT NULL").select("word", "n")
    n_all, n_kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = words.where(F.length("word") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    usual = frequent(words.where(F.length("word") > 0), head)[0].toArrow()
    logs = dict(zip(usual.column("word").to_pylist(), np.log10(usual.column("n").to_numpy() + 1.0).tolist(), strict=True))
    longest = counts.where("gram IS NOT NULL").select("gram", "n")
    *table, n_runs = head_costs(longest, order_nodes)
    model = spark.sparkContext.broadcast((*table, logs))
    del usual, logs, table
    stamp = f"ppm-{uuid.uuid4().hex}"
    end_value, end_known = float(np.log10(ends + 1)), int(ends > 0)

    def make(batch):
        keys, values, common = model.value
        costs = worker_cache(stamp, lambda: hashed(keys, values))
        texts = [lowered(t) for t in batch.column("text").to_pylist()]
        n, known, base, rare = [], [], [], []
        find = common.get
        for t in texts:
            own = t.split()
            values = list(map(find, own))
            odd = [w for w, v in zip(own, values, strict=True) if v is None] if None in values else []
            n.append(len(own) + 1)
            known.append(len(own) - len(odd) + end_known)
            base.append(sum(filter(None, values)) + end_value)
            rare.append(odd)
        gram, begin, end = runs(texts)
        keep = coded(begin, end, len(gram))
        gram = gram[keep]
        cost, absent = probe(costs, gram)
        lengths = end - begin + 1
        units = np.add.reduceat(cost, np.cumsum(lengths) - lengths)
        of = np.repeat(np.arange(len(texts)), lengths)[absent]
        sort = np.lexsort((gram[absent], of))
        of, own = of[sort], gram[absent][sort]
        first = np.nonzero(np.append(True, (of[1:] != of[:-1]) | (own[1:] != own[:-1])))[0] if len(own) else np.zeros(0, np.int64)
        offsets = pa.array(np.searchsorted(of[first], np.arange(len(texts) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (own[first].view(np.int64), np.diff(np.append(first, len(own))).astype(np.int64))]
        out = {c: batch.column(c) for c in ("row", "doc_id", "held_out")}
        return out | {"n_tokens": n, "known": known, "base": base, "units": units, "rare": rare, "gram": lists[0], "times": lists[1]}

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    scored = stored(mapped(numbered, "text", make, "row long,doc_id long,held_out boolean,n_tokens long,known long,base double,units long,rare array<binary>,gram array<long>,times array<long>", most=1_000_000), "ppm-scored")
    found = scored.select("row", F.explode("rare").alias("word")).join(words, "word").groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("more"), F.count("*").alias("more_known"))
    pairs = scored.select("row", F.explode(F.arrays_zip("gram", "times")).alias("p")).select("row", "p.gram", "p.times")
    costs = run_costs(longest, pairs.select("gram").distinct(), n_runs)
    rest = pairs.join(costs, "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("cost")).alias("rest"))
    log_all = float(np.log10(n_all + n_kinds + 1))
    return scored.drop("rare", "gram", "times").join(found, "row", "left").join(rest, "row", "left").select(
        F.col("doc_id").alias(key), "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        (-(F.col("units") + F.coalesce("rest", F.lit(0))) * F.lit(UNIT)).alias("score"),
    )


def fold(key: str = "doc_id", folds: int = 7):
    """crc32 of the key as text, modulo folds; null keys are in fold -1."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(folds)), F.lit(-1))

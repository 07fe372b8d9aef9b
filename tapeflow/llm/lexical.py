"""Ranked lexical search by accumulator-limited term-at-a-time evaluation.

Words are those of decontamination.words_of.  The index is split by document: a row holds the query terms of one
document and how often each occurs, so no posting list is ever shuffled, and one that holds most documents stays spread
over all tasks.  Counts over the collection (documents N, words L, documents of each term) are sums over the index.

A task takes its documents in blocks and ranks each for every item, term by term, rarest first.  A term that comes up adds
its weighted part to the accumulators of its documents.  Before each term the most that the terms not yet seen can add, by their
largest parts within the block, is set against the k-th best partial score so far (the task's earlier blocks count with
their final scores): once it falls short, no document without an accumulator can be among the best, so none is created
from then on, while the ones there are go on to their exact scores.  The best of all tasks are ranked in the end.

All arithmetic after a term's weight is on 64-bit integers, so scores don't depend on the order of documents or terms.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, stored, text_slices
from .decontamination import words_of

#: Distinct terms of items that one pass takes to every task (about 100 bytes each); more make more passes.
BLOCK_TERMS = 1_000_000
#: Documents that a task ranks at a time.
BLOCK_DOCS = 8192
#: Bytes of postings that a task ranks at a time, if its documents are long.
BLOCK_BYTES = 16_000_000


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def build_index(docs: DataFrame, terms: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, terms, times for every row: int32 arrays as bytes, by ascending term; terms: those to keep."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def make(batch):
        number = held.value
        n, found, times = [], [], []
        for t in batch.column("text").to_pylist():
            words = words_of(t)
            ids = np.fromiter(map(number.get, words, itertools.repeat(-1)), np.int32, len(words))
            ids, tf = np.unique(ids[ids >= 0], return_counts=True)
            n.append(len(words))
            found.append(ids.tobytes())
            times.append(tf.astype(np.int32).tobytes())
        return {"doc_id": batch.column("doc_id"), "n_words": n, "terms": found, "times": times}

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return mapped(rows, "text", make, "doc_id long,n_words long,terms binary,times binary")


def document_counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """Documents of each term; every task sends one count for each term that it has."""

    def run(batches):
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32), minlength=n_terms)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_pydict({"term": at, "n": total[at]})

    counts = np.zeros(n_terms, np.int64)
    for term, n in index.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        counts[term] = n
    return counts


class Ranker:
    """The best k documents of every item over the blocks that it is given."""

    def __init__(self, items: list[dict[int, int]], df: np.ndarray, n_docs: int, n_words: int, k: int):
        """items: the terms of each and how often they occur there."""
        self.n_docs, self.n_words, self.k = n_docs, n_words, k
        self.weight = np.array([term_weight(n_docs, int(n)) for n in df], np.int64)
        self.terms, self.repeats = [], []
        for item in items:
            terms = np.array(sorted((t for t in item if df[t]), key=lambda t: (df[t], t)), np.int64)  # rarest first
            self.terms.append(terms)
            self.repeats.append(np.array([item[t] for t in terms], np.int64))
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]  # scores, keys; null keys are NO_KEY
        self.created = self.spared = 0

    def add(self, keys: np.ndarray, n: np.ndarray, terms: list[np.ndarray], times: list[np.ndarray]) -> None:
        """One block: keys, words, terms and times of its documents."""
        doc = np.repeat(np.arange(len(keys)), [len(t) for t in terms])
        term, tf = np.concatenate(terms).astype(np.int64), np.concatenate(times).astype(np.int64)
        order = np.argsort(term, kind="stable")
        doc, term, tf = doc[order], term[order], tf[order]
        m = 75 + (25 * n * self.n_docs) // max(1, self.n_words)
        part = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        start = np.searchsorted(term, np.arange(len(self.weight) + 1))
        most = np.zeros(len(self.weight), np.int64)
        there = np.nonzero(start[1:] > start[:-1])[0]
        if len(there):
            most[there] = np.maximum.reduceat(part, start[there])
        for i, (terms_i, repeats) in enumerate(zip(self.terms, self.repeats, strict=True)):
            self._rank(i, terms_i, repeats, keys, doc, part, start, most)

    def _rank(self, i, terms, repeats, keys, doc, part, start, most) -> None:
        scores, best = self.best[i]
        floor = scores[-1] if len(scores) == self.k else -1
        left = np.append(np.cumsum((repeats * most[terms])[::-1])[::-1], 0)
        held = np.zeros(len(keys), np.int64)
        live = np.zeros(len(keys), bool)
        open_, own = True, np.zeros(0, np.int64)
        for j, (t, r) in enumerate(zip(terms.tolist(), repeats.tolist(), strict=True)):
            if open_ and left[j] < max(floor, self._kth(held, live)):
                open_, own = False, np.nonzero(live)[0]
            docs, parts = doc[start[t] : start[t + 1]], part[start[t] : start[t + 1]]
            if open_:
                held[docs] += r * parts
                live[docs] = True
                self.created += len(docs)
            elif len(own) and len(docs):
                at = np.minimum(np.searchsorted(docs, own), len(docs) - 1)
                met = docs[at] == own
                held[own[met]] += r * parts[at[met]]
                self.spared += len(docs) - int(met.sum())
        own = np.nonzero(held > 0)[0]
        if len(own) > self.k:  # all that reach the k-th score, then the least keys among equals
            own = own[held[own] >= np.partition(held[own], len(own) - self.k)[len(own) - self.k]]
        s, b = np.concatenate([scores, held[own]]), np.concatenate([best, keys[own]])
        order = np.lexsort((b, -s))[: self.k]
        self.best[i] = s[order], b[order]

    def _kth(self, held: np.ndarray, live: np.ndarray) -> int:
        own = held[live]
        return int(np.partition(own, len(own) - self.k)[len(own) - self.k]) if len(own) >= self.k else -1


#: Stands for a null key, after all others.
NO_KEY = np.iinfo(np.int64).max


def _ranked(index: DataFrame, make_ranker) -> DataFrame:
    """item (its number), doc_id, score of the best of every task."""

    def run(batches):
        ranker = make_ranker()
        kept: list[tuple] = []

        def flush():
            keys, n, terms, times = zip(*kept, strict=True)
            ranker.add(np.array(keys, np.int64), np.array(n, np.int64), list(terms), list(times))
            kept.clear()

        size = 0
        for batch in text_slices(batches, "terms", BLOCK_BYTES):
            for r in batch.to_pylist():
                kept.append((NO_KEY if r["doc_id"] is None else r["doc_id"], r["n_words"], np.frombuffer(r["terms"], np.int32), np.frombuffer(r["times"], np.int32)))
                size += len(r["terms"])
                if len(kept) == BLOCK_DOCS or size > BLOCK_BYTES:
                    flush()
                    size = 0
        if kept:
            flush()
        for i, (scores, keys) in enumerate(ranker.best):
            if len(scores):
                yield pa.RecordBatch.from_pydict({"item": pa.array([i] * len(scores), pa.int32()), "doc_id": keys, "score": scores})

    return index.where(F.length("terms") > 0).mapInArrow(run, "item int, doc_id long, score long")


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """item_key, rank, doc_id, score: the k best documents of each item, all if fewer score above 0; ties to the least key.

    Null texts have no words, texts without words count in no figure, items without words have no rows.  Rows of one item key
    (null is one) are one item with the terms of all of them, repeats included.  Each row of docs is a document of its
    own, so a repeated key can take several ranks; null keys come last among equal scores.  Other columns are not looked at.

    Items go to the tasks in blocks of at most block_terms words, dealt by their keys, each with an index of its
    terms, so their number isn't bounded; one item is always whole in one block.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item_key).alias("name"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    n_words = rows.agg(F.sum(F.size(F.regexp_extract_all("text", F.lit("[0-9A-Za-z\\x80-\\x{10FFFF}]+"), 0)))).first()[0] or 0
    blocks = max(1, -(-n_words // block_terms))
    found = None
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == b)
        own: dict[object, Counter] = {}
        for r in part.collect():  # at most block_terms words
            own.setdefault(r["name"], Counter()).update(words_of(r["text"]))
        number = {w: i for i, w in enumerate(dict.fromkeys(w for words in own.values() for w in words))}
        index = stored(build_index(docs, number, key, text), "ranked-postings")
        n_docs, n_all = index.where("n_words > 0").agg(F.count("*"), F.sum("n_words")).first()
        df = document_counts(index, len(number))
        sent = spark.sparkContext.broadcast(([{number[w]: n for w, n in words.items()} for words in own.values()], df, n_docs, n_all or 0))
        names = spark.createDataFrame([(i, name) for i, name in enumerate(own)], f"item int, name {dict(rows.dtypes)['name']}")
        best = _ranked(index, lambda sent=sent: Ranker(*sent.value, k)).join(F.broadcast(names), "item")
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("name").orderBy(F.desc("score"), "doc_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select(F.col("name").alias(item_key), "rank", F.when(F.col("doc_id") != NO_KEY, F.col("doc_id")).alias("doc_id"), "score")
    )

"""Benchmark decontamination with a distributed positional inverted index.

The index is split by document: every row holds the posting lists of one document (terms in order, and for each its
positions), so building and searching never shuffle a posting, and a term or text that is everywhere stays spread over
all tasks.  Postings are kept for the terms that occur in the test items; no other term can take part in a match.

A search takes each window of a test item, starts from the postings of its rarest term over the whole collection, shifts
them to the window's start, and intersects them with the shifted lists of the other terms, rarer terms first.  With a
slop, each term may stand that many words off its place (proximity); what survives is intersected again exactly.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, stored

#: Words of test items that one pass over the index takes to every task (about 100 bytes each); more make more passes.
BLOCK_WORDS = 1_000_000
#: Candidates that a task intersects at a time.
MOST_CANDIDATES = 1_000_000
#: Keys up to this number are sent to all tasks; more are joined by shuffle.
MOST_BROADCAST = 300_000
_SHIFT = 36

#: Lower-cases A-Z and turns every ASCII byte that is no digit or letter into a space; bytes over 7F stay.
_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split() if text else []


def build_index(docs: DataFrame, terms: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, terms, positions for every row: int32 arrays as bytes, sorted by term, then position.

    terms: the numbers of the terms to keep.  Null and empty texts have no postings; repeated rows are rows of their own.
    """
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def make(batch):
        number = held.value
        n, found, places = [], [], []
        for t in batch.column("text").to_pylist():
            words = words_of(t)
            ids = np.fromiter(map(number.get, words, itertools.repeat(-1)), np.int32, len(words))
            at = np.nonzero(ids >= 0)[0].astype(np.int32)
            at = at[np.argsort(ids[at], kind="stable")]
            n.append(len(words))
            found.append(ids[at].tobytes())
            places.append(at.tobytes())
        return {"doc_id": batch.column("doc_id"), "n_words": n, "terms": found, "positions": places}

    rows = docs.selectExpr(f"`{key}` AS doc_id", f"`{text}` AS text")
    return mapped(rows, "text", make, "doc_id long,n_words long,terms binary,positions binary")


def term_counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """Postings of each term over the whole index; every task sends a count for each term it has."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(n_terms, np.int64)
        for b in batches:
            term, n = np.unique(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32), return_counts=True)
            total[term] += n
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_pydict({"term": at, "n": total[at]})

    counts = np.zeros(n_terms, np.int64)
    for term, n in index.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        counts[term] = n
    return counts


def windows_of(items: list[tuple[int, list[bytes]]], size: int, terms: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(windows x size) term numbers, -1 beyond a short item's end, and the number of each window's item."""
    rows, owner, seen = [], [], set()
    for i, words in items:
        ids = [terms[w] for w in words]
        for start in range(max(1, len(ids) - size + 1) if ids else 0):
            window = tuple(ids[start : start + size])
            if (i, window) not in seen:
                seen.add((i, window))
                rows.append(window + (-1,) * (size - len(window)))
                owner.append(i)
    return np.array(rows, np.int64).reshape(len(rows), size), np.array(owner, np.int64)


class Searcher:
    """Windows with their terms ordered from the rarest; finds them in the postings of some documents."""

    def __init__(self, windows: np.ndarray, owner: np.ndarray, counts: np.ndarray, slop: int):
        self.owner, self.slop, self.size = owner, slop, windows.shape[1]
        rarity = np.where(windows < 0, np.iinfo(np.int64).max, counts[windows])
        self.order = np.argsort(rarity, axis=1, kind="stable")  # offsets, the rarest term's first
        self.term = np.take_along_axis(windows, self.order, 1)
        self.length = (windows >= 0).sum(1)

    def _has(self, keys: np.ndarray, term: np.ndarray, at: np.ndarray, slop: int) -> np.ndarray:
        low = (term << _SHIFT) + np.maximum(at - slop, 0)
        i = np.minimum(np.searchsorted(keys, low), len(keys) - 1)
        return (keys[i] >= low) & (keys[i] <= (term << _SHIFT) + at + slop)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, start, exact) of proximity matches; keys: sorted term and position of all postings."""
        none = np.zeros(0, np.int64)
        if not len(keys) or not len(self.term):
            return none, none, none.astype(bool)
        rare = self.term[:, 0]
        low = np.searchsorted(keys, rare << _SHIFT)
        n = np.searchsorted(keys, (rare + 1) << _SHIFT) - low
        out = []
        live = np.nonzero(n)[0]
        if not len(live):
            return none, none, none.astype(bool)
        turn = np.cumsum(n[live]) // MOST_CANDIDATES
        for t in np.unique(turn):
            w = live[turn == t]
            window = np.repeat(w, n[w])
            inside = np.arange(len(window)) - np.repeat(np.cumsum(n[w]) - n[w], n[w])
            start = (keys[np.repeat(low[w], n[w]) + inside] & ((1 << _SHIFT) - 1)) - self.order[window, 0]
            for j in range(1, self.size):
                term = self.term[window, j]
                keep = (term < 0) | self._has(keys, term, start + self.order[window, j], self.slop)
                window, start = window[keep], start[keep]
            exact = np.ones(len(window), bool)
            for j in range(1, self.size):
                term = self.term[window, j]
                exact &= (term < 0) | self._has(keys, term, start + self.order[window, j], 0)
            out.append((window, start, exact))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def search(index: DataFrame, searcher: Searcher, names: list[str | None]) -> DataFrame:
    """For every index row: its key, n_words, hit word positions (int32 bytes), items hit, and items near.

    names: those of the items by number; an item without a name is in neither list of items.
    """
    held = index.sparkSession.sparkContext.broadcast((searcher, names))

    def make(batch):
        searcher, names = held.value
        n_words = batch.column("n_words").to_numpy(zero_copy_only=False)
        gap = searcher.size + searcher.slop + 1
        base = np.cumsum(np.append(0, n_words + gap))  # documents stand apart by more than a window
        terms = [np.frombuffer(x, np.int32) for x in batch.column("terms").to_pylist()]
        places = [np.frombuffer(x, np.int32) for x in batch.column("positions").to_pylist()]
        keys = np.concatenate([(t.astype(np.int64) << _SHIFT) + p + b for t, p, b in zip(terms, places, base + gap, strict=False)] or [np.zeros(0, np.int64)])
        keys.sort()
        window, start, exact = searcher.find(keys)
        doc = np.searchsorted(base + gap, start + searcher.slop, side="right") - 1
        hit = np.zeros(base[-1] + 2 * gap, bool)
        for j in range(searcher.size):
            fits = exact & (j < searcher.length[window])
            hit[start[fits] + j] = True
        sets = []
        for pick in (exact, np.ones(len(exact), bool)):
            owned: list[list[str]] = [[] for _ in n_words]
            for d, i in np.unique(np.stack([doc[pick], searcher.owner[window[pick]]]), axis=1).T:
                if names[i] is not None:
                    owned[d].append(names[i])
            sets.append(owned)
        hits = [np.nonzero(hit[b + gap : b + gap + n])[0].astype(np.int32).tobytes() for b, n in zip(base, n_words, strict=False)]
        return {"doc_id": batch.column("doc_id"), "n_words": n_words, "hits": hits, "items": sets[0], "near": sets[1]}

    return mapped(index, "terms", make, "doc_id long,n_words long,hits binary,items array<string>,near array<string>")


def match_items(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 2, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """For every row of docs: key, n_words, hits (int32 positions as bytes), items (exact), near (within slop).

    Windows are `size` consecutive words of an item, or all words of a shorter one; an item without words has none.  Rows of
    one item key are one item, each text with windows of its own; rows without a key hit words, but name no item.
    Null texts have no words.  Test items are taken to the tasks in blocks of at most block_words words, each with an
    index of its terms, so their number isn't bounded; blocks are joined by row number in the end.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item_key).cast("string").alias("name"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    n_words = rows.agg(F.sum(F.size(F.regexp_extract_all("text", F.lit("[0-9A-Za-z\\x80-\\x{10FFFF}]+"), 0)))).first()[0] or 0
    blocks = max(1, -(-n_words // block_words))
    if blocks > 1:  # rows need a number that holds for all passes
        docs = stored(docs.select(key, text).withColumn("_row", F.monotonically_increasing_id()), "decontamination-docs")
    found = []
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == b)
        number: dict[str | None, int] = {}
        own = [(number.setdefault(r["name"], len(number)), words_of(r["text"])) for r in part.collect()]
        terms = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in own for w in words))}
        if blocks == 1:
            index = stored(build_index(docs, terms, key, text), "postings")
        else:
            index = stored(build_index(docs, terms, "_row", text), "postings")
        windows, owner = windows_of(own, size, terms)
        found.append(search(index, Searcher(windows, owner, term_counts(index, len(terms)), slop), list(number)))
    if blocks == 1:
        return found[0].withColumnRenamed("doc_id", key)
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    merged = every.groupBy("doc_id").agg(
        F.first("n_words").alias("n_words"), F.collect_list("hits").alias("hits"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"),
    )

    @F.pandas_udf("binary")
    def united(hits: pd.Series) -> pd.Series:
        return hits.map(lambda xs: np.unique(np.frombuffer(b"".join(xs), np.int32)).tobytes())

    merged = merged.withColumn("hits", united("hits")).withColumnRenamed("doc_id", "_row")
    return docs.select("_row", key).join(merged, "_row").drop("_row")


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 2, key: str = "doc_id", **options) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items of every row of docs; see match_items."""
    found = match_items(docs, items, size, slop, key, **options)
    return found.select(
        key,
        "n_words",
        (F.length("hits") / 4).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.length("hits") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near_items"),
    )


def without_items(docs: DataFrame, items: DataFrame, size: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that hold a window of a test item: same columns, texts whole.

    Windows are those of match_items of `size` words, so a shorter item is one window of all its words.  Rows are judged
    one by one, whatever their key.
    """
    columns = docs.columns
    docs = stored(docs.withColumn("_number", F.monotonically_increasing_id()), "decontamination-rows")
    found = match_items(docs, items, size, 0, "_number", text)
    hit = stored(found.where(F.length("hits") > 0).select("_number"), "contaminated")
    few = hit.count() <= MOST_BROADCAST
    return docs.join(F.broadcast(hit) if few else hit, "_number", "left_anti").select(columns)


def item_digest(names: list[str]) -> str:
    """What items_sha256 holds for a list of item keys."""
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()

import math
from collections import Counter

import numpy as np
import pytest

from tapeflow.llm import lexical
from tapeflow.llm.decontamination import words_of
from tapeflow.llm.lexical import NO_KEY, Ranker, rank_documents, term_weight

DOCS = "doc_id long, text string, score long, item_id long"
ITEMS = "item_id long, text string, rank int"


def brute(docs, items, k):
    """(item, doc, score) of every item's best by scoring all documents."""
    bags = [(i, Counter(words_of(t))) for i, t, *_ in docs]
    n_docs, n_words = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    terms = {}
    for i, t, *_ in items:
        terms.setdefault(i, Counter()).update(words_of(t))
    out = []
    for i, bag in terms.items():
        scored = []
        for d, b in bags:
            m = 75 + 25 * b.total() * n_docs // max(1, n_words)
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 12 * m)) for w, r in bag.items() if w in b)
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(i, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n=300):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(200)])
    chance = 1 / np.arange(1, 201)
    text = lambda size: " ".join(rng.choice(words, size, p=chance / chance.sum()))
    docs = [(int(i), text(int(rng.integers(0, 80))), 1, 2) for i in rng.permutation(n)]
    docs += [(1000 + i, docs[i % 7][1], 1, 2) for i in range(40)]  # ties
    docs += [(5, docs[3][1], 1, 2), (None, docs[4][1], 1, 2), (2000, None, 1, 2), (2001, "", 1, 2), (2002, "W1 w2, Über! " * 3000, 1, 2)]
    items = [(i, text(int(rng.integers(1, 30))), 0) for i in range(20)]
    items += [(20, "w1 w1 W1 w150", 0), (21, "unseen words", 0), (22, None, 0), (23, " .", 0), (24, "über", 0), (3, "w77 w78", 0), (None, "w5 w6", 0)]
    return docs, items


@pytest.mark.parametrize("k, block_terms, block_docs", [(20, 10**6, 8192), (5, 60, 16), (1000, 10**6, 100)])
def test_rows_equal_brute_force(spark, monkeypatch, k, block_terms, block_docs):
    docs, items = corpus(k)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block_docs)
    found = rank_documents(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), k, block_terms=block_terms)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items, k)


def test_accumulators_are_limited_and_survivors_exact():
    rng = np.random.default_rng(3)
    df = np.array([3, 40, 2000, 5000])
    terms = [np.array(sorted({3} | {t for t, n in ((0, 3), (1, 40), (2, 2000)) if d < n})) for d in range(5000)]
    times = [rng.integers(1, 4, len(t)) for t in terms]
    n = rng.integers(5, 60, 5000)
    ranker = Ranker([{0: 1, 1: 2, 2: 1, 3: 4}], df, 5000, int(n.sum()), 3)
    ranker.add(np.arange(5000), n, terms, times)
    m = 75 + 25 * n * 5000 // n.sum()
    weight = [term_weight(5000, x) for x in df.tolist()]
    full = [sum(r * weight[t] * (10**9 * int(f) // (1000 * int(f) + 12 * int(m[d]))) for t, f in zip(terms[d], times[d]) for r in [(1, 2, 1, 4)[t]]) for d in range(5000)]
    order = sorted(range(5000), key=lambda d: (-full[d], d))[:3]
    assert ranker.best[0][1].tolist() == order and ranker.best[0][0].tolist() == [full[d] for d in order]
    assert ranker.created < 100 < ranker.spared  # the frequent terms create nothing


def test_empty_tables(spark):
    docs, items = corpus(9, 20)
    some, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert rank_documents(some, none.limit(0)).collect() == []
    assert rank_documents(some.limit(0), none).collect() == []
    assert NO_KEY == 2**63 - 1

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tapeflow.llm.ppm import ENDING, GROUPS, ORDER, Trie, fold, lookup, score_texts, training_counts

SCHEMA = "doc_id long, text string, score string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


class Naive:
    """The same model by dictionaries, symbol by symbol."""

    def __init__(self, texts):
        self.counts = defaultdict(Counter)
        for t in texts:
            data = b"\xff" * ORDER + t + b"\xff"
            for i in range(ORDER, len(data)):
                for m in range(ORDER + 1):
                    self.counts[data[i - m : i]][data[i]] += 1

    def probability(self, context, symbol):
        p, excluded = 1.0, set()
        for m in range(ORDER, -1, -1):
            own = self.counts.get(context[len(context) - m :])
            if not own:
                continue
            left = {s: n for s, n in own.items() if s not in excluded}
            if left:
                total = sum(left.values())
                if symbol in left:
                    return p * (left[symbol] - 0.5) / total
                p *= len(left) / (2 * total)
            excluded = set(own)
        return p / max(256 - len(excluded), 1)

    def score(self, t):
        data = b"\xff" * ORDER + t + b"\xff"
        return sum(math.log10(self.probability(data[i - ORDER : i], data[i])) for i in range(ORDER, len(data)))


TEXTS = [(i, t, "x") for i, t in enumerate(["the cat sat on the mat", "The cat\nate  the rat", "a rat and a cat", None, "", "über Ärger", "zzz qqq", "the the the the", "on the mat"] * 3)]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([*TEXTS, TEXTS[0], (None, "the cat", "x")], SCHEMA).repartition(3)
    found = score_texts(docs, fold() != 2, head=3).collect()
    train = [lower(t) for i, t, _ in [*TEXTS, TEXTS[0], (None, "the cat", "x")] if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    tokens = Counter(w for t in train for w in [*re.findall(r"[^\x20\x09-\x0D]+", t), None])
    model = Naive([t.encode() for t in train])
    n, v = sum(tokens.values()), len(tokens)
    texts = {i: t for i, t, _ in TEXTS} | {None: "the cat"}
    assert len(found) == len(TEXTS) + 2
    for r in found:
        own = [*re.findall(r"[^\x20\x09-\x0D]+", lower(texts[r["doc_id"]])), None]
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(tokens[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in own), abs_tol=1e-6)
        assert math.isclose(r["score"], model.score(lower(texts[r["doc_id"]]).encode()), rel_tol=1e-5, abs_tol=1e-4)


def test_probabilities_sum_to_one():
    model = Naive([b"abracadabra", b"abc abd"])
    grams = [Counter() for _ in range(ORDER + 1)]
    for c, own in model.counts.items():
        for s, n in own.items():
            grams[len(c)][int.from_bytes(c + bytes([s]))] += n
    trie = Trie([np.array(sorted(g), np.uint64) for g in grams], [np.array([g[k] for k in sorted(g)]) for g in grams])
    for context in (b"abrac", b"zzzab", b"qqqqq", b"\xff" * 5):
        gram = np.array([int.from_bytes(context + bytes([s])) for s in range(256)], np.uint64)
        p = 10 ** -trie.cost(gram)
        assert np.isclose(p.sum(), 1) and np.allclose(p, [model.probability(context, s) for s in range(256)])
        assert np.allclose(lookup(trie, trie.table(), gram), trie.cost(gram), rtol=1e-5)


def test_smaller_trie_and_no_training_rows(spark):
    docs = spark.createDataFrame(TEXTS, SCHEMA)
    small = {r["doc_id"]: r["score"] for r in score_texts(docs, fold() != 2, order_nodes=60).collect()}
    assert all(np.isfinite(s) and s < 0 for s in small.values())
    none = score_texts(docs, F.lit(False)).collect()
    assert {(r["train_tokens"], r["n_known"], r["base_score"]) for r in none} == {(0, 0, 0.0)}
    assert math.isclose(next(r["score"] for r in none if r["doc_id"] == 6), -8 * math.log10(256), rel_tol=1e-6)
    assert score_texts(docs.limit(0), fold() != 2).count() == 0


def test_rare_runs_score_as_with_the_whole_table(spark):
    docs = spark.createDataFrame(TEXTS, SCHEMA).repartition(3)
    model = Naive([lower(t).encode() for i, t, _ in TEXTS if zlib.crc32(str(i).encode()) % 7 != 2])
    for most in (0, 1, 60):
        for r in score_texts(docs, fold() != 2, order_nodes=most).collect():
            assert math.isclose(r["score"], model.score(lower(dict(t[:2] for t in TEXTS)[r["doc_id"]]).encode()), rel_tol=1e-5, abs_tol=1e-4)


def test_scores_are_the_same_however_costs_come(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one, *others = (sorted(map(tuple, score_texts(docs, fold() != 2, order_nodes=n).select("doc_id", "score").collect())) for n in (3_000_000, 0, 5000))
    assert len(one) == 200 and all(x == one for x in others)


def test_runs_are_dealt_evenly(spark):
    """The largest group, which one task has to hold, is less than a hundredth of all runs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    longest = training_counts(docs).where("gram IS NOT NULL")
    ending = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * ENDING) - 1))
    sizes = sorted(r["count"] for r in longest.groupBy(F.pmod(F.hash(ending), F.lit(GROUPS))).count().collect())
    assert sum(sizes) > 50_000 and sizes[-1] < 0.01 * sum(sizes)

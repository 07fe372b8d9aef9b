import itertools

import numpy as np
import pytest

from tapeflow.llm.toxicity import SEGMENT, Field, chains, features, forward_backward, log_odds, score_documents, toxicity, words_of


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    grid, mask = rng.normal(size=(3, 6)), np.ones((3, 6), bool)
    mask[1, 4:] = mask[2, 1:] = False
    grid[~mask] = 0
    start, trans = 0.3, rng.normal(size=(2, 2))
    odds, _, log_z = forward_backward(grid, mask, start, trans)
    assert np.allclose(np.where(mask, odds, 0), np.where(mask, log_odds(grid, mask, start, trans), 0))
    for k in range(3):
        n = mask[k].sum()
        weight = {}
        for path in itertools.product((0, 1), repeat=int(n)):
            s = start * path[0] + sum(grid[k, t] * path[t] for t in range(n)) + sum(trans[path[t - 1], path[t]] for t in range(1, n))
            weight[path] = np.exp(s)
        assert np.isclose(log_z[k], np.log(sum(weight.values())))
        for t in range(n):
            p = sum(w for path, w in weight.items() if path[t]) / sum(weight.values())
            assert np.isclose(odds[k, t], np.log(p / (1 - p)))


def test_chains_keep_texts_apart():
    lengths = np.array([0, 3, SEGMENT + 1, 0])
    grid, mask, at = chains(lengths, np.arange(1.0, SEGMENT + 5))
    assert mask.sum(1).tolist() == [3, SEGMENT, 1] and grid[at].tolist() == list(np.arange(1.0, SEGMENT + 5))


def test_a_text_is_one_chain():
    rng = np.random.default_rng(4)
    weights = {b"w%d$" % i: float(w) for i, w in enumerate(rng.normal(scale=3, size=9))}
    trans, start, bias = rng.normal(size=(2, 2)) + 2 * np.eye(2), 1.5, -0.5
    field = Field(weights, bias, start, trans, np.zeros(4))
    texts = [[int(i) for i in rng.integers(9, size=n)] for n in (5, 3 * SEGMENT + 7, 0, 2 * SEGMENT, SEGMENT, SEGMENT + 1, 40 * SEGMENT + 3)]
    lengths, odds = field.tokens([" ".join(f"w{i}" for i in own) for own in texts])
    assert lengths.tolist() == [len(own) for own in texts]
    at = 0
    for own in texts:
        if own:
            grid = np.array([[bias + weights[b"w%d$" % i] for i in own]])
            assert np.allclose(odds[at : at + len(own)], forward_backward(grid, np.ones(grid.shape, bool), start, trans)[0][0])
        at += len(own)


def test_document_scores_equal_enumeration(spark):
    """score_documents against all paths of each short text: marginals, their largest log odds and sum, then the score."""
    rng = np.random.default_rng(6)
    weights = {f: float(rng.normal(scale=2)) for w in (b"zork", b"fine", b"so") for f in features(w)}
    trans, start, bias, final = rng.normal(size=(2, 2)), 0.4, -0.3, np.array([-1.0, 0.8, 1.5, -0.4])
    field = Field(weights, bias, start, trans, final)
    texts = ["Zork fine so", "so, so!", None, "", "?!", "zork zork fine other words so zork", "Über zork"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string").repartition(3)
    found = {r["doc_id"]: r for r in score_documents(docs, field).collect()}
    for i, t in enumerate(texts):
        words = words_of(t)
        emit = [bias + sum(weights.get(f, 0.0) for f in features(w)) for w in words]
        paths = list(itertools.product((0, 1), repeat=len(words)))
        weight = [np.exp(start * p[0] + sum(e * y for e, y in zip(emit, p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))) if p else 1.0 for p in paths]
        share = np.array([sum(w for w, p in zip(weight, paths) if p[k]) / sum(weight) for k in range(len(words))])
        odds = np.log(share / (1 - share))
        summary = [1.0, odds.max() if words else -12.0, np.log1p(share.sum()), np.log1p(len(words))]
        assert np.isclose(found[i]["score"], 1 / (1 + np.exp(-np.dot(summary, final)))) and found[i]["n_toxic_words"] == (odds > 0).sum()


def test_finds_toxic_words_and_spans(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows, labels = [], []
    for i in range(300):
        words = [word() for _ in range(30)]
        if i % 3 == 0:
            words[int(rng.integers(30))] = "zork" + str(rng.choice(["er", "ing", ""]))
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(i % 3 == 0)))
    rows += [(1000, None, "en"), (1001, "", None), (None, "Zorking, is bad", "en"), (1003, "Ä ZORK!", "en"), (1003, "Ä ZORK!", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    found = toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(found) == 305
    by_id = {r["doc_id"]: r for r in found}
    assert sum(by_id[i]["predicted"] == y for i, y in labels) >= 0.97 * len(labels)
    assert by_id[1000]["score"] == by_id[1001]["score"] < 0.5
    assert by_id[1003]["starts"] == [2] and by_id[1003]["ends"] == [6]
    assert by_id[None]["held_out"] is False and by_id[None]["n_toxic_words"] == 1


@pytest.mark.parametrize("labels", [[], [(1, 1)]])
def test_labels_of_one_kind_or_none(spark, labels):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    found = toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len({r["score"] for r in found}) == 1 and 0 <= found[0]["score"] <= 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    assert toxicity(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")).count() == 0


def test_held_out_documents(spark):
    """Labels of held-out documents are never learned from, and are found all the same; clean documents are left alone."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = {r["doc_id"]: r for r in toxicity(docs, labels).collect()}
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect() if found[r["doc_id"]]["held_out"]}
    caught = sum(found[i]["predicted"] for i, y in marks.items() if y)
    # With these few labels to learn from; on sf0.1, which has ten times as many, 133 of 144 are caught and 3 of 1,200 wrong.
    assert len(marks) > 50 and caught >= 0.7 * sum(marks.values())
    assert sum(found[i]["predicted"] for i, y in marks.items() if not y) <= 1

import hashlib

import numpy as np
import pytest

from tapeflow.llm.decontamination import words_of
from tapeflow.llm.near_dup import elements, keep_one, near_duplicates, signatures

SCHEMA = "doc_id long, text string, class_id string"


def brute(rows, least=0.8, size=5):
    """Classes from all pairs of word-shingle sets."""
    sets = {}
    for i, text, *_ in rows:
        w = words_of(text)
        sets[i] = {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    label = {i: i for i in sets}
    find = lambda i: i if label[i] == i else find(label[i])
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i: find(i) for i in sets}


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 4))
    shared = [word() for _ in range(60)]
    rows = []
    for g in range(12):
        base = [word() for _ in range(int(rng.integers(60, 200)))]
        for c in range(int(rng.integers(1, 9))):
            text = list(base)
            for _ in range(int(rng.integers(0, 4))):
                text[int(rng.integers(len(text)))] = word()
            rows.append(" ".join(text))
            if c % 3 == 0:
                rows.append(rows[-1])
    rows += [" ".join(shared + [word() for _ in range(50)]) for _ in range(15)]
    chain = [word() for _ in range(120)]
    for _ in range(6):  # neighbours are alike, the ends aren't
        rows.append(" ".join(chain))
        at = int(rng.integers(0, 100))
        chain[at : at + 6] = [word() for _ in range(6)]
    rows += [None, "", "  ?", "one two", "one two", "One, two!", "long " * 5000]
    order = rng.permutation(len(rows))
    return [(int(i), t, "x") for i, t in zip(order, rows)]


def test_classes_equal_brute_force(spark):
    rows = corpus()
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(found) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in found} == brute(rows)


def test_keeps_the_least_of_each_class(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([*rows, rows[0], (None, "a b c", "x")], SCHEMA)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    expected = sorted({i for i, c in brute(rows).items() if i == c}) + [None]
    assert sorted((r[0] for r in kept.collect()), key=lambda x: (x is None, x)) == expected


def test_rows_of_one_key_with_different_texts(spark):
    """Every text has its links, and all rows of a key are in one group."""
    rng = np.random.default_rng(5)
    a, b, c, d = (" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)) for _ in range(4))
    rows = [(7, a, "x"), (7, b, "x"), (2, a + " more", "x"), (3, b + " more", "x"), (4, c, "x"), (5, c + " x", "x"), (9, d, "x"), (9, d, "x"), (8, None, "x"), (8, d + " y", "x"), (None, a, "x"), (6, "", "x")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = sorted(((r["doc_id"], r["class_id"], r["n_shingles"]) for r in near_duplicates(docs).collect()), key=str)
    want = [(7, 2, 56), (7, 2, 56), (2, 2, 57), (3, 2, 57), (4, 4, 56), (5, 4, 57), (9, 8, 56), (9, 8, 56), (8, 8, 0), (8, 8, 57), (None, None, 56), (6, 6, 0)]
    assert found == sorted(want, key=str)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    first = min((None, d + " y"), key=lambda t: "" if t is None else hashlib.sha256(t.encode()).hexdigest())
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(2, a + " more", "x"), (4, c, "x"), (8, first, "x"), (None, a, "x"), (6, "", "x")], key=str)


@pytest.mark.parametrize("weight", ["set", "count"])
def test_coordinates_agree_as_weighted_jaccard(weight):
    rng = np.random.default_rng(2)
    words = [str(i) for i in range(300)]
    a = list(words) + list(rng.choice(words, 500))
    b = list(words[60:]) + ["x%d" % i for i in range(80)] + list(rng.choice(words[60:], 300))
    ea, wa = elements(" ".join(a), 1, weight)
    eb, wb = elements(" ".join(b), 1, weight)
    da, db = dict(zip(ea, wa)), dict(zip(eb, wb))
    true = sum(min(da.get(e, 0), db.get(e, 0)) for e in {*da, *db}) / sum(max(da.get(e, 0), db.get(e, 0)) for e in {*da, *db})
    s = signatures([(ea, wa), (eb, wb), (ea, wa)], 4000)
    assert np.isfinite(s).all() and (s[0] == s[2]).all()
    assert abs((s[0] == s[1]).mean() - true) < 0.04


def test_signature_of_a_text_does_not_depend_on_its_neighbours():
    sets = [elements(t, 5, "set") for t in ("a b c d e f g", "x", "", "p q r s t u v w " * 40)]
    whole = signatures(sets, 150)
    for i, s in enumerate(sets):
        assert (signatures([s], 150)[0] == whole[i]).all()
    assert np.isinf(whole[2]).all()


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0

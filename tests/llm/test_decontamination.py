import re

import pytest

from tapeflow.llm.decontamination import contamination, item_digest, without_items

DOCS = "doc_id long, text string, items string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, size):
    """Every window at every place, word by word."""
    split = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for doc_id, text, *_ in docs:
        words, hit, names = split(text), set(), set()
        for item_id, item in items:
            own = split(item)
            for w in [own[i : i + size] for i in range(max(1, len(own) - size + 1))] if own else []:
                for at in range(len(words) - len(w) + 1):
                    if words[at : at + len(w)] == w:
                        hit |= set(range(at, at + len(w)))
                        names |= {str(item_id)} - {"None"}
        out.append((doc_id, len(words), len(hit), len(names), item_digest(list(names)), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted([tuple(r)[:6] for r in df.collect()], key=str)


LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
CASES = [
    (1, f"before {LONG.upper()}, after {LONG}", "x"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "x"),
    (3, "alpha beta gamma delta epsilon zeta eta theta iota", "x"),
    (4, None, None),
    (5, "", ""),
    (6, "the the the the", "y"),
    (6, "the the the the", "y"),
    (None, "über-straße 12 ÜBER straße", "z"),
    (8, "word " * 20_000 + LONG, "z"),
    (9, "beta alpha", "z"),
]
ITEMS = [(1, LONG), (2, "the the"), (10, "über straße"), (3, None), (4, " ?! "), (5, "alpha"), (6, LONG), (1, "the the"), (1, LONG), (2, "word"), (None, "before alpha"), (None, None)]


@pytest.mark.parametrize("block", [1_000_000, 10, 30])
def test_equals_brute_force(spark, monkeypatch, block):
    """Repeated item keys are one item, rows without a key hit words and name no item, for any size of the blocks."""
    docs = spark.createDataFrame(CASES, DOCS).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(contamination(docs, items, block_words=block)) == brute(CASES, ITEMS, 10)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one two x three"), (2, "three two one"), (3, "one two three")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three")], "item_id long, text string")
    found = {r["doc_id"]: (r["n_near_items"], r["n_items"]) for r in contamination(docs, items, slop=1).collect()}
    assert found == {1: (1, 0), 2: (0, 0), 3: (1, 1)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs, items).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert rows(contamination(one, items)) == brute([(1, "a b")], [], 10)


def test_rows_that_hold_short_items_go(spark):
    items = [("a", "one two three four five"), ("b", " ".join(f"w{i}" for i in range(12))), ("c", None), ("d", "...")]
    texts = [(1, "zero One, two three four FIVE six"), (2, "one two three four"), (None, "x w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 y"), (None, "clean"), (3, "one two three four five"), (3, "clean too"), (4, None)]
    docs = spark.createDataFrame([(i, t, "") for i, t in texts], DOCS)
    found = without_items(docs, spark.createDataFrame(items, "item_id string, text string"))
    assert found.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=str) == sorted([texts[1], texts[3], texts[5], texts[6]], key=str)

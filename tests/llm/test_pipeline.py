import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tapeflow.llm.importance import fit, is_candidate, weigh
from tapeflow.llm.toxicity import toxicity
from tests.llm.test_decontamination import brute as hits
from tests.llm.test_near_dup import brute as classes

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_clean_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len((r["text"] or "").split()) >= 10]
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept.append(stage(spark, kept[-1], SF).cache())
        assert kept[-1].schema == docs.schema
    rows = [{r["doc_id"]: r["text"] for r in d.collect()} for d in kept]
    assert all(set(b) <= set(a) and all(a[i] == t for i, t in b.items()) for a, b in zip(rows, rows[1:]))
    gone = set(rows[0]) - set(rows[2])
    good = [i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(i in gone for i in good) <= 0.03 * len(good)
    by_class = classes([(i, t) for i, t in rows[2].items()])
    assert set(rows[3]) == {i for i, c in by_class.items() if i == c}
    assert set(rows[4]) == {h[0] for h in hits([(i, t) for i, t in rows[3].items()], items, 10) if not h[5]}
    table = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r["doc_id"] for r in toxicity(kept[0], table).collect() if r["predicted"]}
    assert set(rows[1]) == set(rows[0]) - toxic
    model = fit(kept[1], table)
    assert set(rows[2]) == {r["doc_id"] for r in weigh(kept[1], model).where(is_candidate(model)).collect()}
    coded = {r["doc_id"]: r for r in corpus_pipeline.encoding(spark, kept[4], SF).collect()}
    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    library.no_truncation()
    library.no_padding()
    assert set(coded) == set(rows[4])
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for i, text in rows[4].items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want = len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))
        assert (coded[i]["n_tokens"], coded[i]["ids_sha256"], coded[i]["decoded_sha256"]) == want


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_stages_with_null_keys_repeated_rows_and_long_texts(spark):
    """Every stage judges each row by its text: null keys and repeated rows as others, nulls in other columns as nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = [tuple(r) for r in docs.orderBy("doc_id").limit(60).collect()]
    odd = [(None, base[0][1], None, None, None), (None, None, "en", "x", 0), (None, "", None, "x", 0), base[1], base[1], (9_000_001, base[2][1] + " " + "filler words of no harm " * 40_000, "en", None, 1)]
    made = spark.createDataFrame(base + odd, docs.schema)
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, made, SF)
        assert kept.columns == docs.columns
        rows = [tuple(r) for r in kept.collect()]
        assert not set(rows) - set(base + odd), name
        same = lambda row: sum(r == row for r in rows)  # noqa: B023, E731
        if name == "near_duplicates":
            assert same(base[1]) <= 1 and same(odd[0]) == same(odd[1]) == same(odd[2]) == 1
        else:
            assert same(base[1]) in (0, 3)
            assert (same(odd[0]) > 0) == (base[0] in rows), name
    assert corpus_pipeline.encoding(spark, made, SF).count() == len(base + odd)

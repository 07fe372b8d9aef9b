import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from tapeflow.llm.bpe_automaton import MergeAutomaton, WordBpe, decode_documents, encode_digests, encode_documents
from tapeflow.llm.token_counts import PieceCounter, count_tokens

BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", "  ", "Hello World's don't I'LL x²½", "ÀÉ ΑΣ Σ İstanbul é", "<|endoftext|>foo<|startoftext|> <|end bar", "x\x1c\x1dy a b\u0085c d", "日本語テスト 😀😀", "12345 _-_--!!!", "a" * 3000, "the " * 2000, " lead", "trail ", "a  b   c", "\n\n\t", "▁▁a b", "<s> </s> <0x0A>", "ab" * 300 + " " * 50 + "x",
]


def texts(n=300):
    rng = random.Random(11)
    letters = list("abcdefghijklmnopqrstuvwxyz") + list("aaeeiioo'’!?.,éß日😀12  \n▁<>|")
    return TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(n)]


def test_automaton_accepts_encodings_only():
    vocab = {s: i for i, s in enumerate(["a", "b", "ab", "aa", "aab"])}
    merges = [("a", "b"), ("a", "a"), ("a", "ab")]
    auto = MergeAutomaton(vocab, merges)

    def encode(word):
        parts = list(word)
        for u, v in merges:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (u, v):
                    parts[i : i + 2] = [u + v]
                i += 1
        return parts

    def accepted(path):
        state = 0
        for t in path:
            if not auto.has_arc(state, vocab[t]):
                return False
            state = auto.target.get(vocab[t], 0)
        return True

    def paths(word):
        if not word:
            yield []
        for t in vocab:
            if word.startswith(t):
                yield from ([t, *rest] for rest in paths(word[len(t) :]))

    for n in range(1, 8):
        for k in range(2**n):
            word = "".join("ab"[k >> i & 1] for i in range(n))
            assert [p for p in paths(word) if accepted(p)] == [encode(word)]


def test_bpe_equals_library():
    own, library = WordBpe(BPE), tokenizers.Tokenizer.from_file(BPE)
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_counts_equal_library():
    own, library = PieceCounter(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for t in texts():
        assert own.count(t) == len(library.encode(t)), t
    assert own.merge_long("▁" + "ab" * 200) == own.merge("▁" + "ab" * 200)


@pytest.fixture
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(900, None, "x"), (None, "a b", "x"), (3, TEXTS[3], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)


def test_tables(docs):
    library = tokenizers.Tokenizer.from_file(BPE)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = encode_digests(docs, BPE).collect()
    assert len(found) == len(TEXTS) + 3
    for r in found:
        text = {900: "", None: "a b"}.get(r["doc_id"]) if r["doc_id"] in (900, None) else TEXTS[r["doc_id"]]
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    back = decode_documents(encode_documents(docs, BPE), BPE).where("doc_id = 2").first()
    assert back["decoded"] == library.decode(library.encode(TEXTS[2]).ids, skip_special_tokens=False)
    counted = {r["doc_id"]: r for r in count_tokens(docs, PIECES, limit=100).collect()}
    assert counted[900]["n_bytes"] == counted[900]["n_tokens"] == 0 and counted[9]["over_limit"] and counted[6]["n_bytes"] == len(TEXTS[6].encode())
    assert encode_digests(docs.limit(0), BPE).count() == count_tokens(docs.limit(0), PIECES).count() == 0

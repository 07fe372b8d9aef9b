"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens.  It starts as one state with a loop for every base symbol and gets one merge gadget for each
merge (u, v) -> w, in rank order: a copy of the state that u leads to, without the arc v, becomes u's new target; the new
arc w leaves every state that u leaves and leads to where v led.  Every token so has one target state, and a state differs
from the one it was copied from by one missing arc, so the automaton is kept as those missing arcs: as many as merges.
A word's encoding is the only path through it that spells the word.

Words are read by table-driven transitions: the product of the automaton with a trie of the token strings is made
deterministic state by state as texts need it, and each (state, symbol) is looked up in one table from then on.  Every
prefix of a word has one encoding, so each state knows the last token of the prefix read, and the path is traced back
from the word's end.  Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import regex
from pyspark.sql import DataFrame

from .common import mapped, worker_cache

#: Transitions and cached words that a Python worker keeps; beyond that it starts its tables anew.
MOST_TRANSITIONS, MOST_WORDS = 500_000, 60_000


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeAutomaton:
    """The automaton of a merge list; tokens and states are integers, state 0 is the start."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.target: dict[int, int] = {}  # token -> state; 0 unless a gadget redirected it
        self.parent, self.missing, self.born = [0], [-1], [-1]  # of states
        self.left: dict[int, int] = {}  # merged token -> its left part
        self.made: dict[int, int] = {}  # merged token -> the gadget that made it
        self._memo: dict[tuple[int, int], bool] = {}
        for k, (u, v) in enumerate(merges):
            self._gadget(k, vocab[u], vocab[v], vocab[u + v])

    def _gadget(self, k: int, u: int, v: int, w: int) -> None:
        if w in self.made:  # a second way to make w can't fire: the first keeps its parts apart
            self._forbid(k, u, v)
            return
        self.left[w], self.made[w] = u, k
        after_v = self.target.get(v, 0)
        self._forbid(k, u, v)
        self.target[w] = after_v

    def _forbid(self, k: int, u: int, v: int) -> None:
        self.parent.append(self.target.get(u, 0))
        self.missing.append(v)
        self.born.append(k)
        self.target[u] = len(self.parent) - 1

    def has_arc(self, state: int, token: int) -> bool:
        """Whether token leaves state: an arc that a gadget added is there if its left part's arc was there then."""
        key = (state, token)
        if (known := self._memo.get(key)) is not None:
            return known
        found = True
        while state:
            if self.made.get(token, -1) >= self.born[state]:
                token = self.left[token]
            elif self.missing[state] == token:
                found = False
                break
            else:
                state = self.parent[state]
        if len(self._memo) > 150_000:
            self._memo.clear()
        self._memo[key] = found
        return found


class WordEncoder:
    """Table-driven encoder of single words.

    A word is a sequence of symbol numbers below 512; names[i] is the vocabulary entry that symbol i stands for.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], names: list[str]):
        self.automaton = MergeAutomaton(vocab, merges)
        self.spelled: dict[int, tuple[int, ...]] = {vocab[s]: (i,) for i, s in enumerate(names) if s in vocab}
        for u, v in merges:
            self.spelled.setdefault(vocab[u + v], self.spelled[vocab[u]] + self.spelled[vocab[v]])
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, symbols in self.spelled.items():
            node = 0
            for s in symbols:
                if s not in self.trie[node]:
                    self.trie[node][s] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                node = self.trie[node][s]
            self.token_at[node] = token
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple[int, ...], int] = {}
        self.members: list[tuple[int, ...]] = [(0,)]  # of a state: trie node and automaton state of each open token
        self.last: list[int] = [-1]  # of a state: the last token of what was read
        self.table: dict[int, int] = {}  # state and symbol -> state

    def _transition(self, state: int, symbol: int) -> int:
        kept, emitted, trie = [], -1, self.trie
        for member in self.members[state]:
            child = trie[member >> 20].get(symbol)
            if child is None:
                continue
            after = member & 0xFFFFF
            if trie[child]:
                kept.append(child << 20 | after)
            token = self.token_at[child]
            if token >= 0 and emitted < 0 and self.automaton.has_arc(after, token):
                emitted = token
        if emitted < 0:
            raise ValueError(f"no token ends with symbol {symbol}")
        kept.append(self.automaton.target.get(emitted, 0))
        key = (emitted, *kept)
        if (found := self.states.get(key)) is None:
            found = self.states[key] = len(self.members)
            self.members.append(key[1:])
            self.last.append(emitted)
        self.table[state << 9 | symbol] = found
        return found

    def encode(self, symbols) -> list[int]:
        if len(self.table) > MOST_TRANSITIONS:
            self._reset()
        state, path, step, last = 0, [], self.table.get, self.last
        for s in symbols:
            state = step(state << 9 | s) or self._transition(state, s)
            path.append(last[state])
        out, i, spelled = [], len(path), self.spelled
        while i:
            token = path[i - 1]
            out.append(token)
            i -= len(spelled[token])
        out.reverse()
        return out


class WordBpe:
    """A tokenizers file of byte-level BPE with word ends, compiled; decoding joins arc labels by one space."""

    #: Fixed value: the split pattern of such files.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end = model["end_of_word_suffix"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        letters = byte_letters()
        self.encoder = WordEncoder(model["vocab"], merges, [letters[b] for b in range(256)] + [letters[b] + end for b in range(256)])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        self.words = regex.compile(self.SPLIT)
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")")
        self.known, self.older = _Words(self), {}

    def word(self, word: str) -> list[int]:
        """Ids of one pre-split word; its last byte is the symbol that closes words."""
        symbols = word.encode("utf-8", "surrogatepass")
        return self.encoder.encode([*symbols[:-1], symbols[-1] | 256])

    def parts(self, text: str) -> list[str]:
        """Pre-split words and the special strings between them, which are single tokens."""
        out: list[str] = []
        for part in self.specials.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(part)
            else:
                # Letters are lower-cased one by one, so a final capital sigma is no exception.
                plain = part.lower() if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += self.words.findall(plain)
        return out

    def joined(self, text: str) -> tuple[str, str]:
        """Ids and arc labels of a text, each joined by one space."""
        if len(self.known) > MOST_WORDS:
            self.older = dict(self.known)
            self.known.clear()
        found = list(map(self.known.__getitem__, self.parts(text)))
        return (" ".join([a for a, _ in found]), " ".join([b for _, b in found]))

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.joined(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.labels[i] for i in ids])


class _Words(dict):
    """word -> (ids, labels), both joined by spaces; the words of the time before are kept until the next turn."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe

    def __missing__(self, word: str) -> tuple[str, str]:
        bpe = self.bpe
        if (found := bpe.older.get(word)) is None:
            # The pattern yields no special string: its letters and its brackets are matched apart.
            ids = [bpe.special[word]] if word in bpe.special else bpe.word(word)
            found = (" ".join(map(str, ids)), bpe.decode(ids))
        if len(word) <= 64:
            self[word] = found
        return found


def loaded(path: str) -> WordBpe:
    """One compiled automaton for each Python worker."""
    return worker_cache(f"bpe {path}", lambda: WordBpe(path))


def encode_documents(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the column `out`, array<int>: the ids of `text`.  Null texts give no ids.  No shuffle."""
    from pyspark.sql import functions as F

    @F.pandas_udf("array<int>")
    def ids(texts):
        import pandas as pd

        bpe = loaded(path)
        return pd.Series([bpe.encode(t or "") for t in texts])

    return docs.withColumn(out, ids(F.col(text)))


def decode_documents(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the column `out`: the arc labels of `ids`, joined by one space."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def texts(rows):
        import pandas as pd

        bpe = loaded(path)
        return pd.Series(["" if r is None else bpe.decode(list(r)) for r in rows])

    return docs.withColumn(out, texts(F.col(ids)))


def encode_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of every row, encoded and decoded in one pass without a shuffle.

    Null texts count as empty.  Ids are joined by one space for the digest; labels are those of decode_documents.
    """

    def make(batch):
        bpe = loaded(path)
        n, ids_sha, out_sha = [], [], []
        for t in batch.column("text").to_pylist():
            ids, labels = bpe.joined(t or "")
            n.append(ids.count(" ") + 1 if ids else 0)
            ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
            out_sha.append(hashlib.sha256(labels.encode("utf-8", "surrogatepass")).hexdigest())
        return {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": out_sha}

    rows = docs.selectExpr(f"`{key}` AS doc_id", f"`{text}` AS text")
    found = mapped(rows, "text", make, "doc_id long,n_tokens long,ids_sha256 string,decoded_sha256 string")
    return found.withColumnRenamed("doc_id", key)

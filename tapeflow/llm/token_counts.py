"""Token counts of a SentencePiece BPE model by the whole-token shortcut.

Offline, every vocabulary string is merged by itself: those that end as one token are proven whole, so a pre-token that
equals one of them counts as one without any merge.  Only the other pre-tokens are merged, once for each worker's cache.
A merge never joins a symbol to a space that follows it, as no piece holds one inside, so pre-tokens (spaces, then what
stands before the next space) are counted apart.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .common import mapped, worker_cache

SPACE = "▁"
MOST_WORDS = 400_000


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a .model file, by the library's own reader."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces and model.trainer_spec.byte_fallback):
        raise ValueError("only models of identity normalization with a dummy prefix and byte fallback are counted here")
    return [(p.piece, p.score, p.type) for p in model.pieces]


class PieceCounter:
    """Counts tokens of texts; ranks: piece -> place in merge order (the best score first)."""

    NORMAL = 1

    def __init__(self, path: str):
        normal = [(p, s) for p, s, kind in read_pieces(path) if kind == self.NORMAL]
        if any(SPACE in p.lstrip(SPACE) for p, _ in normal):
            raise ValueError("a piece holds a space after other symbols: pre-tokens can't be counted apart")
        self.ranks = {p: -s for p, s in normal}
        self.letters = {p for p in self.ranks if len(p) == 1}
        self.joins = {c for p in self.ranks if len(p) > 1 for c in p}  # symbols that merges can touch
        self.whole = frozenset(p for p in self.ranks if len(self.merge(p)) == 1)
        self.known = _Counts(self)
        self.runs = re.compile(r" *[^ ]+| +")

    def merge(self, text: str) -> list[str]:
        """Symbols of a pre-token after all merges: the best pair first, the leftmost of equals."""
        parts, rank, never = list(text), self.ranks.get, float("inf")
        pairs = [rank(a + b, never) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == never:
                break
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], never)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], never)
        return parts

    def _length(self, parts: list[str]) -> int:
        return sum(1 if len(p) > 1 or p in self.letters else len(p.encode("utf-8", "surrogatepass")) for p in parts)

    def pre_token(self, text: str) -> int:
        """Tokens of one pre-token, spaces escaped; long ones are cut where no merge can reach across."""
        if text in self.whole:
            return 1
        if len(text) <= 32:
            return self._length(self.merge(text))
        n, start = 0, 0
        for i, c in enumerate(text):
            if c not in self.joins:
                n += self._long(text[start:i]) + self._length([c])
                start = i + 1
        return n + self._long(text[start:])

    def _long(self, text: str) -> int:
        if text in self.whole:
            return 1
        return self._length(self.merge(text)) if len(text) <= 200 else self._length(self.merge_long(text))

    def merge_long(self, text: str) -> list[str]:
        """merge() with a heap, for pre-tokens of any length."""
        import heapq

        parts: list[str | None] = list(text)
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) < 0 or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j], after[i] = joined, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a] + parts[b]))
        return [p for p in parts if p is not None]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return sum(map(self.known.__getitem__, [x[1:] if x[:1] == " " else x for x in self.runs.findall(" " + text)]))
        return sum(map(self.known.__getitem__, text.split(" ")))


class _Counts(dict):
    """pre-token without its first space -> tokens."""

    def __init__(self, counter: PieceCounter):
        self.counter = counter

    def __missing__(self, word: str) -> int:
        n = self.counter.pre_token(SPACE + word.replace(" ", SPACE))
        if len(word) <= 64:
            self[word] = n
        return n


def loaded(path: str) -> PieceCounter:
    """One counter for each Python worker."""
    return worker_cache(f"pieces {path}", lambda: PieceCounter(path))


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row.

    Null and empty texts have 0 bytes and 0 tokens.  Rows stay where they are; nothing is shuffled.
    """

    def make(batch):
        counter = loaded(path)
        texts = batch.column("text").to_pylist()
        n = [counter.count(t or "") for t in texts]
        return {"doc_id": batch.column("doc_id"), "n_bytes": [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    rows = docs.selectExpr(f"`{key}` AS doc_id", f"`{text}` AS text")
    return mapped(rows, "text", make, "doc_id long,n_bytes long,n_tokens long,over_limit boolean").withColumnRenamed("doc_id", key)

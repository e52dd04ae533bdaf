"""Token counts by byte-pair merging with a heap over a linked list; no ids are made.

A text becomes symbols (its characters, after the model's space rules). A heap holds
adjacent pairs by rank of the piece they would form, then by place; the lowest is popped
again and again, its two symbols are linked into one, and the new neighbours are pushed.
The count is the initial symbols minus the merges, where a symbol outside the vocabulary
counts as its UTF-8 bytes.

If no piece holds a space mark after another character, no merge crosses the start of a
word, so a text is the sum of its words; counts of words are kept in a bounded memo of
the Python worker. This is checked for the model, and without it whole texts are merged.

Cases: null is counted as empty; an empty text has no tokens. Special strings in a text
are ordinary text, as are unpaired surrogates' replacements. Repeated rows and null
doc_ids are counted one by one. Columns other than those named are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, pick, quoted

LIMIT = 4096
SPACE = "▁"
#: Words in each of the two generations of counts that a Python worker remembers. When the
#: young one is full it becomes the old one, and words still in use move back on use.
MEMO = 600_000
#: Longer words are counted but not remembered.
MEMO_LENGTH = 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCounter:
    """Counts tokens of texts for a SentencePiece BPE model given as bytes."""

    def __init__(self, model: bytes, memo: int = MEMO):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_proto=model)
        sp = self.own
        self.rank: dict[str, float] = {}
        single = set()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
                continue
            self.rank[piece] = -sp.get_score(i)
            if len(piece) == 1:
                single.add(piece)
        self.single = single
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.rank)
        self.memo: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.most = memo

    def merged(self, symbols: str) -> int:
        """Tokens of a run of symbols: initial ones minus merges, by heap and linked list."""
        n = len(symbols)
        rank, single = self.rank, self.single
        tokens = n
        if not all(c in single for c in symbols):
            tokens = sum(1 if c in single else len(c.encode("utf-8", "replace")) for c in symbols)
        if n < 2:
            return tokens
        whole = rank.get(symbols) if n == 2 else None
        if whole is not None:
            return tokens - 1
        piece = list(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            pair = piece[i] + piece[i + 1]
            r = rank.get(pair)
            if r is not None:
                heap.append((r, i, pair))
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            left = piece[i]
            if not left:
                continue
            j = after[i]
            if j >= n or len(left) + len(piece[j]) != len(pair) or left + piece[j] != pair:
                continue
            piece[i], piece[j] = pair, ""
            after[i] = k = after[j]
            tokens -= 1
            if k < n:
                before[k] = i
                new = pair + piece[k]
                r = rank.get(new)
                if r is not None:
                    heapq.heappush(heap, (r, i, new))
            h = before[i]
            if h >= 0:
                new = piece[h] + pair
                r = rank.get(new)
                if r is not None:
                    heapq.heappush(heap, (r, h, new))
        return tokens

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.by_word:
            return self.merged(marked)
        # A word begins at a space mark that follows another character.
        if len(self.memo) > self.most:
            self.memo, self.old = {}, self.memo
        memo, old = self.memo, self.old
        total, lead = 0, 0
        parts = marked.split(SPACE)
        last = len(parts) - 1
        for at, part in enumerate(parts[1:], 1):
            lead += 1
            if not part and at < last:
                continue
            word = part if lead == 1 else SPACE * (lead - 1) + part
            lead = 0
            n = memo.get(word)
            if n is None:
                n = old.get(word)
                if n is None:
                    n = self.merged(SPACE + word)
                if len(word) <= MEMO_LENGTH:
                    memo[word] = n
            total += n
        return total


def worker_counter(model: bytes) -> PieceCounter:
    """This Python worker's counter for a model, kept for its later tasks."""
    import sys
    import types

    name = "_vozmark_token_counters"
    held = sys.modules.setdefault(name, types.ModuleType(name))
    if getattr(held, "model", None) != model:
        held.model, held.counter = model, PieceCounter(model)
    return held.counter


def count_tokens(docs: DataFrame, model_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit of the whole text; columns of these names
    that are there already are replaced.

    The model's file is read on the driver and travels with the function.
    """
    with open(model_path or default_model(), "rb") as file:
        model = file.read()

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = worker_counter(model)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    new = ["n_bytes", "n_tokens", "over_limit"]
    rows = carried(docs, new, text="string").select("row", F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.select(
        "row", F.octet_length("text").cast("long").alias("n_bytes"), tokens("text").alias("n_tokens")
    )
    own = [c for c in docs.columns if c.lower() not in new]
    return counted.select(
        *[F.col(f"row.{quoted(c)}") for c in own], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def op2_token_count(docs: DataFrame) -> DataFrame:
    return count_tokens(pick(docs, doc_id="long", text="string")).drop("text")

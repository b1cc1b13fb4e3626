"""Token counts by heap-and-linked-list byte-pair merging, and fast token ids for packing.

Both work on whole texts. A text is cut where its tokenizer can never merge across, each piece is
looked up in a bounded cache, and only new pieces are computed.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import kept, pieces, text_batches

#: Pieces that a cache generation keeps, and the longest piece (characters) that it keeps.
CACHE_PIECES, CACHE_CHARS = 400_000, 64
#: The pre-tokens of byte-level BPE; fixed value of the public GPT-2 vocabulary.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


class Cache(dict):
    """A dict that computes what it lacks; the last two generations of at most `most` pieces stay."""

    def __init__(self, make, most: int = CACHE_PIECES):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def byte_alphabet() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in plain}
    shown |= {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}
    return [shown[b] for b in range(256)]


class MergeCounter:
    """Counts tokens as initial symbols minus merges; token ids are never emitted.

    path: a byte-level BPE file of the tokenizers library (no normalizer, no prefix space).
    """

    UNSURE = 1 << 40

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names: dict[str, int] = {}
        number = lambda s: names.setdefault(s, len(names))
        self.first = [number(c) for c in byte_alphabet()]
        #: left and right symbol, packed in one int -> rank; made[rank] is the merged symbol
        self.ranks, self.made = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[number(a) << 20 | number(b)] = rank
            self.made.append(number(a + b))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.words = regex.compile(PRETOKEN)
        self.pretokens = Cache(self.merged)
        self.head = Cache(self.segment)
        self.rest = Cache(lambda p: self.segment(" " + p) if p else self.UNSURE)

    def merged(self, word: str) -> int:
        """Tokens of one pre-token: a heap of adjacent pairs by (rank, place) over a doubly linked list."""
        first, ranks, made = self.first, self.ranks.get, self.made
        sym = [first[b] for b in word.encode()]
        n = len(sym)
        if n < 2:
            return n
        rank = [ranks(a << 20 | b, -1) for a, b in zip(sym, sym[1:])]  # of the pair that starts at each place
        heap = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
        if not heap:
            return n
        rank.append(-1)
        heapify(heap)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        merges = 0
        while heap:
            x = heappop(heap)
            i, r = x & 0xFFFFFFFF, x >> 32
            if rank[i] != r:
                continue  # one of the two has been merged since
            merges += 1
            a = sym[i] = made[r]
            j = right[i]
            rank[j] = -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                r = rank[i] = ranks(a << 20 | sym[k], -1)
                if r >= 0:
                    heappush(heap, r << 32 | i)
            else:
                rank[i] = -1
            h = left[i]
            if h >= 0:
                r = rank[h] = ranks(sym[h] << 20 | a, -1)
                if r >= 0:
                    heappush(heap, r << 32 | h)
        return n - merges

    def segment(self, text: str) -> int:
        """Tokens of any text, pre-token by pre-token; a special token's string is one token."""
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.segment, parts))
        return sum(map(self.pretokens.__getitem__, self.words.findall(text)))

    def count(self, text: str) -> int:
        """Tokens of a whole text. Pre-tokens never span a blank's left side unless blanks are adjacent or end the text, which then goes whole."""
        parts = text.split(" ")
        total = self.head[parts[0]] + sum(map(self.rest.__getitem__, parts[1:]))
        return total if total < self.UNSURE else self.segment(text)


def counter(path: str) -> MergeCounter:
    """One counter for each Python worker."""
    return kept(f"counter {path}", lambda: MergeCounter(path))


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row's whole text, by the byte-level BPE file at path.

    Null text counts as empty (0 tokens, not over the limit); a null id stays null; repeated rows are
    each counted; an empty table gives no rows; other columns of df are not read. path must be
    readable on every executor.
    """
    spark = df.sparkSession
    text_batches(spark)
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def op(batches):
        count = counter(path).count
        for batch in pieces(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = np.fromiter(map(count, texts), np.int64, len(texts))
            sizes = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(op, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")

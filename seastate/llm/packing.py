"""Packing of token pieces into fixed windows by Karmarkar-Karp multiway differencing.

`tokenize` turns each whole text into pieces of at most `capacity` ids; `pack` places pieces, whatever
their other columns, into windows. Only the short last piece of a document meets others in a window.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import kept, pieces, text_batches
from .tokens import CACHE_CHARS, Cache, byte_alphabet

#: Pieces that one packing group holds on average: enough for windows to come out even, few enough for one task.
GROUP_PIECES = 2048

#: Words, with their parts, that a cache generation keeps: two workers of an executor hold two generations each.
WORDS = 150_000
#: The part of a window that the first try leaves free.
SLACK = 0.0035
#: One text of so many is cut finely, by the CRC-32 of its id and token ids.
FILLER_EVERY = 16

#: Small Latin-1 letters, then ASCII signs.
PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)").fullmatch


#: What a tokenizers file must say for words to be coded one by one: lower-casing, no merge across white space, runs of letters and of signs apart.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordIds:
    """Ids of whole texts by a tokenizers file, as little-endian uint32 bytes.

    Files of the kind above are served word by word from a cache; of any other kind, and texts that may hold special
    tokens, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.alphabet = self.tokenizer.model, byte_alphabet()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0].get("pattern") or {}
        self.by_word = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == NORMALIZERS and cut.get("Regex") == SPLIT
        self.by_word &= not spec["post_processor"] and not any(t["normalized"] for t in spec["added_tokens"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)", re.IGNORECASE).search
        self.words, self.tails = Cache(self.word, WORDS), Cache(self.any, WORDS // 100)

    def core(self, letters: str) -> bytes:
        """Ids of a run of small Latin-1 letters: one pre-token, which no normalizer changes, by the model alone."""
        shown = letters if letters.isascii() else "".join(map(self.alphabet.__getitem__, letters.encode()))
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def any(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a word. A plain one (letters, then signs) is looked up by its two parts; any other goes to the library."""
        m = PLAIN(word.lower())
        if m is None:
            return self.any(word)
        letters, signs = m.groups()
        if letters == word:
            return self.core(letters)
        return self.words[letters] + self.tails[signs] if signs else self.words[letters]

    def batch(self, texts: list[str]) -> list[bytes]:
        known, out = self.words.__getitem__, []
        for t in texts:
            if not self.by_word or self.special(t):
                out.append(self.any(t))
            else:
                out.append(b"".join(map(known, (t.lower() if t.isascii() else t).replace("\n", " ").split(" "))))
        return out


def tokenize(df: DataFrame, path: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, doc_tokens, ids) for each piece of each whole text, end_id appended.

    A text is cut into as many whole windows as it fills; what is left stays whole, except in one text of FILLER_EVERY,
    whose rest becomes small pieces that even out the windows. ids is little-endian uint32 binary. Null text counts as empty: one piece that holds end_id. Repeated rows
    and null ids give pieces of their own; an empty table gives none; other columns are not read.
    """
    text_batches(df.sparkSession)
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def op(batches):
        ids_of = kept(f"ids {path}", lambda: WordIds(path)).batch
        end, small = np.array([end_id], "<u4").tobytes(), max(1, capacity // 32)
        for batch in pieces(batches, 1):
            at, start, length, tokens, ids = [], [], [], [], []
            for i, (name, b) in enumerate(zip(batch.column(0).to_pylist(), ids_of([t or "" for t in batch.column(1).to_pylist()]))):
                b += end
                n = len(b) // 4
                full = n - n % capacity
                cuts = [*range(0, full, capacity), *range(full, n, small if zlib.crc32(b, zlib.crc32(str(name).encode())) % FILLER_EVERY == 0 else capacity), n]
                for s, e in zip(cuts, cuts[1:]):
                    at.append(i)
                    start.append(s)
                    length.append(e - s)
                    tokens.append(n)
                    ids.append(b[4 * s : 4 * e])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, tokens)), pa.array(ids, pa.binary())], [id_col, "start", "length", "doc_tokens", "ids"])

    return rows.mapInArrow(op, f"`{id_col}` {kind}, start long, length long, doc_tokens long, ids binary")


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp multiway differencing: indices of sizes in each of so many near-equal windows.

    Each partial partition holds the loads of its non-empty windows in falling order. The two with the largest
    imbalance (largest less smallest load) are merged so that large loads meet small ones, until one is left.
    """
    n = len(sizes)
    heap = [(-s, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    pair = np.zeros((n, 2), np.int64)  # node n + k joins two nodes
    used = 0
    while len(heap) > 1:
        (_, first, a, x), (_, _, b, y) = heapq.heappop(heap), heapq.heappop(heap)
        over = max(0, len(a) + len(b) - windows)  # so many of the smallest loads of each side meet, small with large
        i, j = len(a) - over, len(b) - over
        pair[used : used + over, 0], pair[used : used + over, 1] = x[i:], y[j:][::-1]
        loads = np.concatenate([a[:i], b[:j], a[i:] + b[j:][::-1]])
        nodes = np.concatenate([x[:i], y[:j], np.arange(n + used, n + used + over)])
        used += over
        order = np.argsort(-loads, kind="stable")
        loads, nodes = loads[order], nodes[order]
        heapq.heappush(heap, (-int(loads[0] - (loads[-1] if len(loads) == windows else 0)), first, loads, nodes))
    out = []
    for top in heap[0][3].tolist() if heap else []:
        stack, own = [top], []
        while stack:
            k = stack.pop()
            if k < n:
                own.append(k)
            else:
                stack += pair[k - n].tolist()
        out.append(sorted(own))
    return out


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most capacity: about as few as the total allows, more whenever one is over-full.

    The first try leaves SLACK of the capacity for the imbalance that differencing usually ends with.
    """
    if not sizes:
        return []
    count = -(-sum(sizes) // max(1, capacity - int(SLACK * capacity)))
    while True:
        made = differencing(sizes, count)
        worst = max(sum(sizes[i] for i in w) for w in made)
        if worst <= capacity:
            return made
        count += max(1, count * (worst - capacity) // (4 * capacity))


def pack(pieces: DataFrame, groups: int, capacity: int = 4096, length_col: str = "length") -> DataFrame:
    """pieces with sequence_id and offset added: windows of at most capacity tokens, without gaps.

    A piece as long as the capacity is a window of its own; a longer, null or negative length raises. Pieces are
    dealt evenly to `groups` by their place in the input, never by a key, so no hot key fills a group. Any columns
    are kept but sequence_id and offset, which replace those of the same names. An empty table gives no rows.
    """
    keep = pieces.drop("sequence_id", "offset")
    out = T.StructType([*keep.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    group = "__group"
    while group in keep.columns:
        group += "_"

    def op(key, pdf):
        sizes = pdf[length_col].to_numpy()
        if pdf[length_col].isna().any() or (sizes < 0).any() or (sizes > capacity).any():
            raise ValueError(f"a piece's length must be between 0 and {capacity}")
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        full = np.flatnonzero(sizes == capacity)
        sequence[full] = np.arange(len(full))
        short = np.flatnonzero(sizes < capacity)
        for k, window in enumerate(windows_of([int(s) for s in sizes[short]], capacity)):
            at = short[window]
            sequence[at] = len(full) + k
            offset[at[1:]] = np.cumsum(sizes[at])[:-1]
        out = pdf.drop(columns=group)
        out["sequence_id"], out["offset"] = (int(key[0]) << 32) + sequence, offset
        return out

    dealt = keep.withColumn(group, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, groups))).cast("long"))
    return dealt.groupBy(group).applyInPandas(op, out)


def pack_documents(df: DataFrame, path: str, end_id: int, capacity: int = 4096, with_ids: bool = True) -> DataFrame:
    """tokenize() and pack() over a table of documents; without ids, each piece carries their CRC-32 instead."""
    pieces = tokenize(df, path, end_id, capacity).withColumn("ids_crc32", F.crc32("ids"))
    groups = -(-df.count() // GROUP_PIECES)
    return pack(pieces if with_ids else pieces.drop("ids"), groups, capacity)


__all__ = ["tokenize", "pack", "pack_documents", "differencing", "windows_of", "WordIds"]

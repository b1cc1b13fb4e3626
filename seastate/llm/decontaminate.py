"""Benchmark decontamination: a BM25 inverted index of the benchmark's items, queried with every passage of the corpus.

Block-max WAND retrieves all items whose score reaches a part of the score that an item gets from itself; word
shingles then verify that the item occurs, its question and its answer both. The index, not the corpus, is broadcast,
in shards of a bounded size; document frequencies and lengths are those of all items, so shards don't change a score.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import kept, materialize, pieces, text_batches

K1, B = 1.2, 0.75
#: The part of its own score that an item must get from a passage.
THRESHOLD = 0.5
#: Words of a shingle, the part of an item's shingles that must occur, and the part of either its question's or its answer's.
SHINGLE, OVERLAP, EITHER = 5, 0.8, 0.5
#: Postings of a block; groups of items whose bounds are computed for all passages at once.
BLOCK, GROUPS = 8, 64
#: Characters of item text in one broadcast index at about, and its bytes at most.
SHARD_CHARS, INDEX_BYTES = 8_000_000, 512 << 20
WORDS = re.compile(r"\w+")
SENTENCE = re.compile(r"[.!:;]\s")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return WORDS.findall((text or "").lower())


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """An item's question and what follows, as words: cut behind the first question mark, else the first line, else the first sentence, else in the middle.

    Neither is empty if the text has two words; a text of one word is a question without an answer.
    """
    text = text or ""
    whole = words(text)
    for at in (text.find("?") + 1, text.find("\n") + 1, (SENTENCE.search(text) or re.search("$", text)).end()):
        question, answer = words(text[:at]), words(text[at:])
        if at and question and answer:
            return question, answer
    return whole[: -(-len(whole) // 2)], whole[-(-len(whole) // 2) :]


def shingle_hash(run: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(run).encode())


def shingles(w: list[str]) -> np.ndarray:
    """Distinct hashes of the runs of SHINGLE words; of fewer words of the whole; of none none."""
    return np.unique(np.array([shingle_hash(w[k : k + SHINGLE]) for k in range(max(1, len(w) - SHINGLE + 1))] if w else [], np.uint64))


class Statistics:
    """What BM25 takes from all items: their number, their mean length, and in how many of them each term stands."""

    def __init__(self, n: int, mean: float, frequency: dict[str, int]):
        self.n, self.mean, self.frequency = n, mean, frequency

    @classmethod
    def of(cls, texts: list[str | None]) -> "Statistics":
        own = [w for w in map(words, texts) if w]
        frequency: dict[str, int] = {}
        for w in own:
            for t in set(w):
                frequency[t] = frequency.get(t, 0) + 1
        return cls(len(own), sum(map(len, own)) / max(1, len(own)), frequency)

    def weight(self, term: str, count: int, length: int) -> float:
        f = self.frequency[term]
        return math.log(1 + (self.n - f + 0.5) / (f + 0.5)) * count * (K1 + 1) / (count + K1 * (1 - B + B * length / self.mean))


class Index:
    """Postings by term with impacts scaled so that an item scores 1 on itself, in blocks with their maxima, as flat arrays.

    Items are ordered by length class (the power of two that holds their words), so that each class is searched with
    passages of twice its length.
    """

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        statistics = statistics or Statistics.of([t for _, t in items])
        own = [(i, *question_and_answer(t)) for i, t in items]
        own = sorted(((self.length_class(len(q) + len(a)), i, q, a) for i, q, a in own if q), key=lambda x: (x[0], str(x[1]), x[2:]))
        n = len(own)
        self.items = [i for _, i, _, _ in own]
        #: by item: the words of its question and answer if they are too short for a shingle; the hashes of whole, question and answer
        self.short = {(k, p): tuple(w) for k, (_, _, *both) in enumerate(own) for p, w in enumerate(both) if 0 < len(w) < SHINGLE}
        self.hashes = [tuple(map(shingles, (q + a, q, a))) for _, _, q, a in own]
        self.vocabulary: dict[str, int] = {}
        rows: list[tuple[int, int, float]] = []
        for k, (_, _, q, a) in enumerate(own):
            counts: dict[str, int] = {}
            for w in q + a:
                counts[w] = counts.get(w, 0) + 1
            got = {self.vocabulary.setdefault(w, len(self.vocabulary)): statistics.weight(w, c, len(q) + len(a)) for w, c in counts.items()}
            whole = sum(got.values())
            rows += [(t, k, s / whole) for t, s in got.items()]
        terms = len(self.vocabulary)
        table = np.array(rows, np.float64).reshape(-1, 3)
        term, item = table[:, 0].astype(np.int64), table[:, 1].astype(np.int64)
        order = np.lexsort((item, term))
        term, self.ids, self.impacts = term[order], item[order].astype(np.int32), table[order, 2]
        self.start = np.searchsorted(term, np.arange(terms + 1))
        #: blocks of a term begin at its first posting; the largest impact of each, and of each term
        sizes = np.diff(self.start)
        self.first_block = np.concatenate([[0], np.cumsum(-(-sizes // BLOCK))])
        block = self.first_block[term] + (np.arange(len(term)) - self.start[term]) // BLOCK
        self.block_most, self.most = np.zeros(int(self.first_block[-1])), np.zeros(terms)
        np.maximum.at(self.block_most, block, self.impacts)
        np.maximum.at(self.most, term, self.impacts)
        # groups: equal runs of items within one class
        self.groups: list[tuple[int, int, int]] = []  # class, first item, end
        size = max(1, -(-n // GROUPS))
        k = 0
        while k < n:
            end = k
            while end < n and end < k + size and own[end][0] == own[k][0]:
                end += 1
            self.groups.append((own[k][0], k, end))
            k = end
        #: the largest impact of each term in each group; the last row is that of words without postings
        self.bounds = np.zeros((terms + 1, len(self.groups)), np.float32)
        np.maximum.at(self.bounds, (term, np.searchsorted([g[1] for g in self.groups], self.ids, "right") - 1), self.impacts.astype(np.float32))
        self.classes = [(c, own, np.ascontiguousarray(self.bounds[:, own])) for c in sorted({g[0] for g in self.groups}) for own in [[g for g, x in enumerate(self.groups) if x[0] == c]]]

    @staticmethod
    def length_class(n: int) -> int:
        return max(16, 1 << max(0, n - 1).bit_length())

    def search(self, terms: list[int], first: int, end: int, threshold: float) -> list[tuple[int, float]]:
        """(item, score) of all items in [first, end) that score at least threshold on distinct terms, by block-max WAND."""
        ids, lists = self.ids, []  # of each list: current item, place, term, end of the range
        for t in terms:
            low, high = int(self.start[t]), int(self.start[t + 1])
            a, b = bisect_left(ids, first, low, high), bisect_left(ids, end, low, high)
            if a < b:
                lists.append([int(ids[a]), a, t, b])
        found = []
        while lists:
            lists.sort(key=lambda x: x[0])
            total, pivot = 0.0, -1
            for j, x in enumerate(lists):
                total += self.most[x[2]]
                if total >= threshold - 1e-9:
                    pivot = j
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            # the blocks that may hold the pivot item bound its score more tightly
            bound, skip = 0.0, end
            for x in lists[: pivot + 1]:
                low, high = int(self.start[x[2]]), int(self.start[x[2] + 1])
                block = (x[1] - low) // BLOCK
                while low + (block + 1) * BLOCK < high and ids[low + (block + 1) * BLOCK - 1] < item:
                    block += 1
                bound += self.block_most[self.first_block[x[2]] + block]
                skip = min(skip, int(ids[min(low + (block + 1) * BLOCK, high) - 1]) + 1)
            if bound < threshold - 1e-9:
                target = max(item + 1, min(skip, lists[pivot + 1][0] if pivot + 1 < len(lists) else end))
                moved = lists[: pivot + 1]
            elif lists[0][0] == item:
                score = float(sum(self.impacts[x[1]] for x in lists[: pivot + 1]))
                if score >= threshold - 1e-9:
                    found.append((item, score))
                target, moved = item + 1, lists[: pivot + 1]
            else:
                target, moved = item, [x for x in lists[:pivot] if x[0] < item]
            for x in moved:
                x[1] = bisect_left(ids, target, x[1], x[3])
                x[0] = int(ids[x[1]]) if x[1] < x[3] else end
            lists = [x for x in lists if x[1] < x[3]]
        return found

    def overlaps(self, item: int, near: list[str], known: np.ndarray) -> tuple[float, float, float]:
        """The parts of an item's, its question's and its answer's shingles that occur in words `near` with shingle hashes `known`; no answer counts as there."""
        out = []
        for part, h in enumerate(self.hashes[item]):
            run = self.short.get((item, part - 1)) if part else None
            if run:
                out.append(float(any(tuple(near[k : k + len(run)]) == run for k in range(len(near) - len(run) + 1))))
            elif part == 0 and (item, 0) in self.short and len(h) == 1 and len(self.short[item, 0]) + len(self.short.get((item, 1), ())) < SHINGLE:
                out.append(1.0)  # shorter than a shingle: its parts decide
            else:
                out.append(float(np.isin(h, known).mean()) if len(h) else 1.0)
        return tuple(out)

    def passages(self, texts: list[list[str]], threshold: float):
        """(text, first word, passage's words, group) of all passages whose bound in a group reaches threshold.

        Passages overlap by half: in each class of length c, 2c words from every c-th one. Bounds of all passages come
        from sums over the known words of each c; a passage is worth no more than its two halves.
        """
        lookup, none = self.vocabulary.get, len(self.bounds) - 1
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.fromiter((lookup(w, none) for t in texts for w in t), np.int32, int(starts[-1]))
        known = np.flatnonzero(ids != none)
        text = np.searchsorted(starts, known, "right") - 1
        for c, own, bounds in self.classes:
            chunks = np.concatenate([[0], np.cumsum(-(-sizes // c))])
            chunk = chunks[text] + (known - starts[text]) // c
            pair = chunk * len(self.bounds) + ids[known]
            pair.sort()
            pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else pair  # a term counts once in a chunk
            if not len(pair):
                continue
            chunk, term = np.divmod(pair, len(self.bounds))
            first = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
            at = chunk[first]
            half = np.zeros((int(chunks[-1]) + 1, len(own)), np.float32)
            half[at] = np.add.reduceat(bounds[term], first, axis=0)
            both = half[:-1] + half[1:]
            last = chunks[1:][sizes > 0] - 1
            both[last] = half[last]  # a text's last chunk has no successor
            for p, j in zip(*np.nonzero(both >= threshold - 1e-4)):
                t = int(np.searchsorted(chunks, p, "right")) - 1
                k = int(p - chunks[t]) * c
                yield t, k, texts[t][k : k + 2 * c], own[j]


def leaks(docs: list[str | None], index: Index, threshold: float, overlap: float):
    """(document, item, first word of the passage, score, question and answer overlap) of each item that leaks into a document, by its best passage."""
    texts = [words(t) for t in docs]
    best: dict[tuple[int, int], tuple] = {}
    for t, k, passage, g in index.passages(texts, threshold):
        c, first, end = index.groups[g]
        terms = sorted({index.vocabulary[w] for w in passage if w in index.vocabulary})
        hits = index.search(terms, first, end, threshold)
        if not hits:
            continue
        near = texts[t][max(0, k - c) : k + 3 * c]  # words around the passage may hold an item's rim
        known = shingles(near)
        for item, score in hits:
            whole, *part = index.overlaps(item, near, known)
            if whole >= overlap and min(part) >= EITHER and ((t, item) not in best or (*part, score) > best[t, item][:3]):
                best[t, item] = (*part, score, k)
    for (t, item), (q, a, score, k) in sorted(best.items()):
        yield t, index.items[item], k, score, q, a


def _indexes(spark, items: DataFrame, item_col: str, item_text: str, shard_chars: int):
    """Broadcast indexes that hold all items, each about shard_chars characters and INDEX_BYTES at most."""
    own = items.select(F.col(item_col).alias("id"), F.col(item_text).alias("text"))
    total = own.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_chars))
    own = own.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(shards)))
    if shards == 1:
        frequency = None
    else:

        def count(batches):
            for batch in pieces(batches, 0):
                rows = [(s, t, len(w)) for text, s in zip(*(c.to_pylist() for c in batch.columns)) for w in [words(text)] for t in [None, *set(w)] if w]
                columns = list(zip(*rows)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["shard", "term", "length"])

        terms = materialize(spark, own.select("text", "shard").mapInArrow(count, "shard long, term string, length long"), "terms")
        n, length = terms.where("term is null").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()  # a row without a term for each item
        frequency = terms.where("term is not null").groupBy("term").agg(F.count("*").alias("n"))
    for k in range(shards):
        rows = [tuple(r) for r in own.where(F.col("shard") == k).select("id", "text").collect()]
        statistics = None
        if frequency is not None:
            here = terms.where((F.col("shard") == k) & F.col("term").isNotNull()).select("term").distinct()
            statistics = Statistics(n, length / max(1, n), {r["term"]: r["n"] for r in frequency.join(here, "term").collect()})  # the terms of one shard
        index = Index(rows, statistics)
        if len(pickle.dumps(index, 5)) > INDEX_BYTES:
            raise ValueError(f"an index of over {INDEX_BYTES} bytes: lower shard_chars")
        yield spark.sparkContext.broadcast(index)


def contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_chars: int = SHARD_CHARS, keep: list[str] | None = None) -> DataFrame:
    """(id, item, passage, score, question_overlap, answer_overlap): a row for each text of df and item that leaks into it.

    Whole texts are searched. A document of null or empty text leaks nothing, an item without a word is in nothing.
    Items with equal ids or texts are each reported; repeated documents get rows each. passage is the number of the
    first word of the best passage. The items are held in indexes of shard_chars characters; each is broadcast in turn,
    so their number doesn't matter for memory. keep: columns of df in place of the id; where they have one of the names
    above, the result's own column gets an underscore more.
    """
    spark = df.sparkSession
    text_batches(spark)
    keep = keep or [id_col]
    rows = df.select(F.col(text_col).alias("__text"), *keep)
    added = []
    for name in (item_col, "passage", "score", "question_overlap", "answer_overlap"):
        while name.lower() in {c.lower() for c in keep}:
            name += "_"
        added.append(name)
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    kind = items.schema[item_col].dataType.simpleString()
    arrow = to_arrow_type(items.schema[item_col].dataType)
    schema = f"{fields}, " + ", ".join(f"`{c}` {k}" for c, k in zip(added, (kind, "long", "double", "double", "double")))
    out = None
    for index in _indexes(spark, items, item_col, item_text, shard_chars):

        def op(batches, index=index):
            kept()
            for batch in pieces(batches):
                found = list(leaks(batch.column(0).to_pylist(), index.value, threshold, overlap)) if index.value.items else []
                columns = list(zip(*found)) or [()] * 6
                at = pa.array(columns[0], pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[1:]), pa.array(columns[1], arrow), pa.array(columns[2], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[3:])], [*keep, *added])

        part = rows.mapInArrow(op, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(df: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """The rows of df, with all columns, into whose text no item leaks. Nothing is shuffled.

    Rows of null or empty text stay, repeated rows stay or go together, an empty table gives no rows and an empty
    benchmark all; df's columns may have any names.
    """
    text_batches(df.sparkSession)
    place = df.columns.index(text_col)
    for index in _indexes(df.sparkSession, items, item_col, item_text, shard_chars):

        def op(batches, index=index):
            kept()
            for batch in pieces(batches, place):
                bad = {x[0] for x in leaks(batch.column(place).to_pylist(), index.value, threshold, overlap)} if index.value.items else set()
                yield batch.filter(pa.array([i not in bad for i in range(len(batch))], pa.bool_())) if bad else batch

        df = df.mapInArrow(op, df.schema)
    return df

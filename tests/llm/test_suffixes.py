"""Repeated strings against a count of all windows, and on odd tables."""

import collections
import random

import numpy as np
import pytest

from seastate.llm import suffixes
from seastate.llm.suffixes import Depth


def plain(texts, least):
    """(spans, kept) of each text by counting all windows."""
    texts = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[k : k + least] for t in texts for k in range(len(t) - least + 1))
    for t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - least + 1):
            if seen[t[k : k + least]] > 1:
                gone[k : k + least] = [True] * least
        spans = [k for k in range(len(t) + 1) if (k < len(t) and gone[k]) != (k > 0 and gone[k - 1])]
        yield list(zip(spans[::2], spans[1::2])), bytes(b for b, x in zip(t, gone) if not x)


def check(spark, texts, depth, more=()):
    rows = [*((k, t, "x") for k, t in enumerate(texts)), *more]
    df = spark.createDataFrame(rows, "doc_id long, text string, t string").repartition(5)
    got = [(str(x["doc_id"]), x["n_bytes"], [tuple(s) for s in x["spans"]], bytes(x["kept"])) for x in suffixes.remove_repeats(df, depth=depth).collect()]
    want = [(str(k), len((t or "").encode()), *own) for (k, t, _), own in zip(rows, plain([t for _, t, _ in rows], depth.least))]
    assert sorted(got) == sorted(want)
    return df


@pytest.mark.parametrize(("depth", "letters"), [(Depth(12, 4, 3, 64), "ab"), (Depth(20, 8, 5, 50), "abcé"), (Depth(9, 9, 9, 40), "ab "), (Depth(30, 1, 7, 4096), "abcdefgh")])
def test_against_all_windows(spark, depth, letters):
    """Short alphabets repeat by chance, and by period; passages are shared at both ends, inside one text and across buffers."""
    r = random.Random(depth.least)
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    shared = [word(depth.least + k) for k in (-1, 0, 1, 7, 60)]
    texts = [word(r.randint(0, 5 * depth.least)) for _ in range(40)]
    texts += [word(r.randint(0, 40)) + r.choice(shared) + word(r.randint(0, 40)) for _ in range(40)]
    texts += ["a" * 200, "ab" * 70, word(7) * 30, shared[4] + word(3) + shared[4], shared[4], shared[4] + shared[3] + shared[2], word(700)]
    texts += [texts[-1][:300] + "z" + texts[-1][301:], texts[-1][:-1], None, "", "é" * 60, "🙂" * 9]
    check(spark, texts, depth, [(None, texts[3], "x"), (5, texts[3], "x"), (7, "alone", "x"), (None, None, "x")])


def test_at_the_threshold(spark):
    """400 bytes and 399, edits inside long passages, copies, a text over many buffers."""
    r = random.Random(1)
    prose = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))
    line, base = prose(200)[:400], prose(900)
    texts = [prose(30) + line + prose(30) for _ in range(5)] + [prose(30) + line[:399] + "#" + prose(20), "#" + line[1:], line[1:] + "#", prose(100), base, base, base[:2000] + "#" + base[2001:], prose(400) + base[100:700]]
    df = check(spark, [*texts, prose(9000) + line + prose(200)], Depth(buffer=8192))
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_window_minima():
    r = np.random.default_rng(1)
    for n, width in ((1, 1), (9, 4), (12, 4), (13, 13), (50, 7)):
        keys = r.integers(0, 1 << 62, n).astype(np.uint64)
        assert suffixes.window_minima(keys, width).tolist() == [keys[k : k + width].min() for k in range(n - width + 1)]


def test_gram_hashes_depend_on_content_alone():
    raw = np.frombuffer(b"xxabcabcabc\0\0\0\0abc", np.uint8)
    h = suffixes.gram_hashes(raw, 3, suffixes.powers(64))
    grams = [raw[k : k + 3].tobytes() for k in range(len(raw) - 2)]
    assert len(set(h.tolist())) == len(set(grams)) and all((h[i] == h[k]) == (grams[i] == grams[k]) for i in range(len(grams)) for k in range(i))

"""The audit of filters against plain Python, and on odd tables."""

import itertools
import random
import re

from seastate.llm import audit


def fails(rows):
    """The letters that each (id, text) fails."""
    for k, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        own["E"] = k is not None and any(j is not None and j < k and (t or "") == text for j, t in rows)
        yield {x for x in own if own[x]}


def letters(bits):
    return {x for x in audit.LETTERS if bits & audit.BIT[x]}


def table(spark):
    """Null and empty texts, null ids and sources, long texts that differ in one sign, copies, repeated rows, clashing columns."""
    r = random.Random(3)
    prose = lambda n, odd="": " ".join(["".join(r.choice("abcdefg") for _ in range(5)) for _ in range(n)] + [odd])
    long = [prose(k) for k in (40, 200, 201, 900, 9000)]
    texts = [None, "", " \t\x0b", "É" * 300, "\x1c a\x1d\x85b", "A" * 3, "x | y", *long, *(t[:-9] + "#" + t[-8:] for t in long), *(t[:300] + "é" + t[301:] for t in long)]
    texts += [prose(250), "a b " * 300, prose(220, "X" * 200), *long, long[0], long[0], None, " "]
    rows = [(k, t, f"s{k % 3}" if k % 7 else None, 1) for k, t in enumerate(texts)]
    rows += [(None, long[1], "s0", 1), (None, "alone", "s0", 1), (None, "alone", "s1", 1), rows[8], rows[8], (9, long[0], "s2", 1), (5, long[2], "", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, class int").repartition(5)


def test_marked(spark):
    rows, df = table(spark)
    got = sorted((str(x["id"]), x["part"], sorted(letters(x["fails"]))) for x in audit.marked(df).collect())
    assert got == sorted((str(k), s or "", sorted(f)) for (k, _, s, _), f in zip(rows, fails([x[:2] for x in rows])))
    assert audit.marked(df.limit(0)).count() == 0


def test_texts_decide_where_hashes_do_not(spark):
    """With a first seed that tells nothing apart but lengths."""
    rows, df = table(spark)
    weak = lambda block, seed: 0 if seed == 0 else audit.block_hash(block, seed)
    got = sorted((str(x["id"]), x["fails"]) for x in audit.marked(df, hashed=weak).collect())
    assert got == sorted((str(x["id"]), x["fails"]) for x in audit.marked(df).collect())


def test_audit(spark):
    rows, df = table(spark)
    labels = [(k, *x) for k, x in enumerate([(1, 0), (0, 1), (1, 1), (None, None), (0, 0), (1, None)] * 8)] + [(2, 0, 0), (None, 1, 1), (999, 1, 1)]
    good, bad = ({k for k, *x in labels if k is not None and x[c] == 1} for c in (0, 1))
    got = {(x["part"], x["filter_order"], x["step"]): tuple(x)[3:] for x in audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    own, want = list(fails([x[:2] for x in rows])), {}
    for part in {s or "" for _, _, s, _ in rows}:
        docs = [(k, f) for (k, _, s, _), f in zip(rows, own) if (s or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left, gone = docs, []
            for step, x in enumerate(order):
                out = [d for d in left if x in d[1]]
                left, redundant = [d for d in left if x not in d[1]], sum(x in f for _, f in gone)
                want[part, order, step + 1] = [len(left), len(out), redundant, sum(f == {x} for _, f in docs), sum(k in good for k, _ in out), sum(k in bad for k, _ in out)]
                gone += out
    for (part, order, step), x in want.items():
        x.append(sum(y[1] for (p, o, s), y in want.items() if p == part and o[s - 1] == order[step - 1]))
    assert got == {k: tuple(x) for k, x in want.items()}
    assert audit.audit(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_words():
    text = " ".join(random.Random(1).choice(["a", "b\t", "\x0b", "é", "\xa0"]) for _ in range(900_000)).encode()
    assert len(text) > audit.LISTED and audit.words(text) == (len(text.split()), len(set(text.split())))


def test_signature_covers_the_text():
    """A change of any one byte shows."""
    text = random.Random(2).randbytes(9000)
    base = audit.signature(text, 0)
    assert len(base) == 4 and all(audit.signature(text[:k] + bytes([text[k] ^ 1]) + text[k + 1 :], 0)[1:] != base[1:] for k in range(0, 9000, 7))

"""The fill-in-middle transformation against plain Python, and on odd tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seastate.llm import infill


def plain(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (n, "plain", None, None, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    parts = {"P": text[:a], "M": text[a:b], "S": text[b:]}
    form = "spm" if h[3] % 100 < 20 else "psm"
    return (n, form, a, b - a, "".join(f"<{c.upper()}>{parts[c.upper()]}" for c in form))


@pytest.mark.parametrize("step", [1, 2, 3, 4, 90])
def test_elias_fano(step):
    r = np.random.default_rng(step)
    for n in (1, 2, 63, 64, 65, 511, 512, 513, 9000):
        values = np.append(0, np.cumsum(r.integers(0, step + 1, n)))
        read = infill.EliasFano(infill.elias_fano(values))
        assert read.n == n + 1 and [read[k] for k in range(n + 1)] == values.tolist()
        assert step == 90 or len(infill.elias_fano(values)) < 64 + 0.6 * len(values) + len(values) * step / 8


def test_transform(spark, monkeypatch):
    """Null and empty texts, signs of the format and halves of them, astral characters, long texts, copies, repeated rows and ids, null ids, clashing columns."""
    monkeypatch.setattr(infill, "COPIES", 7)
    r = random.Random(5)
    texts = [None, "", "a", "é", "🙂", "<P>x", "a<S", "S>b<", "<<P", "M><M", "<p>", "á\r\n\x00b", "日本語テキスト" * 300, "x🙂é" * 30000]
    texts += ["".join(r.choice("ab é🙂<PSM>\n") for _ in range(r.randint(1, 90))) for _ in range(150)]
    rows = [(k, t, "h", 1) for k, t in enumerate(texts)] + [(1000 + k, "one text of many", "h", 2) for k in range(60)]
    rows += [(None, "no id", "h", 3), (None, "no id", "h", 3), (None, None, "h", 3), rows[12], rows[12], (12, "another text", "h", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, copies int").repartition(5)
    out = infill.transform(df)
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", infill.restored().alias("text")).collect()
    want = [(k, *plain(k, t), t or "") for k, t, *_ in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {x["form"] for x in got} == {"plain", "psm", "spm"}
    listed = infill.index(df.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("key", infill.content_key(F.col("text")))).collect()
    assert len(listed) == len({t or "" for _, t, *_ in rows}) and max(x["copies"] for x in listed) == 60
    assert infill.transform(df.limit(0)).count() == 0


def test_texts_of_one_key_are_compared(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y")], "key string, text string")
    with pytest.raises(Exception, match="two texts have one"):
        infill.index(df).collect()

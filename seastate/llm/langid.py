"""Language identification by a byte convolutional network, trained and applied in numpy.

A text's UTF-8 bytes are cut into windows of WINDOW bytes, all of them. In each window, filters of several widths
slide over the bytes; the largest answer of each filter feeds a softmax over the languages. A convolution over one-hot
bytes is a sum of table rows, so a filter bank of width k is k tables of 256 rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import kept, pieces, text_batches

WINDOW, WIDTHS, FILTERS = 192, (2, 3, 4), 16
#: Windows that are computed at once: their answers fit in a core's cache.
BLOCK = 96
#: The training sample's bounds: languages (most frequent first), texts of each, windows of each text.
TEXTS_PER_LANGUAGE, MOST_TEXTS, WINDOWS_PER_TEXT = 1200, 150_000, 3
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    """languages in order; tables[w][j]: 256 x FILTERS for byte j of the filters of width w; bias, dense and out: the softmax layer."""

    languages: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    out: np.ndarray

    def pooled(self, x: np.ndarray, where: bool = False):
        """The largest answer of each filter in each window of x, and on demand where it is."""
        best, at = [], []
        for width, table in zip(WIDTHS, self.tables):
            n = x.shape[1] - width + 1
            a = np.take(table[0], x[:, :n], axis=0)
            for j in range(1, width):
                a += np.take(table[j], x[:, j : j + n], axis=0)
            if where:
                k = a.argmax(axis=1)
                at.append(k)
                best.append(np.take_along_axis(a, k[:, None, :], 1)[:, 0])
            else:
                best.append(a.max(axis=1))
        return np.concatenate(best, axis=1) + self.bias, at

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Softmax over the languages of each window."""
        out = np.empty((len(x), len(self.languages)), np.float32)
        for k in range(0, len(x), BLOCK):
            h = np.maximum(self.pooled(x[k : k + BLOCK])[0], 0)
            z = h @ self.dense + self.out
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[k : k + BLOCK] = z / z.sum(axis=1, keepdims=True)
        return out


def windows(raw: bytes) -> np.ndarray:
    """All windows of a text's bytes, the last one padded with zeros."""
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 8, rate: float = 0.01, seed: int = 7) -> Model:
    """Train on windows x (n, WINDOW) and language numbers y by Adam; classes weigh alike."""
    rng = np.random.default_rng(seed)
    hidden = FILTERS * len(WIDTHS)
    m = Model(
        languages,
        [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(hidden, np.float32),
        rng.normal(0, 0.2, (hidden, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    parts = [*m.tables, m.bias, m.dense, m.out]
    first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    weight = (len(y) / np.maximum(1, np.bincount(y, minlength=len(languages))) / len(languages)).astype(np.float32)
    lane = np.arange(FILTERS)
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), BLOCK):
            own = order[k : k + BLOCK]
            xb, yb = x[own], y[own]
            h, at = m.pooled(xb, where=True)
            active = h > 0
            h = h * active
            z = h @ m.dense + m.out
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(yb)), yb] -= 1
            p *= (weight[yb] / len(yb))[:, None]
            g = (p @ m.dense.T) * active
            grads = [np.zeros_like(t) for t in m.tables] + [g.sum(axis=0), h.T @ p, p.sum(axis=0)]
            for w, width in enumerate(WIDTHS):
                gw = g[:, w * FILTERS : (w + 1) * FILTERS]
                for j in range(width):
                    byte = np.take_along_axis(xb, at[w] + j, axis=1)  # the j-th byte of each filter's best place
                    np.add.at(grads[w][j], (byte, lane[None, :]), gw)
            step += 1
            now = rate * (0.5 ** (epoch // 3)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for part, grad, a, b in zip(parts, grads, first, second):
                a += 0.1 * (grad - a)
                b += 0.001 * (grad * grad - b)
                part -= now * a / (np.sqrt(b) + 1e-8)
    return m


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from a bounded sample of the rows of df that have a text and a language; None if there are none.

    Of each language at most TEXTS_PER_LANGUAGE distinct texts, those of the least hashes (fewer if MOST_TEXTS don't hold
    as many of all languages), however often each is there; of each text WINDOWS_PER_TEXT windows at even distances over
    its whole length.
    """
    text_batches(df.sparkSession)
    rows = df.select(df[text_col].alias("text"), df[lang_col].alias("lang")).where("text is not null and lang is not null")
    rows = rows.withColumn("h", F.xxhash64("text", F.lit(5)))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("count")).collect()
    if not counts:
        return None
    texts = max(1, min(TEXTS_PER_LANGUAGE, MOST_TEXTS // len(counts)))
    # twice as many distinct texts as wanted (their number is known to a few parts of a hundred), by their hash; of these the ones of least hash
    share = F.create_map([F.lit(v) for r in counts for v in (r["lang"], min(1.0, 2 * texts / r["count"]))])
    sample = rows.where(F.pmod("h", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    sample = sample.dropDuplicates(["lang", "h"]).withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= texts)

    def op(batches):
        for batch in batches:
            lang, out, key = [], [], []
            for t, name, h in zip(*(c.to_pylist() for c in batch.columns)):
                w = windows(t.encode())
                if LETTER.search(t):
                    for k in sorted({round(i * (len(w) - 1) / max(1, WINDOWS_PER_TEXT - 1)) for i in range(WINDOWS_PER_TEXT)}):
                        lang.append(name), out.append(w[k].tobytes()), key.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(out, pa.binary()), pa.array(key, pa.int64())], ["lang", "x", "h"])

    got = sample.select("text", "lang", "h").mapInArrow(op, "lang string, x binary, h long").toPandas()
    if got.empty:
        return None
    got = got.sort_values(["h", "lang", "x"])
    languages = sorted(got["lang"].unique())
    x = np.frombuffer(b"".join(got["x"]), np.uint8).reshape(-1, WINDOW)
    return fit(x, np.searchsorted(languages, got["lang"].to_numpy()), languages)


def predict(df: DataFrame, model: Model | None, keep: list[str], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` with lang_pred and score (0 to 1), or other names, of each whole text.

    All windows count, by their number of letter-like bytes; the score is the mean probability of the predicted
    language. Null texts, texts without a letter and all texts without a model get "und" and 0. Repeated rows stay; an
    empty table gives no rows.
    """
    text_batches(df.sparkSession)
    own = text_col in keep
    rows = df.select(*(() if own else (df[text_col],)), *(df[c] for c in keep))
    place = keep.index(text_col) if own else 0
    letters = np.zeros(256, np.float32)
    letters[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1

    def op(batches):
        kept()
        for batch in pieces(batches, place):
            texts = batch.column(place).to_pylist()
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            some = [i for i, t in enumerate(texts) if model is not None and t and LETTER.search(t)]
            if some:
                parts = [windows(texts[i].encode()) for i in some]
                x = np.concatenate(parts)
                p = model.probabilities(x) * (np.take(letters, x).sum(axis=1) + 1e-3)[:, None]
                total = np.add.reduceat(p, np.cumsum([0, *map(len, parts)])[:-1], axis=0)
                total = total / total.sum(axis=1, keepdims=True)
                for i, k, s in zip(some, total.argmax(axis=1), total.max(axis=1)):
                    lang[i], score[i] = model.languages[k], min(1.0, float(s))
            yield pa.RecordBatch.from_arrays([*batch.columns[0 if own else 1 :], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, *names])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(op, f"{fields}, `{names[0]}` string, `{names[1]}` double")


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: the CRC-32 of its id as text is divisible by 5. Null ids: false."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score): trained on the rows that aren't held out, applied to all."""
    learn = df.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0)
    model = train(learn, text_col, lang_col)
    return predict(df, model, [id_col], text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")


def known_language(df: DataFrame, least: float = 0.3, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of df whose text has letters and a language predicted with a score of `least` or more; all columns stay.

    The model is trained on df's own labelled rows. Without labelled rows nothing can be judged and all rows stay.
    """
    model = train(df, text_col, lang_col)
    if model is None:
        return df
    taken = {c.lower() for c in df.columns}  # Spark's names don't tell cases apart
    a, b = (next(n for k in range(len(df.columns) + 2) if (n := f"{name}{k}") not in taken) for name in ("lang_pred", "score"))
    return predict(df, model, df.columns, text_col, (a, b)).where((F.col(a) != UNKNOWN) & (F.col(b) >= least)).drop(a, b)

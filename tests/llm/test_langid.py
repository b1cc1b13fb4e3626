"""The byte network against a plain one, and its sample of languages that repeat a few texts."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from seastate.llm import langid


def test_probabilities_are_those_of_plain_loops():
    r = np.random.default_rng(3)
    m = langid.Model(["a", "b", "c"], [r.normal(0, 1, (w, 256, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS], r.normal(0, 1, 48).astype(np.float32), r.normal(0, 1, (48, 3)).astype(np.float32), r.normal(0, 1, 3).astype(np.float32))
    x = np.concatenate([langid.windows(t.encode()) for t in ("abc é", "x" * 500, "")])
    for row, got in zip(x, m.probabilities(x)):
        hidden = []
        for width, table in zip(langid.WIDTHS, m.tables):
            for f in range(langid.FILTERS):
                best = max(sum(float(table[j, row[i + j], f]) for j in range(width)) for i in range(len(row) - width + 1))
                hidden.append(max(0.0, best + float(m.bias[len(hidden)])))
        z = [sum(h * float(w) for h, w in zip(hidden, m.dense[:, k])) + float(m.out[k]) for k in range(3)]
        e = [math.exp(v - max(z)) for v in z]
        np.testing.assert_allclose(got, [v / sum(e) for v in e], atol=2e-4)


def test_languages_of_few_texts_are_learned(spark):
    """Ten languages of thousands of rows and five texts each, and one of many texts: none is lost, and the bound holds."""
    r = random.Random(4)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(3, 8)))
    texts = [(f"l{k}", " ".join(word("abcdefghijklmnopqrstuvwxyz"[2 * k : 2 * k + 6]) for _ in range(90)), 4000) for k in range(10) for _ in range(5)]
    texts += [("many", " ".join(word("üöä") for _ in range(6)), 1) for _ in range(4000)]
    df = spark.createDataFrame(texts, "lang string, text string, n int").select("lang", "text", F.explode(F.sequence(F.lit(1), "n")).alias("LANG_PRED0")).repartition(8)
    model = langid.train(df)
    assert model.languages == sorted({x[0] for x in texts})
    kept = langid.known_language(df)
    assert kept.columns == df.columns and kept.groupBy("lang").count().count() == 11
    found = {x["text"]: x["lang_pred"] for x in langid.predict(df.dropDuplicates(["text"]).where("lang <> 'many'"), model, ["text"]).collect()}
    assert sum(found[t] == name for name, t, n in texts if n > 1) >= 45

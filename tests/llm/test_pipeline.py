"""The pipeline's stages on a small table, against plain versions of what each decides."""

import random

from tests.llm.test_operators import prose

import corpus_pipeline
from seastate.llm import simhash


def test_stages(spark, tmp_path):
    secret = "token = abcdefghijklmnop1234"
    texts = [prose(100, k) for k in range(60)]
    texts += [texts[3], texts[3], "123 456 !!", "", None, f"{prose(50, 90)} {secret} {prose(30, 91)}"]
    item = prose(40, 1234)
    texts.append(f"{prose(60, 70)} {item} {prose(60, 71)}")
    docs = spark.createDataFrame([(k, t, "xx", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        seen = stage(spark, seen, str(tmp_path))
        assert seen.columns == docs.columns, name
        seen.write.parquet(f"{tmp_path}/{k}")
        seen = spark.read.parquet(f"{tmp_path}/{k}")
    left = {r["doc_id"]: r["text"] for r in seen.collect()}
    assert set(left) == {*range(60), 65}
    assert "abcdefghijklmnop1234" not in left[65] and all(left[k] == texts[k] for k in range(60))
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out["doc_id"]) == set(left)
    assert (out.groupby("doc_id")["length"].sum() == out.groupby("doc_id")["doc_tokens"].first()).all()
    random.seed(0)
    assert simhash.fingerprint(texts[3]) == simhash.fingerprint(texts[60])


def test_near_dedup_reaches_similarity(spark):
    """Against all pairs of five-word shingle sets; most copies differ in more than two bits of a SimHash."""
    r = random.Random(3)
    texts = []
    for k in range(40):
        base = prose(r.choice((40, 200, 500)), 3000 + k).split()
        texts.append(" ".join(base))
        for _ in range(3):
            own = list(base)
            for at in r.sample(range(len(own)), max(1, round(len(own) * r.choice((0.002, 0.01, 0.02, 0.03))))):
                own[at] = f"changed{r.random()}"
            texts.append(" ".join(own))
    texts += ["", " ", None, "a b", "A  b", texts[0]]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in texts)]
    least = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for k in range(i):
                if len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k]):
                    least[i] = least[k] = min(least[i], least[k])
        if all(least[least[i]] == least[i] for i in range(len(texts))):
            break
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {k for k, x in enumerate(least) if k == x}
    old = {x["doc_id"] for x in simhash.keep_one(docs).collect()}
    assert len(old) > len(kept)


def test_odd_tables(spark, tmp_path):
    """An empty table, and one with clashing columns, null ids and texts, repeated rows and a very long text."""
    clash = ["score", "lang_pred", "h", "key", "keys", "fp", "label", "component_id", "row", "hit", "new", "passage", "item_id", "id", "base", "weak", "length", "ids", "sequence_id", "offset"]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clash)
    long = " ".join(prose(40, 700 + k % 50) for k in range(400))
    texts = [prose(80, k) for k in range(12)] + [prose(80, 3), None, "", long, "1 2 3", prose(80, 900) + " password=abcdefghijklmnop " + prose(9, 1)]
    rows = [(k if k != 2 else None, t, "xx" if k % 4 else None, None, None, *("c" for _ in clash)) for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[2]]
    spark.createDataFrame([(1, prose(30, 5000)), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, data in (("none", []), ("odd", rows)):
        seen = spark.createDataFrame(data, kinds).repartition(3)
        columns = seen.columns
        for k, (step, stage) in enumerate(corpus_pipeline.STAGES):
            seen = stage(spark, seen, str(tmp_path))
            assert k == 4 or seen.columns == columns, step
            seen.write.parquet(f"{tmp_path}/{name}{k}")
            seen = spark.read.parquet(f"{tmp_path}/{name}{k}")
        ids = [x["doc_id"] for x in seen.select("doc_id").distinct().collect()]
        assert sorted(map(str, ids)) == sorted(map(str, [] if name == "none" else [*(k for k in range(12) if k != 2), None, 15, 17]))
    left = {x["doc_id"]: x for x in spark.read.parquet(f"{tmp_path}/odd3").collect()}
    assert "[SECRET]" in left[17]["text"] and left[15]["text"] == long and left[5]["hit"] == "c"

"""Language identification: n-grams and training against plain Python, held-out accuracy, texts of all kinds."""

import zlib

import numpy as np
import pytest

from runlore.llm import language_id, queries
from runlore.llm.language_id import BUCKETS, fit_language_id, gram_buckets, language, train_language_id


def grams(text):
    """n-grams of a text whose runs of other characters count as one gap, none before the first letter."""
    shown, out = "", []
    for c in text.lower():
        shown += c if c.isalpha() else "" if not shown or shown[-1] == " " else " "
    for n in range(1, language_id.MOST + 1):
        out += [shown[i : i + n] for i in range(len(shown) - n + 1) if n > 1 or shown[i] != " "]
    return out


def test_grams():
    texts = ["Hello, World 12 x", "", None, "  Ünïcode\n\nlines  ", "a", "123", "один два", "aaaa"]
    bucket, n = gram_buckets(texts)
    parts = np.split(bucket, np.cumsum(n)[:-1])
    known = {}
    for t, own in zip(texts, parts, strict=True):
        expected = grams(t or "")
        assert len(own) == len(expected), t
        alone, _ = gram_buckets([t])
        assert sorted(alone) == sorted(own)  # what stands beside a text doesn't matter
        if len(set(expected)) == len(set(own.tolist())):
            known[t] = expected
    assert len(known) >= 7


def test_training_against_plain_python():
    """One turn over rows of two languages, coordinate by coordinate."""
    rng = np.random.default_rng(1)
    samples = [(np.array(sorted(rng.choice(6, 3, replace=False)), np.int32), rng.integers(1, 4, 3), "ab"[i % 2]) for i in range(4)]
    idf = np.ones(BUCKETS)
    old = language_id.EPOCHS
    try:
        language_id.EPOCHS = 1
        model = train_language_id(samples, idf)
    finally:
        language_id.EPOCHS = old
    z, n = {}, {}
    for i in np.random.default_rng(29).permutation(4):
        bucket, count, name = samples[i]
        x = {int(b): language_id.SCALE * c / count.sum() for b, c in zip(bucket, count, strict=True)} | {BUCKETS: 1.0}
        w = {}
        for b in x:
            for c in range(2):
                zz, nn = z.get((b, c), 0.0), n.get((b, c), 0.0)
                w[b, c] = 0.0 if abs(zz) <= language_id.L1 else -(zz - np.sign(zz) * language_id.L1) / ((language_id.BETA + nn**0.5) / language_id.ALPHA + language_id.L2)
        e = [np.exp(sum(x[b] * w[b, c] for b in x)) for c in range(2)]
        for c in range(2):
            d = e[c] / sum(e) - (c == "ab".index(name))
            for b in x:
                g = x[b] * d
                more = n.get((b, c), 0.0) + g * g
                z[b, c] = z.get((b, c), 0.0) + g - (more**0.5 - n.get((b, c), 0.0) ** 0.5) / language_id.ALPHA * w[b, c]
                n[b, c] = more
    for (b, c), zz in z.items():
        w = 0.0 if abs(zz) <= language_id.L1 else -(zz - np.sign(zz) * language_id.L1) / ((language_id.BETA + n[b, c] ** 0.5) / language_id.ALPHA + language_id.L2)
        assert (model.bias[c] if b == BUCKETS else model.weights[c][model.row[b]]) == pytest.approx(w, abs=1e-6)


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op13_language_id(spark, sf)
    assert [(f.name, f.dataType.simpleString()) for f in found.schema] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = found.collect()
    assert sorted(r.doc_id for r in rows) == sorted(true)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in true if zlib.crc32(str(i).encode()) % 4 == 2}
    right = [r.lang_pred == true[r.doc_id] for r in held]
    assert np.mean(right) >= 0.985
    loss = np.mean([(r.score - ok) ** 2 for r, ok in zip(held, right, strict=True)])
    assert loss < 0.02 and all(0 <= r.score <= 1 for r in rows)


def test_texts_of_all_kinds(spark):
    schema = "doc_id bigint, text string, lang string, source string, lang_pred string, score int"
    rows = [(i, f"the old house near {i} the river", "en", "a", "x", 1) for i in range(8)] + [(i + 10, f"das alte haus {i} am fluss", "de", "a", None, None) for i in range(8)]
    rows += [(20, None, "en", None, None, None), (21, "", "en", None, None, None), (22, "12 %% 3", "en", None, None, None), (23, "the house", None, None, None, None)]
    rows += [rows[0], rows[0], (None, "das haus", None, None, None, None), (24, "alte haus " * 20_000, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    model = fit_language_id(df)
    assert model.languages == ["de", "en"] and (model.row > 0).sum() < 2000
    found = {r.doc_id: r for r in df.select("doc_id", language(df, model).alias("x")).select("doc_id", "x.*").collect()}
    assert {i: found[i].lang_pred for i in (0, 10, 20, 21, 22, 23, 24, None)} == {0: "en", 10: "de", 20: "und", 21: "und", 22: "und", 23: "en", 24: "de", None: "de"}
    assert all(found[i].score == 0 for i in (20, 21, 22)) and 0.5 < found[23].score <= 1
    none = fit_language_id(df.filter("false"))
    assert [tuple(r) for r in df.filter("doc_id = 23").select(language(df, none).alias("x")).select("x.*").collect()] == [("und", 0.0)]
    one = fit_language_id(df.filter("lang = 'de'"))
    assert [tuple(r) for r in df.filter("doc_id = 23").select(language(df, one).alias("x")).select("x.*").collect()] == [("de", 1.0)]
    assert df.filter("false").select(language(df, model)).count() == 0


def test_temperature():
    """Values that are too sure are divided by more than one."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 500)
    values = rng.normal(size=(500, 3)) * 2
    values[np.arange(500), y] += 2
    assert language_id._temperature(values * 5, y) == pytest.approx(5 * language_id._temperature(values, y), rel=0.05)

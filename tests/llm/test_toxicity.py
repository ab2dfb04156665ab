from __future__ import annotations

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from signals.llm.toxicity import ORDERS, fit_toxicity, gram_blocks, held_out, score_toxicity, training_rows

LABELS = "doc_id bigint, quality int, toxic int, text string"


def corpus(n=400):
    draw = random.Random(2)
    words = ["".join(draw.choice("abcdeghilmnorstu") for _ in range(draw.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [draw.choice(words) for _ in range(draw.randint(5, 200))]
        toxic = int(i % 4 == 0)
        for _ in range(toxic * draw.randint(2, 5)):
            text.insert(draw.randrange(len(text)), draw.choice(["Vileword", "nastyterm"]))
        rows.append((i, " ".join(text), "s"))
        labels.append((i, 1, toxic, "x"))
    return rows, labels


def test_held_out_accuracy(spark, documents):
    rows, labels = corpus()
    docs, marked = documents(rows), spark.createDataFrame(labels, LABELS)
    model = fit_toxicity(docs, marked.where(~held_out(F.col("doc_id"))))
    got = {r.doc_id: r.score for r in score_toxicity(docs, model, keep=["doc_id"]).collect()}
    away = [i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in away) / len(away) > 0.95
    again = fit_toxicity(docs, marked.where(~held_out(F.col("doc_id"))))
    assert np.allclose(model.weights, again.weights, atol=1e-5) and (model.grams == again.grams).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="test data is not here")
def test_held_out_accuracy_on_the_test_data(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(docs, labels.where(~held_out(F.col("doc_id"))))
    seen = docs.join(labels.where(held_out(F.col("doc_id"))).select("doc_id", "toxic"), "doc_id")
    got = score_toxicity(seen, model, keep=["toxic"]).collect()
    hit = [r.score >= 0.5 for r in got if r.toxic]
    false = [r.score >= 0.5 for r in got if not r.toxic]
    assert sum(hit) / len(hit) >= 0.9 and sum(false) / len(false) < 0.005


def present(text):
    """The different hashed n-grams of a text, each hashed by itself."""
    low = "".join(max(c, " ") for c in text.lower())
    out = set()
    for n in ORDERS:
        for i in range(len(low) - n + 1):
            by_order = [g for g in gram_blocks(low[i : i + n])]
            out.add(int(by_order[-1][0]))
    return out


def test_same_as_a_plain_classifier(spark, documents):
    rows, labels = corpus(200)
    model = fit_toxicity(documents(rows), spark.createDataFrame(labels, LABELS), max_features=300, min_rows=4, steps=120)
    grams = [present(t) for _, t, _ in rows]
    y = np.array([x[2] for x in labels], dtype=float)
    p, q = Counter(), Counter()
    for held, label in zip(grams, y, strict=True):
        (p if label else q).update(held)
    ratio = {
        g: np.log((p[g] + 1) / (y.sum() + 2)) - np.log((q[g] + 1) / ((1 - y).sum() + 2)) for g in {*p, *q} if p[g] + q[g] >= 4
    }
    chosen = sorted(ratio, key=lambda g: (-round(abs(ratio[g]) * np.sqrt(p[g] + q[g]), 12), g))[:300]
    assert len(set(chosen) & set(model.grams.tolist())) >= 295  # equal ranks at the cut may fall either way
    chosen = model.grams.tolist()
    x = np.array([[ratio[g] * (g in held) for g in chosen] for held in grams])
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) ** 0.5
    w, a, b = np.zeros(301), np.zeros(301), np.zeros(301)
    for step in range(1, 121):
        error = weight * (1 / (1 + np.exp(-(x @ w[:300] + w[300]))) - y) / weight.sum()
        slope = np.append(x.T @ error + 1e-3 * w[:300], error.sum())
        a, b = 0.9 * a + 0.1 * slope, 0.99 * b + 0.01 * slope**2
        w -= 0.02 * a / (1 - 0.9**step) / (np.sqrt(b / (1 - 0.99**step)) + 1e-9)
    expected = 1 / (1 + np.exp(-(x @ w[:300] + w[300])))
    got = {r.doc_id: r.score for r in score_toxicity(documents(rows), model, keep=["doc_id"]).collect()}
    assert np.allclose([got[i] for i in range(200)], expected, atol=1e-3)


def test_the_sample_is_bounded(spark, documents):
    rows, labels = corpus(300)
    docs, marked = documents(rows), spark.createDataFrame(labels, LABELS)
    some = {r.text for r in training_rows(docs, marked, "doc_id", "text", "toxic", 100).collect()}
    more = {r.text for r in training_rows(docs, marked, "doc_id", "text", "toxic", 200).collect()}
    assert 95 <= len(some) <= 100 and some < more and training_rows(docs, marked, "doc_id", "text", "toxic", 0).count() == 0


def test_odd_rows(spark, documents, odd_rows):
    rows, labels = corpus(80)
    labels += [(3, 1, None, "x"), (None, 1, 1, "x"), (5, 0, 0, "x"), (5, 0, 1, "x"), (99_999, 1, 1, "x")]
    model = fit_toxicity(documents(rows), spark.createDataFrame(labels, LABELS))
    got = score_toxicity(documents(odd_rows), model).collect()
    assert len(got) == len(odd_rows) and all(isinstance(r.score, float) and 0 <= r.score <= 1 for r in got)
    bare = {r.score for r in got if r.doc_id in (1, 2)}
    assert len(bare) == 1 and bare.pop() == pytest.approx(1 / (1 + np.exp(-model.bias)), abs=1e-6)
    assert score_toxicity(documents([]), model).count() == 0


def test_labels_of_one_kind_or_none(spark, documents):
    docs = documents([(1, "a b c", "s"), (2, "d e f", "s")])
    none = fit_toxicity(docs, spark.createDataFrame([], LABELS))
    clean = fit_toxicity(docs, spark.createDataFrame([(1, 1, 0, "x"), (2, 1, 0, "x")], LABELS))
    assert none.bias < 0 and clean.bias < none.bias and not len(clean.grams)


def test_blocks_of_a_long_text_change_nothing(monkeypatch):
    import signals.llm.toxicity as m

    whole = set(np.concatenate(list(gram_blocks("some text of a few words, in some order"))).tolist())
    monkeypatch.setattr(m, "BLOCK", 5)
    assert set(np.concatenate(list(gram_blocks("some text of a few words, in some order"))).tolist()) == whole

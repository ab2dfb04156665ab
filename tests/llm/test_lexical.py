from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from signals.llm import lexical
from signals.llm.lexical import Item, Segment, best_of, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def plainly(docs, items, k=10):
    held = [(d, Counter(TERM.findall((t or "").translate(UPPER)))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(TERM.findall((text or "").translate(UPPER)))
    out = []
    for item, terms in asked.items():
        scores = []
        for d, c in held:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms
            s = 0
            for t, times in terms.items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += times * w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scores)[:k], start=1)]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["Straße", "ÉTÉ", "don't", "x-y", "中文"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(draw.choices(words, weights, k=draw.randint(1, 120)))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)] + [(None, docs[3][1]), (2000, None), (2001, ""), (2002, "-- !")]
    items = [(i, " ".join(draw.choices(words, weights, k=draw.randint(1, 30)))) for i in range(25)]
    items += [(30, docs[3][1]), (31, None), (32, "nowhere"), (33, "w0 W0 w0"), (33, "w1"), (None, "w2 w7")]
    return docs, items


def frames(spark, corpus, clash=True):
    docs = spark.createDataFrame(corpus[0], "doc_id bigint, text string").repartition(5)
    items = spark.createDataFrame(corpus[1], "item_id bigint, text string")
    if clash:
        docs = docs.selectExpr("*", "1 AS n", "'x' AS term", "2 AS item", "3 AS _text", "4 AS score", "5 AS rank", "6 AS item_id")
        items = items.selectExpr("*", "1 AS item", "2 AS term", "3 AS _text", "4 AS doc_id")
    return docs, items


def test_same_as_plain_python(spark, corpus, rows):
    docs, items = frames(spark, corpus)
    assert rows(ranked_search(docs, items)) == plainly(*corpus)


def test_blocks_of_items_change_nothing(spark, corpus, rows):
    docs, items = frames(spark, corpus)
    assert rows(ranked_search(docs, items, k=3, block_terms=40)) == plainly(*corpus, k=3)


@pytest.mark.parametrize(("share", "step"), [(0.0, 8), (1 / 16, 16), (0.3, 64), (2.0, 4096)])
def test_every_split_of_lists_gives_the_same(monkeypatch, share, step):
    monkeypatch.setattr(lexical, "LONG", share)
    monkeypatch.setattr(lexical, "STEP", step)
    draw = np.random.default_rng(1)
    sizes = draw.integers(1, 300, 500)
    held = [(d, t) for d in range(500) for t in np.flatnonzero(draw.random(40) < 1 / (1 + np.arange(40) / 4))]
    of_doc, terms = (np.array(x) for x in zip(*held, strict=True))
    counts = draw.integers(1, 4, len(held))
    segment = Segment(sizes, of_doc, terms, counts, 500, int(sizes.sum()), 40)
    for _ in range(60):
        chosen = np.sort(draw.choice(40, draw.integers(1, 15), replace=False))
        item = Item(chosen, draw.integers(0, 3000, len(chosen)))
        scores = np.zeros(500, dtype=np.int64)
        for t, w in zip(chosen, item.weights, strict=True):
            docs, gain = segment.list_of(t)
            scores[docs] += w * gain
        best = sorted((d for d in range(500) if scores[d] > 0), key=lambda d: (-scores[d], d))[:5]
        for floor in (0, int(scores[best[-1]]) if best else 0):
            found, values = best_of(segment, item, 5, floor)
            assert set(best) <= set(found.tolist())
            assert all(scores[d] == v for d, v in zip(found, values, strict=True))


def test_long_lists_are_skipped():
    """A list whose bound cannot reach the threshold is probed, never walked: its documents do not come up alone."""
    of_doc, terms = np.concatenate([[5, 6], np.arange(1000)]), np.concatenate([[0, 0], np.ones(1000, dtype=int)])
    segment = Segment(np.full(1000, 50), of_doc, terms, np.ones(1002, dtype=int), 1000, 50_000, 2)
    found, _ = best_of(segment, Item(np.array([0, 1]), np.array([900, 1])), 2, 0)
    assert found.tolist() == [5, 6]


def test_empty_tables(spark, corpus):
    docs, items = frames(spark, corpus)
    assert ranked_search(docs.limit(0), items).count() == 0
    assert ranked_search(docs, items.limit(0)).count() == 0
    assert ranked_search(docs, items.where("text IS NULL")).columns == ["item_id", "rank", "doc_id", "score"]

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from signals.llm import vafile
from signals.llm.vafile import top_inner_products

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, cid int"


def brute(rows, every=5, k=5):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok[i, tuple(math.floor(256 * x) for x in v)] = True
    out = []
    for q, a in ok:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in ok if c != q and len(a) == len(b))[:k]
            out += [(q, n, c, -s) for n, (s, c) in enumerate(best, start=1)]
    return sorted(out)


def run(spark, rows, every=5, k=5):
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)
    got = top_inner_products(df, F.col("vec_id") % every == 0, k=k).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


def single(v):
    return [float(x) for x in __import__("numpy").array(v, dtype="float32")]


@pytest.mark.parametrize("block", [4096, 16])
def test_same_as_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vafile, "VECTORS", block)
    monkeypatch.setattr(vafile, "QUERIES", block)
    draw = random.Random(block)
    rows = [(i, single([draw.gauss(0, 0.3) for _ in range(8)])) for i in range(150)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]  # one vector on a third of the rows
    rows += [(2000 + i, single([draw.choice([0.0, 0.5, -0.5]) for _ in range(8)])) for i in range(60)]  # many ties
    assert run(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 2.0]), (5, [float("nan"), 1.0]), (10, None), (15, [None, 1.0]), (20, [float("inf"), 0.0]), (25, []),
        (30, [1.0, 2.0]), (30, [1.0, 2.0]), (35, [3.0]), (40, [1.0, 2.0, 3.0]), (None, [9.0, 9.0]), (41, []), (1, [-1.0, 0.5]),
        (45, [1e6, -1e6]),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(1, [1.0])]) == [] and run(spark, [(0, [1.0])]) == []


def test_huge_components_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, [1e12, 1.0]), (2, [0.5, 0.5]), (5, [-1e300, 0.0]), (10, [3e7, -3e7])]
    got = run(spark, rows)
    small = [r for r in rows if all(abs(x) * 256 + 1 <= math.sqrt(2**62 / 2) for x in r[1])]
    assert [i for i, _ in small] == [0, 2] and got == brute(small)

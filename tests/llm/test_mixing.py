from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from signals.llm.mixing import PASSES, pareto_mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, weights=(1, 2, 3), cap=3, odds=True):
    """Words taken by (doc_id, source), by a plain loop."""
    docs = defaultdict(list)
    for d, t, s in rows:
        digits = int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:13], 16)
        docs[s].append(((digits + 0.5) / 2**52, d, len(WORD.findall(t or ""))))
    names = sorted(docs, key=lambda s: (s is None, s or ""))
    size = {s: sum(x[2] for x in docs[s]) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, total = {}, list(names), sum(size.values())
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        full = [s for s in free if cap * size[s] <= level * weight[s]]
        if not full:
            target.update({s: level * weight[s] for s in free})
            break
        target.update({s: cap * size[s] for s in full})
        free = [s for s in free if s not in full]
    taken = {}
    for s in names:
        heavy = lambda n: len(f"{n:b}")
        expected = {d: 0.0 for _, d, _ in docs[s]}
        if target[s] >= cap * size[s] > 0:
            expected = {d: float(cap) for d in expected}
        elif size[s]:
            held, open_ = 0, sorted({heavy(n) for _, _, n in docs[s]}, reverse=True)
            while True:  # the heaviest class above the cap is held there, the rest spread again
                level = (target[s] - held) / sum(n * heavy(n) for _, _, n in docs[s] if heavy(n) in open_)
                if level * open_[0] <= cap:
                    break
                held += cap * sum(n for _, _, n in docs[s] if heavy(n) == open_[0])
                open_ = open_[1:]
            expected = {d: min(cap, level * heavy(n)) for _, d, n in docs[s]}
        whole = {d: math.floor(e) for d, e in expected.items()}
        p = {d: e - whole[d] for d, e in expected.items()}
        gap, more = max(target[s] - sum(n * whole[d] for _, d, n in docs[s]), 0), set()
        xi = lambda u, d: u / (1 - u) / (p[d] / (1 - p[d])) if odds else u
        order = sorted((x for x in docs[s] if p[x[1]] > 0), key=lambda x: (xi(x[0], x[1]), x[0], -1 if x[1] is None else x[1]))
        for _ in range(PASSES):
            through = 0
            for _, d, n in [x for x in order if x[1] not in more and x[2] <= gap]:
                if through + n > gap:
                    break
                through += n
                more.add(d)
            gap -= through
        others = [(abs(n - gap), d) for u, d, n in order if d not in more and abs(n - gap) < gap]
        more |= {min(others)[1]} if others else set()
        for _, d, n in docs[s]:
            taken[d] = (n, size[s], pytest.approx(target[s]), n * (whole[d] + (d in more)))
    return taken


def test_same_as_a_plain_loop(documents):
    draw = random.Random(5)
    rows = [(i, "w " * draw.randint(0, 90), draw.choice(["a", "b", "c", "d", None, "é", "Z"])) for i in range(900)]
    rows += [(1000 + i, "w " * draw.randint(1, 60), "hot") for i in range(600)] + [(5000, "w " * 20_000, "hot")]
    got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in pareto_mix(documents(rows)).collect()}
    expected = brute(rows)
    assert {k: tuple(v) for k, v in got.items()} == expected
    assert {k: v[3] for k, v in brute(rows, odds=False).items()} != {k: v[3] for k, v in got.items()}
    near = defaultdict(lambda: [0, 0.0])
    for d, _, s in rows:
        near[s][0] += got[d][3]
        near[s][1] = got[d][2]
    assert all(abs(t - want) <= 0.02 * want + 1 for t, want in near.values())
    assert all(t <= 3 * n for n, _, _, t in got.values())


def test_reruns_agree_and_odd_rows(documents, odd_rows):
    df = documents(odd_rows)
    once, again = ([tuple(r)[:7] for r in pareto_mix(df).collect()] for _ in range(2))
    assert sorted(once, key=str) == sorted(again, key=str) and len(once) == len(odd_rows)
    sizes = {r.doc_id: (r["size"], r.taken) for r in pareto_mix(df).collect()}
    assert sizes[1] == (0, 0) and sizes[5] == (0, 0) and sizes[6][0] == 40_001


def test_longer_documents_are_likelier(documents):
    """Within a source the share of documents taken grows with the bit length of the size."""
    rows = [(i, "w " * (1 << (i % 6)), "a") for i in range(3000)] + [(9000 + i, "w " * 30, "b") for i in range(100)]
    share = {n: [0, 0] for n in range(6)}
    for r in pareto_mix(documents(rows), weights=(1, 20)).where("source = 'a'").collect():
        share[r.doc_id % 6][0] += r.copies
        share[r.doc_id % 6][1] += 1
    rates = [a / b for a, b in share.values()]
    assert all(x < y + 0.05 for x, y in zip(rates, rates[1:])) and rates[5] > 3 * rates[0]


def test_order_of_rows_changes_nothing(documents):
    draw = random.Random(8)
    rows = [(i % 40, "w " * draw.randint(0, 50), draw.choice("ab")) for i in range(300)]
    results = []
    for _ in range(3):
        draw.shuffle(rows)
        mix = pareto_mix(documents(rows, clash=False).repartition(draw.randint(1, 6)))
        results.append(sorted((r.doc_id, r.source, r["size"], r.taken) for r in mix.collect()))
    assert results[0] == results[1] == results[2]


def test_carried_columns_and_empty(documents):
    r = pareto_mix(documents([(1, "a b", "s")]), carry=["doc_id", "text", "slice"]).first()
    assert r.carried.text == "a b" and r.copies == 1 and r.carried.slice == 7
    assert pareto_mix(documents([])).count() == 0
    assert pareto_mix(documents([(1, None, None), (2, "", "s")])).agg({"taken": "sum"}).first()[0] == 0

from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from signals.llm.components import connected_components
from signals.llm.simhash import BLOCK, fingerprint, links_in_buckets, pivot_table, radius, simhash_groups, spanning_links

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text, n=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_groups_equal_brute_force(documents):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(40):
        text = [draw.choice(words) for _ in range(draw.randint(1, 400))]
        rows.append((base * 10, " ".join(text), "s"))
        for k in range(1, draw.randint(1, 6)):
            text[draw.randrange(len(text))] = draw.choice(words)
            rows.append((base * 10 + k, " ".join(text).title(), "s"))
    got = {r.doc_id: r for r in simhash_groups(documents(rows)).collect()}
    prints = {d: plain(t) for d, t, _ in rows}
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    ids = sorted(prints)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {d: r.component_id for d, r in got.items()} == union(pairs, ids) and pairs


def test_odd_rows(documents, odd_rows):
    got = simhash_groups(documents(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    by = {r.doc_id: r for r in got}
    assert {by[d].component_id for d in (1, 2, 5)} == {1} and by[1].fingerprint == "0" * 16
    assert by[4].component_id == 3 and by[None].component_id is None
    assert by[6].fingerprint == f"{plain('long ' * 40_000 + 'end'):016x}"
    assert simhash_groups(documents([])).count() == 0


def test_blocks_of_a_long_text_change_nothing(monkeypatch):
    import signals.llm.simhash as m

    text = " ".join(f"w{i % 97}" for i in range(3_000)).encode()
    whole = fingerprint(text, 3)[0]
    monkeypatch.setattr(m, "BLOCK", 50)
    assert (fingerprint(text, 3)[0] == whole).all() and BLOCK > 50
    assert fingerprint(b"a b", 3)[0][0] == xxhash.xxh64_intdigest(b"a b", seed=42)


def test_pivots_drop_no_link():
    draw = np.random.default_rng(2)
    base = draw.integers(0, 1 << 63, (40, 2), dtype=np.uint64)
    prints = np.unique(np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(6), base[:9] ^ np.uint64(15)]), axis=0)
    pivots = draw.integers(0, 1 << 63, (8, 2), dtype=np.uint64)
    for most in (1, 2, 5):
        close = [
            (i, j) for i in range(len(prints)) for j in range(i) if np.bitwise_count(prints[i] ^ prints[j]).sum() <= most
        ]
        found = spanning_links(prints, pivot_table(prints, pivots), most)
        assert set(found) <= {p for a, b in close for p in ((a, b), (b, a))}
        assert union(found, range(len(prints))) == union(close, range(len(prints)))


def test_buckets_larger_than_a_chunk(spark, monkeypatch):
    import signals.llm.simhash as m

    monkeypatch.setattr(m, "CHUNK", 8)
    values = [i ^ (i >> 1) for i in range(100)]
    prints = spark.createDataFrame([(v, bytearray(v.to_bytes(8, "little"))) for v in values], "node bigint, print binary")
    links = links_in_buckets(prints.selectExpr("node", "1L AS key"), prints, 1, 1)
    labels = {r.label for r in connected_components(links).collect()}
    assert labels == {0} and connected_components(links).count() == 100


def test_components(spark):
    draw = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(draw.randint(100, 400), draw.randint(100, 400)) for _ in range(200)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    assert got == union(pairs, nodes | {n for p in pairs for n in p}) or {n: got[n] for n in nodes} == union(pairs, nodes)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_one_row_of_each_component_is_kept(documents, odd_rows):
    rows = odd_rows + [(None, "no id at all but a text", "z"), (9, "one", "b"), (9, "two other words", "b")]
    for shuffled in (rows, rows[::-1]):
        docs = documents(shuffled)
        got = simhash_groups(docs, carry=docs.columns).where("kept").collect()
        assert sorted((str(r.doc_id), r.carried.text) for r in got) == sorted(
            [("1", None), ("3", odd_rows[2][1]), ("6", odd_rows[6][1]), ("7", odd_rows[8][1]), ("8", "one"), ("9", "two other words")]
            + [("None", "no id at all but a text")]
        )
        assert {r.carried.node for r in got} == {7}


def test_radius_grows_with_distance():
    assert radius(1.0, 512, 1) == 0 and radius(0.8, 512, 0) == 77 and radius(0.9, 512, 1) < radius(0.8, 512, 1)

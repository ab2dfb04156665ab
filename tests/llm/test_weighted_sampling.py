from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from signals.llm.weighted_sampling import Sampler, edited_fingerprints, half_replaced, likeness, weighted_fingerprints, weighted_terms


def jaccard(a: str, b: str) -> float:
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((x & y).values()) / sum((x | y).values())


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    return [" ".join(draw.choices(words, weights=[1 / (i + 1) for i in range(200)], k=draw.randint(30, 400))) for _ in range(40)]


def test_collisions_estimate_generalised_jaccard(texts):
    sampler = Sampler(4096)
    prints = [sampler.fingerprint(t.encode()).tobytes() for t in texts]
    errors = []
    for i in range(0, 40, 2):
        true, seen = jaccard(texts[i], texts[i + 1]), likeness(prints[i], prints[i + 1])
        errors.append((seen - true) / np.sqrt(true * (1 - true) / 4096))
    assert abs(np.mean(errors)) < 1 and np.std(errors) < 2


def test_weights_count():
    sampler = Sampler(4096)
    a, b = "x y", "x x x y"
    assert abs(likeness(sampler.fingerprint(a.encode()).tobytes(), sampler.fingerprint(b.encode()).tobytes()) - 0.5) < 0.05


def test_memory_and_blocks_change_nothing(texts, monkeypatch):
    whole = [Sampler(64).fingerprint(t.encode()).tobytes() for t in texts]
    monkeypatch.setattr("signals.llm.weighted_sampling.BLOCK", 7)
    small = Sampler(64, remembered=16)
    assert [small.fingerprint(t.encode()).tobytes() for t in texts] == whole
    monkeypatch.setattr("signals.llm.weighted_sampling.PIECE", 50)
    assert all(weighted_terms(t.encode()) == Counter(t.encode().lower().split()) for t in texts)


def expected_rows(given):
    import xxhash

    def place(row):
        h = xxhash.xxh64_intdigest(row[1].encode(), 42)
        return row[0] is not None, row[0] or 0, h - (1 << 64) if h >> 63 else h

    ordered = sorted(((d, t or "") for d, t, _ in given), key=place)
    sampler = Sampler(64)
    prints = [sampler.fingerprint(t.encode()).tobytes() for _, t in ordered]
    out = []
    for i, (d, text) in enumerate(ordered):
        k = (i + 1) % len(ordered)
        edited = half_replaced(text, ordered[k][1]).encode()
        other = sampler.fingerprint(edited).tobytes()
        digest = hashlib.sha256(edited).hexdigest()
        out.append((d, len(text), digest, prints[i], other, likeness(prints[i], other), likeness(prints[i], prints[k])))
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("parts", [1, 7])
def test_edited_same_as_plain_python(spark, documents, odd_rows, texts, rows, parts):
    given = odd_rows + [(20 + i, t, "z") for i, t in enumerate(texts)]
    made = edited_fingerprints(documents(given).repartition(parts))
    columns = ("doc_id", "n_chars", "edited_sha256", "print", "edited_print", "near_edited", "near_next")
    got = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in rows(made, *columns)]
    assert sorted(got, key=lambda t: tuple((x is None, str(x)) for x in t)) == expected_rows(given)


def test_many_parts(spark, documents, texts):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        given = [(i, t, "z") for i, t in enumerate(texts)] + [(99, "same", "y")] * 50
        made = edited_fingerprints(documents(given))
        got = sorted((r["doc_id"], r["edited_sha256"]) for r in made.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == sorted((r[0], r[2]) for r in expected_rows(given))


def test_single_and_empty(documents, rows):
    one = edited_fingerprints(documents([(1, "abcd", "a")])).collect()
    assert [(r["n_chars"], r["edited_sha256"], r["near_next"]) for r in one] == [(4, hashlib.sha256(b"abab").hexdigest(), 1.0)]
    assert edited_fingerprints(documents([])).count() == 0
    assert weighted_fingerprints(documents([])).count() == 0


def test_equal_texts_have_equal_fingerprints(documents, odd_rows):
    made = weighted_fingerprints(documents(odd_rows)).collect()
    assert len(made) == len(odd_rows)
    by_id = {}
    for r in made:
        by_id.setdefault(r["doc_id"], set()).add(bytes(r["print"]))
    assert by_id[3] == by_id[4] and by_id[1] == by_id[2] == by_id[5] and len(by_id[4]) == 1

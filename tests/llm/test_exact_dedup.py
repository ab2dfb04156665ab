from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from signals.llm.exact_dedup import exact_duplicates


def brute(rows):
    groups = {}
    for d, t, _ in rows:
        groups.setdefault(t or "", []).append(d)
    best = {t: max(ids, key=lambda i: -1 if i is None else i) for t, ids in groups.items()}
    return sorted(
        ((d, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _ in rows),
        key=str,
    )


def pick(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


def test_odd_rows(documents, odd_rows):
    got = exact_duplicates(documents(odd_rows))
    assert pick(got) == brute(odd_rows)
    kept = [r.doc_id for r in got.where("kept").collect()]
    assert sorted(kept, key=str) == sorted([2, 4, 5, 6, None, 7, 8], key=str)  # one of the two equal rows of 4


def test_a_text_on_a_third_of_the_rows(documents):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 50}", "s") for i in range(600)]
    assert pick(exact_duplicates(documents(rows), support=0.1)) == brute(rows)


def test_normalised(documents):
    got = exact_duplicates(documents([(1, "A b", "s"), (2, "a B", "s")]), normalise=F.lower)
    assert {(r.doc_id, r.keep_id, r.kept) for r in got.collect()} == {(1, 2, False), (2, 2, True)}


def test_empty(documents):
    assert exact_duplicates(documents([])).count() == 0

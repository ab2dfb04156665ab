from __future__ import annotations

import random

import corpus_pipeline

FOOT = "all pages of this kind end so"


def prose(draw, lines=12):
    return [" ".join(f"w{draw.randrange(9000)}" for _ in range(9)) for _ in range(lines)]


def test_a_large_copy_group_keeps_one_whole_text(spark, documents):
    draw = random.Random(5)
    body = "\n".join(prose(draw))
    rows = [(i, body, f"site{i % 12}") for i in range(1000)]
    near = prose(draw, 30)
    for i in range(60):
        one = list(near)
        one[i % 30] += f" edit{i}"
        rows.append((2000 + i, "\n".join(one), f"site{i % 12}"))
    # The pages have sites of their own, so the copies' sites cannot hide a line of theirs.
    rows += [(3000 + i, "\n".join([*prose(draw), FOOT]), f"page{i}") for i in range(12)]
    docs = documents(rows, clash=False)
    whole = {r[0]: r[1] for r in rows}
    clean = corpus_pipeline.line_dedup(spark, docs, "")
    kept = {r.doc_id: r.text for r in corpus_pipeline.simhash_dedup(spark, clean, "").collect()}
    assert {0, 2000, *range(3000, 3012)} <= set(kept) and not set(range(1, 1000)) & set(kept)
    assert all(kept[i] == whole[i] for i in kept if i < 3000)
    assert all(kept[3000 + i] + "\n" + FOOT == whole[3000 + i] for i in range(12))

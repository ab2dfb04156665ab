from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import pytest

from signals.llm.line_dedup import copy_groups, remove_spread_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, min_sites=10, share=0.25, short_share=0.9, short_texts=0.005):
    sites, texts = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if WORD.search(line):
                sites[line.strip(" \t\r")] |= {s} - {None}
                texts[line.strip(" \t\r")].add(t)
    n_sites, n_texts = len({s for _, _, s in rows} - {None}), len({t for _, t, _ in rows} - {None})
    few, many = min(min_sites, max(3, math.ceil(share * n_sites))), min(10 * min_sites, max(3, math.ceil(short_share * n_sites)))
    out = set()
    for line in sites:
        if len(WORD.findall(line)) >= 4:
            good = min(len(sites[line]), len(texts[line])) >= few
        else:
            good = len(sites[line]) >= many and len(texts[line]) >= max(many, math.ceil(short_texts * n_texts))
        out |= {line} if good else set()
    result = []
    for d, t, _ in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for x in lines if not (WORD.search(x) and x.strip(" \t\r") in out)]
        result.append((d, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(result, key=str)


def pick(df):
    return sorted(((r.doc_id, r.text, int(r.lines), r.lines_removed) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def spread_rows():
    draw = random.Random(3)
    rows = []
    for spread in range(1, 25):
        line = f"this line is on {spread} sites"
        rows += [(100 * spread + k, f"own text {draw.random()}\n{line}  \n{spread} sites\n", f"site{k}") for k in range(spread)]
    rows += [(9000 + k, f"only on one site but very often\nx {k}", "site0") for k in range(200)]
    # Copies of one text on all sites: its lines have many sites and one text.
    return rows + [(9500 + k, "a whole text that was copied\nto every site there is", f"site{k}") for k in range(24)]


@pytest.mark.parametrize("most", [3, 5, 6, 10])
def test_near_the_thresholds(documents, spread_rows, most):
    got = remove_spread_lines(documents(spread_rows), min_sites=most)
    assert pick(got) == brute(spread_rows, most)


def test_relative_thresholds(documents, spread_rows):
    given = {"site_share": 0.8, "min_sites": 100, "short_share": 0.5, "short_texts": 0.03}
    expected = brute(spread_rows, 100, 0.8, 0.5, 0.03)
    assert pick(remove_spread_lines(documents(spread_rows), **given)) == expected
    assert {n for *_, n in expected} == {0, 1, 2}


def test_odd_rows(documents, odd_rows):
    rows = odd_rows + [(50 + k, f"no id at all but a text\r\nmine {k}", str(k)) for k in range(3)]
    rows += [(60 + k, f"two words \x0c\na b c \r\na b c d \x0b \n{k}", str(k)) for k in range(4)]
    got = remove_spread_lines(documents(rows), min_sites=3)
    assert pick(got) == brute(rows, 3)
    assert got.where("doc_id IS NULL").first().text == ""
    assert remove_spread_lines(documents([])).count() == 0


def test_names_that_clash(spark):
    names = "_a _b _drop _kept row_a row_b site text_key all key long drop kept line sites texts group"
    docs = spark.sql("SELECT 1L AS doc_id, 'a b' AS text, 's' AS source").selectExpr("*", *[f"'mine' AS {c}" for c in names.split()])
    row = remove_spread_lines(docs, near_copies=True).first()
    assert row.text == "a b" and {row[c] for c in names.split()} == {"mine"}


def test_pages_copied_to_all_sites_lose_their_footer(documents):
    draw = random.Random(7)
    foot = "one footer line for all of them"
    rows = []
    for g in range(12):
        body = "\n".join(" ".join(f"w{draw.randrange(9000)}" for _ in range(12)) for _ in range(8))
        rows += [(100 * g + k, f"{body}\n{foot}", f"site{k}") for k in range(12)]
    for near in (False, True):
        got = remove_spread_lines(documents(rows), near_copies=near).collect()
        assert {r.lines_removed for r in got} == {1} and not any(foot in r.text for r in got)


def test_copy_groups(documents):
    draw = random.Random(2)
    base = [f"w{draw.randrange(9000)}" for _ in range(300)]
    rows = []
    for i in range(200):
        text = list(base)
        text[draw.randrange(300)] = f"edit{i}"
        rows.append((i, " ".join(text), "s"))
    rows += [(1000 + i, " ".join(f"w{draw.randrange(9000)}" for _ in range(300)), "s") for i in range(60)]
    groups = copy_groups(documents(rows + [(5000, None, "s")])).collect()
    assert len(groups) == len({t for _, t, _ in rows[:200]}) and len({r["group"] for r in groups}) == 1

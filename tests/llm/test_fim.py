from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from signals.llm.fim import fill_in_middle, restored

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text, rate=50, suffix_first=80):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h[3] % 100 < suffix_first:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_same_as_plain_python(documents, odd_rows, rows):
    more = [(i, f"  tok{i} <S　<P\x85 é{'x ' * i}\n\x1f y>\t", "a") for i in range(10, 60)]
    more += [(100, "has <P> inside", "a"), (101, "has <M>", "b"), (102, "<S>", "b"), (103, "a\x00b \x00 c", "c"), (104, " ", "c")]
    given = odd_rows + more
    made = fill_in_middle(documents(given), rate=90)
    expected = sorted((plainly(d, t, 90) for d, t, _ in given), key=lambda r: tuple((x is None, str(x)) for x in r))
    assert rows(made) == expected
    assert {r["form"] for r in made.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_restored_exactly(documents, odd_rows, rows):
    docs = documents(odd_rows + [(i, f"<<P <S<M {i} <P" * 3 + " " * (i % 3), "a") for i in range(20, 80)])
    made = fill_in_middle(docs, rate=100)
    back = made.select("doc_id", restored(F.col("form"), F.col("output")).alias("text"))
    assert rows(back) == rows(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def test_bytes_that_are_no_text(spark, rows):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF2062' AS STRING) AS text")
    assert rows(fill_in_middle(docs, rate=0), "n", "output") == [(2, "a� b")]


def test_empty_table(documents):
    assert fill_in_middle(documents([])).count() == 0

from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = "row int, key string, node bigint, digest string, slice int, target double, lines string, score string, print string"


@pytest.fixture(scope="session")
def documents(spark):
    """Build a documents table from (doc_id, text, source), with further columns whose names operators use inside."""

    def build(rows, clash=True):
        full = [(d, t, "en", s, len(t) if t is not None else None) for d, t, s in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if clash:
            for column in CLASHING.split(", "):
                name, kind = column.split(" ")
                df = df.selectExpr("*", f"CAST('7' AS {kind}) AS {name}")
        return df

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, a very long one, repeated rows, ties, null ids and sources, blanks of every kind."""
    return [
        (1, None, "a"),
        (2, "", "a"),
        (3, "same words here again and again", "b"),
        (4, "same words here again and again", "b"),
        (4, "same words here again and again", "b"),
        (5, " \t\n\x0b\f\r ", None),
        (6, "long " * 40_000 + "end", "c"),
        (None, "no id at all but a text", None),
        (7, "İstanbul ÉTÉ straße 中文 ﬁ ‍ </s> <|endoftext|>", "c"),
        (8, "one", "a"),
    ]

from __future__ import annotations

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from signals.llm.bpe import Codec, decode_ids, encode_texts, join_tree  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "the ", "don't", "'s", "'", "!!", " ", "\n", "é", "é", "İ", "Σ", "１", "12", "<|endoftext|>", "<|start", "中文", "x" * 50,
         "ing", "\x1c", "\xa0", "\x85", "ß", "ª²½", "‍", "👍"]


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as f:
        return Codec(f.read())


def test_words_are_encoded_as_the_library_does(codec):
    draw = random.Random(1)
    assert codec.by_word
    for _ in range(500):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 60)))
        ids = codec.whole(text).ids
        assert codec.encode(text).tolist() == ids
        assert codec.decode(codec.encode(text)) == codec.library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("size", [7, 50, 200])
def test_joined_halves_equal_the_whole(codec, size):
    draw = random.Random(size)
    for kind in (PARTS, list("abcdefghijklmnopqrstuvwxyzetaoin")):
        for _ in range(80):
            text = "".join(draw.choice(kind) for _ in range(draw.randint(1, 600)))
            pieces = [text[i : i + size] for i in range(0, len(text), size)]
            assert join_tree(codec, [(p, codec.encode(p)) for p in pieces]).tolist() == codec.whole(text).ids


def test_texts(documents, odd_rows, codec):
    rows = odd_rows + [(20, "unsplit" * 3_000, "s"), (21, "Words, and 'words' don't end. " * 500, "s")]
    got = encode_texts(documents(rows), PATH, piece=1_000).collect()
    texts = {}
    for d, t, _ in rows:
        texts[d] = t or ""
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _, _ in rows)
    for r in got:
        ids = codec.whole(texts[r.doc_id]).ids
        assert r.ids == ids and r.decoded == codec.library.decode(ids, skip_special_tokens=False)
    assert encode_texts(documents([]), PATH).count() == 0


def test_decode_list(spark, codec):
    df = spark.createDataFrame([(1, [320, 1125]), (2, None)], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.decoded for r in decode_ids(df, PATH).collect()} == {1: codec.library.decode([320, 1125]), 2: ""}

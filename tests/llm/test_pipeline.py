"""The pipeline stage by stage against plain Python, on a small corpus with planted cases."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from signals.llm.bpe import Codec  # noqa: E402
from signals.llm.mixing import pareto_mix  # noqa: E402
from test_simhash import plain, union  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LINE = "a line that every site shows at its foot"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdeghilmnorstu") for _ in range(draw.randint(2, 9))) for _ in range(900)]
    rows, labels = [], []
    for i in range(240):
        text = [draw.choice(words) for _ in range(draw.randint(30, 200))]
        if i % 6 == 0:
            for _ in range(4):
                text.insert(draw.randrange(len(text)), draw.choice(["vileword", "nastyterm"]))
        body = " ".join(text) + (f"\n{LINE}" if i % 5 == 1 else "")
        rows.append((i, body, "en", f"s{i % 12}", len(body)))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(1000 + i, rows[i][1], "en", "s3", rows[i][4]) for i in (1, 7, 8)]  # exact copies
    rows += [(2000 + i, rows[i][1] + " tail", "en", "s4", rows[i][4] + 5) for i in (2, 9)]  # near copies
    rows += [(3000, None, "en", None, None), (3001, "", "en", "s1", 0), rows[3], (None, "a text of its own kind here", "en", "s2", 27)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


@pytest.fixture(scope="module")
def steps(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.write_once(stage(spark, docs, folder[0]))
        out.append((name, docs))
    return dict(out)


def key(rows):
    return sorted(map(tuple, rows), key=str)


def test_columns(steps):
    for name, df in list(steps.items())[:-1]:
        assert df.columns == COLUMNS, name
    assert list(steps) == ["documents", "toxicity", "line dedup", "simhash near-dedup", "source mix", "bpe"]


def test_toxic_documents_go(steps):
    left = {r.doc_id for r in steps["toxicity"].collect()}
    toxic = {i for i in range(240) if i % 6 == 0}
    clean = {r.doc_id for r in steps["documents"].collect()} - toxic
    assert clean <= left and len(left & toxic) <= 2


def test_shared_lines_go(steps):
    before = steps["toxicity"].collect()
    spread = defaultdict(set)
    for r in before:
        for line in (r.text or "").split("\n"):
            spread[line.strip()].add(r.source)
    out = {k for k, s in spread.items() if len(s - {None}) >= 3 and len(k.split()) >= 4}
    assert out == {LINE}
    expected = []
    for r in before:
        text = r.text if r.text is None else "\n".join(x for x in r.text.split("\n") if x.strip() not in out)
        expected.append((r.doc_id, text, r.lang, r.source, r.n_chars if text == r.text else len(text)))
    assert key(steps["line dedup"].collect()) == key(expected)


def test_one_of_each_group_stays(steps):
    before = sorted(set(map(tuple, steps["line dedup"].collect())), key=lambda r: (r[0] is None, r[0] or 0))
    prints = [plain(r[1]) for r in before]
    label = union([(i, j) for i in range(len(before)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2], range(len(before)))
    assert key(steps["simhash near-dedup"].collect()) == key(r for i, r in enumerate(before) if label[i] == i)
    assert len(set(label.values())) < len(before) - 3


def test_mix_repeats_and_drops(steps):
    before = steps["simhash near-dedup"]
    copies = {r.doc_id: r.copies for r in pareto_mix(before, carry=before.columns).collect()}
    expected = [tuple(r) for r in before.collect() for _ in range(copies[r.doc_id])]
    assert key(steps["source mix"].collect()) == key(expected) and max(copies.values()) <= 3


def test_tokens(steps):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        codec = Codec(f.read())
    want = Counter()
    for r in steps["source mix"].collect():
        ids = codec.whole(r.text or "").ids
        text = codec.library.decode(ids, skip_special_tokens=False)
        want[r.doc_id, len(ids), tuple(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in steps["bpe"].collect()) == want


def test_run_is_all_stages(spark, folder, steps):
    assert key(corpus_pipeline.run(spark, folder[0]).collect()) == key(steps["bpe"].collect())


def odd_documents(spark):
    """Ties, nulls, repeated rows, a long text, and columns whose names the operators use inside."""
    rows = [(5, "same text of some words here", "s1"), (5, "same text of some words here", "s1"), (5, "another text with that id", "s2")]
    rows += [(None, "no id", None), (None, None, "s1"), (6, "", "s2"), (7, "long " * 60_000 + "end", "s3"), (8, "long " * 60_000 + "end", "s3")]
    docs = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], SCHEMA)
    clashing = "row_a row_b site text_key line lines lines_removed drop kept all key node tie row carried doc_id_ toxic _toxic score copy"
    return docs.selectExpr("*", *[f"'mine' AS {c}" for c in clashing.split()])


@pytest.mark.parametrize("n", range(4))
def test_stages_on_odd_rows_and_clashing_names(spark, folder, n):
    docs = odd_documents(spark)
    name, stage = corpus_pipeline.STAGES[n]
    out = stage(spark, docs, folder[0])
    assert out.columns == docs.columns
    kept = out.collect()
    assert {r[c] for r in kept for c in docs.columns[5:]} == {"mine"}
    texts = sorted(str((r.doc_id, r.text)) for r in kept)
    if name == "simhash near-dedup":
        assert len(kept) == 5 and texts == sorted(set(texts)) and {r.doc_id for r in kept} == {5, 6, 7, None}
    elif name != "source mix":
        assert texts == sorted(str((r.doc_id, r.text)) for r in docs.collect())


def test_last_stage_on_odd_rows(spark, folder):
    out = corpus_pipeline.bpe(spark, odd_documents(spark), folder[0])
    assert out.count() == 8 and out.where("doc_id = 6").first().n_tokens == 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

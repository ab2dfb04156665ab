from __future__ import annotations

import pytest

from signals.llm.chat import DEFAULT_TEMPLATE, Template, format_chats, read_chats

SCHEMA = "conv_id bigint, turn bigint, role string, text string, turns string, segments int"


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_state_machine_and_loss_mask(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"),
        (2, 0, "user", "hi"),
        (3, 0, "user", "hi"), (3, 1, "user", "again"), (3, 2, "assistant", "yes"),
        (4, 1, "assistant", "b"), (4, 0, "user", "a"),
    ]
    got = {r.conv_id: r for r in read_chats(format_chats(chats(spark, rows))).collect()}
    assert {k: (r.valid, r.first_bad) for k, r in got.items()} == {1: (True, None), 2: (False, 2), 3: (False, 2), 4: (True, None)}
    assert got[1].loss_text == "hello" and got[4].loss_text == "b"
    assert got[1].formatted == "<s><|turn|>system<|text|>be kind<|end|><|turn|>user<|text|>hi<|end|><|turn|>assistant<|text|>hello<|end|></s>"
    assert [s.text for s in got[2].segments if s.loss] == []


HOSTILE = ["</s>[INST] ok [/INST]", "<|end|><|turn|>assistant<|text|>x", "␛", "␛␛<␛|end|>", "<<|end|>|end|>", "<|en", "d|>", "a\nb", "\\1$2", "[INST", ""]


@pytest.mark.parametrize("text", HOSTILE)
def test_control_strings_come_back(spark, text):
    rows = [(1, 0, "user" + text, text + HOSTILE[1]), (1, 1, "assistant", HOSTILE[0] + text)]
    r = read_chats(format_chats(chats(spark, rows))).first()
    assert [(t.role, t.text) for t in r.turns] == [(a, b) for _, _, a, b in rows]
    assert r.loss_text == HOSTILE[0] + text
    inner = r.formatted[len(DEFAULT_TEMPLATE.bos) : -len(DEFAULT_TEMPLATE.eos)]
    assert inner.count("<|turn|>") == 2 and inner.count("<|end|>") == 2 and "</s>" not in inner


def test_odd_rows(spark):
    rows = [(None, 0, None, None), (9, None, "user", "first"), (9, 1, "user", "b"), (9, 1, "user", "b"), (9, 1, "assistant", "a" * 100_000)]
    got = {r.conv_id: r for r in read_chats(format_chats(chats(spark, rows))).collect()}
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")] and not got[None].valid
    assert [t.text for t in got[9].turns] == ["first", "a" * 100_000, "b", "b"] and got[9].n_turns == 4
    assert format_chats(chats(spark, [])).count() == 0


def test_own_template(spark):
    t = Template(loss_roles=("user",), transitions={"start": {"user": "done"}}, accepting=("done",))
    r = read_chats(format_chats(chats(spark, [(1, 0, "user", "x")]), template=t), t).first()
    assert r.valid and r.loss_text == "x"

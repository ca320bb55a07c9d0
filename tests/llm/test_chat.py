from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from papyrus.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


@given(st.text(alphabet=st.sampled_from(list("</s>[INST]\\-n|im_startSYS \n")), max_size=60))
def test_escape_round_trip(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in chat.CONTROL)


def brute(rows):
    convs, out = defaultdict(list), {}
    for conv, turn, role, text in sorted(rows):
        convs[conv].append((role, text))
    for conv, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_query_by_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = "</s>[INST] ok [/INST]"
    want = brute([*rows, (-1, 0, "user", odd), (-1, 1, "assistant", odd)])
    found = queries.op3_chat_format(spark, sf_dir).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in found} == want
    assert next(r for r in found if r["conv_id"] == -1)["loss_chars"] == len(odd)


def test_long_conversation_and_spans(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"text {k} </s> \\ " + "0" * (k % 3), None) for k in range(120)]
    made = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    parts = sorted(made.collect(), key=lambda r: r["turn_no"])
    whole = "".join(r["formatted"] for r in parts)
    assert whole == chat.instruct([(r[2], chat.escape(r[3])) for r in rows])
    assert [chat.unescape(whole[r["text_start"] : r["text_end"]]) for r in parts] == [r[3] for r in rows]
    assert chat.digests(made).first()[1:5] == brute([r[:4] for r in rows])[1]
    assert [r["formatted"] for r in parts] == [r["formatted"] for r in sorted(chat.format_conversations(spark.createDataFrame(rows, SCHEMA), window=4).collect(), key=lambda r: r["turn_no"])]


def forgetful(turns):
    """Keeps only the last assistant text: rewrites history."""
    last = max((i for i, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
    return "".join(f"<{r}>{t if r != 'assistant' or i == last else ''}" for i, (r, t) in enumerate(turns))


def numbered(turns):
    return "".join(f"<{i}{r}>{t}\n" for i, (r, t) in enumerate(turns))


def test_templates_that_rewrite_or_count():
    c = chat.Conversation(forgetful)
    seen = [c.add(r, t)["rewrites_history"] for r, t in [("user", "a"), ("assistant", "bb"), ("user", "c"), ("assistant", "d")]]
    assert seen == [False, False, False, True]
    c, w = chat.Conversation(numbered, window=16), chat.Conversation(numbered)
    with pytest.raises(chat.NotLocalError):
        for k in range(40):
            c.add("user", str(k))
    assert "".join(w.add("user", str(k))["formatted"] for k in range(40)) == numbered([("user", str(k)) for k in range(40)])


def last_32(turns):
    return "".join(f"<{r}>{t}\n" for r, t in turns[-32:])


def line_every_eighth(turns):
    return "".join(f"<{r}>{t}\n" + "--\n" * (i % 8 == 7) for i, (r, t) in enumerate(turns))


def reads_turn_two(turns):
    """What the second turn says stands before every turn from the fortieth on."""
    return "".join((turns[1][1] if i >= 40 else "") + f"<{r}>{t}\n" for i, (r, t) in enumerate(turns))


@pytest.mark.parametrize("template", [line_every_eighth, reads_turn_two, numbered, chat.instruct])
def test_whole_prefixes_by_default(template):
    turns = [(("user", "assistant")[k % 2], ("", "assistant", "text 8", "--")[k % 4]) for k in range(60)]
    c = chat.Conversation(template)
    got = [c.add(r, t) for r, t in turns]
    whole = "".join(g["formatted"] for g in got)
    assert whole == template(turns) and not any(g["rewrites_history"] for g in got)
    assert [whole[g["text_start"] : g["text_end"]] for g in got] == [t for _, t in turns]


def test_a_template_that_forgets_old_turns_rewrites_history():
    c = chat.Conversation(last_32)
    assert [c.add("user", str(k))["rewrites_history"] for k in range(60)] == [False] * 32 + [True] * 28


def test_odd_rows(spark):
    rows = [(None, None, None, None, "x"), (1, 2, None, "b", "x"), (1, None, "user", None, "x"), (1, 2, "user", "a\nb", None), (1, 2, "user", "a\nb", None), (2, 1, "assistant", "", "x"), (3, 1, "tool\nx", "y" * 300_000, "x")]
    found = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert {k: v["n_turns"] for k, v in found.items()} == {None: 1, 1: 4, 2: 1, 3: 1}
    lone = chat.digests(chat.format_conversations(spark.createDataFrame([(None, k, "user", "same", None) for k in (0, 0, 1)], SCHEMA))).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in lone] == [(None, 1)] * 3
    assert found[3]["turns_sha256"] == hashlib.sha256(("tool\nx\n" + "y" * 300_000 + "\n").encode()).hexdigest()
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


def separated(turns):
    """A separator at every 40th turn, which no short window shows."""
    return "".join(f"<{r}>{t}\n" + "==\n" * (i % 40 == 39) for i, (r, t) in enumerate(turns))


def test_a_long_conversation_equals_the_templates_output(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"text {k}", None) for k in range(500)]
    turns = [(r[2], r[3]) for r in rows]
    found = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).orderBy("turn_no").collect()
    assert "".join(r["formatted"] for r in found) == chat.instruct(turns)
    c = chat.Conversation(separated)
    assert "".join(c.add(*t)["formatted"] for t in turns) == separated(turns)

"""Conversations rebuilt and rendered, against a plain fold of the log."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tillwise.llm import chat

LOG = "conv_id long, seq long, turn long, role string, action string, text string"


def plain_fold(events):
    """Messages of one conversation by walking its log in order."""
    slots = {}
    for e in sorted(events, key=lambda e: e[1]):
        _, _, turn, role, action, text = e
        if action == "regenerate":
            slots = {t: s for t, s in slots.items() if t < turn}
        if action == "edit":
            slots[turn] = {"whole": [], "stream": None}
        slot = slots.setdefault(turn, {"whole": [], "stream": None})
        if action == "message":
            slot["whole"].append((role, text or ""))
        else:
            role = slot["stream"][0] if slot["stream"] else role
            slot["stream"] = (role, (slot["stream"][1] if slot["stream"] else "") + (text or ""))
    return [m for t in sorted(slots) for m in [*slots[t]["whole"], *([slots[t]["stream"]] if slots[t]["stream"] else [])]]


def random_log(seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(25):
        for seq in range(rng.randint(1, 40)):
            turn = rng.randint(0, 5)
            action = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate"])
            rows.append((conv, seq, turn, "user" if turn % 2 == 0 else "assistant", action, rng.choice(["a", "b ", "</s>", None])))
    rng.shuffle(rows)
    return rows


def test_log_equals_plain_fold(spark):
    rows = random_log(1)
    events = spark.createDataFrame(rows, LOG).repartition(5)
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.reconstruct(events).collect()}
    expected = {conv: plain_fold([r for r in rows if r[0] == conv]) for conv in {r[0] for r in rows}}
    assert got == expected


STRINGS = ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "<\\\\/s>", "[INST", "\\", "<", "a</s", "", " [/INST]", "\n", "é😀</s>é", "x" * 100_000]


def test_any_text_and_role_comes_back(spark):
    rows = [(1, k, role, text) for k, (role, text) in enumerate((r, t) for r in ["user", "assistant", "a\\n\nb<s>", None] for t in STRINGS)]
    rows.append((2, 0, "assistant", None))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    rendered = chat.format_conversations(chat.whole_messages(table))
    back = {r.conv_id: r for r in chat.read_back(rendered).collect()}
    assert [tuple(t) for t in back[1].turns] == [(role or "", text) for _, _, role, text in rows[:-1]]
    assert back[1].loss_text == "".join(STRINGS) and back[2].loss_text == ""
    shown = {r.conv_id: r.formatted for r in rendered.collect()}
    assert shown[1].count("</s>") == len(rows) - 1 and shown[1].count("[INST]") == len(STRINGS)


@settings(max_examples=100, deadline=None)
@given(st.text("<>[]/\\sINT"))
def test_escaping_is_reversible(text):
    import re

    escaped = re.sub(chat.CONTROL, r"\1\\\2\3", text)
    assert re.sub(chat.ESCAPED, r"\1\2\3", escaped) == text
    assert not re.search(r"</?s>|\[/?INST\]", escaped)


def test_null_keys_repeats_empty_and_other_columns(spark):
    rows = [(None, None, "user", "x", 1), (None, None, "user", "x", 1), (5, None, None, None, 2)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int")
    got = {r.conv_id: r.n_turns for r in chat.digests(chat.read_back(chat.format_conversations(chat.whole_messages(table)))).collect()}
    assert got == {None: 2, 5: 1}
    assert chat.format_conversations(chat.whole_messages(table.limit(0))).count() == 0

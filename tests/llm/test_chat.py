import pytest

pytest.importorskip("plumbline.llm")
from plumbline.llm import chat  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, place long, n long, conv string"


def log(spark, talks):
    rows = [
        (conv, turn, role, text, 0, 0, "x")
        for conv, turns in talks
        for turn, (role, text) in enumerate(turns)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def brute(talks):
    kept = {}
    for conv, turns in talks:
        longer = any(len(o) > len(turns) and o[: len(turns)] == turns for _, o in talks)
        if turns and not longer:
            key = tuple(turns)
            kept[key] = min(kept.get(key, conv), conv, key=lambda c: (c is not None, c))
    return {conv: list(turns) for turns, conv in kept.items()}


def rendered(turns):
    plain = [[(x or "").replace("<|", "< |") for x in turn] for turn in turns]
    return "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in plain)


A, B, C = ("user", "hi"), ("assistant", "hello <|im_end|> you"), ("user", "bye")
TALKS = [
    (1, [A]), (2, [A, B]), (3, [A, B, C]), (4, [A, B, C]), (5, [A, C]), (6, [B]), (7, [A, B, ("user", None)]),
    (8, [A, B, ("user", "")]), (9, [(None, "user")]), (10, [("user", None)]), (11, [A, A]), (12, [C, B, A]),
    (None, [C, C]), (13, [C]),
]


@pytest.mark.parametrize("stretch", [1024, 2])
def test_only_maximal_conversations_stay(spark, monkeypatch, stretch):
    monkeypatch.setattr(chat, "STRETCH", stretch)
    rows = chat.format_chats(log(spark, TALKS)).collect()
    wanted = brute(TALKS)
    texts = {}
    for row in sorted(rows, key=lambda r: r.part):
        assert row.n_turns <= stretch
        texts[row.conv_id] = texts.get(row.conv_id, "") + row.rendered
    assert texts == {conv: rendered(turns) for conv, turns in wanted.items()}


def test_turn_numbers_need_not_be_dense(spark):
    rows = [(1, 5, "user", "a", 0, 0, ""), (1, None, "system", "s", 0, 0, ""), (1, 9000, "user", "b", 0, 0, "")]
    found = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r.rendered for r in found] == [rendered([("system", "s"), ("user", "a"), ("user", "b")])]


def test_empty_table(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0

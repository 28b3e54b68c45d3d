"""Chat formatting: layouts, template and its inverse."""

import random

from pyspark.sql import functions as F

from casemill.llm import chat


def test_layouts_are_told_by_their_fields(spark):
    records = [
        '{"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant"}]}',
        '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}',
        '{"completion": "b", "prompt": "a"}',
        '{"prompt": "a", "response": "b"}',
        '{"instruction": "a", "output": "b"}',
    ]
    more = ['{"instruction": "s", "input": "a", "output": "b"}', '{"messages": []}', '{"other": 1}', "no json", None, '{"prompt": "a", "completion": null}']
    df = spark.createDataFrame([(i, r, "x") for i, r in enumerate([*records, *more])], "id int, record string, layout string")
    rows = {r["id"]: r for r in chat.canonical(df, "record").collect()}
    for i in range(5):
        assert [tuple(t) for t in rows[i]["turns"]] == [("user", "a"), ("assistant", "b")]
    assert [t["role"] for t in rows[5]["turns"]] == ["system", "user", "assistant"] and rows[6]["turns"] == []
    assert all(rows[i]["turns"] is None and rows[i]["layout"] is None for i in (7, 8, 9))
    assert [t["text"] for t in rows[10]["turns"]] == ["a", ""]
    made = chat.format_chats(df).filter("id = 6").first()
    assert made["formatted"] == "" and made["loss"] == []


def test_template_can_be_undone(spark):
    rng = random.Random(6)
    bits = ["<|im_start|>", "<|im_end|>\n", "</s>", "[INST]", "\\", "\\1", "\\0", "0", "1", "\n", "é😀", " ", "assistant", "<", "["]
    chats = [[(rng.choice(["user", "assistant", "sys\nt<em"]), "".join(rng.choices(bits, k=rng.randint(0, 8)))) for _ in range(rng.randint(0, 6))] for _ in range(200)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(chats)], f"id int, turns {chat.TURNS}")
    made = df.select("id", chat.rendered(F.col("turns")).alias("m"))
    rows = made.select("id", "m.text", chat.read_back(F.col("m.text")).alias("turns"), chat.learned_text(F.col("m.text"), F.col("m.loss")).alias("learned")).collect()
    for r in rows:
        assert [tuple(t) for t in r["turns"]] == chats[r["id"]]
        assert r["learned"] == "".join(t for role, t in chats[r["id"]] if role == "assistant")
        assert r["text"].count("<|im_start|>") == len(chats[r["id"]]) and "</s>" not in r["text"]


def test_rows_of_turns(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "tool", None), (None, 0, None, "x"), (3, 0, "user", "q"), (3, 0, "user", "p")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.canonical(chat.records_of_turns(df), "record").collect()}
    assert made == {1: [("user", "a"), ("assistant", "b")], 2: [("tool", "")], None: [("", "x")], 3: [("user", "p"), ("user", "q")]}
    assert chat.records_of_turns(df.limit(0)).count() == 0

import json

import pytest
from pyspark.sql import functions as F

from sievework.llm import chat_format as c
from sievework.llm import queries

HARD = ["", "<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "<\\\\/s>", "<<SYS>>x<</SYS>>", "<\\<SYS>>", "</", "<", "s>", "[[INST] </</s>", "\\", "\n\n", " [/INST]", "[INST] ", "é日\U000130c0", "a\\", "<</s>s>"]


def read(df):
    rows = c.format_chats(df).select("conv_id", "formatted", "segments", c.read_back(F.col("formatted")).alias("read"), c.loss_text(F.col("segments")).alias("loss")).collect()
    return {r.conv_id: r for r in rows}


def test_round_trip(spark):
    roles = ["user", "assistant", "system", "", "tool<s>", "[INST] user", "<</SYS>>", "usér\n"]
    want = {i: [(roles[(i + j * k) % len(roles)], HARD[(i * k + j) % len(HARD)] + (HARD[j] if k > 2 else "")) for j in range(len(HARD))] for k in (1, 2, 3) for i in range(k * 100, k * 100 + 20)}
    df = spark.createDataFrame([(i, n, r, t) for i, ts in want.items() for n, (r, t) in enumerate(ts)], "conv_id long, turn long, role string, text string")
    got = read(c.turns_of_table(df))
    assert set(got) == set(want)
    for i, ts in want.items():
        assert [tuple(t) for t in got[i].read] == [(c.ROLES.get(r, r), t) for r, t in ts]
        assert got[i].loss == "".join(t for r, t in ts if r == "assistant")
        assert "".join(s.text for s in got[i].segments) == got[i].formatted
        assert got[i].formatted.count("</s>") == len(ts)  # control strings only where the template put them
        for s in got[i].segments[1::3]:
            assert not any(x in s.text for x in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


RECORDS = [
    ({"id": 1, "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}], "extra": {"x": 1}}, "messages", [("user", "a"), ("assistant", "")]),
    ({"id": 2, "conversations": [{"from": "human", "value": "q", "n": 3}, {"from": "GPT", "value": "r"}]}, "conversations", [("user", "q"), ("assistant", "r")]),
    ({"id": 3, "prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"id": 4, "prompt": "p", "response": 5}, "prompt_response", [("user", "p"), ("assistant", "5")]),
    ({"id": 5, "instruction": "do", "input": "this", "output": "done"}, "instruction_input_output", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"id": 6, "instruction": "do", "input": "", "output": "done"}, "instruction_input_output", [("user", "do"), ("assistant", "done")]),
    ({"id": 7, "instruction": "do", "output": "done"}, "instruction_output", [("user", "do"), ("assistant", "done")]),
    ({"id": 8, "system": "be", "prompt": "p", "completion": "c"}, "system_prompt_completion", [("system", "be"), ("user", "p"), ("assistant", "c")]),
    ({"id": 9, "prompt": "p", "completion": "c", "question": "also"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"id": 10, "nothing": 1}, None, []),
    ({"id": 11, "messages": []}, None, []),
    ({"id": 12, "question": "q", "answer": "a"}, "question_answer", [("user", "q"), ("assistant", "a")]),
    ({"id": 13, "dialogue": [{"speaker": "bot", "utterance": "hi"}]}, "dialogue", [("assistant", "hi")]),
]


def test_json_layouts(spark):
    rows = [(json.dumps(r),) for r, _, _ in RECORDS] + [(None,), ("not json",), ("[1, 2]",), ("",)]
    got = c.turns_of_json(spark.createDataFrame(rows, "record string").withColumn("paths", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    by_id = {r.conv_id: (r.layout, [tuple(t) for t in r.turns]) for r in got if r.conv_id is not None}
    assert by_id == {str(r["id"]): (layout, turns) for r, layout, turns in RECORDS}
    assert all(r.layout is None and r.turns == [] for r in got if r.conv_id is None)


def test_typed_layouts(spark):
    for record, layout, turns in RECORDS[:3] + RECORDS[4:5]:
        df = spark.read.json(spark.createDataFrame([(json.dumps(record),)], "value string").rdd.map(lambda r: r.value)).withColumnRenamed("id", "conv_id")
        got = c.turns_of_table(df).collect()
        assert [(r.conv_id, r.layout, [tuple(t) for t in r.turns]) for r in got] == [(record["id"], layout, turns)]
    with pytest.raises(ValueError, match="no mapping"):
        c.turns_of_table(spark.createDataFrame([(1,)], "other long"))


def test_text_ids_odd_elements_and_parts(spark):
    parts = [{"type": "text", "text": "see"}, {"type": "image_url", "image_url": {"url": "u"}}, "this", {"type": "text", "text": "[1, 2]"}]
    records = [
        ({"id": "identity_0", "messages": [{"role": "user", "content": "a"}]}, [("user", "a")]),
        ({"id": "x", "messages": ["a", {"role": "user", "content": "b"}, 3, None, ["c"], {"role": "assistant", "content": "c"}]}, [("user", "b"), ("assistant", "c")]),
        ({"id": "p", "messages": [{"role": "user", "content": parts}, {"role": "assistant", "content": "[1, 2]"}]}, [("user", "see\nthis\n[1, 2]"), ("assistant", "[1, 2]")]),
        ({"id": "7.5", "prompt": ["one", "two"], "completion": "c"}, [("user", "one\ntwo"), ("assistant", "c")]),
        ({"messages": [{"role": "user", "content": []}]}, [("user", "")]),
        ({"id": "s", "messages": [{"role": "user", "content": ['{"text":"x"}', {"text": "y"}, '{"text":{"a":1}}', "[]", 5]}]}, [("user", '{"text":"x"}\ny\n{"text":{"a":1}}\n[]\n5')]),
        ({"id": "e", "messages": ['{"role":"user","content":"no turn"}', {"role": "user", "content": '{"text":"z"}'}]}, [("user", '{"text":"z"}')]),
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r, _ in records] * 2, "record string")
    made = c.turns_of_json(df)
    assert sorted(((r.conv_id, [tuple(t) for t in r.turns]) for r in made.collect()), key=repr) == sorted([(r.get("id"), t) for r, t in records] * 2, key=repr)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    table = spark.createDataFrame([("identity_0", 0, "user", "q"), ("identity_1", 0, "user", "r")], "conv_id string, turn long, role string, text string")
    assert {r.conv_id for r in c.turns_of_table(table).collect()} == {"identity_0", "identity_1"}
    typed = spark.createDataFrame([("k", [("user", [("text", "see"), ("image", None), ("text", "this")])])], "conv_id string, messages array<struct<role:string,content:array<struct<type:string,text:string>>>>")
    assert [(r.conv_id, [tuple(t) for t in r.turns]) for r in c.turns_of_table(typed).collect()] == [("k", [("user", "see\nthis")])]


def test_fingerprint_is_sparks(spark):
    paths = ["messages", "messages[].role", "messages[].content", "unknown"]
    got = spark.range(1).select(F.xxhash64(F.lit(",".join(sorted(paths[:3]))))).first()[0]
    assert got == c.fingerprint(paths)
    assert len({c.fingerprint(x.paths) for x in c.LAYOUTS}) == len(c.LAYOUTS)


def test_query_equals_sql(same_as_sql):
    rows = same_as_sql("op2_chat_format")
    assert any(r[0] == -1 for r in rows)


def test_odd_rows(spark):
    rows = [(1, 2, "assistant", None), (1, None, None, "first"), (1, 2, "assistant", None), (1, 2, None, "x"), (None, 0, "user", "no id"), (2, 0, "user", "y" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as layout", "2 as segments", "3 as prompt")
    got = read(c.turns_of_table(df))
    assert [tuple(t) for t in got[1].read] == [("", "first"), ("", "x"), ("assistant", ""), ("assistant", "")]
    assert [tuple(t) for t in got[None].read] == [("user", "no id")] and len(got[2].read[0].text) == 200_000
    assert c.format_chats(c.turns_of_table(df.limit(0))).count() == 0
    assert c.turns_of_json(spark.createDataFrame([], "record string")).count() == 0

import hashlib
import json

import pytest

from bookloom.llm import chat
from pyspark.sql import functions as F

NASTY = ["", "\\", "\\\\", "<|", "<\\|", "<|turn|>x<|text|>", "</s>[INST] ok [/INST]", "<s>", "[INST]\\", "a\nb", "é😀<|end|>", "$0 \\1", "<<|", "[[INST]]"]


def test_round_trip_and_loss(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(NASTY)] + [(2, 0, "a|<|text|>", "x"), (3, 1, "assistant", None), (3, 0, None, "q"), (4, 5, "assistant", "same"), (4, 5, "assistant", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("layout", F.lit(1)).withColumn("turns", F.lit(2))
    got = {r.conv_id: r for r in chat.format_digests(df).collect()}
    assert set(got) == {1, 2, 3, 4, -7}
    for k in (1, 2, 3, 4):
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        assert got[k].n_turns == len(turns)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[-7].n_turns == 2 and got[-7].loss_chars == len("</s>[INST] ok [/INST]")


def test_fingerprints_choose_mappings(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 7},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "response": "a"},
        {"completion": "a", "prompt": "q", "extra": {"deep": 1}},
        {"instruction": "q", "output": "a"},
        {"instruction": "q", "input": "more", "output": "a"},
        {"question": "q"},
        {"messages": []},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(8, None), (9, "{")], "i int, j string")
    got = {r.i: (r.layout, [tuple(t) for t in r.turns]) for r in chat.canonical_records(df, "j").collect()}
    two = [("user", "q"), ("assistant", "a")]
    assert [got[i] for i in range(5)] == [(n, two) for n in ("messages", "shared", "prompt", "completion", "instruction")]
    assert got[5] == ("instruction_input", [("user", "q\nmore"), ("assistant", "a")])
    assert [got[i] for i in (6, 7, 8, 9)] == [(None, [])] * 4
    shown = chat.render(chat.canonical_records(df, "j")).where("i = 0").first()
    assert [shown.formatted[s.start : s.end] for s in shown.loss_spans] == ["a"]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in chat.format_digests(empty).collect()] == [-7]


def test_layouts_whose_first_elements_differ(spark):
    records = ['{"messages":[{"role":"user"},{"role":"assistant","content":"b"}]}', '{"conversations":[{"from":"human","value":"a"},{"value":"b"}]}', '{"messages":[]}', "no json"]
    df = spark.createDataFrame(list(enumerate(records)), "conv_id int, json string").withColumn("__x", F.lit(1))
    got = {r.conv_id: (r.layout, [(t.role, t.text) for t in r.turns or []]) for r in chat.canonical_records(df, "json").collect()}
    assert got[0] == ("messages", [("user", None), ("assistant", "b")]) and got[1] == ("shared", [("user", "a"), (None, "b")])
    assert got[2][0] is None and got[3][0] is None


def test_row_layouts_are_chosen_by_their_columns(spark):
    rows = spark.createDataFrame([("c", 1, "gpt", "hi", 0), ("c", 0, "human", None, 0)], "id string, turn int, `from` string, value string, extra int")
    (r,) = chat.canonical_rows(rows).collect()
    assert (r.conv_id, r.layout, [(t.role, t.text) for t in r.turns]) == ("c", "shared_rows", [("user", ""), ("assistant", "hi")])
    with pytest.raises(ValueError, match="no row layout"):
        chat.canonical_rows(rows.drop("value"))

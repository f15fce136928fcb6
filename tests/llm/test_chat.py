"""Chat layouts, marks and the way back."""

import json

import pytest
from pyspark.sql import functions as F

from hectare.llm.chat import LAYOUTS, Template, fingerprint, format_chats, read_chats, record_paths, schema_paths, turns_of_records, turns_of_table

NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\[", "[", "[INST", "<\\/s>", "<\\\\/s>", "[[INST]", "</s", "", "\n", "é😀[OUT]", "[TEXT][ROLE]x[/ROLE]", "<s><s>", "[\\INST]", None]


def spelled(x):
    return x or ""


def test_round_trip(spark):
    roles = ["user", "assistant", "system", "tool", "[TEXT]", "a\\b</s>", "", None]
    rows = [(c, t, roles[(c + t) % len(roles)], NASTY[(3 * c + t) % len(NASTY)]) for c in range(20) for t in range(c % 9 + 1)]
    rows += [(None, 0, "user", "null id"), (None, None, "assistant", "first"), (3, 0, "user", "tie"), (3, 0, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    got = {x.conv_id: x for x in read_chats(format_chats(turns_of_table(df))).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (-1 if r[1] is None else r[1], spelled(r[2]).encode(), spelled(r[3]).encode()))
        assert [(t.role, t.text) for t in got[c].turns] == [(spelled(r[2]), spelled(r[3])) for r in own]
        assert got[c].learned == "".join(spelled(r[3]) for r in own if r[2] == "assistant") and got[c].n_turns == len(own)
        raw = got[c].formatted.encode()
        assert len(got[c].mask) == sum(r[2] == "assistant" for r in own)
        for m in got[c].mask:
            assert raw[:m.start].endswith(b"[OUT]") and raw[m.start + m.length:].startswith(b"</s>")


def test_marks_never_come_from_texts(spark):
    df = spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(NASTY)], "conv_id bigint, turn bigint, role string, text string")
    for x in format_chats(turns_of_table(df)).collect():
        body = x.formatted[len("<s>[INST]"):-len("[/INST]")]
        assert not any(m in body for m in Template().marks)
    with pytest.raises(ValueError):
        Template(begin="<<s>")


def test_record_paths_are_those_of_the_schema(spark):
    records = ['{"a": 1, "b": [{"c d": null, "e": [[1.5]]}], "f": {"g": "x", "1": {}}}', '{"x": []}', '[1, {"y": true}]', '"s"', "{}", "broken {", None]
    df = spark.createDataFrame([(r,) for r in records], "r string").select(record_paths(F.expr("try_parse_json(r)")).alias("p"))
    assert [x.p for x in df.collect()] == [
        ["a", "b", "b[]", "b[].`c d`", "b[].e", "b[].e[]", "b[].e[][]", "f", "f.`1`", "f.g"], ["x", "x[]"], ["[]", "[].y"][:1], [], [], None, None]
    nested = spark.createDataFrame([], "a int, b array<struct<`c d`:string, e:array<array<double>>>>, f struct<g:string, `1`:int>")
    assert sorted(schema_paths(nested.schema)) == ["a", "b", "b[]", "b[].`c d`", "b[].e", "b[].e[]", "b[].e[][]", "f", "f.`1`", "f.g"]


def test_every_layout_gives_the_same_turns(spark):
    turns = [("user", "q"), ("assistant", "a")]
    layouts = [
        {"conv_id": 1, "messages": [{"role": r, "content": t} for r, t in turns]},
        {"conversations": [{"from": "human", "value": "q"}, {"value": "a", "from": "gpt"}], "conv_id": 2},
        {"conv_id": 3, "prompt": "q", "response": "a"},
        {"conv_id": 4, "prompt": [{"role": "user", "content": "q"}], "response": "a"},
        {"conv_id": 5, "instruction": "q", "output": "a"},
        {"conv_id": 6, "instruction": "q", "input": "", "output": "a", "system": None},
        {"conv_id": 7, "turn": 1, "role": "assistant", "text": "a"}, {"conv_id": 7, "turn": 0, "role": "user", "text": "q"},
    ]
    odd = ['{"conv_id": 8, "words": "q"}', "not json", None, '{"conv_id": 9, "messages": []}', '{"conv_id": 10, "instruction": "i", "input": "j", "output": null}']
    df = spark.createDataFrame([(json.dumps(x),) for x in layouts] + [(x,) for x in odd], "own string")
    canonical = turns_of_records(df, "own")
    got = {x.conv_id: [(t.role, t.text) for t in x.turns] for x in read_chats(format_chats(canonical)).collect()}
    assert {c: got[c] for c in range(1, 8)} == {c: turns for c in range(1, 8)}
    assert got[10] == [("user", "i\nj"), ("assistant", "")]
    unknown = canonical.where("layout IS NULL").collect()
    assert sorted(str(x.conv_id) for x in unknown) == ["8", "9", "None", "None"] and all(x.turn is None and x.text is None for x in unknown)
    assert canonical.where("conv_id = 7").select("layout").distinct().collect()[0][0] == "turn rows"


def test_typed_tables(spark):
    typed = spark.sql("SELECT 5 AS conv_id, array(named_struct('role', 'user', 'content', 'q'), named_struct('role', 'assistant', 'content', CAST(NULL AS string))) AS messages")
    assert [(x.turn, x.role, x.text, x.layout) for x in turns_of_table(typed).collect()] == [(0, "user", "q", "messages"), (1, "assistant", None, "messages")]
    wide = spark.sql("SELECT 5 AS conv_id, 'q' AS prompt, 'a' AS response, 1 AS layout, 2 AS at, 3 AS turns")
    assert [(x.role, x.text) for x in turns_of_table(wide).collect()] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError):
        turns_of_table(spark.sql("SELECT 1 AS conv_id, 'x' AS words"))
    empty = turns_of_table(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))
    assert read_chats(format_chats(empty)).count() == 0
    prints = [f for x in LAYOUTS for f in x.fingerprints()]
    assert len(prints) == len(set(prints)) and fingerprint(["b", "a"]) == fingerprint(["a", "b"])


def test_a_long_conversation_and_a_long_text(spark):
    turns = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.expr("if(id % 2 = 0, 'user', 'assistant')").alias("role"), F.concat(F.lit("</s> "), F.col("id")).alias("text"))
    long = spark.sql("SELECT 2 AS conv_id, 0L AS turn, 'assistant' AS role, repeat('[INST]é', 200000) AS text")
    got = {x.conv_id: x for x in read_chats(format_chats(turns_of_table(turns.unionByName(long)))).collect()}
    assert [t.text for t in got[1].turns] == [f"</s> {i}" for i in range(3000)] and got[1].learned == "".join(f"</s> {i}" for i in range(1, 3000, 2))
    assert got[2].learned == "[INST]é" * 200000

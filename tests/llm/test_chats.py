import json

from helpers import crowded, rows

from tidemark.llm import chats

TURNS = "conv_id long, turn long, role string, text string"


def test_levels_of_chains_circles_and_unknown(spark):
    calls = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(70)] + [("x", "y"), ("y", "x"), ("z", "x"), ("s", "s"), ("q", "nope")]
    got = dict(map(tuple, chats.levels(spark.createDataFrame(calls, "call_id string, after string")).collect()))
    assert got == {**{f"c{i}": i for i in range(70)}, "x": None, "y": None, "z": None, "s": None, "q": 0}


def test_arguments(spark):
    cases = {
        '{"turn":1,"text":"hi","words":2}': [], ' { "words" : 3 , "text":"é", "turn":0}': [], '{"turn":"1","text":"hi","words":2}': ["type turn"],
        '{"text":"","words":2,"turn":1,"more":null}': ["range text", "unknown more"], "[1]": ["not an object"], "nope": ["not an object"],
        '{"turn":-1}': ["missing text", "missing words", "range turn"], None: ["not an object"],
    }
    df = spark.createDataFrame([(k, "answer") for k in cases] + [("{}", "other")], "arguments string, name string")
    out = df.withColumn("errors", chats.argument_errors("arguments", "name", chats.TOOLS)).withColumn("json", chats.canonical(df["arguments"])).collect()
    assert {r.arguments: r.errors for r in out if r.name == "answer"} == cases
    assert [r.errors for r in out if r.name == "other"] == [["unknown tool"]]
    assert {r.arguments: r.json for r in out}[' { "words" : 3 , "text":"é", "turn":0}'] == '{"text":"é","turn":0,"words":3}'
    assert {r.arguments: r.json for r in out}["nope"] == "null"


def test_linking_reduces_repeated_identifiers(spark):
    calls = [("a", "answer", '{"turn":1,"text":"x","words":2}', None, 1)] * 50 + [("b", "answer", "{}", "a", 2), ("c", "nope", "{}", "gone", 3)]
    results = [("a", t, "r") for t in range(5, 60)] + [("lost", 9, "r")]
    got = {r.call_id: r for r in chats.linked(spark.createDataFrame(calls, "call_id string, name string, arguments string, after string, turn long"),
                                              spark.createDataFrame(results, "call_id string, turn long, text string")).collect()}
    assert len(got) == 3 and (got["a"].copies, got["a"].result_turn, got["a"].results) == (50, 5, 55)
    assert (got["b"].level, got["b"].result_turn, got["c"].level, got["c"].errors) == (1, None, 0, ["unknown tool"])


def test_lines_are_canonical_json(spark):
    table = [(1, 0, "system", "Be brief"), (1, 1, "user", 'Say "é\n\t\\/" now'), (1, 2, "assistant", None), (1, 3, "user", None), (1, 4, "assistant", ""),
             (2, 0, "assistant", "no call"), (2, 1, "user", "again twice"), (2, 1, "user", "again twice"), (None, 1, "user", "x y"), (3, None, "assistant", "z"),
             (4, 0, "user", "long " * 50000), (5, 0, None, "role"), (6, 1, "tool", "other")]
    got = chats.formatted(crowded(spark.createDataFrame(table, TURNS)))
    out = got.collect()
    assert len(out) == len(table)
    for r in out:
        line = json.loads(r.json)
        assert json.dumps(line, sort_keys=True, separators=(",", ":"), ensure_ascii=False).replace("/", "/") == r.json
        assert line["role"] == r.role and (r.conv_id, r.turn, r.role, line["content"]) in table
    by = {(r.conv_id, r.turn): r for r in out}
    assert by[1, 1].result_turn == 2 and by[1, 3].level == 1 and by[1, 3].n_errors >= 1 and by[1, 2].call_id == "1:1"
    assert by[2, 0].call_id is None and by[None, 1].call_id is None and by[4, 0].n_errors == 1 and by[6, 1].call_id is None


def test_empty_table(spark):
    assert rows(chats.formatted(spark.createDataFrame([], TURNS))) == []

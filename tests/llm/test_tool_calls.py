import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import derived, queries
from corpusloom.llm.tool_calls import canonical, linked_calls, parsed, violations

KIND = (
    "conv_id long, turn long, text string, "
    "calls array<struct<id string, name string, arguments string, after string>>, answers string"
)
SCHEMAS = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 0}}, "additionalProperties": False}}


def run(spark, rows):
    got = linked_calls(spark.createDataFrame(rows, KIND), SCHEMAS)
    return got, sorted(((*r[:7], r.valid) for r in got.collect()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for conv in range(12):
        length = 400 if conv == 0 else rng.randrange(1, 12)
        for turn in range(length):
            calls = [
                (f"c{rng.randrange(2 * length)}", rng.choice(["f", "g"]), rng.choice(['{"x":1}', '{"x":-1}', "{", None, "[]", '{"x":1,"y":2}']),
                 rng.choice([None, f"c{rng.randrange(2 * length)}"]))
                for _ in range(rng.randrange(3))
            ]
            rows.append((conv, turn, f"t{turn}", calls, rng.choice([None, f"c{rng.randrange(2 * length)}"])))

    def fine(tool, arguments):
        try:
            value = parsed(arguments or "")
        except ValueError:
            return False
        return isinstance(value, dict) and tool in SCHEMAS and not violations(value, SCHEMAS[tool])

    good = {(conv, turn, place): fine(c[1], c[2]) for conv, turn, _, calls, _ in rows for place, c in enumerate(calls)}
    want = [(*r[:7], None if r[3] is None else good[r[0], r[2], r[3]]) for r in brute_force_of_every(rows)]
    assert run(spark, rows)[1] == sorted(want, key=str)


def test_one_long_chain(spark):
    rows = [(1, k, "t", [(f"c{k}", "f", '{"x":1}', f"c{k - 1}")], None) for k in range(3000)]
    assert sorted(r[6] for r in run(spark, rows)[1]) == list(range(3000))


def test_odd_rows(spark):
    rows = [
        (1, 1, "t", None, None), (1, 2, None, [], "lost"), (1, 3, "t", [(None, None, None, None), None], None),
        (None, 4, "t", [("a", "f", '{"x": 2}', None)], None), (None, 5, None, None, "a"), (2, None, "t", [("z", "f", "{}", "z")], "z"),
        (3, 1, "t", [("a", "f", '{"x": 1e2}', None)] * 2, None), (3, 1, "t", [("a", "f", '{"x": 1e2}', None)] * 2, None),
    ]
    got, seen = run(spark, rows)
    assert seen == sorted(
        [(1, "lost", 2, None, None, "orphan", None, None), (1, None, 3, 0, None, "unanswered", 0, False), (None, "a", 4, 0, "f", "answered", 0, True),
         (2, "z", None, 0, "f", "answered", None, False), *[(3, "a", 1, k, "f", "unanswered", 0, True) for k in (0, 1, 0, 1)]], key=str
    )
    records = {r.conv_id: r.record for r in got.collect()}
    assert records[3] == '{"after":null,"arguments":{"x":100},"conv_id":3,"id":"a","name":"f","result":null}'
    assert run(spark, [])[1] == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, 1, "t", [("a", "f", '{"x":1}', None)], None)], KIND)
    for name in ("call_id", "level", "key", "record", "status"):
        df = df.withColumn(name, F.lit("x"))
    assert linked_calls(df, SCHEMAS).first().level == 0


def test_arguments_that_json_allows_and_rows_cannot_hold(spark):
    odd = ['{"x":1e999}', '{"x":"\\ud800"}', "[" * 2_000 + "]" * 2_000, '{"x":' + "9" * 5_000 + "}", '{"x":"\\ud83d\\ude00"}']
    rows = [(1, k, "t", [(f"c{k}", "f", text, None)], None) for k, text in enumerate(odd)]
    got = linked_calls(spark.createDataFrame(rows, KIND), SCHEMAS).orderBy("turn").collect()
    assert [r.valid for r in got] == [False, False, False, True, False]
    assert ["not JSON" in r.errors[0] for r in got if r.errors] == [True, True, True, False]
    assert json.loads(got[1].record)["arguments"] == odd[1] and "9" * 5_000 in got[3].record and "😀" in got[4].record


def test_nameless_conversation_is_not_the_empty_name(spark):
    kind = KIND.replace("conv_id long", "conv_id string")
    rows = [(None, 1, "t", [("a", "f", '{"x":1}', None)], None), ("", 2, "t", None, "a")]
    got = linked_calls(spark.createDataFrame(rows, kind), SCHEMAS).collect()
    assert sorted((str(r.conv_id), r.status) for r in got) == [("", "orphan"), ("None", "unanswered")]


@pytest.mark.parametrize("text", ['{"a":1,"a":2}', "NaN", '{"a":Infinity}', "", "{", "[" * 100_000, "1 2"])
def test_what_is_not_json(text):
    with pytest.raises(ValueError):
        parsed(text)


def test_canonical():
    value = {"b": [1.0, 2.5, True, None], "a": {"é": " \n", "B": 1e300, "A": -0.0}}
    text = canonical(value)
    assert text == '{"a":{"A":0,"B":1e+300,"é":" \\n"},"b":[1,2.5,true,null]}'
    assert canonical(json.loads(text)) == text


@pytest.mark.parametrize(
    ("value", "schema", "count"),
    [
        (1, {"type": "string"}, 1), (True, {"type": "integer"}, 1), (1.0, {"type": "integer"}, 0), (None, {"type": ["null", "string"]}, 0),
        ("ab", {"minLength": 3}, 1), ("abcd", {"maxLength": 3}, 1), (5, {"minimum": 6}, 1), (5, {"maximum": 4}, 1), (5, {"enum": [5]}, 0),
        (6, {"enum": [5]}, 1), ([1, "a"], {"items": {"type": "integer"}}, 1), ({"a": 1}, {"required": ["b"]}, 1),
        ({"a": 1}, {"additionalProperties": False}, 1), ({"a": {"b": "x"}}, {"properties": {"a": {"properties": {"b": {"type": "null"}}}}}, 1),
    ],
)
def test_violations(value, schema, count):
    assert len(violations(value, schema)) == count


def brute_force_of_every(rows):
    """Replay: a result goes to the last turn's open calls of its id, else to any open one."""
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        calls = [[turn, place, *c] for _, turn, _, made, _ in mine for place, c in enumerate(made or [])]
        results = [(turn, text, answers) for _, turn, text, _, answers in mine if answers is not None]
        link, rest = {}, []
        for k, (turn, _, name) in enumerate(results):
            last = max((c[0] for c in calls if c[2] == name and c[0] < turn), default=None)
            free = [j for j, c in enumerate(calls) if c[2] == name and c[0] == last and j not in link]
            link.update({free[0]: k}) if free else rest.append(k)
        for k in list(rest):
            free = [j for j, c in enumerate(calls) if c[2] == results[k][2] and j not in link]
            if free:
                link[free[0]] = k
                rest.remove(k)

        def wanted(j):
            named = [i for i, c in enumerate(calls) if c[2] == calls[j][5]]
            return next((i for i in reversed(named) if i < j), named[0] if named else None)

        for j, (turn, place, name, tool, _, _) in enumerate(calls):
            level, seen, at = 0, {j}, wanted(j)
            while level is not None and at is not None:
                level = None if at in seen else level + 1
                seen.add(at)
                at = wanted(at)
            state = "unanswered" if j not in link else "early" if results[link[j]][0] <= turn else "answered"
            out.append((conv, name, turn, place, tool, state, level, results[link[j]][1] if j in link else None))
        for k in rest:
            turn, text, name = results[k]
            out.append((conv, name, turn, None, None, "duplicate" if any(c[2] == name for c in calls) else "orphan", None, text))
    return sorted(out, key=str)


def run_every(spark, rows):
    got = linked_calls(spark.createDataFrame(rows, KIND), SCHEMAS).collect()
    return sorted(((*r[:7], json.loads(r.record)["result"]) for r in got), key=str)


def test_every_call_and_result_is_a_row(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(12):
        length = 150 if conv == 0 else rng.randrange(1, 14)
        names = [f"c{k}" for k in range(40 if conv == 0 else 3)]
        for turn in range(length):
            calls = [(rng.choice(names), "f", f'{{"x":{turn}}}', rng.choice([None, *names])) for _ in range(rng.randrange(3))]
            rows.append((conv, turn, f"t{turn}", calls, rng.choice([None, *names, "lost"])))
    got = run_every(spark, rows)
    assert got == brute_force_of_every(rows)
    assert {"answered", "early", "unanswered", "orphan", "duplicate"} == {r[5] for r in got}


def test_ids_that_start_again_each_turn(spark):
    rows = [(1, 1, "", [("call_0", "f", '{"x":1}', None)], None), (1, 3, "", [("call_0", "f", '{"x":3}', "call_0"), ("call_1", "f", '{"x":-4}', "call_0")], None),
            (1, 4, "four", None, "call_0"), (1, 5, "again", None, "call_1"), (1, 6, "more", None, "call_1")]
    assert run_every(spark, rows) == [
        (1, "call_0", 1, 0, "f", "unanswered", 0, None), (1, "call_0", 3, 0, "f", "answered", 1, "four"),
        (1, "call_1", 3, 1, "f", "answered", 2, "again"), (1, "call_1", 6, None, None, "duplicate", None, "more"),
    ]
    odd = [(3, 1, "t", [("a", "f", "{}", None)] * 2, None), (None, None, "t", [("z", "f", "{}", "z"), (None, "f", "{}", None)], "z")]
    assert [r[:7] for r in run_every(spark, odd)] == sorted(
        [(3, "a", 1, 0, "f", "unanswered", 0), (3, "a", 1, 1, "f", "unanswered", 0),
         (None, "z", None, 0, "f", "answered", None), (None, None, None, 1, "f", "unanswered", 0)], key=str
    )
    assert run_every(spark, []) == []


def test_registered_query_keeps_repeated_ids(spark):
    conversations = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    messages = derived.tool_messages(conversations)
    calls = messages.select("conv_id", "turn", F.posexplode("calls"))
    got = queries.registered()["op8_tool_calls"](spark, "/root/testdata/sf0.001").where("place IS NOT NULL").collect()
    assert sorted((r.conv_id, r.turn, r.place) for r in got) == sorted((r.conv_id, r.turn, r.pos) for r in calls.collect())
    assert len({(r.conv_id, r.call_id) for r in got}) < len(got)

"""Tool calls of conversations: linked to their results, ordered, validated, serialised."""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.sources.scratch import stored

_TYPES = {
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: not isinstance(v, bool) and (isinstance(v, int) or isinstance(v, float) and v.is_integer()),
    "number": lambda v: not isinstance(v, bool) and isinstance(v, int | float),
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "null": lambda v: v is None,
}


def violations(value, schema: dict, path: str = "$") -> list[str]:
    """What is wrong with a JSON value, by the usual words of a JSON schema.

    Known words: type, enum, required, properties, additionalProperties (false),
    items, minimum, maximum, minLength, maxLength. Others are ignored.
    """
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_TYPES[k](value) for k in kinds):
        return [f"{path}: not of type {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not an allowed value")
    if _TYPES["number"](value):
        if value < schema.get("minimum", value):
            out.append(f"{path}: below {schema['minimum']}")
        if value > schema.get("maximum", value):
            out.append(f"{path}: above {schema['maximum']}")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{path}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{path}: too long")
    if isinstance(value, list) and "items" in schema:
        out += [e for k, v in enumerate(value) for e in violations(v, schema["items"], f"{path}[{k}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for name in sorted(value):
            if name in known:
                out += violations(value[name], known[name], f"{path}.{name}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{name}: not expected")
    return out


def parsed(text: str):
    """Strict JSON: no repeated keys, no NaN, infinities or numbers beyond a double, no lone
    surrogates, no more nesting than can be walked. ValueError otherwise. Integers may have
    any number of digits.
    """

    def pairs(items: list[tuple]) -> dict:
        if len(dict(items)) < len(items):
            raise ValueError("repeated key")
        return dict(items)

    def refuse(name: str):
        raise ValueError(f"{name} is not JSON")

    def bounded(digits: str) -> float:
        value = float(digits)
        return refuse(digits[:40]) if math.isinf(value) else value

    sys.set_int_max_str_digits(0)
    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_constant=refuse, parse_float=bounded)
        # What cannot be written in UTF-8 or walked to the end is not taken either.
        canonical(value).encode()
        return value
    except UnicodeEncodeError:
        raise ValueError("lone surrogate") from None
    except RecursionError:
        raise ValueError("nested too deeply") from None


def canonical(value) -> str:
    """JSON with keys by code point, no blanks, whole numbers without a fraction."""

    def plain(v):
        if isinstance(v, float) and v.is_integer() and abs(v) < 2**53:
            return int(v)
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): how many calls must be answered before each, null in a cycle.

    Each call waits for at most one other, so the way up doubles every round: log2 of
    the longest chain, however long the conversation is.
    """
    ids = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("known"))
    state = calls.select("conv_id", "call_id", "after").join(ids, ["conv_id", "after"], "left")
    up = F.when(F.col("known"), F.col("after"))
    state = state.select("conv_id", "call_id", up.alias("up"), up.isNotNull().cast("long").alias("level"))
    state = stored(state, "levels")
    waiting, before = state.where("up IS NOT NULL").count(), None
    while waiting and waiting != before:
        above = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        moving = state.where("up IS NOT NULL").join(above, ["conv_id", "up"])
        moving = moving.select("conv_id", "call_id", F.col("next").alias("up"), (F.col("level") + F.col("more")).alias("level"))
        state = stored(state.where("up IS NULL").union(moving), "levels")
        before, waiting = waiting, state.where("up IS NOT NULL").count()
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def _by_turn() -> tuple[Column, Column]:
    """Sort keys: a message's turn, messages without one last."""
    return F.col("turn").isNull(), F.col("turn")


def _waits(calls: DataFrame) -> DataFrame:
    """`calls` with `wanted`: which of the calls named `after` each waits for.

    The last one before the call, or else the first. Only references to ids that repeat
    are sorted with them, so an id that is not repeated may have any number of them.
    """
    several = calls.where("nth = 2").select("key", F.col("call_id").alias("after"), F.lit(True).alias("several"))
    calls = calls.join(several, ["key", "after"], "left")
    plain = calls.where("several IS NULL").withColumn("wanted", F.lit(1)).drop("several")
    refer = calls.where("several").drop("several")
    named = calls.where("call_id IS NOT NULL").join(
        several.select("key", F.col("after").alias("call_id")), ["key", "call_id"], "left_semi"
    )
    marks = named.select("key", F.col("call_id").alias("id"), "turn", "place", F.lit(1).alias("kind"), "nth", F.lit(None).alias("row"))
    row = F.struct(*[c for c in refer.columns])
    marks = marks.unionByName(
        refer.select("key", F.col("after").alias("id"), "turn", "place", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("nth"), row.alias("row"))
    )
    order = Window.partitionBy("key", "id").orderBy(*_by_turn(), "place", "kind").rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("wanted", F.coalesce(F.last("nth", ignorenulls=True).over(order), F.lit(1)))
    return plain.unionByName(marks.where("kind = 0").select("row.*", "wanted"))


def _paired(calls: DataFrame, answers: DataFrame) -> DataFrame:
    """Every call and every result once, those of one id that belong together in one row.

    A result goes to the calls in the last turn before it that has any of its id, in
    turn; what is left on both sides is paired in turn as well.
    """
    call = F.struct(*[c for c in calls.columns if c not in ("key", "call_id")])
    none = F.lit(None)
    answer = F.struct("conv_id", "turn", "text")
    calls = calls.select("key", "call_id", "turn", F.lit(True).alias("is_call"), call.alias("call"))
    answers = answers.select("key", F.col("answers").alias("call_id"), "turn", F.lit(False).alias("is_call"), answer.alias("answer"))
    events = calls.withColumn("answer", none).unionByName(answers.withColumn("call", none))

    same = Window.partitionBy("key", "call_id")
    order = ("is_call", *_by_turn(), "call.nth", "answer.text")
    so_far = same.orderBy(*_by_turn(), "is_call").rowsBetween(Window.unboundedPreceding, 0)
    block = F.when(F.col("is_call"), F.col("turn")).otherwise(F.last(F.when(F.col("is_call"), F.col("turn")), ignorenulls=True).over(so_far))
    events = events.withColumn("block", block).withColumn("known", F.max("is_call").over(same))
    events = events.withColumn("k", F.row_number().over(Window.partitionBy("key", "call_id", "block", "is_call").orderBy(*order[1:])))
    both = [F.first("call", ignorenulls=True).alias("call"), F.first("answer", ignorenulls=True).alias("answer"), F.first("known").alias("known")]
    pairs = events.groupBy("key", "call_id", "block", "k").agg(*both).drop("block", "k")
    whole = F.col("call").isNotNull() & F.col("answer").isNotNull()
    turn = F.coalesce("call.turn", "answer.turn")
    pairs = pairs.withColumns({"whole": whole, "is_call": F.col("call").isNotNull(), "turn": turn})
    k = F.row_number().over(Window.partitionBy("key", "call_id", "whole", "is_call").orderBy(*order[1:]))
    pairs = pairs.withColumn("k", k).groupBy("key", "call_id", "whole", "k", F.when(F.col("whole"), F.col("call.nth")).alias("nth"))
    return pairs.agg(*both).select(
        "key", "call_id", "call.*", F.col("call").isNotNull().alias("called"), F.col("answer.conv_id").alias("answer_conv"),
        F.col("answer.turn").alias("answer_turn"), F.col("answer.text").alias("result"),
        F.when(F.col("answer").isNotNull(), True).alias("answered"), "known",
    ).withColumn("called", F.when(F.col("called"), True))


def linked_calls(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """A row per tool call, and per result without a call.

    `messages` has conv_id, turn, text, calls (array of struct id, name, arguments,
    after) and answers (the id of the call that the message is the result of). Returns
    conv_id, call_id, turn, place, name, status, level, valid, errors, record. Rows of a
    conversation are in order by (level, turn, place): a call comes after the one whose
    result it needs.

    Calls and results that share an id in a conversation each give a row, as where ids
    start again in every turn. A result belongs to the calls in the last turn before it
    that has any of its id, in turn, and else to one still without a result; results left
    over are duplicate. A call waits for the last call of that id before it, or else for the
    first. The repeats of one id in one conversation are sorted by one task. Messages without
    conv_id are one conversation, apart from one with an empty name.

    status is answered, early (the result's turn is not after the call's), unanswered,
    orphan (a result only) or duplicate. A call without an id is
    unanswered and has none. level is null where calls wait for each other in a circle;
    waiting for a call that does not exist is waiting for none. valid is null for
    results only; unknown tools and arguments that are no JSON object are invalid; errors
    lists why. record is canonical JSON of call and result; arguments that are no JSON (see
    `parsed`) stay a string in it. Messages without calls and answers give nothing. Conversations of
    any length are spread by call; none is gathered.
    """
    call = F.posexplode("calls").alias("place", "call")
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key")
    calls = messages.select(key, "conv_id", "turn", call)
    calls = calls.where("call IS NOT NULL").select(
        "key", "conv_id", "turn", "place", F.col("call.id").alias("call_id"), "call.name", "call.arguments", "call.after"
    )
    unnamed = calls.where("call_id IS NULL").drop("key")
    calls = calls.where("call_id IS NOT NULL")
    answers = messages.where("answers IS NOT NULL").select(key, "conv_id", "turn", "text", "answers")
    order = Window.partitionBy("key", "call_id").orderBy(*_by_turn(), "place", "name", "arguments", "after")
    calls = _waits(stored(calls.withColumn("nth", F.row_number().over(order)), "calls"))
    calls = stored(calls, "calls")

    item, wanted = F.struct(F.col("call_id").alias("id"), "nth"), F.struct(F.col("after").alias("id"), F.col("wanted").alias("nth"))
    waiting = calls.select(F.col("key").alias("conv_id"), item.alias("call_id"), F.when(F.col("after").isNotNull(), wanted).alias("after"))
    levels = _levels(waiting).select(F.col("conv_id").alias("key"), "call_id.id", "call_id.nth", "level").withColumnRenamed("id", "call_id")
    calls = calls.drop("wanted").join(levels, ["key", "call_id", "nth"])
    rows = _paired(calls, answers)
    status = (
        F.when(F.col("called").isNull() & F.col("known"), "duplicate")
        .when(F.col("called").isNull(), "orphan")
        .when(F.col("answered").isNull(), "unanswered")
        .when(F.col("answer_turn") <= F.col("turn"), "early")
        .otherwise("answered")
    )
    rows = rows.select(
        F.coalesce("conv_id", "answer_conv").alias("conv_id"), "call_id", F.coalesce("turn", "answer_turn").alias("turn"),
        "place", "name", status.alias("status"), "level", "arguments", "after", "result",
    )
    none = F.lit(None).cast("string")
    unnamed = unnamed.select(
        "conv_id", "call_id", "turn", "place", "name", F.lit("unanswered").alias("status"),
        F.lit(0).cast("long").alias("level"), "arguments", "after", none.alias("result"),
    )
    rows = rows.unionByName(unnamed)
    kept = [f for f in rows.schema.fields if f.name not in ("arguments", "after", "result")]
    kind = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept])
    return rows.mapInArrow(_records(schemas), f"{kind}, valid boolean, errors array<string>, record string")


def _records(schemas: dict[str, dict]):
    def record(row: dict) -> tuple[bool | None, list[str], str]:
        errors, arguments = [], row["arguments"]
        if row["status"] in ("orphan", "duplicate"):
            out = {"conv_id": row["conv_id"], "id": row["call_id"], "result": row["result"]}
            return None, errors, canonical(out)
        try:
            arguments = parsed(arguments or "")
            if not isinstance(arguments, dict):
                errors.append("$: not an object")
            elif row["name"] in schemas:
                errors += violations(arguments, schemas[row["name"]])
        except ValueError as bad:
            errors.append(f"not JSON: {bad}")
        if row["name"] not in schemas:
            errors.append("unknown tool")
        names = {"conv_id": "conv_id", "id": "call_id", "name": "name", "after": "after", "result": "result"}
        out = {k: row[v] for k, v in names.items()} | {"arguments": arguments}
        return not errors, errors, canonical(out)

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [record(row) for row in batch.to_pylist()]
            names = [n for n in batch.schema.names if n not in ("arguments", "after", "result")]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch[n] for n in names],
                    pa.array([m[0] for m in made], pa.bool_()),
                    pa.array([m[1] for m in made], pa.list_(pa.string())),
                    pa.array([m[2] for m in made], pa.string()),
                ],
                names=[*names, "valid", "errors", "record"],
            )

    return serialise

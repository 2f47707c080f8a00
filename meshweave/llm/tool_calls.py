"""Chat formatting: links tool calls with their results and writes canonical JSON.

A message may hold tool calls: an ``assistant`` text that is a JSON object with ``tool_calls``, a
list of ``{"id", "name", "arguments"}`` (arguments an object, or a string holding one). A ``tool``
text that is a JSON object with ``tool_call_id`` and ``content`` is a result. Anything else is
plain content. Arguments may name another call's result as ``{"$ref": id}``.

* Calls and results are hash-joined by conversation and identifier. Where calls repeat an identifier
  the earliest keeps it; the others, and results without a call, are errors.
* Calls are put in topological order: a call without references has level 0, its result follows it,
  and a call that refers to results follows the latest of them. Calls on a cycle, and those that wait
  for one, get level -1. Calls are ranged by conversation and turn, and a task orders runs of up to
  ``run_calls`` of them at a time, given what is placed already; so a round places whole chains, no
  conversation is gathered in one place, and the rounds are as many as runs that a chain goes through.
* Arguments are checked against the schema of the tool (the keywords ``CHECKED``), as far as ``schemas``
  has one. A schema may be true or false; a keyword whose value has no meaning (null, or of another type)
  allows anything, as what is no schema does. ``unchecked`` names the keywords that are not looked at.
  Values are equal as JSON: true is not 1, and 1 is 1.0.
* Each message is written with keys sorted by UTF-16 units, no spaces, unescaped Unicode but for lone
  surrogates, and numbers as ECMAScript lays out doubles; but whole numbers keep all their digits, unless
  they have 22 and are just a double. A text with a fraction or a power that no double holds, with a whole
  number of more than 4300 digits, with NaN or Infinity, or nested deeper than ``DEPTH`` is no JSON, and so
  plain content. A text of any length is looked at whole.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, tidy

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
DEPTH = 200
CHECKED = ("type", "enum", "const", "required", "properties", "additionalProperties", "items", "anyOf", "minimum", "maximum")
_LONE = re.compile("[\ud800-\udfff]")


def clean(text: str | None) -> str | None:
    """Lone surrogates, which UTF-8 cannot hold, as their escapes."""
    return None if text is None else _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _number(value: float) -> str:
    """The shortest decimal of a double, laid out as ECMAScript does."""
    mantissa, _, exponent = repr(abs(value)).partition("e")
    whole, _, fraction = mantissa.partition(".")
    digits = (whole + fraction).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + fraction) - len(digits))
    digits = digits.rstrip("0")
    if not digits:
        return "0"
    sign = "-" if value < 0 else ""
    if len(digits) <= point <= 21:
        return sign + digits.ljust(point, "0")
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{point - 1:+d}"


def canonical(value: Any) -> str:
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    if isinstance(value, int) and 10**21 <= abs(value) < 10**308 and float(value) == value:
        return _number(float(value))
    text = json.dumps(value, ensure_ascii=False)
    return clean(text) if isinstance(value, str) else text


def _finite(text: str) -> float:
    value = float(text)
    if math.isinf(value):
        raise ValueError("no double")
    return value


def _refused(text: str) -> None:
    raise ValueError(f"{text} is no JSON")


def parse(text: str) -> Any:
    """A JSON text; ValueError if it is none (see above)."""
    try:
        value = json.loads(text, parse_constant=_refused, parse_float=_finite)
    except RecursionError as e:
        raise ValueError("nested too deep") from e
    level, depth = [value], 0
    while level:
        depth += 1
        if depth > DEPTH:
            raise ValueError("nested too deep")
        level = [y for x in level if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]
    return value


def _is(value: Any, kind: Any) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "integer":
        return number and (isinstance(value, int) or value.is_integer())
    if kind == "number":
        return number
    return isinstance(value, _TYPES.get(kind, object)) if isinstance(kind, str) else True


def _same(a: Any, b: Any) -> bool:
    """Whether two values are equal as JSON."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return a == b


def errors_of(value: Any, schema: Any, at: str = "$") -> list[str]:
    """What is wrong with a value under a schema, in order of the paths."""
    if isinstance(value, dict) and isinstance(value.get("$ref"), str) and len(value) == 1:
        return []  # stands for a result of any type
    if schema is False:
        return [f"{at}: not allowed"]
    if not isinstance(schema, dict):
        return []

    def of(key: str, kind: Any) -> Any:
        found = schema.get(key)
        return found if isinstance(found, kind) and not isinstance(found, bool) else None

    kinds = of("type", list) or ([schema["type"]] if of("type", str) else [])
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(map(str, kinds))}"]
    out = []
    if of("enum", list) is not None and not any(_same(value, x) for x in schema["enum"]):
        out.append(f"{at}: not in enum")
    if "const" in schema and not _same(value, schema["const"]):
        out.append(f"{at}: not const")
    if of("anyOf", list) and all(errors_of(value, x, at) for x in schema["anyOf"]):
        out.append(f"{at}: none of anyOf")
    if _is(value, "number"):
        out += [f"{at}: below minimum"] * (of("minimum", (int, float)) is not None and value < schema["minimum"])
        out += [f"{at}: above maximum"] * (of("maximum", (int, float)) is not None and value > schema["maximum"])
    if isinstance(value, dict):
        known, more = of("properties", dict) or {}, schema.get("additionalProperties")
        out += [f"{at}.{k}: missing" for k in sorted(x for x in of("required", list) or () if isinstance(x, str)) if k not in value]
        for k in sorted(value):
            if k in known:
                out += errors_of(value[k], known[k], f"{at}.{k}")
            elif more is False:
                out.append(f"{at}.{k}: unknown")
            else:
                out += errors_of(value[k], more, f"{at}.{k}")
    if isinstance(value, list):
        items = schema.get("items")
        for k, x in enumerate(value):
            out += errors_of(x, (items[k] if k < len(items) else None) if isinstance(items, list) else items, f"{at}[{k}]")
    return out


def unchecked(schema: Any, at: str = "$") -> list[str]:
    """Keywords of a schema that say something about values and are not looked at, with their paths."""
    if not isinstance(schema, dict):
        return []
    told = ("title", "description", "default", "examples", "deprecated", "$schema", "$id", "$comment")
    out = [f"{at}.{k}" for k in sorted(map(str, schema)) if k not in CHECKED and k not in told]
    parts = [(f"{at}.properties.{k}", x) for k, x in schema["properties"].items()] if isinstance(schema.get("properties"), dict) else []
    for key in ("items", "anyOf", "additionalProperties"):
        found = schema.get(key)
        parts += [(f"{at}.{key}[{k}]", x) for k, x in enumerate(found)] if isinstance(found, list) else [(f"{at}.{key}", found)]
    return out + [x for where, part in parts for x in unchecked(part, where)]


def references(value: Any) -> set[str]:
    if isinstance(value, dict):
        if len(value) == 1 and isinstance(value.get("$ref"), str):
            return {value["$ref"]}
        value = list(value.values())
    return set().union(*map(references, value)) if isinstance(value, list) and value else set()


def _parsed(text: str | None, marker: str) -> dict | None:
    if not text or marker not in text or not text.lstrip().startswith("{"):
        return None
    try:
        value = parse(text)
    except ValueError:
        return None
    return value if isinstance(value, dict) and marker in value else None


def message_of(role: str | None, text: str | None, schemas: dict[str, dict]) -> tuple[dict, list[dict], str | None]:
    """The message without its place, its calls, and the identifier that it is a result of."""
    if role == "assistant" and (found := _parsed(text, "tool_calls")) and isinstance(found["tool_calls"], list):
        calls = []
        for call in found["tool_calls"]:
            call = call if isinstance(call, dict) else {}
            arguments, wrong = call.get("arguments", {}), []
            if isinstance(arguments, str):
                try:
                    arguments = parse(arguments)
                except ValueError:
                    wrong = ["$: not JSON"]
            name = call.get("name") if isinstance(call.get("name"), str) else ""
            if not wrong:
                wrong = errors_of(arguments, schemas.get(name, {"type": "object"}))
            calls.append({"id": call["id"] if isinstance(call.get("id"), str) else None, "name": name, "arguments": arguments, "errors": wrong, "needs": sorted(references(arguments))})
        shown = [{k: c[k] for k in ("id", "name", "arguments")} for c in calls]
        return {"role": role, "content": found.get("content"), "tool_calls": shown}, calls, None
    if role == "tool" and (found := _parsed(text, "tool_call_id")) and isinstance(found["tool_call_id"], str):
        return {"role": role, "content": found.get("content"), "tool_call_id": found["tool_call_id"]}, [], found["tool_call_id"]
    return {"role": role, "content": text}, [], None


_CALL = pa.struct([("id", pa.string()), ("name", pa.string()), ("errors", pa.list_(pa.string())), ("needs", pa.list_(pa.string()))])
_SCHEMA = "conv_id long, turn long, role string, message string, calls array<struct<id:string,name:string,errors:array<string>,needs:array<string>>>, result_of string"


_PLACED = "conv_id long, id string, order_turn long, level int, result_turn long"


def _run_order(calls: list[tuple]) -> list[tuple]:
    """Of calls (conv_id, id, turn, result_turn, open needs, ready turn, ready level) those whose open
    needs are placed here, with their order turn and level."""
    at = {c[:2]: k for k, c in enumerate(calls)}
    waits, asked = [len(c[4]) for c in calls], {}
    for k, c in enumerate(calls):
        for need in c[4]:
            if (c[0], need) in at:
                asked.setdefault(at[c[0], need], []).append(k)
    turn, level = [max(c[2], c[5] or c[2]) for c in calls], [c[6] or 0 for c in calls]
    free = [k for k, n in enumerate(waits) if not n]
    for k in free:  # grows as calls are freed
        done = max(turn[k], calls[k][3] if calls[k][3] is not None else turn[k])
        for j in asked.get(k, ()):
            turn[j], level[j] = max(turn[j], done), max(level[j], level[k] + 2)
            waits[j] -= 1
            if not waits[j]:
                free.append(j)
    return [(*calls[k][:2], turn[k], level[k], calls[k][3]) for k in free]


def _placed(nodes: DataFrame, run_calls: int) -> DataFrame:
    """``conv_id``, ``id``, ``order_turn``, ``level`` and ``result_turn`` of all calls."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needs = nodes.select("conv_id", "id", F.explode("needs").alias("need"))
    needs = materialise(needs.join(nodes.select("conv_id", F.col("id").alias("need")), ["conv_id", "need"], "left_semi").distinct(), "needs")
    types = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            found = _run_order(held)
            columns = zip(*found, strict=True) if found else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["conv_id", "id", "order_turn", "level", "result_turn"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) >= run_calls:
                    yield out()
                    held = []
        if held:
            yield out()

    placed = None
    while True:
        done = placed.select("conv_id", F.col("id").alias("need"), F.greatest("order_turn", "result_turn").alias("t"), "level") if placed is not None else None
        waiting = needs.groupBy("conv_id", "id").agg(F.collect_list("need").alias("open"), F.lit(None).cast("long").alias("t"), F.lit(None).cast("int").alias("l"))
        left = nodes
        if done is not None:
            met = needs.join(done, ["conv_id", "need"], "left")
            waiting = met.groupBy("conv_id", "id").agg(F.collect_list(F.when(F.col("level").isNull(), F.col("need"))).alias("open"), F.max("t").alias("t"), (F.max("level") + 2).alias("l"))
            left = nodes.join(placed.select("conv_id", "id"), ["conv_id", "id"], "left_anti")
        rows = left.join(waiting, ["conv_id", "id"], "left").select("conv_id", "id", "turn", "result_turn", F.coalesce("open", F.array().cast("array<string>")).alias("open"), "t", "l")
        ranged = rows.repartitionByRange(parts, "conv_id", "turn", "id").sortWithinPartitions("conv_id", "turn", "id")
        new = materialise(ranged.mapInArrow(tidy(run), _PLACED), "placed")
        if new.isEmpty():
            break
        placed = new if placed is None else placed.union(new)
    on_cycle = nodes.select("conv_id", "id", F.col("turn").alias("order_turn"), F.lit(-1).alias("level"), "result_turn")
    if placed is None:
        return on_cycle
    return placed.union(on_cycle.join(placed.select("conv_id", "id"), ["conv_id", "id"], "left_anti"))


def link_tool_calls(conversations: DataFrame, schemas: dict[str, dict] | None = None, run_calls: int = 10_000, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: ``conv_id``, ``turn``, ``role``, ``order_turn`` and ``level`` (sorting by
    these and ``turn`` gives the topological order), ``n_calls``, ``n_linked``, ``n_errors`` and
    ``message``. Null ids, turns, roles and texts pass through as null; repeated rows each count.
    """
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    known = dict(schemas or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            messages, calls, results = [], [], []
            for conv_id, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                message, own, result = message_of(role, text, known)
                messages.append(canonical(message | {"conv_id": conv_id, "turn": turn}))
                calls.append([{"id": clean(c["id"]), "name": clean(c["name"]), "errors": [*map(clean, c["errors"])], "needs": [*map(clean, c["needs"])]} for c in own])
                results.append(clean(result))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(messages, pa.string()), pa.array(calls, pa.list_(_CALL)), pa.array(results, pa.string())], ["conv_id", "turn", "role", "message", "calls", "result_of"]
            )

    parsed = materialise(rows.mapInArrow(tidy(run), _SCHEMA), "messages")
    plain = parsed.where("size(calls) = 0 AND result_of IS NULL").select("conv_id", "turn", "role", F.col("turn").alias("order_turn"), *(F.lit(0).alias(c) for c in ("level", "n_calls", "n_linked", "n_errors")), "message")
    tools = parsed.where("size(calls) > 0 OR result_of IS NOT NULL")
    if tools.isEmpty():
        return plain
    calls = tools.select("conv_id", "turn", F.posexplode("calls").alias("pos", "call")).select("conv_id", "turn", "pos", "call.*")
    first = calls.where("id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "pos")).alias("at"), F.count("*").alias("copies"))
    nodes = calls.join(first, ["conv_id", "id"]).where("turn = at.turn AND pos = at.pos").select("conv_id", "id", "turn", "needs").dropDuplicates(["conv_id", "id"])
    results = tools.where("result_of IS NOT NULL").select("conv_id", F.col("result_of").alias("id"), F.col("turn").alias("result_turn"))
    answered = results.groupBy("conv_id", "id").agg(F.min("result_turn").alias("result_turn"))
    nodes = materialise(nodes.join(answered.hint("shuffle_hash"), ["conv_id", "id"], "left"), "calls")
    placed = _placed(nodes, run_calls)
    where = calls.join(first, ["conv_id", "id"], "left").withColumn("own", F.coalesce((F.col("turn") == F.col("at.turn")) & (F.col("pos") == F.col("at.pos")), F.lit(False)))
    where = where.join(placed, ["conv_id", "id"], "left")
    own = F.col("own")
    asked = where.groupBy("conv_id", "turn").agg(
        F.max(F.when(own, F.col("order_turn"))).alias("o"), F.max(F.when(own, F.col("level"))).alias("l"), F.count("*").alias("calls_"),
        F.sum((own & F.col("result_turn").isNotNull()).cast("int")).alias("linked"), F.sum(F.size("errors") + F.when(own, 0).otherwise(1)).alias("wrong"),
    )
    # A message without conversation or turn meets no aggregate: its calls have no place, each is an error.
    lost = F.aggregate("calls", F.lit(0), lambda n, c: n + F.size(c["errors"]) + 1)
    asked = tools.where("size(calls) > 0").join(asked, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", F.coalesce("o", "turn").alias("order_turn"), F.coalesce("l", F.lit(0)).alias("level"), F.coalesce("calls_", F.size("calls")).cast("int"), F.coalesce("linked", F.lit(0)).cast("int"), F.coalesce("wrong", lost).cast("int"), "message"
    )
    told = tools.where("result_of IS NOT NULL").join(placed.select("conv_id", F.col("id").alias("result_of"), F.col("order_turn").alias("o"), F.col("level").alias("l")), ["conv_id", "result_of"], "left")
    told = told.select(
        "conv_id", "turn", "role", F.greatest("turn", "o").alias("order_turn"), F.when(F.col("l") >= 0, F.col("l") + 1).otherwise(F.coalesce("l", F.lit(0))).alias("level"), F.lit(0), F.col("o").isNotNull().cast("int"), F.col("o").isNull().cast("int"), "message"
    )
    return plain.union(asked).union(told)

"""Chat formatting: linking tool calls and results, ordering, validation, canonical JSON.

A message's text is plain, or a JSON object. An object with `tool_calls` (a list of
{id, name, arguments}; a nested `function` may hold name and arguments, and arguments may be
JSON text) makes calls; one with `tool_call_id` is a result. A call depends on the calls in
its `depends_on` and on every {"$ref": id} in its arguments.

Calls and results are joined by hash of (conversation, id). Levels follow by peeling: each
round settles the calls whose dependencies are settled, one more than the highest of them.
No step gathers a conversation: every group is one call id or one message, so a
conversation that holds a third of all rows is spread like any others.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import written

TOOLS = 8
_CALL = "struct<id:string,name:string,arguments:string,depends:array<string>>"
PARSED = f"row bigint, conv_id bigint, turn bigint, role string, kind string, body string, calls array<{_CALL}>, answers string"


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, and characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def references(value) -> set[str]:
    """Call ids that {"$ref": id} objects name anywhere in a value."""
    if isinstance(value, dict):
        own = {value["$ref"]} if set(value) == {"$ref"} and isinstance(value["$ref"], str) else set()
        return own.union(*map(references, value.values()))
    return set().union(*map(references, value)) if isinstance(value, list) else set()


def parsed(text: str | None) -> tuple[str, dict, list[dict], str | None]:
    """Kind (plain, call or result), the message's fields, its calls, and the call that it answers."""
    try:
        value = json.loads(text) if text and text.lstrip()[:1] == "{" else None
    except (ValueError, RecursionError):
        value = None
    if not isinstance(value, dict):
        return "plain", {"content": text}, [], None
    calls = []
    for c in value.get("tool_calls") if isinstance(value.get("tool_calls"), list) else []:
        c = c if isinstance(c, dict) else {}
        inner = c.get("function") if isinstance(c.get("function"), dict) else c
        args = inner.get("arguments")
        if isinstance(args, str):
            try:
                args = json.loads(args)
            except ValueError:
                pass
        depends = c.get("depends_on") if isinstance(c.get("depends_on"), list) else []
        depends = {d for d in depends if isinstance(d, str)} | references(args)
        name, own = inner.get("name"), c.get("id")
        calls.append({"id": own if isinstance(own, str) else None, "name": name if isinstance(name, str) else None, "arguments": canonical(args), "depends": sorted(depends)})
    if calls:
        return "call", {k: v for k, v in value.items() if k != "tool_calls"}, calls, None
    if isinstance(value.get("tool_call_id"), str):
        return "result", {k: v for k, v in value.items() if k != "tool_call_id"}, [], value["tool_call_id"]
    return "plain", {"content": text}, [], None


def faults(value, schema, at: str = "$") -> list[str]:
    """What in a value goes against a JSON schema: type, enum, const, required, properties, items and bounds.

    A {"$ref": id} stands for a value that isn't known yet and is accepted.
    """
    if not isinstance(schema, dict) or isinstance(value, dict) and set(value) == {"$ref"}:
        return []
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}

    def is_kind(kind: str) -> bool:
        if kind in ("integer", "number"):
            return not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, float) and (kind == "number" or value.is_integer()))
        return isinstance(value, kinds[kind]) if kind in kinds else True

    wanted = schema.get("type")
    wanted = [wanted] if isinstance(wanted, str) else wanted
    if wanted and not any(map(is_kind, wanted)):
        return [f"{at}: not {' or '.join(wanted)}"]
    out = [f"{at}: not one of the values" for _ in [0] if "enum" in schema and value not in schema["enum"] or "const" in schema and value != schema["const"]]
    if isinstance(value, dict):
        known = schema.get("properties") or {}
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in sorted(value.items()):
            if k in known:
                out += faults(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += faults(v, schema["additionalProperties"], f"{at}.{k}")
    if isinstance(value, list):
        for i, v in enumerate(value):
            out += faults(v, schema.get("items"), f"{at}[{i}]")
        size, names = len(value), ("minItems", "maxItems")
    elif isinstance(value, str):
        size, names = len(value), ("minLength", "maxLength")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        size, names = value, ("minimum", "maximum")
    else:
        return out
    low, high = (schema.get(n) for n in names)
    return out + [f"{at}: out of bounds" for _ in [0] if low is not None and size < low or high is not None and size > high]


def _validated(calls: DataFrame, tools: DataFrame | None) -> DataFrame:
    """Adds `faults`: null without a schema for the name, else the list. tools: (name, schema as JSON)."""
    if tools is None:
        return calls.withColumn("faults", F.lit(None).cast("array<string>"))
    known = tools.where("name IS NOT NULL").groupBy(F.col("name").alias("tool")).agg(F.min("schema").alias("schema"))
    joined = calls.join(known, calls.name == known.tool, "left").drop("tool")
    at = {c: i for i, c in enumerate(joined.columns)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for args, schema in zip(b.column(at["arguments"]).to_pylist(), b.column(at["schema"]).to_pylist()):
                try:
                    out.append(None if schema is None else faults(json.loads(args), json.loads(schema)))
                except ValueError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.string()))], names=[*b.schema.names, "faults"])

    return joined.mapInArrow(work, T.StructType([*joined.schema.fields, T.StructField("faults", T.ArrayType(T.StringType()))])).drop("schema")


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, id, level) of first calls: 0 without dependencies; calls in or behind a cycle have no row.

    A dependency that no call of the conversation has is left out. Chains of calls with one
    dependency are followed by pointer doubling, so that they take a logarithm of their length
    in rounds; the calls that join several take a round each, deepest last.
    """
    edges = calls.select("conv_id", "id", F.explode("depends").alias("on"))
    known = calls.select(F.col("conv_id").alias("c"), F.col("id").alias("i"))
    edges = written(edges.join(known, (edges.conv_id == known.c) & (edges.on == known.i), "left_semi").distinct(), "edges")
    counted = edges.groupBy("conv_id", "id").agg(F.count("*").alias("n"), F.min("on").alias("on"))
    pointers = written(counted.where("n = 1").select("conv_id", "id", "on", F.lit(1).cast("bigint").alias("steps")), "pointers")
    most = pointers.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(most.bit_length()):  # after it, whoever still points to a pointer is in or behind a cycle
        to = pointers.select(F.col("conv_id").alias("c"), F.col("id").alias("i"), F.col("on").alias("far"), F.col("steps").alias("more"))
        jumped = pointers.join(to, (pointers.conv_id == to.c) & (pointers.on == to.i), "left")
        pointers = written(jumped.select("conv_id", "id", F.coalesce("far", "on").alias("on"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "pointers")
    ends = pointers.select(F.col("conv_id").alias("c"), F.col("id").alias("i"), F.col("on").alias("root"), "steps")
    joins = counted.where("n > 1").select("conv_id", "id")
    wide = edges.join(joins, ["conv_id", "id"], "left_semi").join(ends, (edges.conv_id == F.col("c")) & (edges.on == F.col("i")), "left")
    wide = written(wide.select("conv_id", "id", F.coalesce("root", "on").alias("on"), F.coalesce("steps", F.lit(0)).alias("steps")), "joins")
    settled = written(calls.select("conv_id", "id").join(counted.select("conv_id", "id"), ["conv_id", "id"], "left_anti").withColumn("level", F.lit(0).cast("bigint")), "levels")
    while True:
        done = settled.select(F.col("conv_id").alias("c"), F.col("id").alias("i"), "level")
        ready = wide.join(done, (wide.conv_id == done.c) & (wide.on == done.i), "left").groupBy("conv_id", "id").agg(F.max(F.col("level") + F.col("steps")).alias("high"), F.count("*").alias("n"), F.count("level").alias("have"))
        new = written(ready.where("n = have").join(settled, ["conv_id", "id"], "left_anti").select("conv_id", "id", (F.col("high") + 1).alias("level")), "levels")
        if not new.limit(1).count():
            break
        settled = settled.unionByName(new)
    root = settled.select(F.col("conv_id").alias("c"), F.col("id").alias("i"), "level")
    chained = pointers.join(root, (pointers.conv_id == root.c) & (pointers.on == root.i)).select("conv_id", "id", (F.col("level") + F.col("steps")).alias("level"))
    return settled.unionByName(chained).withColumn("level", F.col("level").cast("int"))


def derived(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages whose turns are tool calls and results, and the tools (name, schema as JSON), from any conversations.

    A user's turn t becomes a call with id `t`, of one of TOOLS tools by hash; from turn 2 on it
    refers to an earlier turn 2, 4, ... before it, by hash of its text, so that chains grow with
    the logarithm of a conversation. An assistant's turn t becomes the result of call `t - 1`,
    which is an orphan if that wasn't a user's. Other roles, and texts that hold calls or a
    result already, stay. A tool's schema bounds the text by the mean length of its calls'
    texts, so that longer ones are faults; a null text is one as well. No step gathers a
    conversation.
    """
    chosen = messages.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string"))
    own = F.coalesce(F.get_json_object("text", "$.tool_calls"), F.get_json_object("text", "$.tool_call_id"))
    has = F.when(F.ltrim("text").startswith("{"), own).isNotNull()
    named = F.concat(F.lit("tool_"), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(TOOLS)))
    back = (F.col("turn") - 2 * (1 + F.pmod(F.xxhash64("text"), F.floor(F.col("turn") / 2)))).cast("string")
    earlier = F.when(F.col("turn") >= 2, F.struct(back.alias("$ref")))
    arguments = F.struct("text", F.size(F.split("text", r"\s+")).alias("words"), earlier.alias("earlier"))
    call = F.struct(F.col("turn").cast("string").alias("id"), named.alias("name"), arguments.alias("arguments"))
    asked = F.to_json(F.struct(F.array(call).alias("tool_calls")))
    told = F.to_json(F.struct((F.col("turn") - 1).cast("string").alias("tool_call_id"), F.col("text").alias("content")))
    text = F.when(has, F.col("text")).when(F.col("role") == "user", asked).when((F.col("role") == "assistant") & F.col("turn").isNotNull(), told).otherwise(F.col("text"))
    kind = lambda name, **more: F.struct(F.lit(name).alias("type"), *[v.alias(k) for k, v in more.items()])
    mean = F.ceil(F.avg(F.length("text")))
    properties = F.struct(kind("string", maxLength=F.col("most")).alias("text"), kind("integer", minimum=F.lit(1)).alias("words"), kind("object").alias("earlier"))
    schema = F.to_json(F.struct(F.lit("object").alias("type"), F.array(F.lit("text"), F.lit("words")).alias("required"), properties.alias("properties"), F.lit(False).alias("additionalProperties")))
    tools = chosen.where((F.col("role") == "user") & ~has).groupBy(named.alias("name")).agg(mean.alias("most")).select("name", schema.alias("schema"))
    return chosen.withColumn("text", text), tools


def formatted(messages: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """Per message: conv_id, turn, role, kind, n_calls, n_linked, level, status, faults, message_json.

    Messages have conv_id, turn, role, text; other columns aren't read. Of calls or results
    that share an id in a conversation, the first by turn, then place counts; the others'
    status says `duplicate`. Further statuses: `linked`, `unanswered` (a call without result),
    `orphan` (a result without call), `early` (a result before its call), `cycle`, `invalid`
    (arguments against the schema), `unnamed` (no id); null for plain messages. A message
    with several calls has the alphabetically first status that isn't `linked`, and its
    highest level. Null conv_ids belong to no conversation and aren't linked; a null turn
    comes first; repeated messages each keep a row; an empty table gives no rows.

    message_json has sorted keys: role, turn, content and other fields, `tool_calls` (by
    level, then place) with the turn of the answer, or `tool_call_id` with the call's turn.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for b in batches:
            found = [parsed(t) for t in b.column(3).to_pylist()]
            call = pa.list_(pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("depends", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(row, row + len(b)), pa.int64()), *b.columns[:3], pa.array([f[0] for f in found], pa.string()), pa.array([canonical(f[1]) for f in found], pa.string()), pa.array([f[2] for f in found], call), pa.array([f[3] for f in found], pa.string())],
                names=["row", "conv_id", "turn", "role", "kind", "body", "calls", "answers"],
            )
            row += len(b)

    chosen = messages.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string"))
    table = written(chosen.mapInArrow(parse, PARSED), "messages")
    calls = table.where("kind = 'call'").select("row", "conv_id", "turn", F.posexplode("calls").alias("place", "call")).select("row", "conv_id", "turn", "place", "call.*")
    results = table.where("kind = 'result'").select("row", "conv_id", "turn", F.col("answers").alias("id"))
    calls = written(_validated(calls, tools), "calls")
    first = calls.where("conv_id IS NOT NULL AND id IS NOT NULL").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "row", "place")).alias("at"), F.min_by("depends", F.struct("turn", "row", "place")).alias("depends"))
    answer = results.where("conv_id IS NOT NULL").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "row")).alias("back"))
    links = written(first.join(answer, ["conv_id", "id"], "full"), "links")
    firsts = links.where("at IS NOT NULL")
    links = written(links.drop("depends").join(_levels(firsts), ["conv_id", "id"], "left"), "links")

    c = calls.join(links, ["conv_id", "id"], "left")
    own = F.struct("turn", "row", "place")
    status = (
        F.when(F.col("at").isNull(), "unnamed")
        .when(own != F.col("at"), "duplicate")
        .when(F.col("level").isNull(), "cycle")
        .when(F.size("faults") > 0, "invalid")
        .when(F.col("back").isNull(), "unanswered")
        .when(F.col("back.turn") < F.col("turn"), "early")
        .otherwise("linked")
    )
    of_calls = c.select("row", "level", status.alias("status"), "faults", F.struct("level", "place", "id", "name", "arguments", F.col("back.turn").alias("answered"), status.alias("status")).alias("call"))
    by_call = of_calls.groupBy("row").agg(
        F.count("*").alias("n_calls"),
        F.count_if(F.col("status") == "linked").alias("n_linked"),
        F.max("level").alias("level"),
        F.coalesce(F.min(F.when(F.col("status") != "linked", F.col("status"))), F.min("status")).alias("status"),
        F.flatten(F.collect_list(F.coalesce("faults", F.array()))).alias("faults"),
        F.sort_array(F.collect_list("call")).alias("made"),
    )
    r = results.join(links, ["conv_id", "id"], "left")
    r_status = (
        F.when(F.col("conv_id").isNull() | F.col("at").isNull(), "orphan")
        .when(F.struct("turn", "row") != F.col("back"), "duplicate")
        .when(F.col("turn") < F.col("at.turn"), "early")
        .otherwise("linked")
    )
    by_result = r.select("row", F.lit(0).cast("bigint").alias("n_calls"), F.when(r_status == "linked", 1).otherwise(0).cast("bigint").alias("n_linked"), "level", r_status.alias("status"), F.array().cast("array<string>").alias("faults"), F.col("at.turn").alias("called"))
    joined = table.drop("calls").join(by_call.unionByName(by_result, allowMissingColumns=True), "row", "left")

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for m in b.select(["turn", "role", "kind", "body", "answers", "made", "called"]).to_pylist():
                value = json.loads(m["body"]) | {"role": m["role"], "turn": m["turn"]}
                if m["kind"] == "call":
                    value["tool_calls"] = [{"id": c["id"], "name": c["name"], "arguments": json.loads(c["arguments"]), "answered": c["answered"], "level": c["level"], "status": c["status"]} for c in m["made"] or []]
                elif m["kind"] == "result":
                    value |= {"tool_call_id": m["answers"], "called": m["called"]}
                out.append(canonical(value))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("conv_id", "turn", "role", "kind", "n_calls", "n_linked", "level", "status", "faults")), pa.array(out, pa.string())], names=["conv_id", "turn", "role", "kind", "n_calls", "n_linked", "level", "status", "faults", "message_json"])

    filled = joined.withColumns({"n_calls": F.coalesce("n_calls", F.lit(0)), "n_linked": F.coalesce("n_linked", F.lit(0)), "faults": F.coalesce("faults", F.array().cast("array<string>"))})
    return filled.mapInArrow(serialise, "conv_id bigint, turn bigint, role string, kind string, n_calls bigint, n_linked bigint, level int, status string, faults array<string>, message_json string")

"""Chat formatting: tool calls linked to their results.

Calls and results meet in a hash join on (conversation, call id). A call's arguments are validated against the JSON
schema of its tool. Calls are ordered topologically: after those whose results they use, else as they stand in the
conversation. Each becomes one canonical JSON object: keys sorted, no spaces, characters beyond ASCII kept.

The order comes from levels: a call that uses no other has level 0, any other one more than its highest. They are found
over all conversations at once, on tables in the shared folder: chains in as many rounds as the logarithm of their
length, calls that use several others one line of these a round. Calls that wait for each other, or for such, get the
level -1 and an error. No conversation is gathered in one task, nor are the calls that share an id.

Nulls: a call without conversation or id is linked with nothing; null arguments count as an empty object; arguments that
are no JSON object are an error. Of calls (or results) that share an id the earliest stands, others are marked repeated.
Results without a call are returned as orphans. Uses of unknown calls are an error. Ties of place go to the smaller name,
arguments and uses. Texts are taken whole, a few MB at a time between Spark and Python. Other columns are not read. Empty
tables give an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import hot_join, materialize, narrow_batches

_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def _is(value: object, kind: str) -> bool:
    if kind in ("integer", "number"):
        return not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, float) and (kind == "number" or value.is_integer()))
    return isinstance(value, _TYPES[kind])


def problems(value: object, schema: dict, at: str = "$") -> list[str]:
    """What of a JSON schema's type, enum, required, properties, additionalProperties, items, minimum, maximum, minLength and maxLength fails."""
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not of type {kinds if isinstance(kinds, str) else '|'.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}: {k} is missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}: {k} is unknown")
    elif isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += problems(x, schema["items"], f"{at}[{i}]")
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: too long")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: too small")
        if value > schema.get("maximum", value):
            out.append(f"{at}: too large")
    return out


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def levels(calls: DataFrame) -> DataFrame:
    """``(conv, call_id, level)`` of calls ``(conv, call_id, uses array<string>)``, whose ids are distinct in a conversation.

    Calls that use one other form chains, which pointer doubling shortens: after r rounds a call points 2^r calls back, or
    to the end of its chain, a call that uses none or several. Only the latter then settle in rounds, as many as the
    longest line of such calls. What waits for itself has the level -1."""
    edges = materialize(calls.select("conv", "call_id", F.explode("uses").alias("used")).distinct().join(calls.select("conv", F.col("call_id").alias("used")), ["conv", "used"], "left_semi"), "uses")
    free = calls.join(edges, ["conv", "call_id"], "left_anti").select("conv", "call_id", F.lit(0).alias("level"))
    if edges.isEmpty():
        return free
    counted = edges.groupBy("conv", "call_id").agg(F.count("*").alias("n"), F.min("used").alias("end"))
    chains = materialize(counted.where("n = 1").select("conv", "call_id", "end", F.lit(1).cast("long").alias("far"), F.lit(True).alias("moves")), "chains")
    many = materialize(counted.where("n > 1").select("conv", "call_id"), "many")
    total, covered = chains.count(), 1
    while covered <= 2 * total and not chains.where("moves").isEmpty():
        ahead = chains.select("conv", F.col("call_id").alias("end"), F.col("end").alias("next"), F.col("far").alias("more"))
        chains = materialize(chains.join(ahead, ["conv", "end"], "left").select("conv", "call_id", F.coalesce("next", "end").alias("end"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("next").isNotNull().alias("moves")), "chains")
        covered *= 2
    # what still moves after as many steps as there are calls goes round in a circle
    ended = chains.where("not moves").select("conv", "call_id", "end", "far")
    known, rounds = materialize(free, "level"), 0
    if not many.isEmpty():
        of = ended.select("conv", F.col("call_id").alias("used"), "end", "far")
        needs = edges.join(many, ["conv", "call_id"], "left_semi").join(of, ["conv", "used"], "left").join(chains.where("moves").select("conv", F.col("call_id").alias("used"), F.lit(True).alias("circle")), ["conv", "used"], "left")
        needs = materialize(needs.select("conv", "call_id", F.when(F.col("circle").isNull(), F.coalesce("end", "used")).alias("end"), F.coalesce("far", F.lit(0)).alias("far")), "needs")
        while True:
            each = needs.join(known.withColumnRenamed("call_id", "end"), ["conv", "end"], "left")
            ready = each.groupBy("conv", "call_id").agg(F.bool_and(F.col("level").isNotNull()).alias("all"), (F.max(F.col("level") + F.col("far")) + 1).cast("int").alias("level")).where("all").select("conv", "call_id", "level")
            new = materialize(ready, "ready")
            if new.isEmpty():
                break
            # what is settled is only added, and needs no further round; now and then the pieces become one table
            known, needs, rounds = known.unionByName(new), needs.join(new.select("conv", "call_id"), ["conv", "call_id"], "left_anti"), rounds + 1
            if rounds % 8 == 0:
                known, needs = materialize(known, "level"), materialize(needs, "needs")
    tails = ended.join(known.select("conv", F.col("call_id").alias("end"), "level"), ["conv", "end"]).select("conv", "call_id", (F.col("level") + F.col("far")).cast("int").alias("level"))
    found = materialize(known.unionByName(tails), "level")
    return found.unionByName(calls.join(found, ["conv", "call_id"], "left_anti").select("conv", "call_id", F.lit(-1).alias("level")))


def _copied(rows: DataFrame) -> DataFrame:
    """Each row as often as its column ``copies`` says, in lots, so that no row grows with it."""
    lots = rows.where("copies > 0").withColumn("_lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / 4096).cast("long"))))
    return lots.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(4096).cast("long"), F.col("copies") - F.col("_lot") * 4096)))).drop("_lot", "_i", "copies")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls ``(conv, call_id, place, name, arguments string, uses array<string>)``, results ``(conv, call_id, place, content)``.

    One row a call or orphan: ``(conv, call_id, place, status, level, valid, errors array<string>, json)``; status is linked,
    unanswered, repeated or orphan. Order a conversation by (level, place) for a topological order."""
    calls, fields = narrow_batches(calls), ["place", "name", "arguments", "uses"]
    named = calls.select("conv", "call_id", "place", "name", "arguments", F.coalesce("uses", F.array().cast("array<string>")).alias("uses"))
    kinds = materialize(named.groupBy("conv", "call_id", *fields).agg(F.count("*").alias("copies")), "call-kinds")
    real = F.col("conv").isNotNull() & F.col("call_id").isNotNull()
    about = kinds.where(real).groupBy("conv", "call_id").agg(F.min(F.struct(*fields)).alias("first"), F.count("*").alias("n"))
    marked = hot_join(kinds.where(real), about, ["conv", "call_id"], kinds.count()).withColumn("main", F.struct(*fields).eqNullSafe(F.col("first")))
    main = materialize(marked.where("main").select("conv", "call_id", *fields), "calls")
    repeated = _copied(marked.select("conv", "call_id", *fields, (F.col("copies") - F.col("main").cast("int")).alias("copies"))).withColumn("status", F.lit("repeated"))
    unnamed = _copied(kinds.where(~real)).withColumn("status", F.lit("unanswered"))
    others = repeated.unionByName(unnamed).withColumns({"level": F.lit(0), "answer": F.lit(None).cast("string")})
    answer = results.groupBy("conv", "call_id").agg(F.min(F.struct("place", "content")).alias("r")).select("conv", "call_id", F.col("r.content").alias("answer"), F.lit(True).alias("answered"))
    linked = main.join(answer, ["conv", "call_id"], "left").withColumn("status", F.when(F.col("answered"), "linked").otherwise("unanswered")).drop("answered")
    linked = linked.join(levels(main.select("conv", "call_id", "uses")), ["conv", "call_id"], "left")
    known = main.select("conv", F.col("call_id").alias("used"))
    lost = main.select("conv", "call_id", F.explode("uses").alias("used")).join(known, ["conv", "used"], "left_anti").groupBy("conv", "call_id").agg(F.sort_array(F.collect_set("used")).alias("lost"))
    rows = linked.join(lost, ["conv", "call_id"], "left").unionByName(others, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                errors = [f"uses unknown call {x}" for x in r["lost"] or ()]
                if r["level"] == -1:
                    errors.append("calls wait for each other")
                try:
                    arguments = json.loads(r["arguments"]) if r["arguments"] is not None else {}
                except ValueError:
                    arguments = None
                if not isinstance(arguments, dict):
                    errors.append("arguments are no JSON object")
                    arguments = None
                elif r["name"] not in schemas:
                    errors.append(f"unknown tool {r['name']}")
                else:
                    errors += problems(arguments, schemas[r["name"]])
                body = {"id": r["call_id"], "name": r["name"], "arguments": arguments, "uses": sorted(r["uses"]), "result": r["answer"]}
                out.append((r["conv"], r["call_id"], r["place"], r["status"], r["level"], not errors, errors, canonical(body)))
            if out:
                kinds = (batch.schema.field("conv").type, pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv", "call_id", "place", "status", "level", "valid", "errors", "json"])

    kind = dict(calls.dtypes)["conv"]
    schema = f"conv {kind}, call_id string, place long, status string, level int, valid boolean, errors array<string>, json string"
    body = rows.select("conv", F.col("call_id").cast("string"), F.col("place").cast("long"), "name", "arguments", "uses", "answer", "status", F.col("level").cast("int"), "lost").mapInArrow(run, schema)
    orphans = results.join(main.select("conv", "call_id"), ["conv", "call_id"], "left_anti")
    orphans = orphans.select("conv", F.col("call_id").cast("string"), F.col("place").cast("long"), F.lit("orphan").alias("status"), F.lit(0).alias("level"), F.lit(False).alias("valid"), F.array(F.lit("result without a call")).alias("errors"), F.lit(None).cast("string").alias("json"))
    return body.unionByName(orphans)


#: The tools that a conversation's turns stand for where the text itself has no calls.
TURN_SCHEMAS = {
    "count": {"type": "object", "required": ["items"], "additionalProperties": False, "properties": {"items": {"type": "array", "items": {"type": "integer", "minimum": 0}}}},
    "digest": {"type": "object", "required": ["of"], "additionalProperties": False, "properties": {"of": {"type": "array", "items": {"type": "integer", "minimum": 0}}}},
    "reply": {"type": "object", "required": ["n_chars", "text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "n_chars": {"type": "integer", "minimum": 1}}},
    "search": {"type": "object", "required": ["query", "top"], "additionalProperties": False, "properties": {"query": {"type": "string", "minLength": 1, "maxLength": 40}, "top": {"type": "integer", "minimum": 1, "maximum": 7}}},
}


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations ``(conv_id, turn, role, text)``, by rules on single rows.

    Each turn that isn't the assistant's calls a tool: by turn mod 3 ``reply`` with its text, ``search`` with the first 40
    characters, or ``count``. Arguments are bad where a length is divisible by 5 (``search``: a word for a number) or 7
    (``count``: nothing). A call uses the one two turns before, whether there is one or not. Turns of remainder 2 by 4
    also call ``digest``, which uses the calls of this turn and of those two and four before. The assistant's turn answers
    the call of the turn before it; other answers are orphans."""
    own = turns.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("place"), "role", "text")
    call_id: Callable[[Column], Column] = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    size, turn = F.coalesce(F.length("text"), F.lit(0)), F.col("place")
    asks = own.where("role is distinct from 'assistant'")
    name = F.when(turn % 3 == 0, "reply").when(turn % 3 == 1, "search").otherwise("count")
    reply = F.to_json(F.struct(F.length("text").alias("n_chars"), "text", turn.alias("turn")))
    query = F.substring("text", 1, 40).alias("query")
    search = F.when(size % 5 == 0, F.to_json(F.struct(query, F.lit("many").alias("top")))).otherwise(F.to_json(F.struct(query, (turn + 1).alias("top"))))
    count = F.when(size % 7 == 0, "{}").otherwise(F.to_json(F.struct(F.array(turn, size.cast("long")).alias("items"))))
    before = F.when(turn >= 2, F.array(call_id(turn - 2))).otherwise(F.array().cast("array<string>"))
    calls = asks.select("conv", call_id(turn).alias("call_id"), "place", name.alias("name"), F.when(turn % 3 == 0, reply).when(turn % 3 == 1, search).otherwise(count).alias("arguments"), before.alias("uses"))
    of = F.filter(F.array(turn - 4, turn - 2, turn), lambda t: t >= 0)
    digests = asks.where(turn % 4 == 2).select("conv", F.concat(F.lit("digest_"), turn.cast("string")).alias("call_id"), "place", F.lit("digest").alias("name"), F.to_json(F.struct(of.alias("of"))).alias("arguments"), F.transform(of, call_id).alias("uses"))
    results = own.where("role = 'assistant'").select("conv", call_id(turn - 1).alias("call_id"), "place", F.col("text").alias("content"))
    return calls.unionByName(digests), results

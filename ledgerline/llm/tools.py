"""Tool-call linking for chat formatting (operator 6).

Calls and results meet in a hash join on the call's identifier, one row for each identifier, so repeats never multiply.
A call may come after another one; depths in that forest are found by pointer jumping (rounds grow with the logarithm
of the longest chain), and (depth, turn, call_id) is a topological order of a conversation. Arguments are validated
against the tool's schema and everything is written as canonical JSON: sorted keys, no spaces, shortest numbers.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, read_table
from .schemas import check_schema, faults

#: Chains of up to 2^MAX_ROUNDS calls.
MAX_ROUNDS = 40

#: The tools of the query, as JSON schemas.
SCHEMAS = {
    "search": {
        "type": "object",
        "properties": {
            "query": {"type": "string", "minLength": 1, "maxLength": 200},
            "limit": {"type": "integer", "minimum": 1, "maximum": 100},
        },
        "required": ["query"],
        "additionalProperties": False,
    },
    "summarise": {
        "type": "object",
        "properties": {"text": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 1}},
        "required": ["text", "words"],
        "additionalProperties": False,
    },
}

def strict(text: str) -> object:
    """The JSON value of text; names that repeat and numbers that are not finite are errors."""

    def pairs(items: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in items}) < len(items):
            raise ValueError("a name repeats")
        return dict(items)

    def no(name: str) -> float:
        raise ValueError(f"{name} is no number")

    def number(digits: str) -> float:
        return float(digits) if math.isfinite(float(digits)) else no(digits)

    return json.loads(text, object_pairs_hook=pairs, parse_constant=no, parse_float=number)


def canonical(value: object) -> str:
    """Canonical JSON: names sorted by code point, no spaces, characters as they are, whole floats as integers."""

    def plain(x: object) -> object:
        if isinstance(x, float) and x.is_integer() and abs(x) < 2**53:
            return int(x)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def depths(calls: DataFrame) -> DataFrame:
    """(call_id, depth) of calls (call_id unique, after): how many calls come before it along `after`.

    An `after` that names no call counts as none. Calls on or behind a cycle get a null depth.
    """
    nodes = calls.select("call_id", "after").where("call_id is not null")
    known = nodes.select(F.col("call_id").alias("after"), F.lit(True).alias("there"))
    up = nodes.where("after is not null").join(known.hint("shuffle_hash"), "after", "left").select(
        "call_id", F.when(F.col("there"), F.col("after")).alias("up")
    )
    none = nodes.where("after is null").select("call_id", F.col("after").alias("up"))
    found = up.unionByName(none)
    now = materialise(found.withColumn("depth", F.col("up").isNotNull().cast("long")), "depths")
    limit, rounds = math.ceil(math.log2(max(2, now.count()))) + 1, 0
    while rounds < min(limit, MAX_ROUNDS) and not now.where("up is not null").isEmpty():
        # Calls that have reached a first call are done and take no part in the join, where their nulls would meet.
        above = now.select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        moved = now.where("up is not null").join(above.hint("shuffle_hash"), "up").select(
            "call_id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth")
        )
        now = materialise(now.where("up is null").select("call_id", "up", "depth").unionByName(moved), "depths")
        rounds += 1
    return now.select("call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def link_calls(
    calls: DataFrame, results: DataFrame, schemas: dict[str, dict] | None = None, per_conversation: bool = False
) -> DataFrame:
    """One row for each identifier in calls (conv_id, call_id, turn, name, arguments, after) or results (conv_id,
    call_id, turn, content): conv_id, call_id, depth, turn, status, n_calls, n_results, message.

    An identifier is call_id, or with per_conversation conv_id and call_id, where conversations number their calls
    each for itself (a null conv_id is then a conversation like others); after is read alike. Of calls or results with
    one identifier the first counts (least turn, then least values); n_calls and n_results say how many rows there
    were. Rows without call_id are left out. status, the first that holds: no_call, no_result, cycle, unknown_tool,
    bad_json, bad_arguments, ok. message: canonical JSON of the call and its result; arguments that are no JSON, or
    that no canonical JSON can hold (lone surrogates, nesting beyond the interpreter's depth), are bad_json and stay a
    string. A schema with a keyword that is not looked at is an error. A null conv_id, name, content or turn is written as null. Other columns are not looked at. Empty tables
    give an empty table.
    """
    schemas = SCHEMAS if schemas is None else schemas
    for name, schema in schemas.items():
        check_schema(schema, name)

    def named(name: str) -> Column:
        return F.struct("conv_id", F.col(name).alias("call_id")) if per_conversation else F.col(name)

    first = lambda df, prefix, *cols: df.where("call_id is not null").groupBy(named("call_id").alias("id")).agg(
        F.min(F.struct("turn", *cols)).alias(prefix), F.count(F.lit(1)).alias(f"n_{prefix}s")
    )
    one = materialise(first(calls, "call", "conv_id", "name", "arguments", "after"), "calls")
    got = first(results, "result", "conv_id", "content")
    after = F.struct("call.conv_id", F.col("call.after").alias("call_id")) if per_conversation else F.col("call.after")
    ranks = depths(one.select(F.col("id").alias("call_id"), F.when(F.col("call.after").isNotNull(), after).alias("after")))
    ranks = ranks.withColumnRenamed("call_id", "id")
    joined = one.join(ranks.hint("shuffle_hash"), "id", "left").join(got.hint("shuffle_hash"), "id", "full").select(
        F.coalesce("call.conv_id", "result.conv_id").alias("conv_id"),
        (F.col("id.call_id") if per_conversation else F.col("id")).alias("call_id"),
        "depth",
        F.coalesce("call.turn", "result.turn").alias("turn"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.col("call.name").alias("name"),
        F.col("call.arguments").alias("arguments"),
        F.col("call.after").alias("after"),
        F.col("result.content").alias("content"),
    )

    def row(r: dict) -> tuple[str, str]:
        value, state = r["arguments"], "ok"
        try:
            if value is not None:
                known = strict(value)
                canonical([known]).encode()  # in a list: as deep as it is in the message
                value = known
        except (ValueError, RecursionError):
            state = "bad_json"
        if r["name"] not in schemas:
            state = "unknown_tool"
        elif state == "ok" and faults(value, schemas[r["name"]]):
            state = "bad_arguments"
        if r["depth"] is None:
            state = "cycle"
        if not r["n_results"]:
            state = "no_result"
        if not r["n_calls"]:
            state = "no_call"
        call = {"id": r["call_id"], "name": r["name"], "arguments": value, "after": r["after"]} if r["n_calls"] else None
        result = {"id": r["call_id"], "content": r["content"]} if r["n_results"] else None
        return state, canonical({"conversation": r["conv_id"], "call": call, "result": result})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [row(r) for r in batch.to_pylist()]
            kept = batch.select(["conv_id", "call_id", "depth", "turn", "n_calls", "n_results"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, *(pa.array([d[i] for d in done], pa.string()) for i in (0, 1))],
                names=[*kept.schema.names, "status", "message"],
            )

    kept = joined.select("conv_id", "call_id", "depth", "turn", "n_calls", "n_results")
    schema = T.StructType(
        [*kept.schema.fields, T.StructField("status", T.StringType()), T.StructField("message", T.StringType())]
    )
    return joined.mapInArrow(run, schema)


def calls_and_results(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every user turn as a tool call that comes after the conversation's call two turns before, every assistant turn
    as the result of the call one turn before.

    A row without conv_id or turn belongs to no known conversation: its identifier comes from its own values, so it
    is kept, as a call without result or a result without call, and is linked to nothing; rows that repeat are counted.
    """
    own = F.concat(F.lit("call-"), F.sha2(F.to_json(F.struct("conv_id", "turn", "role", "text")), 256))
    # concat is null where one of its parts is; a call id of own has no second hyphen, so it equals no other.
    call_id = lambda turn: F.coalesce(F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string")), own)
    search = F.coalesce(F.char_length("text"), F.lit(0)) <= 200
    calls = conversations.where("role = 'user'").select(
        "conv_id",
        call_id(F.col("turn")).alias("call_id"),
        "turn",
        F.when(search, "search").otherwise("summarise").alias("name"),
        F.when(search, F.to_json(F.struct(F.col("text").alias("query"), F.lit(10).alias("limit"))))
        .otherwise(F.to_json(F.struct("text", F.lit(50).alias("words"))))
        .alias("arguments"),
        F.when((F.col("turn") >= 2) & F.col("conv_id").isNotNull(), call_id(F.col("turn") - 2)).alias("after"),
    )
    results = conversations.where("role = 'assistant'").select(
        "conv_id", call_id(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content")
    )
    return calls, results


def op6_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of conversations linked; see link_calls and calls_and_results for nulls, repeats and empty tables."""
    return link_calls(*calls_and_results(read_table(spark, sf_dir, "conversations")))

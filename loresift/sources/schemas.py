"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()

ENTRY = T.StructType(
    [
        T.StructField("id", _S),
        T.StructField("ts", _S),
        T.StructField("text", _S),
        T.StructField("tags", T.ArrayType(_S)),
        T.StructField("source", _S),
        T.StructField("source_ref", _S),
        T.StructField("source_lines", T.ArrayType(T.IntegerType())),
        T.StructField("source_hash", _S),
        T.StructField("source_commit", _S),
        T.StructField("verified_at", _S),
        T.StructField("drifted_at", _S),
        T.StructField("deleted_at", _S),
        T.StructField("kind", _S),
    ]
)
STORED = T.StructType([*ENTRY.fields, T.StructField("pos", T.LongType())])
KINDS = ("rule", "fact", "pattern")

EVENT = T.StructType([T.StructField("event", _S), T.StructField("tool_name", _S), T.StructField("tool_input", T.MapType(_S, _S)), T.StructField("cwd", _S), T.StructField("timestamp", _S)])
_CONTENT = T.ArrayType(T.StructType([T.StructField(n, _S) for n in ("type", "id", "name")] + [T.StructField("input", T.MapType(_S, _S)), T.StructField("tool_use_id", _S), T.StructField("content", _S)]))
SESSION_LINE = T.StructType([T.StructField("type", _S), T.StructField("cwd", _S), T.StructField("timestamp", _S), T.StructField("message", T.StructType([T.StructField("content", _CONTENT)]))])
QUEUE = T.StructType([T.StructField("ts", _S), T.StructField("path", _S), T.StructField("op", _S)])
PAIR = T.StructType(
    [T.StructField(n, _S) for n in ("run_id", "query", "cwd")]
    + [T.StructField("turn", T.LongType()), T.StructField("gold_files", T.ArrayType(_S)), T.StructField("window_size", T.IntegerType()), T.StructField("tag", _S)]
    + [T.StructField("followed", T.BooleanType()), T.StructField("followed_soft", T.BooleanType()), T.StructField("n_output_refs", T.IntegerType())]
)
QUESTION = T.StructType(
    [T.StructField(n, _S) for n in ("question_id", "question", "question_type")]
    + [T.StructField(n, T.ArrayType(_S)) for n in ("answer_session_ids", "haystack_session_ids", "haystack_dates")]
    + [T.StructField("haystack_sessions", T.ArrayType(T.ArrayType(T.StructType([T.StructField("role", _S), T.StructField("content", _S)]))))]
)

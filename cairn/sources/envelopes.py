"""Message envelopes on the wire (JSON text <-> columns)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPE = T.StructType([T.StructField(c, T.StringType()) for c in ("mime_type", "data", "decode_error")])


def load_object(text) -> dict | None:
    """A JSON object as a standard loader reads it: nothing may follow the
    value, a repeated key keeps its last value, NaN and infinities are numbers.
    None for anything else."""
    if text is None:
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def as_text(value) -> str | None:
    """A JSON value as column text: strings as they are, null as NULL."""
    return value if value is None or isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(ENVELOPE)
def _decode(messages: pd.Series) -> pd.DataFrame:
    out = []
    for text in messages:
        m = load_object(text)
        if m is None:
            out.append((None, None, "bad_json"))
        elif "mime_type" not in m or "data" not in m:
            out.append((None, None, "missing_key"))
        else:
            out.append((as_text(m["mime_type"]), as_text(m["data"]), None))
    return pd.DataFrame(out, columns=["mime_type", "data", "decode_error"])


def envelope_decode(df: DataFrame, message_col: str = "message") -> DataFrame:
    """Add ``mime_type``, ``data`` and ``decode_error`` from a JSON message.

    Errors, as a standard JSON loader plus two required keys would raise them:
    'bad_json' (not one JSON value, or not an object) and 'missing_key'. No
    built-in function is strict about trailing text and keeps the last of
    repeated keys, so the parse is an Arrow-batched function.
    """
    d = df.withColumn("_env", _decode(F.col(message_col)))
    return d.withColumns({c: F.col(f"_env.{c}") for c in ("mime_type", "data", "decode_error")}).drop("_env")


def envelope_encode(routed: DataFrame) -> DataFrame:
    """Add ``message``: the JSON text sent to the client, one shape per kind.

    control -> {turn_complete, interrupted} with NULLs written as null;
    tool -> {mime_type, tool_name}; data -> {mime_type, data}.
    """
    keep_nulls = {"ignoreNullFields": "false"}
    k = F.col("kind")
    msg = (F.when(k == "control", F.to_json(F.struct("turn_complete", "interrupted"), keep_nulls))
           .when(k == "tool", F.to_json(F.struct("mime_type", "tool_name"), keep_nulls))
           .otherwise(F.to_json(F.struct("mime_type", "data"), keep_nulls)))
    return routed.withColumn("message", msg)

"""Message routing (P3, P4) and the first-error cut."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.codec import strict_b64decode, strict_b64_valid
from cairn.plans.partitioning import evaluate_once
from cairn.plans.ordered import null_safe
from cairn.sources.envelopes import as_text, envelope_decode, load_object

SESSION = "user_id"
ORDER = ("ts", "event_id")


def route_agent_events(events: DataFrame) -> DataFrame:
    """Agent events (M6) -> client messages (M5), first matching rule wins.

    1 turn_complete or interrupted -> control row with both flags
    2 input transcription          -> application/input_transcription
    3 output transcription         -> text/plain
    4 no first part                -> dropped
    5 first part PCM audio (MIME prefix 'audio/pcm') with bytes -> audio/pcm, base64
    6 function call                -> application/tool_use + tool name
    7 non-empty text               -> text/plain
    otherwise dropped. Empty audio falls through to 6; later parts are ignored.
    Output: user_id, ts, event_id, kind, mime_type, data, tool_name,
    turn_complete, interrupted.
    """
    part = F.get(F.col("content.parts"), 0)
    flat = events.select(
        SESSION, *ORDER, "turn_complete", "interrupted",
        F.col("input_transcription").isNotNull().alias("_has_in"),
        F.col("input_transcription.text").alias("_in"),
        F.col("output_transcription").isNotNull().alias("_has_out"),
        F.col("output_transcription.text").alias("_out"),
        part.isNotNull().alias("_has_part"),
        part.getField("inline_data").getField("mime_type").alias("_imime"),
        part.getField("inline_data").getField("data").alias("_idata"),
        part.getField("function_call").isNotNull().alias("_has_call"),
        part.getField("function_call").getField("name").alias("_call"),
        part.getField("text").alias("_text"))
    control = F.coalesce(F.col("turn_complete"), F.lit(False)) | F.coalesce(F.col("interrupted"), F.lit(False))
    audio_ok = F.col("_imime").startswith("audio/pcm") & (F.length("_idata") > 0)
    # the first matching rule, 1..7; NULL = dropped
    rule = (F.when(control, 1).when(F.col("_has_in"), 2).when(F.col("_has_out"), 3)
            .when(~F.col("_has_part"), None).when(audio_ok, 5).when(F.col("_has_call"), 6)
            .when(F.coalesce(F.length("_text"), F.lit(0)) > 0, 7))
    r = F.col("_rule")
    return (flat.withColumn("_rule", rule).where(r.isNotNull())
            .select(SESSION, *ORDER,
                    F.when(r == 1, "control").when(r == 6, "tool").otherwise("data").alias("kind"),
                    F.when(r == 2, "application/input_transcription").when(r == 3, "text/plain")
                    .when(r == 5, "audio/pcm").when(r == 6, "application/tool_use")
                    .when(r == 7, "text/plain").alias("mime_type"),
                    F.when(r == 2, F.col("_in")).when(r == 3, F.col("_out"))
                    .when(r == 5, F.base64("_idata")).when(r == 7, F.col("_text")).alias("data"),
                    F.when(r == 6, F.col("_call")).alias("tool_name"),
                    F.when(r == 1, F.col("turn_complete")).alias("turn_complete"),
                    F.when(r == 1, F.col("interrupted")).alias("interrupted")))


PAYLOAD = T.StructType([T.StructField("event", T.StringType()), T.StructField("status", T.StringType()),
                        T.StructField("ok", T.BooleanType())])


@F.pandas_udf(PAYLOAD)
def _load_payload(data: pd.Series) -> pd.DataFrame:
    loaded = [load_object(x) for x in data]
    return pd.DataFrame({"event": [as_text((m or {}).get("event")) for m in loaded],
                         "status": [as_text((m or {}).get("status")) for m in loaded],
                         "ok": [m is not None for m in loaded]})


def route_client_messages(messages: DataFrame, message_col: str = "message") -> DataFrame:
    """Client messages (M4) -> actions.

    text/plain -> 'content' (text); audio/pcm, image/jpeg -> 'realtime'
    (payload = base64-decoded bytes); application/json with event
    'screen_sharing' -> 'state' (state_value = status, any value incl. NULL);
    application/json with another event -> 'ignored'; anything else ->
    'error'. MIME types match exactly. ``error`` names the reason:
    bad_json, missing_key, unsupported_mime, bad_base64, bad_json_payload.
    """
    d = envelope_decode(messages, message_col)
    m, data = F.col("mime_type"), F.col("data")
    realtime = m.isin("audio/pcm", "image/jpeg")
    is_json = m == "application/json"
    # staged columns, referenced by name: each parse or regex runs once per row
    d = d.withColumns({"_pv": _load_payload(F.when(is_json, data)), "_b64": F.when(realtime, strict_b64_valid(data))})
    pv = F.col("_pv")
    d = d.withColumn("error", F.when(F.col("decode_error").isNotNull(), F.col("decode_error"))
                     .when(m == "text/plain", None)
                     .when(realtime & ~F.col("_b64"), "bad_base64")
                     .when(realtime, None)
                     .when(is_json & ~pv["ok"], "bad_json_payload")
                     .when(is_json, None)
                     .otherwise("unsupported_mime"))
    err = F.col("error")
    d = d.withColumn("action", F.when(err.isNotNull(), "error")
                     .when(m == "text/plain", "content")
                     .when(realtime, "realtime")
                     .when(pv["event"] == "screen_sharing", "state")
                     .otherwise("ignored"))
    a = F.col("action")
    d = d.withColumn("payload", F.when(a == "realtime", strict_b64decode(data)))
    return evaluate_once(d, [SESSION, *ORDER], {
        "action": a, "mime_type": m,
        "text": F.when(a == "content", data),
        "payload": F.col("payload"),
        "payload_bytes": F.when(a == "realtime", F.length("payload")).cast("long"),
        "state_key": F.when(a == "state", F.lit("screen_sharing")),
        "state_value": F.when(a == "state", pv["status"]),
        "error": F.col("error")})


def cut_at_first_error(routed: DataFrame, session: str = SESSION, order=ORDER) -> DataFrame:
    """Drop, per session, the first error row and everything after it.

    The position of a session's first error is one partial aggregate over the
    error rows alone; it joins back null-safe (rows without a session form one).
    No row is sorted or written, and filters and column pruning reach the
    source through both branches.
    """
    first = (routed.where(F.col("action") == "error").groupBy(F.col(session).alias("_error_session"))
             .agg(F.min(F.struct(*order)).alias("_first_error")))
    joined = routed.join(first, null_safe([session], ["_error_session"]), "left")
    before = F.col("_first_error").isNull() | (F.struct(*order) < F.col("_first_error"))
    return joined.where(before).drop("_error_session", "_first_error")

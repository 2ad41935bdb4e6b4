"""Per-session ordered operators.

Sessions are keyed by ``user_id`` and ordered by ``(ts, event_id)``. Every
running quantity goes through :func:`cairn.plans.ordered.ordered_scan`, so a
session is split into ranges of rows rather than serialised through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.media import hhmm
from cairn.plans.ordered import RUN, null_safe, ordered_scan, sorted_runs

SESSION = "user_id"
ORDER = ("ts", "event_id")

# Fixed values of the reference client.
IDLE_TIMEOUT_MS = 300_000      # inactivity timer
SAMPLE_RATE_OUT = 24_000       # player sample rate
RING_SECONDS = 180             # player ring buffer length
RING_SIZE = SAMPLE_RATE_OUT * RING_SECONDS


def _pos():
    return F.struct(*ORDER)


# --- A4 -----------------------------------------------------------------------

def assemble_bot_messages(agent_msgs: DataFrame) -> DataFrame:
    """Bot messages as displayed: text chunks appended until a turn completes.

    Only ``turn_complete = true`` closes a message; interruptions and tool
    events do not. Turns without text give no message. Time = first chunk.
    Output: user_id, turn_no, first_ts, hhmm, text, n_chunks.
    """
    closes = (F.col("kind") == "control") & F.coalesce(F.col("turn_complete"), F.lit(False))
    used = agent_msgs.where(closes | (F.col("mime_type") == "text/plain"))
    used = used.select(SESSION, *ORDER, "mime_type", "data", closes.cast("long").alias("_close"))
    scanned = ordered_scan(used, [SESSION], ORDER, sums=[("turn_no", F.col("_close"))])
    return (scanned.where(F.col("mime_type") == "text/plain")
            .groupBy(SESSION, "turn_no")
            .agg(F.min("ts").alias("first_ts"),
                 F.expr("listagg(data, '') WITHIN GROUP (ORDER BY ts, event_id)").alias("text"),
                 F.count(F.lit(1)).alias("n_chunks"))
            .withColumn("hhmm", hhmm(F.col("first_ts"))))


# --- A5 -----------------------------------------------------------------------

def final_transcripts(agent_msgs: DataFrame, player_active: bool = True) -> DataFrame:
    """User utterances: the last input transcription of each utterance wins.

    An utterance is closed by server audio (only while a player exists), a
    tool call, or server text; control rows do not close it. Time = first
    fragment. Output: user_id, utterance_no, first_ts, hhmm, text, n_fragments.
    """
    m = F.col("mime_type")
    closers = ["application/tool_use", "text/plain"] + (["audio/pcm"] if player_active else [])
    spoken = m == "application/input_transcription"
    used = agent_msgs.where(m.isin(*closers) | spoken).select(
        SESSION, *ORDER, "mime_type", F.when(spoken, F.col("data")).alias("data"), m.isin(*closers).cast("long").alias("_close"))
    scanned = ordered_scan(used, [SESSION], ORDER, sums=[("utterance_no", F.col("_close"))])
    return (scanned.where(m == "application/input_transcription")
            .groupBy(SESSION, "utterance_no")
            .agg(F.min("ts").alias("first_ts"),
                 F.max_by("data", _pos()).alias("text"),
                 F.count(F.lit(1)).alias("n_fragments"))
            .withColumn("hhmm", hhmm(F.col("first_ts"))))


# --- the chat as displayed ------------------------------------------------------

TOOL_LINE = "\U0001f6e0\ufe0f Using tool: "  # fixed text of the reference client


def displayed_messages(agent_msgs: DataFrame, player_active: bool = True) -> DataFrame:
    """Every message of a session's chat in display order: bot bubbles (A4),
    user bubbles (A5) and one bot line per tool call. A bubble stands where its
    first piece arrived. Output: user_id, message_no (from 1), sender, text,
    first_ts, first_event_id, hhmm."""
    m = F.col("mime_type")
    closes = (F.col("kind") == "control") & F.coalesce(F.col("turn_complete"), F.lit(False))
    closers = ["application/tool_use", "text/plain"] + (["audio/pcm"] if player_active else [])
    spoken = m == "application/input_transcription"
    used = agent_msgs.select(SESSION, *ORDER, "mime_type", F.when(spoken | (m == "text/plain"), F.col("data")).alias("data"),
                             "tool_name", closes.cast("long").alias("_turn"), m.isin(*closers).cast("long").alias("_said"))
    used = used.withColumns({"_turn": F.coalesce("_turn", F.lit(0)), "_said": F.coalesce("_said", F.lit(0))})
    d = ordered_scan(used, [SESSION], ORDER, sums=[("turn_no", F.col("_turn")), ("utterance_no", F.col("_said"))])
    first = F.min(_pos()).alias("_at")
    bot = (d.where(m == "text/plain").groupBy(SESSION, "turn_no")
           .agg(first, F.expr("listagg(data, '') WITHIN GROUP (ORDER BY ts, event_id)").alias("text")))
    user = d.where(spoken).groupBy(SESSION, "utterance_no").agg(first, F.max_by("data", _pos()).alias("text"))
    tool = d.where(m == "application/tool_use").select(SESSION, _pos().alias("_at"), F.concat(F.lit(TOOL_LINE), "tool_name").alias("text"))
    cols = [SESSION, F.col("_at.ts").alias("ts"), F.col("_at.event_id").alias("event_id"), "text"]
    shown = (bot.select(*cols, F.lit("bot").alias("sender")).unionByName(user.select(*cols, F.lit("user").alias("sender")))
             .unionByName(tool.select(*cols, F.lit("bot").alias("sender"))))
    numbered = ordered_scan(shown.withColumn("_one", F.lit(1).cast("long")), [SESSION], ORDER, sums=[("message_no", F.col("_one"))])
    return numbered.select(SESSION, "message_no", "sender", "text", F.col("ts").alias("first_ts"),
                           F.col("event_id").alias("first_event_id"), hhmm(F.col("ts")).alias("hhmm"))


# --- A6, W1 -------------------------------------------------------------------

def session_state_latest(actions: DataFrame) -> DataFrame:
    """Last write wins per (session, key); any value, NULL included.
    Output: user_id, state_key, state_value, updated_ts, updated_event_id."""
    last = F.max(F.struct(*ORDER, F.col("state_value")))
    return (actions.where(F.col("action") == "state")
            .groupBy(SESSION, "state_key").agg(last.alias("_w"))
            .select(SESSION, "state_key", F.col("_w.state_value").alias("state_value"),
                    F.col("_w.ts").alias("updated_ts"), F.col("_w.event_id").alias("updated_event_id")))


def state_as_of_event(actions: DataFrame) -> DataFrame:
    """Every session row with the screen-sharing state in force at that row
    (its own write included); NULL before the first write."""
    write = F.when(F.col("action") == "state", F.struct(F.col("state_value").alias("v")))
    scanned = ordered_scan(actions, [SESSION], ORDER, lasts=[("_state", write)])
    return scanned.withColumn("screen_sharing", F.col("_state.v")).drop("_state")


# --- W2 -----------------------------------------------------------------------

def flag_share_changes(actions: DataFrame) -> DataFrame:
    """On/off state rows with ``_change``: true for 'on' while closed and
    'off' while open. A repeated 'on' is not a new interval; state values
    other than on/off are ignored."""
    onoff = (actions.where((F.col("action") == "state") & F.col("state_value").isin("on", "off"))
             .select(SESSION, *ORDER, "state_value"))
    prev = ordered_scan(onoff, [SESSION], ORDER,
                        prevs=[("_prev", F.struct(F.col("state_value").alias("v")))])
    return (prev.withColumn("_change", F.col("state_value") != F.coalesce(F.col("_prev.v"), F.lit("off")))
            .drop("_prev"))


def share_changes(actions: DataFrame) -> DataFrame:
    return flag_share_changes(actions).where(F.col("_change")).drop("_change")


def screen_share_intervals(actions: DataFrame) -> DataFrame:
    """'on' opens, the next 'off' closes; unclosed intervals end in NULL.
    Output: user_id, start_ts, start_event_id, end_ts, end_event_id."""
    changes = share_changes(actions)
    nxt = ordered_scan(changes, [SESSION], ORDER,
                       nexts=[("_next", F.struct(*ORDER))])
    return (nxt.where(F.col("state_value") == "on")
            .select(SESSION, F.col("ts").alias("start_ts"), F.col("event_id").alias("start_event_id"),
                    F.col("_next.ts").alias("end_ts"), F.col("_next.event_id").alias("end_event_id")))


# --- activity (T1, W3) -------------------------------------------------------

def activity_rows(agent_msgs: DataFrame, actions: DataFrame, player_active: bool = True,
                  controls: DataFrame | None = None) -> DataFrame:
    """Rows that re-arm the idle timer: server audio (while a player exists),
    server text (incl. output transcription), screen start, audio start
    (``controls``, as in :func:`idle_forced_stops`). Frames, user text, input
    transcriptions and tool use are not activity.
    Output: user_id, ts, event_id, side (0 client, 1 agent, 2 audio control)."""
    server = ["text/plain"] + (["audio/pcm"] if player_active else [])
    a = (agent_msgs.where(F.col("mime_type").isin(*server))
         .select(SESSION, *ORDER, F.lit(1).alias("side")))
    c = (actions.where((F.col("action") == "state") & (F.col("state_value") == "on"))
         .select(SESSION, *ORDER, F.lit(0).alias("side")))
    rows = c.unionByName(a)
    if controls is not None:
        rows = rows.unionByName(controls.where(F.col("control") == "audio_on").select(SESSION, *ORDER, F.lit(2).alias("side")))
    return rows


def activity_sessions(activity: DataFrame, gap_seconds: int = IDLE_TIMEOUT_MS // 1000) -> DataFrame:
    """Sessions of activity: a new one starts when the gap to the previous
    activity exceeds ``gap_seconds`` (a gap of exactly the timeout merges,
    as Spark's session windows do). Output: user_id, session_no,
    session_start, session_end (= last activity + gap), n_events."""
    order = [*ORDER, "side"]
    gap = F.expr(f"INTERVAL {gap_seconds} SECONDS")
    # sessions within each run of rows, then only the edges of runs are compared
    d = sorted_runs(activity.select(SESSION, *order), [SESSION], order)
    w = Window.partitionBy(SESSION, RUN).orderBy(*order)
    d = d.withColumn("_before", F.lag(F.struct("ts")).over(w))
    new = F.col("_before").isNull() | F.coalesce(F.col("ts") > F.col("_before.ts") + gap, F.lit(False))
    d = d.withColumn("_no", F.sum(new.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = d.groupBy(SESSION, RUN, "_no").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"),
                                              F.count(F.lit(1)).alias("_n"))
    edges = part.groupBy(SESSION, RUN).agg(F.max("_no").alias("_sessions"), F.min("_first").alias("_open"),
                                           F.max("_last").alias("_close"))
    by_run = Window.partitionBy(SESSION).orderBy(RUN)
    prev = F.lag("_close").over(by_run)
    edges = edges.withColumn("_joins", (F.lag(RUN).over(by_run).isNotNull()
                                        & ~F.coalesce(F.col("_open") > prev + gap, F.lit(False))).cast("long"))
    earlier = F.sum(F.col("_sessions") - F.col("_joins")).over(by_run.rowsBetween(Window.unboundedPreceding, -1))
    shift = edges.select(F.col(SESSION).alias("_es"), F.col(RUN).alias("_er"),
                         (F.coalesce(earlier, F.lit(0)) - F.col("_joins")).alias("_shift"))
    return (part.join(shift, null_safe([SESSION, RUN], ["_es", "_er"]))
            .groupBy(SESSION, (F.col("_no") + F.col("_shift")).alias("session_no"))
            .agg(F.min("_first").alias("session_start"), (F.max("_last") + gap).alias("session_end"),
                 F.sum("_n").alias("n_events")))


# --- T2 -----------------------------------------------------------------------

def sample_per_window(actions: DataFrame, window: str = "1 second") -> DataFrame:
    """One frame per tumbling window and session: the latest one.
    Output: user_id, window_start, window_end, frame_event_id, n_frames."""
    frames = actions.where((F.col("action") == "realtime") & (F.col("mime_type") == "image/jpeg"))
    return (frames.groupBy(SESSION, F.window("ts", window).alias("w"))
            .agg(F.max(_pos()).alias("_last"), F.count(F.lit(1)).alias("n_frames"))
            .select(SESSION, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    F.col("_last.event_id").alias("frame_event_id"), "n_frames"))


# --- W3 -----------------------------------------------------------------------

def idle_forced_stops(agent_msgs: DataFrame, actions: DataFrame, controls: DataFrame | None = None,
                      timeout_ms: int = IDLE_TIMEOUT_MS, player_active: bool = True,
                      horizon: DataFrame | None = None) -> DataFrame:
    """Where the inactivity timer stops screen sharing.

    Inside an open sharing interval every activity row (and every 'on')
    arms a timer of ``timeout_ms``; the next activity re-arms it, an 'off'
    (or an audio-off row in ``controls``) cancels it. A timer fires when
    the next row comes strictly later than its deadline, or when there is
    no next row and the deadline is not after the session horizon (default:
    the session's last recorded row). The first firing per interval wins.
    ``controls``: optional (user_id, ts, event_id, control) rows with
    control in 'audio_on' (arms), 'audio_off' (cancels).
    Output: user_id, interval_start, stop_ts, armed_event_id.
    """
    order = [*ORDER, "side"]
    cols = [SESSION, *ORDER, "side"]
    iv_type = "struct<open:boolean,start:timestamp_ntz>"
    server = ["text/plain"] + (["audio/pcm"] if player_active else [])
    agent_arms = (agent_msgs.where(F.col("mime_type").isin(*server))
                  .select(SESSION, *ORDER, F.lit(1).alias("side"), F.lit(True).alias("_arm"),
                          F.lit(None).cast(iv_type).alias("_iv")))
    # every on/off row: 'on' arms, 'off' cancels; the changes carry the interval marker
    states = flag_share_changes(actions).select(
        SESSION, *ORDER, F.lit(0).alias("side"), (F.col("state_value") == "on").alias("_arm"),
        F.when(F.col("_change"), F.struct((F.col("state_value") == "on").alias("open"),
                                          F.col("ts").cast("timestamp_ntz").alias("start"))).alias("_iv"))
    timeline = states.unionByName(agent_arms)
    if controls is not None:
        timeline = timeline.unionByName(controls.select(
            SESSION, *ORDER, F.lit(2).alias("side"), (F.col("control") == "audio_on").alias("_arm"),
            F.lit(None).cast(iv_type).alias("_iv")))
    scanned = ordered_scan(timeline, [SESSION], order,
                           lasts=[("_cur", F.col("_iv"))],
                           nexts=[("_next", F.struct(F.col("ts").alias("ts")))])
    if horizon is None:
        horizon = (agent_msgs.select(SESSION, "ts").unionByName(actions.select(SESSION, "ts"))
                   .groupBy(SESSION).agg(F.max("ts").alias("horizon")))
    horizon = horizon.withColumnRenamed(SESSION, "_hs")
    deadline = F.col("ts") + F.expr(f"INTERVAL {timeout_ms} MILLISECONDS")
    fired = (scanned.where(F.col("_arm") & F.coalesce(F.col("_cur.open"), F.lit(False)))
             .join(horizon, null_safe([SESSION], ["_hs"]), "left")
             .withColumn("_deadline", deadline)
             .where(F.when(F.col("_next").isNull(), F.col("_deadline") <= F.col("horizon"))
                    .otherwise(F.col("_next.ts") > F.col("_deadline"))))
    return (fired.groupBy(SESSION, F.col("_cur.start").alias("interval_start"))
            .agg(F.min(F.struct("_deadline", "event_id")).alias("_f"))
            .select(SESSION, "interval_start", F.col("_f._deadline").alias("stop_ts"),
                    F.col("_f.event_id").alias("armed_event_id")))


# --- W5 -----------------------------------------------------------------------

def _int16_le(h):
    """A little-endian sample from its four hex digits."""
    u = F.conv(F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2)), 16, 10).cast("int")
    return F.when(u >= 32768, u - 65536).otherwise(u)


def retain_latest(agent_msgs: DataFrame, capacity: int = RING_SIZE, player_active: bool = True) -> DataFrame:
    """Samples left unread in the player's ring buffer, per session.

    A ring of ``capacity`` slots holds ``capacity - 1`` samples: the newest
    ones since the last flush (an interrupt; a row that also completes the
    turn returns before flushing). Chunks are PCM int16 little-endian; a
    chunk of odd byte length is rejected whole. Only sample counts are scanned
    in order; the bytes are read again for the chunks that are kept, and the
    oldest of them is cut before its samples are exploded.
    Output: user_id, ts, event_id, sample_no, sample (int16), value (float).
    """
    keep_n = capacity - 1
    if not player_active or keep_n <= 0:
        return agent_msgs.limit(0).select(SESSION, *ORDER, F.lit(0).cast("long").alias("sample_no"),
                                          F.lit(0).cast("short").alias("sample"),
                                          F.lit(0.0).cast("float").alias("value"))
    flush = ((F.col("kind") == "control") & F.coalesce(F.col("interrupted"), F.lit(False))
             & ~F.coalesce(F.col("turn_complete"), F.lit(False)))
    flushed = (agent_msgs.where(flush).groupBy(F.col(SESSION).alias("_fs"))
               .agg(F.max(_pos()).alias("_flush")))
    pcm = F.unbase64(F.col("data"))
    chunks = (agent_msgs.where(F.col("mime_type") == "audio/pcm")
              .join(flushed, null_safe([SESSION], ["_fs"]), "left")
              .where(F.col("_flush").isNull() | (_pos() > F.col("_flush"))))
    sizes = (chunks.select(SESSION, *ORDER, F.length(pcm).alias("_len")).where("_len > 0 AND _len % 2 = 0")
             .select(SESSION, *ORDER, (F.col("_len") / 2).cast("long").alias("_n")))
    scanned = ordered_scan(sizes, [SESSION], ORDER, sums=[("_upto", F.col("_n"))])
    # the samples of a session before its newest keep_n ones are gone
    total = scanned.groupBy(F.col(SESSION).alias("_ts")).agg((F.max("_upto") - keep_n).alias("_gone"))
    kept = (scanned.join(total, null_safe([SESSION], ["_ts"])).where(F.col("_upto") > F.col("_gone"))
            .select(F.col(SESSION).alias("_ks"), *[F.col(c).alias(f"_k_{c}") for c in ORDER],
                    F.greatest(F.lit(0).cast("long"), F.col("_gone") - (F.col("_upto") - F.col("_n"))).alias("_skip"), "_n"))
    same = null_safe([SESSION, *ORDER], ["_ks", *[f"_k_{c}" for c in ORDER]])
    # a chunk is cut into the hex digits of its samples in one pass; only those go to the samples' rows
    digits = F.regexp_extract_all(F.hex(pcm), F.lit(".{4}"), F.lit(0))
    tail = F.slice(digits, (F.col("_skip") + 1).cast("int"), (F.col("_n") - F.col("_skip")).cast("int"))
    parts = (agent_msgs.where(F.col("mime_type") == "audio/pcm").join(kept, same)
             .select(SESSION, *ORDER, "_skip", F.posexplode(tail).alias("_at", "_h")))
    parts = parts.withColumn("sample_no", F.col("_skip") + F.col("_at"))
    s = _int16_le("_h")
    return parts.select(SESSION, *ORDER, "sample_no", s.cast("short").alias("sample"),
                        (s.cast("double") / 32768.0).cast("float").alias("value"))

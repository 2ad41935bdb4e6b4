"""Streaming operators. Stateless ones reuse the batch column expressions;
stateful ones keep per-session state in the state store."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.frames import DUPLICATE_DISTANCE, fold_bits
from cairn.operators.routing import route_agent_events, route_client_messages
from cairn.operators.sessions import IDLE_TIMEOUT_MS
from cairn.streaming.latest import LatestTable
from cairn.streaming.ordered import TICK, OrderedProcessor, event_time, micros, ordered_stream

SESSION = "user_id"


# --- T4, T5: stateless routing ------------------------------------------------

def stream_route_events(agent_events: DataFrame) -> DataFrame:
    return route_agent_events(agent_events)


def stream_route_messages(messages: DataFrame) -> DataFrame:
    return route_client_messages(messages)


# --- T6: latest session state ----------------------------------------------------

def session_state_table(spark: SparkSession, root: str, merge_every: int = 16) -> LatestTable:
    """The table of the last write per (session, key) that :func:`stream_session_state` feeds."""
    return LatestTable(spark, root, [SESSION, "state_key"], ["updated_ts", "updated_event_id"], ["state_value"], merge_every)


def stream_session_state(actions: DataFrame) -> DataFrame:
    """The writes of session state, for the table of the latest ones. No state: which
    write is the last is decided by the table, whenever it arrives."""
    writes = actions.where(F.col("action") == "state")
    return writes.select(SESSION, "state_key", "state_value", F.col("ts").alias("updated_ts"), F.col("event_id").alias("updated_event_id"))


# --- T1: activity sessions with session windows ------------------------------------

def stream_activity_sessions(activity: DataFrame, gap_seconds: int = IDLE_TIMEOUT_MS // 1000,
                             delay: str = "10 minutes") -> DataFrame:
    """Session windows of activity per session key (gap = idle timeout)."""
    a = event_time(activity, delay)
    return (a.groupBy(SESSION, F.session_window("_et", f"{gap_seconds} seconds").alias("w"))
            .agg(F.count(F.lit(1)).alias("n_events"))
            .select(SESSION, F.col("w.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n_events"))


# --- W4: the first-error cut -----------------------------------------------------------

CUT_COLUMNS = [SESSION, "ts", "event_id", "action", "mime_type", "state_key", "state_value"]
CUT_OUT = ("user_id long, ts timestamp_ntz, event_id long, action string, mime_type string, state_key string, "
           "state_value string")


class FirstErrorCut(OrderedProcessor):
    """Passes the rows of a session on until its first error. State: the closed
    sessions, which stay for good; an open session has none."""

    columns = CUT_COLUMNS

    def _open(self, rows, closed):
        if not closed:
            return np.ones(len(rows), bool)
        return np.array([k not in closed for k in rows.column(SESSION).to_pylist()], bool)

    def accepts(self, rows):
        # the error lies at or before the watermark, so all that still comes is after it
        return self._open(rows, self.recall())

    def fold(self, rows, known, watermark):
        passes = self._open(rows, known)
        action = rows.column("action")
        error = pc.equal(action, "error").fill_null(False).to_numpy()
        for key, lo, hi in self.runs(rows):
            if passes[lo] and error[lo:hi].any():
                passes[lo + int(error[lo:hi].argmax()):hi] = False
                known[key] = ()
        passes &= ~pc.equal(action, TICK).fill_null(False).to_numpy()
        return rows.select(CUT_COLUMNS).filter(pa.array(passes))


def stream_cut_at_first_error(actions: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Rows of each session before its first error row, in append mode. Rows are
    held until the watermark passes them and released in order; an error ends the
    session for good."""
    return ordered_stream(actions.select(*CUT_COLUMNS), SESSION, ["ts", "event_id"], FirstErrorCut, CUT_OUT, delay)


# --- T7: bot messages, emitted when their turn completes ----------------------------

BOT_OUT = "user_id long, turn_no long, first_ts timestamp_ntz, text string, n_chunks long"


INLINE_CHARS = 4_000
"""Text of an open message beyond this lies in the state store by itself and is not written again."""


class BotMessages(OrderedProcessor):
    """State of a session: the number of closed turns; of the open message the first time, the
    chunk count, the number of text pieces stored, and the text after them."""

    columns = ["user_id", "turn_no", "first_ts", "text", "n_chunks"]
    memory = [("turn_no", pa.int64()), ("first_us", pa.int64()), ("n", pa.int64()), ("stored", pa.int64()), ("text", pa.large_string())]

    def __init__(self, schema, key, order, recording_end: int | None = None):
        super().__init__(schema, key, order)
        self.recording_end = recording_end

    def prepare(self, handle):
        self.texts = handle.getMapState("texts", "session long, no_session boolean, piece long", "text string")

    def begin(self):
        if self.recording_end is not None:
            self.wake(self.recording_end)

    def accepts(self, rows):
        done = pc.and_kleene(pc.equal(rows.column("kind"), "control"), rows.column("turn_complete")).fill_null(False)
        return pc.or_(done, pc.equal(rows.column("mime_type"), "text/plain").fill_null(False)).to_numpy(zero_copy_only=False)

    def fold(self, rows, known, watermark):
        out, nothing = [], (0, None, 0, 0, "")
        cols = [rows.column(c).to_pylist() for c in ("kind", "turn_complete", "mime_type", "data")]
        times = micros(rows.column("ts")).tolist()

        def place(key, piece):
            return (0 if key is None else key, key is None, piece)

        def close(key, turn_no, first_us, n, stored, parts):
            if n > 0:
                before = [self.texts.getValue(place(key, i))[0] for i in range(stored)]
                out.append((key, turn_no, pd.Timestamp(first_us, unit="us"), "".join([*before, *parts]), n))
            for i in range(stored):
                self.texts.removeKey(place(key, i))
        for key, lo, hi in self.runs(rows):
            turn_no, first_us, n, stored, text = known.get(key, nothing)
            parts = [text]
            for kind, done, mime, data, t in zip(*[c[lo:hi] for c in cols], times[lo:hi]):
                if kind == "control" and done is True:
                    close(key, turn_no, first_us, n, stored, parts)
                    turn_no, first_us, n, stored, parts = turn_no + 1, None, 0, 0, []
                elif mime == "text/plain":
                    first_us = t if n == 0 else first_us
                    n += 1
                    if data is not None:
                        parts.append(data)
            text = "".join(parts)
            if len(text) > INLINE_CHARS:
                self.texts.updateValue(place(key, stored), (text,))
                stored, text = stored + 1, ""
            known[key] = (turn_no, first_us, n, stored, text)
        if self.recording_end is not None and watermark > self.recording_end:
            for key, (turn_no, first_us, n, stored, text) in list(known.items()):
                if n > 0:
                    close(key, turn_no, first_us, n, stored, [text])
                    known[key] = (turn_no, None, 0, 0, "")
        return out


def stream_bot_messages(agent_msgs: DataFrame, delay: str = "10 minutes", recording_end: int | None = None) -> DataFrame:
    """Bot messages emitted when ``turn_complete`` closes them (append mode),
    however long the session was silent in between. With ``recording_end`` (microseconds; a replayed
    recording) the messages still open are emitted once the watermark passes it, as
    the batch form does at the end of its table."""
    cols = agent_msgs.select(SESSION, "ts", "event_id", "kind", "turn_complete", "mime_type", "data")
    return ordered_stream(cols, SESSION, ["ts", "event_id"], lambda *a: BotMessages(*a, recording_end), BOT_OUT, delay)


# --- T2 then T3: sampled frames, near duplicates suppressed ------------------------------

FRAMES_OUT = "stream int, ts timestamp_ntz, frame_id long, signature string"


class NearDuplicates(OrderedProcessor):
    """State of a stream of frames: the last kept signature, which survives stop
    and start of sharing, like the client's."""

    columns = ["stream", "ts", "frame_id", "signature"]
    memory = [("bits", pa.int64())]

    def __init__(self, schema, key, order, threshold: int):
        super().__init__(schema, key, order)
        self.threshold = threshold

    def accepts(self, rows):
        return rows.column("sig_bits").is_valid().to_numpy(zero_copy_only=False)  # a clock row has none

    def fold(self, rows, known, watermark):
        bits = rows.column("sig_bits").to_numpy().view(np.uint64)
        kept = [np.zeros(0, np.int64)]
        for key, lo, hi in self.runs(rows):
            last = np.array(known[key], np.int64).view(np.uint64)[0] if key in known else None
            at = lo + fold_bits(bits[lo:hi], last, self.threshold)
            if len(at):
                known[key] = (int(bits[at[-1:]].view(np.int64)[0]),)
                kept.append(at)
        return rows.select(self.columns).take(pa.array(np.concatenate(kept)))


def stream_suppress_near_duplicates(frames: DataFrame, threshold: int = DUPLICATE_DISTANCE, delay: str | None = "10 minutes") -> DataFrame:
    """Frames kept per stream, in the order of (ts, frame_id) whatever order they
    arrive in. ``frames``: stream, ts, frame_id, signature, sig_bits; with
    ``delay`` None also ``_et`` with a watermark."""
    cols = ["stream", "ts", "frame_id", "signature", "sig_bits"]
    rows = frames.select(*cols, *([] if delay else ["_et"]))
    return ordered_stream(rows, "stream", ["ts", "frame_id"], lambda *a: NearDuplicates(*a, int(threshold)), FRAMES_OUT, delay)


def stream_sampled_frames(frames: DataFrame, window: str = "1 second", threshold: int = DUPLICATE_DISTANCE,
                          delay: str = "10 minutes") -> DataFrame:
    """What a client sends: the latest frame of every tumbling window, and of these
    the ones that differ from the last one sent. Two stateful steps in one
    query: a window's frame goes on when the watermark closes the window, and the
    watermark goes with it."""
    picked = F.max(F.struct("ts", "frame_id", "signature", "sig_bits"))
    sampled = (event_time(frames, delay).groupBy("stream", F.window("_et", window).alias("w")).agg(picked.alias("_f"))
               .select("stream", "_f.*", F.window_time("w").alias("_et")))
    return stream_suppress_near_duplicates(sampled, threshold, delay=None)


# --- T8: idle forced stops with event-time timeouts ---------------------------------

IDLE_OUT = "user_id long, interval_start timestamp_ntz, stop_ts timestamp_ntz, armed_event_id long"
IDLE_COLUMNS = [SESSION, "ts", "event_id", "side", "kind"]


def idle_timeline(agent_msgs: DataFrame, actions: DataFrame, player_active: bool = True,
                  controls: DataFrame | None = None, with_others: bool = False) -> DataFrame:
    """Timer-relevant rows: server activity ('act', arms), screen 'on' (opens and
    arms) and 'off' (closes and cancels), audio on ('act') and off ('cancel') from
    ``controls``. With ``with_others`` all other rows too ('other'): they show that
    the session goes on. Columns: user_id, ts, event_id, side, kind."""
    server = F.coalesce(F.col("mime_type").isin(*["text/plain"] + (["audio/pcm"] if player_active else [])), F.lit(False))
    state = F.coalesce((F.col("action") == "state") & F.col("state_value").isin("on", "off"), F.lit(False))
    act = agent_msgs.select(SESSION, "ts", "event_id", F.lit(1).alias("side"), F.when(server, "act").otherwise("other").alias("kind"))
    st = actions.select(SESSION, "ts", "event_id", F.lit(0).alias("side"),
                        F.when(state, F.col("state_value")).otherwise("other").alias("kind"))
    rows = st.unionByName(act)
    if controls is not None:
        rows = rows.unionByName(controls.select(SESSION, "ts", "event_id", F.lit(2).alias("side"),
                                                F.when(F.col("control") == "audio_on", "act").otherwise("cancel").alias("kind")))
    return rows if with_others else rows.where("kind <> 'other'")


class IdleStops(OrderedProcessor):
    """State of a session while its sharing is open: since when, the armed
    deadline, whether this interval has fired. None while it is closed."""

    columns = ["user_id", "interval_start", "stop_ts", "armed_event_id"]
    memory = [("start_us", pa.int64()), ("deadline_us", pa.int64()), ("armed_id", pa.int64()), ("fired", pa.bool_())]

    def __init__(self, schema, key, order, timeout_us: int, until_horizon: bool):
        super().__init__(schema, key, order)
        self.timeout_us, self.until_horizon = timeout_us, until_horizon

    def fold(self, rows, known, watermark):
        out = []

        def fire(key, start_us, deadline, armed_id):
            out.append((key, pd.Timestamp(start_us, unit="us"), pd.Timestamp(deadline, unit="us"), armed_id))
        times, ids, kinds = micros(rows.column("ts")).tolist(), rows.column("event_id").to_pylist(), rows.column("kind").to_pylist()
        for key, lo, hi in self.runs(rows):
            is_open = key in known
            start_us, deadline, armed_id, fired = known.get(key, (None, None, None, False))
            for t, eid, kind in zip(times[lo:hi], ids[lo:hi], kinds[lo:hi]):
                if deadline is not None and (t > deadline or (kind == "other" and t == deadline)):
                    fire(key, start_us, deadline, armed_id)
                    fired, deadline = True, None
                if kind == "on":
                    if not is_open:
                        is_open, start_us, fired = True, t, False
                    if not fired:
                        deadline, armed_id = t + self.timeout_us, eid
                elif kind == "off":
                    is_open, deadline = False, None
                elif kind == "cancel":
                    deadline = None
                elif kind == "act" and is_open and not fired:
                    deadline, armed_id = t + self.timeout_us, eid
            if is_open:
                known[key] = (start_us, deadline, armed_id, fired)
            else:
                known.pop(key, None)
        if not self.until_horizon:
            armed = []
            for key, (start_us, deadline, armed_id, _) in list(known.items()):
                if deadline is not None and deadline < watermark:
                    fire(key, start_us, deadline, armed_id)
                    known[key] = (start_us, None, armed_id, True)
                elif deadline is not None:
                    armed.append(deadline)
            if armed:
                self.wake(min(armed))
        return out


def stream_idle_stops(timeline: DataFrame, timeout_ms: int = IDLE_TIMEOUT_MS, delay: str = "10 minutes",
                      until_horizon: bool = False) -> DataFrame:
    """Forced stops of screen sharing by the inactivity timer (append mode).

    Rows are held until the watermark passes them and folded in order. A deadline
    fires when a later row comes after it, or when the watermark passes it; with
    ``until_horizon`` (a replayed recording) only rows of the session itself let
    it fire, as in the batch form. An interval stays open until its 'off', however
    long the session is silent.
    """
    rows = timeline.select(*IDLE_COLUMNS, (F.col("kind") == "other").cast("int").alias("late"))
    return ordered_stream(rows, SESSION, ["ts", "late", "event_id", "side"],
                          lambda *a: IdleStops(*a, timeout_ms * 1000, until_horizon), IDLE_OUT, delay)


# --- T2: latest frame per tumbling window, append mode -------------------------------

def stream_sample_per_window(actions: DataFrame, window: str = "1 second",
                             delay: str = "10 minutes") -> DataFrame:
    """One frame per window and session, emitted once the watermark closes
    the window (append mode). Output as the batch ``sample_per_window``."""
    frames = actions.where(((F.col("action") == "realtime") & (F.col("mime_type") == "image/jpeg")) | (F.col("action") == TICK))
    return (event_time(frames, delay).groupBy(SESSION, F.window("_et", window).alias("w"))
            .agg(F.max(F.struct("ts", "event_id")).alias("_last"), F.count(F.lit(1)).alias("n_frames"))
            .select(SESSION, F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                    F.col("_last.event_id").alias("frame_event_id"), "n_frames"))

"""Stateful streams over a hand-made recording replayed in chunks equal
their batch twins."""

import datetime as dt
import random

from cairn.operators import sessions as S
from cairn.operators.routing import cut_at_first_error
from cairn.session import staging_path
from cairn.streaming import operators as ST
from cairn.streaming.staging import file_stream, run_foreach_batch, run_to_parquet, stage_chunks

T0 = dt.datetime(2024, 1, 1, 10, 0)
AGENT = ("user_id long, ts timestamp_ntz, event_id long, kind string, mime_type string, data string, "
         "tool_name string, turn_complete boolean, interrupted boolean")


def _agent_rows():
    rows, eid = [], 0
    for user in (1, 2):
        for minute in range(40):
            eid += 1
            t = T0 + dt.timedelta(minutes=minute, seconds=user)
            if minute % 7 == 6:
                rows.append((user, t, eid, "control", None, None, None, True, None))
            else:
                rows.append((user, t, eid, "data", "text/plain", f"c{eid}", None, None, None))
    return rows


def _run(spark, stream):
    out = staging_path(spark, "out")
    run_to_parquet(stream, out, staging_path(spark, "ck"))
    return spark.read.parquet(out).collect()


def _files(spark, name, parts):
    """One file per list of rows, arriving in that order."""
    import os
    import time
    root = staging_path(spark, name).removeprefix("file:")
    for i, df in enumerate(parts):
        df.coalesce(1).write.parquet(f"{root}/part={i}")
        for f in os.listdir(f"{root}/part={i}"):
            os.utime(f"{root}/part={i}/{f}", (time.time() - 1000 + i, time.time() - 1000 + i))
    return file_stream(spark, root, "/part=*/*.parquet")


def _end(t):
    return (None, t + dt.timedelta(days=3), -1, "tick", None, None, None, None, None)


END = int((T0 + dt.timedelta(hours=2) - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def test_bot_messages_stream_equals_batch(spark):
    rows = _agent_rows()
    df = spark.createDataFrame(rows, AGENT)
    random.Random(1).shuffle(rows)
    # shuffled within blocks of a few minutes: rows come late, but within the watermark's delay
    rows.sort(key=lambda r: (r[1] - T0) // dt.timedelta(minutes=8))
    parts = [spark.createDataFrame(rows[i:i + 9], AGENT) for i in range(0, len(rows), 9)]
    parts.append(spark.createDataFrame([_end(T0)], AGENT))
    got = sorted((r.user_id, r.turn_no, r.text, r.n_chunks) for r in _run(
        spark, ST.stream_bot_messages(_files(spark, "t7", parts), recording_end=END)))
    want = sorted((r.user_id, r.turn_no, r.text, r.n_chunks) for r in S.assemble_bot_messages(df).collect())
    assert got == want and len(got) == 12  # the open messages of both sessions are closed at the end


def test_a_row_one_second_late_takes_its_place(spark):
    def say(s, text):
        return (1, T0 + dt.timedelta(seconds=s), s, "data", "text/plain", text, None, None, None)
    parts = [[say(0, "A"), say(2, "C")], [say(1, "B"), (1, T0 + dt.timedelta(seconds=3), 3, "control", None, None, None, True, None)],
             [_end(T0)]]
    got = _run(spark, ST.stream_bot_messages(_files(spark, "abc", [spark.createDataFrame(p, AGENT) for p in parts])))
    assert [r.text for r in got] == ["ABC"]


ACTIONS = ("user_id long, ts timestamp_ntz, event_id long, action string, mime_type string, state_key string, state_value string")


def test_idle_stops_and_cut_from_two_sources_equal_batch(spark):
    rnd = random.Random(8)
    agent, actions = [], []
    for user in (1, 2, 3):
        for i in range(60):
            t = T0 + dt.timedelta(seconds=rnd.randrange(0, 3 * 3600))
            agent.append((user, t, 1000 * user + i, "data", rnd.choice(["text/plain", "application/tool_use"]), "x", None, None, None))
        for i in range(25):
            t = T0 + dt.timedelta(seconds=rnd.randrange(0, 3 * 3600))
            bad = user == 3 and i == 20
            actions.append((user, t, 1000 * user + 500 + i, "error" if bad else "state", "application/json",
                            None if bad else "screen_sharing", None if bad else rnd.choice(["on", "off", "on"])))
    a, c = spark.createDataFrame(agent, AGENT), spark.createDataFrame(actions, ACTIONS)
    cut = cut_at_first_error(c)
    # the two sources are cut at different instants; the second is read whole at once
    by_time = sorted(agent, key=lambda r: r[1])
    end = spark.createDataFrame([_end(T0)], AGENT)
    s_agent = _files(spark, "src-a", [spark.createDataFrame(by_time, AGENT).limit(0), spark.createDataFrame(by_time, AGENT), end])
    acts = sorted(actions, key=lambda r: r[1])
    half = [acts[:40], acts[40:], [(None, T0 + dt.timedelta(days=3), -1, "tick", None, None, None)]]
    parts = [spark.createDataFrame(p, ACTIONS) for p in half]
    got_cut = _run(spark, ST.stream_cut_at_first_error(_files(spark, "src-c", parts)))
    assert sorted(map(tuple, got_cut)) == sorted(map(tuple, cut.select(*ACTIONS_COLS).collect()))
    s_cut = _files(spark, "src-cut", [spark.createDataFrame(got_cut, ACTIONS)])
    timeline = ST.idle_timeline(s_agent, s_cut, with_others=True)
    got = sorted(map(tuple, _run(spark, ST.stream_idle_stops(timeline, delay="4 hours", until_horizon=True))))
    want = sorted(map(tuple, S.idle_forced_stops(a, cut).collect()))
    assert got == want and want


ACTIONS_COLS = ["user_id", "ts", "event_id", "action", "mime_type", "state_key", "state_value"]


def test_audio_controls_arm_and_cancel(spark):
    c = "user_id long, ts timestamp_ntz, event_id long, control string"
    controls = spark.createDataFrame([(1, T0 + dt.timedelta(minutes=4), 7, "audio_on"), (1, T0 + dt.timedelta(minutes=6), 8, "audio_off")], c)
    actions = spark.createDataFrame([(1, T0, 1, "state", "application/json", "screen_sharing", "on")], ACTIONS)
    agent = spark.createDataFrame([(1, T0 + dt.timedelta(hours=1), 9, "control", None, None, None, None, True), _end(T0)], AGENT)
    timeline = ST.idle_timeline(agent, actions, controls=controls, with_others=True)
    assert _run(spark, ST.stream_idle_stops(_files(spark, "ctl", [timeline]))) == []
    without = ST.idle_timeline(agent, actions, with_others=True)
    assert len(_run(spark, ST.stream_idle_stops(_files(spark, "noctl", [without])))) == 1
    sessions = S.activity_sessions(S.activity_rows(agent, actions, controls=controls)).collect()
    assert [(r.session_no, r.n_events) for r in sessions] == [(1, 2)]


def test_idle_stops_stream_fires_on_timeout(spark):
    actions = spark.createDataFrame(
        [(1, T0, 1, "state", "application/json", None, None, None, "screen_sharing", "on", None)],
        "user_id long, ts timestamp_ntz, event_id long, action string, mime_type string, text string, "
        "payload binary, payload_bytes long, state_key string, state_value string, error string")
    agent = spark.createDataFrame(
        [(1, T0 + dt.timedelta(minutes=2), 2, "data", "text/plain", "x", None, None, None),
         (2, T0 + dt.timedelta(hours=1), 3, "data", "text/plain", "later", None, None, None)], AGENT)
    timeline = ST.idle_timeline(agent, actions)
    root = staging_path(spark, "t8-in")
    stage_chunks(timeline, root, "ts", chunks=2)
    out = staging_path(spark, "t8-out")
    run_to_parquet(ST.stream_idle_stops(file_stream(spark, f"{root}/split", "/_c=*/*.parquet")), out,
                   staging_path(spark, "t8-ck"))
    got = [(r.user_id, r.stop_ts, r.armed_event_id) for r in spark.read.parquet(out).collect()]
    # no later row for user 1: the event-time timeout fires once user 2's row moves the watermark
    assert got == [(1, T0 + dt.timedelta(minutes=7), 2)]


def test_staged_chunks_cover_input_in_ascending_ranges(spark):
    import glob
    import os

    df = spark.createDataFrame(_agent_rows(), AGENT)
    root = staging_path(spark, "stage-many")
    # 80 rows, at most 7 per chunk: the chunk count grows with the input
    stage_chunks(df, root, "ts", chunks=2, rows_per_chunk=7)
    dirs = sorted(glob.glob(f"{root.removeprefix('file:')}/split/_c=*"), key=lambda d: int(d.split("=")[1]))
    assert len(dirs) == 12
    times = [os.path.getmtime(f"{d}/{f}") for d in dirs for f in os.listdir(d) if f.endswith(".parquet")]
    assert times == sorted(times)
    ranges, total = [], []
    for d in dirs:
        part = spark.read.parquet(d)
        assert len([f for f in os.listdir(d) if f.endswith(".parquet")]) == 1
        rows = part.collect()
        total += rows
        if rows:
            ranges.append((min(r.ts for r in rows), max(r.ts for r in rows)))
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    assert sorted(map(tuple, total)) == sorted(map(tuple, df.collect()))


def _action(user, t, eid, action="state"):
    return (user, t, eid, action, "application/json", None, None)


def test_an_error_ends_the_session_for_good(spark):
    day = dt.timedelta(days=1)
    rows = [_action(1, T0 - day, 1), _action(1, T0, 2), _action(1, T0 + dt.timedelta(seconds=1), 3, "error"),
            *[_action(2, T0 + dt.timedelta(hours=h), 100 + h) for h in range(0, 24 * 9, 5)], _action(1, T0 + 5 * day, 4),
            _action(2, T0 + 8 * day, 500, "error"), _action(2, T0 + 9 * day, 501), _action(None, T0 + day, 600)]
    rows.sort(key=lambda r: r[1])
    df = spark.createDataFrame(rows, ACTIONS)
    parts = [spark.createDataFrame(rows[i:i + 6], ACTIONS) for i in range(0, len(rows), 6)]
    parts.append(spark.createDataFrame([(None, T0 + 20 * day, -1, "tick", None, None, None)], ACTIONS))
    got = sorted(map(tuple, _run(spark, ST.stream_cut_at_first_error(_files(spark, "cut5", parts)))), key=str)
    want = sorted(map(tuple, cut_at_first_error(df).select(*ACTIONS_COLS).collect()), key=str)
    assert got == want
    assert [r[2] for r in got if r[0] == 1] == [1, 2]


def test_a_turn_stays_open_across_silent_days(spark):
    day = dt.timedelta(days=1)

    def say(d, eid, text):
        return (1, T0 + d * day, eid, "data", "text/plain", text, None, None, None)
    rows = [say(0, 1, "A"), say(3, 2, "B"), (1, T0 + 3.5 * day, 3, "control", None, None, None, True, None), say(7, 4, "C"), say(11, 5, "D")]
    others = [(2, T0 + dt.timedelta(hours=h), 100 + h, "data", "text/plain", "x", None, None, None) for h in range(0, 24 * 11, 7)]
    everything = sorted(rows + others, key=lambda r: r[1])
    parts = [spark.createDataFrame(everything[i:i + 5], AGENT) for i in range(0, len(everything), 5)]
    parts.append(spark.createDataFrame([(None, T0 + 30 * day, -1, "tick", None, None, None, None, None)], AGENT))
    end = int((T0 + 11 * day - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    stream = _files(spark, "silent", parts)
    got = sorted((r.user_id, r.turn_no, r.first_ts, r.text, r.n_chunks) for r in _run(spark, ST.stream_bot_messages(stream, recording_end=end)))
    df = spark.createDataFrame(everything, AGENT)
    want = sorted((r.user_id, r.turn_no, r.first_ts, r.text, r.n_chunks) for r in S.assemble_bot_messages(df).collect())
    assert got == want
    assert [(r[1], r[3]) for r in got if r[0] == 1] == [(0, "AB"), (1, "CD")]
    # a live stream has no end: what is open waits for the end of its turn
    live = _run(spark, ST.stream_bot_messages(_files(spark, "silent-live", parts)))
    assert [r.text for r in live] == ["AB"]


def test_an_interval_stays_open_across_silent_days(spark):
    day = dt.timedelta(days=1)

    def on_off(d, eid, value):
        return (1, T0 + d * day, eid, "state", "application/json", "screen_sharing", value)
    actions = [on_off(0, 1, "on"), on_off(4, 2, "on"), on_off(8, 3, "off"), on_off(9, 4, "on")]
    agent = [(2, T0 + dt.timedelta(hours=h), 100 + h, "data", "text/plain", "x", None, None, None) for h in range(0, 24 * 9, 7)]
    agent.append((1, T0 + 9.5 * day, 90, "control", None, None, None, True, None))
    a, c = spark.createDataFrame(agent, AGENT), spark.createDataFrame(actions, ACTIONS)
    rows = sorted(ST.idle_timeline(a, c, with_others=True).collect(), key=lambda r: r.ts)
    schema = "user_id long, ts timestamp_ntz, event_id long, side int, kind string"
    parts = [spark.createDataFrame([tuple(r) for r in rows[i:i + 5]], schema) for i in range(0, len(rows), 5)]
    parts.append(spark.createDataFrame([(None, T0 + 30 * day, -1, 9, "other")], schema))
    got = sorted(map(tuple, _run(spark, ST.stream_idle_stops(_files(spark, "idle-days", parts), until_horizon=True))))
    assert got == sorted(map(tuple, S.idle_forced_stops(a, c).collect())) and len(got) == 2


FRAMES = "stream int, ts timestamp_ntz, frame_id long, signature string, sig_bits long"


def _frames(seed=3, n=400):
    rnd, rows, bits = random.Random(seed), [], 0
    for i in range(n):
        if rnd.random() < .5:
            bits ^= 1 << rnd.randrange(63)
        rows.append((rnd.choice([1, 1, 1, 2, None]), T0 + dt.timedelta(milliseconds=300 * i), i, format(bits, "064b"), bits))
    return rows


def test_late_frames_are_folded_in_their_place(spark):
    from cairn.operators.frames import sampled_frames, suppress_near_duplicates
    rows = _frames()
    df = spark.createDataFrame(rows, FRAMES)
    shuffled = rows[:]
    random.Random(5).shuffle(shuffled)
    end = (None, T0 + dt.timedelta(days=3), None, None, None)
    parts = [spark.createDataFrame(shuffled[i:i + 60], FRAMES) for i in range(0, len(rows), 60)] + [spark.createDataFrame([end], FRAMES)]
    got = _run(spark, ST.stream_suppress_near_duplicates(_files(spark, "late", parts)))
    want = suppress_near_duplicates(df).select("stream", "ts", "frame_id", "signature").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and 20 < len(want) < 390
    # sampled first, in one query
    got = _run(spark, ST.stream_sampled_frames(_files(spark, "late-sampled", parts)))
    want = sampled_frames(df).select("stream", "ts", "frame_id", "signature").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and len(want) > 20


def test_a_long_turn_goes_through_pieces(spark):
    from cairn.streaming import ordered
    n = 2 * ordered.PIECE_ROWS + 7
    rows = [(1, T0 + dt.timedelta(milliseconds=i), i, "data", "text/plain", f"{i},", None, None, None) for i in range(n)]
    random.Random(1).shuffle(rows)
    parts = [spark.createDataFrame(rows, AGENT), spark.createDataFrame([_end(T0)], AGENT)]
    end = int((T0 + dt.timedelta(milliseconds=n) - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    got = _run(spark, ST.stream_bot_messages(_files(spark, "long", parts), recording_end=end))
    assert [(r.n_chunks, r.text) for r in got] == [(n, "".join(f"{i}," for i in range(n)))]


def test_session_state_is_the_last_write_whatever_order_it_arrives_in(spark):
    rnd, rows = random.Random(9), []
    for i in range(300):
        rows.append((rnd.choice([1, 2, 3, None]), T0 + dt.timedelta(minutes=rnd.randrange(0, 20_000)), i, rnd.choice(["state", "state", "text"]),
                     "application/json", "screen_sharing", rnd.choice(["on", "off", None])))
    df = spark.createDataFrame(rows, ACTIONS)
    parts = [spark.createDataFrame(rows[i:i + 40], ACTIONS) for i in range(0, 300, 40)]
    table = ST.session_state_table(spark, staging_path(spark, "latest"), merge_every=3)

    def twice(batch, batch_id):  # a batch that is run again
        table.append(batch, batch_id)
        table.append(batch, batch_id)
    run_foreach_batch(ST.stream_session_state(_files(spark, "state", parts)), twice, staging_path(spark, "ck"))
    want = S.session_state_latest(df).select("user_id", "state_key", "updated_ts", "updated_event_id", "state_value").collect()
    got = table.read().select("user_id", "state_key", "updated_ts", "updated_event_id", "state_value").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and len(want) == 4
    assert [f.rsplit("/", 1)[1] for f in table.folders()] == ["base-5", "part-6", "part-7"]


class _Held:
    """A state variable of a group, and what is asked of it."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def exists(self):
        return None in self.rows

    def get(self):
        self.calls += 1
        return self.rows[None]

    def update(self, row):
        self.calls += 1
        self.rows[None] = row

    def clear(self):
        self.rows.clear()

    def getValue(self, key):
        self.calls += 1
        return self.rows[key]

    def updateValue(self, key, row):
        self.calls += 1
        self.rows[key] = row

    def removeKey(self, key):
        self.calls += 1
        del self.rows[key]


class _Handle:
    def __init__(self):
        self.states, self.timers = [], []

    def getMapState(self, *_):
        self.states.append(_Held())
        return self.states[-1]

    getValueState = getMapState

    def registerTimer(self, at):
        self.timers.append(at)


def test_the_calls_of_a_group_do_not_grow_with_its_sessions():
    import pandas as pd
    import pyarrow as pa
    from cairn.streaming import ordered

    class Clock:
        def getCurrentWatermarkInMs(self):
            return int((T0 + dt.timedelta(days=1)).timestamp() * 1000)

    def run(sessions):
        schema = pa.schema([("user_id", pa.int64()), ("ts", pa.timestamp("us")), ("event_id", pa.int64()),
                            *[(c, pa.string()) for c in ACTIONS_COLS[3:]]])
        frame = pd.DataFrame([(u, T0 + dt.timedelta(seconds=s), 3 * u + s, "error" if s == 1 and u % 2 else "state", None, None, None)
                              for u in range(sessions) for s in (2, 1, 0)], columns=ACTIONS_COLS)
        for c in ("user_id", "event_id"):
            frame[ordered.ABSENT + c] = False
        p, handle = ST.FirstErrorCut(schema, "user_id", ["ts", "event_id"]), _Handle()
        p.init(handle)
        assert list(p.handleInputRows((0,), iter([frame]), None)) == []
        out = pd.concat(p.handleExpiredTimer((0,), Clock(), None))
        assert list(p.handleInputRows((0,), iter([frame[frame.user_id % 2 == 1]]), None)) == []  # closed for good
        return len(out), sum(s.calls for s in handle.states) + len(handle.timers)
    few, many = run(10), run(2000)
    assert (few[0], many[0]) == (20, 4000)  # all three rows of the even sessions, the first one of the odd ones
    assert few[1] == many[1]


def test_many_sessions_equal_batch_with_long_open_messages(spark):
    rnd, rows, eid = random.Random(4), [], 0
    for user in [None, *range(1, 300)]:
        for _ in range(6):
            eid += 1
            t = T0 + dt.timedelta(seconds=rnd.randrange(3 * 3600))
            if rnd.random() < .2:
                rows.append((user, t, eid, "control", None, None, None, True, None))
            else:  # long enough to be stored by itself in some sessions
                rows.append((user, t, eid, "data", "text/plain", f"c{eid}," * rnd.choice([1, 1, 900]), None, None, None))
    rows.sort(key=lambda r: r[1])
    parts = [spark.createDataFrame(rows[i:i + 500], AGENT) for i in range(0, len(rows), 500)] + [spark.createDataFrame([_end(T0)], AGENT)]
    end = int((T0 + dt.timedelta(hours=3) - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    got = _run(spark, ST.stream_bot_messages(_files(spark, "many", parts), recording_end=end))
    want = S.assemble_bot_messages(spark.createDataFrame(rows, AGENT)).collect()
    cols = ("user_id", "turn_no", "first_ts", "text", "n_chunks")
    assert sorted(([r[c] for c in cols] for r in got), key=str) == sorted(([r[c] for c in cols] for r in want), key=str) and len(want) > 300

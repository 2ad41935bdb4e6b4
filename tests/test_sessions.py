import datetime as dt

from cairn.operators import sessions as S

T0 = dt.datetime(2024, 1, 1, 10, 0)
AGENT = ("user_id long, ts timestamp_ntz, event_id long, kind string, mime_type string, data string, "
         "tool_name string, turn_complete boolean, interrupted boolean")
ACTIONS = ("user_id long, ts timestamp_ntz, event_id long, action string, mime_type string, text string, "
           "payload binary, payload_bytes long, state_key string, state_value string, error string")


def at(sec):
    return T0 + dt.timedelta(seconds=sec)


def agent(spark, rows):
    """rows: (sec, kind, mime, data, tc, intr)"""
    return spark.createDataFrame([(1, at(s), i, k, m, d, "t" if k == "tool" else None, tc, it)
                                  for i, (s, k, m, d, tc, it) in enumerate(rows)], AGENT)


def states(spark, rows):
    """rows: (sec, status)"""
    return spark.createDataFrame([(1, at(s), 100 + i, "state", "application/json", None, None, None,
                                   "screen_sharing", v, None) for i, (s, v) in enumerate(rows)], ACTIONS)


TXT = ("data", "text/plain")


def test_bot_messages_close_only_on_turn_complete(spark):
    a = agent(spark, [
        (0, "data", "text/plain", "Hel", None, None),
        (1, "control", None, None, None, True),        # interrupt does not close
        (2, "tool", "application/tool_use", None, None, None),
        (3, "data", "text/plain", "lo", None, None),
        (4, "control", None, None, True, None),
        (5, "control", None, None, True, None),        # empty turn: no message
        (6, "data", "text/plain", "Bye", None, None),
    ])
    got = sorted((r.turn_no, r.text, r.first_ts, r.hhmm, r.n_chunks) for r in S.assemble_bot_messages(a).collect())
    assert got == [(0, "Hello", at(0), "10:00", 2), (2, "Bye", at(6), "10:00", 1)]


def test_final_transcripts_last_wins(spark):
    a = agent(spark, [
        (0, "data", "application/input_transcription", "he", None, None),
        (1, "control", None, None, True, None),        # control does not close the utterance
        (2, "data", "application/input_transcription", "hello", None, None),
        (3, "data", "audio/pcm", "AAAA", None, None),   # closes while a player exists
        (4, "data", "application/input_transcription", "next", None, None),
    ])
    got = sorted((r.utterance_no, r.text, r.first_ts) for r in S.final_transcripts(a).collect())
    assert got == [(0, "hello", at(0)), (1, "next", at(4))]
    got = sorted((r.utterance_no, r.text) for r in S.final_transcripts(a, player_active=False).collect())
    assert got == [(0, "next")]


def test_intervals_and_state(spark):
    st = states(spark, [(0, "off"), (10, "on"), (20, "on"), (30, "off"), (40, "on")])
    iv = sorted((r.start_ts, r.end_ts) for r in S.screen_share_intervals(st).collect())
    assert iv == [(at(10), at(30)), (at(40), None)]
    latest = S.session_state_latest(st).first()
    assert (latest.state_value, latest.updated_ts) == ("on", at(40))
    asof = {r.event_id: r.screen_sharing for r in S.state_as_of_event(st).collect()}
    assert asof[101] == "on" and asof[103] == "off"


def test_idle_forced_stops(spark):
    st = states(spark, [(0, "on"), (1000, "off"), (2000, "on"), (2100, "off")])
    a = agent(spark, [
        (100, "data", "text/plain", "x", None, None),    # re-arms: next activity at 700 > 400 -> fires at 400
        (700, "data", "text/plain", "y", None, None),
        (2050, "data", "text/plain", "z", None, None),   # cancelled by the off at 2100
        (2200, "data", "text/plain", "w", None, None),   # screen closed: no timer
    ])
    got = [(r.interval_start, r.stop_ts) for r in S.idle_forced_stops(a, st).collect()]
    assert got == [(at(0), at(400))]


def test_ring_keeps_capacity_minus_one_after_last_flush(spark):
    import base64
    pcm = lambda *v: base64.b64encode(b"".join(x.to_bytes(2, "little", signed=True) for x in v)).decode()
    a = agent(spark, [
        (0, "data", "audio/pcm", pcm(1, 2, 3), None, None),
        (1, "control", None, None, None, True),                  # flush
        (2, "data", "audio/pcm", pcm(4, 5), None, None),
        (3, "control", None, None, True, True),                  # turn complete returns first: no flush
        (4, "data", "audio/pcm", base64.b64encode(b"\x01\x02\x03").decode(), None, None),  # odd: rejected
        (5, "data", "audio/pcm", pcm(-6, 7), None, None),
    ])
    got = [r.sample for r in S.retain_latest(a, capacity=4).orderBy("ts", "sample_no").collect()]
    assert got == [5, -6, 7]
    got = [r.sample for r in S.retain_latest(a, capacity=100).orderBy("ts", "sample_no").collect()]
    assert got == [4, 5, -6, 7]


def test_activity_sessions_gap_boundary(spark):
    a = agent(spark, [(0, "data", "text/plain", "a", None, None),
                      (300, "data", "text/plain", "b", None, None),    # exactly 5 min: same session
                      (601, "data", "text/plain", "c", None, None)])   # 5 min + 1 s: new session
    act = S.activity_rows(a, states(spark, []))
    got = sorted((r.session_start, r.n_events) for r in S.activity_sessions(act).collect())
    assert got == [(at(0), 2), (at(601), 1)]


def test_idle_stops_with_audio_controls(spark):
    st = states(spark, [(0, "on"), (5000, "off")])
    a = agent(spark, [(100, "data", "text/plain", "x", None, None),
                      (1000, "data", "text/plain", "y", None, None)])
    # without controls the timer armed at 100 fires at 400
    assert [r.stop_ts for r in S.idle_forced_stops(a, st).collect()] == [at(400)]
    controls = spark.createDataFrame([(1, at(200), 900, "audio_off"), (1, at(700), 901, "audio_on")],
                                     "user_id long, ts timestamp_ntz, event_id long, control string")
    # audio off at 200 cancels; audio on at 700 re-arms, next activity at 1000 is within 5 min,
    # the row at 1000 arms until 1300, then the off at 5000 comes later: fires at 1300
    got = [(r.stop_ts, r.armed_event_id) for r in S.idle_forced_stops(a, st, controls=controls).collect()]
    assert got == [(at(1300), 1)]


def test_retain_latest_time_is_linear_in_the_chunk(spark):
    import base64
    import time

    def seconds(n):
        pcm = base64.b64encode(bytes(range(256)) * (n // 128)).decode()
        df = spark.createDataFrame([(1, None, 1, "data", "audio/pcm", pcm, None, None)],
                                   "user_id long, ts timestamp_ntz, event_id long, kind string, mime_type string, data string, "
                                   "turn_complete boolean, interrupted boolean")
        t = time.perf_counter()
        assert S.retain_latest(df).agg({"sample": "sum"}).first()[0] is not None
        return time.perf_counter() - t
    seconds(1280)
    assert seconds(320_000) < 8 * max(seconds(40_000), 1.0)  # a quadratic form takes 64 times as long

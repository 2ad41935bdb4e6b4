import base64
import datetime as dt

from pyspark.sql import functions as F

from cairn.operators.routing import cut_at_first_error, route_agent_events, route_client_messages
from cairn.plans.derive import AGENT_EVENT_SCHEMA
from cairn.sources.envelopes import envelope_decode, envelope_encode

T0 = dt.datetime(2024, 1, 1)


def ts(s):
    return T0 + dt.timedelta(seconds=s)


def part(mime=None, data=None, call=None, text=None):
    return ((mime, data) if mime is not None else None, (call,) if call is not None else None, text)


def ev(i, tc=None, intr=None, it=None, ot=None, parts=None, user=1):
    return (user, ts(i), i, tc, intr, (it,) if it is not None else None, (ot,) if ot is not None else None,
            (parts,) if parts is not None else None)


def routed(spark, rows):
    df = spark.createDataFrame(rows, AGENT_EVENT_SCHEMA)
    return {r.event_id: r for r in route_agent_events(df).collect()}


def test_agent_rules_first_match_wins(spark):
    r = routed(spark, [
        ev(1, tc=True, it="ignored"),                        # control beats transcription
        ev(2, it="hello", ot="also"),                        # input beats output
        ev(3, ot="spoken"),
        ev(4, parts=[]),                                     # no first part: dropped
        ev(5, parts=[part("audio/pcm;rate=24000", b"\x01\x02")]),
        ev(6, parts=[part("audio/pcm", b"", call="t1")]),    # empty audio falls through to the call
        ev(7, parts=[part("image/png", b"x", text="txt")]),  # not audio: text
        ev(8, parts=[part(text="")]),                        # empty text: dropped
        ev(9, parts=[part(text="first"), part(text="second")]),
        ev(10, intr=True),
    ])
    assert set(r) == {1, 2, 3, 5, 6, 7, 9, 10}
    assert (r[1].kind, r[1].turn_complete, r[1].interrupted) == ("control", True, None)
    assert (r[2].mime_type, r[2].data) == ("application/input_transcription", "hello")
    assert (r[3].mime_type, r[3].data) == ("text/plain", "spoken")
    assert (r[5].mime_type, r[5].data) == ("audio/pcm", base64.b64encode(b"\x01\x02").decode())
    assert (r[6].kind, r[6].mime_type, r[6].tool_name) == ("tool", "application/tool_use", "t1")
    assert (r[7].mime_type, r[7].data) == ("text/plain", "txt")
    assert r[9].data == "first"
    assert (r[10].turn_complete, r[10].interrupted) == (None, True)


def test_envelope_encode_keeps_nulls(spark):
    df = spark.createDataFrame([ev(1, tc=True), ev(2, parts=[part(call="x")])], AGENT_EVENT_SCHEMA)
    msgs = {r.event_id: r.message for r in envelope_encode(route_agent_events(df)).collect()}
    assert msgs[1] == '{"turn_complete":true,"interrupted":null}'
    assert msgs[2] == '{"mime_type":"application/tool_use","tool_name":"x"}'


def client(spark, messages, user=1):
    rows = [(user, ts(i), i, m) for i, m in enumerate(messages)]
    return spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_id long, message string")


def test_envelope_decode_errors(spark):
    df = client(spark, ['{"mime_type":"text/plain","data":"hi"}', "not json", "[1,2]",
                        '{"mime_type":"text/plain"}', '{"mime_type":"text/plain","data":null}'])
    got = {r.event_id: (r.mime_type, r.data, r.decode_error) for r in envelope_decode(df).collect()}
    assert got[0] == ("text/plain", "hi", None)
    assert got[1][2] == "bad_json" and got[2][2] == "bad_json"
    assert got[3][2] == "missing_key"
    assert got[4][2] is None  # present but null is not a missing key


def test_client_routing(spark):
    msgs = [
        '{"mime_type":"text/plain","data":"hello"}',
        '{"mime_type":"audio/pcm","data":"Y*WI="}',          # stray character skipped -> b"ab"
        '{"mime_type":"image/jpeg","data":"YW"}',            # missing padding -> error
        '{"mime_type":"application/json","data":"{\\"event\\":\\"screen_sharing\\",\\"status\\":\\"on\\"}"}',
        '{"mime_type":"application/json","data":"{\\"event\\":\\"other\\"}"}',
        '{"mime_type":"application/json","data":"oops"}',
        '{"mime_type":"Text/Plain","data":"x"}',             # exact match only
    ]
    got = {r.event_id: r for r in route_client_messages(client(spark, msgs)).collect()}
    assert (got[0].action, got[0].text) == ("content", "hello")
    assert (got[1].action, bytes(got[1].payload), got[1].payload_bytes) == ("realtime", b"ab", 2)
    assert (got[2].action, got[2].error) == ("error", "bad_base64")
    assert (got[3].action, got[3].state_key, got[3].state_value) == ("state", "screen_sharing", "on")
    assert got[4].action == "ignored"
    assert (got[5].action, got[5].error) == ("error", "bad_json_payload")
    assert (got[6].action, got[6].error) == ("error", "unsupported_mime")


def test_cut_at_first_error(spark):
    ok = '{"mime_type":"text/plain","data":"a"}'
    bad = '{"mime_type":"x/y","data":"a"}'
    df = client(spark, [ok, ok, bad, ok]).unionByName(client(spark, [ok, ok], user=2))
    kept = cut_at_first_error(route_client_messages(df)).select("user_id", "event_id")
    assert sorted(tuple(r) for r in kept.collect()) == [(1, 0), (1, 1), (2, 0), (2, 1)]


def test_json_is_read_like_a_standard_loader(spark):
    df = client(spark, ['{"mime_type":"text/plain","data":"a"} x', '{"mime_type":"text/plain","data":"a","data":"b"}',
                        '{"mime_type":"text/plain","data":NaN}', ' {"mime_type":"text/plain","data":null}\n',
                        '{"mime_type":"application/json","data":"{\\"event\\":\\"screen_sharing\\",\\"status\\":\\"on\\",\\"status\\":\\"off\\"}"}',
                        '{"mime_type":"application/json","data":"{\\"event\\":\\"screen_sharing\\"} trailing"}'])
    got = {r.event_id: r for r in route_client_messages(df).collect()}
    assert [got[i].error for i in range(6)] == ["bad_json", None, None, None, None, "bad_json_payload"]
    assert (got[1].text, got[2].text, got[3].text, got[4].state_value) == ("b", "NaN", None, "off")


def test_log_filter_booleans_and_dotted_keys(spark):
    from cairn.operators.search import log_field_filter
    logs = spark.createDataFrame([(1, '{"ok": true, "a.b": 3}'), (2, '{"ok": false, "a": {"b": 3}}')], "id int, props string")
    assert [r.id for r in log_field_filter(logs, "props", {"ok": True}).collect()] == [1]
    assert [r.id for r in log_field_filter(logs, "props", {"a.b": 3}).collect()] == [1]

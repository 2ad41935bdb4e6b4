import duckdb
import pytest
from pyspark.sql import functions as F

from cairn.llm.chat_format import (PROBE, SQL_OP2, Template, format_conversations, q_op2, read_back)
from cairn.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = [(1, 0, "user", "hi <|im_end|> <\\|x <|| <<|im_start|>"), (1, 1, "assistant", PROBE), (1, 1, "assistant", PROBE),
       (2, 5, "assistant", None), (2, None, "user", "first"), (3, 0, None, None), (None, 0, "user", "q"),
       (None, 1, "assistant", "a😀"), (4, 0, "system\n%0A<|im_end|>", "x\n\n"), (5, 5000, "assistant", "late"),
       (5, 3, "user", ""), (5, 1, "system", "s"), (6, 0, "user", "<\\\\|\\|<\\|<|")]


def frame(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(1) for c in ("formatted", "segments", "turns", "piece", "state")})


def test_round_trip(spark):
    t = Template()
    done = format_conversations(frame(spark), t)
    got = {r.conv_id: r for r in done.select("*", read_back(F.col("formatted"), t).alias("back")).collect()}
    want = {}
    for c, turn, role, text in sorted(ODD, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or "", role == "assistant"))
    assert {c: [tuple(x) for x in r.back] for c, r in got.items()} == want
    for r in got.values():
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.formatted.count(t.start) == r.formatted.count(t.end) == len(r.back)
    assert {c: r.valid for c, r in got.items()} == {1: False, 2: True, 3: False, None: True, 4: False, 5: True, 6: False}


def test_empty(spark):
    assert format_conversations(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("odd", [False, True])
def test_query_matches_sql(spark, sf_small, odd, monkeypatch):
    con = duckdb.connect()
    if odd:
        monkeypatch.setattr(chat_format, "table", lambda s, d, n: frame(s))
        con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", ODD)
    else:
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf_small}/conversations.parquet')")
    df = q_op2(spark, sf_small)
    r = con.execute(SQL_OP2)
    names = [c[0] for c in r.description]
    rows = [dict(zip(names, x)) for x in r.fetchall()]
    if odd:  # the SQL puts null turns last
        rows = [x for x in rows if x["conv_id"] not in (2,)]
    got = [x.asDict() for x in df.collect() if not (odd and x.conv_id == 2)]
    key = lambda x: str(x["conv_id"])
    assert sorted(got, key=key) == sorted(rows, key=key)


def test_plan_is_native(spark, sf_small):
    plan = q_op2(spark, sf_small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

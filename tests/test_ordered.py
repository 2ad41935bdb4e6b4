import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.operators.routing import cut_at_first_error
from cairn.operators.sessions import activity_sessions
from cairn.plans.ordered import RUN, ordered_scan, sorted_runs


def _data(spark, n=400, keys=3, seed=7):
    rnd = random.Random(seed)
    rows = [(rnd.choice([None, *range(keys)]), i, rnd.choice([0, 1]), rnd.choice([None, "a", "b"])) for i in range(n)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "k int, pos long, flag long, v string")


def _scan(df, key, pos, parts):
    got = ordered_scan(df, [key], [pos], partitions=parts, sums=[("s", F.col("flag"))], lasts=[("l", F.col("v"))],
                       prevs=[("p", F.struct(F.col(pos).alias("pos")))], nexts=[("n", F.struct(F.col(pos).alias("pos")))])
    return sorted(((r[key], r[pos], r.s, r.l, r.p.pos if r.p else None, r.n.pos if r.n else None) for r in got.collect()), key=str)


def _window(df, key, pos):
    w = Window.partitionBy(key).orderBy(pos)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select(key, pos, F.sum("flag").over(run).alias("s"), F.last("v", True).over(run).alias("l"),
                    F.lag(pos).over(w).alias("p"), F.lead(pos).over(w).alias("n"))
    return sorted((tuple(r) for r in ref.collect()), key=str)


def test_ordered_scan_equals_single_window(spark):
    df = _data(spark)  # with a NULL key
    for parts in (1, 5, 40):
        assert _scan(df, "k", "pos", parts) == _window(df, "k", "pos")


def test_null_positions_sort_first_and_stay(spark):
    df = spark.createDataFrame([(None, None, 1, "a"), (None, 2, 1, None), (1, None, 1, None), (1, 5, 0, "b")],
                               "k int, pos long, flag long, v string")
    assert _scan(df, "k", "pos", 3) == _window(df, "k", "pos")
    assert _scan(df.where("pos is null"), "k", "pos", 3) == _window(df.where("pos is null"), "k", "pos")


def test_clock_change_of_the_session_time_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    start = dt.datetime(2024, 3, 10, 0, 0)
    rows = [(1, start + dt.timedelta(minutes=6 * i), 1, None) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, flag long, v string")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = ordered_scan(df, ["k"], ["ts"], partitions=9, sums=[("s", F.col("flag"))]).orderBy("ts").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r.s for r in got] == list(range(1, 41))


def test_sparse_session_and_bursts_are_split_by_rows(spark):
    t = dt.datetime(2020, 1, 1)
    rows = [("sparse", t, 1, None), ("sparse", t.replace(year=2024), 1, None)]
    rows += [("a", t + dt.timedelta(minutes=44 * i), 1, None) for i in range(1000)]
    rows += [("b", t + dt.timedelta(seconds=i), 1, None) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, flag long, v string")
    assert _scan(df, "k", "ts", 38) == _window(df, "k", "ts")
    sizes = sorted_runs(df, ["k"], ["ts"], 38).groupBy("k", RUN).count().collect()
    assert max(r["count"] for r in sizes) <= 2 * 50
    assert len([r for r in sizes if r.k == "b"]) >= 9


def test_first_error_cut_keeps_rows_without_session_or_time(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(None, t, 1, "content"), (None, t, 2, "error"), (None, t, 3, "content"), (1, None, 4, "content"), (1, t, 5, "error"),
            (2, t, 6, "content"), (3, t, 7, "error"), (3, t, 8, "error")]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp_ntz, event_id long, action string")
    out = cut_at_first_error(df)
    assert sorted(r.event_id for r in out.collect()) == [1, 4, 6]
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_activity_sessions_equal_brute_force(spark):
    rnd = random.Random(3)
    t = dt.datetime(2024, 1, 1)
    rows = [(rnd.choice([None, 1, 2]), t + dt.timedelta(seconds=rnd.randrange(0, 60_000)), i, rnd.randrange(2)) for i in range(600)]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp_ntz, event_id long, side int")
    want = []
    for u in (None, 1, 2):
        no, last, cur = 0, None, None
        for _, ts, _, _ in sorted((r for r in rows if r[0] == u), key=lambda r: r[1:]):
            if last is None or ts > last + dt.timedelta(seconds=300):
                no += 1
                cur = [u, no, ts, ts, 0]
                want.append(cur)
            cur[3], cur[4], last = ts + dt.timedelta(seconds=300), cur[4] + 1, ts
    got = [[r.user_id, r.session_no, r.session_start, r.session_end, r.n_events] for r in activity_sessions(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)

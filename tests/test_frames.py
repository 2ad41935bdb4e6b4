import random

from pyspark.sql import functions as F

from cairn.functions import media as M
from cairn.operators import frames as FR


def test_signature_strictly_above_mean_and_packed_bits(spark):
    vals = [float(i % 4) for i in range(64)]           # mean 1.5
    df = spark.createDataFrame([(vals,)], "v array<float>")
    r = df.select(M.mean_threshold_signature(F.col("v")).alias("s"), M.mean_threshold_bits(F.col("v")).alias("b")).first()
    assert r.s == "0011" * 16
    assert (r.b & 0xFFFFFFFFFFFFFFFF) == int(r.s, 2)
    eq = spark.createDataFrame([([2.0] * 64,)], "v array<float>")
    assert eq.select(M.mean_threshold_signature(F.col("v"))).first()[0] == "0" * 64


def test_hamming_string_and_bits(spark):
    df = spark.createDataFrame([("0101", "0011", 5, 3)], "a string, b string, x long, y long")
    r = df.select(M.hamming_distance(F.col("a"), F.col("b")), M.hamming_distance_bits(F.col("x"), F.col("y"))).first()
    assert tuple(r) == (2, 2)


def test_luma_weights(spark):
    df = spark.createDataFrame([([1.0], [1.0], [1.0]), ([10.0], [0.0], [0.0])], "r array<float>, g array<float>, b array<float>")
    got = [round(x.l[0], 6) for x in df.select(M.luma(F.col("r"), F.col("g"), F.col("b")).alias("l")).collect()]
    assert got == [1.0, 2.99]


def test_int16_quantization_wraps_and_truncates(spark):
    df = spark.createDataFrame([([1.0, -1.0, 1.5, -0.00003, float("nan")],)], "v array<float>")
    q = df.select(M.quantize_int16(F.col("v")).alias("q")).first().q
    assert q == [32767, -32767, -16386, 0, 0]
    back = spark.createDataFrame([([32767, -32768],)], "q array<smallint>")
    dq = back.select(M.dequantize_int16(F.col("q")).alias("d")).first().d
    assert abs(dq[0] - 0.999969482421875) < 1e-9 and dq[1] == -1.0


def _brute(rows, t):
    kept, last = [], {}
    for s, fid, bits in sorted(rows):
        if s not in last or bin(bits ^ last[s]).count("1") > t:
            kept.append((s, fid))
            last[s] = bits
    return sorted(kept)


def test_near_duplicates_compare_with_last_kept(spark):
    # 0b0000 kept; 0b0001 (d=1) dropped; 0b0011 (d=2 from last kept, 1 from previous) kept
    rows = [(1, 1, 0b0000), (1, 2, 0b0001), (1, 3, 0b0011), (1, 4, 0b0011), (2, 1, 0b1111)]
    df = spark.createDataFrame([(s, f, b, "") for s, f, b in rows], "stream int, frame_id long, sig_bits long, signature string")
    got = sorted((r.stream, r.frame_id) for r in FR.suppress_near_duplicates(df, 1).collect())
    assert got == [(1, 1), (1, 3), (2, 1)]


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for s in range(4):
        b = rnd.getrandbits(16)
        for f in range(150):
            if rnd.random() < 0.3:
                b ^= 1 << rnd.randrange(16)
            if rnd.random() < 0.1:
                b ^= rnd.getrandbits(16)
            rows.append((s, f, b))
    df = spark.createDataFrame([(s, f, b, "") for s, f, b in rows], "stream int, frame_id long, sig_bits long, signature string")
    for t in (0, 1, 2, 5):
        got = sorted((r.stream, r.frame_id) for r in FR.suppress_near_duplicates(df, t).collect())
        assert got == _brute(rows, t), t


def _signed(b):
    return b - (1 << 64) if b >= (1 << 63) else b


def test_near_duplicates_chunked_fold_is_exact(spark):
    # many short runs force the fix-up rounds
    rnd = random.Random(11)
    rows = []
    for s in range(3):
        b = rnd.getrandbits(16)
        for f in range(200):
            if rnd.random() < 0.3:
                b ^= 1 << rnd.randrange(16)
            if rnd.random() < 0.05:
                b ^= rnd.getrandbits(16)
            rows.append((s, f, b))
    df = spark.createDataFrame([(s, f, b, "") for s, f, b in rows],
                               "stream int, frame_id long, sig_bits long, signature string")
    for t in (1, 3):
        want = _brute(rows, t)
        for parts in (1, 7, 60):
            got = sorted((r.stream, r.frame_id) for r in FR.suppress_near_duplicates(df, t, partitions=parts).collect())
            assert got == want, (t, parts)


def test_near_duplicates_of_a_null_stream_are_kept(spark):
    rows = [(None, 1, 0), (None, 2, 1), (None, 3, 7), (1, 1, 0)]
    df = spark.createDataFrame([(s, f, b, "") for s, f, b in rows], "stream int, frame_id long, sig_bits long, signature string")
    got = {(r.stream, r.frame_id) for r in FR.suppress_near_duplicates(df, 1).collect()}
    assert got == {(None, 1), (None, 3), (1, 1)}
    assert FR.consecutive_distances(df).count() == 4


def test_near_duplicates_chunked_full_64_bit_signatures(spark):
    rnd = random.Random(5)
    rows = [(1, i, rnd.getrandbits(64)) for i in range(120)]
    df = spark.createDataFrame([(s, f, _signed(b), "") for s, f, b in rows],
                               "stream int, frame_id long, sig_bits long, signature string")
    for t in (28, 32):
        got = sorted((r.stream, r.frame_id) for r in FR.suppress_near_duplicates(df, t, partitions=24).collect())
        assert got == _brute(rows, t), t


def test_a_fold_is_repeated_only_up_to_where_it_agrees(spark):
    from cairn.plans.ordered import sorted_runs
    rnd, rows = random.Random(8), []
    for s in (1, 2, None):
        b = rnd.getrandbits(60)
        for f in range(1000):
            if rnd.random() < 0.6:
                b ^= 1 << rnd.randrange(60)
            rows.append((s, f, b))
    df = spark.createDataFrame(rows, "stream int, frame_id long, sig_bits long")
    runs = sorted_runs(df, ["stream"], ["frame_id"], partitions=24)
    rewritten = []
    got = sorted(((r.stream, r.frame_id) for r in FR.fold_in_runs(runs, 3, rewritten=rewritten).collect()), key=str)
    assert got == sorted([(s or None, f) for s, f in _brute([(s or 0, f, b) for s, f, b in rows], 3)], key=str)
    # whole runs would be 69 of 72 in the first round alone
    assert rewritten and rewritten[0] < 0.15 * len(rows) and sum(rewritten) < 0.5 * len(rows)
    kept, again, _ = FR.refold_bits(FR.np.array([0, 1, 7, 63, 63], FR.np.uint64), FR.np.array([True, False, True, True, False]), FR.np.uint64(0), 1)
    assert (kept, again) == ([], 2)

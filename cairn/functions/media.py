"""Frame signature and audio sample expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
LUMA_WEIGHTS = (0.299, 0.587, 0.114)  # r, g, b; alpha ignored
INT16_SCALE_OUT = 32767.0             # float -> int16 multiplies by 0x7fff
INT16_SCALE_IN = 32768.0              # int16 -> float divides by 32768


def luma(r: Column, g: Column, b: Column) -> Column:
    """Per-pixel grey value of three equally long channel arrays."""
    wr, wg, wb = LUMA_WEIGHTS
    return F.transform(
        r, lambda x, i: F.lit(wr) * x.cast("double") + F.lit(wg) * F.get(g, i).cast("double")
        + F.lit(wb) * F.get(b, i).cast("double"))


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double"))
    return total / F.size(values)


def mean_threshold_signature(values: Column) -> Column:
    """Average hash: bit i is '1' iff value i is strictly above the mean."""
    mean = _mean(values)
    return F.array_join(F.transform(values, lambda x: F.when(x.cast("double") > mean, "1")
                                    .otherwise("0")), "")


def mean_threshold_bits(values: Column) -> Column:
    """The same signature packed into a long, first value in the top bit."""
    mean = _mean(values)
    return F.aggregate(values, F.lit(0).cast("long"),
                       lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(
                           F.when(x.cast("double") > mean, F.lit(1).cast("long"))
                           .otherwise(F.lit(0).cast("long"))))


def hamming_distance(a: Column, b: Column) -> Column:
    """Number of positions of ``a`` whose character differs in ``b``."""
    diffs = F.filter(F.sequence(F.lit(1), F.length(a)),
                     lambda i: F.substring(a, i, 1) != F.substring(b, i, 1))
    return F.when(F.length(a) == 0, F.lit(0)).otherwise(F.size(diffs))


def hamming_distance_bits(a: Column, b: Column) -> Column:
    """Distance of two packed signatures: popcount of the xor."""
    return F.bit_count(a.bitwiseXOR(b))


def quantize_int16(values: Column) -> Column:
    """float -> int16 the way a typed-array store does it: x*32767,
    truncated toward zero, wrapped modulo 2^16; NaN and infinities give 0."""
    def one(x):
        q = (x.cast("double") * F.lit(INT16_SCALE_OUT)).try_cast("long")
        return (F.pmod(F.coalesce(q, F.lit(0).cast("long")) + 32768, F.lit(65536)) - 32768).cast("short")
    return F.transform(values, one)


def dequantize_int16(samples: Column) -> Column:
    """int16 -> float: s / 32768 (not symmetric with quantize_int16)."""
    return F.transform(samples, lambda s: (s.cast("double") / F.lit(INT16_SCALE_IN)).cast("float"))


def hhmm(ts: Column) -> Column:
    """Zero-padded HH:mm in the session time zone (UTC here)."""
    return F.date_format(ts, "HH:mm")

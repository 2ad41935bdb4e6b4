"""Base64 with the decoder semantics of a lenient Python ``b64decode``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ALPHABET_AND_PAD = "[^A-Za-z0-9+/=]"
_WELL_FORMED = r"^[A-Za-z0-9+/]*={0,2}$"


def _cleaned(s: Column) -> Column:
    # characters outside the alphabet are skipped, as the lenient decoder does
    return F.regexp_replace(s, _ALPHABET_AND_PAD, "")


def strict_b64_valid(s: Column) -> Column:
    """True when ``s`` decodes: padding present and complete, '=' only at the end."""
    c = _cleaned(s)
    return s.isNotNull() & c.rlike(_WELL_FORMED) & (F.length(c) % 4 == 0)


def strict_b64decode(s: Column) -> Column:
    """Decoded bytes, or NULL where the lenient Python decoder would raise."""
    return F.when(strict_b64_valid(s), F.try_to_binary(_cleaned(s), F.lit("base64")))


def b64encode(b: Column) -> Column:
    return F.base64(b)

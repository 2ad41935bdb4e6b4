"""Column expressions (JVM-side, inside whole-stage codegen)."""

from cairn.functions.codec import b64encode, strict_b64decode, strict_b64_valid
from cairn.functions.media import (
    dequantize_int16,
    hamming_distance,
    hamming_distance_bits,
    hhmm,
    luma,
    mean_threshold_bits,
    mean_threshold_signature,
    quantize_int16,
)
from cairn.functions.text import LINE_BREAK, WORD_DELIMITERS, lines_of, search_terms, words_of

__all__ = [
    "LINE_BREAK", "WORD_DELIMITERS", "b64encode", "dequantize_int16", "hamming_distance",
    "hamming_distance_bits", "hhmm", "lines_of", "luma", "mean_threshold_bits",
    "mean_threshold_signature", "quantize_int16", "search_terms", "strict_b64decode",
    "strict_b64_valid", "words_of",
]

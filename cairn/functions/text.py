"""Text splitting expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference job's behaviour.
# Word delimiter of the word-count job: one or more commas or whitespace.
WORD_DELIMITERS = r"[,\s]+"
# Line terminators recognised by Spark's text source: \r\n, \r, \n.
LINE_BREAK = r"\r\n|\r|\n"
# Search terms: maximal runs of letters or digits (our choice for BM25).
TERM = r"[\p{L}\p{N}]+"


def lines_of(text: Column) -> Column:
    """Array of lines as the text source would read them.

    One final line terminator does not start an extra empty line; ``\\z``
    (not ``$``) so that only the very end of the text is matched.
    """
    body = F.regexp_replace(text, f"({LINE_BREAK})\\z", "")
    return F.split(body, LINE_BREAK, -1)


def words_of(line: Column) -> Column:
    """Array of words: regex split, limit -1, empty strings kept."""
    return F.split(line, WORD_DELIMITERS, -1)


def search_terms(text: Column) -> Column:
    """Lower-cased maximal runs of letters or digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def search_term_count(text: Column) -> Column:
    """Number of :func:`search_terms`, without building the array."""
    return F.regexp_count(F.lower(text), F.lit(TERM))

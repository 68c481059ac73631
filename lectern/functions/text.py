"""Text expressions: whitespace clean-up and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blank characters of Unicode, and the separators of files, groups, records and units.
BLANKS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
TOKEN = r"\S+"
WORD = "[a-z0-9]+"


def collapse_newlines(c: Column) -> Column:
    """Runs of adjacent newlines become one; a line that holds blanks stays."""
    return F.regexp_replace(c, "\n{2,}", "\n")


def strip_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def tokens(c: Column) -> Column:
    """Maximal runs of non-blank characters."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def n_tokens(c: Column) -> Column:
    return F.size(tokens(c))


def words(c: Column) -> Column:
    """Lower-case ASCII words and numbers, the vocabulary of the lexical embedding."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def paragraphs(c: Column) -> Column:
    """Non-blank lines, in order."""
    return F.filter(F.split(c, "\n"), lambda p: strip_ws(p) != "")

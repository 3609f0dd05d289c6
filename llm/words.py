"""Words of letters and digits, as arrays of a DataFrame's rows."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of 0-9, a-z and everything beyond ASCII, after lower-casing A-Z alone.
WORD = r"[0-9a-z\x80-\x{10FFFF}]+"


def words(text: Column) -> Column:
    """The words of a whole text in order; a null text has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


#: The same class in SQL, by what is outside, of a column ``text``.
WORDS_SQL = rf"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

"""T07 accent stripping: Unicode NFD, then drop combining marks (category Mn).

Spark SQL has no Unicode normaliser.  ASCII texts pass as they are, in the JVM; the others go
through an Arrow UDF, where Python's library decomposes a whole text and one pattern made from
its data drops the marks.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Ty


def strip_accents_py(s: str | None) -> str | None:
    if s is None or s.isascii():
        return s
    return "".join(ch for ch in unicodedata.normalize("NFD", s) if unicodedata.category(ch) != "Mn")


@cache
def _marks() -> tuple[re.Pattern, re.Pattern]:
    """The non-spacing marks below U+10000 (a set that `re` looks up at once), and those above."""
    runs: tuple[list, list] = ([], [])
    for code in range(0x80, 0x110000):
        if unicodedata.category(chr(code)) == "Mn":
            part = runs[code > 0xFFFF]
            if part and code == part[-1][1] + 1:
                part[-1][1] = code
            else:
                part.append([code, code])
    low, high = ("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in part) + "]+" for part in runs)
    return re.compile(low), re.compile(high)


def _strip(s: str | None) -> str | None:
    if s is None or s.isascii():
        return s
    low, high = _marks()
    s = low.sub("", unicodedata.normalize("NFD", s))
    return high.sub("", s) if s and max(s) > "\uffff" else s


@F.pandas_udf(Ty.StringType())
def _strip_accents_udf(s: pd.Series) -> pd.Series:
    return s.map(_strip, na_action="ignore")


def strip_accents(text) -> Column:
    """NFD + drop Mn.  `text` is best a plain column: it is read by the guard and by the UDF."""
    c = F.col(text) if isinstance(text, str) else text
    other = c.rlike(r"[^\x00-\x7F]")
    return F.when(other, _strip_accents_udf(F.when(other, c))).otherwise(c)


def strip_accents_tokens(tokens) -> Column:
    """Apply T07 to each token of an ARRAY<STRING> (tokens hold no spaces)."""
    c = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.split(strip_accents(F.array_join(c, " ")), " ")

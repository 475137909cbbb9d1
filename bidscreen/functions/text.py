"""Column helpers that give string functions the Unicode meaning the screening rules expect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space of any kind: what (?U)\s matches.
WHITE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end, U+3000 included."""
    return F.btrim(text, F.lit(WHITE))


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of one group, in order; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words the text contains; words that overlap count each."""
    out = F.lit(0)
    for word in words:
        out = out + F.contains(text, F.lit(word)).cast("int")
    return out


def level(score: Column, high: float, medium: float, low: float | None = None) -> Column:
    out = F.when(score >= high, "high").when(score >= medium, "medium")
    return (out if low is None else out.when(score >= low, "low")).otherwise("none")

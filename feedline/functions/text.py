"""Column functions that turn feed text into values.

All of them are built-in expressions, so they stay inside JVM codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the feeds' text rules count it (all Unicode
# white space and the four ASCII separators).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The decimal float grammar of the feeds, underscores allowed
# between digits, plus the special values.
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_FLOAT = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
_INFINITE = r"(?i)^[+-]?inf(?:inity)?$"
_NOT_A_NUMBER = r"(?i)^[+-]?nan$"

# The literals that count as true.
TRUE_LITERALS = ("1", "true", "True")


def strip(col: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.trim(col, F.lit(WHITE_SPACE))


def _bare(text: Column) -> Column:
    """:func:`strip`, which looks at nothing but the ends of a text where these are printable ASCII."""
    ends = [F.ascii(text), F.ascii(F.substring(text, -1, 1))]
    return F.when(ends[0].between(33, 126) & ends[1].between(33, 126), text).otherwise(strip(text))


def first_text(*leaves: Column) -> Column:
    """First non-blank trimmed text among array-typed leaves, else null.

    Every leaf holds all occurrences of one tag in document order.  Where two
    different aliases occur in one element, the alias named first wins.
    """
    found = [F.get(F.filter(F.transform(leaf, _bare), lambda t: t != ""), F.lit(0)) for leaf in leaves]
    return found[0] if len(found) == 1 else F.coalesce(*found)


def to_number(col: Column) -> Column:
    """DOUBLE value of a decimal literal, null for any other text.

    A bare cast also takes ``1d`` or ``0x1p3`` and refuses ``1_000``, so the
    grammar is checked first.
    """
    return number_of(strip(col))


def number_of(text: Column) -> Column:
    """:func:`to_number` of text already trimmed."""
    plain = F.when(text.contains("_"), F.replace(text, F.lit("_"), F.lit(""))).otherwise(text)
    return (
        F.when(text.rlike(_FLOAT), plain.try_cast("double"))
        .when(
            text.rlike(_INFINITE),
            F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))),
        )
        .when(text.rlike(_NOT_A_NUMBER), F.lit(float("nan")))
    )


def to_bool(col: Column) -> Column:
    """True for a true literal, false for any other text, null for null."""
    return bool_of(strip(col))


def bool_of(text: Column) -> Column:
    """:func:`to_bool` of text already trimmed."""
    return text.isin(*TRUE_LITERALS)


def iso_ts(col: Column) -> Column:
    """Spaces become ``T``; a bare date stays bare; blank becomes null."""
    return F.when(col != "", F.replace(col, F.lit(" "), F.lit("T")))


def iso_ts_hour(date: Column, hour: Column | None = None) -> Column:
    """A timestamp text from a date and the hour kept in its own element.

    The hour only counts where the date has no time part; it defaults to
    midnight.
    """
    joined = iso_ts(date)
    hour_text = F.lit("00:00:00")
    if hour is not None:
        hour_text = F.coalesce(F.nullif(hour, F.lit("")), hour_text)
    return F.when(joined.contains("T"), joined).otherwise(F.concat(joined, F.lit("T"), hour_text))


def typed_ts(col: Column) -> Column:
    """TIMESTAMP twin of an ISO text; null where the text is no timestamp."""
    return F.try_to_timestamp(col)


def to_event_time(col: Column, formats: tuple[str, ...]) -> Column:
    """TIMESTAMP from the first of several patterns that parses."""
    text = strip(col)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])

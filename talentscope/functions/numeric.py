"""Numeric column helpers.

Every helper here is a ``Column -> Column`` built from native Spark
expressions, so it stays inside whole-stage codegen.

Rounding goes through ``decimal(28,10)`` first. A double sum depends on
the order rows were added, so two engines (or two runs with different
partitioning) can disagree in the last bit; rounding to ten places first
absorbs that noise, and the final half-up / half-even step then works on
an exact decimal, the way a SQL ``numeric`` column does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

_EXACT = DecimalType(28, 10)

# Fixed value: what counts as a plain decimal or scientific number once the
# surrounding whitespace is gone.  Anything else ('5d', 'NaN', 'inf', '')
# becomes NULL.
NUMBER_PATTERN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: Column | str, places: int) -> Column:
    """Round half away from zero (SQL ``numeric`` ROUND) and return a double."""
    return F.round(_col(c).cast(_EXACT), places).cast("double")


def rnd_even(c: Column | str, places: int) -> Column:
    """Round half to even (numpy / pandas ``round``) and return a double."""
    return F.bround(_col(c).cast(_EXACT), places).cast("double")


def safe_div(num: Column | str, den: Column | str) -> Column:
    """``num / NULLIF(den, 0)``: zero divisors give NULL instead of an ANSI error."""
    return _col(num) / F.nullif(_col(den), F.lit(0))


def strip_ws(c: Column | str) -> Column:
    """Remove leading and trailing whitespace of any kind (tabs too)."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def to_number(c: Column | str) -> Column:
    """String to double; blanks, words and malformed numbers become NULL.

    ``try_cast`` alone is looser than a number parser (it accepts '5d',
    'NaN', 'Infinity'), so the text must match ``NUMBER_PATTERN`` first.
    Only a text that doesn't match as it stands is stripped.
    """
    s = _col(c).cast("string")
    t = strip_ws(s)
    return F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double")).when(t.rlike(NUMBER_PATTERN), t.try_cast("double"))


def to_int(c: Column | str) -> Column:
    """String to int: a whole number within range, else NULL ('3.7' and
    '99999999999' are no years)."""
    x = to_number(c)
    return F.when(x == F.floor(x), x.try_cast("int"))


def min_max_scale(value: Column | str, lo: Column | str, hi: Column | str) -> Column:
    """``(value - lo) / NULLIF(hi - lo, 0)``."""
    return safe_div(_col(value) - _col(lo), _col(hi) - _col(lo))

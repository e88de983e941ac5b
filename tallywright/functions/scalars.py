"""Column expressions that several operator families share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_default(col: str | Column, default: str) -> Column:
    """The column, or the default where it is null or empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def percent(part: Column, whole: Column) -> Column:
    """part / whole in per cent as a double; 0 for an empty whole."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; 0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def since(as_of: str, days: int) -> Column:
    return F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ranked(col: str, levels: tuple[str, ...], other: int | None = None) -> Column:
    """The place of a value in an order; `other` (or one past the last) for values that are not in it."""
    out = F.lit(len(levels) if other is None else other)
    for i, level in reversed(list(enumerate(levels))):
        out = F.when(F.col(col) == level, i).otherwise(out)
    return out


def json_string(x: Column) -> Column:
    """A string as a JSON literal with ASCII escapes for quotes, backslashes and control characters; other text is kept up to
    U+007F and escaped beyond it, as \\uXXXX."""
    quoted = F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), '"', r'\\"')
    for char, esc in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")):
        quoted = F.replace(quoted, F.lit(char), F.lit("\\" + esc))
    plain = ~quoted.rlike("[^\\x20-\\x7e]")
    unit = lambda c: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(c), 4, "0")))
    point = lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int")

    def escaped(c: Column) -> Column:
        p = point(c)
        pair = F.concat(unit(F.lit(0xD800) + F.shiftright(p - 0x10000, 10)), unit(F.lit(0xDC00) + (p - 0x10000).bitwiseAND(F.lit(0x3FF))))
        return F.when(c.rlike("^[\\x20-\\x7e]$"), c).when(p >= 0x10000, pair).otherwise(unit(p))

    slow = F.array_join(F.transform(F.filter(F.split(quoted, ""), lambda c: c != ""), escaped), "")
    return F.concat(F.lit('"'), F.when(plain, quoted).otherwise(slow), F.lit('"'))


def uuid_of(digest: Column) -> Column:
    """The first 32 digits of a hexadecimal digest in groups of 8-4-4-4-12."""
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4), F.substring(digest, 17, 4), F.substring(digest, 21, 12))


def fraction_even(p: Column, q: Column, places: int) -> Column:
    """p / q of whole numbers to so many places, half to even, as a double; null where q is 0. Rounded as a fraction: the double nearest
    to it may lie on the other side of a tie."""
    whole = "decimal(38,0)"
    sign = F.when(q < 0, F.lit(-1)).otherwise(F.lit(1))
    n, d = (p.cast(whole) * sign * 10**places).cast(whole), F.nullif((q.cast(whole) * sign).cast(whole), F.lit(0).cast(whole))
    rest = F.pmod(n, d)
    down = F.call_function("div", n - rest, d)
    up = F.when((rest * 2 > d) | ((rest * 2 == d) & (down % 2 != 0)), 1).otherwise(0)
    return (down + up).cast("double") / float(10**places)

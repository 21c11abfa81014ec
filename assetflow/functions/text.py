"""Text functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def win(c: Column) -> Column:
    return F.translate(c, "/", "\\")


def unix(c: Column) -> Column:
    return F.translate(c, "\\", "/")


def escape(c: Column, escape_char: str = "\\", escaped: str = '\\"') -> Column:
    """``escape_char`` before each character of ``escaped``."""
    chars = "".join("\\" + x for x in escaped)
    return F.regexp_replace(c, f"([{chars}])", re.sub(r"([\\$])", r"\\\1", escape_char) + "$1")


def replace_regex(c: Column, pattern: str, replacement: str) -> Column:
    r"""All matches; ``\1`` in the replacement is a group, a dollar sign is itself."""
    return F.regexp_replace(c, pattern, re.sub(r"\\(\d)", r"$\1", replacement.replace("$", "\\$")))


def replace_delimited(c: Column, call: str) -> Column:
    """``call`` is delimiter, pattern, delimiter, replacement, delimiter; any character may be the delimiter."""
    _, pattern, replacement, _ = call.split(call[0])
    return replace_regex(c, pattern, replacement)


def substr(c: Column, start: int, length: int | None = None) -> Column:
    """Code points from ``start`` on; a negative start counts from the end, a negative length takes the characters before
    the start. What lies outside the text is empty."""
    n = F.char_length(c)
    begin = F.lit(start) if start >= 0 else n + start
    if length is None:
        begin, end = F.greatest(begin, F.lit(0)), n
    elif length >= 0:
        begin, end = F.greatest(begin, F.lit(0)), begin + length
    else:
        begin, end = F.greatest(begin + length, F.lit(0)), begin
    return F.substring(c, begin + 1, F.greatest(end - begin, F.lit(0)))


def to_bool(c: Column) -> Column:
    """``true`` or ``false`` in any case; anything else is an error."""
    low = F.lower(c)
    return F.when(low == "true", True).when(low == "false", False).when(c.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), c)))


def parse_key_value(c: Column) -> Column:
    """``name=value`` as (key, value), else null."""
    grammar = r"(?s)\A([_a-zA-Z][_a-zA-Z0-9]*)=(.*)\z"
    return F.when(c.rlike(grammar), F.struct(F.regexp_extract(c, grammar, 1).alias("key"), F.regexp_extract(c, grammar, 2).alias("value")))


#: Units of sizes, each 1,024 of the one before.
UNITS = ("bytes", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB", "ZiB", "YiB")


def size_step(c: Column) -> Column:
    """How often the size is divided: while it is strictly over 1,024."""
    step = F.lit(0)
    for i in range(1, len(UNITS)):
        step = F.when(c.cast("double") > float(1024**i), i).otherwise(step)
    return step


def human_size(c: Column) -> Column:
    """A size with its unit; bytes without decimals, larger units with one."""
    step = size_step(c)
    value = c.cast("double") / F.pow(F.lit(1024.0), step)
    unit = F.when(c == 1, "byte").otherwise(F.element_at(F.array(*[F.lit(u) for u in UNITS]), step + 1))
    # Rounded half to even as binary fractions print elsewhere.
    return F.concat(F.when(step == 0, c.cast("long").cast("string")).otherwise(F.format_string("%.1f", F.bround(value, 1))), F.lit(" "), unit)

"""Path functions as Column expressions. Golden values are in tests/test_functions.py."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _before(c: Column, end: Column) -> Column:
    """``c`` without ``end``, which it ends in."""
    return F.left(c, F.length(c) - F.length(end))


def directory(c: Column) -> Column:
    """Parent: without the last element; ``/a`` has ``/``, ``/`` and a bare name have none."""
    head = _before(c, F.substring_index(c, "/", -1))
    return F.when(c == "/", "").when(head == "/", "/").otherwise(F.rtrim(head, F.lit("/")))


def filename(c: Column) -> Column:
    """Last element; ``.`` behind a trailing slash."""
    return F.when(c.isin("/", ""), c).when(c.endswith("/"), ".").otherwise(F.substring_index(c, "/", -1))


def _dotted(name: Column) -> Column:
    return ~name.isin(".", "..") & name.contains(".")


def stem(c: Column) -> Column:
    """File name without its extension."""
    name = filename(c)
    return F.when(_dotted(name), _before(name, F.concat(F.lit("."), F.substring_index(name, ".", -1)))).otherwise(name)


def extension(c: Column) -> Column:
    """From the last dot on, the dot included; none is empty."""
    name = filename(c)
    return F.when(_dotted(name), F.concat(F.lit("."), F.substring_index(name, ".", -1))).when(c.isNotNull(), "")


def correct_separator(c: Column) -> Column:
    return F.regexp_replace(c, r"[/\\]+", "/")


def reduce_slashes(c: Column) -> Column:
    return F.regexp_replace(c, "/+", "/")


def elements(c: Column) -> Column:
    return F.filter(F.split(c, "/"), lambda x: x != "")


def normalize(c: Column) -> Column:
    """Without ``.``, with ``..`` folded; more ``..`` than elements is an error."""
    fold = F.aggregate(
        elements(c),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == ".", acc)
        .when((x == "..") & (F.size(acc) == 0), F.raise_error(F.concat(F.lit("too many parents in path: "), c)).cast("array<string>"))
        .when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, x)),
    )
    return F.concat(F.when(c.startswith("/"), "/").otherwise(""), F.array_join(fold, "/"))


def has_base(c: Column, base: Column) -> Column:
    """The normalized base's elements begin the normalized path's."""
    path, head = normalize(c), normalize(base)
    e, b = elements(path), elements(head)
    return (path.startswith("/") == head.startswith("/")) & (F.size(b) <= F.size(e)) & (F.slice(e, F.lit(1), F.size(b)) == b)


def remove_base(c: Column, base: Column, relative: bool = False) -> Column:
    """Without the base's elements; unchanged where it isn't a prefix. ``relative`` puts ``./`` in front."""
    e, b = elements(c), elements(base)
    fits = (c.startswith("/") == base.startswith("/")) & (F.size(b) <= F.size(e)) & (F.slice(e, F.lit(1), F.size(b)) == b)
    rest = F.array_join(F.slice(e, F.size(b) + 1, F.size(e)), "/")
    return F.when(fits, F.concat(F.lit("./"), rest) if relative else rest).otherwise(c)

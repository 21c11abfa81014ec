"""Output templates: text with ``{variable:function:function}`` and capture groups, compiled once to a Column."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import paths, text

FUNCTIONS = {
    "win": text.win, "unix": text.unix, "native": text.unix, "esc": text.escape, "upper": F.upper, "lower": F.lower,
    "directory": paths.directory, "filename": paths.filename, "file": paths.stem, "extension": paths.extension,
}
_PART = re.compile(r"\{([^{}]*)\}|\(\?<([a-zA-Z_][a-zA-Z0-9_]*)>|(\()|(\))")


def apply_function(c: Column, call: str) -> Column:
    if call.startswith("substr"):
        start, *length = call[len("substr") :].strip("$ ").split(",")
        return text.substr(c, int(start), int(length[0]) if length else None)
    if call.startswith("$"):
        return text.replace_delimited(c, call[1:])
    if call not in FUNCTIONS:
        raise ValueError(f"unknown function: {call}")
    return FUNCTIONS[call](c)


class Template:
    """``render`` gives the text, ``captures`` the map of the template's groups (``0`` is the whole text)."""

    def __init__(self, pattern: str, strict: bool = True):
        self.pattern, self.strict = pattern, strict

    def _value(self, reference: str, scope: Mapping[str, Column]) -> Column:
        name, *calls = reference.split(":")
        if name not in scope:
            if self.strict:
                raise KeyError(name)
            value = F.lit("")
        elif self.strict:
            value = scope[name]
        else:
            value = F.coalesce(scope[name], F.lit(""))
        for call in calls:
            value = apply_function(value, call)
        if self.strict and name in scope:  # around the functions, which repeat their argument
            value = F.when(scope[name].isNull(), F.raise_error(F.lit(f"unresolved variable: {name}"))).otherwise(value)
        return value

    def unresolved(self, scope: Mapping[str, Column]) -> list[str]:
        return [n for m in _PART.finditer(self.pattern) if m[1] is not None and (n := m[1].split(":")[0]) not in scope]

    def _compiled(self, scope: Mapping[str, Column]) -> tuple[Column, dict[str, Column]]:
        if self.strict and (lost := self.unresolved(scope)):
            raise KeyError(f"unresolved variable: {lost[-1]}")  # the last one is named
        open_: list[tuple[str, int]] = []
        parts: list[Column] = []
        groups: dict[str, Column] = {}
        number, at = 0, 0
        for m in _PART.finditer(self.pattern):
            if m.start() > at:
                parts.append(F.lit(self.pattern[at : m.start()]))
            at = m.end()
            if m[1] is not None:
                parts.append(self._value(m[1], scope))
            elif m[4]:
                name, begin = open_.pop()
                groups[name] = F.concat(F.lit(""), *parts[begin:])
            else:
                number += 1
                open_.append((m[2] or str(number), len(parts)))
        if at < len(self.pattern):
            parts.append(F.lit(self.pattern[at:]))
        return F.concat(F.lit(""), *parts), groups

    def render(self, scope: Mapping[str, Column]) -> Column:
        return self._compiled(scope)[0]

    def captures(self, scope: Mapping[str, Column]) -> Column:
        whole, groups = self._compiled(scope)
        entries = [F.lit("0"), whole]
        for name, value in groups.items():
            entries += [F.lit(name), value]
        return F.create_map(*entries)


def assign(df, name: str, value: Column):
    return df.withColumn(name, value)


def unset(df, *names: str):
    return df.drop(*names)

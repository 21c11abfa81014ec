"""Secrets by one deterministic automaton for all rules.

The rules' patterns are compiled by subset construction and minimised into one transition table; every byte of a text is
read once and moves one state. Where a rule accepts, its own reversed automaton walks back to the match's first byte, so
that a byte far from any secret costs one look-up whatever the number of rules.

Matches are leftmost and don't overlap within a rule, as a search with the rule's pattern would give them one after the
other; a match that fails its rule's length still takes its place. To the base rules the automaton adds credentials of
known form (``ADDED``); their spans come beside those of the base rules and change none of them. All rules cost one pass.

Scale: documents are scanned where they are read, in whole; nothing is shuffled.

Defined results: a null text is empty and has no spans; a text of any length is scanned whole; rows are scanned each, whatever
their ids; spans that start together come in the order of their rules; an empty table gives an empty table; other columns of
``docs``, whatever their names, are neither read nor returned. Spans are in code points, the end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import bytes_of, compile_rules, reverse, word
from .common import to_python

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


@dataclass(frozen=True)
class Rule:
    """``head`` then one or more bytes of ``tail``. ``least`` tail bytes make a match count. If ``eager``, the automaton
    accepts at the least length only: allowed where a shorter match can't hide another one."""

    name: str
    head: tuple
    tail: frozenset
    least: int
    eager: bool


_QUOTE, _SPACES = ("opt", bytes_of("\"'")), ("star", bytes_of(" "))
_KEYS = ("any", *[word(k, True) for k in ("password", "passwd", "secret", "token")], ("seq", word("api", True), ("opt", bytes_of("_")), word("key", True)))
#: The key words, prefixes, classes and lengths of the base rules.
RULES = (
    Rule("assign", ("seq", _KEYS, _QUOTE, _SPACES, bytes_of(":="), _SPACES, _QUOTE), bytes_of(UPPER + LOWER + DIGITS + "+/_.=-"), 8, False),
    Rule("access", word("AKIA"), bytes_of(UPPER + DIGITS), 12, True),
    Rule("hex", ("seq",), bytes_of(DIGITS + "abcdef"), 32, True),
)
_ALNUM = UPPER + LOWER + DIGITS
#: Public forms of credentials. None is eager: the automaton of several counted tails would hold a state for each
#: way in which they can run side by side.
ADDED = (
    Rule("github", ("seq", word("gh"), bytes_of("pousr"), bytes_of("_")), bytes_of(_ALNUM), 36, False),
    Rule("slack", ("seq", word("xox"), bytes_of("abprs"), bytes_of("-")), bytes_of(_ALNUM + "-"), 10, False),
    Rule("google", word("AIza"), bytes_of(_ALNUM + "_-"), 35, False),
    Rule("pem", ("seq", word("-----BEGIN "), ("any", ("seq",), *[word(k) for k in ("RSA ", "EC ", "DSA ", "OPENSSH ", "ENCRYPTED ")]), word("PRIVATE KEY")), bytes_of("-"), 5, False),
)
BASE_KINDS = tuple(r.name for r in RULES)


@lru_cache(maxsize=8)  # once a worker
def compiled(rules: tuple[Rule, ...]) -> tuple:
    """The forward automaton, and per rule the automaton of its reversed head."""
    heads = [("seq", r.head, ("times", r.tail, r.least)) if r.eager else ("seq", r.head, r.tail) for r in rules]
    return compile_rules(heads, True), [compile_rules([reverse(h)], False) for h in heads]


def find(text: bytes, forward, back, rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """(start, rule, end) in bytes of the matches that count."""
    out: list[tuple[int, int, int]] = []
    over = [0] * len(rules)  # where each rule's last match ends, failing ones included
    row = forward.rows[0]
    at = 0
    for b in text:
        row = row[b]
        at += 1
        if row[256]:
            for r, rule in enumerate(rules):
                if row[256] >> r & 1 and at > over[r]:
                    state, start, k = back[r].rows[0], -1, at
                    while k > over[r]:  # back to the earliest byte from which the rule accepts here
                        k -= 1
                        state = state[text[k]]
                        if state[256]:
                            start = k
                        elif state is back[r].sink:
                            break
                    if start < 0:
                        continue
                    end = at
                    while end < len(text) and text[end] in rule.tail:
                        end += 1
                    over[r] = end
                    if rule.eager or end - at + 1 >= rule.least:
                        out.append((start, r, end))
    return sorted(out)


def scanner(rules: tuple[Rule, ...]) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forward, back = compiled(rules)
        for batch in batches:
            spans = []
            for value in batch.column(1):
                text = value.as_buffer()
                text = bytes(text) if text is not None else b""
                found = find(text, forward, back, rules)
                if found and not text.isascii():
                    place = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]).tolist()
                    found = [(place[s], r, place[e]) for s, r, e in found]
                spans.append([{"kind": rules[r].name, "start": s, "end": e} for s, r, e in found])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["__id", "spans"])

    return scan


def scan_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES + ADDED) -> DataFrame:
    """(``id``, spans) per row: an array of (kind, start, end) by start, then by the order of the rules."""
    kind = docs.schema[id].dataType.simpleString()
    own = to_python(docs).select(F.col(id).alias("__id"), F.col(text).cast("string").alias("__text"))
    return own.mapInArrow(scanner(rules), f"__id {kind}, spans array<struct<kind: string, start: long, end: long>>").withColumnRenamed("__id", id)

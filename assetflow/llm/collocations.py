"""Phrases that hold together: counts of all phrases of two to five words, and how tightly their parts belong to each other.

Counts live in sorted streams, never in one task's table:

1. *Table of counters.* Words and pairs of neighbouring words are counted by keyed hash in ``COUNTERS`` saturating counters.
   Where a counter stays below the least count, the word or pair surely does too; a collision only costs rows.
2. *Runs.* Each place of a text gives one run: the up to five words that start there, cut before the first pair that the
   counters rule out. Every phrase that starts at the place is a prefix of that run, so one run stands for five phrases. A task
   sorts a stretch of runs, adds up equal ones and hands them on by ranges, as packed columns of word numbers.
3. *Prefix order.* A range's sorted stretches are merged, and the counts of all phrases are added up along the order. A prefix
   that a range's edge parts comes out of each range with its part, and the parts are added.
4. *Lockstep joins.* The stream of frequent phrases is sorted by their reversed words: there the parts that a phrase ends
   with come before it on the stack, which gives the right counts, and its longer phrases to the left come after it. Then it is sorted by its words,
   which gives the left counts and longer phrases to the right. A range begins with copies of the phrases that its first key
   begins with, so no range needs another's stack. No phrase is looked up by hash.

A phrase inside a longer one of at least its share is dropped. It is enough to look at phrases longer by one word: the longer
one holds such a phrase, and that one is at least as frequent.

Scale: texts are read three times and never shuffled; runs are, packed, after they are combined. Ranges part a hot word's or pair's
phrases. The counters are of one size for any table; when many pairs are frequent they rule out less, which costs runs and no results.
What comes to the driver are the counters' bits and samples of about ``SPLIT_SAMPLE`` keys for split points. The highest scores
are found in two levels, so a language may hold all phrases.

Defined results: a null text is empty; texts of any length are taken whole; a null language is ``und``, together with rows
that say so; repeated rows count each time; ties of cuts go to the shortest first part, ties of scores to the higher count and
then to the phrase's bytes; an empty table gives an empty table; other columns, whatever their names, aren't read. Words are
named by 64-bit keyed hashes only while a task combines its runs; everywhere else they are compared by their bytes.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, MASK, kept_table, mix, secret, sent_if_small, text_chunks, to_python, word_hashes, word_table, words

LEAST, LONGEST, TOP = 100, 5, 2000
UNKNOWN = "und"
#: Counters of words and pairs, one byte each, and those of one row of the table.
COUNTERS, BLOCK = 1 << 23, 1 << 16
#: Runs that a task sorts and combines before it hands them on, and places of the texts, about, whose runs are one range.
HELD_RUNS, RANGE_PLACES = 1_500_000, 2_500_000
#: Phrases of one range, about, and the most keys that split points are taken from. Only the ranges' sizes depend on them.
RANGE_ROWS, SPLIT_SAMPLE = 200_000, 20_000
_PIECE_ENDS = word_table(b".,;:!?\n\x0b\x0c\r")
_PARTING = _PIECE_ENDS | word_table(b" \t")


def _tokens(batch: pa.RecordBatch, key: int) -> Iterator[tuple]:
    """Of each chunk: languages of its rows, bytes, word starts and ends, rows, hashes of words (with their language) and of
    pairs, and whether a word goes on from the one before it in the same piece."""
    langs = batch.column(0)
    for base, data, offsets in text_chunks(batch.column(1)):
        data = LOWER[data]
        start, end, row = words(data, offsets, _PARTING)
        names = langs.slice(base, len(offsets) - 1).dictionary_encode()
        code = names.indices.to_numpy(zero_copy_only=False)
        dictionary = names.dictionary.to_pylist()
        salt = np.zeros(max(len(dictionary), 1), np.uint64)
        for i, name in enumerate(dictionary):
            raw = np.frombuffer(name.encode(), np.uint8)
            salt[i] = word_hashes(raw, np.zeros(1, np.int64), np.array([len(raw)]), key ^ 1)[0]
        word_lang = code[row]
        h = mix(word_hashes(data, start, end, key) ^ salt[word_lang])
        ends = np.concatenate([[0], np.cumsum(_PIECE_ENDS[data])])
        joined = np.zeros(len(start), bool)
        joined[1:] = (row[1:] == row[:-1]) & (ends[start[1:]] == ends[start[:-1]])
        yield dictionary, data, start, end, word_lang, h, joined


def _pairs(h: np.ndarray) -> np.ndarray:
    """Hash of each word with the next; the last has none."""
    return mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + mix(h[1:]))


def counter_maker(key: int, counters: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(counters, np.uint32)
        for batch in batches:
            for *_, h, joined in _tokens(batch, key):
                np.add.at(table, h % np.uint64(counters), np.uint32(1))
                np.add.at(table, _pairs(h)[joined[1:]] % np.uint64(counters), np.uint32(1))
        out = []
        for k, part in enumerate(np.minimum(table, 255).astype(np.uint8).reshape(-1, min(BLOCK, counters))):
            at = np.flatnonzero(part)
            if 3 * len(at) < len(part):
                if len(at):
                    out.append((k, at.astype(np.uint16).tobytes(), part[at].tobytes()))
            else:
                out.append((k, None, part.tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "at", "n"])

    return count


def block_adder(least: int, size: int) -> Callable:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bits of the blocks that this task was dealt; rows pass one by one, so it holds those blocks and nothing more."""
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, at, n in zip(*[batch.column(i) for i in range(3)], strict=True):
                table = sums.setdefault(k.as_py(), np.zeros(size, np.uint16))
                n = np.frombuffer(n.as_buffer(), np.uint8)
                at = np.frombuffer(at.as_buffer(), np.uint16) if at.is_valid else slice(None)
                table[at] = np.minimum(table[at] + n, 255)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([np.packbits(t >= min(least, 255), bitorder="little").tobytes() for t in sums.values()], pa.binary())], ["block", "bits"]
        )

    return add


def _bits(texts: DataFrame, key: int, least: int, counters: int) -> np.ndarray:
    """Which counters reach the least count, as a packed table: ``counters`` / 8 bytes."""
    size = min(BLOCK, counters)
    parts = texts.mapInArrow(counter_maker(key, counters), "block int, at binary, n binary")
    # A block's rows pass through its task as a stream, so few tasks do.
    rows = parts.repartition(min(8, counters // size), "block").mapInArrow(block_adder(least, size), "block int, bits binary").collect()
    out = np.zeros(counters // 8, np.uint8)
    for block, bits in rows:
        out[block * size // 8 : (block + 1) * size // 8] = np.frombuffer(bits, np.uint8)
    return out


def _frequent(bits: np.ndarray) -> Callable:
    counters = len(bits) * 8

    def may_be(h: np.ndarray) -> np.ndarray:
        at = h % np.uint64(counters)
        return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    return may_be


#: Of one language's runs in one range: words (each with a blank behind it), a column of word numbers for each place of a run (0
#: is none), counts. Rows without words give the language's number of words.
RUNS = "range int, lang string, words binary, columns binary, counts binary"
_RUNS = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("words", pa.binary()), ("columns", pa.binary()), ("counts", pa.binary())])
_CODEC = pa.Codec("zstd")


def _sorted_runs(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Different runs, sorted, with their counts added up. Three word numbers of 21 bits are compared as one."""
    keys = []
    for k in range(0, len(columns), 3):
        key = np.zeros(len(columns[0]), np.uint64)
        for c in columns[k : k + 3]:
            key = key << np.uint64(21) | c.astype(np.uint64)
        keys.append(key)
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    at = np.flatnonzero(new)
    total = np.diff(np.append(at, len(order))) if counts is None else np.add.reduceat(counts[order], at)
    return [c[order[at]] for c in columns], total


def run_maker(key: int, bits: np.ndarray, longest: int, splits: list[tuple[str, bytes]]) -> Callable:
    may_be_frequent = _frequent(bits)

    def flush(held: list[tuple], known: dict[int, bytes], langs: list[str]) -> Iterator[tuple]:
        lang, *columns = (np.concatenate(c) for c in zip(*held, strict=True))
        for k in np.unique(lang).tolist():
            own = [c[lang == k] for c in columns]
            # Hashes give way to ranks in the order of the words' bytes; 0 stands for no word.
            names = np.unique(own[0])  # every word of a run begins one itself
            text = [known[h] for h in names.tolist()]
            order = sorted(range(len(text)), key=text.__getitem__)
            text = [text[i] for i in order]
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(1, len(order) + 1)
            own, counts = _sorted_runs([np.where(c == 0, 0, rank[np.minimum(np.searchsorted(names, c), len(names) - 1)]) for c in own])
            run = lambda i, own=own, text=text: b"".join([text[c[i] - 1] for c in own if c[i]])
            lo = bisect.bisect_left(splits, (langs[k], b""))
            hi = bisect.bisect_right(splits, (langs[k], b"\xff"))
            edges = [0, *[bisect.bisect_left(range(len(counts)), s, key=run) for _, s in splits[lo:hi]], len(counts)]
            for r, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if a == b:
                    continue
                part = np.stack([c[a:b] for c in own])
                used = np.unique(part)
                used = used[used > 0]
                local = np.where(part == 0, 0, np.searchsorted(used, part) + 1).astype(np.uint16 if len(used) < 65536 else np.uint32)
                yield lo + r, langs[k], *(_packed(x) for x in (b"".join([text[i - 1] for i in used.tolist()]), local.tobytes(), counts[a:b].astype(np.uint32).tobytes()))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(rows(batches), _RUNS, 500)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[tuple] = []
        known: dict[int, bytes] = {}
        langs: list[str] = []
        total: list[int] = []
        for batch in batches:
            for names, data, start, end, lang, h, joined in _tokens(batch, key):
                if not len(h):
                    continue
                for name in names:
                    if name not in langs:
                        langs.append(name)
                        total.append(0)
                number = np.array([langs.index(n) for n in names], np.int32)
                for i, n in enumerate(np.bincount(lang, minlength=len(names)).tolist()):
                    total[number[i]] += n
                h[h == 0] = 1  # 0 stands for no word
                ok = may_be_frequent(h)
                goes_on = np.zeros(len(h), bool)
                goes_on[:-1] = joined[1:] & ok[:-1] & ok[1:]
                at = np.flatnonzero(goes_on)
                goes_on[at] = may_be_frequent(_pairs(h)[at])
                at = np.flatnonzero(ok)
                name, first = np.unique(h[at], return_index=True)
                raw = data.tobytes()
                known.update((x, raw[a:b] + b" ") for x, a, b in zip(name.tolist(), start[at[first]].tolist(), end[at[first]].tolist(), strict=True) if x not in known)
                columns, open_ = [h[at]], goes_on[at]
                for k in range(1, longest):
                    more = np.flatnonzero(open_)
                    column = np.zeros(len(at), np.uint64)
                    column[more] = h[at[more] + k]
                    open_[more] = goes_on[at[more] + k]
                    columns.append(column)
                held.append((number[lang[at]], *columns))
                if sum(len(x[0]) for x in held) > HELD_RUNS:
                    yield from flush(held, known, langs)
                    held, known = [], {}
        if held:
            yield from flush(held, known, langs)
        for name, n in zip(langs, total, strict=True):
            yield 0, name, None, None, np.array([n], np.int64).tobytes()

    return runs


def _packed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _unpacked(raw: bytes) -> bytes:
    return _CODEC.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)


COUNTS = "lang string, key binary, k int, f long, parted boolean"
_COUNTS = pa.schema([("lang", pa.string()), ("key", pa.binary()), ("k", pa.int32()), ("f", pa.int64()), ("parted", pa.bool_())])


def prefix_counter(least: int, longest: int) -> Callable:
    """Counts of all prefixes of each range's runs, of rows sorted by range and language. What may go on in a neighbouring range
    is marked ``parted``."""

    def phrases(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (_, lang), own in groupby(rows, key=lambda r: r[:2]):
            parts = []
            for _, _, text, columns, counts in own:
                if text is None:
                    yield lang, b"", 0, int(np.frombuffer(counts, np.int64)[0]), True
                    continue
                text, counts = _unpacked(text).split(b" ")[:-1], np.frombuffer(_unpacked(counts), np.uint32)
                columns = np.frombuffer(_unpacked(columns), np.uint16 if len(text) < 65536 else np.uint32)
                parts.append((text, columns.reshape(longest, -1), counts))
            if parts:
                yield from counted(lang, parts)

    def counted(lang: str, parts: list[tuple]) -> Iterator[tuple]:
        # By the bytes that follow a word, which are a blank.
        text = sorted({w for t, _, _ in parts for w in t}, key=lambda w: w + b" ")
        rank = {w: i + 1 for i, w in enumerate(text)}
        maps = [np.array([0, *[rank[w] for w in t]], np.int32) for t, _, _ in parts]
        columns = [np.concatenate([m[c[j]] for m, (_, c, _) in zip(maps, parts, strict=True)]) for j in range(longest)]
        columns, counts = _sorted_runs(columns, np.concatenate([n for _, _, n in parts]).astype(np.int64))
        new = np.zeros(len(counts), bool)
        new[0] = True
        for k in range(1, longest + 1):
            new[1:] |= columns[k - 1][1:] != columns[k - 1][:-1]
            at = np.flatnonzero(new)
            total = np.add.reduceat(counts, at)
            edge = np.zeros(len(at), bool)
            edge[[0, -1]] = True
            for i, n, parted in zip(*(x[(columns[k - 1][at] > 0) & ((total >= least) | edge)].tolist() for x in (at, total, edge)), strict=True):
                yield lang, b"".join([text[c[i] - 1] + b" " for c in columns[:k]]), k, n, parted

    return lambda batches: _batched(phrases(_rows(batches)), _COUNTS)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)], strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _sampled(texts: DataFrame, key: int, longest: int, ranges: int, rate: float) -> list[tuple[str, bytes]]:
    """Split points of the runs, from a sample of places at ``rate``. Only the ranges' sizes depend on it."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(TaskContext.get().partitionId())
        out: list[tuple] = []
        for batch in batches:
            for names, data, start, end, lang, h, joined in _tokens(batch, key):
                raw = data.tobytes()
                for i in np.flatnonzero(draw.random(len(h)) < rate).tolist():
                    stop = i + 1
                    while stop < min(len(h), i + longest) and joined[stop]:
                        stop += 1
                    out.append((names[lang[i]], b"".join([raw[start[j] : end[j]] + b" " for j in range(i, stop)])))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in ((0, pa.string()), (1, pa.binary()))], ["lang", "key"])

    found = sorted((a, bytes(b)) for a, b in texts.mapInArrow(some, "lang string, key binary").limit(2 * SPLIT_SAMPLE).collect())
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


def phrase_counts(docs: DataFrame, lang: str, text: str, least: int, longest: int, counters: int = COUNTERS, range_places: int = RANGE_PLACES) -> DataFrame:
    """(lang, key, k, f): each phrase of up to ``longest`` words that comes ``least`` times, every word with a blank behind it,
    and per language the number of all words as the phrase of none."""
    key = secret()
    texts = to_python(docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text")))
    bits = _bits(texts, key, least, counters)
    places = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 5 + 1  # about
    ranges = 1 + places // range_places
    splits = _sampled(texts, key, longest, ranges, min(1.0, SPLIT_SAMPLE / places)) if ranges > 1 else []
    runs = texts.mapInArrow(run_maker(key, bits, longest, splits), RUNS).repartition(len(splits) + 1, "range").sortWithinPartitions("range", "lang")
    found = kept_table(runs.mapInArrow(prefix_counter(least, longest), COUNTS))
    whole = found.where("parted").groupBy("lang", "key", "k").agg(F.sum("f").alias("f"))
    return found.where("NOT parted").select("lang", "key", "k", "f").unionByName(whole).where((F.col("f") >= least) | (F.col("k") == 0))


def _splits(df: DataFrame, n: int) -> list[tuple[str, bytes]]:
    """Up to ``n`` - 1 keys that part the table into ranges of about one size, from a sample by hash of bounded size."""
    rows = df.count()
    if n < 2 or not rows:
        return []
    part = max(1, -(-rows // (SPLIT_SAMPLE // 2)))
    sample = sorted((a, bytes(b)) for a, b in df.select("lang", "order_key").where(F.pmod(F.xxhash64("lang", "order_key"), F.lit(part)) == 0).limit(SPLIT_SAMPLE).collect())
    return sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []


#: ``copy`` rows stand for phrases of other ranges; ``shared`` phrases have copies.
PHRASE = "lang string, order_key binary, key binary, k int, f long, parts array<long>, longer long, copy boolean"
STREAM = f"range int, {PHRASE}, shared boolean"
_PHRASE = [("lang", pa.string()), ("order_key", pa.binary()), ("key", pa.binary()), ("k", pa.int32()), ("f", pa.int64()), ("parts", pa.list_(pa.int64())), ("longer", pa.int64()), ("copy", pa.bool_())]
_STREAM = pa.schema([("range", pa.int32()), *_PHRASE, ("shared", pa.bool_())])


def range_dealer(splits: list[tuple[str, bytes]]) -> Callable:
    """Each phrase to the range of its key, and as a copy to the ranges after it that begin with it."""

    def dealt(rows: Iterator[tuple]) -> Iterator[tuple]:
        for lang, order_key, *rest, copy in rows:
            own = bisect.bisect_right(splits, (lang, order_key))
            last = own
            while not copy and last < len(splits) and splits[last][0] == lang and splits[last][1].startswith(order_key):
                last += 1
            yield own, lang, order_key, *rest, copy, last > own
            for other in range(own + 1, last + 1):
                yield other, lang, order_key, *rest, True, True

    return lambda batches: _batched(dealt(_rows(batches)), _STREAM)


JOINED = "lang string, key binary, k int, f long, before array<long>, parts array<long>, longer long, copy boolean, shared boolean"
_JOINED = pa.schema([("lang", pa.string()), ("key", pa.binary()), ("k", pa.int32()), ("f", pa.int64()), ("before", pa.list_(pa.int64())), ("parts", pa.list_(pa.int64())), ("longer", pa.int64()), ("copy", pa.bool_()), ("shared", pa.bool_())])


def lockstep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of STREAM, sorted: each phrase with the counts of the phrases that its key begins with, shortest first, and the
    highest count of the phrases longer by one word that begin with it. Copies only hand on what they have seen."""

    def joined(rows: Iterator[tuple]) -> Iterator[tuple]:
        stack: list[list] = []  # order_key, f, longer and the row's own columns
        at = None

        def close(depth: int) -> Iterator[tuple]:
            while len(stack) > depth:
                order_key, f, longer, lang, key, k, parts, copy, shared = stack.pop()
                if longer is not None or not copy:
                    yield lang, key, k, f, None if copy else [x[1] for x in stack], parts, longer, copy, shared
                if stack and k == stack[-1][5] + 1:
                    stack[-1][2] = max(f, stack[-1][2] or 0)

        for place, lang, order_key, key, k, f, parts, longer, copy, shared in rows:
            if (place, lang) != at:
                yield from close(0)
                at = place, lang
            while stack and not order_key.startswith(stack[-1][0]):
                yield from close(len(stack) - 1)
            if stack and stack[-1][0] == order_key:  # one phrase by several rows: what each of them has seen
                top = stack[-1]
                top[2] = max(top[2] or 0, longer or 0) or None
                top[6], top[7], top[8] = top[6] or parts, top[7] and copy, top[8] or shared
            else:
                stack.append([order_key, f, longer, lang, key, k, parts, copy, shared])
        yield from close(0)

    return _batched(joined(_rows(batches)), _JOINED)


def _streamed(phrases: DataFrame, order_key, ranges: int) -> DataFrame:
    """``phrases`` (key, parts, longer, copy and counts) through ``lockstep`` in the order of ``order_key``."""
    keyed = phrases.select("lang", order_key.alias("order_key"), "key", "k", "f", "parts", "longer", "copy")
    splits = _splits(keyed.where("NOT copy"), ranges)
    dealt = keyed.mapInArrow(range_dealer(splits), STREAM).repartition(len(splits) + 1, "range")
    return dealt.sortWithinPartitions("range", "lang", "order_key", "copy").mapInArrow(lockstep, JOINED)


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP, absorbed_percent: int = 100, counters: int = COUNTERS, range_places: int = RANGE_PLACES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to ``longest`` words that come ``least``
    times. ``score`` is floor(1000 * a * n / (l * r)) at the phrase's weakest cut; a phrase inside a longer one that has
    ``absorbed_percent`` of its count is left out."""
    counts = kept_table(phrase_counts(docs, lang, text, least, longest, counters, range_places))
    phrases = counts.where("k > 0").withColumns({"parts": F.lit(None).cast("array<long>"), "longer": F.lit(None).cast("long"), "copy": F.lit(False)})
    ranges = 1 + phrases.count() // range_rows
    # Blanks end words, so the reversed words end the same way.
    backward = F.expr("encode(concat(array_join(reverse(slice(split(decode(key, 'UTF-8'), ' '), 1, k)), ' '), ' '), 'UTF-8')")
    rights = kept_table(_streamed(phrases, backward, ranges).select("lang", "key", "k", "f", F.col("before").alias("parts"), "longer", "copy"))
    lefts = kept_table(_streamed(rights, F.col("key"), ranges))
    own = F.struct("f", "before", "parts")
    merged = lefts.where("shared OR copy").groupBy("lang", "key", "k").agg(F.max("longer").alias("longer"), F.max_by(own, F.when(~F.col("copy"), 1)).alias("own"))
    joined = lefts.where("NOT (shared OR copy)").select("lang", "key", "k", "longer", own.alias("own")).unionByName(merged).where("k > 1")
    n = sent_if_small(counts.where("k = 0").select("lang", F.col("f").alias("n")))
    # The first k words are the k-th shortest prefix, the rest the (k' - k)-th shortest suffix. Arithmetic by decimals is exact.
    cuts = F.expr("""transform(sequence(1, k - 1), c -> named_struct(
        'score', (cast(own.f as decimal(38, 0)) * 1000 * cast(n as decimal(38, 0))) div (cast(own.before[c - 1] as decimal(38, 0)) * cast(own.parts[k - c - 1] as decimal(38, 0))),
        'cut', c, 'l', own.before[c - 1], 'r', own.parts[k - c - 1]))""")
    alone = joined.where(F.col("longer").isNull() | (100 * F.col("longer") < absorbed_percent * F.col("own.f")))
    scored = alone.join(n, "lang").withColumn("c", F.array_min(cuts))
    rows = scored.select("lang", F.expr("decode(substring(key, 1, length(key) - 1), 'UTF-8')").alias("phrase"), F.col("own.f").alias("a"), "c.l", "c.r", "n", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = rows.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(ranges))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order))).where(F.col("rank") <= top)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return last.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Benchmark decontamination by winnowing.

Of every 9 consecutive 5-word hashes the smallest is kept as a fingerprint, in the benchmark and in the documents alike,
so any 13 equal words in a row share a fingerprint at the same place. Documents are scanned once: a fingerprint that may
be in the benchmark is extended to the 13-word windows around it, which are joined with the benchmark's windows by hash and
by their words, so a hit is a hit on the words themselves. Items of fewer than 13 words are one window each, and are looked
up whole. The hashes are keyed anew in each call; results don't depend on the key.

Scale: what is handed to the tasks is a bit table over the benchmark's fingerprints, 16 bits for each and ``MOST_BITS``
(8 MB) at most; it only spares rows, and the join that follows decides. A window met in many documents joins one row, the
window's, with its items in it. A document's own row is never multiplied but by its hits.

Defined results: null and empty texts have no words and aren't contaminated; texts of any length are taken whole; an item
without words has no window; equal items all count, also those of one id, which is named once; repeated documents and
documents of one id are judged each; an empty benchmark hits nothing; a null item id counts as none; an empty table gives an
empty table; other columns of ``docs``, whatever their names, are neither read nor returned by ``hits`` and are kept as they
are by ``clean_documents``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Rolling, as_signed, cut, mix, secret, sent_if_small, text_chunks, to_python, word_hashes, word_table, words

WINDOW = 13
GRAM = 5
KEEP_FROM = WINDOW - GRAM + 1
#: Bits of the table over the benchmark's fingerprints.
LEAST_BITS, MOST_BITS, BITS_EACH = 1 << 22, 1 << 26, 16
#: Percent of a document's words that must be hit.
SHARE = 5
BASE = 0xC2B2AE3D27D4EB4F
#: Words are runs of ASCII letters and digits and of all bytes beyond ASCII.
PARTING = word_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


class _Words:
    """The words of a chunk: hashes, rows, numbers by row, and their own text, in lower case and one blank apart."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, key: int):
        low = LOWER[data]
        start, end, self.row = words(low, offsets, PARTING)
        self.roll, self.count = Rolling(word_hashes(low, start, end, key), BASE), np.bincount(self.row, minlength=len(offsets) - 1)
        keep = ~PARTING[low]
        blank = end[end < len(low)]
        blank = blank[~keep[blank]]
        low[blank], keep[blank] = 32, True
        place = np.cumsum(keep)
        self.start, self.end = place[start] - 1, place[end - 1]
        self.text = low[keep].tobytes()

    def of(self, at: np.ndarray, size: np.ndarray) -> list[bytes]:
        """Text of the runs of ``size`` words from ``at`` on."""
        return [self.text[a:b] for a, b in zip(self.start[at].tolist(), self.end[at + size - 1].tolist(), strict=True)]


def _grams(roll: Rolling, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of ``size`` words inside a row, and their hashes."""
    at = np.arange(max(0, len(row) - size + 1))
    at = at[row[at] == row[at + size - 1]]
    return at, mix(roll.of(at, at + size) + np.uint64(size))


def winnow(roll: Rolling, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the fingerprints: the smallest of each ``KEEP_FROM`` neighbouring grams, the last of equals."""
    at, h = _grams(roll, row, GRAM)
    if not len(at):
        return at, h
    # A window of grams lies in one row and has no gaps, since a row's grams follow each other.
    n = max(0, len(at) - KEEP_FROM + 1)
    first = np.arange(n)
    first = first[at[first + KEEP_FROM - 1] - at[first] == KEEP_FROM - 1]
    first = first[row[at[first]] == row[at[first + KEEP_FROM - 1]]]
    best = first.copy()
    for k in range(1, KEEP_FROM):
        best = np.where(h[first + k] <= h[best], first + k, best)
    best = np.unique(best)
    return at[best], h[best]


def _bit(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h >> np.uint64(13)) % np.uint64(bits)).astype(np.int64)


def window_maker(key: int) -> Callable:
    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per item: its windows with their words, and the hashes that lead to them."""
        for batch in batches:
            for first, data, offsets in text_chunks(batch.column(1)):
                w = _Words(data, offsets, key)
                at, h = _grams(w.roll, w.row, WINDOW)
                print_at, prints = winnow(w.roll, w.row)
                short = np.flatnonzero((w.count > 0) & (w.count < WINDOW))
                begin = np.searchsorted(w.row, short)
                size = w.count[short]
                whole = mix(w.roll.of(begin, begin + size) + size.astype(np.uint64))
                rows = np.concatenate([w.row[at], short, w.row[print_at], short]).astype(np.int64)
                hashes = np.concatenate([h, whole, prints, whole])
                sizes = np.concatenate([np.full(len(at), WINDOW), size, np.full(len(print_at), GRAM), size]).astype(np.int64)
                text = w.of(np.concatenate([at, begin]), sizes[: len(at) + len(short)]) + [None] * (len(print_at) + len(short))
                lead = np.zeros(len(rows), bool)
                lead[len(at) + len(short) :] = True
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows + first)), pa.array(as_signed(hashes)), pa.array(sizes), pa.array(text, pa.binary()), pa.array(lead)], ["item", "hash", "size", "words", "lead"])

    return windows_of


def scanner(table: np.ndarray, sizes: list[int], key: int) -> Callable:
    bits = 8 * len(table)

    def may_be(h: np.ndarray) -> np.ndarray:
        k = _bit(h, bits)
        return (table[k >> 3] >> (k & 7).astype(np.uint8) & 1).astype(bool)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document: its number of words, and the windows around what may be a benchmark's fingerprint."""
        for batch in batches:
            for base, data, offsets in text_chunks(batch.column(1)):
                n = len(offsets) - 1
                w = _Words(data, offsets, key)
                begin = np.concatenate([[0], np.cumsum(w.count)])
                at, h = winnow(w.roll, w.row)
                at = at[may_be(h)]
                # The windows of 13 words that hold the fingerprint's 5.
                start = np.unique((at[:, None] - np.arange(KEEP_FROM)).ravel())
                start = start[start >= 0]
                own = w.row[start]
                start = start[(start >= begin[own]) & (start + WINDOW <= begin[own + 1])]
                found = [(start, mix(w.roll.of(start, start + WINDOW) + np.uint64(WINDOW)), np.full(len(start), WINDOW))]
                for size in sizes:
                    at, h = _grams(w.roll, w.row, size)
                    may = may_be(h)
                    found.append((at[may], h[may], np.full(int(may.sum()), size)))
                start, h, size = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(start, kind="stable")
                start, h, size = start[order].astype(np.int64), h[order], size[order].astype(np.int64)
                own = w.row[start] if len(start) else np.zeros(0, np.int64)
                place = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))]).astype(np.int32)
                span = pa.StructArray.from_arrays([pa.array((start - begin[own]).astype(np.int64)), pa.array(as_signed(h)), pa.array(size), pa.array(w.of(start, size), pa.binary())], ["start", "hash", "size", "words"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(base, n), pa.array(w.count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(place), span)], ["__id", "n_words", "spans"])

    return scan


def hits(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", share: int = SHARE) -> DataFrame:
    """(``id``, n_words, n_hit, n_items, items, contaminated) per document; items is a sorted array of the ids as strings."""
    key = secret()
    items = to_python(benchmark).select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("t"))
    made = cut(items.mapInArrow(window_maker(key), "item string, hash long, size long, words binary, lead boolean"))
    leads = made.where("lead").select("hash")
    bits = min(max(LEAST_BITS, 1 << (BITS_EACH * leads.count()).bit_length()), MOST_BITS)
    # 64-bit words of the table come to the driver, of which there are at most a million, not the fingerprints.
    bit = F.pmod(F.shiftrightunsigned("hash", 13), F.lit(bits))
    packed = leads.select((bit / 64).cast("int").alias("word"), (bit % 64).cast("int").alias("b")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("mask")).toArrow()
    table = np.zeros(bits // 64, "<i8")
    table[packed.column("word").to_numpy()] = packed.column("mask").to_numpy()
    sizes = sorted(r[0] for r in made.where((F.col("size") < WINDOW) & ~F.col("lead")).select("size").distinct().collect())  # 12 at most
    windows = made.where("NOT lead").groupBy("hash", "words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    kind = docs.select(id).schema[0].dataType.simpleString()
    scanned = to_python(docs).select(F.col(id).alias("__id"), F.col(text).alias("__t")).mapInArrow(
        scanner(table.view(np.uint8), sizes, key), f"__id {kind}, n_words long, spans array<struct<start: long, hash: long, size: long, words: binary>>"
    )
    rows = scanned.withColumn("__row", F.monotonically_increasing_id())
    # One plan, one scan: documents without spans keep a row whose key is their own number, so they spread evenly.
    spread = rows.select("__id", "n_words", "__row", F.explode_outer("spans").alias("s")).select(
        "__id", "n_words", "__row", F.col("s.start").alias("start"), F.coalesce("s.hash", "__row").alias("hash"), F.col("s.size").alias("size"), F.coalesce("s.words", F.lit(b"")).alias("words")
    )
    met = spread.join(windows, ["hash", "words"], "left")
    per = met.groupBy("__row", "__id", "n_words").agg(
        F.sort_array(F.collect_list(F.when(F.col("items").isNotNull(), F.struct("start", "size")))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # The union of [start, start + size) over spans in order of start: what each adds beyond the furthest end so far.
    union = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["size"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(a["end"], s["start"]))).alias("n")),
    )["n"]
    return per.select(F.col("__id").alias(id), "n_words", union.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items").withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.lit(100 // share) * F.col("n_hit") >= F.col("n_words"))
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones, whatever its columns are called. Rows are told apart by id, null included, and a
    checksum of the text, so each goes or stays by its own text."""
    names = docs.columns
    plain = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    own = lambda c: f"__c{names.index(c)}"
    marked = plain.withColumn("__who", F.struct(F.col(own(id)).alias("name"), F.xxhash64(own(text)).alias("check")))
    bad = cut(hits(marked.select("__who", F.col(own(text)).alias("__body")), benchmark, "__who", "__body").where("contaminated").select(F.col("__who").alias("__bad")).distinct())
    return marked.join(sent_if_small(bad), F.col("__who") == F.col("__bad"), "left_anti").select(*plain.columns).toDF(*names)

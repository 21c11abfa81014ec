"""Remove repeated 100-byte strings, exactly, by sorted suffixes.

1. *Anchors.* Of every ``KEEP_FROM`` neighbouring 32-byte hashes the smallest is an anchor (winnowing), so every 100-byte
   string holds an anchor that depends on its own bytes alone: equal strings meet at equal anchors, at equal offsets.
   An anchor stands for the run of string starts that fall to it; the bytes they span are its context.
2. *Classes.* Anchors are dealt by hash. Anchor hashes propose that contexts are equal, and keyed BLAKE2b digests of all their
   bytes, 128 bits, decide it; of equal ones all but the first (smallest id, then start) are repeats whole, so long copies are settled without
   looking at single starts. Within a task's chunk this is done before the shuffle, which leaves one context a chunk of any
   passage, however common.
3. *Suffix sort.* First contexts that share an anchor but differ somewhere (the edges of passages) are fetched, and the
   suffixes that start in them are sorted by a mergesort whose comparisons find the common extension of two suffixes by
   binary search over keyed prefix polynomial hashes, in a logarithmic number of steps. The order is then verified by bytes,
   neighbour by neighbour, and where hashes have misled the sort, the group is sorted by bytes; of each run of equals the
   earliest stays.
4. The repeats of each document are united and cut out.

The hashes are keyed anew in each call, so no text can be made to collide beforehand. What the suffix sort finds doesn't depend
on its hashes at all; equal contexts are told by 128-bit keyed digests.

Scale: contexts are dealt as packed hashes, once, and texts are shuffled once, for the edges and for the cutting. An anchor
that too many different contexts share (one passage with ever other surroundings) isn't sorted in one task: the strings
around it are dealt by their own keyed digest, 16 bytes each and never the strings, after equal ones of a batch have been
reduced to their first. Tables in between are Parquet in the shared folder.

Defined results: a null text is empty; texts under 100 bytes lose nothing; a text of any length is taken whole, in pieces of
``CHUNK_BYTES`` that overlap (up to 2 GB, which is Spark's limit for a value); rows are ordered by id, then by a checksum of the text (rows of one id and text are one
document, others are different ones); a null id comes before all others; an empty table gives an empty table; other columns
of ``docs``, whatever their names, are neither read nor returned. Bytes are removed without regard to characters.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, MASK, Rolling, arrays, as_signed, kept_table, mix, secret, text_chunks, to_python

SPAN = 100
GRAM = 32
KEEP_FROM = SPAN - GRAM + 1
BUCKET_ANCHORS = 500_000
#: Edge contexts of one anchor that one task sorts together; what has more goes by the strings' digests.
MOST_CONTEXTS = 4096
#: Suffixes that one sort takes, a bucket at least, and strings of one bucket of digests.
PIECE_SUFFIXES = 200_000


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by running minima from both sides of blocks."""
    n = len(x)
    top = np.iinfo(np.uint64).max
    padded = np.full(-(-n // width) * width, top, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors_in_pieces(data: np.ndarray, offsets: np.ndarray, key: int = 0) -> tuple[np.ndarray, ...]:
    """``anchors`` of a chunk; a document longer than a chunk goes by pieces that overlap by a string less one byte, so each
    start is seen once. A run of starts that a piece parts is two contexts, which meet at their anchor like others."""
    if len(offsets) > 2 or len(data) <= 2 * CHUNK_BYTES:
        return anchors(data, offsets, key)
    parts = []
    for at in range(0, len(data) - SPAN + 1, CHUNK_BYTES):
        piece = data[at : at + CHUNK_BYTES + SPAN - 1]
        row, lo, hi, anchor, h, context = anchors(piece, np.array([0, len(piece)]), key)
        parts.append((row, lo + at, hi + at, anchor + at, h, context))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _digests(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, key: int) -> np.ndarray:
    """Keyed 128-bit digests of the bytes from ``lo`` to ``hi``, two numbers each."""
    raw, k = memoryview(data.tobytes()), (key & MASK).to_bytes(8, "little")
    return np.frombuffer(b"".join([hashlib.blake2b(raw[a:b], digest_size=16, key=k).digest() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]), np.uint64).reshape(-1, 2)


def anchors(data: np.ndarray, offsets: np.ndarray, key: int = 0) -> tuple[np.ndarray, ...]:
    """Per anchor: row, first and last start it stands for and its own place (all in ``data``), anchor hash, context digest."""
    length = np.maximum(np.diff(offsets) - SPAN + 1, 0)
    total = int(length.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), np.zeros((0, 2), np.uint64)
    roll = Rolling(data, key | 1)
    g = np.arange(len(data) - GRAM + 1)
    h = mix(roll.of(g, g + GRAM))
    # Upper half hash, lower half place: the minimum is the leftmost gram with the least hash, whatever the chunk.
    low = sliding_minimum((h & np.uint64(0xFFFFFFFF00000000)) | g.astype(np.uint64), KEEP_FROM) & np.uint64(0xFFFFFFFF)
    row = np.repeat(np.arange(len(length)), length)
    start = np.arange(total) + np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    anchor = low[start].astype(np.int64)
    new = np.ones(total, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    lo, hi = start[at], start[np.concatenate([at[1:], [total]]) - 1]
    anchor = anchor[at]
    # The anchor's place in its context is part of what has to be equal.
    return row[at], lo, hi, anchor, h[anchor], _digests(data, lo, hi + SPAN, key) + (anchor - lo).astype(np.uint64)[:, None] * np.uint64(0x9FB21C651E98DF25)


BLOCK = "bucket long, ids binary, ties binary, held binary, hash binary, context binary, proof binary, lo binary, span binary, reach binary"
REMOVED = "id long, tie long, hot boolean, hash binary, lo binary, hi binary, reach binary"


def _runs(*x: np.ndarray) -> np.ndarray:
    if not len(x[0]):
        return np.zeros(1, np.int64)
    new = np.zeros(len(x[0]), bool)
    new[0] = True
    for c in x:
        new[1:] |= c[1:] != c[:-1]
    return np.concatenate([np.flatnonzero(new), [len(x[0])]])


def _firsts(*keys: np.ndarray) -> np.ndarray:
    first = np.zeros(len(keys[0]), bool)
    first[_runs(*keys)[:-1]] = True
    return first


def _later(keys: tuple[np.ndarray, ...], place: tuple[np.ndarray, ...]) -> np.ndarray:
    """Of rows sorted by class and place: those whose place comes after the first of their class. Rows of one id and text
    are one document, so the place of a class's first may come several times."""
    at = _runs(*keys)
    begin = np.repeat(at[:-1], np.diff(at))
    later = np.zeros(len(keys[0]), bool)
    for c in place:
        later |= c != c[begin]
    return later


def block_maker(buckets: int, key: int) -> Callable:
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every_id, every_tie = arrays(batch, 0, 1)
            for base, data, offsets in text_chunks(batch.column(2)):
                ids, ties = (x[base : base + len(offsets) - 1] for x in (every_id, every_tie))
                row, lo, hi, anchor, h, digest = anchors_in_pieces(data, offsets, key)
                context, proof = np.ascontiguousarray(digest.T)
                span, reach, lo = hi - lo, anchor - lo, lo - offsets[row]
                order = np.lexsort((lo, ties[row], ids[row], proof, context, h))
                first, later = np.zeros(len(row), bool), np.zeros(len(row), bool)
                first[order] = _firsts(h[order], context[order], proof[order])
                later[order] = _later((h[order], context[order], proof[order]), (ids[row][order], ties[row][order], lo[order]))
                # Contexts that the chunk has before are repeats; they go by document and carry no hashes.
                bucket = np.where(first, (h >> np.uint64(20)) % np.uint64(buckets), (ids[row].view(np.uint64) % np.uint64(buckets)))
                bucket = np.where(first, bucket.astype(np.int64), -1 - bucket.astype(np.int64))
                order = np.lexsort((row, bucket))
                order = order[(first | later)[order]]
                at = _runs(bucket[order])
                out = []
                for a, b in zip(at[:-1], at[1:], strict=True):
                    i = order[a:b]
                    begin = _runs(row[i])
                    own = row[i][begin[:-1]]
                    if bucket[i[0]] < 0:
                        i_h = i_c = i_p = b""
                    else:
                        i_h, i_c, i_p = h[i].tobytes(), context[i].tobytes(), proof[i].tobytes()
                    out.append((int(bucket[i[0]]), ids[own].tobytes(), ties[own].tobytes(), np.diff(begin).astype(np.int32).tobytes(), i_h, i_c, i_p, lo[i].astype(np.int32).tobytes(), span[i].astype(np.uint8).tobytes(), reach[i].astype(np.uint8).tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], BLOCK.replace(" binary", "").replace(" long", "").split(", "))

    return blocks


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column] or [np.zeros(0, kind)])


def _by_document(ids, ties, hot, h, lo, hi, reach, edge) -> pa.Table:
    """Rows of REMOVED; a repeat has no hash, an edge has one."""
    order = np.lexsort((lo, hot, edge, ties, ids))
    at = _runs(ids[order], ties[order], edge[order], hot[order])
    out = [[] for _ in range(7)]
    for a, b in zip(at[:-1], at[1:], strict=True):
        i = order[a:b]
        k = i[0]
        row = (int(ids[k]), int(ties[k]), bool(hot[k]), h[i].tobytes() if edge[k] else b"", lo[i].astype(np.int32).tobytes(), hi[i].astype(np.int32).tobytes(), reach[i].astype(np.uint8).tobytes())
        for c, v in zip(out, row, strict=True):
            c.append(v)
    kinds = (pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * 4)
    return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [x.split()[0] for x in REMOVED.split(", ")])


def class_maker(most: int) -> Callable:
    def classes(group: pa.Table) -> pa.Table:
        """Of a bucket's contexts: repeats of an earlier equal one, and edges (first contexts whose anchor has others)."""
        held = _joined(group.column("held"), np.int32)
        ids, ties = np.repeat(_joined(group.column("ids"), np.int64), held), np.repeat(_joined(group.column("ties"), np.int64), held)
        lo = _joined(group.column("lo"), np.int32).astype(np.int64)
        hi = lo + _joined(group.column("span"), np.uint8)
        reach = _joined(group.column("reach"), np.uint8)
        if group.column("bucket")[0].as_py() < 0:
            none = np.zeros(len(lo), bool)
            return _by_document(ids, ties, none, lo, lo, hi + SPAN, reach, none)
        h, context, proof = (_joined(group.column(c), np.uint64) for c in ("hash", "context", "proof"))
        order = np.lexsort((lo, ties, ids, proof, context, h))
        ids, ties, lo, hi, reach, h, context, proof = (x[order] for x in (ids, ties, lo, hi, reach, h, context, proof))
        first, later = _firsts(h, context, proof), _later((h, context, proof), (ids, ties, lo))
        at = _runs(h)
        kinds = np.repeat(np.add.reduceat(first.astype(np.int64), at[:-1]), np.diff(at)) if len(h) else np.zeros(0, np.int64)
        keep = later | first & (kinds > 1)
        return _by_document(ids[keep], ties[keep], (kinds > most)[keep] & first[keep], h[keep], lo[keep], np.where(first, hi, hi + SPAN)[keep], reach[keep], first[keep])

    return classes


#: ``kind`` is CONTEXT (one context with its bytes), STRINGS (packed digests of strings around hot anchors; ``lo`` is their
#: number) or KNOWN (a repeat that the batch itself has shown, from ``lo``, ``reach`` bytes long).
EDGES = "hash long, kind int, id long, tie long, lo long, reach long, bytes binary"
CONTEXT, STRINGS, KNOWN = 0, 1, 2
#: Of each packed string: id, tie, anchor hash, digest in two halves, start.
PACK = ("<i8", "<i8", "<i8", "<u8", "<u8", "<i4")


def _edge_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.binary())
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in EDGES.split(", ")])


def edge_maker(string_buckets: int, key: int) -> Callable:
    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with their edges: the bytes of each edge's context, and for hot anchors the digests of its strings."""
        last = None
        for batch in batches:
            out: list[tuple] = []
            hot: list[tuple] = []
            seen = {last}  # rows of one id and text come together, and are one document
            ids, ties = (x.tolist() for x in arrays(batch, 0, 1))
            for base, data, offsets in text_chunks(batch.column(2)):
                for r in range(len(offsets) - 1):
                    i, t, own = ids[base + r], ties[base + r], data[offsets[r] : offsets[r + 1]]
                    last = (i, t)
                    if last in seen:
                        continue
                    seen.add(last)
                    text = own.tobytes()
                    for e in batch.column(3)[base + r].as_py():
                        lo, hi, reach = (np.frombuffer(e[c], k) for c, k in (("lo", np.int32), ("hi", np.int32), ("reach", np.uint8)))
                        h = np.frombuffer(e["hash"], np.int64)
                        if e["hot"]:
                            n = (hi - lo + 1).astype(np.int64)
                            start = np.repeat(lo.astype(np.int64) - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                            hot.append((np.full(len(start), i), np.full(len(start), t), start, np.repeat(h, n), _digests(own, start, start + SPAN, key)))
                        else:
                            out.extend((x, CONTEXT, i, t, a, d, text[a : b + SPAN]) for x, a, b, d in zip(h.tolist(), lo.tolist(), hi.tolist(), reach.tolist(), strict=True))
                    if len(out) >= 5000:
                        yield _edge_batch(out)
                        out = []
            yield _edge_batch(out + _hot_rows(hot, string_buckets))

    return edges


def _hot_rows(hot: list[tuple], buckets: int) -> list[tuple]:
    """A batch's strings around hot anchors by bucket of their digests; those that the batch has before are known repeats."""
    if not hot:
        return []
    ids, ties, lo, h, digest = (np.concatenate(c) for c in zip(*hot, strict=True))
    digest, proof = np.ascontiguousarray(digest.T)
    order = np.lexsort((lo, ties, ids, proof, digest, h))
    ids, ties, lo, h, digest, proof = (c[order] for c in (ids, ties, lo, h, digest, proof))
    first, later = _firsts(h, digest, proof), _later((h, digest, proof), (ids, ties, lo))
    out = [(i, KNOWN, i, t, a, b - a, b"") for i, t, a, b in _merged(ids[later], ties[later], lo[later])]
    ids, ties, lo, h, digest, proof = (c[first] for c in (ids, ties, lo, h, digest, proof))
    bucket = digest % np.uint64(buckets)
    order = np.lexsort((lo, ties, ids, bucket))
    at = _runs(bucket[order])
    for a, b in zip(at[:-1], at[1:], strict=True):
        k = order[a:b]
        # Buckets have hashes of their own, which spread them over tasks like anchors.
        name = int(as_signed(mix(bucket[k[:1]] + np.uint64(0xD1B54A32D192ED03)))[0])
        out.append((name, STRINGS, 0, 0, b - a, 0, b"".join(c[k].astype(d).tobytes() for c, d in zip((ids, ties, h, digest, proof, lo), PACK, strict=True))))
    return out


def _merged(ids: np.ndarray, ties: np.ndarray, lo: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(id, tie, from, to) of the strings that start at ``lo``, overlapping ones united."""
    if not len(ids):
        return []
    order = np.lexsort((lo, ties, ids))
    ids, ties, lo = ids[order], ties[order], lo[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1]) | (lo[1:] > lo[:-1] + SPAN)
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(ids)]]) - 1
    return list(zip(ids[at].tolist(), ties[at].tolist(), lo[at].tolist(), (lo[last] + SPAN).tolist(), strict=True))


def repeats_of_strings(packs: list[tuple[int, bytes]]) -> list[tuple[int, int, int, int]]:
    """Repeats among a bucket's packed strings."""
    parts = []
    for n, raw in packs:
        cols, at = [], 0
        for kind in PACK:
            cols.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        parts.append(cols)
    ids, ties, h, digest, proof, lo = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((lo, ties, ids, proof, digest, h))
    ids, ties, lo, h, digest, proof = (c[order] for c in (ids, ties, lo, h, digest, proof))
    later = _later((h, digest, proof), (ids, ties, lo))
    return _merged(ids[later], ties[later], lo[later].astype(np.int64))


class Suffixes:
    """The 100-byte strings that start at ``place`` in ``data``, sorted by hash and verified by bytes."""

    def __init__(self, data: np.ndarray, place: np.ndarray, key: int):
        self.data, self.place, self.roll = data, place, Rolling(data, key | 1)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.eight = np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))

    def lane(self, i: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k + 7 of suffixes i as one number; what goes beyond the string is cut off."""
        x = self.eight[self.place[i] + 8 * k].astype(np.uint64)
        return x >> np.uint64(8 * max(0, 8 * (k + 1) - SPAN))

    def compared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the bytes of string i are less than, equal to or greater than those of j."""
        out, open_ = np.zeros(len(i), np.int8), np.arange(len(i))
        for k in range(-(-SPAN // 8)):
            a, b = self.lane(i[open_], k), self.lane(j[open_], k)
            out[open_] = (a > b).astype(np.int8) - (a < b).astype(np.int8)
            open_ = open_[a == b]
        return out

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes i and j, 100 at most, by binary search over equal hashes."""
        a, b = self.place[i], self.place[j]
        least, most = np.zeros(len(a), np.int64), np.full(len(a), SPAN)
        while (least < most).any():
            mid = (least + most + 1) // 2
            same = self.roll.of(a, a + mid) == self.roll.of(b, b + mid)
            least, most = np.where(same, mid, least), np.where(same, most, mid - 1)
        return least

    def less(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.extension(i, j)
        whole = n == SPAN
        n = np.minimum(n, SPAN - 1)
        return np.where(whole, or_equal, self.data[self.place[i] + n] < self.data[self.place[j] + n])

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Mergesort within groups (``group`` is sorted), all groups at once. Each level doubles the sorted runs: an element's
        new rank is its own plus its rank in the partner run, found by binary search."""
        n = len(group)
        at = _runs(group)
        begin, size = np.repeat(at[:-1], np.diff(at)), np.repeat(np.diff(at), np.diff(at))
        order = np.arange(n)
        width = 1
        while n and width < size.max():
            slot = np.flatnonzero(size > width)
            r = slot - begin[slot]
            run = r // width
            other = begin[slot] + (run ^ 1) * width
            end = np.minimum(other + width, begin[slot] + size[slot])
            real = other < begin[slot] + size[slot]
            slot, r, run, other, end = slot[real], r[real], run[real], other[real], end[real]
            item, lo, hi = order[slot], other.copy(), end.copy()
            right = run % 2 == 1
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) // 2
                ahead = self.less(order[mid], item[open_], right[open_])
                lo[open_] = np.where(ahead, mid + 1, lo[open_])
                hi[open_] = np.where(ahead, hi[open_], mid)
            moved = order.copy()
            moved[begin[slot] + (run // 2) * 2 * width + (r - run * width) + (lo - other)] = item
            order = moved
            width *= 2
        return order

    def verified(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of ``sort`` and whether each string equals the one before it in its group, by bytes. Where hashes have
        misled the sort, the group is sorted by bytes."""
        order = self.sort(group)
        misled = group[np.bincount(order, minlength=len(order)) != 1]  # a merge by contradictory hashes loses strings
        for _ in range(2):
            if len(misled):
                slot = np.flatnonzero(np.isin(group, misled))
                order[slot] = slot[np.lexsort([*(self.lane(slot, k) for k in reversed(range(-(-SPAN // 8)))), group[slot]])]
            one, two = order[:-1], order[1:]
            within = group[one] == group[two]
            by_bytes = self.compared(one, two)
            misled = group[one][within & (by_bytes > 0)]
            if not len(misled):
                break
        return order, within & (by_bytes == 0)


def repeats_among(h: np.ndarray, ids: np.ndarray, ties: np.ndarray, lo: np.ndarray, reach: np.ndarray, texts: list, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(context, start) of the strings that an earlier equal one in the same bucket precedes."""
    size = np.array([len(t) for t in texts]) - SPAN + 1
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.concatenate([[0], np.cumsum(size + SPAN - 1)[:-1]])
    context = np.repeat(np.arange(len(texts)), size)
    step = np.arange(len(context)) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    depth = reach[context] - step
    order = np.lexsort((depth, h[context]))
    context, step, depth = context[order], step[order], depth[order]
    group = np.repeat(np.arange(len(at := _runs(h[context], depth)) - 1), np.diff(at))
    order, same = Suffixes(data, begin[context] + step, key).verified(group)
    run = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
    c, p = context[order], lo[context[order]] + step[order]
    by = np.lexsort((p, ties[c], ids[c], run))
    later = _later((run[by],), (ids[c][by], ties[c][by], p[by]))
    return c[by][later], p[by][later]


REPEATS = "id long, tie long, lo binary, hi binary"


def _repeat_batch(spans: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    """Rows of REPEATS, one a document."""
    ids, ties, lo, hi = (np.array(c, np.int64) for c in (zip(*spans, strict=True) if spans else [()] * 4))
    order = np.lexsort((lo, ties, ids))
    at = _runs(ids[order], ties[order])
    out = [(int(ids[k[0]]), int(ties[k[0]]), lo[k].astype(np.int32).tobytes(), hi[k].astype(np.int32).tobytes()) for k in (order[a:b] for a, b in zip(at[:-1], at[1:], strict=True))]
    cols = list(zip(*out, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["id", "tie", "lo", "hi"])


def edge_sorter(key: int) -> Callable:
    return lambda batches: sort_edges(batches, key)


def sort_edges(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hash, whole buckets at a time, in pieces of bounded size."""
    kept: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        known = [(i, t, a, a + n) for k, i, t, a, n in zip(*[batch.column(c).to_pylist() for c in ("kind", "id", "tie", "lo", "reach")], strict=True) if k == KNOWN]
        if known:
            yield _repeat_batch(known)
        kept.append(batch)
        held += int(_weights(batch).sum())
        if held > PIECE_SUFFIXES:
            t = pa.Table.from_batches(kept)
            h = arrays(t, "hash")[0]
            last = int(_runs(h)[-2])  # the last bucket may go on
            for a, b in _pieces(h[:last], _weights(t)[:last]):
                yield _settle(t.slice(a, b - a), key)
            t = t.slice(last)
            kept, held = t.to_batches(), int(_weights(t).sum())
    if held:
        t = pa.Table.from_batches(kept)
        for a, b in _pieces(arrays(t, "hash")[0], _weights(t)):
            yield _settle(t.slice(a, b - a), key)


def _settle(t: pa.Table, key: int) -> pa.RecordBatch:
    """Repeats among the rows of whole buckets."""
    kind = arrays(t, "kind")[0]
    spans = []
    if (kind == STRINGS).any():
        packs = t.filter(pa.array(kind == STRINGS))
        # Strings of several buckets don't meet by their digests, so they go together.
        spans += repeats_of_strings(list(zip(packs.column("lo").to_pylist(), packs.column("bytes").to_pylist(), strict=True)))
    if (kind == CONTEXT).any():
        t = t.filter(pa.array(kind == CONTEXT))
        h, ids, ties, lo, reach = arrays(t, "hash", "id", "tie", "lo", "reach")
        c, p = repeats_among(h, ids, ties, lo, reach, t.column("bytes").to_pylist(), key)
        spans += _merged(ids[c], ties[c], p)
    return _repeat_batch(spans)


def _weights(t) -> np.ndarray:
    """Suffixes, about, in each row."""
    kind, n = arrays(t, "kind", "lo")
    return np.where(kind == STRINGS, n, np.where(kind == CONTEXT, KEEP_FROM // 2, 1))


def _pieces(h: np.ndarray, weight: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole buckets of about PIECE_SUFFIXES suffixes."""
    at, total = _runs(h), np.concatenate([[0], np.cumsum(weight)])
    a = 0
    while a < len(h):
        fits = int(np.searchsorted(total, total[a] + PIECE_SUFFIXES, "right")) - 1
        b = int(at[max(np.searchsorted(at, fits, "right") - 1, np.searchsorted(at, a, "right"))])
        yield a, b
        a = b


def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their repeats: what is removed, and what is left."""
    for batch in batches:
        for base, data, offsets in text_chunks(batch.column(2)):
            out = []
            for r in range(len(offsets) - 1):
                text = data[offsets[r] : offsets[r + 1]]
                own = batch.column(3)[base + r].as_py()
                if not own:
                    out.append((len(text), 0, 0, text.tobytes()))
                    continue
                lo, hi = (np.concatenate([np.frombuffer(s[k], np.int32) for s in own]) for k in ("lo", "hi"))
                change = np.bincount(lo, minlength=len(text) + 1) - np.bincount(hi, minlength=len(text) + 1)
                gone = np.cumsum(change)[: len(text)] > 0
                edges = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
                out.append((len(text), int(gone.sum()), edges, text[~gone].tobytes()))
            n, removed, count, left = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(4).slice(base, len(n)), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in left]), pa.array(left, pa.binary())],
                ["__id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def suffix_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", most_contexts: int = MOST_CONTEXTS, bucket_anchors: int = BUCKET_ANCHORS) -> DataFrame:
    """(``id``, n_bytes, n_removed, n_spans, kept_sha256, kept) per row; ``kept`` is what is left, as bytes. Ids are integers."""
    kind, hidden = docs.schema[id].dataType.simpleString(), secret()
    own = to_python(docs).select(F.coalesce(F.col(id).cast("long"), F.lit(-(1 << 63))).alias("key"), F.xxhash64(text).alias("check"), F.col(text).alias("text"), F.col(id).alias("__id"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-total * 2 // (KEEP_FROM + 1) // bucket_anchors))
    blocks = own.select("key", "check", "text").mapInArrow(block_maker(buckets, hidden), BLOCK)
    found = kept_table(blocks.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(class_maker(most_contexts), REMOVED))
    listed = lambda df, *more: df.groupBy("id", "tie").agg(F.collect_list(F.struct("lo", "hi", *more)).alias("spans"))
    same_document = (F.col("key") == F.col("id")) & (F.col("check") == F.col("tie"))
    hot = found.where("hot").agg(F.sum(F.length("hash") / 8)).first()[0] or 0
    string_buckets = math.ceil(hot * KEEP_FROM / PIECE_SUFFIXES) or 1
    edges = listed(found.where("length(hash) > 0"), "hash", "reach", "hot")
    # The same columns as in the last join, so that Spark shuffles the texts once for both.
    contexts = own.join(edges, same_document).select("key", "check", "text", "spans", "__id").mapInArrow(edge_maker(string_buckets, hidden), EDGES)
    sorted_edges = contexts.repartition("hash").sortWithinPartitions("hash").mapInArrow(edge_sorter(hidden), REPEATS)
    repeats = found.where("length(hash) = 0").select("id", "tie", "lo", "hi").unionByName(sorted_edges)
    return (
        own.join(listed(repeats), same_document, "left").select("key", "check", "text", "spans", "__id")
        .mapInArrow(cleaned, f"__id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
        .withColumnRenamed("__id", id)
    )

"""Helpers that several operators share: recovery points, Arrow text access and vectorised hashing."""

from __future__ import annotations

import secrets
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import checkpointed as cut  # noqa: F401
from ..sources.store import shared_folder as shared_dir  # noqa: F401

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of text that one vectorised step handles; a longer document is a step of its own.
CHUNK_BYTES = 1 << 20


#: Rows of text in one Arrow batch, unless the session says otherwise: Spark's default of 10,000 holds hundreds of MB of long
#: texts in the JVM and in Python at once.
BATCH_ROWS = 1000


def to_python(docs: DataFrame) -> DataFrame:
    """``docs``, on its way to Python. Spark bounds a batch by bytes (64 MB unless the session says otherwise); its rows are
    bounded here, for the whole session, if that has Spark's default. A plan can't carry the setting itself."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if docs.sparkSession.conf.get(key) == "10000":
        docs.sparkSession.conf.set(key, str(BATCH_ROWS))
    return docs


#: Rows of a few numbers or short names that are sent to every executor; what has more is joined by shuffle.
MOST_BROADCAST = 200_000


def sent_if_small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df`` marked for broadcast after its rows have been counted, or as it is. Give a table that is cheap to read twice."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Rows of a few numbers that one partition of a small table holds.
PARTITION_ROWS = 100_000


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """A recovery point of a table that is known to have ``most_rows`` rows at most, in as few partitions as those need: walks
    take many steps over such tables, and each would write files for every partition."""
    return cut(df.coalesce(1 + most_rows // PARTITION_ROWS))


def kept_table(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: a recovery point for large tables, since Parquet is
    compressed and a checkpoint isn't."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def secret() -> int:
    """A key for one call's hashes. Results don't depend on it; texts that collide under it can't be made beforehand."""
    return secrets.randbits(64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums and minima of its values behave as random."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        while len(_powers) > 2:  # a worker serves many calls, each with a base of its own
            _powers.pop(next(iter(_powers)))
        n = max(n, CHUNK_BYTES + 4096)
        both = []
        for b in (base & MASK, pow(base, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _powers[base] = (both[0], both[1])
    return have[0][:n], have[1][:n]


class Rolling:
    """Prefix polynomial hashes of a sequence: the hash of any run of it in constant time."""

    def __init__(self, values: np.ndarray, base: int = BASE):
        n = len(values)
        up, self.down = powers(n + 1, base)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.down[start]


def text_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 bytes, offsets) of runs of rows of about CHUNK_BYTES; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_table(separators: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(separators)] = True
    return out


def lower_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


#: Space, tab, line feed, vertical tab, form feed and carriage return part words.
BLANKS = word_table(b" \t\n\x0b\x0c\r")
LOWER = lower_table()


def words(data: np.ndarray, offsets: np.ndarray, parting: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; words don't cross rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~parting[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


_LANES = 32
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int) -> np.ndarray:
    """Keyed 64-bit hash of each word: its bytes are mixed in eight at a time, one step after the other, from a state that
    only the key's holder knows. Words over 256 bytes are digested one by one."""
    size = end - start
    keyed = (key * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & MASK
    h = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(key & MASK))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    at = np.flatnonzero(size <= 8 * _LANES)
    left = size[at]
    for lane in range(_LANES):
        if not len(at):
            break
        h[at] = mix((h[at] ^ (eight[start[at] + 8 * lane] & _MASKS[np.minimum(left, 8)])) + np.uint64(keyed))
        more = left > 8
        at, left = at[more], left[more] - 8
    secret_key = (key & MASK).to_bytes(8, "little")
    for i in np.flatnonzero(size > 8 * _LANES).tolist():
        h[i] = int.from_bytes(blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=secret_key).digest(), "little")
    return h


def arrays(batch_or_table, *names: str) -> list[np.ndarray]:
    """Number columns as arrays."""
    out = []
    for n in names:
        c = batch_or_table.column(n)
        out.append((c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).to_numpy(zero_copy_only=False))
    return out


def as_signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)

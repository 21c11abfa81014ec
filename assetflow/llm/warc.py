"""WARC records in ZIP packages, written and read on the executors.

A package is a ZIP file with stored members: ``archive/*.warc`` with the records and ``indexes/*.cdxj`` with one line of
place and length for each. The reader asks the file system for ranges only: the end of the package, its central directory
(ZIP64 where sizes or counts ask for it), the index member, and then the records themselves, neighbours together. Nothing
is extracted. Packages live in a folder that all executors share, by any file system that pyarrow opens.

Scale: payload groups are settled on digests and ids; payloads are written where they are read. A task writes packages of
bounded size. For reading, the packages' bytes decide on the number of tasks: runs of neighbouring records, ``READ_BYTES``
long, are dealt to them one by one, so one package is read by many tasks and a small one by few.

Defined results: a null html is an empty payload; one of any size is one record, which is a run and, beyond
``package_bytes``, a package of its own; of equal payloads of ``least`` bytes or more the largest id's rows are responses,
the others revisits; if all ids of such a group are null, all are responses; repeated rows are records each; an empty table
gives an empty table; line breaks in a url are escaped; other columns of ``pages``, whatever their names, are neither
written nor returned. The packages stay in their folder, which is the caller's to delete: the result reads them when it runs.
"""

from __future__ import annotations

import json
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sent_if_small, shared_dir, to_python

LEAST_REVISIT = 1000
PACKAGE_BYTES = 128 << 20
#: Bytes of neighbouring records that are read at once, and of all that one task reads, about.
READ_BYTES = 4 << 20
TASK_BYTES = 32 << 20


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


# ---- records


def record(page: str | None, url: str | None, kind: str, digest: str, refers: str | None, payload: bytes, size: int) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record, with its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record at this place")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record doesn't end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {"page": fields.get("X-Page-ID"), "type": fields["WARC-Type"], "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers": fields.get("X-Refers-To-Page-ID"), "size": size, "payload": payload}


# ---- packages


def _write_package(system: fs.FileSystem, path: str, records: list[bytes]) -> int:
    lines, at = [], 0
    for r in records:
        lines.append(json.dumps({"offset": at, "length": len(r)}))
        at += len(r)
    with system.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo("archive/data.warc"), "w", force_zip64=True) as m:
            for r in records:
                m.write(r)
        z.writestr(zipfile.ZipInfo("indexes/data.cdxj"), "\n".join(lines))
    return len(records)


def writer(folder: str, package_bytes: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        context = TaskContext.get()
        held: list[bytes] = []
        size, number, made = 0, 0, []

        def close() -> None:
            nonlocal held, size, number
            # A task that is tried again writes names of its own; only what the task that ended lists is read.
            name = f"{base}/part-{context.partitionId():05d}-{context.taskAttemptId()}-{number}.zip"
            made.append((f"{folder}/{name.rpartition('/')[2]}", _write_package(system, name, held), size))
            held, size, number = [], 0, number + 1

        for batch in batches:
            for page, url, digest, kind, refers, n, html in zip(*[batch.column(i) for i in range(7)], strict=True):
                payload = bytes(html.as_buffer()) if html.is_valid and kind.as_py() == "response" else b""
                held.append(record(page.as_py(), url.as_py(), kind.as_py(), digest.as_py(), refers.as_py(), payload, n.as_py()))
                size += len(held[-1])
                if size >= package_bytes:
                    close()
        if held:
            close()
        paths, counts, sizes = zip(*made, strict=True) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    return write


def directory(read: Callable[[int, int], bytes], size: int) -> list[dict]:
    """Members of a ZIP file from its central directory; ``read(offset, length)`` gives a range of it."""
    tail_at = max(0, size - (1 << 16) - 22)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of a ZIP directory")
    count, length, offset = struct.unpack("<10xHII", tail[end : end + 20])
    if count == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        locator = read(tail_at + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        (at,) = struct.unpack("<8xQ4x", locator)
        wide = read(at, 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 directory end")
        count, length, offset = struct.unpack("<32xQQQ", wide)
    raw, at, out = read(offset, length), 0, []
    for _ in range(count):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("a ZIP directory entry is broken")
        flags, method, packed, plain, n, extra, comment, place = struct.unpack("<8xHH8xIIHHH8xI", raw[at : at + 46])
        name = raw[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        fields = raw[at + 46 + n : at + 46 + n + extra]
        while len(fields) >= 4:
            tag, m = struct.unpack("<HH", fields[:4])
            if tag == 1:  # ZIP64: only the values that didn't fit, in this order
                wide = list(struct.unpack(f"<{m // 8}Q", fields[4 : 4 + m // 8 * 8]))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                place = wide.pop(0) if place == 0xFFFFFFFF else place
            fields = fields[4 + m :]
        out.append({"name": name, "method": method, "size": plain, "packed": packed, "offset": place})
        at += 46 + n + extra + comment
    return out


def data_start(read: Callable[[int, int], bytes], member: dict) -> int:
    """Where a stored member's bytes begin, behind its local header."""
    if member["method"] != 0 or member["packed"] != member["size"]:
        raise ValueError(f"{member['name']} isn't stored")
    local = read(member["offset"], 30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    name, extra = struct.unpack("<26xHH", local)
    return member["offset"] + 30 + name + extra


def _ranges(path: str) -> tuple[Callable[[int, int], bytes], int, pa.NativeFile]:
    system, name = opened(path)
    file = system.open_input_file(name)
    return (lambda at, n: file.read_at(n, at)), file.size(), file


def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per package: runs of neighbouring records, READ_BYTES or one record long."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            read, size, file = _ranges(path)
            with file:
                members = {m["name"]: m for m in directory(read, size)}
                out = []
                for name, index in members.items():
                    if not name.startswith("indexes/"):
                        continue
                    archive = members["archive/" + name.removeprefix("indexes/").removesuffix(".cdxj") + ".warc"]
                    base = data_start(read, archive)
                    lines = read(data_start(read, index), index["size"]).decode().split("\n")
                    start, lengths, held = base, [], 0
                    for x in map(json.loads, filter(None, lines)):
                        if lengths and held + x["length"] > READ_BYTES:
                            out.append((path, start, lengths))
                            start, lengths, held = base + x["offset"], [], 0
                        lengths.append(x["length"])
                        held += x["length"]
                    if lengths:
                        out.append((path, start, lengths))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["path", "start", "lengths"])


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("page", "type", "digest", "refers", "size", "payload")
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
    for batch in batches:
        for path, start, lengths in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            read, _, file = _ranges(path)
            with file:
                raw = read(start, sum(lengths))
            out, at = [], 0
            for n in lengths:
                out.append(parse(raw[at : at + n]))
                at += n
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in zip(names, kinds, strict=True)], list(names))


def write_packages(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes a record for each row and returns (path, records, bytes) of the packages."""
    own = to_python(pages).select(F.col(id).alias("__id"), F.col(url).cast("string").alias("__url"), F.coalesce(F.col(html), F.lit("")).alias("__html"))
    own = own.withColumn("__digest", F.sha1("__html")).withColumn("__n", F.octet_length("__html").cast("long"))
    groups = cut(own.where(F.col("__n") >= least).groupBy("__digest").agg(F.count("*").alias("k"), F.max("__id").alias("__first")).where("k > 1 AND __first IS NOT NULL").select(F.col("__digest").alias("__of"), "__first"))
    known = sent_if_small(groups)
    revisit = F.col("__first").isNotNull() & ~F.col("__id").eqNullSafe(F.col("__first"))
    rows = own.join(known, F.col("__digest") == F.col("__of"), "left").select(
        F.col("__id").cast("string").alias("page"), "__url", "__digest", F.when(revisit, "revisit").otherwise("response").alias("type"),
        F.when(revisit, F.col("__first").cast("string")).alias("refers"), "__n", "__html",
    )
    return cut(rows.mapInArrow(writer(folder, package_bytes), "path string, records long, bytes long"))


def read_packages(packages: DataFrame) -> DataFrame:
    """(page, type, digest, refers, size, payload) of every record of the packages in ``packages`` (path, bytes)."""
    n = packages.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    least = packages.sparkSession.sparkContext.defaultParallelism
    # Explicit numbers: by size alone, lists of paths and places would all fall to one task.
    found = cut(packages.select("path").repartition(max(1, min(n["n"], 4 * least + n["n"] // 16))).mapInArrow(places, "path string, start long, lengths array<long>"))
    tasks = max(least, -(-n["bytes"] // TASK_BYTES))
    return found.repartition(tasks).mapInArrow(records, "page string, type string, digest string, refers string, size long, payload binary")


def round_trip(pages: DataFrame, id: str = "page_id") -> DataFrame:
    """Writes ``pages`` to the shared folder and reads the packages back: (``id``, payload_bytes, payload_digest, record_type,
    refers_to). A response's size and digest are taken from the payload that was read, a revisit's from its record."""
    folder = f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    back = read_packages(write_packages(pages, folder, id))
    kind = pages.schema[id].dataType
    full = F.col("type") == "response"
    return back.select(
        F.col("page").cast(kind).alias(id),
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("size")).alias("payload_bytes"),
        F.when(full, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers").cast(kind).alias("refers_to"),
    )

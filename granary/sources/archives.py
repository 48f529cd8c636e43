"""Members of archives as rows and as tasks of their own (SRC-31).

The directory of an archive is read by ranges: of a ZIP file its end, of an unpacked TAR file the headers
between the members. Then every member is a row with its place, rows are dealt over tasks, and a task
reads its members' bytes alone, in parts of bounded size. A packed TAR or GZ file has no places to begin
at: it is one row, which one task streams. Files are opened by ``pyarrow.fs``, which knows local, HDFS and
object-store paths; Spark only lists them, so no content passes through ``binaryFile``.
"""

from __future__ import annotations

import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIRECTORY = "path string, member string, kind string, offset long, packed long, length long, crc long"
PARTS = "path string, member string, part int, first_byte long, content binary"
#: Kinds of rows: stored and deflated members of ZIP files, members of TAR files, and whole packed streams.
STORED, DEFLATED, TAR, PACKED_TAR, GZ = "stored", "deflated", "tar", "packed_tar", "gz"
_ZIP = {zipfile.ZIP_STORED: STORED, zipfile.ZIP_DEFLATED: DEFLATED}


def opened(path: str) -> pa.NativeFile:
    """A seekable file of any path that Spark lists."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = unquote(path.removeprefix("file:"))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def archives(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and length of the files that are not empty; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length")


def _listed(path: str) -> Iterator[tuple]:
    with opened(path) as file:
        head = file.read(2)
        file.seek(0)
        if zipfile.is_zipfile(file):
            with zipfile.ZipFile(file) as archive:
                for i in archive.infolist():
                    if i.is_dir():
                        continue
                    if i.flag_bits & 1 or i.compress_type not in _ZIP:
                        raise ValueError(f"{path}: {i.filename} is encrypted or packed by a method other than deflate")
                    yield path, i.filename, _ZIP[i.compress_type], i.header_offset, i.compress_size, i.file_size, i.CRC
            return
        size = file.size()
        file.seek(0)
        if head == b"\x1f\x8b":
            name = path.rsplit("/", 1)[-1]
            packed = name.lower().endswith((".tgz", ".tar.gz"))
            yield path, None if packed else unquote(name.removesuffix(".gz")), PACKED_TAR if packed else GZ, 0, size, None, None
            return
        if not size:
            return
        with tarfile.open(fileobj=file, mode="r:") as archive:
            for i in archive:
                archive.members = []  # headers that have passed are not kept
                if i.isfile():
                    yield path, i.name, TAR, i.offset_data, i.size, i.size, None


def members(files: DataFrame, path: str = "path", rows: int = 4096) -> DataFrame:
    """A row of DIRECTORY for each member of the ZIP, TAR and GZ files that ``path`` names; folders and links are left out.

    Null paths and empty files have no members; a path that stands twice gives its members twice. A packed TAR file is one row
    with a null member. Encrypted members and methods other than deflate are refused.
    """
    names = [f.split()[0] for f in DIRECTORY.split(", ")]
    kinds = [pa.string()] * 3 + [pa.int64()] * 4

    def run(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                held = []
                for row in _listed(p) if p is not None else ():
                    held.append(row)
                    if len(held) == rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return files.select(F.col(path).cast("string")).mapInArrow(run, DIRECTORY)


def _ranged(file: pa.NativeFile, left: int, step: int) -> Iterator[bytes]:
    while left > 0:
        data = file.read(min(step, left))
        if not data:
            raise ValueError("the archive ends within a member")
        left -= len(data)
        yield data


def _inflated(chunks: Iterator[bytes], window: int, step: int) -> Iterator[bytes]:
    """Unpacked bytes, ``step`` at most at once; streams that follow one another (GZ) are one."""
    unpack, rest = zlib.decompressobj(window), b""
    for chunk in chunks:
        rest += chunk
        while rest:
            if unpack.eof:
                if not rest.strip(b"\0"):
                    break
                unpack = zlib.decompressobj(window)
            out = unpack.decompress(rest, step)
            rest = unpack.unconsumed_tail or unpack.unused_data
            if out:
                yield out
            elif not unpack.eof:
                break
    while not unpack.eof:
        out = unpack.decompress(rest, step)
        rest = unpack.unconsumed_tail
        if not out and not unpack.eof:
            raise ValueError("the archive ends within a member")
        yield out


def _even(chunks: Iterator[bytes], step: int) -> Iterator[bytes]:
    """The same bytes in parts of ``step``, the last one shorter; an empty member is one empty part."""
    held, sent = bytearray(), False
    for chunk in chunks:
        held += chunk
        while len(held) >= step:
            yield bytes(held[:step])
            del held[:step]
            sent = True
    if held or not sent:
        yield bytes(held)


def _checked(chunks: Iterator[bytes], crc: int | None, name: str) -> Iterator[bytes]:
    found = 0
    for chunk in chunks:
        found = zlib.crc32(chunk, found)
        yield chunk
    if crc is not None and found != crc:
        raise ValueError(f"{name}: the checksum differs")


class _Stream:
    """What ``tarfile`` reads from, over an iterator of bytes."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, b""

    def read(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n and (chunk := next(self.chunks, None)) is not None:
            parts.append(chunk)
            have += len(chunk)
        data = b"".join(parts)
        self.held = data[n:]
        return data[:n]


def _unpacked(path: str, member: str | None, kind: str, offset: int, packed: int, crc: int | None, step: int) -> Iterator[tuple[str, int, bytes]]:
    """(member, part, bytes) of a row of DIRECTORY."""
    with opened(path) as file:
        if kind in (STORED, DEFLATED):
            file.seek(offset)
            name, extra = struct.unpack("<26xHH", file.read(30))  # the local header's own lengths
            offset += 30 + name + extra
        file.seek(offset)
        raw = _ranged(file, packed, step)
        if kind == PACKED_TAR:
            with tarfile.open(fileobj=_Stream(_inflated(raw, 31, step)), mode="r|") as archive:
                for i in archive:
                    archive.members = []
                    if i.isfile():
                        inner = archive.extractfile(i)
                        yield from ((i.name, n, part) for n, part in enumerate(_even(iter(partial(inner.read, step), b""), step)))
            return
        chunks = _inflated(raw, 31 if kind == GZ else -15, step) if kind in (GZ, DEFLATED) else raw
        yield from ((member, n, part) for n, part in enumerate(_even(_checked(chunks, crc, f"{path}: {member}"), step)))


def contents(directory: DataFrame, tasks: int = 64, part_bytes: int = 8 << 20) -> DataFrame:
    """The bytes of the members in rows of PARTS: parts of ``part_bytes``, the last one shorter, with the place of their first byte.

    Rows of the directory are dealt over ``tasks`` by path and place, whatever archive they come from; filter it
    first for some members only. A task holds a few parts at a time, so neither archive nor member need fit
    its memory. ZIP members are held against their checksum. An empty member is one empty part.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for member, n, content in _unpacked(row["path"], row["member"], row["kind"], row["offset"], row["packed"], row["crc"], part_bytes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["path"]]), pa.array([member]), pa.array([n], pa.int32()), pa.array([n * part_bytes], pa.int64()), pa.array([content], pa.binary())], [f.split()[0] for f in PARTS.split(", ")]
                    )

    rows = directory.select("path", "member", "kind", "offset", "packed", "crc")
    return rows.repartition(tasks, "path", "offset").mapInArrow(run, PARTS)

"""Members of archives as rows, without unpacking: a Spark data source over zip, nested zip and tar files.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("archive").option("members", "*/train/*.jpg").load(folder)

A zip file's directory is at its end. The driver reads its last record alone (count and place), and cuts the
count into ranges; a task walks over the directory, keeps the entries of its range that are asked for, and
reads those members. With `inner`, members whose names fit it are archives themselves: a task copies one to
a temporary file of its own and reads a share of its members. A tar file has no directory and is read by
one task from front to back.

Options: members (glob on a member's name), smallest and largest (bytes; other members are not read), inner (glob;
null for none), entries (members a task, 10,000), inner_tasks (shares of an inner archive, 1), max_member_bytes (64
MiB), max_inner_bytes (4 GiB), content (true; false leaves it null). Which members are read is said by options and
not by pushed-down filters: Spark 4.1 keeps the filters that a Python source has taken for later queries on the
same DataFrame, which would then lack rows.

Files are reached through pyarrow.fs, by local paths or URIs. Directories, links and devices are not members.
Absolute names and those with empty, "." or ".." parts or back slashes, members that are larger than
allowed or than they say, encrypted ones, unknown compression and wrong checksums are errors that name the
archive and the member. Names may repeat. A folder without archives reads as no rows.
"""

from __future__ import annotations

import struct
import tarfile
import tempfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, inner string, name string, size long, crc32 long, content binary"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a local path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Entry:
    name: str
    method: int
    flags: int
    crc: int
    packed: int
    size: int
    header: int
    folder: bool


def directory_of(source: BinaryIO, size: int, path: str) -> tuple[int, int]:
    """(entries, place) of a zip file's directory, from the record at its end."""
    lo = max(0, size - (1 << 16) - 22)
    source.seek(lo)
    tail = source.read(size - lo)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
        at = tail.rfind(b"PK\5\6", 0, at)  # within the comment
    if at < 0:
        raise ValueError(f"{path} is no zip file")
    count, _, place = struct.unpack("<HII", tail[at + 10 : at + 20])
    if count == 0xFFFF or place == 0xFFFFFFFF:
        source.seek(lo + at - 20)
        signature, _, record, _ = struct.unpack("<IIQI", source.read(20))
        if signature != 0x07064B50:
            raise ValueError(f"{path}: the directory's place is missing")
        source.seek(record)
        told = struct.unpack("<IQHHIIQQQQ", source.read(56))
        count, place = told[7], told[9]
    return count, place


def entries(source: BinaryIO, place: int, first: int, last: int, path: str) -> Iterator[Entry]:
    """Entries of a directory from number first up to last."""
    source.seek(place)
    held = b""

    def take(n: int) -> bytes:
        nonlocal held
        while len(held) < n:
            more = source.read(1 << 20)
            if not more:
                raise ValueError(f"{path}: the directory ends early")
            held += more
        out, held = held[:n], held[n:]
        return out

    for k in range(last):
        fixed = struct.unpack("<IHHHHHHIIIHHHHHII", take(46))
        if fixed[0] != 0x02014B50:
            raise ValueError(f"{path}: entry {k} of the directory is damaged")
        raw, extra, _ = take(fixed[10]), take(fixed[11]), take(fixed[12])
        if k < first:
            continue
        name = raw.decode("utf-8" if fixed[3] & 0x800 else "cp437")
        packed, size, header = fixed[8], fixed[9], fixed[16]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:
                wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                size = wide.pop(0) if size == 0xFFFFFFFF else size
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        mode = fixed[15] >> 28 if fixed[1] >> 8 == 3 else 8
        yield Entry(name, fixed[4], fixed[3], fixed[7], packed, size, header, name.endswith("/") or mode not in (0, 8))


def checked(name: str, path: str) -> str:
    if name.startswith("/") or "\\" in name or any(p in ("", ".", "..") for p in name.split("/")):
        raise ValueError(f"{path}: unsafe member name {name!r}")
    return name


def member_pieces(source: BinaryIO, entry: Entry, path: str, most: int) -> Iterator[bytes]:
    """A member's content in pieces, with its size and checksum held against the directory."""
    if entry.size > most:
        raise ValueError(f"{path}: member {entry.name!r} has {entry.size} bytes, more than {most}")
    if entry.flags & 1 or entry.method not in (0, 8):
        raise ValueError(f"{path}: member {entry.name!r} is encrypted or of unknown compression")
    source.seek(entry.header)
    head = struct.unpack("<IHHHHHIIIHH", source.read(30))
    if head[0] != 0x04034B50:
        raise ValueError(f"{path}: member {entry.name!r} is not where the directory says")
    source.seek(entry.header + 30 + head[9] + head[10])
    left, crc, size = entry.packed, 0, 0
    inflate = zlib.decompressobj(-15) if entry.method == 8 else None
    while left:
        piece = source.read(min(left, 1 << 20))
        if not piece:
            raise ValueError(f"{path}: member {entry.name!r} ends early")
        left -= len(piece)
        while piece:
            try:
                out = inflate.decompress(piece, 1 << 22) if inflate else piece
            except zlib.error as e:
                raise ValueError(f"{path}: member {entry.name!r}: {e}") from e
            piece = inflate.unconsumed_tail if inflate else b""
            crc, size = zlib.crc32(out, crc), size + len(out)
            if size > entry.size:
                raise ValueError(f"{path}: member {entry.name!r} is larger than it says")
            yield out
    if size != entry.size or crc != entry.crc or (inflate and not inflate.eof):
        raise ValueError(f"{path}: member {entry.name!r} does not have its size and checksum")


@dataclass
class Share(InputPartition):
    """Entries first to last of an archive; of an inner one with `container`, share k of n."""

    path: str
    kind: str
    first: int = 0
    last: int = 0
    container: Entry | None = None
    k: int = 0
    n: int = 1


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.form = options["path"], schema
        self.members, self.inner = options.get("members", "*"), options.get("inner")
        number = lambda k, d: int(options.get(k, d))
        self.entries, self.inner_tasks = number("entries", 10_000), number("inner_tasks", 1)
        self.most, self.most_inner = number("max_member_bytes", 64 << 20), number("max_inner_bytes", 4 << 30)
        self.content = options.get("content", "true").lower() == "true"
        self.smallest = number("smallest", 0)
        self.largest = number("largest", 0) if "largest" in options else None

    def wanted(self, name: str, size: int) -> bool:
        """Whether a member is to be read."""
        return fnmatchcase(name, self.members) and self.smallest <= size and (self.largest is None or size <= self.largest)

    def partitions(self) -> list[Share]:
        system, path = opened(self.path)
        found = system.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        out: list[Share] = []
        for f in sorted((f for f in files if f.is_file), key=lambda f: f.path):
            if f.base_name.endswith((".tar", ".tar.gz", ".tgz")):
                out.append(Share(f.path, "tar"))
            elif f.base_name.endswith(".zip"):
                with system.open_input_file(f.path) as source:
                    count, place = directory_of(source, f.size, f.path)
                    if self.inner is None:
                        out += [Share(f.path, "zip", k, min(k + self.entries, count)) for k in range(0, count, self.entries)]
                    else:  # containers alone are kept
                        inside = [e for e in entries(source, place, 0, count, f.path) if not e.folder and fnmatchcase(e.name, self.inner)]
                        out += [Share(f.path, "inner", container=e, k=k, n=self.inner_tasks) for e in inside for k in range(self.inner_tasks)]
        return out or [Share("", "none")]

    def read(self, partition: Share) -> Iterator[tuple]:
        if partition.kind == "none":
            return
        system, _ = opened(self.path)
        if partition.kind == "tar":
            yield from self._tar(system, partition.path)
            return
        with system.open_input_file(partition.path) as source:
            if partition.kind == "zip":
                _, place = directory_of(source, source.size(), partition.path)
                yield from self._members(source, place, partition.first, partition.last, partition.path, None)
                return
            box = partition.container
            checked(box.name, partition.path)
            with tempfile.TemporaryFile() as copy:
                for piece in member_pieces(source, box, partition.path, self.most_inner):
                    copy.write(piece)
                where = f"{partition.path}!{box.name}"
                count, place = directory_of(copy, box.size, where)
                step = -(-count // partition.n)
                yield from self._members(copy, place, step * partition.k, min(count, step * (partition.k + 1)), partition.path, box.name)

    def _members(self, source: BinaryIO, place: int, first: int, last: int, path: str, inner: str | None) -> Iterator[tuple]:
        where = path if inner is None else f"{path}!{inner}"
        chosen = [e for e in entries(source, place, first, last, where) if not e.folder and checked(e.name, where) and self.wanted(e.name, e.size)]
        for e in chosen:  # the members of one share
            yield path, inner, e.name, e.size, e.crc, b"".join(member_pieces(source, e, where, self.most)) if self.content else None

    def _tar(self, system: fs.FileSystem, path: str) -> Iterator[tuple]:
        with system.open_input_file(path) as raw, tarfile.open(fileobj=raw, mode="r|gz" if path.endswith("gz") else "r|") as archive:
            for m in archive:
                if not m.isfile() or not self.wanted(checked(m.name, path), m.size):
                    continue
                if m.size > self.most:
                    raise ValueError(f"{path}: member {m.name!r} has {m.size} bytes, more than {self.most}")
                content = archive.extractfile(m).read()
                if len(content) != m.size:
                    raise ValueError(f"{path}: member {m.name!r} ends early")
                yield path, None, m.name, m.size, zlib.crc32(content), content if self.content else None


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return ArchiveReader(dict(self.options), schema)

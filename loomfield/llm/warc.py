"""WARC archives as a Spark data source: one gzip member a record, written in parallel, read in splits.

    spark.dataSource.register(WarcSource)
    records.write.format("warc").mode("append").save(folder)
    spark.read.format("warc").option("split_bytes", 64 << 20).load(folder)

Reading. Files are cut into byte ranges, one a task. A task seeks to its range, looks for the gzip magic and
takes a place for the start of a member if what it inflates to begins with a WARC version line and a whole
block of headers; other places with these bytes are chance. From there on members follow each other, so
each end gives the next start. A task owns the records that start in its range, and reads the last of them
beyond its end. A record inside another's payload (an archive in an archive, which deflate leaves as it is)
also validates, but what follows it is the outer member's rest: a first place counts only if members follow
each other from it past the end of the range, and one begins there or the file ends. Payloads that hold
archives of their own and reach over whole ranges need ranges larger than them.

Writing. Tasks write files of whole members under names of their own in a hidden folder; the driver moves the
files of the tasks that succeeded into place when all have, so that lost or repeated tasks leave nothing behind.

Files are reached through pyarrow.fs, by local paths or URIs (file, s3, gs, hdfs). Damaged members raise an
error that names the file and the place.

Nulls, empties: a null payload is an empty one. Null and repeated ids are written as they are. An empty table
writes no file, and a folder without files reads as no rows; a folder that is not there is an error. Extra
columns of what is written are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from loomfield.llm.common import fresh, has_repeats, materialize
from loomfield.operators.ranking import with_least

#: Fixed values of the format.
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: What is written of a record; refers_to is null but for a revisit, whose payload is given for its length and digest alone.
WRITTEN = ("record_id", "uri", "date", "refers_to", "payload")
READ = (
    "record_id string, type string, uri string, date string, refers_to string, payload_digest string, "
    "payload_length long, payload binary, file string, offset long"
)


def _at(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def sha1_label(digest: bytes) -> str:
    """A digest as archives label it."""
    return "sha1:" + base64.b32encode(digest).decode()


def member(record_id: str | None, uri: str | None, date: str | None, refers_to: str | None, payload: bytes) -> bytes:
    """One record as a gzip member: an HTTP response, or a revisit of one with its headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{record_id or ''}>")]
    fields += [("WARC-Target-URI", uri)] if uri is not None else []
    fields += [("WARC-Date", date)] if date is not None else []
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", SAME_PAYLOAD)]
    fields += [("WARC-Payload-Digest", sha1_label(hashlib.sha1(payload).digest())), ("Content-Type", "application/http; msgtype=response")]
    fields += [("Content-Length", str(len(block)))]
    # A line end in a value would end its header.
    head = "WARC/1.1\r\n" + "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields) + "\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(head.encode() + block + b"\r\n\r\n") + deflate.flush()


def _headers(block: bytes) -> dict[str, str]:
    """Fields of a block of headers by lower-case name, lines that go on joined."""
    out: dict[str, str] = {}
    last = None
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def _bare(uri: str | None) -> str | None:
    return None if uri is None else uri.removeprefix("<").removesuffix(">")


def parsed(data: bytes, file: str, offset: int) -> Iterator[tuple]:
    """Rows of the records in one inflated member (one, as a rule). A response's payload is held against its
    digest."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(VERSION, at) or end < 0:
            raise ValueError(f"{file} at {offset}: no WARC record in the member at {at}")
        head = _headers(data[at:end])
        size = int(head.get("content-length", -1))
        block = data[end + 4 : end + 4 + size]
        if size < 0 or len(block) < size:
            raise ValueError(f"{file} at {offset}: the record is shorter than it says")
        at = end + 4 + size
        at += 4 if data.startswith(b"\r\n\r\n", at) else 0
        kind, payload, length = head.get("warc-type"), block, len(block)
        if "application/http" in head.get("content-type", ""):
            http_end = block.find(b"\r\n\r\n")
            if http_end < 0:
                raise ValueError(f"{file} at {offset}: the HTTP headers do not end")
            payload = block[http_end + 4 :]
            length = len(payload)
            if kind == "revisit":
                length = int(_headers(block[:http_end]).get("content-length", length))
        said = head.get("warc-payload-digest")
        if kind == "response" and said and said.startswith("sha1:") and said != sha1_label(hashlib.sha1(payload).digest()):
            raise ValueError(f"{file} at {offset}: the payload does not have its digest")
        yield (
            _bare(head.get("warc-record-id")), kind, head.get("warc-target-uri"), head.get("warc-date"), _bare(head.get("warc-refers-to")),
            said, length, None if kind == "revisit" else payload, file, offset,
        )


class Members:
    """Gzip members of an open file, which is read step bytes at once and inflated piece bytes at once."""

    def __init__(self, source, size: int, name: str, step: int = 1 << 20, piece: int = 1 << 14):
        self.source, self.size, self.name, self.step, self.piece = source, size, name, step, piece
        self.held_at, self.held = 0, b""

    def _from(self, at: int) -> Iterator[bytes]:
        while at < self.size:
            if not self.held_at <= at < self.held_at + len(self.held):
                self.source.seek(at)
                self.held_at, self.held = at, self.source.read(min(self.step, self.size - at))
                if not self.held:
                    return
            piece = self.held[at - self.held_at : at - self.held_at + self.piece]
            yield piece
            at += len(piece)

    def starts(self, lo: int, hi: int) -> Iterator[int]:
        """Places of the magic from lo on that begin before hi."""
        at = lo
        while at < hi:
            self.source.seek(at)
            piece = self.source.read(min(self.step, hi - at) + len(MAGIC) - 1)
            k = piece.find(MAGIC)
            while k >= 0:
                yield at + k
                k = piece.find(MAGIC, k + 1)
            at += self.step

    def valid(self, at: int) -> bool:
        """Whether a member with WARC headers begins at a place."""
        inflate, head = zlib.decompressobj(31), b""
        try:
            for piece in self._from(at):
                while piece:
                    head += inflate.decompress(piece, 1 << 12)
                    piece = inflate.unconsumed_tail
                    if not head.startswith(VERSION[: len(head)]) or len(head) > 1 << 20:
                        return False
                    if b"\r\n\r\n" in head and len(head) >= len(VERSION):
                        return True
                if inflate.eof:
                    return False
        except zlib.error:
            pass
        return False

    def inflated(self, at: int, keep: bool = True) -> tuple[bytes, int]:
        """The member at a place (nothing of it unless keep), and where it ends."""
        inflate, parts, read = zlib.decompressobj(31), [], at
        try:
            for piece in self._from(at):
                read += len(piece)
                part = inflate.decompress(piece)
                if keep:
                    parts.append(part)
                if inflate.eof:
                    return b"".join(parts), read - len(inflate.unused_data)
        except zlib.error as e:
            raise ValueError(f"{self.name} at {at}: {e}") from e
        raise ValueError(f"{self.name} at {at}: the member does not end")

    def padded(self, at: int) -> int:
        """at, or where zeros that fill up the file end."""
        for piece in self._from(at):
            left = piece.lstrip(b"\0")
            if left:
                return at + len(piece) - len(left)
            at += len(piece)
        return at

    def leads_on(self, at: int, hi: int) -> bool:
        """Whether members follow each other from a place to hi or to the file's end."""
        while at < hi:
            try:
                _, at = self.inflated(at, keep=False)
            except ValueError:
                return False
            at = self.padded(at)
            if at < self.size and not self.valid(at):
                return False
        return True

    def owned(self, lo: int, hi: int) -> Iterator[tuple[int, bytes]]:
        """(place, content) of the members that start in [lo, hi)."""
        at = next((k for k in self.starts(lo, hi) if self.valid(k) and (k == 0 or self.leads_on(k, hi))), hi)
        while at < min(hi, self.size):
            data, end = self.inflated(at)
            yield at, data
            at = self.padded(end)
            if at < min(hi, self.size) and not self.valid(at):
                raise ValueError(f"{self.name} at {at}: no member where one should begin")


@dataclass
class ByteRange(InputPartition):
    path: str
    lo: int
    hi: int
    size: int


class WarcReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, schema: T.StructType):
        self.path, self.split_bytes, self.form = path, split_bytes, schema

    def partitions(self) -> list[ByteRange]:
        system, path = _at(self.path)
        found = system.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.is_file else system.get_file_info(fs.FileSelector(path))
        files = sorted((f for f in files if f.is_file and f.size and f.base_name.endswith(".gz")), key=lambda f: f.path)
        cut = lambda f: range(0, f.size, self.split_bytes)
        return [ByteRange(f.path, lo, min(lo + self.split_bytes, f.size), f.size) for f in files for lo in cut(f)] or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.size:
            return
        form, rows, held = to_arrow_schema(self.form), [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), form, strict=True)], schema=form)
        with _at(self.path)[0].open_input_file(partition.path) as source:
            members = Members(source, partition.size, partition.path)
            for offset, data in members.owned(partition.lo, partition.hi):
                for row in parsed(data, partition.path, offset):
                    rows.append(row)
                    held += len(row[7] or b"")
                if len(rows) >= 1000 or held >= 16 << 20:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, file_bytes: int, overwrite: bool):
        self.path, self.file_bytes, self.overwrite, self.job = path, file_bytes, overwrite, uuid.uuid4().hex

    def _hidden(self, path: str) -> str:
        return f"{path}/_pending-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = _at(self.path)
        sink, files, size = None, [], 0
        for batch in iterator:
            for row in zip(*(batch.column(batch.schema.get_field_index(n)) for n in WRITTEN), strict=True):
                if sink is None or size >= self.file_bytes:
                    if sink is not None:
                        sink.close()
                    system.create_dir(self._hidden(path), recursive=True)
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    sink, size = system.open_output_stream(f"{self._hidden(path)}/{files[-1]}", compression=None), 0
                *told, payload = (x.as_py() for x in row)
                data = member(*told, payload or b"")
                sink.write(data)
                size += len(data)
        if sink is not None:
            sink.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _at(self.path)
        system.create_dir(path, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(path)):
                if f.is_file and f.base_name.endswith(".warc.gz"):
                    system.delete_file(f.path)
        for message in messages:
            for name in message.files if message else []:
                system.move(f"{self._hidden(path)}/{name}", f"{path}/{name}")
        self._clear(system, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_at(self.path))

    def _clear(self, system: fs.FileSystem, path: str) -> None:
        if system.get_file_info(self._hidden(path)).type == fs.FileType.Directory:
            system.delete_dir(self._hidden(path))


class WarcSource(DataSource):
    """Options: path; split_bytes (64 MiB) of reading; file_bytes (256 MiB, about) of writing."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(self.options["path"], int(self.options.get("split_bytes", 64 << 20)), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        if missing := set(WRITTEN) - set(schema.names):
            raise ValueError(f"records to write lack {sorted(missing)}")
        return WarcWriter(self.options["path"], int(self.options.get("file_bytes", 256 << 20)), overwrite)


def with_revisits(records: DataFrame, rank: str, least_bytes: int = 1000) -> DataFrame:
    """records(record_id, payload, ...) with refers_to: of records with equal payloads of least_bytes or
    more, the one with the largest rank stays as it is (of ties the one with the larger record_id, and of equal
    rows any one), and the others refer to it. Payloads are told apart by SHA-256, and copies of one may be
    most rows: they are dealt over salts. Rows are told apart by record_id, or, where it is null or repeats,
    by a stored number of their own."""
    own, top, key, row = fresh(records, "own", "top", "key", "row")
    if has_repeats(records, "record_id"):
        rows = materialize(records.withColumn(row, F.monotonically_increasing_id()), "records")
    else:
        rows = records.withColumn(row, F.col("record_id"))
    rows = rows.withColumn(key, F.sha2("payload", 256))
    rows = rows.withColumn(own, F.struct(F.col(rank).alias("rank"), F.col("record_id").alias("id"), F.col(row).alias("row")))
    long = F.length("payload") >= least_bytes
    found = with_least(rows.filter(long).select(row, key, own), key, own, top, row, extreme=F.max)
    copies = found.filter(F.col(f"{own}.row") != F.col(f"{top}.row")).select(row, F.col(f"{top}.id").alias("refers_to"))
    return rows.join(copies.hint("shuffle_hash"), row, "left").drop(own, key, row)  # payloads are not sorted


def payload_sha1() -> Column:
    """Bare lower-case hex SHA-1 of the full payload of rows read: of the payload where it is there, else from
    its label."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    label = F.substring_index("payload_digest", ":", -1)
    # Base 32 in eights: 8 digits are 5 bytes.
    value = lambda k, i: F.position(F.substring(label, 8 * k + i + 1, 1), F.lit(alphabet)).cast("long") - 1
    eights = [sum((value(k, i) * (1 << (5 * (7 - i))) for i in range(1, 8)), value(k, 0) * (1 << 35)) for k in range(4)]
    hexed = F.lower(F.concat(*[F.lpad(F.hex(x), 10, "0") for x in eights]))
    return F.when(F.col("payload").isNotNull(), F.sha1("payload")).otherwise(hexed)

"""Tables published as numbered snapshots: a log with compare-and-set, rollback, and digests checked on reading.

A snapshot's rows are Parquet under a name of their own. It exists from when its entry is in the log of its table:
a file of the next number, put there whole and only if there is none (a hard link on local and NFS folders, a
rename elsewhere, which HDFS refuses where the target exists; on object stores without such a rename use
one writer). Of two writers that start from the same last number one wins, and the other is told. A write that
dies leaves rows that no entry names, which are never read.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has published since the snapshot that this one started from."""


@dataclass(frozen=True)
class Snapshot:
    """number counts a table's snapshots from 1; base is the one it was made from; path holds its rows."""

    name: str
    number: int
    base: int
    digest: str
    path: str
    at: float


def rows_digest(df: DataFrame) -> str:
    """SHA-256 of a table's rows, whatever their order: sums of parts of their own digests."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = df.agg(F.count("*").alias("n"), *[F.sum(F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(5)])
    return parts.select(F.sha2(F.concat_ws("|", *parts.columns), 256)).first()[0]


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _log(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/_log/{name}"


def _put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Whether the file has been put there whole; false if there is one already."""
    files, at = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    files.mkdirs(at.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(at.getParent(), f"_draft-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        if files.getScheme() == "file":
            os.link(draft.toUri().getPath(), at.toUri().getPath())
            return True
        return not files.exists(at) and files.rename(draft, at)
    except FileExistsError:
        return False
    finally:
        files.delete(draft, False)


def snapshots(spark: SparkSession, folder: str, name: str) -> list[Snapshot]:
    """All snapshots of a table in order; none before the first. As many as publications, each a small file."""
    files, at = _fs(spark, _log(folder, name))
    if not files.exists(at):
        return []
    out = []
    for status in files.listStatus(at):
        path = status.getPath()
        if path.getName().endswith(".json") and not path.getName().startswith(("_", ".")):
            source = files.open(path)
            try:
                out.append(Snapshot(**json.loads(bytes(source.readAllBytes()).decode())))
            finally:
                source.close()
    return sorted(out, key=lambda s: s.number)


def _append(spark: SparkSession, folder: str, last: Snapshot | None, name: str, digest: str, path: str) -> Snapshot:
    base = last.number if last else 0
    new = Snapshot(name, base + 1, base, digest, path, time.time())
    if not _put_new(spark, f"{_log(folder, name)}/{new.number:020d}.json", json.dumps(new.__dict__, sort_keys=True)):
        raise Conflict(f"{name!r} has a snapshot {new.number} already, by another writer that started from {base}")
    return new


def last_snapshot(spark: SparkSession, folder: str, name: str, number: int | None = None) -> Snapshot:
    found = [s for s in snapshots(spark, folder, name) if number in (None, s.number)]
    if not found:
        raise LookupError(f"{name!r} has no snapshot" + ("" if number is None else f" {number}"))
    return found[-1]


def publish(df: DataFrame, folder: str, name: str, key: list[str], base: int | None = None) -> str:
    """Publish df as the snapshot after base (by default the last one when this is called), and return the
    digest of its rows; Conflict if base is not the last any more. Rows that the last snapshot has already
    publish nothing; rows of an earlier one become a new snapshot that names the same files."""
    spark = df.sparkSession
    told = snapshots(spark, folder, name)
    last = told[-1] if told else None
    if base is not None:
        if base != (last.number if last else 0):
            raise Conflict(f"{name!r} is at {last.number if last else 0}, not at {base}")
    digest = rows_digest(df)
    if last and last.digest == digest:
        return digest
    path = next((s.path for s in told if s.digest == digest), None)
    if path is None:
        path = f"{folder.rstrip('/')}/{name}/{digest}-{uuid.uuid4().hex}"
        df.sortWithinPartitions(*key).write.parquet(path)
    _append(spark, folder, last, name, digest, path)
    return digest


def rollback(spark: SparkSession, folder: str, name: str, number: int, base: int | None = None) -> Snapshot:
    """Make the rows of an earlier snapshot the last ones, by a new entry that names its files."""
    told, last = last_snapshot(spark, folder, name, number), last_snapshot(spark, folder, name)
    if base is not None and base != last.number:
        raise Conflict(f"{name!r} is at {last.number}, not at {base}")
    return _append(spark, folder, last, name, told.digest, told.path)


def migrate(spark: SparkSession, folder: str, name: str, to: str, change, key: list[str]) -> str:
    """Publish change(last snapshot of name) under another name; the old snapshots stay as they are."""
    return publish(change(latest(spark, folder, name)), folder, to, key)


def latest(spark: SparkSession, folder: str, name: str, verify: bool = True, number: int | None = None) -> DataFrame:
    """The rows of the last snapshot, or of a numbered one; unless verify is off they must have its digest."""
    told = last_snapshot(spark, folder, name, number)
    out = spark.read.parquet(told.path)
    if verify and (found := rows_digest(out)) != told.digest:
        raise ValueError(f"snapshot {told.number} of {name!r} has rows with the digest {found}, not {told.digest}")
    return out

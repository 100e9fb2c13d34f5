"""Archives as rows: against zipfile and tarfile, in ranges of every size, nested, filtered and damaged."""

import io
import random
import tarfile
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from loomfield.sources import archives as A
from loomfield.sources.formats import named


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(A.ArchiveSource)


def contents(n, seed):
    rng = random.Random(seed)
    return {f"set/{('train', 'test')[k % 2]}/{k % 7}/{k % 7}_{k}.jpg": rng.randbytes(rng.randrange(0, 3000)) if k % 3 else b"x" * k * 50 for k in range(n)}


def zipped(members, method=zipfile.ZIP_DEFLATED, **more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.writestr("set/", b"")
        for name, data in members.items():
            z.writestr(name, data, compress_type=method if len(data) % 2 else zipfile.ZIP_STORED, **more)
        z.comment = b"PK\5\6 not the end"
    return out.getvalue()


def rows(df):
    return {(r.archive.rsplit("/", 1)[-1], r.inner, r.name, r.size, r.crc32, bytes(r.content)) for r in df.collect()}


def told(archive, inner, members):
    return {(archive, inner, n, len(d), zlib.crc32(d), d) for n, d in members.items()}


@pytest.mark.parametrize("entries", [1, 7, 10_000])
def test_members_of_zip_and_tar(spark, source, tmp_path, entries):
    a, b, c = contents(40, 1), {"ünï/東.txt": "é".encode(), "plain.txt": b""}, contents(9, 3)
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.zip").write_bytes(zipped(a))
    (tmp_path / "sub/b.zip").write_bytes(zipped(b))
    (tmp_path / "note.txt").write_bytes(b"no archive")
    for name, mode in (("c.tar.gz", "w:gz"), ("d.tar", "w")):
        with tarfile.open(tmp_path / name, mode) as t:
            link = tarfile.TarInfo("link")
            link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
            t.addfile(link)
            for n, data in c.items():
                info = tarfile.TarInfo(n)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    df = spark.read.format("archive").option("entries", entries).load(str(tmp_path))
    assert rows(df) == told("a.zip", None, a) | told("b.zip", None, b) | told("c.tar.gz", None, c) | told("d.tar", None, c)
    assert df.count() == 40 + 2 + 18 and df.rdd.getNumPartitions() >= (45 if entries == 1 else 4)
    some = spark.read.format("archive").option("members", "*/train/*").option("content", "false").load(str(tmp_path / "a.zip"))
    assert {(r.name, r.content) for r in some.collect()} == {(n, None) for n in a if "/train/" in n}
    parsed, other = named(some, "name", r"set/(train|test)/(\d+)/\2_(\d+)\.jpg", ["split", "identity", "frame"])
    assert parsed.count() == 20 and other.count() == 0


def test_large_directories_and_wide_fields(spark, source, tmp_path):
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        for k in range(66_000):  # more than a short count holds
            z.writestr(f"m{k}", b"")
    with zipfile.ZipFile(tmp_path / "wide.zip", "w") as z, z.open("w", "w", force_zip64=True) as f:
        f.write(b"wide")
    df = spark.read.format("archive").load(str(tmp_path))
    assert df.filter("archive LIKE '%many%'").select("name").distinct().count() == 66_000 and df.filter("name = 'w'").first().content == b"wide"


@pytest.mark.parametrize("tasks", [1, 4, 50])
def test_archives_in_archives(spark, source, tmp_path, tasks):
    a, b = contents(23, 5), contents(3, 6)
    (tmp_path / "outer.zip").write_bytes(zipped({"data/a.zip": zipped(a), "data/b.zip": zipped(b), "read.me": b"text"}))
    df = spark.read.format("archive").option("inner", "data/*.zip").option("inner_tasks", tasks).load(str(tmp_path))
    assert rows(df) == told("outer.zip", "data/a.zip", a) | told("outer.zip", "data/b.zip", b)
    with pytest.raises(Exception, match="more than 100"):
        spark.read.format("archive").option("inner", "*.zip").option("max_inner_bytes", 100).load(str(tmp_path)).collect()


def test_only_what_is_asked_for_is_read(spark, source, tmp_path):
    a = contents(60, 7)
    broken = zipped({**a, "set/bad/big.jpg": b"?" * 5001})
    at = broken.index(b"set/bad/big.jpg") + len("set/bad/big.jpg")
    (tmp_path / "a.zip").write_bytes(broken[:at] + bytes([broken[at] ^ 1]) + broken[at + 1 :])

    def read(**options):
        return {r.name for r in spark.read.format("archive").options(**options).load(str(tmp_path / "a.zip")).collect()}

    assert read(largest="5000") == set(a) and read(members="set/t*", smallest="10", largest="899") == {n for n, d in a.items() if 10 <= len(d) < 900}
    assert read(content="false") == {*a, "set/bad/big.jpg"}
    with pytest.raises(Exception, match="big.jpg"):
        read()
    df = spark.read.format("archive").option("largest", "5000").load(str(tmp_path / "a.zip"))
    assert df.filter("name LIKE 'set/train%'").count() == 30 and df.count() == 60


def test_what_is_refused(spark, source, tmp_path):
    def read(data, **options):
        (tmp_path / "x.zip").write_bytes(data)
        return spark.read.format("archive").options(**options).load(str(tmp_path / "x.zip")).collect()

    for name in ("/abs", "a/../b", "a//b", "./a", "a\\b"):
        with pytest.raises(Exception, match="unsafe"):
            read(zipped({name.replace("\\", "/"): b"1"}).replace(name.replace("\\", "/").encode(), name.encode()))
    good = zipped({"name": b"12345678901" * 9})
    assert len(read(good)) == 1
    for bad, said in ((good[:-40], "no zip"), (zipped({"n": b"1"}, zipfile.ZIP_BZIP2), "compression")):
        with pytest.raises(Exception, match=said):
            read(bad)
    with pytest.raises(Exception, match="more than 50"):
        read(good, max_member_bytes="50")
    with pytest.raises(Exception, match="missing"):
        spark.read.format("archive").load(str(tmp_path / "missing")).collect()
    (tmp_path / "empty").mkdir()
    assert spark.read.format("archive").load(str(tmp_path / "empty")).count() == 0

"""Archives: round trips, splits of every size, nested and damaged members, and the choice of revisits."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomfield.llm import warc
from loomfield.llm.common import shared_dir


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(warc.WarcSource)


def archive(tmp_path, payloads, name="a.warc.gz", between=b""):
    data = b"".join(warc.member(f"urn:x:{k}", f"http://h/{k}", None, None, p) + between for k, p in enumerate(payloads))
    (tmp_path / name).write_bytes(data)
    return data


def noise(n, seed):
    return random.Random(seed).randbytes(n)


def test_members_are_plain_gzip_and_plain_warc():
    one, two = warc.member("urn:a", "http://x/\r\nEvil: 1", "2024-01-01T00:00:00Z", None, b"body"), warc.member("urn:b", None, None, "urn:a", b"body")
    text = gzip.decompress(one + two).decode()
    first, rest = text.split("\r\n\r\nbody\r\n\r\n")
    assert first.startswith("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:a>\r\nWARC-Target-URI: http://x/ Evil: 1\r\n")
    assert "WARC-Refers-To: <urn:a>" in rest and rest.endswith("Content-Length: 4\r\n\r\n\r\n\r\n") and "body" not in rest


@pytest.mark.parametrize("split", [37, 200, 1000, 1 << 20])
def test_splits_of_any_size_own_each_record_once(tmp_path, split):
    """Also with chance magic, nested archives, archives in archives, empty and large payloads, and padding."""
    inner = b"".join(warc.member(f"urn:in:{k}", None, None, None, noise(50, k)) for k in range(3))
    payloads = [b"", b"x", noise(300, 1), warc.MAGIC * 9, noise(90, 2) + inner + noise(90, 3), inner, b"a" * 50_000, noise(3000, 4), b"end"]
    if split < 1000:
        payloads = [p for p in payloads if inner not in p]  # these reach over whole ranges
    for between in (b"", b"\0" * 5):
        data = archive(tmp_path, payloads, between=between)
        with open(tmp_path / "a.warc.gz", "rb") as f:
            got = []
            for lo in range(0, len(data), split):
                members = warc.Members(f, len(data), "a", step=256, piece=64)
                got += [row for at, text in members.owned(lo, min(lo + split, len(data))) for row in warc.parsed(text, "a", at)]
        assert [(r[0], r[7]) for r in got] == [(f"urn:x:{k}", p) for k, p in enumerate(payloads)]
        assert all(data[r[9] :].startswith(warc.MAGIC) for r in got)


def test_damage_is_named(tmp_path):
    data = archive(tmp_path, [noise(500, 1), noise(500, 2)])
    second = len(warc.member("urn:x:0", "http://h/0", None, None, noise(500, 1)))

    def read(bad):
        (tmp_path / "b.warc.gz").write_bytes(bad)
        with open(tmp_path / "b.warc.gz", "rb") as f:
            return [r for at, text in warc.Members(f, len(bad), "b").owned(0, len(bad)) for r in warc.parsed(text, "b", at)]

    assert len(read(data)) == 2
    for bad, where in ((data[:-30], second), (data[: second + 200] + b"?" * 20 + data[second + 220 :], second), (data[:second] + b"junk" + data[second:], second)):
        with pytest.raises(ValueError, match=f"b at {where}"):
            read(bad)
    wrong = gzip.compress(gzip.decompress(data[:second]).replace(b"sha1:", b"sha1:AAAA"))
    with pytest.raises(ValueError, match="digest"):
        read(wrong)


def test_round_trip_of_a_table(spark, source):
    rows = [(f"urn:{k}", f"http://h/{k}", None, f"urn:{k - 1}" if k % 5 == 4 else None, noise(k * 7, k) if k % 7 else None, "extra") for k in range(200)]
    df = spark.createDataFrame(rows, "record_id string, uri string, date string, refers_to string, payload binary, type string").repartition(3)
    folder = f"{shared_dir(spark)}/warc-round"
    df.write.format("warc").option("file_bytes", 9000).mode("append").save(folder)
    got = spark.read.format("warc").option("split_bytes", 700).load(folder)
    assert got.rdd.getNumPartitions() > 20
    want = {(a, b, d, None if d else bytes(p or b""), len(p or b"")) for a, b, _, d, p, _ in rows}
    found = got.collect()
    assert {(r.record_id, r.uri, r.refers_to, r.payload and bytes(r.payload) if r.payload is None else bytes(r.payload), r.payload_length) for r in found} == want and len(found) == 200
    sha = {r.record_id: r.s for r in got.select("record_id", warc.payload_sha1().alias("s")).collect()}
    assert sha == {a: hashlib.sha1(p or b"").hexdigest() for a, _, _, _, p, _ in rows}
    again = df.filter("record_id = 'urn:3'")
    again.write.format("warc").mode("append").save(folder)
    assert spark.read.format("warc").load(folder).count() == 201
    again.write.format("warc").mode("overwrite").save(folder)
    assert spark.read.format("warc").load(folder).count() == 1
    df.limit(0).write.format("warc").mode("append").save(folder + "-none")
    assert spark.read.format("warc").load(folder + "-none").count() == 0
    with pytest.raises(Exception, match="warc-missing"):
        spark.read.format("warc").load(folder.replace("round", "missing")).count()


def test_a_task_that_fails_leaves_nothing(spark, source):
    folder = f"{shared_dir(spark)}/warc-failed"
    df = spark.range(100).select(
        F.when(F.col("id") < 99, F.col("id").cast("string")).otherwise(F.raise_error(F.lit("boom"))).alias("record_id"),
        F.lit(None).cast("string").alias("uri"), F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("refers_to"), F.lit(b"x").alias("payload"),
    )
    with pytest.raises(Exception, match="boom"):
        df.write.format("warc").mode("append").save(folder)
    from pathlib import Path

    assert not list(Path(folder.removeprefix("file://")).rglob("*.gz"))


def test_revisits(spark):
    """Ties, nulls, repeated rows, short payloads, a payload that most rows have, clashing columns."""
    rng = random.Random(2)
    kinds = [None, b"", b"s" * 999, b"l" * 1000, b"m" * 1500, noise(1200, 1)]
    rows = [(rng.randrange(60), kinds[rng.choice([0, 1, 2, 3, 3, 3, 4, 5])]) for _ in range(300)] + [(None, kinds[4]), (None, kinds[4]), (None, None), (99, noise(1100, 9))]
    df = spark.createDataFrame(rows, "page_id long, payload binary").withColumn("record_id", F.concat(F.lit("u"), F.coalesce("page_id", F.lit(-1)))).withColumn("row", F.lit(1)).withColumn("key", F.lit("k"))
    got = warc.with_revisits(df, "page_id")
    assert got.columns == [*df.columns, "refers_to"]
    found = got.collect()
    assert sorted(map(str, ((r.page_id, r.payload) for r in found))) == sorted(str((i, p)) for i, p in rows)
    for kind in kinds:
        own = [r for r in found if (r.payload is None) == (kind is None) and bytes(r.payload or b"") == (kind or b"")]
        if len(kind or b"") < 1000:
            assert not any(r.refers_to for r in own)
        else:
            top = max(-1 if r.page_id is None else r.page_id for r in own)
            first = [r for r in own if r.refers_to is None]
            assert len(first) == 1 and first[0].page_id == top and {r.refers_to for r in own} == {None, f"u{top}"}
    assert warc.with_revisits(df.limit(0), "page_id").count() == 0
    once = df.dropna(subset=["page_id"]).dropDuplicates(["page_id"])
    told = {r.page_id: r for r in warc.with_revisits(once, "page_id").collect()}
    tops = {}
    for r in once.collect():
        if len(r.payload or b"") >= 1000:
            tops[bytes(r.payload)] = max(tops.get(bytes(r.payload), -1), r.page_id)
    assert len(told) == once.count()
    for r in told.values():
        top = tops.get(bytes(r.payload or b""), r.page_id)
        assert r.refers_to == (None if top == r.page_id else f"u{top}")

import json

import pytest
from pyspark.sql import functions as F

from loomfield.operators import snapshots as G
from loomfield.sources import formats as S


def test_coco_keypoints(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "a.jpg", "width": 10, "height": 10}],
        "annotations": [
            {"id": 5, "image_id": 1, "category_id": 8, "bbox": [1, 2, 3, 4], "keypoints": [1, 1, 2, 0, 0, 0]},
            {"id": 6, "image_id": 1, "category_id": 9, "bbox": [0, 0, 1, 1], "keypoints": []},
        ],
        "categories": [{"id": 8, "keypoints": ["nose", "eye"]}, {"id": 9, "keypoints": []}],
    }
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    r = S.load(spark, "coco_keypoints", str(tmp_path / "a.json")).collect()
    assert [(x.annotation_id, x.x2, x.y2) for x in r] == [(5, 4.0, 6.0)]
    assert {k: v.c for k, v in r[0].keypoints.items()} == {"nose": 1.0}


def test_list_file_and_names(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# remark\nfoo_1 1 2 3\nbar 4\n")
    rows = {r["name"]: r for r in S.load(spark, "list_file", str(tmp_path / "list.txt")).collect()}
    assert rows["foo_1"].breed == 3 and rows["foo_1"].well_formed and not rows["bar"].well_formed
    names = spark.createDataFrame([("0001C2S3.jpg",), ("odd.jpg",), (None,)], "n string")
    good, bad = S.named(names, "n", r"(\d{4})C(\d)S(\d)\.jpg", ["identity", "camera", "sequence"])
    assert [tuple(r) for r in good.collect()] == [("0001C2S3.jpg", "0001", "2", "3")] and bad.count() == 2


def test_embedding_manifest(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"sample_ids": ["a", "b"], "identities": ["x", "y"], "embeddings": [[1.0], [2.0]], "qualities": [0.5, 0.6]}))
    assert [r.embedding for r in S.load(spark, "embedding_manifest", str(tmp_path / "e.json")).orderBy("sample_id").collect()] == [[1.0], [2.0]]
    (tmp_path / "f.json").write_text(json.dumps({"sample_ids": ["a", "b"], "identities": ["x"], "embeddings": [[1.0]], "qualities": []}))
    with pytest.raises(Exception, match="differ in length"):
        S.load(spark, "embedding_manifest", str(tmp_path / "f.json")).collect()


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="no known format"):
        S.load(spark, "nope", "x")


def test_tool_output(spark):
    probe = {"streams": [{"codec_type": "audio"}, {"codec_type": "video", "codec_name": "h264", "width": 4, "height": 2, "avg_frame_rate": "30000/1001"}], "format": {"duration": "12.5", "bit_rate": "800"}}
    r = S.stream_facts(spark.createDataFrame([(json.dumps(probe),), ("{}",)], "p string"), "p").collect()
    assert r[0].codec == "h264" and abs(r[0].fps - 29.97) < 0.01 and r[0].duration == 12.5 and r[0].bit_rate == 800 and r[1].codec is None
    g = S.gpu_samples(spark.createDataFrame([("0, 120, [N/A], 30",)], "l string"), "l").first()
    assert (g.device, g.memory_mib, g.power_w, g.utilisation) == (0, 120.0, None, 30.0)
    log = "frame= 10 speed=2x\nframe= 60 fps=1 speed= 137x\nbench: utime=0.100s stime=0.1s rtime=0.014s\nbench: maxrss=5000KiB"
    d = S.decode_report(spark.createDataFrame([(log,)], "l string"), "l").first()
    assert (d.frames, d.real_s, d.max_rss_kib) == (60, 0.014, 5000)
    t = S.timestamps(spark.createDataFrame([("1.5",), ("N/A",)], "t string"), "t").collect()
    assert [x.timestamp_ns for x in t] == [1_500_000_000, None]


def test_manifest_is_not_overwritten(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "id int, name string")
    S.write_manifest(df, str(tmp_path / "m"), ["id"])
    assert {r.value for r in spark.read.text(str(tmp_path / "m")).collect()} == {'{"id":1,"name":"a"}', '{"id":2,"name":"b"}'}
    with pytest.raises(Exception, match="already exists"):
        S.write_manifest(df, str(tmp_path / "m"), ["id"])


def test_generations(spark, tmp_path):
    a = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    first = G.publish(a, str(tmp_path / "g"), "gallery", ["id"])
    assert G.publish(a.orderBy(F.desc("id")), str(tmp_path / "g"), "gallery", ["id"]) == first
    assert len(G.snapshots(spark, str(tmp_path / "g"), "gallery")) == 1
    second = G.publish(a.filter("id = 1"), str(tmp_path / "g"), "gallery", ["id"])
    assert second != first and G.latest(spark, str(tmp_path / "g"), "gallery").count() == 1


def test_image_folders_are_listed_in_tasks(spark, tmp_path):
    for name in ("a/1.png", "a/2 x.png", "b/deep/3.png", "b/.hidden", "b/_tmp/4.png", "_c/5.png", "root.png"):
        at = tmp_path / "set" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"x" * len(name))
    (tmp_path / "set" / "empty").mkdir()
    for path in (f"{tmp_path}/set", f"file:{tmp_path}/set/", f"file://{tmp_path}/set"):
        found = S.load(spark, "image_folders", path)
        got = {(r.identity, r.name): (r.bytes, r.path) for r in found.collect()}
        want = {("a", "1.png"): "a/1.png", ("a", "2 x.png"): "a/2 x.png", ("deep", "3.png"): "b/deep/3.png", ("set", "root.png"): "root.png"}
        assert got == {k: (len(n), f"file:{tmp_path}/set/{n}") for k, n in want.items()}
    assert "binaryFile" not in found._jdf.queryExecution().executedPlan().toString()  # whose files the driver lists one by one

"""Round trips through the readers and sinks: tables written in a format to the shared folder and read again, and tool
output made from tables and parsed."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.functions.vectors import as_double
from loomfield.operators import integrity as I
from loomfield.operators import snapshots as G
from loomfield.plans.registering import query, rounded
from loomfield.sources import formats as S
from loomfield.sources.archives import ArchiveSource
from loomfield.storage import shared_dir


def _place(df, name: str) -> str:
    return f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT CAST(l_partkey AS VARCHAR) AS "left", CAST(l_suppkey AS VARCHAR) AS "right", l_linenumber % 2 AS label FROM lineitem""")
def source_csv_pairs(t):
    rows = t("lineitem").select(F.col("l_partkey").cast("string").alias("left"), F.col("l_suppkey").cast("string").alias("right"), (F.col("l_linenumber") % 2).cast("int").alias("label"))
    path = _place(rows, "pairs")
    rows.write.option("header", True).csv(path)
    return S.load(rows.sparkSession, "csv_pairs", path)


@query("""SELECT CAST(vec_id AS VARCHAR) AS sample_id, CAST(label AS VARCHAR) AS identity, round(list_sum(embedding::DOUBLE[]), 5) AS total, len(embedding) AS dim, vec_id % 4 / 4.0::DOUBLE AS quality FROM embeddings""")
def source_embedding_manifest(t):
    """One document of parallel arrays for each label."""
    e = t("embeddings")
    one = F.struct(F.col("vec_id").cast("string").alias("s"), F.col("label").cast("string").alias("i"), as_double("embedding").alias("e"), (F.col("vec_id") % 4 / 4).alias("q"))
    docs = e.groupBy("label").agg(F.collect_list(one).alias("x")).select(
        "label", F.col("x.s").alias("sample_ids"), F.col("x.i").alias("identities"), F.col("x.e").alias("embeddings"), F.col("x.q").alias("qualities")
    )
    path = _place(e, "manifest")
    docs.repartition("label").write.partitionBy("label").json(path)
    rows = S.load(e.sparkSession, "embedding_manifest", path)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return rounded(rows.select("sample_id", "identity", total.alias("total"), F.size("embedding").cast("long").alias("dim"), "quality"), "total", digits=5)


@query("""SELECT '{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS line, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS sha256 FROM orders""")
def source_manifest_lines(t):
    rows = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    path = _place(rows, "lines")
    S.write_manifest(rows, path, ["o_orderkey"])
    return rows.sparkSession.read.text(path).select(F.col("value").alias("line"), F.sha2("value", 256).alias("sha256"))


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def source_jsonl(t):
    rows = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    path = _place(rows, "jsonl")
    S.write_manifest(rows, path, ["o_orderkey"])
    return S.jsonl(rows.sparkSession, path, "o_orderkey long, o_custkey long, o_orderpriority string")


@query("""SELECT 'part_' || p_partkey AS name, CAST(p_size AS INTEGER) AS class, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey % 2 + 1 AS INTEGER) END AS species, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_partkey % 12 AS INTEGER) END AS breed, p_partkey % 7 <> 0 AS well_formed FROM part""")
def source_list_file(t):
    """Every fifth species is no number, every seventh line lacks its breed; each file begins with a remark."""
    k = F.col("p_partkey")
    species = F.when(k % 5 == 0, "x").otherwise((k % 2 + 1).cast("string"))
    line = F.concat_ws(" ", F.concat(F.lit("part_"), k), F.col("p_size").cast("string"), species, F.when(k % 7 != 0, (k % 12).cast("string")))
    rows = t("part").select(F.explode(F.array(F.lit("#image class species breed"), line)).alias("value"))
    path = _place(rows, "list")
    rows.write.text(path)
    return S.load(rows.sparkSession, "list_file", path)


@query("""SELECT p_partkey AS image_id, 'part_' || p_partkey || '.png' AS file_name, (p_partkey % 60)::DOUBLE AS x1, (p_partkey % 40)::DOUBLE AS y1, p_partkey % 60 + 10.0::DOUBLE AS x2, p_partkey % 40 + p_size::DOUBLE AS y2,
  CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 60)::DOUBLE END AS nose, CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 3) / 2.0::DOUBLE END AS sure FROM part""")
def source_coco(t):
    """One document for each brand: images, annotations with two points each (visible by turns), one category."""
    k, size = F.col("p_partkey"), F.col("p_size")
    number = lambda c: c.cast("double")
    image = F.struct(k.alias("id"), F.concat(F.lit("part_"), k, F.lit(".png")).alias("file_name"), F.lit(64).alias("width"), F.lit(48).alias("height"))
    points = F.array(number(k % 60), number(k % 40), number(k % 3), F.lit(1.0), F.lit(1.0), F.lit(2.0))
    note = F.struct(
        k.alias("id"), k.alias("image_id"), F.lit(8).alias("category_id"), F.array(number(k % 60), number(k % 40), F.lit(10.0), number(size)).alias("bbox"), points.alias("keypoints")
    )
    kinds = F.array(F.struct(F.lit(8).alias("id"), F.array(F.lit("nose"), F.lit("tail")).alias("keypoints")))
    docs = t("part").groupBy("p_brand").agg(F.collect_list(image).alias("images"), F.collect_list(note).alias("annotations")).withColumn("categories", kinds)
    path = _place(docs, "coco")
    docs.repartition("p_brand").write.partitionBy("p_brand").json(path)
    rows = S.coco_keypoints(docs.sparkSession, path)
    nose = F.col("keypoints")["nose"]
    return rows.select("image_id", "file_name", "x1", "y1", "x2", "y2", nose["x"].alias("nose"), nose["c"].alias("sure"))


@query("""SELECT p_partkey, p_brand AS codec, CAST(p_size * 16 AS INTEGER) AS width, CAST(p_size AS INTEGER) AS height, round(p_size * 1000 / 1001.0::DOUBLE, 6) AS fps,
  CASE WHEN p_partkey % 2 = 0 THEN 12.5::DOUBLE ELSE 99.0 END AS duration, p_partkey * 1000 AS bit_rate FROM part""")
def source_stream_facts(t):
    """ffprobe's JSON: every other stream lacks a duration, which the container has."""
    k, size = F.col("p_partkey"), F.col("p_size")
    text = F.concat(
        F.lit('{"streams":[{"codec_type":"audio","codec_name":"aac"},{"codec_type":"video","codec_name":"'), F.col("p_brand"), F.lit('","width":'), size * 16, F.lit(',"height":'), size,
        F.lit(',"avg_frame_rate":"'), size * 1000, F.lit('/1001"'), F.when(k % 2 == 0, ',"duration":"12.5"').otherwise(""), F.lit(',"bit_rate":"'), k * 1000,
        F.lit('"}],"format":{"duration":"99.0","bit_rate":"1"}}'),
    )
    rows = S.stream_facts(t("part").select("p_partkey", text.alias("body")), "body").drop("body")
    return rounded(rows, "fps")


@query("""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN -1 ELSE event_id * 1000000000 + (event_id % 1000) * 1000000 END AS timestamp_ns FROM events""")
def source_timestamps(t):
    k = F.col("event_id")
    text = F.when(k % 9 == 0, "N/A").otherwise(F.concat(F.lit(" "), k, F.lit("."), F.lpad((k % 1000).cast("string"), 3, "0")))
    rows = S.timestamps(t("events").select("event_id", text.alias("line")), "line")
    return rows.select("event_id", F.coalesce("timestamp_ns", F.lit(-1)).alias("timestamp_ns"))


@query("""SELECT event_id, CAST(event_id % 4 AS INTEGER) AS device, (event_id % 8000)::DOUBLE AS memory_mib, CASE WHEN event_id % 6 = 0 THEN NULL ELSE (event_id % 300) / 2.0::DOUBLE END AS power_w, (event_id % 101)::DOUBLE AS utilisation FROM events""")
def source_gpu_samples(t):
    k = F.col("event_id")
    power = F.when(k % 6 == 0, "[N/A]").otherwise((k % 300 / 2).cast("string"))
    line = F.concat_ws(", ", (k % 4).cast("string"), (k % 8000).cast("string"), power, (k % 101).cast("string"))
    return S.gpu_samples(t("events").select("event_id", line.alias("line")), "line").drop("line")


@query("""SELECT event_id, event_id * 3 AS frames, (event_id % 40) / 4.0::DOUBLE AS speed, 1.25::DOUBLE AS user_s, (event_id % 10) / 2.0::DOUBLE AS real_s, CASE WHEN event_id % 5 > 0 THEN event_id END AS max_rss_kib FROM events""")
def source_decode_report(t):
    """An ffmpeg log with two progress lines, of which the last counts."""
    k = F.col("event_id")
    text = F.concat(
        F.lit("frame=    1 fps=0.0 speed=0.1x\rframe= "), k * 3, F.lit(" fps=9 speed= "), (k % 40 / 4).cast("string"), F.lit("x\nbench: utime=1.25s stime=0.1s rtime="), (k % 10 / 2).cast("string"), F.lit("s\n"),
        F.when(k % 5 > 0, F.concat(F.lit("bench: maxrss="), k, F.lit("KiB"))).otherwise(""),
    )
    return S.decode_report(t("events").select("event_id", text.alias("log")), "log").drop("log")


@query("SELECT n_nationkey, n_name, 2 AS version FROM nation")
def source_generations(t):
    """Published, published again without effect, migrated to another name, read back with its digest checked."""
    rows, at = t("nation").select("n_nationkey", "n_name"), _place(t("nation"), "store")
    if G.publish(rows, at, "old", ["n_nationkey"]) != G.publish(rows, at, "old", ["n_nationkey"]):
        raise ValueError("equal rows were published as two snapshots")
    G.migrate(rows.sparkSession, at, "old", "new", lambda df: df.withColumn("version", F.lit(2)), ["n_nationkey"])
    return G.latest(rows.sparkSession, at, "new")


@query("""SELECT number, base, reads, n_suppkey, s_acctbal FROM (SELECT s_suppkey AS n_suppkey, s_acctbal FROM supplier) s, (VALUES (1, 0, 'all'), (2, 1, 'even'), (3, 2, 'all'), (4, 3, 'even')) v(number, base, reads)
WHERE reads = 'all' OR n_suppkey % 2 = 0""")
def source_snapshots(t):
    """All suppliers, those of even number, all again, and a rollback to the second: each snapshot read by its number. A
    writer that started from the first is refused."""
    spark, at, key = t("supplier").sparkSession, _place(t("supplier"), "snapshots"), ["n_suppkey"]
    rows = t("supplier").select(F.col("s_suppkey").alias("n_suppkey"), "s_acctbal")
    even = rows.filter("n_suppkey % 2 = 0")
    G.publish(rows, at, "supplier", key, base=0)
    G.publish(even, at, "supplier", key, base=1)
    try:
        G.publish(rows.limit(1), at, "supplier", key, base=1)
        raise ValueError("a writer that started from an old snapshot was not refused")
    except G.Conflict:
        pass
    G.publish(rows, at, "supplier", key, base=2)
    G.rollback(spark, at, "supplier", 2)
    out = None
    for s in G.snapshots(spark, at, "supplier"):
        reads = "all" if s.number % 2 else "even"
        own = G.latest(spark, at, "supplier", number=s.number).select(F.lit(s.number).alias("number"), F.lit(s.base).alias("base"), F.lit(reads).alias("reads"), "n_suppkey", "s_acctbal")
        out = own if out is None else out.union(own)
    return out


@query("""WITH d AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '{"a":1,"a":2}' WHEN 1 THEN '{"a":' || o_orderkey || '}' WHEN 2 THEN '[1,2' WHEN 3 THEN repeat('[', 40) || repeat(']', 40) ELSE '[NaN]' END AS body FROM orders)
SELECT o_orderkey, ['REPEATED_KEY', NULL, 'NOT_JSON', 'DEPTH', 'NUMBER'][o_orderkey % 5 + 1] AS rule, sha256(body) AS sha256 FROM d""")
def source_strict_documents(t):
    k = F.col("o_orderkey")
    deep = F.lit("[" * 40 + "]" * 40)
    body = F.when(k % 5 == 0, '{"a":1,"a":2}').when(k % 5 == 1, F.concat(F.lit('{"a":'), k, F.lit("}"))).when(k % 5 == 2, "[1,2").when(k % 5 == 3, deep).otherwise("[NaN]")
    return I.strict_documents(t("orders").select("o_orderkey", body.alias("body")), "body").drop("body")


@query("""SELECT n_name, n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'a, "b"' ELSE 'plain' END AS note FROM nation""")
def source_csv_sink(t):
    rows = t("nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 4 == 0, 'a, "b"').otherwise("plain").alias("note"))
    path = _place(rows, "table")
    S.write_csv(rows, path, ["n_nationkey"])
    return rows.sparkSession.read.schema("n_name string, n_nationkey long, note string").option("header", True).option("escape", '"').option("lineSep", "\r\n").csv(path)


@query("""SELECT 'v' || vec_id AS image, CAST(k AS INTEGER) AS place, round(embedding[k + 1]::DOUBLE, 6) AS score, (vec_id % 50 + k)::DOUBLE AS x FROM embeddings, range(3) r(k)""")
def source_region_candidates(t):
    k, v = F.col("vec_id"), as_double("embedding")
    boxes = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.array((k % 50 + i).cast("double"), F.lit(0.0), F.lit(1.0), F.lit(1.0)))
    rows = t("embeddings").select(F.concat(F.lit("v"), k).alias("image"), F.slice(v, 1, 3).alias("scores"), boxes.alias("boxes"))
    path = _place(rows, "regions")
    rows.write.parquet(path)
    return S.load(rows.sparkSession, "region_candidates", path).select("image", "place", F.round("score", 6).alias("score"), F.col("box")[0].alias("x"))


@query("""SELECT 'v' || vec_id AS image, CASE WHEN vec_id % 9 = 0 THEN NULL ELSE CASE WHEN vec_id % 4 = 0 THEN 45 ELSE 46 END END AS points, CASE WHEN vec_id % 9 > 0 AND vec_id % 5 > 0 AND vec_id % 11 > 0 THEN (vec_id % 50)::DOUBLE END AS x1,
  CASE WHEN vec_id % 9 = 0 THEN 'POINTS' WHEN vec_id % 11 = 0 THEN 'BOX' END AS rule FROM embeddings WHERE vec_id % 9 = 0 OR vec_id % 11 > 0
UNION ALL SELECT 'v' || vec_id, NULL, NULL, 'BOX' FROM embeddings WHERE vec_id % 9 > 0 AND vec_id % 11 = 0""")
def source_landmark_labels(t):
    """Some documents lack a point (45 are left), have one too few, an empty value in the box, or no box."""
    k = F.col("vec_id")
    points = F.transform(F.sequence(F.lit(1), F.when(k % 9 == 0, 45).otherwise(46)), lambda i: F.array(F.when((k % 4 == 0) & (i == 3), float("nan")).otherwise(i.cast("double")), F.lit(1.0)))
    box = F.when(k % 11 != 0, F.array(F.when(k % 5 == 0, "").otherwise((k % 50).cast("string")), F.lit("1"), F.lit("60"), F.lit("2")))
    rows = t("embeddings").select(F.concat(F.lit("v"), k).alias("image"), points.alias("landmarks"), box.alias("bounding_boxes"))
    path = _place(rows, "landmarks")
    rows.write.json(path)
    out = S.load(rows.sparkSession, "landmark_labels", path)
    return out.select("image", F.size("landmarks").cast("long").alias("points"), "x1", "rule").withColumn("points", F.when(F.col("rule").isNull(), F.col("points")))


@query("""SELECT 'part_' || p_partkey || '.jpg' AS name, CASE WHEN p_partkey % 8 > 0 THEN 'dog' END AS kind, (p_partkey % 60)::DOUBLE AS x1, CASE WHEN p_partkey % 8 > 0 THEN CASE WHEN p_partkey % 60 + p_size > 90 THEN 'BOX' END ELSE 'OBJECTS' END AS rule FROM part WHERE p_partkey % 8 > 0
UNION ALL SELECT 'part_' || p_partkey || '.jpg', NULL, NULL, 'OBJECTS' FROM part WHERE p_partkey % 8 = 0""")
def source_head_boxes(t):
    """One file for each brand."""
    k, size = F.col("p_partkey"), F.col("p_size")
    box = F.concat(F.lit("<object><name>dog</name><pose>Frontal</pose><bndbox><xmin>"), k % 60, F.lit("</xmin><ymin>1</ymin><xmax>"), k % 60 + size, F.lit("</xmax><ymax>9</ymax></bndbox></object>"))
    text = F.concat(F.lit("<annotation><filename>part_"), k, F.lit(".jpg</filename><size><width>90</width><height>48</height></size>"), F.when(k % 8 > 0, box).otherwise(""), F.lit("</annotation>"))
    files = t("part").groupBy("p_brand").agg(F.concat(F.lit("<all>"), F.array_join(F.collect_list(text), ""), F.lit("</all>")).alias("value"))
    path = _place(files, "heads")
    files.repartition("p_brand").write.partitionBy("p_brand").text(path)
    return S.load(files.sparkSession, "head_boxes", path).select("name", "kind", "x1", "rule")


@query("""WITH r AS (SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS identity, CASE WHEN o_orderkey % 31 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END AS label, o_orderkey - CASE WHEN o_orderkey % 29 = 1 THEN 1 ELSE 0 END AS n FROM orders
), f AS (SELECT identity || '/' || n || '.png' AS filename, identity, label FROM r), c AS (SELECT *, count(*) OVER (PARTITION BY filename) AS n FROM f)
SELECT filename, identity, CASE WHEN label = 'x' THEN 'LABEL' WHEN n > 1 THEN 'REPEATED' END AS rule FROM c""")
def source_split_list(t):
    o, k = t("orders"), F.col("o_orderkey")
    folder = F.lpad(F.col("o_custkey").cast("string"), 6, "0")
    name = F.concat(folder, F.lit("/"), k - F.when(k % 29 == 1, 1).otherwise(0), F.lit(".png"))
    rows = o.select(name.alias("filename"), F.when(k % 31 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("label"))
    path = _place(rows, "split")
    rows.write.option("header", True).csv(path)
    return S.load(rows.sparkSession, "split_list", path)


def _zipped(rows: DataFrame, folder: str) -> None:
    """rows(archive, name, content) as one zip file for each archive, with a part of it as an archive in the archive."""
    def write(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
        import io
        import zipfile

        from loomfield.sources.archives import opened

        system, at = opened(folder)
        outer, inner = io.BytesIO(), io.BytesIO()
        with zipfile.ZipFile(outer, "w", zipfile.ZIP_DEFLATED) as z, zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as y:
            for name, content in members.sort_values("name")[["name", "content"]].itertuples(index=False):
                (y if name.startswith("inner/") else z).writestr(name, content)
            y.close()
            z.writestr("inner.zip", inner.getvalue())
        system.create_dir(at, recursive=True)
        draft = f"{at}/draft-{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as out:
            out.write(outer.getvalue())
        system.move(draft, f"{at}/{key[0]}.zip")
        return pd.DataFrame({"archive": [key[0]], "members": [len(members)]})

    rows.groupBy("archive").applyInPandas(write, "archive string, members long").write.format("noop").mode("overwrite").save()


_MEMBERS = """WITH m AS (SELECT 'part' || c_custkey // 1000 AS archive, CASE WHEN c_custkey % 3 = 0 THEN 'inner/' ELSE 'outer/' END || lower(c_mktsegment) || '/' || c_custkey || '_' || c_custkey % 7 || '.txt' AS name,
  c_name || chr(10) || repeat(c_mktsegment, CAST(c_custkey % 50 AS INT)) AS content FROM customer)
"""


def _members(t) -> DataFrame:
    k = F.col("c_custkey")
    folder = F.when(k % 3 == 0, "inner/").otherwise("outer/")
    name = F.concat(folder, F.lower("c_mktsegment"), F.lit("/"), k.cast("string"), F.lit("_"), (k % 7).cast("string"), F.lit(".txt"))
    content = F.concat("c_name", F.lit("\n"), F.repeat(F.col("c_mktsegment"), (k % 50).cast("int")))
    return t("customer").select(F.concat(F.lit("part"), F.floor(k / 1000).cast("string")).alias("archive"), name.alias("name"), content.alias("content"))


def _archives(t):
    spark, at = t("customer").sparkSession, _place(t("customer"), "archives")
    _zipped(_members(t), at)
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").option("entries", 100), at


def _archive():
    return F.regexp_extract("archive", r"([^/]+)\.zip$", 1).alias("archive")


@query(_MEMBERS + "SELECT archive, name, strlen(content) AS size, sha256(content) AS sha256 FROM m WHERE name LIKE 'outer/%'")
def source_archive_members(t):
    """Members of zip files, a range of each directory a task."""
    reader, at = _archives(t)
    found = reader.option("members", "outer/*").load(at)
    return found.select(_archive(), "name", "size", F.sha2("content", 256).alias("sha256"))


@query(_MEMBERS + r"""SELECT archive, name, split_part(name, '/', 2) AS segment, CAST(regexp_extract(name, '/(\d+)_', 1) AS BIGINT) AS customer,
  regexp_extract(name, '_(\d+)\.', 1) AS frame, sha256(content) AS sha256 FROM m WHERE name LIKE 'inner/%'""")
def source_nested_archives(t):
    """Members of archives within archives, with the fields of their names."""
    reader, at = _archives(t)
    found = reader.option("inner", "inner.zip").option("inner_tasks", 2).load(at)
    rows, _ = S.named(found, "name", r"inner/(\w+)/(\d+)_(\d)\.txt", ["segment", "customer", "frame"])
    return rows.select(_archive(), "name", "segment", F.col("customer").cast("long").alias("customer"), "frame", F.sha2("content", 256).alias("sha256"))


@query(_MEMBERS + """SELECT archive AS identity, split_part(name, '/', 3) AS name, strlen(content) AS bytes FROM m""")
def source_image_folders(t):
    """A folder for each identity, a file for each row, written as text and read without its contents."""
    at = _place(t("customer"), "folders")
    rows = _members(t)

    def write(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
        from loomfield.sources.archives import opened

        system, folder = opened(f"{at}/{key[0]}")
        system.create_dir(folder, recursive=True)
        for name, content in members[["name", "content"]].itertuples(index=False):
            with system.open_output_stream(f"{folder}/{name.rsplit('/', 1)[-1]}") as out:
                out.write(content.encode())
        return pd.DataFrame({"archive": [key[0]], "members": [len(members)]})

    rows.groupBy("archive").applyInPandas(write, "archive string, members long").write.format("noop").mode("overwrite").save()
    return S.load(t("customer").sparkSession, "image_folders", at).select("identity", "name", "bytes")

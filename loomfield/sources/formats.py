"""Readers of the formats that identity and video datasets come in, as DataFrames of fixed schema.

Every reader returns rows plus, where a format has rules, a table of the rows that break them: a
reader never drops what it cannot parse without saying so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.sources.archives import opened

Reader = Callable[[SparkSession, str], DataFrame]
_READERS: dict[str, Reader] = {}


def reader(name: str):
    """Register a reader of a named format."""

    def add(f: Reader) -> Reader:
        _READERS[name] = f
        return f

    return add


def load(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in _READERS:
        raise ValueError(f"{name!r} is no known format; known are {sorted(_READERS)}")
    return _READERS[name](spark, path)


@reader("coco_keypoints")
def coco_keypoints(spark: SparkSession, path: str, category: int = 8) -> DataFrame:
    """COCO-style JSON documents (images, annotations, categories, which agree between documents): one row
    for each annotation of a category, its xywh box as corners, its visible keypoints as name -> (x, y,
    confidence = visibility / 2)."""
    schema = (
        "images array<struct<id: bigint, file_name: string, width: int, height: int>>, "
        "annotations array<struct<id: bigint, image_id: bigint, category_id: int, bbox: array<double>, keypoints: array<double>>>, "
        "categories array<struct<id: int, keypoints: array<string>>>"
    )
    doc = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    images = doc.select(F.inline("images")).withColumnRenamed("id", "image_id")
    names = doc.select(F.inline("categories")).filter(F.col("id") == category).select(F.col("id").alias("category_id"), F.col("keypoints").alias("names")).distinct()
    notes = doc.select(F.inline("annotations")).join(F.broadcast(names), "category_id")  # one row a category
    point = lambda i: F.struct(
        F.element_at("keypoints", 3 * i + 1).alias("x"), F.element_at("keypoints", 3 * i + 2).alias("y"), (F.element_at("keypoints", 3 * i + 3) / 2).alias("c")
    )
    entries = F.transform(F.sequence(F.lit(0), F.size("names") - 1), lambda i: F.struct(F.element_at("names", i + 1).alias("k"), point(i).alias("v")))
    b = F.col("bbox")
    return notes.join(images, "image_id").select(
        "image_id", "file_name", F.col("id").alias("annotation_id"), b[0].alias("x1"), b[1].alias("y1"), (b[0] + b[2]).alias("x2"), (b[1] + b[3]).alias("y2"),
        F.map_from_entries(F.filter(entries, lambda e: e["v"]["c"] > 0)).alias("keypoints"),
    )


@reader("image_folders")
def image_folders(spark: SparkSession, path: str) -> DataFrame:
    """A folder for each identity: (path, identity, name, bytes), file contents unread. The driver lists the folders in
    path, tasks what is in them; as with Spark's own readers, names that begin with . or _ are left out. path is one
    that pyarrow.fs reaches."""
    system, root = opened(path)
    root = root.rstrip("/")
    prefix = "file:" if isinstance(system, fs.LocalFileSystem) else path.rstrip("/").removesuffix(root)

    def rows(infos: Iterable[fs.FileInfo]) -> Iterator[pa.RecordBatch]:
        seen = [f for f in infos if f.type == fs.FileType.File and not any(x[:1] in "._" for x in f.path[len(root) + 1 :].split("/"))]
        for k in range(0, len(seen), 10_000):
            part = seen[k : k + 10_000]
            folders, names = zip(*((("/" + f.path).rsplit("/", 2)[1:]) for f in part), strict=True)
            columns = [f"{prefix}{f.path}" for f in part], folders, names, [f.size for f in part]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["path", "identity", "name", "bytes"])

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = opened(path)[0]
        for batch in batches:
            for folder, deep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from rows(there.get_file_info(fs.FileSelector(folder, recursive=deep)))

    folders = [(f.path, True) for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory]
    asked = spark.createDataFrame([(root, False), *folders], "folder string, deep boolean")
    tasks = min(len(folders) + 1, 4 * spark.sparkContext.defaultParallelism)
    return asked.repartition(tasks).mapInArrow(listed, "path string, identity string, name string, bytes long")


def named(rows: DataFrame, column: str, pattern: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with fields taken from a column by the groups of a pattern, and the rows that do not match."""
    fits = F.col(column).rlike(f"^(?:{pattern})$")
    taken = {f: F.regexp_extract(column, f"^(?:{pattern})$", k + 1) for k, f in enumerate(fields)}
    return rows.filter(fits).withColumns(taken), rows.filter(~fits | F.col(column).isNull())


@reader("list_file")
def list_file(spark: SparkSession, path: str) -> DataFrame:
    """Blank-separated lines `name class species breed`; lines that begin with # are remarks."""
    lines = spark.read.text(path).filter("value <> '' AND NOT value LIKE '#%'")
    part = F.split(F.trim("value"), r"\s+")
    number = lambda k: F.try_element_at(part, F.lit(k + 1)).try_cast("int")
    return lines.select(part[0].alias("name"), number(1).alias("class"), number(2).alias("species"), number(3).alias("breed"), (F.size(part) == 4).alias("well_formed"))


@reader("jsonl")
def jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; with a schema a line that does not fit fails the read."""
    r = spark.read
    return (r.schema(schema).option("mode", "FAILFAST") if schema else r).json(path)


@reader("embedding_manifest")
def embedding_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document of parallel arrays -> rows (sample_id, identity, embedding, quality); arrays
    of different lengths fail."""
    doc = spark.read.schema("sample_ids array<string>, identities array<string>, embeddings array<array<double>>, qualities array<double>").option("multiLine", True).json(path)
    even = (F.size("sample_ids") == F.size("identities")) & (F.size("sample_ids") == F.size("embeddings"))
    zipped = F.when(even, F.arrays_zip("sample_ids", "identities", "embeddings", "qualities")).otherwise(
        F.raise_error(F.lit("parallel arrays differ in length"))
    )
    return doc.select(F.inline(zipped)).toDF("sample_id", "identity", "embedding", "quality")


@reader("csv_pairs")
def csv_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("left string, right string, label int").option("header", True).option("mode", "FAILFAST").csv(path)


def stream_facts(rows: DataFrame, column: str) -> DataFrame:
    """Facts of the first video stream in ffprobe's JSON: codec, width, height, fps (a rational),
    duration and bit rate, which fall back to those of the container."""
    schema = (
        "streams array<struct<codec_type: string, codec_name: string, width: int, height: int, avg_frame_rate: string, duration: string, bit_rate: string>>, "
        "format struct<duration: string, bit_rate: string>"
    )
    doc = rows.withColumn("_p", F.from_json(column, schema))
    video = F.try_element_at(F.filter("_p.streams", lambda s: s["codec_type"] == "video"), F.lit(1))
    rate = F.split("_v.avg_frame_rate", "/")
    number = lambda c: F.col(c).try_cast("double")
    return (
        doc.withColumn("_v", video)
        .withColumns(
            {
                "codec": F.col("_v.codec_name"), "width": F.col("_v.width"), "height": F.col("_v.height"),
                "fps": F.try_divide(F.try_element_at(rate, F.lit(1)).try_cast("double"), F.coalesce(F.try_element_at(rate, F.lit(2)).try_cast("double"), F.lit(1.0))),
                "duration": F.coalesce(number("_v.duration"), number("_p.format.duration")),
                "bit_rate": F.coalesce(number("_v.bit_rate"), number("_p.format.bit_rate")).cast("long"),
            }
        )
        .drop("_p", "_v")
    )


def gpu_samples(rows: DataFrame, column: str) -> DataFrame:
    """nvidia-smi CSV lines `index, memory MiB, power W, utilisation %`; [N/A] is null."""
    part = F.transform(F.split(column, ","), lambda x: F.trim(x))
    at = lambda k, kind: F.try_element_at(part, F.lit(k + 1)).try_cast(kind)
    return rows.withColumns({"device": at(0, "int"), "memory_mib": at(1, "double"), "power_w": at(2, "double"), "utilisation": at(3, "double")})


def decode_report(rows: DataFrame, column: str) -> DataFrame:
    """The last frame count, speed and times that an ffmpeg log tells."""
    last = lambda pattern: F.try_element_at(F.regexp_extract_all(column, F.lit(pattern), F.lit(1)), F.lit(-1))
    return rows.withColumns(
        {
            "frames": last(r"frame=\s*([0-9]+)").try_cast("long"), "speed": last(r"speed=\s*([0-9.]+)x").try_cast("double"),
            "user_s": last(r"utime=([0-9.]+)s").try_cast("double"), "real_s": last(r"rtime=([0-9.]+)s").try_cast("double"), "max_rss_kib": last(r"maxrss=([0-9]+)(?:KiB|kB)").try_cast("long"),
        }
    )


def timestamps(rows: DataFrame, column: str) -> DataFrame:
    """Decimal seconds, or N/A, as nanoseconds."""
    return rows.withColumn("timestamp_ns", (F.trim(column).try_cast("decimal(38,9)") * 1_000_000_000).cast("long"))


def write_manifest(df: DataFrame, path: str, key: list[str]) -> None:
    """Rows as canonical JSON lines, columns by name, sorted within files; an existing path is refused."""
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    df.sortWithinPartitions(*key).select(line.alias("value")).write.mode("error").text(path)


def write_csv(df: DataFrame, path: str, key: list[str]) -> None:
    """A small table as one RFC 4180 file: header, CRLF, quotes where needed, rows by key, columns by
    name. Line ends inside a value are written as CRLF too."""
    rows = df.select(*sorted(df.columns)).coalesce(1).sortWithinPartitions(*key)
    rows.write.mode("error").option("header", True).option("lineSep", "\r\n").option("escape", '"').option("emptyValue", "").csv(path)


@reader("region_candidates")
def region_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate regions with their arrays (image, scores, boxes); arrays of different lengths fail."""
    rows = spark.read.schema("image string, scores array<double>, boxes array<array<double>>").parquet(path)
    even = (F.size("scores") == F.size("boxes")) & F.forall("boxes", lambda b: F.size(b) == 4)
    zipped = F.when(even, F.arrays_zip("scores", "boxes")).otherwise(F.raise_error(F.lit("scores and boxes differ in shape")))
    return rows.select("image", F.posexplode(zipped).alias("place", "r")).select("image", "place", F.col("r.scores").alias("score"), F.col("r.boxes").alias("box"))


@reader("landmark_labels")
def landmark_labels(spark: SparkSession, path: str, points: int = 46, prefix: str = "face46", multi_line: bool = False) -> DataFrame:
    """Label documents (image, landmarks, bounding_boxes), one a line or, with multi_line, one a file, which
    then may leave out the image for the file's own name. Rows (image, landmarks name -> (x, y, 1), x1, y1,
    x2, y2, rule): points that are not finite are left out, a box with an empty value is null, and rule says
    POINTS or BOX where their number is wrong."""
    schema = "image string, landmarks array<array<double>>, bounding_boxes array<string>"
    doc = spark.read.schema(schema).option("multiLine", multi_line).option("allowNonNumericNumbers", True).json(path).withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    named = F.transform("landmarks", lambda p, i: F.struct(F.concat(F.lit(f"{prefix}."), i).alias("k"), F.struct(p[0].alias("x"), p[1].alias("y"), F.lit(1.0).alias("c")).alias("v")))
    box = F.transform("bounding_boxes", lambda x: x.try_cast("double"))
    whole = F.forall(box, lambda v: F.coalesce(fine(v), F.lit(False)))
    even = (F.size("landmarks") == points) & F.forall("landmarks", lambda p: F.size(p) == 2)
    rule = F.when(F.coalesce(~even, F.lit(True)), "POINTS").when(F.coalesce(F.size("bounding_boxes") != 4, F.lit(True)), "BOX")
    return doc.select(
        F.coalesce("image", F.regexp_replace("_file", r"\.[^.]*$", "")).alias("image"),
        F.when(rule.isNull(), F.map_from_entries(F.filter(named, lambda e: fine(e["v"]["x"]) & fine(e["v"]["y"])))).alias("landmarks"),
        *[F.when(rule.isNull() & whole, box[k]).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))],
        rule.alias("rule"),
    )


@reader("head_boxes")
def head_boxes(spark: SparkSession, path: str) -> DataFrame:
    """XML annotations (filename, size, one object with a box): (name, kind, pose, x1, y1, x2, y2, rule).
    rule says OBJECTS where there is not one object, BOX where its box is missing, empty or beyond the size."""
    schema = (
        "filename string, size struct<width: double, height: double>, object array<struct<name: string, pose: string, truncated: string, "
        "bndbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>>>"
    )
    doc = spark.read.format("xml").option("rowTag", "annotation").schema(schema).load(path).withColumn("_o", F.try_element_at("object", F.lit(1)))
    b, size = F.col("_o.bndbox"), F.col("size")
    inside = (b["xmin"] >= 0) & (b["xmin"] < b["xmax"]) & (b["xmax"] <= size["width"]) & (b["ymin"] >= 0) & (b["ymin"] < b["ymax"]) & (b["ymax"] <= size["height"])
    rule = F.when(F.coalesce(F.size("object") != 1, F.lit(True)), "OBJECTS").when(F.coalesce(~inside, F.lit(True)), "BOX")
    return doc.select(
        F.col("filename").alias("name"), F.col("_o.name").alias("kind"), F.col("_o.pose").alias("pose"), b["xmin"].alias("x1"), b["ymin"].alias("y1"), b["xmax"].alias("x2"), b["ymax"].alias("y2"), rule.alias("rule")
    )


@reader("split_list")
def split_list(spark: SparkSession, path: str) -> DataFrame:
    """CSV (filename, label) of a split, whose label is the number of the file's folder: (filename, identity,
    rule); another header fails, and rule says LABEL where they differ, REPEATED where a file comes twice."""
    rows = spark.read.schema("filename string, label string").option("header", True).option("enforceSchema", False).csv(path)
    folder = F.regexp_extract("filename", r"(?:^|/)([0-9]+)/[^/]+$", 1)
    n = rows.groupBy(F.col("filename").alias("_f")).agg(F.count("*").alias("_n"))
    wrong = (folder == "") | ~F.col("label").rlike("^[0-9]+$") | (folder.try_cast("long") != F.col("label").try_cast("long"))
    rule = F.when(F.coalesce(wrong, F.lit(True)), "LABEL").when(F.col("_n") > 1, "REPEATED")
    return rows.join(n, F.col("filename") == F.col("_f"), "left").select("filename", folder.alias("identity"), rule.alias("rule"))

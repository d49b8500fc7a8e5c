"""Readers and writers of the file formats, as DataFrames."""

from __future__ import annotations

import io
import json
import math
import os
import tarfile
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BOX_STRUCT = "array<struct<idx:int,cls:int,cx:double,cy:double,w:double,h:double>>"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return files is not None and len(files) > 0


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text; blank cells stay blank and never become null; a missing or empty file is an empty table."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "").csv(path, schema=schema, enforceSchema=True)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, compressed: bool = False) -> None:
    """Committed as a whole; blanks are written as such."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("compression", "gzip" if compressed else "none").csv(path)


def stripped(df: DataFrame) -> DataFrame:
    """Column names without the blanks around them."""
    return df.toDF(*[c.strip() for c in df.columns])


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per line, with ``file`` and ``line``. A broken last line of a file (a write that was cut) is left out; a broken line before it is an error when the row is read."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"file string, line bigint, value struct<{schema}>").select("file", "line", "value.*")
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    lines = text.select("file", F.posexplode(F.split("value", "\n")).alias("line", "raw")).where(F.trim("raw") != "")
    parsed = lines.withColumn("ok", F.try_parse_json("raw").isNotNull()).withColumn("value", F.from_json("raw", schema))
    last = lines.groupBy("file").agg(F.max("line").alias("last"))
    rows = parsed.join(F.broadcast(last), "file").where(F.col("ok") | (F.col("line") < F.col("last")))
    checked = F.when(F.col("ok"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("broken line "), F.col("line").cast("string"), F.lit(" of "), F.col("file"))))
    return rows.select("file", F.col("line").cast("bigint").alias("line"), checked.alias("value")).select("file", "line", "value.*")


def last_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of rows with the same key the last one in ``order``."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key an earlier run hasn't written yet; the rest of a job that is taken up again."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def _tokens(line: Column) -> Column:
    return F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != "")


def parse_labels(df: DataFrame, text: str = "text") -> DataFrame:
    """Lenient: label files as rows (idx, cls, cx, cy, w, h). Lines with fewer than five fields or without numbers are skipped, further fields ignored; a class may be written as a float and is cut."""
    lines = df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n")).alias("line", "raw")).withColumn("t", _tokens(F.col("raw"))).where(F.size("t") >= 5)
    numbers = F.transform(F.slice("t", 1, 5), lambda x: x.try_cast("double"))
    rows = lines.withColumn("v", numbers).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))))
    keep = [c for c in df.columns if c != text]
    place = F.row_number().over(Window.partitionBy(*keep).orderBy("line")) - 1 if keep else F.col("line")
    names = ("cx", "cy", "w", "h")
    return rows.select(*keep, place.cast("int").alias("idx"), F.col("v")[0].cast("int").alias("cls"), *[F.col("v")[i + 1].alias(n) for i, n in enumerate(names)])


def label_problems(df: DataFrame, text: str = "text", classes: int = 6) -> DataFrame:
    """Strict: one row (line, problem) per rule that a line breaks."""
    keep = [c for c in df.columns if c != text]
    lines = df.select(*keep, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n")).alias("line", "raw")).withColumn("t", _tokens(F.col("raw"))).where(F.size("t") > 0)
    lines = lines.withColumn("v", F.transform("t", lambda x: x.try_cast("double")))
    five = F.size("t") == 5
    numeric = F.forall("v", lambda x: x.isNotNull())
    finite = F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    good = five & numeric & finite
    v = lambda i: F.get("v", F.lit(i))
    rules = {
        "field_count": ~five, "not_numeric": five & ~numeric, "not_finite": five & numeric & ~finite, "class_id": good & ((v(0) != F.floor(v(0))) | (v(0) < 0) | (v(0) >= classes)),
        "out_of_range": good & F.exists(F.slice("v", 2, 4), lambda x: (x < 0) | (x > 1)), "no_extent": good & ((v(3) <= 0) | (v(4) <= 0)),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return lines.select(*keep, "line", F.explode(found).alias("problem"))


def format_labels(boxes: DataFrame, key: str, digits: int = 8) -> DataFrame:
    """(key, text): boxes as label files in the order of idx, without those of no extent, with a line end after each."""
    line = F.format_string(f"%d %.{digits}f %.{digits}f %.{digits}f %.{digits}f\n", "cls", "cx", "cy", "w", "h")
    rows = boxes.where("w > 0 and h > 0").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", line.alias("l")))).alias("a"))
    return rows.select(key, F.array_join(F.col("a.l"), "").alias("text"))


def read_voc(spark: SparkSession, path: str, classes: dict[str, int]) -> DataFrame:
    """Objects of annotation files: (file, idx, name, cls or null, cx, cy, w, h), clipped to the image. A size of zero gives null boxes."""
    schema = "filename string, size struct<width:double,height:double>, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
    rows = spark.read.format("xml").option("rowTag", "annotation").schema(schema).load(path)
    boxes = rows.select(F.col("filename").alias("file"), F.nullif("size.width", F.lit(0.0)).alias("W"), F.nullif("size.height", F.lit(0.0)).alias("H"), F.posexplode("object").alias("idx", "o"))
    cls = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])[F.lower(F.trim("o.name"))]
    clip = lambda c, size: F.least(F.greatest(F.col(f"o.bndbox.{c}") / F.col(size), F.lit(0.0)), F.lit(1.0))
    boxes = boxes.select("file", "idx", F.col("o.name").alias("name"), cls.alias("cls"), *[clip(c, s).alias(c) for c, s in (("xmin", "W"), ("ymin", "H"), ("xmax", "W"), ("ymax", "H"))])
    return boxes.select("file", "idx", "name", "cls", ((F.col("xmin") + F.col("xmax")) / 2).alias("cx"), ((F.col("ymin") + F.col("ymax")) / 2).alias("cy"), (F.col("xmax") - F.col("xmin")).alias("w"), (F.col("ymax") - F.col("ymin")).alias("h"))


COCO = "images array<struct<id:bigint,file_name:string,width:double,height:double>>, annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>>>, categories array<struct<id:bigint,name:string>>"


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, annotation_id, category, cx, cy, w, h) of the three lists of a COCO document."""
    doc = spark.read.schema(COCO).option("multiLine", True).json(path)
    images = doc.select(F.explode("images").alias("i")).select("i.*").withColumnRenamed("id", "image_id")
    notes = doc.select(F.explode("annotations").alias("a")).select(F.col("a.id").alias("annotation_id"), "a.image_id", "a.category_id", "a.bbox")
    names = doc.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("category"))
    rows = notes.join(images, "image_id").join(names, "category_id", "left")
    b = lambda i: F.col("bbox")[i]
    return rows.select("file_name", "annotation_id", "category", ((b(0) + b(2) / 2) / F.col("width")).alias("cx"), ((b(1) + b(3) / 2) / F.col("height")).alias("cy"), (b(2) / F.col("width")).alias("w"), (b(3) / F.col("height")).alias("h"))


def to_coco(boxes: DataFrame, sizes: DataFrame, names: list[str]) -> DataFrame:
    """Rows (part, value): the images, annotations and categories of a COCO document as JSON, one row each, so that a document of any size can be written in parallel."""
    images = sizes.select(F.lit("images").alias("part"), F.to_json(F.struct(F.col("image").alias("id"), F.format_string("%d.jpg", "image").alias("file_name"), "width", "height")).alias("value"))
    rows = boxes.join(sizes, "image")
    box = F.array((F.col("cx") - F.col("w") / 2) * F.col("width"), (F.col("cy") - F.col("h") / 2) * F.col("height"), F.col("w") * F.col("width"), F.col("h") * F.col("height"))
    notes = rows.select(F.lit("annotations").alias("part"), F.to_json(F.struct((F.col("image") * 1000 + F.col("idx")).alias("id"), F.col("image").alias("image_id"), F.col("cls").alias("category_id"), box.alias("bbox"), F.lit(0).alias("iscrowd"))).alias("value"))
    spark = boxes.sparkSession
    kinds = spark.createDataFrame([(json.dumps({"id": i, "name": n}),) for i, n in enumerate(names)], "value string").select(F.lit("categories").alias("part"), "value")
    return images.unionByName(notes).unionByName(kinds)


def predictions(df: DataFrame) -> DataFrame:
    """Parallel arrays (image, cls, conf, xywhn) as rows (image, idx, cls, conf, cx, cy, w, h)."""
    rows = df.select("image", F.posexplode(F.arrays_zip("cls", "conf", "xywhn")).alias("idx", "p"))
    return rows.select("image", "idx", F.col("p.cls").alias("cls"), F.col("p.conf").alias("conf"), *[F.col("p.xywhn")[i].alias(n) for i, n in enumerate(("cx", "cy", "w", "h"))])


def _walk(value) -> Iterator[dict]:
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if all(k in x for k in ("x", "y", "width", "height")):
                yield x
                continue
            stack += list(x.values())[::-1]
        elif isinstance(x, list):
            stack += x[::-1]


def _number(x) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def nested_boxes(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Boxes found at any depth of JSON texts: (key, idx, x1, y1, x2, y2, name, cls, conf). A class or confidence that is no number is -1 or null; text that isn't JSON has no boxes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text in zip(batch[key], batch[payload], strict=True):
                try:
                    doc = json.loads(text)
                except (TypeError, ValueError):
                    continue
                idx = 0
                for b in _walk(doc):
                    x, y, w, h = (_number(b[c]) for c in ("x", "y", "width", "height"))
                    if None in (x, y, w, h):
                        continue
                    name = next((str(b[c]) for c in ("class", "class_name", "label") if b.get(c) is not None), None)
                    cls = _number(b.get("class_id", b.get("class_index")))
                    conf = _number(b.get("confidence", b.get("score")))
                    out.append((k, idx, x - w / 2, y - h / 2, x + w / 2, y + h / 2, name, -1 if cls is None else int(cls), conf))
                    idx += 1
            yield pd.DataFrame(out, columns=["k", "idx", "x1", "y1", "x2", "y2", "name", "cls", "conf"])

    kind = dict(df.dtypes)[key]
    return df.select(key, payload).mapInPandas(run, f"k {kind}, idx int, x1 double, y1 double, x2 double, y2 double, name string, cls int, conf double").withColumnRenamed("k", key)


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, suffix, content, copies) of tar and zip files: of members with one suffix (last two parts of the path) the first stays, with how many there are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                out = []
                if name.endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        out = [(name, n, i, z.read(n)) for i, n in enumerate(z.namelist()) if not n.endswith("/")]
                else:
                    with tarfile.open(fileobj=io.BytesIO(data)) as t:
                        out = [(name, m.name, i, t.extractfile(m).read()) for i, m in enumerate(t.getmembers()) if m.isfile()]
                yield pd.DataFrame(out, columns=["archive", "member", "place", "content"])

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, place int, content binary")
    rows = rows.withColumn("suffix", F.substring_index("member", "/", -2))
    first = rows.groupBy("archive", "suffix").agg(F.min_by(F.struct("member", "content"), "place").alias("m"), F.count("*").alias("copies"))
    return first.select("archive", "m.member", "suffix", "m.content", "copies")


def write_archive(rows: Iterable[tuple[str, bytes]], path: str) -> None:
    """A tar.gz or zip whose bytes depend on names and contents alone: sorted, without times."""
    import gzip

    items = sorted(rows)
    temporary = path + ".part"
    if path.endswith(".zip"):
        with zipfile.ZipFile(temporary, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in items:
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    else:
        with open(temporary, "wb") as raw, gzip.GzipFile(fileobj=raw, mode="wb", mtime=0, filename="") as packed, tarfile.open(fileobj=packed, mode="w") as t:
            for name, data in items:
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    os.replace(temporary, path)

"""Files: formats by extension, validation, routing, upload rules. Bad files become rows with an error, not failures."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Formats by extension, extensions that may be uploaded, and the upload cap.
FORMATS = {"pdf": "pdf", "docx": "docx", "png": "image", "jpg": "image", "jpeg": "image", "tiff": "image", "tif": "image", "bmp": "image"}
UPLOADS = ("pdf", "docx")
UPLOAD_CAP = 16 * 1024 * 1024
ROUTED = ("pdf", "docx")


def guessed_formats() -> dict[str, str]:
    """Formats that a MIME type settles, by extension, for extensions without a format of their own."""
    out = {}
    for ext, kind in mimetypes.types_map.items():
        name = ext[1:].lower()
        if name in FORMATS:
            continue
        if kind.startswith("image/"):
            out[name] = "image"
        elif kind == "application/pdf":
            out[name] = "pdf"
        elif kind == "application/vnd.openxmlformats-officedocument.wordprocessingml.document":
            out[name] = "docx"
    return out


def suffix(path: Column) -> Column:
    """The lower-cased extension without its dot: after the last dot of the name, '' for a name that begins with its only dot."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def format_of(path: Column) -> Column:
    table = FORMATS | guessed_formats()
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(pairs, suffix(path))


def format_error(path: Column) -> Column:
    return F.when(format_of(path).isNull(), F.concat(F.lit("Unknown file format: "), path))


def route_error(path: Column) -> Column:
    fmt = format_of(path)
    return F.coalesce(format_error(path), F.when(~fmt.isin(*ROUTED), F.concat(F.lit("Unsupported format: "), fmt)))


def allowed_upload(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin(*UPLOADS)


def within_cap(length: Column) -> Column:
    return length <= UPLOAD_CAP


def file_type(name: Column) -> Column:
    return F.when(F.lower(name).endswith(".pdf"), "pdf").otherwise("docx")


def missing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths (or patterns) that name nothing, in any store that Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if not at.getFileSystem(conf).globStatus(at):
            out.append(p)
    return out


def load_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, format, length, content, error of the files under paths; a path that names nothing is a row with an error."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    gone = missing(spark, paths)
    there = [p for p in paths if p not in gone]
    p = F.col("path")
    if there:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(there)
    else:
        raw = spark.createDataFrame([], "path string, length long, content binary")
    out = raw.select("path", format_of(p).alias("format"), "length", "content", route_error(p).alias("error"))
    if not gone:
        return out
    rows = spark.createDataFrame([(x,) for x in gone], "path string")
    lost = rows.select("path", format_of(p).alias("format"), F.lit(None).cast("long").alias("length"), F.lit(None).cast("binary").alias("content"), F.concat(F.lit("File not found: "), p).alias("error"))
    return out.unionByName(lost)

"""Reading image folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted file extensions.
EXTENSIONS = ["png", "jpg", "jpeg", "bmp", "gif", "webp"]


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def split_allowed(files: DataFrame, name: str = "filename") -> tuple[DataFrame, DataFrame]:
    """Files with an accepted extension, and the others with a reason."""
    allowed = extension(F.col(name)).isin(EXTENSIONS)
    reason = F.concat(F.col(name), F.lit(" - Unsupported format (use PNG, JPG, BMP, GIF, WebP)"))
    return files.where(allowed), files.where(~allowed).withColumn("error", reason)


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, format, width, height, channels, size_bytes, status, image) per file.

    A file that cannot be decoded stays in the result with status ``invalid``.
    The length comes from the file listing; contents are read once, by the decoder.
    """
    decoded = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(folder)
    lengths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    image = F.col("image")
    rows = decoded.select(_plain(image["origin"]).alias("path"), "image").join(
        lengths.select(_plain(F.col("path")).alias("path"), "length"), "path")
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(
        name.alias("filename"), extension(name).alias("format"), image["width"].alias("width"), image["height"].alias("height"),
        image["nChannels"].alias("channels"), F.col("length").alias("size_bytes"),
        F.when(image["height"] > 0, "ok").otherwise("invalid").alias("status"), "image")

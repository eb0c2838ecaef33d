"""Statistics of image collections and features of single images."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.functions.scalars import ratio
from sondage.operators import profile

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Gradient size from which a pixel counts as an edge, and the width of the grey-level histogram.
EDGE_GRADIENT = 100.0
LEVELS = 256


def fingerprint(metadata: DataFrame) -> DataFrame:
    """One row over the metadata table (filename, format, width, height, size_bytes, channels)."""
    counts = metadata.groupBy("format").agg(F.count(F.lit(1)).alias("n"))
    formats = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("format", "n"))))).scalar()
    channels = metadata.groupBy("channels").agg(F.count(F.lit(1)).alias("n"))
    mode = channels.agg(F.min_by("channels", F.struct(-F.col("n"), F.col("channels")))).scalar()
    size = F.avg("size_bytes")
    return metadata.agg(
        F.count(F.lit(1)).alias("n_images"), F.avg("width").alias("avg_width"), F.avg("height").alias("avg_height"),
        (size / 1024).alias("avg_size_kb"), (F.sum("size_bytes") / (1024 * 1024)).alias("total_mb"),
        F.stddev_samp("width").alias("width_std"), F.stddev_samp("height").alias("height_std"),
        F.avg(F.col("width") / F.col("height")).alias("aspect_ratio_mean"),
        (F.count_if(F.col("channels") == 1) > 0).alias("has_grayscale"),
        (F.count_if(F.col("channels") >= 3) > 0).alias("has_color"),
        ratio(F.stddev_samp("size_bytes"), size).alias("size_variability"),
    ).select("*", mode.alias("channels_mode"), formats.alias("format_distribution"))


def meta_features(metadata: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(filename, width, height, channels, size_kb, aspect_ratio[, label])."""
    rows = metadata.select(
        "filename", "width", "height", "channels", (F.col("size_bytes") / 1024).alias("size_kb"),
        F.try_divide(F.col("width").cast("double"), F.col("height").cast("double")).alias("aspect_ratio"))
    return rows if labels is None else rows.join(labels, "filename", "left")


def size_outliers(metadata: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Files whose size is outside mean +- 3 sample standard deviations."""
    facts = metadata.agg(F.struct(F.avg("size_bytes").alias("m"), F.stddev_samp("size_bytes").alias("s"))).scalar()
    away = F.abs(F.col("size_bytes") - facts["m"])
    return metadata.where(away > sigmas * facts["s"])


def histograms(metadata: DataFrame) -> DataFrame:
    """(feature, bin, low, high, n): width and height in 30 bins, bytes in 20, aspect ratio in 25."""
    rows = metadata.withColumn("aspect_ratio", F.col("width") / F.col("height"))
    parts = [(["width", "height"], 30), (["size_bytes"], 20), (["aspect_ratio"], 25)]
    return profile.union_all([profile.histogram(rows, names, bins, fixed=True) for names, bins in parts])


def format_counts(metadata: DataFrame) -> DataFrame:
    return metadata.groupBy("format").agg(F.count(F.lit(1)).alias("n"))


def _grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Grey levels 0-255; Spark stores pixels row by row in BGR order."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels).astype("float64")
    if channels == 1:
        return pixels[:, :, 0]
    return np.round(pixels[:, :, 0] * 0.114 + pixels[:, :, 1] * 0.587 + pixels[:, :, 2] * 0.299)


def _measure(grey: np.ndarray) -> tuple:
    counts = np.bincount(grey.astype("int64").ravel(), minlength=LEVELS)
    share = counts[counts > 0] / grey.size
    padded = np.pad(grey, 1, mode="reflect" if min(grey.shape) > 1 else "edge")
    up, down, left, right = padded[:-2, 1:-1], padded[2:, 1:-1], padded[1:-1, :-2], padded[1:-1, 2:]
    laplacian = up + down + left + right - 4 * grey
    gradient = np.abs(right - left) + np.abs(down - up)
    return (
        grey.mean(), grey.std(), grey.max() - grey.min(), float(-(share * np.log2(share)).sum()),
        int((counts > np.percentile(counts, 90)).sum()), laplacian.var(), float((gradient > EDGE_GRADIENT).mean()),
    )


def pixel_features(scanned: DataFrame) -> DataFrame:
    """Brightness, contrast, entropy, histogram peaks, texture and edge density of each decodable image.

    Images are decoded by Spark; a task measures one image at a time.
    """
    names = ["brightness_mean", "brightness_std", "contrast", "entropy", "histogram_peaks", "texture_variance", "edge_density"]
    schema = ("filename string, brightness_mean double, brightness_std double, contrast double, entropy double, "
              "histogram_peaks int, texture_variance double, edge_density double")

    def measure(frames):
        for frame in frames:
            rows = [
                _measure(_grey(d, h, w, c))
                for d, h, w, c in zip(frame["data"], frame["height"], frame["width"], frame["channels"])]
            yield pd.DataFrame(rows, columns=names).assign(filename=frame["filename"].to_numpy())[["filename", *names]]

    valid = scanned.where(F.col("status") == "ok").select("filename", "height", "width", "channels", F.col("image.data").alias("data"))
    return valid.mapInPandas(measure, schema)

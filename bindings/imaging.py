"""Images: a metadata table derived from parts, and picture files derived from suppliers."""

import struct
import sys
import zlib
from pathlib import Path

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from bindings.profiling import rounded
from bindings.registry import query
from sondage.operators import images
from sondage.plans.durable import scratch_path
from sondage.sources import images as source

cloudpickle.register_pickle_by_value(sys.modules[__name__])

META = """meta AS (SELECT 'img_' || p_partkey || '.' || ['png', 'jpg', 'jpeg', 'bmp', 'gif', 'webp', 'txt'][p_partkey % 7 + 1] AS filename,
  upper(['png', 'jpg', 'jpeg', 'bmp', 'gif', 'webp', 'txt'][p_partkey % 7 + 1]) AS format, (16 + p_partkey * 13 % 640)::INT AS width, (16 + p_partkey * 7 % 480)::INT AS height,
  (CASE WHEN p_partkey % 97 = 0 THEN 9000000 ELSE 1000 + p_partkey * 31 % 50000 END)::BIGINT AS size_bytes, (CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 3 END)::INT AS channels, p_type FROM part)"""


def metadata(t):
    key = F.col("p_partkey")
    ext = F.element_at(F.array(*[F.lit(e) for e in [*source.EXTENSIONS, "txt"]]), (key % 7 + 1).cast("int"))
    return t.part.select(
        F.concat(F.lit("img_"), key.cast("string"), F.lit("."), ext).alias("filename"), F.upper(ext).alias("format"),
        (16 + key * 13 % 640).cast("int").alias("width"), (16 + key * 7 % 480).cast("int").alias("height"),
        F.when(key % 97 == 0, 9000000).otherwise(1000 + key * 31 % 50000).cast("long").alias("size_bytes"),
        F.when(key % 3 == 0, 1).otherwise(3).cast("int").alias("channels"), "p_type")


@query("image_fingerprint", f"""WITH {META} SELECT count(*) AS n_images, round(avg(width), 4) AS avg_width, round(avg(height), 4) AS avg_height,
  round(avg(size_bytes) / 1024, 4) AS avg_size_kb, round(sum(size_bytes) / (1024 * 1024)::DOUBLE, 4) AS total_mb, round(stddev_samp(width), 4) AS width_std,
  round(stddev_samp(height), 4) AS height_std, round(avg(width / height::DOUBLE), 5) AS aspect_ratio_mean, count_if(channels = 1) > 0 AS has_grayscale,
  count_if(channels >= 3) > 0 AS has_color, round(stddev_samp(size_bytes) / avg(size_bytes), 5) AS size_variability,
  (SELECT channels FROM meta GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS channels_mode,
  (SELECT string_agg(format || '=' || n, ',' ORDER BY format) FROM (SELECT format, count(*) AS n FROM meta GROUP BY 1)) AS format_distribution FROM meta""")
def _(t):
    out = images.fingerprint(metadata(t))
    pairs = F.transform(F.array_sort(F.map_entries("format_distribution")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    out = out.withColumn("format_distribution", F.array_join(pairs, ","))
    out = rounded(out, 4, "avg_width", "avg_height", "avg_size_kb", "total_mb", "width_std", "height_std")
    return rounded(out, 5, "aspect_ratio_mean", "size_variability")


@query("image_meta_features", f"""WITH {META} SELECT filename, width, height, channels, round(size_bytes / 1024.0::DOUBLE, 4) AS size_kb, round(width / height::DOUBLE, 5) AS aspect_ratio, p_type AS label FROM meta""")
def _(t):
    meta = metadata(t)
    out = images.meta_features(meta, meta.select("filename", F.col("p_type").alias("label")))
    return rounded(rounded(out, 4, "size_kb"), 5, "aspect_ratio")


@query("image_size_outliers", f"""WITH {META} SELECT filename, size_bytes FROM meta, (SELECT avg(size_bytes) AS m, stddev_samp(size_bytes) AS s FROM meta) WHERE abs(size_bytes - m) > 3 * s""")
def _(t):
    return images.size_outliers(metadata(t)).select("filename", "size_bytes")


def _hist(feature, value, bins):
    return f"""SELECT '{feature}' AS feature, g.bin, round(lo + w * g.bin, 4) AS low, coalesce(n, 0) AS n FROM (SELECT unnest(range({bins})) AS bin) g
  CROSS JOIN (SELECT min({value}) AS lo, (max({value}) - min({value})) / {bins}.0::DOUBLE AS w FROM meta)
  LEFT JOIN (SELECT least(floor(({value} - lo) / w), {bins - 1})::BIGINT AS bin, count(*) AS n FROM meta, (SELECT min({value}) AS lo,
    (max({value}) - min({value})) / {bins}.0::DOUBLE AS w FROM meta) GROUP BY 1) c ON g.bin = c.bin"""


@query("image_histograms", f"WITH {META} " + " UNION ALL ".join([
    _hist("width", "width::DOUBLE", 30), _hist("height", "height::DOUBLE", 30), _hist("size_bytes", "size_bytes::DOUBLE", 20),
    _hist("aspect_ratio", "(width / height::DOUBLE)", 25)]))
def _(t):
    return rounded(images.histograms(metadata(t)).drop("high"), 4, "low")


@query("image_format_counts", f"WITH {META} SELECT format, count(*) AS n FROM meta GROUP BY 1")
def _(t):
    return images.format_counts(metadata(t))


@query("image_reject", f"""WITH {META} SELECT filename, format <> 'TXT' AS accepted, CASE WHEN format = 'TXT' THEN filename || ' - Unsupported format (use PNG, JPG, BMP, GIF, WebP)' END AS error FROM meta""")
def _(t):
    good, bad = source.split_allowed(metadata(t))
    return good.select("filename", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("error")).unionByName(
        bad.select("filename", F.lit(False).alias("accepted"), "error"))


# -- files ---------------------------------------------------------------------------------------


def _png(width, height, rows):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    data = zlib.compress(b"".join(b"\0" + r for r in rows))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", data) + chunk(b"IEND", b"")


def pictures(t):
    """One grey picture per supplier, written by tasks below the shared scratch folder.

    Pixel (x, y) of supplier s is (s * 7 + x * 11 + y * 5) % 256; every tenth file is broken.
    """
    folder = scratch_path(t.spark, "pictures")
    plain = folder.removeprefix("file:")
    if "://" in plain:
        raise ValueError("the picture files need a shared folder that is mounted as a file system")

    def paint(frames):
        Path(plain).mkdir(parents=True, exist_ok=True)
        for frame in frames:
            for s in frame["s_suppkey"]:
                width, height = int(8 + s % 9), int(8 + s % 5)
                rows = [bytes((s * 7 + x * 11 + y * 5) % 256 for x in range(width)) for y in range(height)]
                body = b"not a picture" if s % 10 == 3 else _png(width, height, rows)
                Path(f"{plain}/supplier_{s}.png").write_bytes(body)
            yield pd.DataFrame({"n": [len(frame)]})

    t.supplier.select("s_suppkey").mapInPandas(paint, "n long").agg(F.sum("n")).collect()
    return folder


@query("image_scan", """SELECT 'supplier_' || s_suppkey || '.png' AS filename, 'png' AS format, CASE WHEN s_suppkey % 10 = 3 THEN -1 ELSE 8 + s_suppkey % 9 END::INT AS width,
  CASE WHEN s_suppkey % 10 = 3 THEN -1 ELSE 8 + s_suppkey % 5 END::INT AS height, CASE WHEN s_suppkey % 10 = 3 THEN -1 ELSE 1 END::INT AS channels,
  CASE WHEN s_suppkey % 10 = 3 THEN 'invalid' ELSE 'ok' END AS status FROM supplier""")
def _(t):
    return source.scan(t.spark, pictures(t)).drop("image", "size_bytes")


@query("image_pixel_features", """WITH px AS (SELECT s_suppkey, (s_suppkey * 7 + x * 11 + y * 5) % 256 AS v FROM supplier, (SELECT unnest(range(16)) AS x), (SELECT unnest(range(12)) AS y)
   WHERE s_suppkey % 10 <> 3 AND x < 8 + s_suppkey % 9 AND y < 8 + s_suppkey % 5),
  c AS (SELECT s_suppkey, v, count(*) AS n FROM px GROUP BY ALL),
  h AS (SELECT s_suppkey, v, n / (sum(n) OVER (PARTITION BY s_suppkey))::DOUBLE AS p FROM c),
  e AS (SELECT s_suppkey, -sum(p * log2(p)) AS entropy FROM h GROUP BY 1)
  SELECT 'supplier_' || px.s_suppkey || '.png' AS filename, round(avg(v), 5) AS brightness_mean, round(stddev_pop(v), 5) AS brightness_std,
   (max(v) - min(v))::DOUBLE AS contrast, round(any_value(entropy), 5) AS entropy FROM px JOIN e ON px.s_suppkey = e.s_suppkey GROUP BY px.s_suppkey""")
def _(t):
    out = images.pixel_features(source.scan(t.spark, pictures(t)))
    return rounded(out.select("filename", "brightness_mean", "brightness_std", "contrast", "entropy"), 5, "brightness_mean", "brightness_std", "entropy")

"""Images as rows, and the one Arrow stage that measures them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Figures of each kernel, with their types.
FIGURES = {
    "basic": "blur double, brightness double, contrast double, white_space double",
    "edges": "edge_density double, thick double, irregularity double, skew double",
    "hand": "stroke double, baseline double, spacing double, component double, hw double",
    "grid": "hot_regions int",
    "brisque": "brisque double",
    "barcode": "peak_count int, has_barcode boolean",
    "seals": "seal_count int, has_seal boolean",
    "tables": "h_lines double, v_lines double, has_table boolean",
}

#: The same for parts of kernels; they are measured only where they are named.
PARTS = {
    "edge_mass": "edge_density double, thick double, irregularity double",
    "skew": "skew double",
    "component": "component double",
}


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``origin``, ``height``, ``width``, ``n_channels``, ``data``; unreadable files have null sizes."""
    image = spark.read.format("image").load(path).select("image.*")
    good = F.col("height") > 0
    return image.select("origin", *[F.when(good, F.col(c)).alias(n) for c, n in (("height", "height"), ("width", "width"), ("nChannels", "n_channels"), ("data", "data"))])


def image_info(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``origin``, ``width``, ``height``, ``format`` (by the name), ``mode`` (by channels), ``size_bytes``."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("origin"), F.col("length").alias("size_bytes"))
    mode = F.element_at(F.create_map(*[F.lit(x) for pair in ((1, "L"), (3, "RGB"), (4, "RGBA")) for x in pair]), F.col("n_channels"))
    # the two sources write a local path with one slash or with three
    same = lambda c: F.regexp_replace(c, "^([a-z]+:)/+", "$1/")
    sizes = read_images(spark, path).select(same("origin").alias("_origin"), "width", "height", mode.alias("mode"))
    return files.join(sizes, same("origin") == F.col("_origin"), "left").select("origin", "width", "height", F.upper(F.substring_index("origin", ".", -1)).alias("format"), "mode", "size_bytes")


def features(images: DataFrame, key: str = "origin", kernels: list[str] | None = None) -> DataFrame:
    """Page figures (of all kernels, or of some), one row per image; null figures where there is no image. One Python stage for all."""
    known = FIGURES if kernels is None else FIGURES | PARTS
    chosen = [k for k in known if kernels is None or k in kernels]
    schema = ", ".join(known[k] for k in chosen)
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"int": "Int32", "boolean": "boolean"}
    casts = {"height": "Int32", "width": "Int32"} | {x.split()[0]: types[x.split()[1]] for x in schema.split(", ") if x.split()[1] in types}

    def run(parts):
        from pagewright.functions import kernels as K

        for part in parts:
            rows = []
            for k, h, w, n, data in part.itertuples(index=False):
                g = None if data is None or pd.isna(h) else K.gray(bytes(data), int(h), int(w), int(n))
                rows.append({"key": k, "height": None if g is None else int(h), "width": None if g is None else int(w), **({} if g is None else K.features(g, chosen))})
            yield pd.DataFrame(rows, columns=["key", "height", "width", *names]).astype(casts)

    kind = dict(images.dtypes)[key]
    narrow = images.select(F.col(key).alias("key"), "height", "width", "n_channels", "data")
    return narrow.mapInPandas(run, f"key {kind}, height int, width int, {schema}").withColumnRenamed("key", key)

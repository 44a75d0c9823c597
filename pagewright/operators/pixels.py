"""Pixel kernels that are plain relational algebra, over (image, y, x, v) rows of gray values.

Sums of integers come first and one division last, so that results do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pixels_of(embeddings: DataFrame, width: int = 8) -> DataFrame:
    """Gray images, 8x8 by default, from vectors of 64 numbers."""
    cells = embeddings.select("vec_id", F.posexplode("embedding").alias("i", "e"))
    v = F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (F.col("e").cast("double") * 4 + 0.5) * 255))).cast("long")
    return cells.select("vec_id", F.expr(f"i div {width}").cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"), v.alias("v"))


def variance(x: Column) -> Column:
    """Population variance of integers."""
    n = F.count(x)
    return (n * F.sum(x * x) - F.sum(x) * F.sum(x)).cast("double") / (n * n).cast("double")


def brightness(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("vec_id").agg((F.sum("v").cast("double") / F.count("v")).alias("brightness"))


def contrast(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("vec_id").agg(F.sqrt(variance(F.col("v"))).alias("contrast"))


def white_space(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("vec_id").agg((F.count_if(F.col("v") > 240) * 100 / F.count("*")).alias("white_space"))


def laplacian_blur(pixels: DataFrame) -> DataFrame:
    """Variance of the 3x3 Laplacian; beyond the border the image is mirrored without repeating the edge.

    Each pixel hands its value to the places that need it, mirrored places included, and the shares are summed: one
    aggregation, no self-join.
    """
    size = Window.partitionBy("vec_id")
    p = pixels.withColumns({"h": F.max("y").over(size) + 1, "w": F.max("x").over(size) + 1})

    def along(axis: str, n: str) -> Column:
        # who reads this pixel: its two neighbours, and a border pixel reads its one neighbour twice
        at, last = F.col(axis), F.col(n) - 1
        weight = lambda to: F.when((to == 0) | (to == last), F.when(last == 0, 0).otherwise(2)).otherwise(1)
        sides = [F.when((at + d >= 0) & (at + d <= last), F.struct((at + d).alias("to"), weight(at + d).alias("k"))) for d in (-1, 1)]
        return F.array_compact(F.array(*sides))

    centre = p.select("vec_id", "y", "x", (F.col("v") * -4).alias("part"))
    rows = p.select("vec_id", "x", "v", F.explode(along("y", "h")).alias("s")).select("vec_id", F.col("s.to").alias("y"), "x", (F.col("v") * F.col("s.k")).alias("part"))
    cols = p.select("vec_id", "y", "v", F.explode(along("x", "w")).alias("s")).select("vec_id", "y", F.col("s.to").alias("x"), (F.col("v") * F.col("s.k")).alias("part"))
    lap = centre.unionByName(rows).unionByName(cols).groupBy("vec_id", "y", "x").agg(F.sum("part").alias("l"))
    return lap.groupBy("vec_id").agg(variance(F.col("l")).alias("blur"))


def _cv(values: Column) -> Column:
    return F.sqrt(variance(values)) / (F.sum(values).cast("double") / F.count(values)) * 100


def baseline_score(pixels: DataFrame) -> DataFrame:
    """Spread of the distances between text rows: rows with more than 0.3 of the most dark pixels; 0 for fewer than two."""
    rows = pixels.groupBy("vec_id", "y").agg(F.count_if(F.col("v") < 128).alias("n"))
    rows = rows.withColumn("most", F.max("n").over(Window.partitionBy("vec_id"))).where(F.col("n") * 10 > F.col("most") * 3)
    gaps = rows.withColumn("gap", (F.col("y") - F.lag("y").over(Window.partitionBy("vec_id").orderBy("y"))).cast("long"))
    scored = gaps.groupBy("vec_id").agg(F.least(_cv(F.col("gap")) * 1.5, F.lit(60.0)).alias("baseline"))
    return pixels.select("vec_id").distinct().join(scored, "vec_id", "left").select("vec_id", F.coalesce("baseline", F.lit(0.0)).alias("baseline"))


def spacing_score(pixels: DataFrame, least_gap: int = 5) -> DataFrame:
    """Spread of the distances (above ``least_gap``) between empty columns: those with less than 0.1 of the most dark pixels."""
    cols = pixels.groupBy("vec_id", "x").agg(F.count_if(F.col("v") < 128).alias("n"))
    cols = cols.withColumn("most", F.max("n").over(Window.partitionBy("vec_id"))).where(F.col("n") * 10 < F.col("most"))
    gaps = cols.withColumn("gap", (F.col("x") - F.lag("x").over(Window.partitionBy("vec_id").orderBy("x"))).cast("long")).where(F.col("gap") > least_gap)
    scored = gaps.groupBy("vec_id").agg(F.least(_cv(F.col("gap")), F.lit(100.0)).alias("spacing"))
    return pixels.select("vec_id").distinct().join(scored, "vec_id", "left").select("vec_id", F.coalesce("spacing", F.lit(0.0)).alias("spacing"))

"""Files that arrive, by upload or from urls: one row each, with the reason why it is refused.

Nothing is fetched here: a provider brings the relation of downloads, and files are read by Spark's own sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import files
from pagewright.functions.thresholds import DEFAULTS, Thresholds

MIB = 1024 * 1024


def megabytes(length: Column) -> Column:
    """A size in MB with two places."""
    return F.format_string("%.2f", length / MIB)


def read_uploads(spark: SparkSession, path: str, t: Thresholds = DEFAULTS) -> DataFrame:
    """One row per file below ``path`` (one file, a folder or a glob): ``path``, ``filename``, ``length``, ``content``, ``error``."""
    raw = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return with_upload_errors(raw.select("path", name.alias("filename"), "length", "content"), t)


def with_upload_errors(uploads: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Adds ``error`` (null: accepted) from ``filename`` and ``length``."""
    name = F.coalesce("filename", F.lit(""))
    error = (
        F.when(F.trim(name) == "", "No file selected").when(~files.allowed_file(name), "Invalid file type")
        .when(files.too_large(F.col("length"), t), F.concat(F.lit("File too large. Maximum size: "), F.lit(str(t.max_bytes / MIB)), F.lit("MB")))
    )
    return uploads.withColumn("error", error)


def with_download_errors(downloads: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Adds ``error`` (null: downloaded), ``extension`` and ``saved_as``.

    Needs ``url``, ``filename`` (null: the url's fingerprint stands in), ``failure`` (null, ``timeout``, ``connection`` or other text), ``status``,
    ``reason``, ``content_type``, ``content_length`` (null: not told) and ``length`` (of what came).
    """
    c = F.col
    limit = F.lit(f"{t.max_bytes / MIB:.2f}")
    large = lambda n: F.concat(F.lit("File too large ("), megabytes(n), F.lit("MB). Maximum size: "), limit, F.lit("MB"))
    error = (
        F.when(~files.url_is_valid(c("url")), "Invalid URL format")
        .when(c("failure") == "timeout", "Request timeout").when(c("failure") == "connection", "Connection error - could not reach the server")
        .when(c("failure").isNotNull(), F.concat(F.lit("Request error: "), c("failure")))
        .when(c("status") >= 400, F.concat(F.lit("HTTP error: "), c("status").cast("string"), F.lit(" - "), F.coalesce("reason", F.lit(""))))
        .when(c("content_length") > t.max_bytes, large(c("content_length"))).when(c("length") > t.max_bytes, large(c("length")))
    )
    extension = F.coalesce(files.url_extension(c("url")), files.content_type_extension(c("content_type")), F.lit("pdf"))
    name = F.coalesce(F.when(c("filename") != "", c("filename")), F.hex(F.xxhash64("url")))
    df = downloads.withColumns({"error": error, "extension": extension})
    return df.withColumn("saved_as", F.when(c("error").isNull(), F.concat(name, F.lit("."), c("extension"))))


def pdf_pages(converted: DataFrame, first_page_only: bool = False) -> DataFrame:
    """One row per page of converted files, from a provider's ``path``, ``images`` (in page order) and ``failure`` (null: converted).

    ``page_number`` (from 1), ``page_name``, ``image``, ``error``; a file that failed, or that has no pages, gives one row without a page.
    """
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    images = F.slice("images", 1, 1) if first_page_only else F.col("images")
    usable = F.when(F.col("failure").isNull() & (F.size("images") > 0), images)
    rows = converted.select("path", base.alias("_base"), "failure", F.posexplode_outer(usable).alias("_at", "image"))
    number = (F.col("_at") + 1).cast("int")
    error = F.when(F.col("_at").isNull(), F.concat(F.lit("PDF conversion failed: "), F.coalesce("failure", F.lit("no pages"))))
    return rows.select("path", number.alias("page_number"), F.concat("_base", F.lit("_page_"), number.cast("string"), F.lit(".png")).alias("page_name"), "image", error.alias("error"))

"""Predicates over file names, urls, sizes and tokens (F-01..F-10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.thresholds import DEFAULTS, EXTENSIONS, IMAGE_SUFFIXES, URL_EXTENSIONS, Thresholds

# Extension by media type.
MEDIA_TYPES = {"application/pdf": "pdf", "image/png": "png", "image/jpeg": "jpg", "image/jpg": "jpg", "image/bmp": "bmp", "image/tiff": "tiff", "image/x-tiff": "tiff"}


def allowed_file(name: Column) -> Column:
    return F.contains(name, F.lit(".")) & F.lower(F.substring_index(name, ".", -1)).isin(*EXTENSIONS)


def is_image_file(name: Column) -> Column:
    low = F.lower(name)
    out = F.lit(False)
    for s in IMAGE_SUFFIXES:
        out = out | low.endswith(s)
    return out


def is_pdf(name: Column) -> Column:
    return F.lower(name).endswith(".pdf")


def url_is_valid(url: Column) -> Column:
    """Has a scheme and a host."""
    return F.coalesce(F.length(F.try_parse_url(url, F.lit("PROTOCOL"))) > 0, F.lit(False)) & F.coalesce(F.length(F.try_parse_url(url, F.lit("HOST"))) > 0, F.lit(False))


def url_extension(url: Column) -> Column:
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    ext = F.lower(F.substring_index(path, ".", -1))
    return F.when(F.contains(path, F.lit(".")) & ext.isin(*URL_EXTENSIONS), ext)


def content_type_extension(content_type: Column) -> Column:
    kind = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    return F.element_at(F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair]), kind)


def too_large(length: Column, t: Thresholds = DEFAULTS) -> Column:
    return length > t.max_bytes


def authorised(header: Column, token: Column) -> Column:
    """Equal, or both missing."""
    return header.eqNullSafe(token)


def client_accepts(name: Column, media_type: Column, length: Column, t: Thresholds = DEFAULTS) -> Column:
    """What a client sends: allowed by its media type or by its name's end, and not too large."""
    kind = F.coalesce(media_type.isin("application/pdf", "image/png", "image/jpeg", "image/jpg"), F.lit(False))
    return (kind | F.coalesce(F.lower(name).rlike(r"\.(pdf|png|jpg|jpeg)$"), F.lit(False))) & (length <= t.max_bytes)

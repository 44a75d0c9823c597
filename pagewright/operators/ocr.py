"""Recognised words to page figures (A-01..A-03)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.checks import round2
from pagewright.functions.markers import HEADER
from pagewright.functions.thresholds import DEFAULTS, Thresholds

KEYS = ["doc_id", "page_number"]


def words_of(texts: DataFrame) -> DataFrame:
    """The word relation of texts: position, block of fifty words, and a made-up confidence."""
    split = texts.select("doc_id", F.posexplode(F.split("text", "[ \n]+")).alias("word_idx", "text"))
    conf = (F.length("text") * 37 + F.col("word_idx") * 11 + F.col("doc_id") * 7) % 101
    return split.select("doc_id", F.lit(1).alias("page_number"), "word_idx", (F.floor(F.col("word_idx") / 50) + 1).cast("int").alias("block_num"), "text", conf.cast("int").alias("conf"))


def page_stats(words: DataFrame, pages: DataFrame | None = None, t: Thresholds = DEFAULTS) -> DataFrame:
    """``ocr``, ``hi_words``, ``regions``, ``chars``, ``words`` of each page; zeros for pages (if given) without words."""
    kept = words.where(F.trim("text") != "").withColumn("conf", F.greatest("conf", F.lit(0)))
    out = kept.groupBy(*KEYS).agg(
        round2(F.sum("conf") / F.count("*")).alias("ocr"), F.count_if(F.col("conf") >= t.high_word_confidence).alias("hi_words"),
        F.count_distinct(F.when(F.col("block_num") > 0, F.col("block_num"))).alias("regions"), F.sum(F.length(F.trim("text"))).alias("chars"), F.count("*").alias("words"),
    )
    if pages is None:
        return out
    return pages.select(*KEYS).join(out, KEYS, "left").fillna(0, ["ocr", "hi_words", "regions", "chars", "words"])


def validator_stats(words: DataFrame) -> DataFrame:
    """``confidence`` over all rows with one, whatever their text; ``text_length``, ``has_content``, ``word_count``."""
    length = F.sum(F.length("text")) + F.count("*") - 1
    return words.groupBy(*KEYS).agg(
        F.coalesce(round2(F.sum(F.when(F.col("conf") >= 0, F.col("conf"))) / F.count_if(F.col("conf") >= 0)), F.lit(0.0)).alias("confidence"),
        length.alias("text_length"), (length > 50).alias("has_content"), F.count_if(F.trim("text") != "").alias("word_count"),
    )


def page_text(passes: DataFrame) -> DataFrame:
    """``text`` of each page from recognition passes (``pass`` 1 to 4): the first two that gave any, joined by a line break; else the third, else the fourth."""
    read = [F.max(F.when((F.col("pass") == k) & F.col("text").rlike(r"\S"), F.col("text"))).alias(f"p{k}") for k in (1, 2, 3, 4)]
    both = F.concat_ws("\n", "p1", "p2")
    return passes.groupBy(*KEYS).agg(*read).select(*KEYS, F.coalesce(F.when(both != "", both), "p3", "p4", F.lit("")).alias("text"))


def header_markers(headers: DataFrame, key: str = "doc_id") -> DataFrame:
    """``header_markers``: those found in any of the header texts of a document (one for each image variant and page mode)."""
    low = F.lower("text")
    seen = [F.bool_or(F.contains(low, F.lit(m.lower())) | F.contains(F.col("text"), F.lit(m))).alias(f"h{i}") for i, m in enumerate(HEADER)]
    names = F.array_compact(F.array(*[F.when(F.col(f"h{i}"), m) for i, m in enumerate(HEADER)]))
    return headers.groupBy(key).agg(*seen).select(key, names.alias("header_markers"))

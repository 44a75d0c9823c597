"""Stage rules P-01..P-13 as column expressions over page metrics.

A null metric gives a null check where the rule has nothing to compare; the stages then are null as a whole, as for a page
that could not be read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.thresholds import DEFAULTS, Thresholds

CHECKS = ("resolution", "blur", "brightness", "contrast", "white_space", "skew", "corruption")


def round2(x: Column) -> Column:
    """Two decimals, halves to even in binary, as the metrics are rounded everywhere."""
    return F.rint(x * 100) / 100


def _kind(critical: Column | None, warning: Column) -> Column:
    out = F.when(critical, "critical").when(warning, "warning") if critical is not None else F.when(warning, "warning")
    return out.otherwise("pass")


def check_kinds(t: Thresholds = DEFAULTS) -> dict[str, Column]:
    """``pass``, ``warning`` or ``critical`` for each of the seven checks."""
    c = F.col
    too_dark, too_bright = c("brightness") < t.critical_dark, c("brightness") > t.critical_bright
    return {
        "resolution": _kind((c("width") < t.critical_width) | (c("height") < t.critical_height), (c("width") < t.warn_width) | (c("height") < t.warn_height)),
        "blur": _kind(c("blur") < t.critical_blur, c("blur") < t.warn_blur),
        "brightness": _kind(too_dark | too_bright, (c("brightness") < t.warn_dark) | (c("brightness") > t.warn_bright)),
        "contrast": _kind(c("contrast") < t.critical_contrast, c("contrast") < t.warn_contrast),
        "white_space": _kind(None, c("white_space") >= t.white_space),
        "skew": _kind(None, F.abs("skew") >= t.skew),
        "corruption": _kind((c("thick") > 25) | ((c("irregularity") > 100) & (c("thick") > 15)), (c("thick") > 18) | (c("irregularity") > 80)),
    }


def brightness_issue(t: Thresholds = DEFAULTS) -> Column:
    b = F.col("brightness")
    return F.when(b < t.warn_dark, "too_dark").when(b > t.warn_bright, "too_bright").otherwise("ok")


def _names(kinds: dict[str, Column], kind: str) -> Column:
    return F.array_compact(F.array(*[F.when(k == kind, name) for name, k in kinds.items()]))


def stage1(df: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Adds ``s1_score``, ``s1_critical`` and ``s1_warnings`` (check names, in the order of the checks)."""
    kinds = check_kinds(t)
    points = sum((F.when(k == "pass", 100.0).when(k == "warning", 50.0).otherwise(0.0) for k in kinds.values()), F.lit(0.0))
    readable = F.col("width").isNotNull() & F.col("blur").isNotNull()
    return df.withColumns({
        "s1_score": F.when(readable, round2(points / 7)),
        "s1_critical": F.when(readable, _names(kinds, "critical")).otherwise(F.array().cast("array<string>")),
        "s1_warnings": F.when(readable, _names(kinds, "warning")).otherwise(F.array().cast("array<string>")),
    })


def stage2(df: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Adds ``s2_score``, ``s2_critical`` and ``s2_warnings`` from ocr, hi_words, regions and chars."""
    c = F.col
    fails = {"ocr_confidence": c("ocr") < t.ocr, "high_confidence_words": c("hi_words") < t.high_words, "text_regions": c("regions") < t.text_regions, "characters": c("chars") < t.characters}
    passed = sum(((~f).cast("int") for f in fails.values()), F.lit(0))
    unreadable = c("ocr") < t.critical_ocr
    weighted = round2(F.least(c("ocr") / 100, F.lit(1.0)) * 40 + passed / 4 * 60)
    warn = F.array_compact(F.array(*[F.when(f, name) for name, f in fails.items()]))
    none = F.array().cast("array<string>")
    return df.withColumns({
        "s2_score": F.when(c("ocr").isNull(), F.lit(None)).when(unreadable, 0.0).otherwise(weighted),
        "s2_critical": F.when(unreadable, F.array(F.lit("ocr_unreadable"))).otherwise(none),
        "s2_warnings": F.when(c("ocr").isNull() | unreadable, none).otherwise(warn),
    })


def handwriting_pct(stroke: Column, baseline: Column, spacing: Column, component: Column) -> Column:
    return round2(stroke * 0.35 + baseline * 0.15 + spacing * 0.30 + component * 0.20)


def with_distribution(df: DataFrame) -> DataFrame:
    """Adds ``concentrated`` and ``spread`` from the number of hot cells of the 4x4 grid."""
    share = F.col("hot_regions") * 100 / 16
    return df.withColumns({"concentrated": share < 25, "spread": share > 50})


def stage3(df: DataFrame) -> DataFrame:
    """Adds ``s3_branch`` (1..6), ``s3_score``, ``s3_action``, ``s3_critical``, ``s3_warnings``; needs the distribution."""
    hw, spread, conc = F.col("hw"), F.col("spread"), F.col("concentrated")
    branch = F.when(hw.isNull(), F.lit(None)).when(hw >= 40, 1).when(spread & (hw >= 25), 2).when(conc & (hw < 30), 3).when((hw >= 20) & (hw < 30), 4).when(hw >= 10, 5).otherwise(6)
    df = df.withColumn("s3_branch", branch)
    b = F.col("s3_branch")
    score = F.when(b <= 2, 0.0).when(b == 3, F.greatest(F.lit(80.0), 100 - hw * 0.5)).when(b == 4, F.greatest(F.lit(60.0), 100 - hw * 1.5)).when(b == 5, F.greatest(F.lit(85.0), 100 - hw * 1.5)).when(b == 6, 100.0)
    one = lambda when, name: F.when(when, F.array(F.lit(name)))
    none = F.array().cast("array<string>")
    return df.withColumns({
        "s3_score": score,
        "s3_action": F.when(b <= 2, "REJECT").when(b == 4, "WARNING").when(b.isNotNull(), "ACCEPT"),
        # only the second entry speaks of handwriting in the words that the blur filter looks for
        "s3_critical": F.coalesce(one(b == 1, "handwritten"), one(b == 2, "handwriting_spread"), none),
        "s3_warnings": F.coalesce(one((b == 3) & (hw >= 15), "signatures"), one((b == 3) | (b == 5), "minor"), one(b == 4, "moderate"), none),
    })


def stage4(df: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Adds ``s4_score``, ``quality_level`` and ``s4_warnings``."""
    b = F.col("brisque")
    level = F.when(b.isNull(), F.lit(None)).when(b >= t.brisque, "Poor").when(b >= 50, "Acceptable").when(b >= 30, "Good").otherwise("Excellent")
    df = df.withColumns({"s4_score": F.when(b.isNotNull(), F.greatest(F.lit(0.0), 100 - b)), "quality_level": level})
    none = F.array().cast("array<string>")
    return df.withColumn("s4_warnings", F.when(F.col("quality_level").isin("Poor", "Acceptable"), F.array(F.concat(F.lit("quality_"), F.lower("quality_level")))).otherwise(none))


def final_score() -> Column:
    part = lambda name, w: F.coalesce(F.col(name), F.lit(0.0)) * w
    return round2(part("s1_score", 0.35) + part("s2_score", 0.40) + part("s3_score", 0.20) + part("s4_score", 0.05))


def all_stages(df: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Stages 1 to 4, the final score, and critical entries and warnings over all stages in stage order."""
    df = stage4(stage3(with_distribution(stage2(stage1(df, t), t))), t)
    return df.withColumns({
        "final_score": final_score(),
        "critical": F.concat("s1_critical", "s2_critical", "s3_critical"),
        "warnings": F.concat("s1_warnings", "s2_warnings", "s3_warnings", "s4_warnings"),
    })

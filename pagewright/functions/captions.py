"""Caption model: which pages to ask it about, how its words are read, and what they overrule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that speak for printed or handwritten pages (found anywhere, also inside other words).
PRINTED_STRONG = ["printed", "typed", "computer-generated", "digital", "system-generated", "form", "official document", "certificate", "template", "scanned document"]
PRINTED_WEAK = ["document", "pdf", "text", "stamp", "seal"]
HANDWRITTEN_STRONG = ["handwritten", "handwriting", "written by hand", "manuscript", "cursive", "script", "hand-drawn", "written manually", "hand written"]
HANDWRITTEN_WEAK = ["pen", "pencil", "ink", "written"]
SIGNATURE = ["signature", "signed", "stamp", "seal"]
PRINTED_TEXT = ["text", "printed", "typed", "form", "document"]


def _hits(text: Column, words: list[str]) -> Column:
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def parse_captions(df: DataFrame, text_col: str = "explanation") -> DataFrame:
    """Adds ``caption_branch`` (1..7), ``is_printed`` and ``caption_confidence``."""
    t = F.lower(text_col)
    ps, hs = _hits(t, PRINTED_STRONG), _hits(t, HANDWRITTEN_STRONG)
    df = df.withColumns({"_ps": ps, "_hs": hs, "_p": ps * 3 + _hits(t, PRINTED_WEAK), "_h": hs * 3 + _hits(t, HANDWRITTEN_WEAK), "_sig": _hits(t, SIGNATURE) > 0, "_txt": _hits(t, PRINTED_TEXT) > 0})
    c = F.col
    some = c("_ps") >= 1
    branch = F.when(c("_hs") > 0, 1).when((c("_ps") >= 2) & (c("_h") == 0), 2).when(c("_sig") & c("_txt") & some, 3).when((c("_p") > c("_h") * 3) & some, 4).when(c("_h") > c("_p"), 5).when((c("_p") > c("_h") * 2) & some, 6).otherwise(7)
    df = df.withColumn("caption_branch", F.when(c(text_col).isNotNull(), branch))
    b = c("caption_branch")
    raw = F.when(b == 1, F.least(F.lit(0.95), 0.7 + c("_hs") * 0.1)).when(b == 2, F.least(F.lit(0.95), 0.75 + c("_ps") * 0.05)).when(b == 3, 0.8).when(b == 4, F.least(F.lit(0.9), 0.65 + c("_ps") * 0.05)).when(b == 5, F.least(F.lit(0.9), 0.6 + c("_h") * 0.05)).when(b == 6, 0.7).when(b == 7, 0.5)
    return df.withColumns({"is_printed": b.isin(2, 3, 4, 6), "caption_confidence": F.rint(raw * 1000) / 1000}).drop("_ps", "_hs", "_p", "_h", "_sig", "_txt")


def caption_gate(ocr: Column, hw: Column) -> Column:
    """Whether the model is asked at all; filter on this before running a provider."""
    need = F.when(hw >= 40, 70).when(hw >= 35, 65).when(hw >= 30, 60).otherwise(50)
    return F.coalesce((ocr >= 50) & (hw >= 20) & ~((ocr >= 90) & (hw < 50)) & (ocr >= need), F.lit(False))


def required_confidence(ocr: Column, hw: Column) -> Column:
    base = F.when(hw >= 40, 0.75).when(hw >= 35, 0.70).when(hw >= 30, 0.65).otherwise(0.60)
    less = F.when(ocr >= 80, 0.10).when(ocr >= 75, 0.05).otherwise(0.0)
    return F.greatest(F.lit(0.60), base - less)


def caption_override(df: DataFrame) -> DataFrame:
    """Adds ``f``: true, false or null. Needs ocr, hw, is_printed, caption_confidence, timed_out and failed."""
    c = F.col
    late = F.when(c("hw") > 35, False).when((c("ocr") >= 75) & (c("hw") < 35), True).otherwise(False)
    enough = c("caption_confidence") >= required_confidence(c("ocr"), c("hw"))
    said = F.when(c("failed") | c("is_printed").isNull(), F.lit(None).cast("boolean")).when(~c("is_printed"), False).when(enough, True)
    return df.withColumn("f", F.when(~caption_gate(c("ocr"), c("hw")), F.lit(None).cast("boolean")).when(F.coalesce(c("timed_out"), F.lit(False)), late).otherwise(said))


def false_positive_handwriting(threshold: float = 0.6) -> Column:
    return F.coalesce(F.col("is_printed") & (F.col("caption_confidence") >= threshold), F.lit(False))

"""Page decisions: failure filter, consensus ladder C1..C27, score ladder D1..D6, and their meaning.

The ladders are ordered lists of (id, condition); the first condition that holds names the rule. Conditions are SQL text over the
page's metrics. Nulls never satisfy a comparison; flags that are negated are made false for null first. ``f`` is the opinion of the caption
model: true (printed), false (handwritten) or null (none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.thresholds import DEFAULTS, Thresholds

#: Entries of the critical list that a good reading overrules.
BLUR, SPREAD = "blur", "handwriting_spread"

# Rule, status, priority, message.
RULES = [
    ("C1", "ACCEPTED", "Normal", "Readable text outweighs the caption model"),
    ("C2", "REJECTED", "N/A", "Document is handwritten"),
    ("C3", "ACCEPTED", "Normal", "Caption model confirms printed text"),
    ("C4", "ACCEPTED", "Normal", "Very readable text outweighs handwriting"),
    ("C5", "REJECTED", "N/A", "Document appears handwritten"),
    ("C6", "REJECTED", "N/A", "Text is unreadable"),
    ("C7", "ACCEPTED", "Normal", "Readable text outweighs the caption model"),
    ("C8", "REJECTED", "N/A", "Document is handwritten"),
    ("C9", "ACCEPTED", "Normal", "Caption model confirms printed text"),
    ("C10", "ACCEPTED", "Normal", "Readable text outweighs handwriting"),
    ("C11", "REJECTED", "N/A", "Document appears handwritten"),
    ("C12", "REJECTED", "N/A", "Document is handwritten"),
    ("C13", "ACCEPTED", "Normal", "Caption model confirms printed text"),
    ("C14", "ACCEPTED", "Normal", "Caption model confirms printed text"),
    ("C15", "REJECTED", "N/A", "Handwritten text throughout the document"),
    ("C16", "REJECTED", "N/A", "Handwritten text throughout the document"),
    ("C17", "REJECTED", "N/A", "Resolution is too low"),
    ("C18", "REJECTED", "N/A", "Document is extremely blurry"),
    ("C19", "FLAG_FOR_REVIEW", "Low", "Blurry but partly readable"),
    ("C20", "REJECTED", "N/A", "Document is too blurry"),
    ("C21b", "REJECTED", "N/A", "Critical failure"),
    ("C22", "ACCEPTED", "High", "All signals are good"),
    ("C23a", "ACCEPTED", "Normal", "Signatures in isolated areas"),
    ("C23b", "FLAG_FOR_REVIEW", "Low", "Isolated handwriting, text hard to read"),
    ("C24a", "ACCEPTED", "Normal", "Readable text with isolated handwriting"),
    ("C24b", "FLAG_FOR_REVIEW", "Medium", "Readable text, handwriting all over"),
    ("C24c", "FLAG_FOR_REVIEW", "Medium", "Readable text, handwriting of unclear spread"),
    ("C25", "FLAG_FOR_REVIEW", "Low", "Sharp image but unusual font"),
    ("C26a", "ACCEPTED", "Normal", "Handwriting measure unreliable on a soft image"),
    ("C26b", "ACCEPTED", "Normal", "Readable text with isolated handwriting"),
    ("C26c", "REJECTED", "N/A", "Handwritten text throughout the document"),
    ("C26d", "ACCEPTED", "Normal", "Readable text with some handwriting"),
    ("D1", "REJECTED", "N/A", "Critical failures"),
    ("D2h", "ACCEPTED", "High", "Very readable"),
    ("D2n", "ACCEPTED", "Normal", "Very readable"),
    ("D3h", "ACCEPTED", "High", "Readable"),
    ("D3n", "ACCEPTED", "Normal", "Readable"),
    ("D4h", "ACCEPTED", "High", "Good score"),
    ("D4n", "ACCEPTED", "Normal", "Good score"),
    ("D5", "FLAG_FOR_REVIEW", "Low", "Score in the review band"),
    ("D6", "REJECTED", "N/A", "Score too low"),
]


def consensus_rules(t: Thresholds = DEFAULTS) -> list[tuple[str, str]]:
    """The consensus ladder over ocr, hw, hw2 (hw, null where blur makes it unreliable), blur, width, height, spread, conc,
    f, and the counts ``n_all`` (critical entries of stages 1 to 3, those overruled left out) and ``n_other`` (all but blur and spread)."""
    blurry, extreme = f"blur < {t.critical_blur}", f"coalesce(blur < {t.extreme_blur}, false)"
    return [
        ("C1", "ocr >= 85 and hw >= 40 and f = false"),
        ("C2", "ocr >= 80 and hw >= 40 and f = false"),
        ("C3", "ocr >= 80 and hw >= 40 and f = true"),
        ("C4", "ocr >= 85 and hw >= 40 and hw < 50"),
        ("C5", "ocr >= 80 and hw >= 50"),
        ("C6", "ocr < 20"),
        ("C7", "hw2 >= 40 and ocr >= 85 and f = false"),
        ("C8", "hw2 >= 40 and ocr >= 70 and f = false"),
        ("C9", "hw2 >= 40 and ocr >= 70 and f = true"),
        ("C10", "hw2 >= 40 and ocr >= 75"),
        ("C11", "hw2 >= 40 and ocr >= 70"),
        ("C12", "hw2 >= 40"),
        ("C13", "hw2 >= 30 and hw2 < 40 and ocr >= 60 and f = true"),
        ("C14", "spread and hw2 >= 25 and ocr >= 60 and f = true"),
        ("C15", "spread and hw2 >= 25 and ocr >= 60"),
        ("C16", "spread and hw2 >= 25"),
        ("C17", "width < 400 or height < 300"),
        ("C18", f"{blurry} and {extreme} and not coalesce(ocr >= 50, false)"),
        ("C19", f"{blurry} and ocr >= 30 and ocr < 50"),
        ("C20", f"{blurry} and not coalesce(ocr >= 30, false)"),
        ("C21a", f"n_all > 0 and ocr >= 50 and (not {extreme} or ocr >= 80) and n_other = 0"),
        ("C21b", "n_all > 0"),
        ("C22", "ocr > 80 and hw2 < 15 and blur > 100 and width > 800"),
        ("C23a", "hw2 > 15 and hw2 < 30 and conc and ocr >= 30"),
        ("C23b", "hw2 > 15 and hw2 < 30 and conc and ocr < 30"),
        ("PAGE_ERROR", "hw2 > 15 and hw2 < 30 and conc and ocr is null"),
        ("C24a", "ocr > 75 and hw2 > 25 and hw2 < 40 and conc"),
        ("C24b", "ocr > 75 and hw2 > 25 and hw2 < 40 and spread"),
        ("C24c", "ocr > 75 and hw2 > 25 and hw2 < 40"),
        ("C25", "ocr < 50 and blur > 150 and width > 1000"),
        ("C26a", "hw2 > 20 and ocr > 70 and blur < 60"),
        ("C26b", "hw2 > 20 and ocr > 70 and conc"),
        ("C26c", "hw2 > 20 and ocr > 70 and spread"),
        ("C26d", "hw2 > 20 and ocr > 70"),
        ("C27", "true"),
    ]


def score_rules(t: Thresholds = DEFAULTS) -> list[tuple[str, str]]:
    """The score ladder over final_score, ocr and has_critical."""
    accept = t.accept_score - 10
    return [
        ("D1", "has_critical"),
        ("D2h", "ocr >= 80 and final_score >= 75"),
        ("D2n", "ocr >= 80 and final_score >= 55"),
        ("D3h", "ocr >= 60 and ocr < 80 and final_score >= 85"),
        ("D3n", "ocr >= 60 and ocr < 80 and final_score >= 60"),
        ("D4h", f"final_score >= {accept} and final_score >= 85"),
        ("D4n", f"final_score >= {accept}"),
        ("D5", f"final_score >= {t.review_score}"),
        ("D6", "true"),
    ]


def ladder(rules: list[tuple[str, str]]) -> Column:
    out = None
    for name, condition in rules:
        out = F.when(F.expr(condition), name) if out is None else out.when(F.expr(condition), name)
    return out


def _without(column: str, gone: Column, *names: str) -> Column:
    return F.filter(column, lambda x: ~(gone & x.isin(*names)))


def failure_filter(df: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Takes blur entries (readable text) and spread handwriting (blurred but readable) out of the critical lists, with a note."""
    extreme = F.coalesce(F.col("blur") < t.extreme_blur, F.lit(False))
    has_blur = F.array_contains("s1_critical", BLUR)
    very = F.coalesce(F.col("ocr") >= 80, F.lit(False)) & has_blur
    fair = ~very & F.coalesce(F.col("ocr") >= 50, F.lit(False)) & ~extreme & has_blur
    soft = F.coalesce((F.col("ocr") >= 50) & (F.col("blur") < t.critical_blur), F.lit(False)) & ~extreme & F.array_contains("s3_critical", SPREAD)
    df = df.withColumns({"_blur": very | fair, "_soft": soft, "_note": F.when(very, "blur_readable").when(fair, "blur_slight")})
    notes = F.array_compact(F.array("_note", F.when(F.col("_soft"), "handwriting_unreliable")))
    return df.withColumns({
        "s1_critical": _without("s1_critical", F.col("_blur"), BLUR),
        "s3_critical": _without("s3_critical", F.col("_soft"), SPREAD),
        "critical": F.filter("critical", lambda x: ~(F.col("_blur") & (x == BLUR)) & ~(F.col("_soft") & (x == SPREAD))),
        "warnings": F.concat("warnings", notes),
    }).drop("_blur", "_soft", "_note")


def consensus(df: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Adds ``consensus_rule``; needs filtered stages and, if captions were read, ``f``."""
    if "f" not in df.columns:
        df = df.withColumn("f", F.lit(None).cast("boolean"))
    unreliable = F.coalesce((F.col("blur") < t.critical_blur) & (F.col("ocr") >= 30) & (F.col("ocr") < 50), F.lit(False))
    every = F.concat("s1_critical", "s2_critical", "s3_critical")
    overruled = F.coalesce(F.col("ocr") >= 80, F.lit(False))
    left = F.filter(every, lambda x: ~(overruled & x.isin(BLUR, SPREAD)))
    other = F.filter(every, lambda x: ~x.isin(BLUR, SPREAD))
    df = df.withColumns({"hw2": F.when(~unreliable, F.col("hw")), "conc": F.col("concentrated"), "n_all": F.size(left), "n_other": F.size(other)})
    return df.withColumn("consensus_rule", ladder(consensus_rules(t))).drop("hw2", "conc", "n_all", "n_other")


def page_decisions(df: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """From staged pages to one decision a page: ``rule_id``, ``status``, ``priority``, ``message``, ``has_critical``, ``is_error``."""
    df = consensus(failure_filter(df, t), t)
    df = df.withColumn("has_critical", F.size("critical") > 0)
    rule = F.when(F.col("consensus_rule").isin("C27", "C21a"), ladder(score_rules(t))).otherwise(F.col("consensus_rule"))
    df = df.withColumn("rule_id", rule).withColumn("is_error", F.col("rule_id") == "PAGE_ERROR")
    rules = df.sparkSession.createDataFrame([*RULES, ("PAGE_ERROR", "REJECTED", "N/A", "Error processing page")], "rule_id string, status string, priority string, message string")
    df = df.join(F.broadcast(rules), "rule_id")
    by_consensus = F.col("rule_id").startswith("C") & (F.col("status") == "REJECTED")
    return df.withColumns({
        "has_critical": F.col("has_critical") | by_consensus | F.col("is_error"),
        "final_score": F.when(F.col("is_error"), 0.0).otherwise(F.col("final_score")),
        "critical": F.when(F.col("is_error"), F.array(F.lit("page_error"))).otherwise(F.col("critical")),
        "warnings": F.when(F.col("is_error"), F.array().cast("array<string>")).otherwise(F.col("warnings")),
        "ocr": F.when(~F.col("is_error"), F.col("ocr")),
        "hw": F.when(~F.col("is_error"), F.col("hw")),
    })

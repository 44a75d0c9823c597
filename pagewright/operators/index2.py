"""Registration documents: confidence, method, route and lenient validation (I-07..I-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import markers as M
from pagewright.functions.checks import round2
from pagewright.functions.thresholds import DEFAULTS, Thresholds


def visual_indicators(df: DataFrame) -> DataFrame:
    """Adds ``visual_markers`` and ``visual_score`` from peak_count, barcode_data, seal_count, h_lines, v_lines, width, height."""
    c = F.col
    data = c("barcode_data")
    parts = {
        "barcode_top_section": ((c("peak_count") > 20) & (c("peak_count") < 200), F.lit(0.5)),
        "barcode_decoded": (data.rlike("[0-9]") & (F.length(data) > 8), F.lit(0.6)),
        "n_official_seals": (c("seal_count").between(1, 5), 0.4 + c("seal_count") * 0.1),
        "dense_table_grid": ((c("h_lines") > c("width") * 3) & (c("v_lines") > c("height") * 2), F.lit(0.5)),
    }
    score = sum((F.when(F.coalesce(on, F.lit(False)), w).otherwise(0.0) for on, w in parts.values()), F.lit(0.0))
    names = {n: F.concat(c("seal_count").cast("string"), F.lit("_official_seals")) if n == "n_official_seals" else F.lit(n) for n in parts}
    return df.withColumns({"visual_markers": F.array_compact(F.array(*[F.when(on, names[n]) for n, (on, _) in parts.items()])), "visual_score": score})


def text_indicators(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds critical, strong and supporting markers, the number of critical ones that are not listed, and ``text_score``.

    ``header_markers`` (array) is taken into account if there is such a column, but only where no critical marker stands in the text.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumns({
        "critical_markers": M.found(t, M.CRITICAL), "strong_markers": M.found(t, M.STRONG), "supporting_markers": M.found(t, M.SUPPORTING),
        "extra_critical": M.partial_header(t).cast("int") + M.regn(t).cast("int"),
    })
    none = F.array().cast("array<string>")
    free = (F.size("critical_markers") == 0) & (F.col("extra_critical") == 0)
    header = F.when(free, F.array_distinct("header_markers")).otherwise(none) if "header_markers" in df.columns else none
    df = df.withColumn("from_header", F.coalesce(header, none))
    score = F.size("critical_markers") * 2.0 + F.col("extra_critical") * 1.8 + F.size("from_header") * 2.0 + F.size("strong_markers") * 0.6 + F.size("supporting_markers") * 0.3
    return df.withColumn("text_score", score)


def confidence(df: DataFrame) -> DataFrame:
    """Adds ``confidence_rule``, ``confidence`` (unrounded), ``is_index2`` and ``method``; needs text, visual and negative signals."""
    c = F.col
    neg = F.size("neg_exact") + F.size("neg_partial")
    penalty = F.size("neg_exact") * 0.4 + F.size("neg_partial") * 0.3
    strong_neg = F.exists(F.concat("neg_exact", "neg_partial"), lambda m: F.array_contains(F.array(*[F.lit(s) for s in M.STRONG_NEGATIVE]), m) | _contains_any(m, M.STRONG_NEGATIVE))
    definitive = F.arrays_overlap(F.concat("critical_markers", "from_header"), F.array(*[F.lit(m) for m in M.DEFINITIVE]))
    critical = (F.size("critical_markers") + c("extra_critical") + F.size("from_header")) > 0
    indicators = F.size("critical_markers") + c("extra_critical") + F.size("from_header") + F.size("strong_markers") + F.size("supporting_markers")
    barcode = F.exists("visual_markers", lambda m: m.startswith("barcode"))
    table = F.array_contains("visual_markers", "dense_table_grid")
    rule = (
        F.when(M.early_gate(c("text")), "GATE").when(strong_neg & ~definitive, "R0").when(definitive, "R1").when(critical & (neg > 0), "R1B")
        .when((F.size("strong_markers") >= 3) & (c("visual_score") > 1.0), "R2")
        .when(barcode & table & (F.size("supporting_markers") >= 2) & (neg == 0) & (indicators >= 2), "R3").otherwise("R4")
    )
    df = df.withColumn("confidence_rule", rule)
    r = c("confidence_rule")
    value = (
        F.when(r == "GATE", 0.0).when(r == "R0", F.greatest(F.lit(0.0), 0.20 - penalty)).when(r == "R1", 0.85 + F.least(F.lit(0.1), c("visual_score") * 0.02))
        .when(r == "R1B", F.greatest(F.lit(0.0), 0.25 - penalty)).when(r == "R2", 0.65 + c("text_score") * 0.05).when(r == "R3", 0.70)
        .otherwise(F.least(F.lit(0.55), (c("text_score") * 0.7 + c("visual_score") * 0.3) / 3.0))
    )
    method = F.when(r == "GATE", "early_handwriting_detection").when(critical, "Text markers (CRITICAL found)").when(indicators > F.size("visual_markers"), "Text markers").otherwise("Visual structure")
    return df.withColumn("confidence", value).withColumns({"is_index2": F.col("confidence") >= 0.60, "method": method})


def _contains_any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def structure_score(has_barcode: Column, has_seal: Column, has_table: Column, text: Column) -> Column:
    header = _contains_any(F.lower(F.coalesce(text, F.lit(""))), ["सूची", "index", "regn"])
    return sum((F.coalesce(x, F.lit(False)).cast("int") for x in (has_barcode, has_seal, has_table)), header.cast("int")) * 25


def fully_handwritten(df: DataFrame) -> DataFrame:
    """Adds ``hand_branch`` (1..5) and ``is_handwritten`` from ocr, is_printed, caption_confidence (null: not asked) and text."""
    c = F.col
    keyword = _contains_any(F.lower(F.coalesce(c("text"), F.lit(""))), M.PRINTED_KEYWORDS)
    said = c("is_printed").isNotNull()
    yes, no = said & c("is_printed") & (c("caption_confidence") > 0.6), said & ~c("is_printed") & (c("caption_confidence") > 0.7)
    branch = F.when(c("ocr") >= 70, 1).when(yes, 2).when(no, 3).when(c("ocr") >= 50, 4).otherwise(5)
    hand = F.when(branch.isin(1, 2, 4), False).when(branch == 3, ~F.coalesce(c("ocr") >= 60, F.lit(False))).otherwise(~keyword)
    return df.withColumns({"hand_branch": branch, "is_handwritten": hand})


def validate(df: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Adds ``decision`` and ``index2_score``; needs ocr, structure, is_handwritten."""
    c = F.col
    score = round2(F.least(F.lit(100.0), c("ocr") * 1.5) * 0.4 + c("structure") * 0.4 + F.when(c("is_handwritten"), 0.0).otherwise(100.0) * 0.2)
    value = F.when(c("ocr") < t.index2_ocr, c("ocr")).when(c("is_handwritten"), 0.0).otherwise(score)
    ok = (c("ocr") >= t.index2_ocr) & ~c("is_handwritten") & (score >= t.index2_accept)
    return df.withColumns({"index2_score": value, "decision": F.when(ok, "ACCEPT").otherwise("REJECT")})


def route(df: DataFrame) -> DataFrame:
    """Adds ``route`` and ``document_type``: which result a document gets. A handwritten one is called general but is not judged again."""
    to = F.col("is_index2") & (F.rint(F.col("confidence") * 1000) / 1000 >= 0.6)
    kind = F.when(to & (F.col("decision") == "REJECT") & F.col("is_handwritten"), "GENERAL").when(to, "INDEX2").otherwise("GENERAL")
    return df.withColumns({"route": F.when(to, "index2").otherwise("general"), "document_type": kind})


def first_pages(pages: DataFrame) -> DataFrame:
    """The pages on which a document is routed: its first one only."""
    return pages.where(F.col("page_number") == 1)


def message(df: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Adds ``rejection_reason`` (null: accepted) and ``message``; needs decision, ocr, is_handwritten, index2_score and ``n_markers``.

    Figures have one place, rounded half up in decimal arithmetic.
    """
    c = F.col
    one = lambda x: F.round(x.cast("decimal(18,2)"), 1).cast("string")
    reason = (
        F.when(c("decision") == "ACCEPT", None).when(c("ocr") < t.index2_ocr, F.concat(F.lit("Text completely unreadable (OCR: "), one(c("ocr")), F.lit("%)")))
        .when(c("is_handwritten"), "Document is fully handwritten").otherwise(F.concat(F.lit("Quality below minimum threshold (score: "), one(c("index2_score")), F.lit(")")))
    )
    df = df.withColumn("rejection_reason", reason)
    score = one(c("index2_score"))
    accepted = F.concat(F.lit("Document accepted (score: "), score, F.lit("/100). Document structure verified with "), c("n_markers").cast("string"), F.lit(" authenticity markers."))
    rejected = F.concat(F.lit("Document rejected: "), c("rejection_reason"), F.lit(". Score: "), score, F.lit("/100"))
    return df.withColumn("message", F.when(c("decision") == "ACCEPT", accepted).otherwise(rejected))

"""Pages to documents, documents to batch items, items to summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.checks import round2
from pagewright.functions.thresholds import DEFAULTS, Thresholds


def best_pages(pages: DataFrame) -> DataFrame:
    """One row a document: its best page's number and fields, page counts, and the first override.

    Of two pages it is the second; else pages without critical failures go before others, then the higher score, then the
    earlier page. Pages in error count only if nothing else is there, by score and then by page.
    """
    fields = [c for c in ("page_number", "final_score", "status", "priority", "message", "rule_id", "ocr", "hw", "critical", "warnings", "has_critical") if c in pages.columns]
    earlier = -F.col("page_number")
    ranked = F.struct(
        F.when(F.col("is_error"), 0).otherwise(1).alias("ok"),
        F.when((F.col("total_pages") == 2) & ~F.col("is_error"), F.col("page_number")).otherwise(0).alias("second"),
        F.when((F.col("total_pages") != 2) & ~F.col("is_error") & ~F.col("has_critical"), 1).otherwise(0).alias("clean"),
        F.col("final_score").alias("score"), earlier.alias("earlier"),
    )
    # of two pages the first never is the best one, even if the second is in error: then the higher score decides among all
    usable = ~F.col("is_error") & ((F.col("total_pages") != 2) | (F.col("page_number") == 2))
    fallback = F.struct(F.col("final_score").alias("score"), earlier.alias("earlier"))
    row = F.struct(*fields)
    out = pages.groupBy("doc_id").agg(
        F.max("total_pages").alias("total_pages"),
        F.max_by(F.when(usable, row), F.when(usable, ranked)).alias("b1"),
        F.max_by(row, fallback).alias("b2"),
        F.count_if(F.col("status") == "ACCEPTED").alias("accepted_pages"),
        F.min(F.when(F.col("rule_id").isin("C3", "C9", "C13", "C14"), F.col("page_number"))).alias("override_page"),
    )
    return out.withColumn("best", F.coalesce("b1", "b2")).select("doc_id", "total_pages", F.col("best.page_number").alias("best_page"), *[F.col(f"best.{c}").alias(c) for c in fields[1:]], "accepted_pages", "override_page", F.col("b1").isNull().alias("no_page"))


def document_decisions(pages: DataFrame) -> DataFrame:
    """The best page's decision, patched by what other pages have."""
    docs = best_pages(pages)
    accepted, total = F.col("status") == "ACCEPTED", F.col("total_pages")
    rescued = (total >= 3) & ~accepted & (F.col("accepted_pages") > 0)
    prefix = accepted & ((total >= 3) | ((total == 2) & (F.col("best_page") == 2)))
    lost = (total >= 3) & ~accepted & (F.col("accepted_pages") == 0)
    template = F.when(prefix, "accepted_prefix").when(rescued, "accepted_pages").when(lost, "rejected_all").otherwise("page")
    status = F.when(rescued, "ACCEPTED").otherwise(F.col("status"))
    reasons = F.when(status == "ACCEPTED", F.array().cast("array<string>")).otherwise(F.concat("critical", "warnings"))
    priority = F.when(rescued, "Normal").otherwise(F.col("priority"))
    return docs.withColumns({"status": status, "priority": priority, "message_kind": template, "rejection_reasons": reasons})


def batch_items(docs: DataFrame) -> DataFrame:
    """A document as a batch shows it: several pages are accepted if any page is, else rejected; a single one keeps its status."""
    several = F.col("total_pages") > 1
    status = F.when(several & (F.col("accepted_pages") > 0), "ACCEPTED").when(several, "REJECTED").otherwise(F.col("status"))
    kind = F.when(several & (F.col("accepted_pages") > 0), "pages_passed").when(several, "all_failed").when(F.size("critical") > 0, F.element_at("critical", 1)).otherwise(F.col("message"))
    return docs.select("doc_id", "total_pages", "accepted_pages", status.alias("status"), kind.alias("reason"), round2(F.col("final_score")).alias("score"), F.col("ocr").alias("ocr_confidence"))


def batch_summary(items: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Counts of a batch; items with an ``error`` (if there is such a column) failed."""
    error = F.col("error").isNotNull() if "error" in items.columns else F.lit(False)
    return items.groupBy(batch_col).agg(
        F.count("*").alias("total"), F.count_if(~error).alias("successful"), F.count_if(error).alias("failed"),
        *[F.count_if(~error & (F.col("status") == s)).alias(name) for s, name in (("ACCEPTED", "accepted"), ("REJECTED", "rejected"), ("FLAG_FOR_REVIEW", "flagged"))],
    )


def bulk_report(items: DataFrame) -> DataFrame:
    """Display columns of a batch: pages (1 by default), score, recognition, reason, and the band of the score."""
    return items.select("doc_id", F.coalesce("total_pages", F.lit(1)).alias("pages"), "score", "ocr_confidence", F.coalesce("reason", F.lit("-")).alias("reason"), score_band(F.col("score")).alias("band"))


def score_band(score):
    return F.when(score >= 70, "acceptable").when(score >= 50, "review").otherwise("too_low")


def response_entries(files: DataFrame, items: DataFrame) -> DataFrame:
    """One row per file of a batch: refused ones keep their ``error``; others have the item of their document, or status UNKNOWN if its run failed.

    ``files`` has batch_id, idx, doc_id, filename and error; ``items`` is what ``batch_items`` gives.
    """
    found = items.select(F.col("doc_id").alias("_doc"), "status", "score", "reason", "ocr_confidence", "total_pages")
    both = files.select("batch_id", "idx", "doc_id", "filename", "error").join(found, F.col("doc_id") == F.col("_doc"), "left")
    ok, ran = F.col("error").isNull(), F.col("_doc").isNotNull()
    return both.select(
        "batch_id", "idx", "doc_id", "filename", "error", (ok & ran).alias("success"), F.when(ok, F.coalesce("status", F.lit("UNKNOWN"))).alias("status"),
        F.when(ok, F.coalesce("score", F.lit(0.0))).alias("score"), F.when(ok, F.coalesce("reason", F.lit("Needs review"))).alias("reason"),
        F.when(ok, F.col("ocr_confidence")).alias("ocr_confidence"), F.when(ok, F.coalesce("total_pages", F.lit(1))).alias("total_pages"),
    )


RESPONSE = (
    "success boolean, error string, summary struct<total_files:bigint,successful:bigint,failed:bigint,accepted:bigint,rejected:bigint,flagged_for_review:bigint>, "
    "results array<struct<idx:int,filename:string,success:boolean,status:string,score:double,reason:string,ocr_confidence:double,total_pages:int>>, "
    "errors array<struct<idx:int,filename:string,error:string>>"
)


def batch_responses(entries: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """``batch_id`` and ``response``, the JSON of a batch: summary, results and errors in the order of the files.

    A batch with more files than allowed is refused as a whole, so that lists never have more than ``max_files`` entries.
    """
    error = F.col("error").isNotNull()
    counts = entries.groupBy("batch_id").agg(
        F.count("*").alias("total_files"), F.count_if(F.col("success")).alias("successful"), F.count_if(error).alias("failed"),
        *[F.count_if(~error & (F.col("status") == s)).alias(name) for s, name in (("ACCEPTED", "accepted"), ("REJECTED", "rejected"), ("FLAG_FOR_REVIEW", "flagged_for_review"))],
    )
    allowed = entries.join(counts.where(F.col("total_files") <= t.max_files).select("batch_id"), "batch_id", "left_semi")
    result = F.struct("idx", "filename", "success", "status", "score", "reason", "ocr_confidence", "total_pages")
    lists = allowed.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.when(~error, result))).alias("results"), F.array_sort(F.collect_list(F.when(error, F.struct("idx", "filename", "error")))).alias("errors"))
    summary = F.struct("total_files", "successful", "failed", "accepted", "rejected", "flagged_for_review")
    good = F.to_json(F.struct(F.lit(True).alias("success"), summary.alias("summary"), "results", "errors"))
    refused = F.to_json(F.struct(F.lit(False).alias("success"), F.concat(F.lit("Too many files. Maximum "), F.lit(str(t.max_files)), F.lit(" files allowed per bulk upload.")).alias("error")))
    return counts.join(lists, "batch_id", "left").select("batch_id", F.when(F.col("results").isNull(), refused).otherwise(good).alias("response"))

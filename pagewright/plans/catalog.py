"""Registry of the document-quality queries; their SQL twins are in ``oracle``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import captions, checks, decisions, files, markers
from pagewright.functions.thresholds import DEFAULTS
from pagewright.operators import index2, ocr, pixels, rollup
from pagewright.plans.oracle import ORACLE
from pagewright.sources import derive, images
from pagewright.sources import files as upload_files
from pagewright.streaming import batches

QUERIES: dict = {}
KEYS = ["doc_id", "page_number"]


def query(make):
    QUERIES[make.__name__] = make
    return make


def _read(spark, sf, table):
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _cat(name: str, alias: str):
    return F.concat_ws(",", name).alias(alias)


def _staged(spark: SparkSession, sf: str) -> DataFrame:
    return checks.all_stages(derive.page_metrics(spark, sf))


def _pages(spark, sf):
    return decisions.page_decisions(_staged(spark, sf))


def _documents(spark, sf):
    return rollup.document_decisions(_pages(spark, sf))


def _items(spark, sf):
    return rollup.batch_items(_documents(spark, sf))


def _check(name: str):
    def run(spark, sf):
        return derive.page_metrics(spark, sf).select(*KEYS, checks.check_kinds()[name].alias("kind"))

    run.__name__ = f"check_{name}"
    return query(run)


for _name in checks.CHECKS:
    _check(_name)


@query
def stage1_score(spark, sf):
    return checks.stage1(derive.page_metrics(spark, sf)).select(*KEYS, "s1_score", _cat("s1_critical", "critical"), _cat("s1_warnings", "warnings"))


@query
def ocr_page_stats(spark, sf):
    return ocr.page_stats(ocr.words_of(_read(spark, sf, "documents")))


@query
def stage2_score(spark, sf):
    return checks.stage2(ocr_page_stats(spark, sf)).select(*KEYS, "s2_score", _cat("s2_critical", "critical"), _cat("s2_warnings", "warnings"))


@query
def handwriting_pct(spark, sf):
    c = F.col
    return derive.page_metrics(spark, sf).select(*KEYS, checks.handwriting_pct(c("stroke"), c("baseline"), c("spacing"), c("component")).alias("hw"))


@query
def stage3_ladder(spark, sf):
    out = checks.stage3(checks.with_distribution(derive.page_metrics(spark, sf)))
    return out.select(*KEYS, "s3_branch", "s3_score", "s3_action", _cat("s3_critical", "critical"), _cat("s3_warnings", "warnings"))


@query
def stage4_bands(spark, sf):
    return checks.stage4(derive.page_metrics(spark, sf)).select(*KEYS, "s4_score", "quality_level", _cat("s4_warnings", "warnings"))


@query
def final_score(spark, sf):
    return _staged(spark, sf).select(*KEYS, "final_score")


@query
def failure_filter(spark, sf):
    return decisions.failure_filter(_staged(spark, sf)).select(*KEYS, _cat("critical", "critical"), _cat("warnings", "warnings"))


@query
def consensus_rule(spark, sf):
    return decisions.consensus(decisions.failure_filter(_staged(spark, sf))).select(*KEYS, "consensus_rule")


@query
def score_status(spark, sf):
    return _staged(spark, sf).withColumn("has_critical", F.lit(False)).select(*KEYS, decisions.ladder(decisions.score_rules()).alias("rule_id"))


@query
def page_decision(spark, sf):
    return _pages(spark, sf).select(*KEYS, "rule_id", "status", "priority", "message", "final_score", "has_critical")


def _captioned(spark, sf):
    """Staged pages with the caption model's opinion ``f``."""
    staged = _staged(spark, sf)
    said = captions.parse_captions(derive.relation(spark, sf, derive.PAGE_CAPTIONS))
    opinion = captions.caption_override(staged.select(*KEYS, "ocr", "hw").join(said, KEYS)).select(*KEYS, "f")
    return staged.join(opinion, KEYS)


@query
def consensus_rule_captions(spark, sf):
    return decisions.consensus(decisions.failure_filter(_captioned(spark, sf))).select(*KEYS, "f", "consensus_rule")


@query
def page_decision_captions(spark, sf):
    return decisions.page_decisions(_captioned(spark, sf)).select(*KEYS, "rule_id", "status", "priority", "has_critical")


@query
def first_override(spark, sf):
    """The first page of a document on which the caption model overruled the handwriting measure."""
    return rollup.best_pages(decisions.page_decisions(_captioned(spark, sf))).select("doc_id", "override_page")


@query
def best_page(spark, sf):
    return rollup.best_pages(_pages(spark, sf)).select("doc_id", "total_pages", "best_page", "final_score", "rule_id", "accepted_pages")


@query
def document_decision(spark, sf):
    return _documents(spark, sf).select("doc_id", "total_pages", "status", "priority", "message_kind", "final_score", F.size("rejection_reasons").cast("long").alias("n_reasons"))


@query
def bulk_items(spark, sf):
    return _items(spark, sf)


@query
def bulk_report(spark, sf):
    return rollup.bulk_report(_items(spark, sf))


@query
def score_band(spark, sf):
    return _items(spark, sf).groupBy(rollup.score_band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


@query
def batch_summary(spark, sf):
    items = _items(spark, sf).withColumns({"batch_id": F.col("doc_id") % 97, "error": F.when(F.col("doc_id") % 13 == 0, "Download failed")})
    return rollup.batch_summary(items)


def _entries(spark, sf):
    """Files of batches with the items of their documents; every 17th document's run failed."""
    submitted = upload_files.with_upload_errors(derive.relation(spark, sf, derive.SUBMISSIONS))
    return rollup.response_entries(submitted, _items(spark, sf).where(F.col("doc_id") % 17 != 0))


@query
def response_entries(spark, sf):
    return _entries(spark, sf)


@query
def batch_response(spark, sf):
    """The JSON of every batch, read back."""
    told = rollup.batch_responses(_entries(spark, sf)).select("batch_id", F.from_json("response", rollup.RESPONSE).alias("r")).select("batch_id", "r.*")
    each = lambda name, field: F.when(F.col("success"), F.concat_ws("|", F.transform(name, lambda x: F.concat(x["idx"].cast("string"), F.lit(":"), x[field])))).alias(name)
    return told.select("batch_id", "success", "error", "summary.*", each("results", "status"), each("errors", "error"))


@query
def download_errors(spark, sf):
    """What is said of every download, and under which extension it is kept."""
    return upload_files.with_download_errors(derive.relation(spark, sf, derive.DOWNLOADS)).select("page_id", "error", "extension", (F.col("saved_as").isNotNull()).alias("saved"), F.when(F.col("filename").isNotNull(), F.col("saved_as")).alias("custom_name"))


@query
def client_filter(spark, sf):
    """The files of a batch that the client sends: allowed by media type or name, at most 10 MiB, the first fifty."""
    files_in = derive.relation(spark, sf, derive.SUBMISSIONS)
    kind = F.when(F.col("doc_id") % 11 == 0, F.when(F.col("doc_id") % 2 == 0, "application/pdf").otherwise("text/plain"))
    kept = files_in.where(files.client_accepts(F.col("filename"), kind, F.col("length")))
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy("idx"))
    return kept.withColumn("place", place).where(F.col("place") <= DEFAULTS.max_files).select("batch_id", "doc_id", "place")


@query
def batch_cap(spark, sf):
    n, cap = F.count("*"), F.lit(DEFAULTS.max_files).cast("long")
    return derive.relation(spark, sf, derive.UPLOADS).groupBy("batch_id").agg(n.alias("files"), (n > cap).alias("refused"), F.least(n, cap).alias("shown"))


@query
def allowed_file(spark, sf):
    name = F.col("filename")
    return derive.relation(spark, sf, derive.UPLOADS).select("item_idx", files.allowed_file(name).alias("allowed"), files.is_image_file(name).alias("is_image"), files.is_pdf(name).alias("is_pdf"))


@query
def size_limit(spark, sf):
    return derive.relation(spark, sf, derive.UPLOADS).select("item_idx", files.too_large(F.col("length")).alias("too_large"))


@query
def auth_check(spark, sf):
    i = F.col("item_idx")
    header = F.when(i % 3 != 0, F.concat(F.lit("t"), (i % 2).cast("string")))
    return derive.relation(spark, sf, derive.UPLOADS).select("item_idx", files.authorised(header, F.when(i % 4 != 0, "t1")).alias("authorised"))


@query
def filenames_match(spark, sf):
    events = _read(spark, sf, "events")
    least = events.agg(F.min("event_type").alias("least"))
    named = events.join(F.broadcast(least), F.col("event_type") != F.col("least"), "left")
    return named.groupBy(F.col("user_id").alias("batch_id")).agg((F.count("*") == F.count("least")).alias("matches"))


@query
def bulk_url_zip(spark, sf):
    """Lists of at most fifty urls and names each, as a request has them, taken apart again by position."""
    urls = derive.relation(spark, sf, derive.URLS).withColumn("name", F.concat(F.lit("n"), F.col("page_id").cast("string")))
    pairs = F.array_sort(F.collect_list(F.struct("page_id", "url", "name")))
    lists = urls.groupBy(F.floor(F.col("page_id") / DEFAULTS.max_files).alias("batch_id")).agg(pairs.alias("p")).select("batch_id", F.col("p.url").alias("urls"), F.col("p.name").alias("names"))
    rows = lists.where(F.size("urls") == F.size("names")).select("batch_id", F.posexplode(F.arrays_zip("urls", "names")).alias("idx", "z"))
    return rows.select("batch_id", "idx", F.col("z.urls").alias("url"), F.col("z.names").alias("filename"))


@query
def url_extension(spark, sf):
    urls = derive.relation(spark, sf, derive.URLS)
    out = urls.select("page_id", files.url_is_valid(F.col("url")).alias("valid"), files.url_extension(F.col("url")).alias("from_url"), files.content_type_extension(F.col("content_type")).alias("from_type"))
    return out.withColumn("extension", F.coalesce("from_url", "from_type", F.lit("pdf")))


def _captions(spark, sf):
    return captions.parse_captions(derive.relation(spark, sf, derive.CAPTIONS))


@query
def caption_parse(spark, sf):
    return _captions(spark, sf).select("doc_id", "caption_branch", "is_printed", "caption_confidence")


@query
def caption_gate(spark, sf):
    return derive.page_metrics(spark, sf).select(*KEYS, captions.caption_gate(F.col("ocr"), F.col("hw")).alias("asked"))


@query
def caption_override(spark, sf):
    pages = derive.page_metrics(spark, sf).select(*KEYS, "ocr", "hw")
    return captions.caption_override(pages.join(_captions(spark, sf), KEYS)).select(*KEYS, "f")


def _marker_text(spark, sf):
    return derive.relation(spark, sf, derive.MARKER_TEXT)


def _sorted(column, alias):
    return F.concat_ws(",", F.array_sort(column)).alias(alias)


@query
def text_markers(spark, sf):
    t = F.col("text")
    return _marker_text(spark, sf).select(
        "doc_id", *[_sorted(markers.found(t, m), n) for m, n in ((markers.CRITICAL, "critical"), (markers.STRONG, "strong"), (markers.SUPPORTING, "supporting"))],
        markers.partial_header(t).alias("partial_header"), markers.regn(t).alias("regn"), markers.early_gate(t).alias("gated"),
    )


def _headers(spark, sf):
    return ocr.header_markers(derive.relation(spark, sf, derive.HEADER_TEXT))


@query
def header_markers(spark, sf):
    return _headers(spark, sf).select("doc_id", _sorted("header_markers", "header"))


@query
def page_text(spark, sf):
    return ocr.page_text(derive.relation(spark, sf, derive.OCR_PASSES))


@query
def negative_signals(spark, sf):
    return markers.negatives(_marker_text(spark, sf)).select("doc_id", _sorted("neg_exact", "neg_exact"), _sorted("neg_partial", "neg_partial"))


@query
def visual_indicators(spark, sf):
    return index2.visual_indicators(derive.relation(spark, sf, derive.PAGE_VISUALS)).select("doc_id", _cat("visual_markers", "markers"), "visual_score")


def _confident(spark, sf, text=derive.MARKER_TEXT, headers=False):
    texts = derive.relation(spark, sf, text)
    if headers:
        texts = texts.join(_headers(spark, sf), "doc_id", "left")
    signals = markers.negatives(index2.text_indicators(texts))
    seen = index2.visual_indicators(derive.relation(spark, sf, derive.PAGE_VISUALS)).select("doc_id", "visual_markers", "visual_score", "has_barcode", "has_seal", "has_table")
    both = signals.join(seen, "doc_id", "left")
    none = F.array().cast("array<string>")
    return index2.confidence(both.withColumns({"visual_markers": F.coalesce("visual_markers", none), "visual_score": F.coalesce("visual_score", F.lit(0.0))}))


def _confidence_columns(df):
    return df.select("doc_id", "confidence_rule", (F.rint(F.col("confidence") * 1000) / 1000).alias("confidence"), "is_index2", "method")


@query
def index2_confidence(spark, sf):
    return _confidence_columns(_confident(spark, sf))


@query
def index2_confidence_clean(spark, sf):
    return _confidence_columns(_confident(spark, sf, derive.MARKER_TEXT_CLEAN))


@query
def index2_confidence_header(spark, sf):
    """With what the header passes read, where the text itself has no critical marker."""
    return _confidence_columns(_confident(spark, sf, derive.MARKER_TEXT_CLEAN, headers=True))


@query
def index2_first_page(spark, sf):
    return index2.first_pages(derive.page_metrics(spark, sf)).select("doc_id", "page_number", "total_pages")


@query
def validator_ocr(spark, sf):
    return ocr.validator_stats(ocr.words_of(_read(spark, sf, "documents")))


def _validated(spark, sf):
    read = validator_ocr(spark, sf).select("doc_id", F.col("confidence").alias("ocr"))
    said = _captions(spark, sf).select("doc_id", "is_printed", "caption_confidence")
    df = _confident(spark, sf).join(read, "doc_id").join(said, "doc_id")
    df = df.withColumn("structure", index2.structure_score(F.col("has_barcode"), F.col("has_seal"), F.col("has_table"), F.col("text")))
    return index2.validate(index2.fully_handwritten(df))


@query
def validator_score(spark, sf):
    return _validated(spark, sf).select("doc_id", "structure", "hand_branch", "is_handwritten", "index2_score", "decision")


@query
def index2_message(spark, sf):
    marks = F.size("critical_markers") + F.col("extra_critical") + F.size("strong_markers") + F.size("supporting_markers") + F.size("visual_markers")
    return index2.message(_validated(spark, sf).withColumn("n_markers", marks)).select("doc_id", "rejection_reason", "message")


@query
def index2_route(spark, sf):
    return index2.route(_validated(spark, sf)).select("doc_id", "route", "document_type")


def _pixel(name, make, width=8):
    def run(spark, sf):
        return make(pixels.pixels_of(_read(spark, sf, "embeddings"), width))

    run.__name__ = name
    return query(run)


_pixel("pixel_brightness", pixels.brightness)
_pixel("pixel_contrast", pixels.contrast)
_pixel("pixel_white_space", pixels.white_space)
_pixel("pixel_laplacian_blur", pixels.laplacian_blur)
_pixel("row_projection_cv", pixels.baseline_score)
_pixel("col_projection_cv", pixels.spacing_score, width=64)


def _kernel(name, kernels, *columns):
    def run(spark, sf):
        drawn = derive.drawn_pages(_read(spark, sf, "supplier"))
        return images.features(drawn, kernels=kernels).select("origin", *columns)

    run.__name__ = name
    return query(run)


_kernel("image_decode", ["basic"], "height", "width", "blur", "brightness", "contrast", "white_space")
_kernel("edge_features", ["edge_mass"], "edge_density", "thick", "irregularity")
_kernel("skew", ["skew"], "skew")
_kernel("stroke_width", ["hand"], "stroke", "hw")
_kernel("components", ["component"], "component")
_kernel("grid_distribution", ["grid"], "hot_regions")
_kernel("brisque", ["brisque"], "brisque")
_kernel("seals", ["seals"], "seal_count", "has_seal")
_kernel("tables", ["tables"], "h_lines", "v_lines", "has_table")
_kernel("barcode_peaks", ["barcode"], "peak_count", "has_barcode")


# Stage, name, technology, time, weight, checks.
STAGE_ROWS = [
    (1, "Basic Quality Checks", "OpenCV", "50-100ms", 0.35, ["Resolution", "Blur Detection", "Brightness", "Contrast", "White Space", "Skew Detection"]),
    (2, "OCR Confidence Analysis", "Tesseract OCR", "2-5 seconds", 0.40, ["Average Confidence", "High Confidence Words", "Text Regions", "Character Count"]),
    (3, "Handwriting Detection", "Computer Vision", "0.5-2 seconds", 0.20, ["Stroke Width Variance", "Baseline Variance", "Character Spacing", "Connected Components"]),
    (4, "Overall Quality Score", "BRISQUE", "100-200ms", 0.05, ["Blind Image Quality Assessment"]),
]


@query
def stage_catalog(spark, sf):
    rows = spark.createDataFrame(STAGE_ROWS, "stage int, name string, technology string, processing_time string, weight double, checks array<string>")
    return rows.withColumns({"n_checks": F.size("checks"), "checks": F.concat_ws("|", "checks")})


@query
def health(spark, sf):
    return spark.createDataFrame([("healthy", "Document Quality Verification Pipeline", "1.0.0")], "status string, service string, version string")


@query
def shown_slices(spark, sf):
    """What is shown of long values: the first twenty words of a text, two hundred characters of an explanation."""
    said = derive.relation(spark, sf, derive.CAPTIONS).select("doc_id", F.substring(F.repeat("explanation", 12), 1, 200).alias("explanation"))
    words = _read(spark, sf, "documents").select("doc_id", F.concat_ws(" ", F.slice(F.split("text", "[ \n]+"), 1, 20)).alias("words"))
    return words.join(said, "doc_id")


@query
def result_json(spark, sf):
    """Results as JSON text and read back."""
    text = _items(spark, sf).select(F.to_json(F.struct("doc_id", "status", "score")).alias("j"))
    return text.select(F.from_json("j", "doc_id long, status string, score double").alias("r")).select("r.*")


@query
def field_extraction(spark, sf):
    """Fields that were extracted into nested JSON, compared with what the documents say: the first word, and the length."""
    docs = _read(spark, sf, "documents")
    kind = "array<struct<field_name:string,expected_value:string,extracted_value:string,confidence:double>>"
    field = lambda name, expected, found, sure: F.struct(F.lit(name).alias("field_name"), expected.alias("expected_value"), found.alias("extracted_value"), F.lit(sure).alias("confidence"))
    first = field("first_word", F.lower(F.regexp_extract("text", "^[^ \n]+", 0)), F.lower(F.element_at(F.split("text", "[ \n,.]+"), 1)), 0.95)
    length = field("n_chars", F.col("n_chars").cast("string"), F.length(F.trim("text")).cast("string"), 0.8)
    text = docs.select("doc_id", F.to_json(F.array(first, length)).alias("j"))
    rows = text.select("doc_id", F.explode(F.from_json("j", kind)).alias("x")).select("doc_id", "x.*")
    return rows.withColumn("matches", F.col("expected_value").eqNullSafe(F.col("extracted_value")))


@query
def daily_counts(spark, sf):
    return batches.daily_counts(_read(spark, sf, "events"))


@query
def stream_batch_summary(spark, sf):
    """The same counts from a stream over the table's file, final state."""
    events = _read(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events*.parquet").parquet(sf)
    return batches.run_available(batches.daily_counts(stream), batches.shared_path(spark, "daily"))

"""Deterministic relations of the engine's input shapes, derived from the sample tables.

Each relation is one SELECT over named tables that Spark SQL and other engines read alike, so that it can serve on both
sides of a comparison. Values are synthetic: they exercise rules and say nothing about real scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _dec(expr: str) -> str:
    return f"cast(({expr}) as double) / cast(100 as double)"


_KEYS = "l_orderkey AS o, l_partkey AS p, l_suppkey AS s, cast(l_linenumber AS bigint) AS n"
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"

PAGE_METRICS = f"""
SELECT o AS doc_id, page_number, total_pages,
  {_dec('(p * 7919 + s * 104729 + n * 131) % 10001')} AS ocr,
  {_dec('(p * 613 + o * 17 + s * 29) % 5501')} AS hw,
  {_dec('(o * 389 + p * 53) % 20001')} AS blur,
  cast(300 + (p * 31 + s * 7) % 1500 AS int) AS width,
  cast(250 + (o * 13 + s * 3) % 1500 AS int) AS height,
  cast((o * 5 + n * 3 + s) % 17 AS int) AS hot_regions,
  cast(12 AS double) + {_dec('(p * 97 + n * 1009) % 24001')} AS brightness,
  cast(14 AS double) + {_dec('(o * 71 + p * 11) % 6001')} AS contrast,
  {_dec('(s * 211 + p * 3) % 10001')} AS white_space,
  {_dec('(o * 19 + s * 401) % 9001')} - cast(45 AS double) AS skew,
  {_dec('(p * 59 + o * 7) % 2601')} AS thick,
  {_dec('(o * 23 + p * 5 + n * 37) % 10201')} AS irregularity,
  {_dec('(s * 313 + o * 3 + n * 57) % 10001')} AS brisque,
  cast((p * 3 + n) % 12 AS int) AS hi_words,
  cast((o + n) % 6 AS int) AS regions,
  cast((p * 7 + s) % 120 AS int) AS chars,
  {_dec('(p * 61 + o * 13) % 10001')} AS stroke,
  {_dec('(o * 43 + s * 17) % 6001')} AS baseline,
  {_dec('(p * 29 + n * 97) % 10001')} AS spacing,
  {_dec('(s * 71 + o * 31) % 10001')} AS component
FROM (
  SELECT {_KEYS},
    cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS int) AS page_number,
    cast(count(*) OVER (PARTITION BY l_orderkey) AS int) AS total_pages
  FROM lineitem) AS k
"""

# Phrases appended to texts so that each marker rule fires.
PHRASES = ["", "", " index-ii सूची क्र.2", " regn. 63m", " agreement to sell", " गावाचे नाव stamp duty registration fee", " no objection certificate index ii", " stamp duty echallan"]
_PHRASE = "CASE cast(doc_id % 8 AS int) " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES)) + " END"

MARKER_TEXT = f"SELECT doc_id, concat(text, {_PHRASE}) AS text FROM documents"
#: Texts without any fuzzy hit beside the phrase.
MARKER_TEXT_CLEAN = f"SELECT doc_id, concat(repeat('0123456789 ', 12), {_PHRASE}) AS text FROM documents"

# Captions that reach each branch of the caption parser.
CAPTIONS_TEXT = ["a handwritten letter", "a printed form with typed text", "a typed page with a signature and stamp", "an official page in ink", "a page written with a pen and ink", "a certificate", "a cat", "a scanned document with text written on a template"]
_CAPTION = "CASE cast(doc_id % 8 AS int) " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CAPTIONS_TEXT)) + " END"
CAPTIONS = f"SELECT doc_id, 1 AS page_number, {_CAPTION} AS explanation, doc_id % 29 = 0 AS timed_out, doc_id % 31 = 0 AS failed FROM documents"

#: A caption for every page.
PAGE_CAPTIONS = f"""
SELECT doc_id, page_number, {_CAPTION.replace('doc_id % 8', '(doc_id * 3 + page_number) % 8')} AS explanation,
  (doc_id + page_number) % 29 = 0 AS timed_out, (doc_id + page_number) % 31 = 0 AS failed
FROM ({PAGE_METRICS}) AS m
"""

# What the four recognition passes of a page are made to give.
_PASS = "CASE WHEN doc_id % 5 = 0 AND {p} = 1 THEN ' ' WHEN doc_id % 3 = 0 AND {p} = 2 THEN NULL WHEN doc_id % 7 = 0 AND {p} < 4 THEN '' ELSE concat('pass {p} ', text) END"
OCR_PASSES = " UNION ALL ".join(f"SELECT doc_id, 1 AS page_number, {p} AS pass, {_PASS.format(p=p)} AS text FROM documents" for p in (1, 2, 3, 4))

# Phrases that the header passes of some documents are made to read.
HEADER_PHRASES = ["", " index-2", " सब रजिस्ट्रार", " REGN 63M", " सूची क्र.2"]
_HEADER = "CASE cast((doc_id + {k}) % 11 AS int) " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(HEADER_PHRASES)) + " ELSE '' END"
HEADER_TEXT = " UNION ALL ".join(
    f"SELECT doc_id, {variant} AS variant, {psm} AS psm, concat(substring(text, 1, 100), {_HEADER.format(k=variant * 3 + psm)}) AS text FROM documents"
    for variant in range(4) for psm in (6, 7)
)

SUBMISSIONS = """
SELECT cast(floor(o_custkey / 5) AS bigint) AS batch_id, o_orderkey AS doc_id, (o_orderkey * 7919) % 12000000 AS length,
  cast(row_number() OVER (PARTITION BY cast(floor(o_custkey / 5) AS bigint) ORDER BY o_orderkey) AS int) AS idx,
  concat('f', cast(o_orderkey AS varchar(20)), CASE cast(o_orderkey % 11 AS int) WHEN 0 THEN '.txt' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpg' ELSE '.pdf' END) AS filename
FROM orders
"""

UPLOADS = """
SELECT user_id AS batch_id, event_id AS item_idx, (event_id * 7919) % 12000000 AS length,
  concat('f', cast(event_id AS varchar(20)), CASE cast(event_id % 9 AS int) WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpg'
    WHEN 3 THEN '.jpeg' WHEN 4 THEN '.bmp' WHEN 5 THEN '.tiff' WHEN 6 THEN '.txt' WHEN 7 THEN '' ELSE '.pdf.exe' END) AS filename
FROM events
"""

URLS = """
SELECT page_id,
  CASE cast(page_id % 6 AS int) WHEN 0 THEN concat(url, '.pdf') WHEN 1 THEN concat(url, '.JPG') WHEN 2 THEN concat('no-scheme/', cast(page_id AS varchar(20)))
    WHEN 3 THEN concat(url, '?x=1.png') WHEN 4 THEN concat('http://h.example/a.b/', cast(page_id AS varchar(20)), '.tif') ELSE url END AS url,
  CASE cast(page_id % 7 AS int) WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/PNG; charset=x' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'text/html' WHEN 4 THEN 'image/tiff' END AS content_type
FROM pages
"""

DOWNLOADS = f"""
SELECT page_id, url, content_type, CASE WHEN page_id % 4 = 0 THEN concat('custom', cast(page_id AS varchar(20))) END AS filename,
  CASE WHEN page_id % 19 = 0 THEN 'timeout' WHEN page_id % 23 = 0 THEN 'connection' WHEN page_id % 29 = 0 THEN 'bad chunk' END AS failure,
  CASE WHEN page_id % 13 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN page_id % 13 = 0 THEN 'Not Found' ELSE 'OK' END AS reason,
  CASE WHEN page_id % 3 = 0 THEN page_id * 104729 % 16777216 END AS content_length, page_id * 15485863 % 16777216 AS length
FROM ({URLS}) AS u
"""

PAGE_VISUALS = f"""
SELECT DISTINCT o AS doc_id, cast((o * 37) % 260 AS int) AS peak_count, cast((o * 11) % 8 AS int) AS seal_count,
  CASE WHEN o % 5 = 0 THEN concat('REG', cast(o * 100003 AS varchar(20))) WHEN o % 5 = 1 THEN 'ABC1' END AS barcode_data,
  cast((o * 101) % 9000 AS double) AS h_lines, cast((o * 67) % 5000 AS double) AS v_lines,
  cast(500 + o % 1200 AS int) AS width, cast(600 + o % 1500 AS int) AS height,
  o % 3 = 0 AS has_barcode, o % 4 = 0 AS has_seal, o % 2 = 0 AS has_table
FROM (SELECT {_KEYS} FROM lineitem) AS k
"""


def relation(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a derivation over the tables of ``sf_dir`` without registering any view."""
    names = [t for t in ("lineitem", "documents", "events", "pages", "embeddings", "conversations", "orders") if f"FROM {t}" in text]
    for t in names:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})


def page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, PAGE_METRICS)


def drawn_pages(suppliers: DataFrame) -> DataFrame:
    """A small gray page for each supplier: lines of text-like bars; on some a seal, a grid, a bar code or noise; every 17th has no image.

    ``origin`` (the key), ``height``, ``width``, ``n_channels``, ``data``.
    """

    def run(parts):
        import numpy as np
        import pandas as pd

        names = ["origin", "height", "width", "n_channels", "data"]
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"height": "Int32", "width": "Int32", "n_channels": "Int32"})
        for part in parts:
            rows = []
            for key in part["origin"].tolist():
                if len(rows) == 256:
                    yield frame(rows)
                    rows = []
                if key % 17 == 16:
                    rows.append((key, None, None, None, None))
                    continue
                draw = np.random.default_rng(key)
                h, w = 180 + key % 5 * 10, 150 + key % 7 * 10
                g = np.full((h, w), 255, np.uint8)
                at = [(y, x) for y in range(20, h - 10, 14 + key % 3) for x in range(8, w - 12, 9)]
                # shade, height and width of each bar, in this order
                bars = draw.integers(np.tile([0, 0, 2], len(at)), np.tile([90, 3, 7], len(at))).reshape(-1, 3).tolist()
                for (y, x), (shade, down, across) in zip(at, bars):
                    g[y : y + 5 + down, x : x + across] = shade
                if key % 4 == 0:
                    y, x = np.indices((h, w))
                    g[np.abs(np.hypot(y - h // 2, x - w // 2) - 45) < 2] = 0
                if key % 5 == 0:
                    g[::18] = 0
                    g[:, ::18] = 0
                if key % 3 == 0:
                    g[2:16, 10 : w - 10 : 4] = 0
                if key % 6 == 1:
                    g = np.clip(g + draw.normal(0, 12, g.shape), 0, 255).astype(np.uint8)
                rows.append((key, h, w, 1, g.tobytes()))
            yield frame(rows)

    # keys are few bytes and pages much work: a file of them goes to all cores
    keys = suppliers.select(suppliers["s_suppkey"].alias("origin"))
    return keys.repartition(8 * suppliers.sparkSession.sparkContext.defaultParallelism, "origin").mapInPandas(run, "origin long, height int, width int, n_channels int, data binary")

"""Files that arrive and what is answered for a batch of them."""

import json

from pyspark.sql import functions as F

from pagewright.functions import files
from pagewright.operators import rollup
from pagewright.sources.files import pdf_pages, read_uploads, with_download_errors
from pagewright.sources.providers import captions_from, downloads_from
from pagewright.sources.sinks import write_responses, write_results


def test_uploads(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"x" * 10)
    (tmp_path / "b.txt").write_bytes(b"x")
    (tmp_path / "c.png").write_bytes(b"x" * (10_485_760 + 1))
    got = {r["filename"]: (r["length"], r["error"]) for r in read_uploads(spark, f"file://{tmp_path}").drop("content").collect()}
    assert got == {"a.PDF": (10, None), "b.txt": (1, "Invalid file type"), "c.png": (10_485_761, "File too large. Maximum size: 10.0MB")}
    assert read_uploads(spark, f"file://{tmp_path}/a.PDF").count() == 1


def test_downloads(spark):
    big = 10_485_760 + 52_429
    rows = [
        ("nohost", None, None, 200, "OK", None, None, 5), ("http://h/a", None, "timeout", None, None, None, None, None), ("http://h/a", None, "connection", None, None, None, None, None),
        ("http://h/a", None, "odd", None, None, None, None, None), ("http://h/a", "n", None, 404, "Not Found", None, None, 0), ("http://h/a", "n", None, 200, "OK", None, big, 1),
        ("http://h/a", "n", None, 200, "OK", None, None, big), ("http://h/a.TIF", "n", None, 200, "OK", "image/png", 5, 5), ("http://h/a", "n", None, 200, "OK", "image/png; x=1", 5, 5), ("http://h/a", "", None, 200, "OK", None, None, 5),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, url string, filename string, failure string, status int, reason string, content_type string, content_length long, length long")
    got = [(r["error"], r["saved_as"]) for r in sorted(with_download_errors(df).select("i", "error", "saved_as").collect())]
    large = "File too large (10.05MB). Maximum size: 10.00MB"
    assert got[:9] == [
        ("Invalid URL format", None), ("Request timeout", None), ("Connection error - could not reach the server", None), ("Request error: odd", None), ("HTTP error: 404 - Not Found", None),
        (large, None), (large, None), (None, "n.tif"), (None, "n.png"),
    ]
    assert got[9][0] is None and got[9][1].endswith(".pdf") and len(got[9][1]) > 5


def test_client_filter(spark):
    rows = [("a.pdf", None, 5, True), ("a.txt", "image/png", 5, True), ("a.txt", "text/plain", 5, False), ("a.JPG", None, 10_485_761, False), (None, "application/pdf", 5, True), (None, None, 5, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, t string, size long, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", files.client_accepts(F.col("n"), F.col("t"), F.col("size")).alias("got")).collect())


def test_responses(spark):
    """Refused files are errors, documents without a result are UNKNOWN, and a batch of more than fifty is refused."""
    names = [(1, 1, 10, "a.pdf", None), (1, 2, 11, "b.txt", "Invalid file type"), (1, 3, 12, "c.pdf", None), *((2, i, 100 + i, f"{i}.pdf", None) for i in range(1, 52)), (3, 1, 13, None, "No file selected")]
    batch = spark.createDataFrame(names, "batch_id long, idx int, doc_id long, filename string, error string")
    items = spark.createDataFrame([(10, 2, 1, "ACCEPTED", "pages_passed", 77.5, 80.0)], "doc_id long, total_pages int, accepted_pages long, status string, reason string, score double, ocr_confidence double")
    got = {r["batch_id"]: json.loads(r["response"]) for r in rollup.batch_responses(rollup.response_entries(batch, items)).collect()}
    assert got[1]["summary"] == {"total_files": 3, "successful": 1, "failed": 1, "accepted": 1, "rejected": 0, "flagged_for_review": 0}
    assert [(r["idx"], r["success"], r["status"], r["score"], r["total_pages"]) for r in got[1]["results"]] == [(1, True, "ACCEPTED", 77.5, 2), (3, False, "UNKNOWN", 0.0, 1)]
    assert got[1]["errors"] == [{"idx": 2, "filename": "b.txt", "error": "Invalid file type"}]
    assert got[2] == {"success": False, "error": "Too many files. Maximum 50 files allowed per bulk upload."}
    assert got[3]["results"] == [] and got[3]["summary"]["failed"] == 1
    assert rollup.batch_responses(rollup.response_entries(batch.limit(0), items)).collect() == []


def test_pdf_pages(spark):
    rows = [("/x/a.b.pdf", [b"1", b"2"], None), ("c.pdf", [b"3"], "broken"), ("d.pdf", [], None), ("e.pdf", None, None)]
    df = spark.createDataFrame(rows, "path string, images array<binary>, failure string")
    got = {(r["path"], r["page_number"], r["page_name"], None if r["image"] is None else bytes(r["image"]), r["error"]) for r in pdf_pages(df).collect()}
    none = "PDF conversion failed: no pages"
    assert got == {("/x/a.b.pdf", 1, "a.b_page_1.png", b"1", None), ("/x/a.b.pdf", 2, "a.b_page_2.png", b"2", None), ("c.pdf", None, None, None, "PDF conversion failed: broken"), ("d.pdf", None, None, None, none), ("e.pdf", None, None, None, none)}
    assert pdf_pages(df, first_page_only=True).where("path like '/x%'").count() == 1


def test_providers(spark):
    def caption(data):
        if data == b"slow":
            raise TimeoutError("20 s")
        if data == b"bad":
            raise ValueError("no image")
        return {"explanation": "a printed form"}

    rows = [(1, 1, 70.0, 30.0, b"x"), (2, 1, 70.0, 30.0, b"slow"), (3, 1, 70.0, 30.0, b"bad"), (4, 1, 20.0, 30.0, b"never asked")]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, ocr double, hw double, data binary")
    got = {r["doc_id"]: tuple(r)[2:] for r in captions_from(df, caption).collect()}
    assert got == {1: ("a printed form", False, False, None), 2: (None, True, False, "20 s"), 3: (None, False, True, "ValueError: no image")}

    def fetch(url):
        if "slow" in url:
            raise TimeoutError
        if "gone" in url:
            raise ConnectionError("refused")
        return {"status": 200, "reason": "OK", "content_type": "image/png", "content_length": 3, "content": b"abc"}

    urls = spark.createDataFrame([("http://h/ok", "n"), ("http://h/slow", None), ("http://h/gone", None)], "url string, filename string")
    told = {r["url"][9:]: (r["error"], r["saved_as"], r["length"]) for r in with_download_errors(downloads_from(urls, fetch)).collect()}
    assert told == {"ok": (None, "n.png", 3), "slow": ("Request timeout", None, None), "gone": ("Connection error - could not reach the server", None, None)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "{}"), (2, "[]")], "batch_id long, response string")
    write_results(df, f"file://{tmp_path}/t", by=["batch_id"])
    write_responses(df, f"file://{tmp_path}/j")
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 2 and sorted(r[0] for r in spark.read.text(f"file://{tmp_path}/j").collect()) == ["[]", "{}"]

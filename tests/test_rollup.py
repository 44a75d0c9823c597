import random

from pyspark.sql import functions as F

from pagewright.operators import rollup

SCHEMA = "doc_id long, page_number int, total_pages int, final_score double, has_critical boolean, is_error boolean, status string, rule_id string, ocr double"


def pages(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"priority": F.lit("Normal"), "message": F.lit("m"), "hw": F.lit(1.0)})
    return df.withColumns({"critical": F.when(F.col("has_critical"), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")), "warnings": F.array(F.lit("w"))})


def best_of(rows):
    """The same choice, page after page."""
    rows = sorted(rows, key=lambda r: r[1])
    total, best = rows[0][2], None
    for r in rows:
        if r[5]:
            continue
        if total == 2:
            best = r if r[1] == 2 else best
        elif best is None or (best[4] and not r[4]) or (best[4] == r[4] and r[3] > best[3]):
            best = r
    return best or max(rows, key=lambda r: r[3])


def test_best_page_against_a_loop(spark):
    r = random.Random(2)
    rows = []
    for d in range(150):
        n = r.choice([1, 2, 2, 3, 5])
        for p in range(1, n + 1):
            error = r.random() < 0.2
            rows.append((d, p, n, 0.0 if error else float(r.choice([40, 60, 60, 80])), error or r.random() < 0.4, error, "REJECTED" if error else r.choice(["ACCEPTED", "REJECTED", "FLAG_FOR_REVIEW"]), "PAGE_ERROR" if error else "D3n", None if error else 50.0))
    got = {x["doc_id"]: x["best_page"] for x in rollup.best_pages(pages(spark, rows)).collect()}
    assert got == {d: best_of([x for x in rows if x[0] == d])[1] for d in range(150)}


def test_document_patch_and_bulk(spark):
    row = lambda d, p, n, score, crit, status: (d, p, n, score, crit, False, status, "D3n", 50.0)
    rows = [
        row(1, 1, 1, 60.0, False, "FLAG_FOR_REVIEW"),
        row(2, 1, 2, 90.0, False, "ACCEPTED"), row(2, 2, 2, 40.0, False, "REJECTED"),
        row(3, 1, 3, 50.0, True, "ACCEPTED"), row(3, 2, 3, 45.0, False, "REJECTED"), row(3, 3, 3, 20.0, True, "REJECTED"),
        row(4, 1, 3, 50.0, False, "FLAG_FOR_REVIEW"), row(4, 2, 3, 45.0, False, "REJECTED"), row(4, 3, 3, 20.0, True, "REJECTED"),
        row(5, 1, 2, 90.0, False, "REJECTED"), row(5, 2, 2, 70.0, False, "ACCEPTED"),
    ]
    docs = rollup.document_decisions(pages(spark, rows))
    got = {x["doc_id"]: (x["best_page"], x["status"], x["message_kind"]) for x in docs.collect()}
    assert got == {1: (1, "FLAG_FOR_REVIEW", "page"), 2: (2, "REJECTED", "page"), 3: (2, "ACCEPTED", "accepted_pages"), 4: (1, "FLAG_FOR_REVIEW", "rejected_all"), 5: (2, "ACCEPTED", "accepted_prefix")}
    items = rollup.batch_items(docs)
    assert {x["doc_id"]: (x["status"], x["reason"]) for x in items.collect()} == {1: ("FLAG_FOR_REVIEW", "m"), 2: ("ACCEPTED", "pages_passed"), 3: ("ACCEPTED", "pages_passed"), 4: ("REJECTED", "all_failed"), 5: ("ACCEPTED", "pages_passed")}
    total = rollup.batch_summary(items.withColumns({"batch_id": F.lit(1), "error": F.when(F.col("doc_id") == 1, "bad")})).first().asDict()
    assert total == {"batch_id": 1, "total": 5, "successful": 4, "failed": 1, "accepted": 3, "rejected": 1, "flagged": 0}

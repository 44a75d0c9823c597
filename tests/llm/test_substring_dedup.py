import random
import re
from collections import Counter

from pagewright.llm import substring_dedup
from pagewright.llm.substring_dedup import dedup_substrings, without_repeats


def brute(rows, width):
    words = [re.findall(r"[^\x20\x09-\x0d]+", t or "", re.A) for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (k, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def rows_of(seed=1):
    r = random.Random(seed)
    vocab = [f"w{i}é" for i in range(300)]
    passage = [r.choice(vocab) for _ in range(60)]
    rows = []
    for k in range(80):
        w = [r.choice(vocab) for _ in range(r.choice([0, 5, 34, 35, 36, 90, 400]))]
        if k % 3 == 0:
            at = r.randrange(len(w) + 1)
            w[at:at] = passage[r.randrange(10) : 60 - r.randrange(10)]
        rows.append((k, r.choice([" ", "\n", "  \t"]).join(w)))
    rows += [(100, rows[5][1]), (101, None), (102, ""), (103, " \n "), (100, rows[5][1]), (100, "other text"), (None, rows[7][1])]
    rows.append((104, " ".join(["a"] * 200)))
    rows.append((105, " ".join(vocab) + " " + " ".join(vocab)))
    return rows


def test_against_brute_force(spark):
    for width in (35, 7):
        rows = rows_of(width)
        df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, n_words int").repartition(5)
        got = sorted((tuple(r) for r in dedup_substrings(df, width=width).collect()), key=str)
        assert got == brute(rows, width)


def test_clean_text_keeps_separators(spark):
    block = " ".join(f"x{i}" for i in range(40))
    df = spark.createDataFrame([(1, f"head  here\n{block}\ntail  end"), (2, f"{block}")], "doc_id long, text string")
    got = {r["doc_id"]: r["clean_text"] for r in dedup_substrings(df, with_clean=True).collect()}
    assert got == {1: "head  here\ntail  end", 2: ""}


def test_without_repeats_keeps_columns(spark):
    rows = [(1, "a b c x", "k", 5), (2, "y a b c", None, 6), (3, None, "m", 7), (None, "q r", "n", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, clean_text string, _k1 int")
    got = sorted((tuple(r) for r in without_repeats(df, width=3).collect()), key=str)
    assert got == sorted([(1, "x", "k", 5), (2, "y ", None, 6), (3, None, "m", 7), (None, "q r", "n", 8)], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_substrings(df).collect() == []


def thue_morse(n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_that_differ_in_the_order_of_their_bytes(spark):
    x, y = thue_morse(10)
    rest = [f"w{i}" for i in range(34)]
    rows = [(1, " ".join([x, *rest])), (2, " ".join([y, *rest])), (3, "\n".join([y, *rest]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in dedup_substrings(df).collect())
    assert got == [(1, 35, 0), (2, 35, 35), (3, 35, 35)]


def test_windows_of_hot_grams_only(spark, monkeypatch):
    """Grams that stand out are no minimisers; windows of nothing else go by longer grams, with the same result."""
    monkeypatch.setattr(substring_dedup, "HOT_TIMES", 0)
    r = random.Random(3)
    rows = [(k, " ".join(r.choice("ab") for _ in range(r.choice([40, 60, 90])))) for k in range(60)]
    rows += [(100 + k, " ".join(["of the"] * 40) + f" end{k} " + " ".join(f"u{k}_{i}" for i in range(50))) for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for width in (7, 20):
        got = sorted(((x["doc_id"], x["n_words"], x["n_removed"], x["kept_text"]) for x in dedup_substrings(df, width=width).collect()), key=str)
        assert got == brute(rows, width)


def test_very_long_texts(spark):
    r = random.Random(9)
    words = [f"v{r.randrange(5000)}" for _ in range(400_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[1000:1200]) + " end"), (3, "z" * 2_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(x) for x in dedup_substrings(df).collect()), key=str) == brute(rows, 35)

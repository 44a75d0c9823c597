import random
import re

import numpy as np

from pagewright.llm import decontaminate
from pagewright.llm.decontaminate import drop_contaminated, find_leaks, suffix_array


def words(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items, window):
    out = []
    for k, t in docs:
        w, hit, found = words(t), set(), set()
        for i, text in items:
            v = words(text)
            n = min(window, len(v))
            for a in range(len(v) - n + 1 if v else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit.update(range(b, b + n))
                        found.add(str(i))
        out.append((k, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def case():
    r = random.Random(4)
    vocab = ["é%d" % i for i in range(12)] + ["Word", "x9"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 4, 9, 10, 11, 25])))) for i in range(12)] + [(50, None), (51, "..."), (3, "Zed yes")]
    docs = []
    for k in range(40):
        w = [r.choice(vocab) for _ in range(r.choice([0, 3, 12, 60]))]
        for _ in range(r.choice([0, 1, 2])):
            at = r.randrange(len(w) + 1)
            w[at:at] = (r.choice(items)[1] or "zed YES!").split()
        docs.append((k, r.choice([" ", ", ", "\n"]).join(w).upper() if k % 2 else " ".join(w)))
    return docs + [(90, None), (91, ""), (0, docs[0][1]), (None, docs[1][1])], items


def clean(rows):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows), key=str)


def test_against_brute_force(spark, monkeypatch):
    docs, items = case()
    items = [(i, t or None) for i, t in items]
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, n_hit int").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    for window in (10, 3):
        assert clean(find_leaks(d, i, window).collect()) == brute(docs, items, window)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    assert clean(find_leaks(d, i, 10).dropDuplicates(["doc_id", "n_words", "n_hit"]).collect()) == sorted({str(x): x for x in brute(docs, items, 10)}.values(), key=str)


def test_longest_match(spark):
    text = " ".join(f"w{i}" for i in range(30))
    d = spark.createDataFrame([(1, f"a b {text} c"), (2, "a b c")], "doc_id long, text string")
    i = spark.createDataFrame([(7, f"q {text}")], "item_id long, text string")
    rows = {r["doc_id"]: r["spans"] for r in find_leaks(d, i).collect()}
    assert [tuple(s) for s in rows[1]] == [("7", 1, 2, 30)] and rows[2] == []
    assert [r["doc_id"] for r in drop_contaminated(d, i).collect()] == [2]
    assert find_leaks(d.limit(0), i).collect() == []
    assert [r["n_hit"] for r in find_leaks(d, i.limit(0)).collect()] == [0, 0]


def test_suffix_array():
    r = np.random.default_rng(0)
    for n in (1, 2, 50, 400):
        codes = r.integers(0, 3, n).astype(np.uint64)
        order = suffix_array(codes, 16).tolist()
        keys = [tuple(codes[i : i + 16].tolist()) for i in order]
        assert keys == sorted(keys) and sorted(order) == list(range(n))

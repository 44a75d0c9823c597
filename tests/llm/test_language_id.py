import math
from collections import Counter

import numpy as np
import regex

from pagewright.llm.language_id import UNKNOWN, WORD, keep_identified, learn, predict
from pagewright.llm.queries import op9_language_id

ROWS = [(1, "The cat and the dog", "en", 0.1), (2, "le chat et le chien", "fr", 0.2), (3, "der Hund und die Katze", "de", None), (4, None, "en", 0.0), (5, "123 !?", "fr", 1.0), (6, "unlabelled text", None, 1.0)]
SCHEMA = "doc_id long, text string, lang string, score double"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in op9_language_id(spark, sf).collect()]
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and 200 < len(held) < 500
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95


def brute_learn(rows):
    """Plain counts: words and padded n-grams for each language."""
    langs = sorted({lang for _, lang in rows if lang is not None and regex.search(WORD, (_ or "").lower())})
    counts = [{x: Counter() for x in langs} for _ in range(5)]
    for text, lang in rows:
        if lang is None:
            continue
        for w in regex.findall(WORD, (text or "").lower()):
            counts[0][lang][w] += 1
            p = f" {w} "
            for k in range(1, 5):
                counts[k][lang].update(g for i in range(len(p) - k + 1) if (g := p[i : i + k]).strip())
    return langs, counts


def brute_predict(text, langs, counts):
    words = regex.findall(WORD, (text or "").lower())
    if not words or not langs:
        return UNKNOWN, 0.0
    totals = [[max(1, sum(c[x].values())) for x in langs] for c in counts]

    def unit(k, u):
        if not any(u in counts[k][x] for x in langs):
            return None
        return [math.log(counts[k][x][u] / n if u in counts[k][x] else 0.5 / max(totals[k])) for x, n in zip(langs, totals[k])]

    sums = [0.0] * len(langs)
    for w in words:
        scores = [unit(0, w)] if unit(0, w) else []
        p = f" {w} "
        for k in range(min(4, len(p)), 0, -1):
            if scores:
                break
            scores = [s for i in range(len(p) - k + 1) if (s := unit(k, p[i : i + k]))]
        for j in range(len(langs)):
            sums[j] += sum(s[j] for s in scores) / max(1, len(scores))
    z = [s / math.sqrt(len(words)) for s in sums]
    e = [math.exp(x - max(z)) for x in z]
    return langs[z.index(max(z))], max(e) / sum(e)


def test_against_brute_force(spark):
    """Learning and predicting again in plain Python; with small heads, which send words and n-grams to the joins, the same results."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").limit(120)
    extra = [(-1, None, "en"), (-2, "12", "en"), (-3, "xqzt жук " + "b" * 60, "en"), (-4, "ééa " * 4000, None), (-4, "ééa " * 4000, None)]
    df = docs.union(spark.createDataFrame(extra, docs.schema)).persist()
    learned = df.where("doc_id % 3 <> 1")
    langs, counts = brute_learn([(r["text"], r["lang"]) for r in learned.collect()])
    want = sorted((r["doc_id"], *brute_predict(r["text"], langs, counts)) for r in df.collect())
    words, grams = (len(set().union(*(u for c in some for u in c.values()))) for some in (counts[:1], counts[1:]))
    for cells in (1 << 21, 4 * min(words, grams), 1_000):
        model = learn(learned, max_cells=cells)
        assert model["langs"] == langs and (model["words_table"] is None, model["grams_table"] is None) == (words <= cells // 4, grams <= cells // 4)
        got = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in predict(df, model).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])
    df.unpersist()


def test_ties_go_to_the_first_language(spark):
    df = spark.createDataFrame([(1, "same words", "zz"), (2, "same words", "aa")], "doc_id long, text string, lang string")
    assert [tuple(r)[1:] for r in predict(df, learn(df)).collect()] == [("aa", 0.5)] * 2


def test_defined_cases(spark):
    df = spark.createDataFrame(ROWS + ROWS[:1], SCHEMA)
    model = learn(df)
    got = sorted((r["doc_id"], r["lang_pred"]) for r in predict(df, model).collect())
    assert got == [(1, "en"), (1, "en"), (2, "fr"), (3, "de"), (4, UNKNOWN), (5, UNKNOWN), (6, got[-1][1])]
    assert sorted({r["doc_id"] for r in keep_identified(df, model, 0.4).collect()} & {1, 2, 3, 4, 5}) == [1, 2, 3]
    assert predict(df.limit(0), model).collect() == []
    nothing = learn(df.limit(0))
    assert {r["lang_pred"] for r in predict(df, nothing).collect()} == {UNKNOWN}


def test_long_runs(spark):
    """Words of any length are learned and known, and their n-grams count."""
    df = spark.createDataFrame([(1, "กขคงจ" * 12, "th"), (2, "the cat and the dog", "en")], "doc_id long, text string, lang string")
    model = learn(df)
    assert "กขคง" in model["grams"] and len(model["word_hash"]) == 5
    got = predict(spark.createDataFrame([(3, "ขคงจก" * 11), (4, "the dog"), (5, "กขคงจ" * 200_000)], "doc_id long, text string"), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {3: "th", 4: "en", 5: "th"}


def test_keep_identified_keeps_columns(spark):
    rows = [(1, "the cat", "en", "a"), (1, "the cat", "en", "a"), (None, "the dog", "en", None), (2, "...", None, "b"), (None, None, "en", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _k1 string, _text string")
    model = learn(spark.createDataFrame(ROWS, SCHEMA))
    assert sorted((tuple(r) for r in keep_identified(df, model, 0.4).collect()), key=str) == sorted(rows[:3], key=str)
    assert keep_identified(df.limit(0), model).collect() == []


def test_new_words_of_many_texts_are_scored_at_once(spark, monkeypatch):
    """One look-up for all texts of a slice, and n-gram scores as by a plain walk, for characters of any plane and words of any length."""
    from pagewright.llm import language_id as L

    rows = [(1, "the cat 𐐨𐐩𐐪 ab", "en"), (2, "le chat жук ééa " + "b" * 60, "fr"), (3, "der Hund กขคง", "de")]
    model = learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    words = ["cats", "𐐩𐐪x", "жу", "éé", "b", "bb", "z", "語", "กขคa", "chats" * 70_000, "c"]
    at = {g: i for i, g in enumerate(model["grams"])}

    def plain(word):
        p = f" {word} "
        for k in range(min(4, len(p)), 0, -1):
            if hits := [at[g] for i in range(len(p) - k + 1) if (g := p[i : i + k]) in at]:
                return model["gram_logs"][hits].mean(axis=0)
        return np.zeros(3)

    scorer = L.Scorer(model | {"levels": L._levels(model["grams"])})
    assert np.allclose(scorer.by_grams(words), [plain(w) for w in words]) and scorer.by_grams([]).shape == (0, 3)
    calls, own = [], scorer.look_up
    monkeypatch.setattr(scorer, "look_up", lambda new: calls.append(len(new)) or own(new))
    texts = [f"{w} cat {w}" for w in words] + ["", "12"]
    counts, sums, row, word, times = scorer.sums(texts)
    assert calls == [len(words) + 1] and counts.tolist() == [3] * len(words) + [0, 0]
    cat = scorer.look_up(["cat"])[0][0]
    assert np.allclose(sums, [*(2 * scorer.look_up([w])[0][0] + cat for w in words), np.zeros(3), np.zeros(3)])
    tail = [i for i, w in enumerate(words) if scorer.look_up([w])[1][0]]
    assert sorted(zip(row.tolist(), word, times.tolist())) == [(i, words[i], 2) for i in tail]
    nothing = L.Scorer({"langs": [], "word_hash": np.zeros(0, np.uint64), "word_logs": np.zeros((0, 0)), "levels": L._levels([]), "gram_logs": np.zeros((0, 0))})
    assert nothing.sums(["a b"])[0].tolist() == [2] and nothing.by_grams(["a"]).shape == (1, 0)

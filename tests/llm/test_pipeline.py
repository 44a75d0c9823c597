import random
import re
import subprocess
import sys

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0d]+", t)


def shingles(t, n=5):
    w = spaced("".join(c.lower() if c.isascii() else c for c in t))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def test_stages_against_brute_force(spark, tmp_path):
    r = random.Random(9)
    english = "the of and to in that it is was for on with as his they at be this from have or by one had not but what all were when".split()
    french = "le de un et il ne je son que se qui ce dans en du elle au pour pas cela nous sur faire plus dire me on mon lui avec".split()

    def prose(words, n):
        return " ".join(r.choice(words) + r.choice(["", "", "a", "e", "in"]) for _ in range(n))

    leak = prose(english, 14)
    shared = prose(french, 60)
    base = prose(english, 120)
    near = base.split()
    near[7] = "changed"
    texts = [prose(english, 80), prose(french, 90), base, base, " ".join(near), prose(english, 50) + " " + leak, prose(french, 70) + "\n" + shared, shared + "\n" + prose(french, 75), None, "12345 %%%", prose(english, 6)]
    rows = [(i, t, "fr" if t and t.startswith(tuple(french)) else "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    spark.createDataFrame([(1, "x " + leak), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns

    stage = [f(spark, docs, str(tmp_path)) for f in [corpus_pipeline.identify]][0]
    assert stage.columns == columns and {x["doc_id"] for x in stage.collect()} == set(range(11)) - {8, 9}

    kept = corpus_pipeline.drop_near_duplicates(spark, stage, str(tmp_path))
    sets = {i: shingles(t) for i, t in enumerate(texts) if i not in (8, 9)}
    twins = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert twins == {(2, 3), (2, 4), (3, 4)}
    assert kept.columns == columns and {x["doc_id"] for x in kept.collect()} == set(sets) - {3, 4}

    cut = corpus_pipeline.cut_repeats(spark, kept, str(tmp_path))
    after = {x["doc_id"]: x for x in cut.collect()}
    assert cut.columns == columns and all(x["n_chars"] == len(x["text"]) for x in after.values())
    assert not set(spaced(shared)[0:1]) - set(spaced(texts[6])) and len(spaced(after[6]["text"])) == 70 and len(spaced(after[7]["text"])) == 75
    assert after[0]["text"] == texts[0]

    clean = corpus_pipeline.drop_leaks(spark, cut, str(tmp_path))
    assert clean.columns == columns and {x["doc_id"] for x in clean.collect()} == {0, 1, 2, 6, 7, 10}

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: (len(library.encode(x["text"]).ids), x["text"]) for i, x in after.items() if i != 5}
    assert {x["doc_id"]: (x["n_tokens"], x["text"]) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want


def test_documents_loaded_twice_keep_one_whole_copy(spark, tmp_path):
    """Stage 3 sees no copies that stage 2 left: repeated rows and null ids."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(1, one), (1, one), (None, two), (None, two), (3, three), (3, three + " more"), (None, three)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    cut = corpus_pipeline.cut_repeats(spark, corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)), str(tmp_path)).collect()
    assert sorted((str(x["doc_id"]), x["text"][:2], len(spaced(x["text"])) >= 60) for x in cut) == [("1", "a0", True), ("3", "c0", True), ("None", "b0", True)]


def test_entry_without_llm(tmp_path):
    """With the folders and the pipeline gone, the entry module still imports and has its other queries."""
    import os
    import shutil

    root = os.path.dirname(corpus_pipeline.__file__)
    shutil.copytree(f"{root}/pagewright", tmp_path / "pagewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_stages_with_odd_tables(spark, tmp_path):
    """Columns named like the operators' own, nulls everywhere, repeated rows, and no rows at all."""
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", None, 5, "x", 1), (1, text, "en", None, 5, "x", 1), (None, "the cat sat there", None, "s", None, None, None), (2, None, "en", "s", 0, "y", 2), (3, "", None, None, None, "z", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _text string, _k1 int"
    docs = spark.createDataFrame(rows, schema).withColumnsRenamed({"_k1": "node"}).withColumn("_carry", F.lit(1))
    spark.createDataFrame([(1, "another benchmark passage of many words that nobody wrote before now")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {"language_id": 3, "minhash_dedup": 4, "substring_dedup": 5, "decontaminate": 5}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == left[name], name
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    got = corpus_pipeline.tokens(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted((str(r[0]), r[1] or "") for r in rows)
    assert corpus_pipeline.tokens(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_stages_take_little_memory_beside_the_jvm():
    """What a Python worker allocates for four megabytes of text and for a bucket of the average size."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from pagewright.llm import minhash_dedup, substring_dedup

    words = np.random.default_rng(5).integers(0, 50_000, (2000, 350)).tolist()
    texts = pa.array([" ".join(f"w{x}" for x in row) for row in words])
    ids = pa.array(range(len(texts)), pa.int64())

    def peak(rows) -> float:
        tracemalloc.start()
        for _ in rows:
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most / (1 << 20)

    assert peak(minhash_dedup._sketches(5)(iter([pa.RecordBatch.from_arrays([ids, ids, texts, ids], names=["_k1", "_k2", "_text", "_carry"])]))) < 35

    class NoneHot:
        value = bytes(1 << (substring_dedup.SLOT_BITS - 3))

    size = texts.nbytes
    buckets = max(1, -(-size * substring_dedup.PACKED_TIMES // substring_dedup.BUCKET_BYTES))
    packed = pa.Table.from_batches(list(substring_dedup._pack(35, 4, buckets, NoneHot)(iter([pa.RecordBatch.from_arrays([ids, ids, texts], names=["_k1", "_k2", "_text"])]))))
    one = packed.filter(pa.array(np.asarray(packed.column("bucket")) == 0))
    assert one.num_rows and peak(substring_dedup._count(35)(one) for _ in range(1)) < 60


def test_workers_hold_little_memory():
    """A tokenizer's merges of many words at once stay small, a language model has no table of strings, and what another operator kept is forgotten."""
    import tracemalloc

    from pagewright.llm import _shared, bpe, language_id
    from pagewright.llm.queries import vocabulary

    tokenizer = bpe.Bpe(bpe.load_spec(vocabulary()))
    words = [b"w%07d" % i for i in range(60_000)]
    tracemalloc.start()
    tokenizer._side_by_side(words[:1], 8)
    base = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    codes = tokenizer.merge(words)
    peak = tracemalloc.get_traced_memory()[1] - base
    tracemalloc.stop()
    assert peak < 20 << 20, peak
    assert tokenizer.decode(codes[:100]) == [w.decode() for w in words[:100]]
    assert language_id.MEMO_CELLS <= 1 << 19
    freed = []
    _shared.kept_by_worker("one", lambda: 1)
    _shared._TRIM, own = (lambda _: freed.append(1)), _shared._TRIM
    try:
        assert _shared.kept_by_worker("one", lambda: 2) == 1 and not freed
        assert _shared.kept_by_worker("two", lambda: 2) == 2 and freed
    finally:
        _shared._TRIM = own
        _shared.release()
    assert not _shared._KEPT

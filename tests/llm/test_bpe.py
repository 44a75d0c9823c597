import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagewright.llm.bpe import Bpe, decode, encode, load_spec, round_trip

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return Bpe(load_spec(PATH))


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def texts():
    r = random.Random(5)
    out = ["", " ", "\n\n  x", "I'll we've DON'T it's 'S", "a<|endoftext|>b <|endoftext|>", "<|endoftext|", "x" * 5000, "ab" * 300 + "c" * 70, "日本語 テキスト", "naïve café\x85\x1c\x1d x᠎​", "١٢٣ ½ x²", "🙂👩‍👩‍👧 é"]
    alphabet = "abc thein ABC 019 .,!? '\n\t\réß中Ж́ 　 \U0001f600"
    out += ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 200))) for _ in range(400)]
    out += [" ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(1, 90))) for _ in range(30)) for _ in range(20)]
    return out


def test_same_as_library(own, library):
    sample = texts()
    want = [e.ids for e in library.encode_batch(sample, add_special_tokens=False)]
    got = own.encode(sample)
    assert [ids(g) for g in got] == want
    assert own.decode(got) == [library.decode(w, skip_special_tokens=False) for w in want]


def test_every_character_class(own, library):
    for a in range(0, 0x30000, 64):
        chars = [chr(c) for c in range(a, a + 64) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}b {c}1{c} " for c in chars)
        assert ids(own.encode([text])[0]) == library.encode(text, add_special_tokens=False).ids, hex(a)


def test_pieces_and_broken_codes(own, library, monkeypatch):
    monkeypatch.setattr("pagewright.llm.bpe.PIECE", 7)
    for t in texts()[:200]:
        assert ids(own.encode([t])[0]) == library.encode(t, add_special_tokens=False).ids
    r = np.random.default_rng(1)
    for _ in range(200):
        codes = r.integers(0, 50257, 6)
        assert own.decode([codes.astype("<u4").tobytes()])[0] == library.decode(codes.tolist(), skip_special_tokens=False)


def test_operator(spark, library):
    rows = [(1, "Hello world", "x"), (2, None, None), (None, "", "y"), (1, "Hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = decode(encode(df, PATH), PATH).collect()
    want = [(k, library.encode(t or "", add_special_tokens=False).ids, t or "") for k, t, _ in rows]
    assert sorted([(r["doc_id"], ids(r["ids"]), r["decoded"]) for r in out], key=str) == sorted(want, key=str)
    assert encode(df.limit(0), PATH).collect() == []


def test_round_trip_in_one_pass(spark, library):
    text = "A long text, 1234 words; " * 60_000  # more than one piece
    rows = [(1, text), (2, None), (None, ""), (1, text), (3, "x" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_carry", F.lit(1))
    got = sorted(((r["doc_id"], ids(r["ids"]), r["decoded"], r["_carry"]) for r in round_trip(df, PATH, carry=["_carry"]).collect()), key=str)
    assert got == sorted(((k, library.encode(t or "", add_special_tokens=False).ids, t or "", 1) for k, t in rows), key=str)
    assert round_trip(df.limit(0), PATH).collect() == []


def test_decode_replaces_a_column(spark):
    df = spark.createDataFrame([(1, "Hi")], "doc_id long, text string")
    codes = encode(df, PATH).withColumn("decoded", F.lit("old"))
    assert [tuple(r) for r in decode(codes, PATH).select("doc_id", "decoded").collect()] == [(1, "Hi")]
    with pytest.raises(ValueError):
        decode(codes, PATH, ids_col="decoded")

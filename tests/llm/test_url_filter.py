import random

import pytest

from pagewright.llm import url_filter
from pagewright.llm.url_filter import Bloom, Cascade, build, judge, keys_of, parse_rule


def plain(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = []
    for v, r in rules:
        h, p = parse_rule(r)
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), h + p, v))
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_against_plain_rules(spark, monkeypatch):
    r = random.Random(3)
    labels = ["a", "b", "example", "com", "net", "org", "É"]
    rules = [(r.choice(["block", "allow"]), rule) for rule in {".".join(r.choice(labels[:6]) for _ in range(r.randrange(1, 4))) + r.choice(["/", "/en/", "/en/7", ""]) for _ in range(60)}]
    urls = [f"{r.choice(['http', 'HTTPS', ''])}://{'.'.join(r.choice(labels + ['Example', 'COM']) for _ in range(r.randrange(1, 5)))}{r.choice(['', '/', '/en/7', '/en/71?x=/a', '/EN/', '?q', '#/en/', '/e\nn/'])}" for _ in range(600)]
    urls += [None, "", "no scheme", "://", "http://", "http:///en/", "a://b://c", "http://" + "a." * 300 + "com/en/" + "x" * 3000, urls[0]]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in judge(df, build(df, rules)).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}
    assert judge(df.limit(0), build(df.limit(0), rules)).collect() == []
    assert {x["verdict"] for x in judge(df, build(df, [])).collect()} == {"allow"}


def test_cascade_is_exact():
    listed = [f"k{i}" for i in range(300)]
    others = [f"u{i}" for i in range(20000)]
    first = Bloom(listed, 0.2, 0)
    wrong = [k for k in others if k in first]
    cascade = Cascade(first, listed, wrong)
    assert len(wrong) > 100 and len(cascade.levels) > 2
    assert all(k in cascade for k in listed) and not any(k in cascade for k in others)


def test_bad_rules(spark, monkeypatch):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    with pytest.raises(ValueError):
        build(df, [("block", "com/"), ("allow", "COM/")])
    monkeypatch.setattr(url_filter, "MAX_RULES", 0)
    with pytest.raises(ValueError):
        build(df, [("block", "com/")])
    assert keys_of("a.com", "/en/x", [0, 1, 9]) == ["a.com /", "a.com ", "com /", "com "]


def test_equally_long_rules(spark):
    """Of equally long rules that fit, the one with the longer host counts."""
    rules = [("block", "a.com/"), ("allow", "com/xy"), ("allow", "b.org/"), ("block", "org/zz")]
    urls = ["http://a.com/xy", "http://b.org/zz", "http://c.com/xyz", "http://a.com/xy"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r["rule"], r["verdict"]) for r in sorted(judge(df, build(df, rules)).collect())]
    assert got == [plain(u, rules)[2:] for u in urls] == [("a.com/", "block"), ("b.org/", "allow"), ("com/xy", "allow"), ("a.com/", "block")]

import random
import re

import pyarrow as pa

from pagewright.llm import components as components_module
from pagewright.llm import minhash_dedup
from pagewright.llm.components import components
from pagewright.llm.minhash_dedup import keep_first, near_duplicates


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(rows, width):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", lower(t))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = root(i)
        least[r] = min(least.get(r, 1 << 62), k if k is not None else 1 << 62)
    return sorted((k, len(s), least[root(i)] if least[root(i)] < 1 << 62 else None) for i, ((k, _), s) in enumerate(zip(rows, sets)))


def make_rows(seed):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(200)]
    rows, k = [], 0
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([3, 8, 30, 60, 150, 400]))]
        for _ in range(r.choice([1, 2, 6, 12])):
            w = list(base)
            for _ in range(int(len(w) * r.choice([0, 0.02, 0.05, 0.08, 0.2]))):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((k, " ".join(w)))
            k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, "  \n"), (k + 3, "One"), (k + 4, "one"), (k + 5, "one two")]
    r.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for seed, width in ((1, 2), (2, 5)):
        rows = make_rows(seed)
        df = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, size int")
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(df, width).collect())
        assert got == brute(rows, width)


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "x y z"), (7, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in near_duplicates(df, 2).collect()), key=str)
    assert got == sorted([(1, 5, 1), (1, 5, 1), (None, 5, 1), (None, 2, None), (7, 0, 7)], key=str)


def test_keep_first_and_empty(spark):
    df = spark.createDataFrame([(5, "a b c d e f", "x"), (3, "a b c d e f", "y"), (9, "q r s t u v w", None)], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in keep_first(df).collect()) == [(3, "a b c d e f", "y"), (9, "q r s t u v w", None)]
    assert near_duplicates(df.limit(0), 2).collect() == []


def test_components_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150)]
    df = spark.createDataFrame(edges, "u long, v long").selectExpr("struct(u as a, 0L as b) as u", "struct(v as a, 0L as b) as v")
    got = {r["node"]["a"]: r["label"]["a"] for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 150: 100, 200: 100}


def test_long_lists_in_blocks(spark, monkeypatch):
    """Without stars and pairs, blocks alone find every link."""
    monkeypatch.setattr(minhash_dedup, "SHORT", 1)
    monkeypatch.setattr(minhash_dedup, "STARS", 0)
    monkeypatch.setattr(minhash_dedup, "BLOCK_SHINGLES", 500)
    r = random.Random(8)
    vocab = [f"v{i}" for i in range(150)]
    base = [r.choice(vocab) for _ in range(90)]
    rows = []
    for k in range(45):
        w = list(base)
        for _ in range(r.randrange(0, 14)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in near_duplicates(df, 2).collect())
    assert got == brute(rows, 2)


def test_keep_first_keeps_one_row_of_a_group(spark):
    """Repeated rows, a shared id, null ids with and without an id in the group, and rows without words."""
    near = " ".join(f"w{i}" for i in range(60))
    also = near + " x"
    alone = " ".join(f"q{i}" for i in range(40))
    other = " ".join(f"z{i}" for i in range(40))
    rows = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (2, near, "s"), (2, also, "s"), (None, near, "s"), (None, alone, "s"), (None, alone, "s"), (7, other, "s"), (7, other, "t"), (8, "", "s"), (9, None, "s"), (None, "", "s"), (None, " ", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = [tuple(r) for r in keep_first(df).collect()]
    assert sorted(str(r[:2]) for r in got if (r[1] or "").strip() and r[0] != 2) == sorted([str((1, "a b c d e f")), str((None, alone)), str((7, other))])
    assert [r[0] for r in got if r[1] in (near, also)] == [2]
    assert sorted((r for r in got if not (r[1] or "").strip()), key=str) == sorted(rows[-4:], key=str)


def thue_morse(n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_that_differ_in_the_order_of_their_bytes(spark):
    """Words whose bytes cancel out in a polynomial hash modulo 2**64 are not the same word."""
    x, y = thue_morse(10)
    rows = [(1, x), (2, y), (3, f"{x} {y} {x}"), (4, f"{y} {x} {y}"), (5, x)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_duplicates(df, 2).collect()) == [(1, 1, 1), (2, 1, 2), (3, 2, 3), (4, 2, 3), (5, 1, 1)]


def test_very_long_texts(spark):
    r = random.Random(5)
    words = [f"t{r.randrange(3000)}" for _ in range(60_000)]
    near, far = list(words), list(words)
    for _ in range(2_000):
        near[r.randrange(len(near))] = "n"
    for _ in range(12_000):
        far[r.randrange(len(far))] = f"f{r.randrange(3000)}"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, "q" * 3_000_000), (5, "q" * 3_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in near_duplicates(df, 2).collect()) == brute(rows, 2)


def near_copies(n, words, most, seed):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(150)]
    base = [r.choice(vocab) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(0, most)):
            w[r.randrange(len(w))] = r.choice(vocab)
        out.append(" ".join(w))
    return out


def test_stars_make_no_more_pairs_than_nodes(spark):
    """A group whose members share many lists grows by a pair for each member in a round, not by one for each two members."""
    r = random.Random(3)
    members = [(key, node) for key in range(60) for node in range(50) if r.random() < 0.6]
    lists = spark.createDataFrame(members, "key long, node long").selectExpr("key", "node", "node as label", "min(node) over (partition by key) as lo")
    for turn in range(2):
        pairs = {(x["u"], x["v"]) for x in minhash_dedup._star(lists, turn).distinct().collect()}
        assert all(u < v for u, v in pairs)
        assert 25 <= len(pairs) <= 50


def test_long_lists_link_groups_and_not_members():
    """Of n alike members n - 1 links come out, which join them all, in one block and across two."""
    texts = near_copies(40, 90, 3, 4)
    for blocks in ([0] * 40, [k % 2 for k in range(40)]):
        table = pa.table({"b1": [0] * 40, "b2": [max(blocks)] * 40, "block": blocks, "node": range(40), "label": [k // 2 for k in range(40)], "_text": texts})
        out = minhash_dedup._compare(2)(table)
        links = list(zip(out.column("u").to_pylist(), out.column("v").to_pylist()))
        assert len(links) == 19
        label = [k // 2 for k in range(40)]
        for u, v in links:
            label = [label[u] if x == label[v] else x for x in label]
        assert len(set(label)) == 1


def test_large_groups_of_near_copies_against_brute_force(spark, monkeypatch):
    """Groups larger than a list that emits pairs, with copies around the least similarity."""
    monkeypatch.setattr(minhash_dedup, "SHORT", 8)
    monkeypatch.setattr(minhash_dedup, "BLOCK_SHINGLES", 2_000)
    texts = near_copies(70, 90, 16, 6) + near_copies(50, 30, 5, 7)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in near_duplicates(df, 2).collect())
    assert got == brute(rows, 2)
    assert len({c for _, _, c in got}) > 2


def test_few_links_are_joined_without_shuffles(spark, monkeypatch):
    """Up to a fixed number, links take no shuffle at all, and rounds give the same groups."""
    r = random.Random(11)
    edges = [(r.randrange(-400, 400), r.randrange(-400, 400)) for _ in range(330)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, 5000)]
    edges += [(1 << 62, -(1 << 62)), (2000, 2099)] + [(2099, 2001 + k) for k in range(40)] + edges[:20]
    df = spark.createDataFrame(edges, "u long, v long")
    parent = {x: x for u, v in edges if u != v for x in (u, v)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    want = {x: root(x) for x in parent}

    def found(name):
        spark.sparkContext.setJobGroup(name, name)
        got = components(df).collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(got) == len(want) and dict(map(tuple, got)) == want
        return jobs

    assert found("few links") <= 5
    monkeypatch.setattr(components_module, "FEW", 5)
    assert found("many links") > 5
    assert components(df.limit(0)).collect() == components(df.where("u = 5000")).collect() == []
    monkeypatch.undo()
    assert components(df.limit(0)).collect() == components(df.where("u = 5000")).collect() == []


def test_members_of_a_long_list_by_holders_and_by_marks(monkeypatch):
    """Counting only the holders of a member's shingles links the same members as going through all shingles."""
    r = random.Random(9)
    texts = [f"a common line of words {' '.join(r.choice('pqrstuvwxyz') + str(r.randrange(40)) for _ in range(40))}" for _ in range(60)] + near_copies(20, 50, 4, 1) + near_copies(20, 60, 12, 2)
    n = len(texts)
    blocks = [k % 2 for k in range(n)]
    table = pa.table({"b1": [0] * n, "b2": [1] * n, "block": blocks, "node": range(n), "label": range(n), "_text": texts})
    out = []
    for dense in (0, 4, 1 << 40):
        monkeypatch.setattr(minhash_dedup, "DENSE", dense)
        out.append(minhash_dedup._compare(2)(table).to_pylist())
    assert out[0] == out[1] == out[2] and len(out[0]) >= 19

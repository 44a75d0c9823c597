import numpy as np

from pagewright.llm import ann
from pagewright.llm.ann import build_index, search
from pagewright.llm.queries import op1_ann


def exact(rows, queries, k):
    out = {}
    for q, x in queries:
        x = np.array(x, float)
        near = sorted((float(np.sqrt(np.square(np.array(y, float) - x).sum())), v) for v, y in rows if v != q and len(y) == len(x))
        out[q] = near[:k]
    return out


def test_recall_on_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = exact(rows, [r for r in rows if r[0] % 100 == 0], 10)
    got = {}
    for r in op1_ann(spark, sf).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    assert got.keys() == want.keys()
    hits = [len({v for _, v in got[q].values()} & {v for _, v in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.95
    for q, ranks in got.items():
        assert sorted(ranks) == list(range(1, 11)) and [ranks[i] for i in range(1, 11)] == sorted(ranks.values())
    table = dict(rows)
    q, (score, v) = 100, got[100][1]
    assert np.isclose(score, np.linalg.norm(np.array(table[q]) - np.array(table[v])), rtol=0, atol=1e-12)


def test_several_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "STEP", 7)
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=16).astype(float).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for x in search(build_index(df, shard_rows=200), df.where("vec_id % 30 = 0"), 5).collect():
        got.setdefault(x["query_id"], set()).add(x["vec_id"])
    want = exact(rows, rows[::30], 5)
    assert np.mean([len(got[q] & {v for _, v in want[q]}) / 5 for q in want]) >= 0.95


def test_defined_cases(spark):
    same, nan = [1.0, 2.0], float("nan")
    rows = [(i, same) for i in range(300)] + [(400, [1.0, 2.5]), (401, None), (402, [0.0, 0.0]), (403, [1.0, None]), (404, [nan, 1.0]), (405, [float("inf"), 1.0]), (406, [1.0, 2.0, 3.0]), (None, same), (500, [])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<double>, score int")
    index = build_index(df, shard_rows=64)
    got = {}
    for x in search(index, df, 10).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    assert set(got) == set(range(300)) | {400}
    assert sorted(got[3]) == [(i + 1, v, 0.0) for i, v in enumerate([0, 1, 2, 4, 5, 6, 7, 8, 9, 10])]
    assert [v for _, v, _ in sorted(got[400])] == list(range(10))
    assert search(build_index(df.limit(0)), df.limit(0)).collect() == []


def found(index, queries, k=10):
    out = {}
    for x in search(index, queries, k).collect():
        out.setdefault(x["query_id"], []).append((x["rank"], x["score"], x["vec_id"]))
    return {q: [(d, v) for _, d, v in sorted(x)] for q, x in out.items()}


def test_shifted_and_large_vectors(spark):
    """Offsets that dwarf the distances, huge and tiny components, far clusters: the nearest are found, with exact distances."""
    r = np.random.default_rng(4)
    base = r.normal(size=(700, 12))
    far = np.where(np.arange(700) % 3 == 0, 1e9, -1e6)[:, None]
    for points in (base + 1e4, base + 1e6, base * 1e20, base * 1e200, base * 1e-200, base + far):
        rows = [(i, x.tolist()) for i, x in enumerate(points)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = found(build_index(df, shard_rows=300), df.where("vec_id % 35 = 0"))
        hits = []
        for q in range(0, 700, 35):
            away = points - points[q]
            scale = np.abs(away).max()
            d = np.sqrt(np.square(away / scale).sum(axis=1)) * scale
            want = [v for v in np.lexsort((np.arange(700), d)).tolist() if v != q][:10]
            hits.append(len({v for _, v in got[q]} & set(want)) / 10)
            assert all(np.isclose(s, d[v], rtol=1e-12) for s, v in got[q])
        assert np.mean(hits) >= 0.95


def test_repeated_rows(spark):
    """A query row that is repeated is one query; candidates that share an id are one candidate each."""
    r = np.random.default_rng(6)
    rows = [(i, x.tolist()) for i, x in enumerate(r.normal(size=(60, 4)))]
    df = spark.createDataFrame(rows + rows[:1] * 2 + [(0, rows[30][1])], "vec_id long, embedding array<double>")
    index = build_index(df)
    want = exact(rows, rows[:1], 10)[0]
    got = {}
    for x in search(index, df.where("vec_id = 0"), 10).collect():
        got.setdefault(x["rank"], []).append((x["score"], x["vec_id"]))
    assert all(len(v) == 2 for v in got.values()) and len(got) == 10
    assert all(any(v == b and np.isclose(d, a) for d, v in got[i + 1]) for i, (a, b) in enumerate(want))
    assert found(index, df.where("vec_id = 0").limit(1))[0] and [v for _, v in found(index, df.where("vec_id = 30"))[30]].count(0) == 1


def test_edges_back_prune_a_node_seldom(monkeypatch):
    """Pruned rows stay in proportion to the nodes and do not come near one for each edge back."""
    points = np.random.default_rng(8).normal(size=(3000, 12))
    pruned, plain = [], ann.Graph.prune
    monkeypatch.setattr(ann.Graph, "prune", lambda self, nodes, *a: pruned.append(len(nodes)) or plain(self, nodes, *a))
    graph = ann.build_graph(points)
    assert sum(pruned) < 6 * len(points)
    edges = graph.edges
    assert edges.shape == (3000, ann.DEGREE) and all(len(e := r[r >= 0]) == len(set(e.tolist())) for r in edges) and not (edges == np.arange(3000)[:, None]).any()
    found, _ = graph.search(points[::30], ann.BEAM)
    near = np.argsort(((points[::30, None] - points) ** 2).sum(axis=2), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b[:10])) / 10 for a, b in zip(near.tolist(), found.tolist())]) > 0.95

"""Approximate nearest neighbours with robust-pruned directed graphs, one for each shard.

Vectors are dealt to shards by a hash of their id: ``SHARD_ROWS`` to a shard, fewer where that leaves cores without one. In a shard
equal vectors are one node. The graph grows in batches: a greedy beam search over what is there proposes neighbours of each new
node; pruning keeps the nearest and drops what a kept one is nearer to by the factor ``ALPHA``, so that edges stay diverse; edges
back are added, and pruned in the same way once a node has ``SPARE`` too many, so that a node is not pruned again for each of them. All searches of a batch run side by side in numpy. The index is one row a shard
(vectors, edges, ids) in a table in the shared folder, so a lost executor costs no rebuilding.

Every query goes to every shard. The index is shuffled once, whatever the number of queries: a task sorts what it gets by shard,
loads a shard's graph from its row and streams the shard's queries past it; a beam search of width ``BEAM`` gives the shard's
nearest, and the best over all shards stay.

Distances are sums of squared differences in double precision, divided by a power of two first where squares could overflow or
vanish; only the choice of candidates is approximate. Results have the distances of the original vectors.

Defined cases: vectors that are null or zero or hold a null, NaN or infinite component take no part, neither as queries nor as
candidates; vectors of different lengths never meet; a null id takes no part; rows that repeat an id are separate candidates, but
a query never finds rows of its own id; a repeated query row is one query, query rows that share an id but not the vector are ranked
apart; ties go to the smaller id; fewer candidates than asked for are all returned if the search reaches them; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm._shared import named, write_table

SHARD_ROWS = 1 << 14
LEAST_ROWS = 1 << 11
DEGREE = 32
#: Places that a node has for edges back, beside ``DEGREE``, before its edges are pruned again.
SPARE = 16
BEAM_BUILD = 64
BEAM = 128
ALPHA = 1.2
STEP = 256
#: Numbers that a step of a search holds at a time.
CELLS = 1 << 22


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _scale(x: np.ndarray) -> float:
    """A power of two that brings the largest component near one, or one where squares are safe."""
    most = float(np.abs(x).max(initial=0))
    return 2.0 ** np.floor(np.log2(most)) if most and not 1e-100 < most < 1e100 else 1.0


class Graph:
    def __init__(self, points: np.ndarray, edges: np.ndarray, entry: int):
        self.points, self.edges, self.entry = points, edges, entry
        self.step = max(8, min(STEP, CELLS // max(1, points.shape[1] * (edges.shape[1] + BEAM))))

    def _squares(self, queries: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its own row of nodes."""
        away = self.points[at]
        away -= queries[:, None, :]
        return np.einsum("ijk,ijk->ij", away, away)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes found for each query, nearest first, and their squared distances; -1 where there are fewer."""
        rows, n = len(queries), len(self.points)
        ids = np.full((rows, beam), -1)
        far = np.full((rows, beam), np.inf, self.points.dtype)
        done = np.ones((rows, beam), bool)
        seen = np.zeros((rows, n), bool)
        start = np.full((rows, 1), self.entry)
        ids[:, :1], far[:, :1], done[:, :1] = start, self._squares(queries, start), False
        seen[:, self.entry] = True
        active = np.arange(rows)
        while len(active):
            spot = np.argmin(done[active], axis=1)
            open_ = ~done[active, spot]
            active, spot = active[open_], spot[open_]
            if not len(active):
                break
            done[active, spot] = True
            near = self.edges[ids[active, spot]]
            safe = np.maximum(near, 0)
            fresh = (near >= 0) & ~seen[active[:, None], safe]
            seen[active[:, None], safe] |= near >= 0
            away = np.where(fresh, self._squares(queries[active], safe), np.inf)
            all_far = np.concatenate([far[active], away], axis=1)
            order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            pick = lambda a, b: np.take_along_axis(np.concatenate([a, b], axis=1), order, axis=1)
            far[active] = np.take_along_axis(all_far, order, axis=1)
            ids[active] = pick(ids[active], np.where(fresh, near, -1))
            done[active] = pick(done[active], ~fresh)
        return ids, far

    def prune(self, nodes: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
        """Robust pruning: out-edges of each node from its row of candidates (-1: none)."""
        safe = np.maximum(candidates, 0)
        away = self._squares(self.points[nodes], safe)
        bad = (candidates < 0) | (candidates == nodes[:, None])
        order = np.argsort(np.where(bad, np.inf, away), axis=1, kind="stable")
        safe, away, bad = (np.take_along_axis(x, order, axis=1) for x in (safe, away, bad))
        # a candidate named twice counts once
        ranked = np.argsort(safe, axis=1, kind="stable")
        sorted_ = np.take_along_axis(safe, ranked, axis=1)
        twice = np.zeros_like(bad)
        np.put_along_axis(twice, ranked[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], axis=1)
        alive = ~bad & ~twice
        p = self.points[safe]
        out = np.full((len(nodes), degree), -1)
        row = np.arange(len(nodes))
        for k in range(degree):
            spot = np.argmax(alive, axis=1)
            some = alive[row, spot]
            if not some.any():
                break
            out[some, k] = safe[row, spot][some]
            alive[row, spot] = False
            between = p - p[row, spot][:, None, :]
            alive &= ~(some[:, None] & (ALPHA * ALPHA * np.einsum("ijk,ijk->ij", between, between) <= away))
        return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM_BUILD) -> Graph:
    n = len(points)
    middle = np.median(points, axis=0)
    entry = int(np.argmin(np.einsum("ij,ij->i", points - middle, points - middle)))
    graph = Graph(points, np.full((n, degree + SPARE), -1), entry)
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at = 1
    while at < n:
        nodes = order[at : at + max(1, min(graph.step, at // 4))]
        at += len(nodes)
        found, _ = graph.search(points[nodes], beam)
        graph.edges[nodes, :degree] = graph.prune(nodes, found, degree)
        # edges back, a bounded number of new ones to a node at a time
        source, target = np.repeat(nodes, degree), graph.edges[nodes, :degree].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        place = np.arange(len(target)) - np.searchsorted(target, target)
        for k in range(0, int(place.max(initial=-1)) + 1, degree):
            some = (place >= k) & (place < k + degree)
            ends, row = np.unique(target[some], return_inverse=True)
            wide = np.full((len(ends), 2 * degree + SPARE), -1)
            wide[:, : degree + SPARE] = graph.edges[ends]
            wide[row, degree + SPARE + place[some] - k] = source[some]
            used = np.sort(wide, axis=1)[:, ::-1]
            fits = (used >= 0).sum(axis=1) <= degree + SPARE
            graph.edges[ends[fits]] = used[fits, : degree + SPARE]
            _prune_again(graph, ends[~fits], used[~fits], degree)
    over = np.flatnonzero((graph.edges >= 0).sum(axis=1) > degree)
    _prune_again(graph, over, graph.edges[over], degree)
    # edges stand first, so what is beyond ``degree`` is empty
    return Graph(points, np.ascontiguousarray(graph.edges[:, :degree]), entry)


def _prune_again(graph: Graph, nodes: np.ndarray, candidates: np.ndarray, degree: int) -> None:
    for a in range(0, len(nodes), graph.step):
        part = slice(a, a + graph.step)
        graph.edges[nodes[part]] = -1
        graph.edges[nodes[part], :degree] = graph.prune(nodes[part], candidates[part], degree)


def _build(table: pa.Table) -> pa.Table:
    ids = table.column("id").to_numpy()
    vectors = _matrix(table.column("vector"))
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order] + 0.0
    distinct, group = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel(), return_inverse=True)
    points = distinct.view(np.float64).reshape(len(distinct), -1)
    graph = build_graph(points / _scale(points))
    member = np.argsort(group, kind="stable")
    counts = np.bincount(group, minlength=len(points))
    return pa.table({
        "dim": table.column("dim")[:1], "shard": table.column("shard")[:1], "entry": pa.array([graph.entry], pa.int32()),
        "points": pa.array([points.tobytes()], pa.binary()), "edges": pa.array([graph.edges.astype("<i4").tobytes()], pa.binary()),
        "ids": pa.array([ids[member].astype("<i8").tobytes()], pa.binary()), "counts": pa.array([counts.astype("<i4").tobytes()], pa.binary()),
    })


class Shard:
    """A shard's graph, read from its row, and the ids of its nodes."""

    def __init__(self, dim: int, entry: int, points: bytes, edges: bytes, ids: bytes, counts: bytes):
        self.points = np.frombuffer(points, np.float64).reshape(-1, dim)
        self.scale = _scale(self.points)
        self.graph = Graph(self.points / self.scale, np.frombuffer(edges, "<i4").reshape(len(self.points), -1).astype(np.int64), entry)
        self.ids, self.counts = np.frombuffer(ids, "<i8"), np.frombuffer(counts, "<i4")
        self.first = np.cumsum(self.counts) - self.counts

    def nearest(self, names: np.ndarray, queries: np.ndarray, k: int, beam: int):
        """For each query the places of its row, the ids and the distances of the k nearest found."""
        for a in range(0, len(queries), self.graph.step):
            found, _ = self.graph.search(queries[a : a + self.graph.step] / self.scale, beam)
            for q, nodes in enumerate(found, a):
                nodes = nodes[nodes >= 0]
                away = self.points[nodes] - queries[q]
                scale = _scale(away)
                far = np.sqrt(np.square(away / scale).sum(axis=1)) * scale
                # of equal vectors, the k smallest ids beside the query's own are all that can be among the k nearest
                picked, score = [], []
                for node, d in zip(nodes.tolist(), far.tolist()):
                    same = self.ids[self.first[node] : self.first[node] + self.counts[node]]
                    same = same[same != names[q]][:k]
                    picked += same.tolist()
                    score += [d] * len(same)
                best = np.lexsort((picked, score))[:k]
                yield q, [picked[i] for i in best], [score[i] for i in best]


def _find(k: int, beam: int):
    """Rows come by shard, the shard's graph before its queries."""

    def run(batches):
        shard, key = None, None
        for batch in batches:
            dims, numbers, graphs = (batch.column(i).to_numpy() for i in (0, 1, 2))
            edge = np.flatnonzero(np.append(True, (dims[1:] != dims[:-1]) | (numbers[1:] != numbers[:-1]) | (graphs[1:] != graphs[:-1])))
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), batch.num_rows]):
                own = int(dims[a]), int(numbers[a])
                if graphs[a] == 0:
                    shard, key = Shard(own[0], *(batch.column(i)[a].as_py() for i in range(6, 11))), own
                elif key == own:  # queries of a length that the shard has no vectors of find nothing there
                    rows = batch.slice(a, b - a)
                    queries = _matrix(pa.chunked_array([rows.column(5)]))
                    names, place = rows.column(4).to_numpy(), rows.column(3)
                    for at in range(0, len(queries), STEP):
                        part = list(shard.nearest(names[at : at + STEP], queries[at : at + STEP], k, beam))
                        which = pa.array(np.repeat([at + q for q, _, _ in part], [len(i) for _, i, _ in part]).astype(np.int64))
                        yield pa.RecordBatch.from_arrays([place.take(which), pa.array(names).take(which), pa.array([i for _, x, _ in part for i in x], pa.int64()), pa.array([d for _, _, x in part for d in x], pa.float64())], names=["place", "query_id", "vec_id", "score"])

    return run


def _rows(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    vector = named(vector_col).cast("array<double>")
    return df.select(named(id_col).cast("long").alias("id"), vector.alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("dim", F.size("vector"))


def build_index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index: one row for each shard and vector length, in the shared folder."""
    rows, total = _rows(df, id_col, vector_col), df.count()
    # at least a shard for each core as long as it has LEAST_ROWS
    shards = max(1, -(-total // shard_rows), min(df.sparkSession.sparkContext.defaultParallelism, total // LEAST_ROWS))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    made = dealt.groupBy("dim", "shard").applyInArrow(_build, INDEX)
    return write_table(made, "graphs")


INDEX = "dim int, shard int, entry int, points binary, edges binary, ids binary, counts binary"


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = BEAM) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (Euclidean distance) of the nearest found for each query."""
    asked = _rows(queries, id_col, vector_col).dropDuplicates(["id", "vector"])
    asked = write_table(asked.withColumn("place", F.monotonically_increasing_id()), "queries")
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("points", "edges", "ids", "counts")]
    sent = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "place", "id", "vector", F.lit(None).cast("int").alias("entry"), *nothing)
    graphs = index.select("dim", "shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("place"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("vector"), "entry", "points", "edges", "ids", "counts")
    streams = graphs.union(sent).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind")
    found = streams.mapInArrow(_find(k, beam), "place long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("place").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

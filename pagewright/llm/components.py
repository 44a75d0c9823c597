"""Connected components of an edge table by alternating large-star and small-star steps.

Nodes are longs, or structs that compare field by field. Each step groups by a node with a map-side minimum and joins that back, so
no neighbourhood is ever gathered; the edge table is written to the shared folder after each round. Only counts reach the
driver, but for up to ``FEW`` links between longs (at most sixteen bytes each), where a dozen shuffles would cost more than all
else: those are joined there in memory. An empty table gives an empty result; self links and repeated links change nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm._shared import write_table

#: Links that are joined on the driver: eight megabytes, whatever the input.
FEW = 1 << 19


def _least(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of some links and the least node reachable from it."""
    nodes, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = codes[: len(u)], codes[len(u) :]
    label = np.arange(len(nodes))
    while len(open_ := np.flatnonzero(label[a] != label[b])):
        a, b = a[open_], b[open_]
        # a root goes under the least root that a link leads to, then every node under its root
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, np.maximum(label[a], label[b]), least)
        while not np.array_equal(new, again := new[new]):
            new = again
        label = new
    return nodes, nodes[label]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and ``label`` (the least node reachable) for every node of ``edges`` (columns ``u`` and ``v``)."""
    if edges.schema["u"].dataType.simpleString() == "bigint" and edges.count() <= FEW:
        few = edges.where("u <> v").select("u", "v").toArrow()
        nodes, labels = _least(few.column("u").to_numpy(), few.column("v").to_numpy())
        return edges.sparkSession.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "label": pa.array(labels, pa.int64())}))
    cur = write_table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = None
    while True:
        state = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state["n"] == 0 or (state["n"], state["s"]) == before:
            break
        before = state["n"], state["s"]
        cur = write_table(_small_star(_large_star(cur).distinct()).distinct(), name)
    members = cur.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return members.union(cur.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())

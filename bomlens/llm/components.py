"""Connected components of an edge list, by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomlens.llm.common import stored, tidied

MAX_ROUNDS = 50
#: So many links (16 MB) are solved by one task; more take the rounds.
ONE_TASK = 1_000_000


def solved(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable) of links in arrays, by hooking and pointer jumping."""
    names, ends = np.unique(np.r_[a, b], return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(names))
    while (apart := label[left] != label[right]).any():
        low, high = np.minimum(label[left], label[right])[apart], np.maximum(label[left], label[right])[apart]
        np.minimum.at(label, high, low)
        while ((above := label[label]) != label).any():
            label = above
    return names, names[label]


def _solved_in_task(batches):
    parts = [b for b in batches if b.num_rows]
    if parts:
        found = solved(*(np.concatenate([np.asarray(b.column(k)) for b in parts]) for k in range(2)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "component"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: large-star links each larger neighbour, small-star each smaller one, to the least of the neighbourhood."""
    if large:
        near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = near.join(least, "a")
    if large:
        return joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).filter("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the least node reachable. Self-links are ignored.

    Links that fit one task are solved there. Of more, every round is a few grouped minima and equi-joins and is written to the shared folder, so a lost executor costs no
    more than a round. The number of rounds grows with the logarithm of a component's size.
    """
    current = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    before = _state(current)
    if before[0] <= ONE_TASK:
        return current.repartition(1).mapInArrow(tidied(_solved_in_task), "node bigint, component bigint")
    for _ in range(MAX_ROUNDS):
        current = stored(_star(_star(current, True), False), "edges")
        after = _state(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))

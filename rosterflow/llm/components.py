"""Connected components: in one task where links are few, else by alternating large and small stars."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(moved).where("a <> b").distinct()


#: Links that one task labels at once (8 MB); rounds of joins would cost the driver more than the links are worth.
FEW = 500_000


def _at_once(edges: DataFrame) -> DataFrame:
    """(node, component) of ``edges`` in one task: labels fall to the least that a link or another label leads to, until none does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        if not parts:
            return
        ends = np.concatenate([p[0] for p in parts] + [p[1] for p in parts])
        nodes, at = np.unique(ends, return_inverse=True)
        one, other = at[: len(at) // 2], at[len(at) // 2 :]
        least, before = np.arange(len(nodes)), None
        while before is None or (least != before).any():
            before = least.copy()
            low = np.minimum(before[one], before[other])
            for place in (before[one], before[other], one, other):
                np.minimum.at(least, place, low)
            least = least[least]
        for i in range(0, len(nodes), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 65_536]), pa.array(nodes[least[i : i + 65_536]])], ["node", "component"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node bigint, component bigint")


def connected(work: Workspace, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: bigint); component is the smallest node reached.

    A list of FEW or less goes to one task. Of a longer one each round maps the
    edge list to stars by joins and partial aggregates, and the list is written
    to the shared folder after each round. Rounds grow with the logarithm of the longest
    path. Loops are ignored; an empty list gives an empty result.
    """
    current = work.settle(edges.select("a", "b").where("a <> b").distinct())
    seen = None
    while True:
        state = current.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first()
        if state[0] == 0 or state == seen:
            break
        if state[0] <= FEW:
            return _at_once(current)
        seen = state
        following = work.settle(_small_star(_large_star(current)))
        work.drop(current)
        current = following
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(roots)

"""Classes of sets that meet in buckets: stars first, then what these leave open, exactly and in cells."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cut, components, join_counted

#: Shingles of a cell that are counted at a time.
COLUMNS = 2048


def links_in_cell(sets: list[np.ndarray], part: np.ndarray, comps: list, p: int, q: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, row) links that span what is newly connected among the rows of a cell: pairs of the blocks p and q, of different components, by exact similarity of sorted sets.

    Intersections of all pairs come from a product of incidence matrices over the values that at least two of the rows hold.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    rows, values = np.repeat(np.arange(n), sizes), np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    rows, values = rows[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    rows, column = rows[shared], (np.cumsum(new & shared) - 1)[shared]
    left, right = np.flatnonzero(part == p), np.flatnonzero(part == q)
    common = np.zeros((len(left), len(right)), np.float32)
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + COLUMNS + 1, COLUMNS))
    block = np.zeros((n, COLUMNS), np.float32)
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        at = rows[lo:hi], column[lo:hi] - COLUMNS * k
        block[at] = 1
        common += block[left] @ block[right].T
        block[at] = 0
    close = lambda k: right[100 * common[k].astype(np.int64) >= percent * (sizes[left[k]] + sizes[right] - common[k].astype(np.int64))]
    return spanning(left, close, comps, p == q)


def spanning(left: np.ndarray, close: Callable[[int], np.ndarray], comps: list, once: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of left[k] with close(k): those that connect two components not yet connected; once: each pair comes from both of its rows."""
    parent: dict = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    kept = []
    for k, x in enumerate(left.tolist()):
        for y in close(k).tolist():
            if not once or x < y:
                a, b = root(comps[x]), root(comps[y])
                if a != b:
                    parent[a] = b
                    kept.append((x, y))
    found = np.array(kept, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def unsettled_links(buckets: DataFrame, payload: DataFrame, linked: Callable[[pa.Table, np.ndarray, list, int, int], tuple[np.ndarray, np.ndarray]], block: int) -> DataFrame:
    """(a, b) links between different components that meet in one bucket, from rows (key, id, component) and payload (id, ...); only such as connect something new within a cell.

    A bucket is cut into blocks of about `block` members, and a cell of two blocks is compared in one task, however large the bucket is.
    """
    sizes = Cut(buckets.sparkSession).table(buckets.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")))
    rows = join_counted(buckets, sizes, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "id", "component")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = linked(table, table.column("part").to_numpy(), table.column("component").to_pylist(), key[1].as_py(), key[2].as_py())
        ids = table.column("id")
        return pa.table({"a": ids.take(pa.array(i)), "b": ids.take(pa.array(j))})

    return cells.join(payload, "id").groupBy("key", "p", "q").applyInArrow(run, buckets.select(F.col("id").alias("a"), F.col("id").alias("b")).schema).distinct()


def classes_of_buckets(spark: SparkSession, members: DataFrame, confirm: Callable[[DataFrame], DataFrame], payload: Callable[[DataFrame], DataFrame], linked: Callable, block: int) -> DataFrame:
    """(node, component) of the ids that a chain of links connects, among rows (key, id) of buckets.

    In each bucket all meet the least member, which finds the bulk of a group with one pair per member; confirm gives the
    (a, b) that are links. Buckets that still hold several components are then compared in cells of
    blocks, across these components, by linked over payload(ids). No link between two members of a bucket is lost,
    and no group is expanded into rows for all its pairs.
    """
    cut = Cut(spark)
    hubs = members.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("key", "a")
    met = cut.table(members.join(hubs, "key").select("key", "id", "a").distinct())
    links = cut.table(confirm(cut.table(met.where("id <> a").select("a", F.col("id").alias("b")).distinct())))
    comps = cut.table(components(spark, links))
    labelled = cut.table(met.join(comps.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")))
    # all pairs of a bucket of two were stars; buckets with the same members are one
    mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who"))
    mixed = cut.table(mixed.where("lo <> hi and n > 2").groupBy("who", "n").agg(F.min("key").alias("key")).select("key"))
    rest = cut.table(join_counted(labelled, mixed, "key"))
    if rest.isEmpty():
        return comps
    more = unsettled_links(rest, payload(cut.table(rest.select("id").distinct())), linked, block)
    return cut.table(components(spark, links.unionByName(more)))

"""Near-duplicate embeddings by spherical-cap filters of structured random product codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .cells import classes_of_buckets, spanning
from .common import Cut

#: Blocks of coordinates of a product code, independent codes, and filters that a vector is listed at in each on average.
PIECES, CODES, LISTED = 4, 6, 10
#: Filters of a code for every filter that all vectors of one label are listed at together: so few unrelated vectors meet.
ROOM = 60
#: How far below a cap's edge the nearest filters of a vector in hardly any cap may lie, in units of the spread of inner products, 1 / sqrt(dimension).
SLACK = 0.12
#: Members of an unsettled bucket that are compared as one block; members of a component whose links one task counts.
BLOCK, STRIPE = 512, 2048


class ProductCode:
    """Filters of one dimension: all sums of one direction from each block of coordinates, after a random rotation."""

    def __init__(self, dim: int, directions: int, seed: int):
        draw = np.random.default_rng([seed, dim])
        self.directions = directions
        self.rotation = np.linalg.qr(draw.standard_normal((dim, dim)))[0]
        self.pieces = [x for x in np.array_split(np.arange(dim), PIECES) if len(x)]
        codes = [draw.standard_normal((directions, len(x))) for x in self.pieces]
        self.codes = [c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(len(self.pieces)) for c in codes]
        self.first = seed * directions ** len(self.pieces)
        self.least, self.slack = self.edge(draw.standard_normal((min(512, max(64, (1 << 21) // directions**2)), dim))), SLACK / np.sqrt(dim)

    def edge(self, sample: np.ndarray) -> float:
        """The inner product that LISTED filters reach on average over a sample of random directions."""
        turned = sample / np.linalg.norm(sample, axis=1, keepdims=True) @ self.rotation
        sums = [turned[:, p] @ c.T for p, c in zip(self.pieces, self.codes, strict=True)]
        half = len(sums) // 2
        left, right = np.zeros((len(sample), 1)), np.zeros((len(sample), 1))
        for s in sums[:half]:
            left = (left[:, :, None] + s[:, None, :]).reshape(len(sample), -1)
        for s in sums[half:]:
            right = (right[:, :, None] + s[:, None, :]).reshape(len(sample), -1)
        left.sort(axis=1)
        lo, hi = -1.0, 1.0
        for _ in range(30):
            mid = (lo + hi) / 2
            listed = sum(x.size * len(y) - np.searchsorted(x, mid - y).sum() for x, y in zip(left, right, strict=True)) / len(sample)
            lo, hi = (mid, hi) if listed > LISTED else (lo, mid)
        return hi

    def filters(self, unit: np.ndarray) -> list[np.ndarray]:
        """Of each unit vector: the filters whose cap it lies in, by list decoding: partial sums that the blocks still to come cannot lift over the cap's edge are left at once."""
        turned = unit @ self.rotation
        sums = [turned[:, p] @ c.T for p, c in zip(self.pieces, self.codes, strict=True)]
        tops = np.cumsum([s.max(axis=1) for s in sums[::-1]], axis=0)[::-1]
        out = []
        for i in range(len(unit)):
            least = min(self.least, tops[0][i] - self.slack)  # a vector in hardly any cap is listed at its nearest filters
            total, ids = np.zeros(1), np.zeros(1, np.int64)
            for k, s in enumerate(sums):
                total = (total[:, None] + s[i]).reshape(-1)
                rest = tops[k + 1][i] if k + 1 < len(sums) else 0.0
                keep = np.flatnonzero(total >= least - rest)
                total, ids = total[keep], ids[keep // self.directions] * self.directions + keep % self.directions
            out.append(ids + self.first)
        return out


_codes: dict[tuple[int, int], list[ProductCode]] = {}


def codes_of(dim: int, directions: int) -> list[ProductCode]:
    if (dim, directions) not in _codes:
        _codes[dim, directions] = [ProductCode(dim, directions, seed) for seed in range(CODES)]
    return _codes[dim, directions]


def listed(vectors: DataFrame, directions: int) -> DataFrame:
    """(id, dim, filters, unit) from (id, vector): the filters of each vector and the vector at length 1, as packed doubles. Vectors that are zero or hold null or non-finite components are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            rows: list[tuple[int, int, np.ndarray, bytes]] = []
            by_dim: dict[int, list[int]] = {}
            values = {}
            for i, x in enumerate(column):
                v = x.values
                if v is None or not len(v) or v.null_count:
                    continue
                v = v.to_numpy(zero_copy_only=False).astype(np.float64)
                top = np.abs(v).max()
                if np.isfinite(v).all() and top > 0:
                    v = v / top
                    values[i] = v / np.linalg.norm(v)
                    by_dim.setdefault(len(v), []).append(i)
            for dim, own in by_dim.items():
                unit = np.array([values[i] for i in own])
                lists = zip(*(c.filters(unit) for c in codes_of(dim, directions)), strict=True)
                rows += [(i, dim, np.concatenate(f), u.tobytes()) for i, f, u in zip(own, lists, unit, strict=True)]
            ids = batch.column("id").take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.binary())], names=["id", "dim", "filters", "unit"])

    schema = vectors.select("id").schema.add("dim", "long").add("filters", ArrayType(LongType())).add("unit", "binary")
    return vectors.select("id", "vector").mapInArrow(run, schema)


def units_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A matrix of packed unit vectors."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def linked_vectors(least: float):
    """Links among the vectors of a cell, which have one label and dimension."""

    def run(table: pa.Table, part: np.ndarray, comps: list, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
        unit = units_of(table.column("unit"))
        left, right = np.flatnonzero(part == p), np.flatnonzero(part == q)
        near = unit[left] @ unit[right].T >= least
        return spanning(left, lambda k: right[near[k]], comps, p == q)

    return run


def confirm(pairs: DataFrame, units: DataFrame, least: float) -> DataFrame:
    """The (a, b) whose unit vectors (id, unit) have a cosine of at least `least`."""
    both = pairs.join(units.select(F.col("id").alias("b"), F.col("unit").alias("y")), "b").join(units.select(F.col("id").alias("a"), F.col("unit").alias("x")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [float(np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64)) >= least for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, pairs.select("a", "b").schema)


class Stripe:
    """STRIPE members or so of a component, whose links with all its members are counted as these pass by."""

    def __init__(self, least: float):
        self.least, self.own, self.counts = least, [], None

    def add(self, rows: pa.RecordBatch, own: bool) -> None:
        if own:
            self.own.append(rows)
            return
        self.close()
        self.count(rows, False)

    def close(self) -> None:
        if self.counts is None:
            table = pa.Table.from_batches(self.own)
            self.ids, self.unit, self.counts = table.column("id"), units_of(table.column("unit")), np.zeros(table.num_rows, np.int64)
            for lo in range(0, table.num_rows, BLOCK):
                self.count(table.slice(lo, BLOCK), True, lo)

    def count(self, rows, own: bool, first: int = 0) -> None:
        times = rows.column("times").to_numpy()
        near = self.unit @ units_of(rows.column("unit")).T >= self.least
        if own:
            near[first + np.arange(len(times)), np.arange(len(times))] = False
        self.counts += near @ times

    def result(self) -> pa.RecordBatch:
        self.close()
        return pa.RecordBatch.from_arrays([self.ids.combine_chunks(), pa.array(self.counts)], names=["id", "n"])


def link_counts(members: DataFrame, units: DataFrame, least: float) -> DataFrame:
    """(id, n): of each member of a component the number of its links, from (component, id) and (id, times, unit).

    A component is cut into stripes; a stripe's members stay in memory while all members of the component pass by, and give one
    row each, so that neither pairs nor rows by pair of blocks come out.
    """
    sizes = Cut(members.sparkSession).table(members.groupBy("component").agg(F.ceil(F.count("*") / STRIPE).cast("int").alias("parts")))
    rows = members.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("id", F.struct("component", "other").alias("stripe"), (F.col("other") == F.col("part")).alias("own"))
    rows = rows.join(units, "id").withColumn("key", F.xxhash64("stripe"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # own members first; a stripe's number also tells those apart whose keys are equal
    rows = rows.repartition(n, "key").sortWithinPartitions("key", "stripe", F.desc("own")).select("key", F.col("stripe.component").alias("c"), F.col("stripe.other").alias("o"), "own", "id", "times", "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, stripe = None, None
        for batch in batches:
            c, o, own = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("c", "o", "own"))
            edges = [0, *(np.flatnonzero((c[1:] != c[:-1]) | (o[1:] != o[:-1]) | (own[1:] != own[:-1])) + 1).tolist(), len(c)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi > lo and (c[lo], o[lo]) != last:
                    if stripe:
                        yield stripe.result()
                    last, stripe = (c[lo], o[lo]), Stripe(least)
                for at in range(lo, hi, BLOCK):
                    stripe.add(batch.slice(at, min(BLOCK, hi - at)), bool(own[lo]))
        if stripe:
            yield stripe.result()

    return rows.mapInArrow(run, members.select("id").schema.add("n", "long"))


def links(spark: SparkSession, vectors: DataFrame, least: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id) of every row: vectors of equal label and dimension are linked at cosines of at least `least`, in double precision.

    Equal vectors of a label become one first, with the number of its rows. Each lists all filters whose caps hold it, in several
    codes; the vectors of a bucket (label, dimension, filter) meet its least member, and those of buckets that still hold several components are compared in
    cells across these, which gives components. All pairs of a component are then compared by stripes to count links, one row coming out per member.

    Null labels, and vectors that are null, zero, or hold null or non-finite components link with nothing; nor do rows with a null id; a row's id should be its own. A link
    between components whose members share no cap at all stays unseen; the README has the measured recall. An empty table gives an empty one;
    other columns are ignored. Memory goes with the dimension, not with the size of a group.
    """
    cut = Cut(spark)
    rows = vectors.select(F.col(vec_id).alias("vec"), F.col(label).alias("label"), F.col(embedding).alias("vector"))
    usable = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.col("vec").isNotNull()).where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    kinds = cut.table(usable.groupBy("label", "vector").agg(F.min("vec").alias("id"), F.count("*").alias("times")))
    most = kinds.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    directions = max(16, int(np.ceil((most * LISTED * ROOM) ** (1 / PIECES))))
    found = cut.table(kinds.select("label", "id", "times").join(listed(kinds, directions), "id"))
    units = found.select("id", "times", "unit")
    filters = found.select("label", "dim", F.explode("filters").alias("filter"), "id").select(F.struct("label", "dim", "filter").alias("key"), "id")
    comps = classes_of_buckets(spark, filters, lambda pairs: confirm(pairs, units, least), lambda ids: units, linked_vectors(least), BLOCK)
    counts = link_counts(comps.select("component", F.col("node").alias("id")), units, least)
    kinds = kinds.join(counts, "id", "left").join(comps.select(F.col("node").alias("id"), "component"), "id", "left").join(found.select("id", F.lit(1).alias("live")), "id")
    kinds = kinds.select(F.col("label").alias("__l"), F.col("vector").alias("__v"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = rows.join(kinds, (F.col("label") == F.col("__l")) & (F.col("vector") == F.col("__v")), "left")
    return out.select(F.col("vec").alias(vec_id), F.when(F.col("vec").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(F.col("vec").isNotNull(), F.coalesce("component", "vec")).alias("component_id"))

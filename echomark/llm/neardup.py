"""MinHash near-duplicates of whole texts, with odd sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .cells import classes_of_buckets, links_in_cell
from .common import Cut, Sets, bands_for, binary_column, components, join_ids, list_column, mix, overlap, shingles, sliced

#: Samples in a band, and the probability that a pair at the threshold meets in no band.
ROWS = 5
MISS = 1e-6
#: Bits of an odd sketch.
SKETCH_BITS = 512
#: Standard deviations of the estimate by which a candidate may fall short of the threshold and still be confirmed on full sets.
SLACK = 5.0
#: Members of an unsettled bucket that are compared as one block.
BLOCK = 512


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of MinHash samples, packed: sample i with value x flips the bit that (i, x) hashes to."""
    n, k = samples.shape
    at = mix(samples ^ (np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))) % np.uint64(SKETCH_BITS)
    flips = np.bincount((np.arange(n)[:, None] * SKETCH_BITS + at.astype(np.int64)).reshape(-1), minlength=n * SKETCH_BITS)
    return np.packbits((flips & 1).astype(np.uint8).reshape(n, SKETCH_BITS), axis=1)


def most_differing_bits(threshold: float, k: int) -> int:
    """The population count of the XOR up to which a pair of k samples each is kept as a candidate.

    A pair of similarity J differs in k (1 - J) samples, with a binomial spread; each differing sample puts two
    elements into one sketch only, and d such elements leave n (1 - (1 - 2 / n)^d) / 2 bits set in the XOR.
    """
    differing = k * (1 - threshold) + SLACK * np.sqrt(k * threshold * (1 - threshold))
    n = SKETCH_BITS
    bits = n * (1 - (1 - 2 / n) ** (2 * differing)) / 2
    return int(np.ceil(bits + SLACK * np.sqrt(n) / 4))


def features(docs: DataFrame, sets: Sets, width: int, doc_id: str, text: str) -> DataFrame:
    """(id, n_shingles, set_a, set_b, sketch, bands): sizes, 128 bits that equal sets share, the odd sketch and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in sliced(batches, text):
            own = shingles(data, offsets, width)
            size = np.array([len(x) for x in own], np.int64)
            samples = np.array([sets.samples(x) if len(x) else np.zeros(len(sets.a), np.uint64) for x in own], np.uint64).reshape(len(own), len(sets.a))
            a = np.array([x.sum(dtype=np.uint64) for x in own], np.uint64).view(np.int64)
            b = np.array([mix(x ^ np.uint64(0x8EBC6AF09C88C6E3)).sum(dtype=np.uint64) for x in own], np.uint64).view(np.int64)
            sketches = odd_sketches(samples)
            yield pa.RecordBatch.from_arrays([part.column(doc_id), pa.array(size), pa.array(a), pa.array(b), binary_column([x.tobytes() for x in sketches]), list_column(sets.keys(samples))], names=["id", "n_shingles", "set_a", "set_b", "sketch", "bands"])

    schema = docs.select(F.col(doc_id).alias("id")).schema.add("n_shingles", "long").add("set_a", "long").add("set_b", "long").add("sketch", "binary").add("bands", ArrayType(LongType()))
    return docs.select(doc_id, text).mapInArrow(run, schema)


def close_sketches(pairs: DataFrame, most: int) -> DataFrame:
    """Of (a, b, sketch_a, sketch_b) the (a, b) whose sketches differ in few bits enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
                near = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most
                yield batch.select(["a", "b"]).filter(pa.array(near))

    return pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, pairs.select("a", "b").schema)


def confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """The (a, b) with 100 * intersection >= percent * union of their full shingle sets, computed from whole texts."""
    ids = Cut(docs.sparkSession).table(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    own = join_ids(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "id", ids, "left_semi")
    both = pairs.join(own.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(own.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, known = [], None, None
            right = [s for _, data, offsets in sliced(iter([batch]), "text_b") for s in shingles(data, offsets, width)]
            ids, left = batch.column("a").to_pylist(), batch.column("text_a")
            for i, a in enumerate(ids):
                if a != last:
                    last, known = a, next(s for _, data, offsets in sliced(iter([pa.RecordBatch.from_arrays([left.slice(i, 1)], names=["t"])]), "t") for s in shingles(data, offsets, width))
                common = overlap(known, right[i])
                keep.append(100 * common >= percent * (len(known) + len(right[i]) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, pairs.select("a", "b").schema)


def linked_texts(width: int, percent: int):
    """Links among the texts of a cell, from whole texts."""

    def run(table: pa.Table, part: np.ndarray, comps: list, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
        rows = pa.RecordBatch.from_arrays([table.column("text").combine_chunks()], names=["text"])
        sets = [s for _, data, offsets in sliced(iter([rows]), "text") for s in shingles(data, offsets, width)]
        return links_in_cell(sets, part, comps, p, q, percent)

    return run


def classes(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): the size of each text's shingle set and the least id reachable by links.

    Texts with equal sets form a class at once. The classes' least members meet in bands of MinHash samples; in
    each bucket all meet the least member, pairs are judged by their odd sketches and confirmed on the full sets of
    whole texts; buckets that still hold several components are then compared in blocks, exactly, across these
    components. A link is lost only if its texts meet in no band (MISS at the threshold, less above it).

    Null or empty texts have no shingles and link with nothing; rows that share an id but not a text are one document, linked by any of its texts; rows with a null
    id are their own component, of equal rows each gets the same answer; texts of any length are taken whole, in
    memory in proportion to the longest; an empty table gives an empty one; extra columns, also of the results' names, are ignored.
    """
    cut = Cut(spark)
    sets = Sets(bands_for(percent / 100, MISS, ROWS), ROWS)
    most = most_differing_bits(percent / 100, len(sets.a))
    all_ = cut.table(features(docs, sets, width, doc_id, text))
    same = cut.table(all_.where("n_shingles > 0 and id is not null").groupBy("n_shingles", "set_a", "set_b").agg(F.min("id").alias("head")))
    key = ["n_shingles", "set_a", "set_b"]
    heads = cut.table(all_.join(same.select(F.col("head").alias("id"), *key), ["id", *key], "left_semi").dropDuplicates(["id", *key]))
    # an id with several texts joins their classes
    owned = all_.where("n_shingles > 0 and id is not null").groupBy("id").agg(F.min(F.struct(*key)).alias("lo"), F.max(F.struct(*key)).alias("hi")).where("lo <> hi").select("id")
    tied = cut.table(all_.join(cut.table(owned), "id", "left_semi").join(same, key).select(F.col("id").alias("b"), F.col("head").alias("a")).where("a <> b").distinct())
    sketches = heads.select("id", "sketch")

    def confirmed(stars: DataFrame) -> DataFrame:
        pairs = stars.join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b")), "b").join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a")), "a")
        return confirm(cut.table(close_sketches(pairs, most)), docs, width, percent, doc_id, text)

    def whole(ids: DataFrame) -> DataFrame:
        return join_ids(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "id", ids, "left_semi")

    comps = classes_of_buckets(spark, heads.select("id", F.explode("bands").alias("key")).distinct(), confirmed, whole, linked_texts(width, percent), BLOCK)
    if not tied.isEmpty():
        comps = cut.table(components(spark, comps.select(F.col("node").alias("b"), F.col("component").alias("a")).unionByName(tied)))
    heads = same.join(comps.select(F.col("node").alias("head"), "component"), "head", "left").select("n_shingles", "set_a", "set_b", F.coalesce("component", "head").alias("component"))
    out = all_.select("id", "n_shingles", "set_a", "set_b").join(heads, ["n_shingles", "set_a", "set_b"], "left")
    return out.select(F.col("id").alias(doc_id), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without those that have a near-duplicate with a lesser id; of rows equal in id and text one stays, those without an id all stay.

    Rows that share an id but not a text are one document with several texts, which all stay. Of rows equal in id and text but not in other
    columns, the one of the least hash of all columns stays, so that reruns agree.
    """
    cut = Cut(spark)
    gone = cut.table(classes(spark, docs, width, percent, doc_id, text).where(F.col(doc_id) != F.col("component_id")).select(doc_id).distinct())
    left = join_ids(docs, doc_id, gone, "left_anti")
    repeated = cut.table(docs.groupBy(doc_id).count().where((F.col("count") > 1) & F.col(doc_id).isNotNull()).select(doc_id))
    if repeated.isEmpty():
        return left
    first = Window.partitionBy(doc_id, text).orderBy(F.xxhash64(*docs.columns), *(c for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))))
    one = join_ids(left, doc_id, repeated, "left_semi").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return join_ids(left, doc_id, repeated, "left_anti").unionByName(one)

"""What the operators share: lineage cuts, connected components, and byte kernels over Arrow columns."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, as a Java regular expression and as bytes.
SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text that one kernel call works on, unless a single text is longer.
SLICE_BYTES = 1 << 20


# ---------------------------------------------------------------- lineage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of our own in local mode, an error on a cluster, whose machines do not see one another's folders."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Cut:
    """Tables written to the shared folder; each later plan starts at the written rows, which outlive any executor."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
        self.n = 0

    def __call__(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def table(self, df: DataFrame) -> DataFrame:
        return self(df)[0]


def components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge, component being the least node reachable.

    Alternating large-star and small-star rounds; each round is written to the shared folder, so that
    the plan stays short and a lost executor costs one round at most. No node's neighbours are ever
    gathered: the rounds only take minima by key and join them back.
    """
    cut = Cut(spark)
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e, path = cut(e)
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e, new = cut(small.where("u != v").distinct())
        remove(spark, path)
        path = new
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: Ids that a semi or anti join broadcasts at most, after counting them; more are shuffled.
BROADCAST_IDS = 1_000_000


def join_ids(rows: DataFrame, column: str, ids: DataFrame, how: str) -> DataFrame:
    """rows semi or anti joined with the single column of ids (a written table), without shuffling wide rows where the ids are few."""
    name = ids.columns[0]
    keys = ids.withColumnRenamed(name, "__ids")
    few = keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(keys) if few else keys, F.col(column) == F.col("__ids"), how)


def join_counted(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """rows joined with a written table of one row per key, which is broadcast where it has BROADCAST_IDS rows at most, after counting them."""
    few = table.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(table) if few else table, on)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def id_crc(column: str = "doc_id"):
    """crc32 of an id's decimal digits."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


# ---------------------------------------------------------------- byte kernels


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string or binary column and the n + 1 offsets of its values; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string()).cast(pa.large_binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes together; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES):
    """Of every batch: the rows of a slice, their bytes and their offsets."""
    for batch in batches:
        data, offsets = texts(batch.column(column))
        for lo, hi in slices(offsets, most):
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 places at which each text's words begin."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes up to which a word is hashed in steps of eight bytes with all others; longer ones are digested each.
STEPPED = 256
_KEPT = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes have equal hashes wherever they stand.

    Every step mixes eight bytes into what came before, so that no sum or product of bytes is left that
    texts of a regular pattern could bring to the same value.
    """
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) + np.uint64(_BASE))
    wide = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]).data, strides=(1,))
    open_ = np.flatnonzero(sizes <= STEPPED)
    at, left = starts[open_], sizes[open_]
    while len(open_):
        out[open_] = mix(out[open_] ^ ((wide[at] & _KEPT[np.minimum(left, 8)]) * np.uint64(0xD6E8FEB86659FD93)))
        more = np.flatnonzero(left > 8)
        open_, at, left = open_[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(sizes > STEPPED).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def sequence_hashes(words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of sequences of words that follow one another without gaps; equal sequences have equal hashes.

    A sum over words each mixed with its place, so that only chance makes two sequences equal.
    """
    sizes = hi - lo
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    total = np.zeros(len(place) + 1, np.uint64)
    np.cumsum(mix(words[int(lo[0]) if len(lo) else 0 :][: len(place)] ^ mix(place.astype(np.uint64) + np.uint64(_BASE))), out=total[1:])
    ends = np.cumsum(sizes)
    return mix((total[ends] - total[ends - sizes]) + sizes.astype(np.uint64) * np.uint64(_BASE)).view(np.int64)


_MULTIPLIERS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """Of each text: the sorted distinct hashes of its shingles of so many words; with fewer words, of the whole sequence; without words, none."""
    n = len(words)
    all_ = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width):
        all_ += mix(words[j : n - width + 1 + j] * _MULTIPLIERS[j]) * _MULTIPLIERS[-1 - j] if n >= width else all_
    all_ = mix(all_)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= width:
            out.append(np.unique(all_[lo : hi - width + 1]))
        elif hi > lo:
            own = np.uint64(hi - lo)
            for j, w in enumerate(words[lo:hi]):
                own = mix(np.array([own ^ w * _MULTIPLIERS[j]], np.uint64))[0]
            out.append(np.array([own], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """shingle_hashes of texts whose A-Z are lower-cased."""
    data = LOWER[data]
    starts, ends, bounds = word_bounds(data, offsets)
    with np.errstate(over="ignore"):
        return shingle_hashes(span_hashes(data, starts, ends), bounds, width)


def binary_column(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def list_column(rows: np.ndarray) -> pa.Array:
    """A list column from a matrix."""
    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * k, max(k, 1), dtype=np.int32)[: n + 1]), pa.array(np.ascontiguousarray(rows).reshape(-1)))


class Sets:
    """MinHash samples of hash sets, by band."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        self.bands, self.rows = bands, rows
        draw = np.random.default_rng(seed)
        self.a = draw.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def samples(self, own: np.ndarray) -> np.ndarray:
        """The least value of the set under each of the hash functions."""
        least = None
        for lo in range(0, len(own), 8192):
            part = ((own[lo : lo + 8192, None] * self.a + self.b) >> np.uint64(24)).min(axis=0)
            least = part if least is None else np.minimum(least, part)
        return least

    def keys(self, samples: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band of each row of samples."""
        x = samples.reshape(-1, self.bands, self.rows)
        out = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(_BASE), x.shape[:2]).copy()
        for j in range(self.rows):
            out = mix(out ^ x[:, :, j] * _MULTIPLIERS[j % 5])
        return out.view(np.int64)


def bands_for(threshold: float, miss: float, rows: int) -> int:
    """The fewest bands of so many rows that miss a pair at the threshold with at most this probability."""
    return int(np.ceil(np.log(miss) / np.log1p(-(threshold**rows))))


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int(np.count_nonzero(y[at] == x))

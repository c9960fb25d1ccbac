"""The packed index: blocks of sorted keys, pointers and postings as flat arrays, searched in Arrow batches.

A block holds the postings of a range of hashes (those with one prefix) in four arrays: K distinct keys and K + 1 pointers of 4 bytes,
N song numbers of 2 bytes and N frames of 4 bytes, so 4 K + 4 (K + 1) + 6 N bytes. The postings of key k are those from its pointer to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a hash; postings of a block; query hashes that are looked up in a block at a time; hits of an output batch.
HASH_BITS = 32
BLOCK_POSTINGS = 1 << 20
QUERY_CHUNK = 1 << 16
HITS = 1 << 18
#: The largest song number that a posting has room for.
LARGEST_SONG = (1 << 16) - 1

BLOCK = "prefix int, part int, keys binary, pointers binary, songs binary, frames binary, n_keys long, n_postings long"


def check_songs(songs: DataFrame) -> str:
    """The configuration tag of the songs (song_id, cfg_tag) to be indexed; an error if an id repeats or is too large, if the tags differ, or if there is no song."""
    one = songs.agg(
        F.count("*").alias("n"), F.count_distinct("song_id").alias("ids"), F.max("song_id").alias("largest"), F.min("song_id").alias("least"), F.min("cfg_tag").alias("tag"), F.max("cfg_tag").alias("other")
    ).first()
    if not one["n"]:
        raise ValueError("no songs to index")
    if one["ids"] < one["n"]:
        raise ValueError("song ids repeat, which would make two songs one")
    if one["largest"] > LARGEST_SONG or one["least"] < 0:
        raise ValueError(f"song id {one['largest'] if one['largest'] > LARGEST_SONG else one['least']} is not between 0 and {LARGEST_SONG}")
    if one["tag"] is None or one["tag"] != one["other"]:
        raise ValueError(f"fingerprints of several configurations: {one['tag']}, {one['other']}")
    return one["tag"]


def prefix_of(h, bits: int):
    return F.shiftright(h.cast("long"), HASH_BITS - bits).cast("int") if bits else F.lit(0)


def pack(postings: DataFrame, songs: DataFrame, block_postings: int | None = None) -> tuple[DataFrame, int]:
    """(blocks, prefix bits) of postings (h, song_id, t1) of the songs (song_id, cfg_tag), which check_songs() must pass; blocks has BLOCK and cfg_tag.

    The range of a block is a prefix of the hash, as long as the number of postings asks. A range with more than its share, such as
    one that holds a very frequent hash, is cut into parts by song, so no task sorts more than about block_postings of them.
    """
    most = block_postings or BLOCK_POSTINGS
    tag = check_songs(songs)
    bits = min(16, max(0, (postings.count() // most).bit_length()))
    rows = postings.select("h", "song_id", "t1", prefix_of(F.col("h"), bits).alias("prefix"))
    # at most 2^16 rows
    parts = rows.groupBy("prefix").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(parts), "prefix").withColumn("part", F.pmod(F.xxhash64("song_id"), F.col("parts")).cast("int"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        h, song, t1 = (table.column(c).to_numpy().astype(np.int64) for c in ("h", "song_id", "t1"))
        order = np.lexsort((t1, song, h))
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        arrays = {"keys": h[first].astype("<u4"), "pointers": np.append(first, len(h)).astype("<u4"), "songs": song[order].astype("<u2"), "frames": t1[order].astype("<u4")}
        row = {"prefix": key[0].as_py(), "part": key[1].as_py(), **{k: x.tobytes() for k, x in arrays.items()}, "n_keys": len(first), "n_postings": len(h)}
        return pa.Table.from_pylist([row], SCHEMA)

    return dealt.select("h", "song_id", "t1", "prefix", "part").groupBy("prefix", "part").applyInArrow(run, BLOCK).withColumn("cfg_tag", F.lit(tag)), bits


SCHEMA = pa.schema([("prefix", pa.int32()), ("part", pa.int32()), *((c, pa.binary()) for c in ("keys", "pointers", "songs", "frames")), ("n_keys", pa.int64()), ("n_postings", pa.int64())])


def arrays(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(row[c], kind).astype(np.int64) for c, kind in (("keys", "<u4"), ("pointers", "<u4"), ("songs", "<u2"), ("frames", "<u4")))


def unpack(blocks: DataFrame) -> DataFrame:
    """The postings (h, song_id, t1) of packed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, pointers, songs, frames = arrays(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, np.diff(pointers))), pa.array(songs.astype(np.int32)), pa.array(frames.astype(np.int32))], names=["h", "song_id", "t1"])

    return blocks.select("keys", "pointers", "songs", "frames").mapInArrow(run, "h long, song_id int, t1 int")


def lookup_packed(query_hashes: DataFrame, blocks: DataFrame, bits: int) -> DataFrame:
    """The rows of matching.lookup() from packed blocks: each hash is found by binary search and its run of postings expanded.

    Query hashes are gathered by range in chunks of about QUERY_CHUNK, each of which meets the blocks of its range; neither side is held
    by more than a chunk and a block, and what is shuffled is one row for each.
    """
    q = query_hashes.select(F.col("query_id").cast("long").alias("query_id"), F.col("h").cast("long").alias("h"), F.col("t1").cast("int").alias("tq")).withColumn("prefix", prefix_of(F.col("h"), bits))
    chunks = q.groupBy("prefix").agg(F.ceil(F.count("*") / QUERY_CHUNK).alias("chunks"))
    q = q.join(F.broadcast(chunks), "prefix").withColumn("chunk", F.pmod(F.xxhash64("query_id", "h", "tq"), F.col("chunks")))
    asked = q.groupBy("prefix", "chunk").agg(F.collect_list(F.struct("query_id", "h", "tq")).alias("asked"))
    both = asked.join(blocks.select("prefix", "keys", "pointers", "songs", "frames"), "prefix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                keys, pointers, songs, frames = arrays({c: row.column(c)[0].as_py() for c in ("keys", "pointers", "songs", "frames")})
                query, h, tq = (x.to_numpy() for x in row.column("asked").flatten().flatten())
                at = np.searchsorted(keys, h)
                hit = np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == h))
                start = pointers[at[hit]]
                size = pointers[at[hit] + 1] - start
                ends = np.cumsum(size)
                lo = 0
                while lo < len(hit):
                    hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + HITS, "right")))
                    n = size[lo:hi]
                    which = np.repeat(np.arange(lo, hi), n)
                    place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + start[which]
                    own, t1 = hit[which], frames[place]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(query[own]), pa.array(songs[place].astype(np.int32)), pa.array(t1.astype(np.int32)), pa.array((t1 - tq[own]).astype(np.int32))], names=["query_id", "song_id", "t1", "delta"]
                    )
                    lo = hi

    return both.select("asked", "keys", "pointers", "songs", "frames").mapInArrow(run, "query_id long, song_id int, t1 int, delta int")


def packed_stats(blocks: DataFrame) -> DataFrame:
    """One row: blocks, keys, postings and bytes as stored, and the bytes that the layout has by the formula, one pointer more for every block."""
    stored = sum(F.length(c).cast("long") for c in ("keys", "pointers", "songs", "frames"))
    one = blocks.agg(F.count("*").alias("n_blocks"), F.sum("n_keys").alias("n_keys"), F.sum("n_postings").alias("n_postings"), F.sum(stored).alias("bytes"))
    return one.withColumn("bytes_formula", 4 * F.col("n_keys") + 4 * (F.col("n_keys") + F.col("n_blocks")) + 6 * F.col("n_postings"))

"""Anchor and target pairs, their hashes, and the postings index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.columns import pack_hash
from ..plans.config import Config


def pair(peaks: DataFrame, fanout, dt_min: int, dt_max, df_max: int, longest: int | None = None) -> DataFrame:
    """(clip, t1, f1, f2, dt): of each peak the first `fanout` later peaks, in order of (t, f), within the time and frequency zone.

    A range self-join as an equi-join on (clip, time bucket): buckets are as long as the largest time step, so an
    anchor meets its targets in its own bucket or the next. fanout and dt_max may be columns of peaks; longest bounds dt_max then.
    """
    if isinstance(dt_max, int) and dt_max < dt_min:
        raise ValueError("dt_max must not be below dt_min")
    width = longest or dt_max
    fan, most = (F.col(x) if isinstance(x, str) else F.lit(x) for x in (fanout, dt_max))
    bucket = F.floor(F.col("t") / width)
    extra = [x for x in (fanout, dt_max) if isinstance(x, str)]
    a = peaks.select("clip", *extra, F.col("t").alias("t1"), F.col("f").alias("f1"), F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    b = peaks.select("clip", F.col("t").alias("t2"), F.col("f").alias("f2"), bucket.alias("bucket"))
    near = a.join(b, ["clip", "bucket"]).where((F.col("t2") - F.col("t1")).between(F.lit(dt_min), most) & (F.abs(F.col("f2") - F.col("f1")) <= df_max))
    first = Window.partitionBy("clip", "t1", "f1").orderBy("t2", "f2")
    out = near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= fan)
    return out.select("clip", "t1", "f1", "f2", (F.col("t2") - F.col("t1")).alias("dt"))


def hashes(peaks: DataFrame, cfg: Config, fanout: int | None = None, dt_max: int | None = None) -> DataFrame:
    """(clip, h, t1) of all pairs."""
    h = cfg.hash
    pairs = pair(peaks, fanout or h.fanout, h.dt_min, dt_max or h.dt_max, h.df_max_bins)
    return pairs.select("clip", pack_hash(F.col("f1"), F.col("f2"), F.col("dt"), h.freq_decim, h.freq_bits, h.dt_bits).alias("h"), "t1")


def build_index(hashes_: DataFrame, max_song_id: int | None = None) -> DataFrame:
    """The postings table (h, song_id, t1). Row order carries no meaning; write_index lays it out."""
    out = hashes_.select("h", F.col("clip").cast("int").alias("song_id"), F.col("t1").cast("int").alias("t1"))
    if max_song_id is not None:
        out = out.withColumn("song_id", F.when(F.col("song_id") <= max_song_id, F.col("song_id")).otherwise(F.raise_error(F.lit("song_id too large")).cast("int")))
    return out


def write_index(postings: DataFrame, table: str, buckets: int = 64) -> None:
    """Bucketed and sorted by hash, so that lookups of bucketed query hashes need no shuffle."""
    postings.write.mode("overwrite").bucketBy(buckets, "h").sortBy("h", "song_id", "t1").saveAsTable(table)


def list_index(postings: DataFrame) -> DataFrame:
    """The list layout: (h, postings array<struct<song_id, t1>>), sorted within each hash."""
    return postings.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("song_id", "t1"))).alias("postings"))


def index_of(hashes_: DataFrame, layout: str) -> DataFrame:
    if layout not in ("csr", "map"):
        raise ValueError(f"unknown index layout {layout!r}")
    postings = build_index(hashes_)
    return postings if layout == "csr" else list_index(postings)


def prune(postings: DataFrame, most: int) -> DataFrame:
    """Without the hashes that have more than `most` postings."""
    return postings.join(postings.groupBy("h").count().where(F.col("count") <= most).select("h"), "h", "left_semi")


def prune_observed(postings: DataFrame, most: int) -> tuple[DataFrame, Observation]:
    """prune(), and what it dropped: n_keys, n_postings, dropped_keys, dropped_postings, known once the rows have been read, from the same pass."""
    seen = Observation()
    gone = F.when(F.col("count") > most, F.col("count"))
    lengths = postings.groupBy("h").count().observe(seen, F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum("count"), F.lit(0)).alias("n_postings"), F.count(gone).alias("dropped_keys"), F.coalesce(F.sum(gone), F.lit(0)).alias("dropped_postings"))
    return postings.join(lengths.where(F.col("count") <= most).select("h"), "h", "left_semi"), seen


def prune_report(postings: DataFrame, most: int) -> DataFrame:
    """(stage, n_keys, n_postings, max_len, emptied): the index before and after prune(), and whether nothing is left of it."""
    lengths = postings.groupBy("h").agg(F.count("*").alias("n"))
    kept = F.when(F.col("n") <= most, F.col("n"))
    one = lengths.agg(F.count("*").alias("k0"), F.coalesce(F.sum("n"), F.lit(0)).alias("p0"), F.coalesce(F.max("n"), F.lit(0)).alias("m0"), F.count(kept).alias("k1"), F.coalesce(F.sum(kept), F.lit(0)).alias("p1"), F.coalesce(F.max(kept), F.lit(0)).alias("m1"))
    stages = [F.struct(F.lit(name).alias("stage"), F.col(f"k{i}").alias("n_keys"), F.col(f"p{i}").alias("n_postings"), F.col(f"m{i}").alias("max_len"), ((F.col(f"k{i}") == 0) & (F.col("k0") > 0)).alias("emptied")) for i, name in enumerate(("before", "after"))]
    return one.select(F.inline(F.array(*stages)))


def prune_lists(lists: DataFrame, most: int) -> DataFrame:
    return lists.where(F.size("postings") <= most)


def index_stats(postings: DataFrame) -> DataFrame:
    """One row: postings, keys, posting-list lengths, share of single postings, ratios per song, and bytes of the packed layout."""
    lengths = postings.groupBy("h").agg(F.count("*").alias("n"))
    a = lengths.agg(F.sum("n").alias("n_postings"), F.count("*").alias("n_keys"), F.avg("n").alias("mean_len"), F.max("n").alias("max_len"), F.percentile("n", 0.5).alias("median_len"), F.expr("percentile_disc(0.99) within group (order by n)").alias("p99_len"), F.avg((F.col("n") == 1).cast("double")).alias("singletons"))
    songs = postings.agg(F.count_distinct("song_id").alias("n_songs"))
    out = a.join(songs, F.lit(True))
    return out.withColumn("postings_per_song", F.col("n_postings") / F.col("n_songs")).withColumn("keys_per_song", F.col("n_keys") / F.col("n_songs")).withColumn("bytes", 4 * F.col("n_keys") + 4 * (F.col("n_keys") + 1) + 6 * F.col("n_postings"))



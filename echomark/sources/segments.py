"""An index that grows by segments: songs are enrolled, retired and enrolled again without writing the whole index anew.

Below the root, postings/segment=N has what one enrolment adds, and log/segment=N its songs. A segment counts once its log is there, which is written last; so what
a failed enrolment left is not seen, and a second writer of the same number fails. Of a song's entries the one of the latest segment holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "song_id int, action string, sha256 string, cfg_tag string"
#: Songs whose live segments are broadcast to the postings at most, after counting them.
BROADCAST_SONGS = 1_000_000


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


class SegmentedIndex:
    """The segments below a root folder, all of one configuration."""

    def __init__(self, spark: SparkSession, root: str, cfg_tag: str):
        self.spark, self.root, self.tag = spark, root.rstrip("/"), cfg_tag

    def log(self) -> DataFrame:
        """(segment, song_id, action, sha256, cfg_tag) of all committed segments."""
        if not exists(self.spark, f"{self.root}/log"):
            return self.spark.createDataFrame([], f"segment int, {LOG}")
        return self.spark.read.schema(f"{LOG}, segment int").parquet(f"{self.root}/log").select("segment", "song_id", "action", "sha256", "cfg_tag")

    def songs(self) -> DataFrame:
        """(song_id, segment, sha256) of the songs that are enrolled now."""
        last = self.log().groupBy("song_id").agg(F.max(F.struct("segment", "action", "sha256")).alias("x"))
        return last.where("x.action = 'add'").select("song_id", "x.segment", "x.sha256")

    def live(self) -> DataFrame:
        """The postings (h, song_id, t1) of the songs that are enrolled now; segments without such a song, or not committed, are not read."""
        songs = self.songs()
        paths = [f"{self.root}/postings/segment={r[0]}" for r in songs.select("segment").distinct().collect()]  # one for each enrolment since the last merge
        if not paths:
            return self.spark.createDataFrame([], "h long, song_id int, t1 int")
        rows = self.spark.read.schema("h long, song_id int, t1 int, segment int").option("basePath", f"{self.root}/postings").parquet(*paths)
        own = songs.select(F.col("song_id").alias("__song"), F.col("segment").alias("__segment"))
        few = own.limit(BROADCAST_SONGS + 1).count() <= BROADCAST_SONGS
        return rows.join(F.broadcast(own) if few else own, (F.col("song_id") == F.col("__song")) & (F.col("segment") == F.col("__segment")), "left_semi").select("h", "song_id", "t1")

    def _commit(self, log: DataFrame, postings: DataFrame | None) -> int:
        n = (self.log().agg(F.max("segment")).first()[0] or 0) + 1
        if postings is not None:
            postings.select(F.col("h").cast("long").alias("h"), F.col("song_id").cast("int").alias("song_id"), F.col("t1").cast("int").alias("t1")).write.mode("overwrite").parquet(f"{self.root}/postings/segment={n}")
        log.write.mode("error").parquet(f"{self.root}/log/segment={n}")
        return n

    def enrol(self, postings: DataFrame, songs: DataFrame) -> int:
        """Adds songs (song_id, sha256, cfg_tag) with their postings and returns the segment; a song that is there already is replaced. An id that repeats, another configuration, or postings of other songs are errors."""
        rows = songs.select(F.col("song_id").cast("int").alias("song_id"), F.lit("add").alias("action"), "sha256", "cfg_tag")
        one = rows.agg(F.count("*").alias("n"), F.count_distinct("song_id").alias("ids"), F.count(F.when(F.coalesce(F.col("cfg_tag") != self.tag, F.lit(True)), 1)).alias("others")).first()
        if not one["n"]:
            raise ValueError("no songs to enrol")
        if one["ids"] < one["n"]:
            raise ValueError("song ids repeat")
        if one["others"]:
            raise ValueError(f"{one['others']} songs have another configuration than {self.tag}")
        if not postings.select("song_id").distinct().join(rows, "song_id", "left_anti").isEmpty():
            raise ValueError("postings of songs that are not enrolled with them")
        return self._commit(rows, postings)

    def retire(self, songs: DataFrame) -> int:
        """Takes songs (song_id) out by a tombstone; ids that are not enrolled are passed over."""
        gone = songs.select(F.col("song_id").cast("int").alias("song_id")).distinct().join(self.songs(), "song_id", "left_semi")
        none = F.lit(None).cast("string")
        return self._commit(gone.select("song_id", F.lit("retire").alias("action"), none.alias("sha256"), none.alias("cfg_tag")), None)

    def stale(self, songs: DataFrame) -> DataFrame:
        """Of songs (song_id, sha256) those that are not enrolled with that checksum, which are to be enrolled."""
        return songs.join(self.songs().select("song_id", "sha256"), ["song_id", "sha256"], "left_anti")

    def compact(self) -> int:
        """Merges all segments into one and removes the old ones; a reader that began before sees the old files or fails, a later one the new. If it stops half-way, both say the same."""
        old = [r[0] for r in self.log().select("segment").distinct().collect()]  # one row for each enrolment since the last merge
        log = self.songs().select("song_id", F.lit("add").alias("action"), "sha256", F.lit(self.tag).alias("cfg_tag"))
        n = self._commit(log, self.live())
        for s in sorted(old, reverse=True):
            remove(self.spark, f"{self.root}/postings/segment={s}")
        for s in sorted(old):
            remove(self.spark, f"{self.root}/log/segment={s}")
        return n

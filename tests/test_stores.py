"""Stores that are replaced song by song, demo files, samples, and studies over whole tracks."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from echomark.functions import dsp
from echomark.operators import evaluation
from echomark.plans import studies
from echomark.plans.config import system_config
from echomark.plans.enrolment import enrol
from echomark.sources import audio, tables
from echomark.streaming import identify as streaming


def test_fingerprints_are_replaced_song_by_song(spark, tmp_path):
    cfg, root = system_config("baseline"), f"file://{tmp_path}"
    peaks = lambda rows: spark.createDataFrame(rows, "clip long, t int, f int, mag_db double")
    postings = lambda rows: spark.createDataFrame(rows, "h long, song_id long, t1 int")
    songs = lambda *ids: spark.createDataFrame([(k, f"s{k}") for k in ids], "song_id long, sha256 string")
    tables.write_fingerprints(peaks([(k, 1, k, 0.0) for k in (1, 2, 3)]), postings([(k, k, 1) for k in (1, 2, 3)]), songs(1, 2, 3), root, cfg)
    # 2 is analysed again and 3 has nothing left; a row of a song that is not given is not written
    tables.write_fingerprints(peaks([(2, 7, 7, 0.0), (2, 8, 8, 0.0), (1, 9, 9, 9.0)]), postings([(70, 2, 7)]), songs(2, 3), root, cfg)
    at = tables.cache_dir(root, cfg)
    read = lambda name, *c: sorted(map(tuple, spark.read.parquet(f"{at}/{name}").select(*c).collect()))
    assert read("peaks", "song_id", "t") == [(1, 1), (2, 7), (2, 8)] and read("postings", "song_id", "h") == [(1, 1), (2, 70)]
    assert read("meta", "song_id", "n_peaks", "n_hashes") == [(1, 1, 1), (2, 2, 1), (3, 0, 0)]


@pytest.fixture(scope="module")
def tracks(spark):
    x = {k: dsp.resample(audio.toy_track(k, 16, 8000, -20.0), 8000, 8000) for k in (1, 2, 3)}
    return spark.createDataFrame([(k, v.tolist(), 8000) for k, v in x.items()], "clip long, samples array<double>, fs int")


def test_demo_files(spark, tracks, tmp_path):
    songs = tracks.select(F.col("clip").cast("int").alias("song_id"), "samples")
    noise = spark.createDataFrame([("cafe", (0.1 * np.random.default_rng(3).standard_normal(9000)).tolist())], "noise_type string, samples array<double>")
    rows = [(k, k, 3.0, 1, 1, kind, 5 if kind != "none" else 0, snr) for k, (kind, snr) in enumerate([("none", float("inf")), ("cafe", 5.0), ("cafe", 0.0)], 1)]
    m = spark.createDataFrame(rows, "query_id long, song_id int, length_sec double, start_sample long, rep int, noise_type string, noise_start long, snr_db double")
    studies.write_demo(m, songs, noise, ["noise_type"], 8000, str(tmp_path))
    assert sorted(x for x in os.listdir(tmp_path / "wav") if x.endswith(".wav")) == ["query000001.wav", "query000002.wav"]
    got, fs, _ = audio.decode_wav((tmp_path / "wav" / "query000001.wav").read_bytes())
    assert fs == 8000 and np.abs(got - np.array(songs.where("song_id = 1").first()["samples"][:24000])).max() <= 1 / 65536
    listed = spark.read.option("header", True).csv(f"{tmp_path}/manifest").collect()
    assert {(r["query_id"], r["file"]) for r in listed} == {("1", "wav/query000001.wav"), ("2", "wav/query000002.wav")}


def test_samples_at_even_distances(spark):
    rows = spark.range(1000, 1103).withColumn("x", F.rand(1)).repartition(7)
    assert [r["id"] for r in studies.systematic_sample(rows, "id", 5).orderBy("id").collect()] == [1000, 1026, 1051, 1077, 1102]
    placed, n = studies.ranked(rows, "id", "place")
    assert n == 103 and all(r["place"] == r["id"] - 999 for r in placed.collect()) and placed.columns == ["id", "x", "place"]
    assert studies.systematic_sample(rows, "id", 1).first()["id"] == 1000 and studies.systematic_sample(rows.limit(3), "id", 9).count() == 3


def test_runs_are_written_as_a_pair(spark, tmp_path):
    rows = spark.createDataFrame([("base", 1, float("inf"), 'a "b", c'), ("base", 2, 0.5, None)], "system string, query_id long, snr_db double, note string")
    tables.write_run(rows, f"{tmp_path}/run", "20260101", f"{tmp_path}/csv")
    text = spark.read.option("header", True).option("escape", '"').schema(rows.schema).option("positiveInf", "Inf").csv(f"{tmp_path}/csv/run=20260101")
    key = lambda df: sorted(map(tuple, df.select(*rows.columns).collect()))
    assert key(text) == key(rows) == key(spark.read.parquet(f"{tmp_path}/run/run=20260101"))


def test_holdout_duplicates_are_suspect(spark, tracks):
    """Track 2 is in the index too, track 3 is not."""
    cfg = system_config("baseline")
    index = enrol(tracks.where("clip < 3"), cfg)
    held = tracks.where("clip > 1").withColumn("clip", F.col("clip") + 10)
    got = {r["song_id"]: r for r in studies.holdout_duplicates(held, index, cfg).collect()}
    assert got[12]["suspect"] and not got[13]["suspect"] and got[12]["norm_score"] > got[13]["norm_score"]


def test_density_by_snr(spark, tracks):
    cfg = system_config("baseline")
    clips = tracks.where("clip < 3").withColumn("snr_db", F.when(F.col("clip") == 1, 10.0).otherwise(0.0))
    from echomark.operators import peaks, signals

    want = {r["clip"]: r["density_per_sec"] for r in peaks.density(signals.fingerprint(clips, cfg), cfg).collect()}
    assert {r["snr_db"]: r["density"] for r in studies.density_by_snr(clips, cfg).collect()} == {10.0: pytest.approx(want[1]), 0.0: pytest.approx(want[2])}


def test_windowed_counts_of_a_stream(spark, tmp_path):
    postings = spark.createDataFrame([(1, 7, 10), (1, 8, 11), (2, 7, 20)], "h long, song_id int, t1 int")
    at = f"file://{tmp_path}/in"
    rows = [(f"2026-01-01 00:00:{s:02d}", 1, h, t) for s, h, t in ((1, 1, 0), (2, 2, 10), (3, 9, 0), (4, 1, 0))]
    spark.createDataFrame(rows, "ts string, query_id long, h long, t1 int").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(at)
    stream = spark.readStream.schema("ts timestamp, query_id long, h long, t1 int").parquet(at)
    q = streaming.counts(stream, postings).writeStream.outputMode("update").format("memory").queryName("stream_counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["song_id"], r["delta"]): r["cnt"] for r in spark.table("stream_counts").collect()}
    assert got == {(7, 10): 3, (8, 11): 2}


def test_demo_rows_are_the_first_of_their_groups(spark):
    rows = spark.createDataFrame([(k, k % 3) for k in range(1, 20)], "query_id long, g long")
    assert [r["query_id"] for r in evaluation.demo_rows(rows, ["g"]).collect()] == [1, 2, 3]


def test_the_synthetic_corpus_is_seeded_and_as_declared(spark):
    rows = audio.toy_corpus(spark)
    got = {r["clip"]: (r["fs"], len(r["samples"]), dsp.level_dbfs(np.array(r["samples"]))) for r in audio.decoded(rows).collect()}
    for k, (fs, _, seconds, dbfs) in enumerate(audio.TOY, 1):
        assert got[k][:2] == (fs, fs * seconds) and got[k][2] == pytest.approx(dbfs, abs=0.3)
    again = {r["clip"]: r["content"] for r in audio.toy_corpus(spark).collect()}
    assert again == {r["clip"]: r["content"] for r in rows.collect()}

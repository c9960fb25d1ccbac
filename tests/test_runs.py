"""Runs that stop and go on, spot checks, counts of the same pass, and re-verification."""

import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from echomark.functions import dsp
from echomark.operators import catalog, evaluation, landmarks
from echomark.plans import runs, studies
from echomark.plans.config import Eval, system_config
from echomark.plans.enrolment import enrol
from echomark.sources import audio


def test_a_stopped_run_goes_on(spark, tmp_path):
    root, work, calls = f"file://{tmp_path}/run", spark.range(5, 42).withColumnRenamed("id", "query_id"), []

    def compute(own):
        calls.append(own.agg(F.min("query_id"), F.max("query_id")).first())
        if len(calls) == 3:
            own = own.withColumn("query_id", F.when(F.col("query_id") < 22, F.col("query_id")).otherwise(F.raise_error(F.lit("lost")).cast("long")))
        return own.withColumn("square", F.col("query_id") * F.col("query_id"))

    with pytest.raises(ValueError, match="no committed batch"):
        runs.results(spark, root)
    with pytest.raises(Exception, match="lost"):
        runs.run_batches(work, "query_id", 10, compute, root, "tag", "r1")
    assert sorted(r["query_id"] for r in runs.results(spark, root).collect()) == list(range(5, 20))
    assert runs.run_batches(work, "query_id", 10, compute, root, "tag", "r1") == 3
    assert runs.run_batches(work, "query_id", 10, compute, root, "tag", "r1") == 0
    assert [tuple(c) for c in calls] == [(5, 9), (10, 19), (20, 29), (20, 29), (30, 39), (40, 41)]
    assert sorted(map(tuple, runs.results(spark, root).collect())) == [(k, k * k) for k in range(5, 42)]
    rows = {r["batch"]: r for r in runs.ledger(spark, root).collect()}
    assert [rows[k]["n_rows"] for k in range(5)] == [5, 10, 10, 10, 2] and all(r["elapsed_sec"] > 0 and r["cfg_tag"] == "tag" and r["revision"] == "r1" for r in rows.values())
    for size, tag, rev in ((9, "tag", "r1"), (10, "other", "r1"), (10, "tag", "r2")):
        with pytest.raises(ValueError, match="in batches of"):
            runs.run_batches(work, "query_id", size, compute, root, tag, rev)
    with pytest.raises(ValueError, match="no work"):
        runs.run_batches(work.where("false"), "query_id", 10, compute, root, "tag", "r1")
    assert runs.revision()


@pytest.fixture(scope="module")
def grid(spark):
    x = {k: dsp.resample(audio.toy_track(k, 14, 8000, -20.0), 8000, 8000) for k in (1, 2)}
    songs = spark.createDataFrame([(k, "opm", "db", "dev", len(v), v.tolist()) for k, v in x.items()], "song_id int, repertoire string, role string, split string, n_samples long, samples array<double>")
    hiss = np.random.default_rng(7).standard_normal(40000) * 0.1
    bank = spark.createDataFrame([("cafe", len(hiss), hiss.tolist())], "noise_type string, n_samples long, samples array<double>")
    cfg = replace(Eval(), lengths_sec=(5,), snr_db=(float("inf"), 10, 0), noise_types=("cafe",), reps_per_song=1)
    return songs, bank, evaluation.manifest(spark, songs.drop("samples"), cfg, 42, 8000, bank)


def test_experiments_run_their_kernel_once(spark, grid):
    songs, bank, m = grid
    cfg = system_config("baseline")
    index = enrol(songs.select(F.col("song_id").cast("long").alias("clip"), "samples", F.lit(8000).alias("fs")), cfg)
    out = studies.run_experiment(m, songs.select("song_id", "samples"), bank, index, cfg)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan  # the peaks of index and queries have been written once and are read
    rows = out.collect()
    assert len(rows) == 6 and all(r["correct"] for r in rows)


def test_spot_checks(spark, grid):
    songs, bank, m = grid
    got = studies.spot_check(m, songs.select("song_id", "samples"), bank, 8000).collect()
    assert sorted(r["snr_db"] for r in got) == [0.0, 10.0, float("inf")] and all(r["right_length"] and r["in_range"] and r["snr_kept"] and r["regenerates"] and r["n_samples"] == 40000 for r in got)
    # silent noise cannot be mixed at an SNR
    silent = bank.withColumn("samples", F.transform("samples", lambda _: F.lit(0.0)))
    bad = {r["snr_db"]: r["snr_kept"] for r in studies.spot_check(m, songs.select("song_id", "samples"), silent, 8000).collect()}
    assert bad[float("inf")] and not bad[10.0]
    with pytest.raises(Exception, match="leaves the song"):
        studies.spot_check(m, songs.select("song_id", F.slice("samples", 1, 100).alias("samples")), bank, 8000).collect()


def test_counts_come_from_the_same_pass(spark):
    paths = spark.createDataFrame([("/a/opm/x.wav",), ("/a/opm/.x.wav",), ("/a/american/x.txt",), ("/a/b/x.wav",), ("/a/american/holdout/y.AU",)], "path string")
    rows, seen = catalog.classify_observed(paths)
    assert sorted(r["role"] for r in rows.collect()) == ["db", "holdout"]
    assert seen.get == {"n_files": 5, "n_hidden": 1, "n_no_audio": 1, "n_no_repertoire": 1}
    postings = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 1), (2, 1, 1)], "h long, song_id int, t1 int")
    rows, seen = landmarks.prune_observed(postings, 2)
    assert [r["h"] for r in rows.collect()] == [2] and seen.get == {"n_keys": 2, "n_postings": 4, "dropped_keys": 1, "dropped_postings": 3}


def test_noise_bank_is_whole_or_an_error(spark, tmp_path):
    wav = audio.encode_wav(np.sin(np.arange(16000) / 9) / 2, 16000)
    files = [(f"/n/{code}_16k/ch01.wav", wav) for code, _ in audio.NOISE_CODES] + [("/n/PCAFETER_16k/ch02.wav", wav), ("/n/STRAFFIC_48k/ch01.wav", wav)]
    table = lambda rows: spark.createDataFrame(rows, "path string, content binary")
    at = f"file://{tmp_path}/bank"
    audio.write_noise_bank(table(files), at)
    got = {r["noise_type"]: r for r in spark.read.parquet(at).collect()}
    assert set(got) == {"cafe", "traffic", "crowd"} and got["traffic"]["file"] == "/n/STRAFFIC_16k/ch01.wav" and got["cafe"]["duration_sec"] == 1.0
    with pytest.raises(Exception, match="channel 01 of SPSQUARE is not there"):
        audio.write_noise_bank(table([f for f in files if "SPSQUARE" not in f[0]]), at)
    with pytest.raises(Exception, match="is not unique"):
        audio.write_noise_bank(table([*files, ("/m/SPSQUARE_16k/ch01.wav", wav)]), at)


def test_a_changed_file_with_an_old_date_is_found(spark, tmp_path):
    lib = tmp_path / "opm"
    lib.mkdir()
    for k in range(3):
        (lib / f"{k}.wav").write_bytes(audio.encode_wav(np.full(100, k / 10), 8000))
    rows, seen = audio.scan(spark, f"file://{tmp_path}")
    digests = {r["path"].rpartition("/")[2]: r["sha256"] for r in rows.select("path", "sha256").collect()}
    assert seen.get["n_files"] == 3
    done = spark.createDataFrame([(str(lib / f"{k}.wav"), digests[f"{k}.wav"]) for k in range(2)], "path string, sha256 string")
    old = os.stat(lib / "1.wav")
    (lib / "1.wav").write_bytes(audio.encode_wav(np.full(100, 0.9), 8000))
    os.utime(lib / "1.wav", (old.st_atime, old.st_mtime))
    got = {os.path.basename(r["path"]): r["was"] for r in audio.changed(spark, str(tmp_path), done).collect()}
    assert got == {"1.wav": digests["1.wav"], "2.wav": None}


def test_the_index_table_is_read_by_hash(spark):
    """Lookups of bucketed query hashes against the written index shuffle neither side."""
    from echomark.operators import matching

    postings = spark.createDataFrame([(h, s, h + s) for h in range(50) for s in range(4)], "h long, song_id int, t1 int")
    asked = spark.createDataFrame([(q, h, 1) for q in range(3) for h in range(q, 80, 7)], "query_id long, h long, t1 int")
    landmarks.write_index(postings, "idx_postings", 4)
    asked.write.mode("overwrite").bucketBy(4, "h").sortBy("h").saveAsTable("idx_asked")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = matching.lookup(spark.table("idx_asked"), spark.table("idx_postings"))
        assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, matching.lookup(asked, postings).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table idx_postings")
        spark.sql("drop table idx_asked")


def test_every_broken_invariant_is_counted(spark):
    from echomark.operators.evaluation import manifest, manifest_invariants

    songs = spark.createDataFrame([(k, "opm", "holdout" if k > 3 else "db", "dev", 300_000) for k in range(1, 6)], "song_id int, repertoire string, role string, split string, n_samples long")
    noise = spark.createDataFrame([("cafe", 400_000), ("traffic", 400_000), ("crowd", 400_000)], "noise_type string, n_samples long")
    rows = manifest(spark, songs, replace(Eval(), lengths_sec=(3, 5), reps_per_song=2), 42, 8000, noise)
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    found = lambda r, again=rows, **more: {x["check"]: x["violations"] for x in manifest_invariants(r, songs, noise, again, 8000, **more).collect() if x["violations"]}
    assert found(rows) == {}
    change = lambda where, **to: rows.select(*(F.when(F.expr(where), to[c]).otherwise(F.col(c)).cast(rows.schema[c].dataType).alias(c) if c in to else F.col(c) for c in rows.columns))
    one = "song_id = 1 and length_sec = 3 and rep = 1"
    got = found(change(f"{one} and noise_type = 'cafe'", start_sample=F.lit(7)))
    assert got == {"excerpt_shared": 1, "regenerated": 8}
    assert found(change(f"{one} and noise_type = 'cafe' and snr_db = 0", noise_start=F.lit(9))) == {"noise_shared": 1, "regenerated": 1}
    got = found(change("song_id = 2 and rep = 2", split=F.lit("test")))
    assert got["split_by_song"] == 1
    assert found(change("query_id = 5", query_id=F.lit(6))) == {"unique_id": 1, "regenerated": 1}
    assert found(change(f"{one} and noise_type = 'none'", noise_start=F.lit(4))) == {"clean_without_noise": 1, "regenerated": 1}
    assert found(rows.where("song_id <> 5"))["holdout_queried"] == 1
    assert found(change("song_id = 3 and length_sec = 5 and rep = 1", start_sample=F.lit(299_999)))["excerpt_inside"] == 25
    assert found(change("noise_type = 'crowd' and song_id = 1", noise_type=F.lit("rain")))["noise_known"] == 32
    assert found(change("noise_type = 'crowd'", noise_start=F.lit(3)))["noise_span"] == 1
    checked = spark.createDataFrame([(True, True, False, True), (True, True, True, False), (True, True, True, True)], "right_length boolean, in_range boolean, snr_kept boolean, regenerates boolean")
    absent = spark.createDataFrame([("crowd",), ("rain",)], "noise_type string")
    assert found(rows, checked=checked, absent=absent) == {"synthesis": 1, "regeneration": 1, "noise_files": 1}

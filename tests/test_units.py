from dataclasses import replace
from math import inf

import numpy as np
import pytest
from pyspark.sql import functions as F

from echomark.functions import columns as C
from echomark.functions import dsp
from echomark.operators import catalog, evaluation, landmarks, matching, peaks, signals, tuning
from echomark.plans import bindings as B
from echomark.plans.config import Match, baseline_config, check_compatible, config_diff, config_tag, enhanced_config, extraction_fields, fnv1a32, resolve_query, system_config
from echomark.sources import audio, tables


def test_tag_follows_extraction_only():
    base = baseline_config()
    assert config_tag(base) == base.tag
    changed = [replace(base, peaks=replace(base.peaks, nbhd_f=15)), replace(base, hash=replace(base.hash, fanout=9)), replace(base, pre=replace(base.pre, preemph_alpha=0.9)), replace(base, stft=replace(base.stft, hop=128))]
    kept = [replace(base, match=replace(base.match, tau=0.5)), replace(base, hash=replace(base.hash, query_fanout=3)), replace(base, denoise=replace(base.denoise, enable=True)), replace(base, seed=7)]
    assert len({c.tag for c in [base, *changed]}) == 5
    assert {c.tag for c in kept} == {base.tag}
    assert fnv1a32("") == "811c9dc5" and fnv1a32("hello") == "4f9f2cab"
    assert config_diff(extraction_fields(base), extraction_fields(changed[0])) == ["peaks.nbhd_f (17 -> 15)"]


def test_query_resolution_is_strict_and_clamped():
    enh = enhanced_config()
    assert resolve_query(enh, 4.999)[:2] == (20, 64) and resolve_query(enh, 5.0)[:2] == (8, 32)
    narrow = replace(enh, hash=replace(enh.hash, dt_max=16, query_dt_max=99))
    fanout, dt_max, warnings = resolve_query(narrow, 10)
    assert (fanout, dt_max) == (8, 16) and warnings
    assert system_config("  ENH1 ").system == "enh1" and system_config("enh1").match.tau == 0.0267
    with pytest.raises(ValueError):
        system_config("none")
    with pytest.raises(ValueError):
        check_compatible(enh, replace(enh, stft=replace(enh.stft, hop=1)))


def test_hash_round_trip_and_range(spark):
    edges = [(f1, f2, dt) for f1 in (0, 1, 256, 511) for f2 in (0, 511) for dt in (0, 1, 64, 16383)]
    df = spark.createDataFrame(edges, "a int, b int, c int").withColumn("h", C.pack_hash(F.col("a"), F.col("b"), F.col("c"))).withColumn("u", C.unpack_hash(F.col("h")))
    got = df.collect()
    assert all((r["a"], r["b"], r["c"]) == tuple(r["u"]) for r in got) and len({r["h"] for r in got}) == len(edges)
    assert max(r["h"] for r in got) == (1 << 32) - 1
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([(512, 0, 0)], "a int, b int, c int").select(C.pack_hash(F.col("a"), F.col("b"), F.col("c"))).collect()
    with pytest.raises(ValueError):
        C.pack_hash(F.lit(1), F.lit(1), F.lit(1), decim=3)


def test_statistics(spark):
    df = spark.createDataFrame([(112, 10, 2), (50, 0, 0), (0, 0, 0), (20000, 5100, 5100)], "n long, b long, c long")
    m = [r["m"] for r in df.select(C.mcnemar(F.col("n"), F.col("b"), F.col("c")).alias("m")).collect()]
    assert m[0]["p"] == pytest.approx(158 / 4096, rel=1e-12)
    assert m[1]["p"] == 1 and m[2]["p"] is None and m[3]["p"] == 1
    w = spark.createDataFrame([(30, 30), (90, 90), (0, 0)], "k long, n long").select(C.wilson(F.col("k"), F.col("n")).alias("w")).collect()
    assert w[0]["w"]["lo"] == pytest.approx(0.886486606826031) and w[1]["w"]["lo"] == pytest.approx(0.959064374435673) and w[2]["w"]["p"] is None
    x = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([],)], "x array<double>").select(C.hazen(F.col("x"), 0.95).alias("h"), C.nearest_rank(F.col("x"), 0.05).alias("r")).collect()
    assert (x[0]["h"], x[0]["r"], x[1]["h"]) == (4.0, 1.0, None)


def test_stft_geometry_and_tone():
    x = np.sin(2 * np.pi * 1000 * np.arange(24000) / 8000)
    s = np.abs(dsp.stft(x, 512, 256, 512))
    assert s.shape == (257, 92) and set(s.argmax(axis=0)) == {64}
    assert dsp.stft(x[:100], 512, 256, 512).shape == (257, 0)
    with pytest.raises(ValueError):
        dsp.stft(x, 512, 256, 256)


def test_resample_and_levels():
    x = np.sin(2 * np.pi * 440 * np.arange(44100) / 44100)
    y = dsp.resample(x, 44100, 8000)
    assert len(y) == 8000 and np.abs(y[200:-200] - np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)[200:-200]).max() < 1e-2
    assert dsp.level_dbfs(dsp.rms_normalize(x, -20)[0]) == pytest.approx(-20, abs=1e-9)
    assert dsp.rms_normalize(np.zeros(5), -20)[1] == 0 and dsp.level_dbfs(np.zeros(5)) == -inf
    with pytest.raises(ValueError):
        dsp.preprocess(np.array([np.nan]), baseline_config())


@pytest.mark.parametrize("snr", [10, 0, -10])
def test_mixing(snr):
    r = np.random.default_rng(1)
    x, v = 0.01 * r.standard_normal(5000), r.standard_normal(700)
    y, measured, gain = dsp.mix_at_snr(x, v, snr)
    assert measured == pytest.approx(snr, abs=1e-9) and np.abs(y).max() <= 0.99 + 1e-12
    assert dsp.mix_at_snr(x, v, inf)[1] == inf and dsp.mix_at_snr(np.zeros(9), v, snr)[1:] == (-inf, 1.0)
    with pytest.raises(ValueError):
        dsp.mix_at_snr(x, v, float("nan"))


def test_spectral_subtraction():
    m = np.abs(np.random.default_rng(2).standard_normal((9, 40)))
    n = dsp.noise_spectrum(m, 0.1)
    out = dsp.spectral_subtract(m, n, 2.0, 0.02)
    assert (out <= m + 1e-12).all() and (out >= 0.02 * m - 1e-12).all()
    quiet = np.argsort((m * m).sum(axis=0))[:4]
    assert np.allclose(n, m[:, quiet].mean(axis=1))
    with pytest.raises(ValueError):
        dsp.spectral_subtract(m, n[:-1], 2, 0.02)


@pytest.mark.parametrize("mode", ["fixed", "adaptive"])
def test_relational_picker_equals_kernel(spark, mode):
    mag = np.abs(np.random.default_rng(3).standard_normal((65, 90)))
    cfg = B.SMALL if mode == "fixed" else B.ADAPTIVE
    cells = spark.createDataFrame([(1, t + 1, f + 1, float(mag[f, t])) for f in range(65) for t in range(90)], "clip long, t int, f int, mag double")
    t, f, level = dsp.peaks(mag, cfg)
    got = {(r["t"], r["f"]) for r in peaks.pick(cells, cfg).collect()}
    assert got == set(zip(t.tolist(), f.tolist(), strict=True))
    capped = peaks.cap_density(peaks.pick(cells, cfg), cfg)
    assert {(r["t"], r["f"]) for r in capped.collect()} == got
    with pytest.raises(ValueError):
        peaks.pick(cells, replace(cfg, peaks=replace(cfg.peaks, mode="other")))


def test_index_layouts_agree_and_prune_alike(spark):
    h = spark.createDataFrame([(5, 1, 3), (5, 1, 3), (5, 2, 9), (6, 2, 1)], "h long, clip long, t1 int")
    p, lists = landmarks.index_of(h, "csr"), landmarks.index_of(h, "map")
    q = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (2, 7, 1)], "query_id long, h long, t1 int")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(matching.lookup(q, p)) == key(matching.lookup_lists(q, lists)) and matching.lookup(q, p).count() == 6
    assert {r["h"] for r in landmarks.prune(p, 2).collect()} == {r["h"] for r in landmarks.prune_lists(lists, 2).collect()} == {6}
    with pytest.raises(ValueError):
        landmarks.index_of(h, "tree")


def test_smoothing_is_dense_and_empty_queries_stay(spark):
    p = spark.createDataFrame([(1, 1, 10), (2, 1, 12), (3, 2, 50), (3, 2, 50)], "h long, song_id int, t1 int")
    q = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (1, 3, 0)], "query_id long, h long, t1 int")
    ids = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = {r["query_id"]: r for r in matching.identify(ids, q, p, Match()).collect()}
    assert (got[1]["pred1"], got[1]["score1"], got[1]["best_delta"], got[1]["pred2"]) == (1, 2, 11, 2)  # offsets 10 and 12 meet at the empty 11
    assert (got[2]["pred1"], got[2]["score1"], got[2]["norm_score"], got[2]["accepted"]) == (0, 0, 0.0, False)


def test_tuning_refuses_other_splits(spark):
    rows = spark.createDataFrame([("test", 0.1, 2.0, True, True, 5.0)], "split string, norm_score double, margin double, is_in_db boolean, correct boolean, snr_db double")
    with pytest.raises(Exception, match="development"):
        tuning.development_rows(rows).collect()
    with pytest.raises(ValueError, match="unknown songs"):
        tuning.require_holdout(rows)
    with pytest.raises(ValueError):
        evaluation.metrics(rows, ["snr_db"])


def test_splits_keep_what_was_assigned(spark):
    rows = spark.createDataFrame([(f"p{i}", "db", "opm", "dev" if i < 3 else None) for i in range(20)], "source_path string, role string, repertoire string, split string")
    got = {r["source_path"]: r["split"] for r in catalog.assign_splits(rows, 1).collect()}
    assert [got[f"p{i}"] for i in range(3)] == ["dev"] * 3 and sum(v == "dev" for v in got.values()) == 4


def test_wav_and_ingest(spark):
    x = audio.toy_track(2, 3, 22050, -24.0)
    y, fs, channels = audio.decode_wav(audio.encode_wav(x, 22050, 2))
    assert (fs, channels, len(y)) == (22050, 2, len(x)) and np.abs(x - y).max() < 1e-4
    files = spark.createDataFrame([("a.wav", bytearray(audio.encode_wav(x, 22050))), ("b.wav", bytearray(b"junk"))], "path string, content binary")
    got = {r["path"]: r for r in audio.ingest(files).collect()}
    assert got["a.wav"]["action"] == "processed" and got["a.wav"]["duration_sec"] == pytest.approx(3.0)
    assert got["b.wav"]["action"] == "failed" and got["b.wav"]["message"]


def test_experiment_end_to_end(spark):
    from echomark.plans import studies
    from echomark.plans.config import Eval
    from echomark.plans.enrolment import enrol

    cfg = system_config("baseline")
    x = {k: dsp.resample(audio.toy_track(k, 16, 8000, -20.0), 8000, 8000) for k in (1, 2, 3)}
    clips = spark.createDataFrame([(k, v.tolist(), 8000) for k, v in x.items()], "clip long, samples array<double>, fs int")
    songs = spark.createDataFrame([(k, "opm", "holdout" if k == 3 else "db", "dev", len(v)) for k, v in x.items()], "song_id int, repertoire string, role string, split string, n_samples long")
    hiss = np.random.default_rng(7).standard_normal(40000)
    bank = spark.createDataFrame([("cafe", len(hiss), hiss.tolist())], "noise_type string, n_samples long, samples array<double>")
    m = evaluation.manifest(spark, songs, replace(Eval(), lengths_sec=(5,), snr_db=(inf, 10), noise_types=("cafe",), reps_per_song=1), 42, 8000, bank)
    index = enrol(clips.where("clip < 3"), cfg)
    got = studies.run_experiment(m, clips.withColumnRenamed("clip", "song_id"), bank, index, cfg).collect()
    assert len(got) == 6 and all(r["correct"] and r["pred1"] == r["song_id"] for r in got if r["is_in_db"]) and not any(r["correct"] for r in got if not r["is_in_db"])
    assert all(r["snr_measured"] == pytest.approx(r["snr_db"], abs=0.1) for r in got if r["snr_db"] < inf)


def test_catalog_round_trip_and_staleness(spark, tmp_path):
    names = [n for n, _, _ in catalog.SCHEMA]
    row = ("1", 'A "quoted", title', "é", "opm", "db", "dev", "", "x/y.wav", "", "1.5", "")
    tables.write_csv(spark.createDataFrame([row], names), str(tmp_path / "c"))
    got = tables.read_catalog(spark, str(tmp_path / "c")).first()
    assert (got["song_id"], got["title"], got["year"], got["duration_sec"], got["sha256"]) == (1, 'A "quoted", title', 0, 1.5, "")
    songs = spark.createDataFrame([(1, "a"), (2, ""), (3, "c")], "song_id int, sha256 string")
    meta = spark.createDataFrame([(1, "b"), (2, "z"), (3, "c")], "song_id int, sha256 string")
    assert [r["song_id"] for r in tables.stale(songs, meta).collect()] == [1]


def test_relational_signal_operators_equal_kernels(spark):
    x = np.random.default_rng(4).standard_normal(200)
    s = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "clip long, i long, x double")
    mags = signals.dft_magnitudes(spark, signals.frames(s, 16, 8), 16).orderBy("t", "f").collect()
    want = np.abs(dsp.stft(x, 16, 8, 16)).T.reshape(-1)
    assert np.allclose([r["mag"] for r in mags], want)


def test_streamed_identification(spark, tmp_path):
    from echomark.streaming import identify

    q = spark.createDataFrame([(1, 1, 0), (1, 2, 0)], "query_id long, h long, t1 int")
    q.write.parquet(str(tmp_path / "in"))
    p = spark.createDataFrame([(1, 4, 10), (2, 4, 10)], "h long, song_id int, t1 int")
    out = []
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    identify.start(stream, p, Match(), lambda df: out.extend(df.collect()), str(tmp_path / "ck")).awaitTermination()
    assert [(r["query_id"], r["pred1"], r["score1"]) for r in out] == [(1, 4, 2)]


def test_a_bad_clip_leaves_the_others(spark):
    from echomark.plans.enrolment import enrol_catalog

    cfg = baseline_config()
    x = {k: dsp.resample(audio.toy_track(k, 12, 8000, -20.0), 8000, 8000).tolist() for k in (1, 2, 3)}
    rows = [(1, "db", x[1], 8000), (2, "db", [float("nan")] * 9000, 8000), (3, "holdout", x[3], 8000), (4, "db", x[2], 8000), (5, "db", [], 8000)]
    clips = spark.createDataFrame(rows, "clip long, role string, samples array<double>, fs int")
    peaks_, report = enrol_catalog(clips, cfg)
    got = {r["clip"]: r for r in report.collect()}
    assert {k: r["action"] for k, r in got.items()} == {1: "extracted", 2: "failed", 4: "extracted", 5: "failed"}
    assert got[1]["n_peaks"] > 0 and got[1]["n_hashes"] > 0 and got[2]["message"] == "samples that are not finite" and got[2]["n_peaks"] == 0
    held = spark.createDataFrame(peaks_.where("clip = 1 and t is not null").drop("message").collect(), "clip long, t int, f int, mag_db float")
    again = {r["clip"]: (r["action"], r["n_hashes"]) for r in enrol_catalog(clips, cfg, held)[1].collect()}
    assert again[1] == ("cached", got[1]["n_hashes"]) and again[4][0] == "extracted"
    with pytest.raises(ValueError, match="no songs"):
        enrol_catalog(clips.where("clip = 3"), cfg)
    with pytest.raises(ValueError, match="could be"):
        enrol_catalog(clips.where("clip = 2"), cfg)


def test_ingest_skips_what_is_current(spark):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    wav = audio.encode_wav(audio.toy_track(2, 3, 22050, -24.0), 22050)
    files = spark.createDataFrame([("a.wav", at, bytearray(wav)), ("b.wav", at, bytearray(wav)), ("c.wav", at, bytearray(b"junk"))], "path string, modified timestamp, content binary")
    done = spark.createDataFrame([("a.wav", at, "0" * 64, 3.0)], "path string, modified timestamp, sha256 string, duration_sec double")
    got = {r["path"]: r for r in audio.ingest_library(files, done).collect()}
    assert {k: r["action"] for k, r in got.items()} == {"a.wav": "skipped", "b.wav": "processed", "c.wav": "failed"}
    assert len(got["b.wav"]["sha256"]) == 64 and audio.decode_wav(bytes(got["b.wav"]["wav"]))[1] == 8000 and got["c.wav"]["sha256"] is None


@pytest.mark.parametrize("size", [1, 30, 50000])
def test_noise_wraps_over_its_whole_bank(spark, size):
    from echomark.plans import studies

    draw = np.random.default_rng(size)
    song, bank = draw.standard_normal(2000), draw.standard_normal(size)
    m = spark.createDataFrame([(1, 1, 0.1, 101, "cafe", min(size, 25), 5.0)], "query_id long, song_id int, length_sec double, start_sample long, noise_type string, noise_start long, snr_db double")
    songs = spark.createDataFrame([(1, song.tolist())], "song_id int, samples array<double>")
    noise = spark.createDataFrame([("cafe", bank.tolist())], "noise_type string, samples array<double>")
    got = studies.synthesize(m, songs, noise, 8000).first()
    want, measured = dsp.synthesize(song, 101, 800, bank, min(size, 25), 5.0)
    assert np.allclose(got["samples"], want) and got["snr_measured"] == pytest.approx(measured)


def test_quantiles_are_exact(spark):
    draw = np.random.default_rng(3)
    rows = [(k, float(v)) for k, n in (("a", 1), ("b", 2), ("c", 1001), (None, 40)) for v in np.round(draw.standard_normal(n) * 10, 1)] + [("a", None), ("c", 0.0), ("c", inf)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r["k"], r["name"]): r["q"] for r in evaluation.quantiles(df, ["k"], [("m", "hazen", 0.5), ("lo", "nearest", 0.05), ("hi", "hazen", 0.95)]).collect()}
    for k in ("a", "b", "c", None):
        v = sorted(x for g, x in rows if g == k and x is not None)
        n = len(v)
        for name, p in (("m", 0.5), ("hi", 0.95)):
            at = min(max(n * p + 0.5, 1), n)
            lo = int(at)
            a, b = v[lo - 1], v[min(lo + 1, n) - 1]
            assert got[k, name] == pytest.approx(a + (at - lo) * (b - a) if a != b else a)
        assert got[k, "lo"] == v[max(1, -(-n * 5 // 100)) - 1]


def test_studies_of_synthetic_tracks(spark):
    """The gate passes where every probe finds its track and fails where it cannot; smaller neighbourhoods give more peaks, and the sweep's sizes are those of each index."""
    from echomark.operators import signals
    from echomark.plans import studies

    cfg = baseline_config()
    clips = spark.createDataFrame([(k, dsp.resample(audio.toy_track(k, 30, 8000, -20.0), 8000, 8000).tolist(), 8000) for k in (1, 2)], "clip long, samples array<double>, fs int").repartition(2, "clip")
    assert tuple(studies.enrol_gate(clips, cfg).first()) == (1.0, True)
    silent = clips.withColumn("samples", F.transform("samples", lambda x: F.lit(0.0)))
    assert studies.enrol_gate(silent, cfg).first()["passed"] is False
    got = {r["nbhd"]: r for r in studies.neighbourhood_sweep(clips, cfg, (21, 13)).collect()}
    for n in (21, 13):
        own = replace(cfg, peaks=replace(cfg.peaks, nbhd_f=n, nbhd_t=n))
        p = signals.fingerprint(clips, own, denoise=False)
        h = landmarks.hashes(p, own).collect()
        keys = len({r["h"] for r in h})
        assert (got[n]["n_peaks"], got[n]["n_postings"], got[n]["n_keys"], got[n]["bytes"]) == (p.count(), len(h), keys, 4 * keys + 4 * (keys + 1) + 6 * len(h))
        d = [r["density_per_sec"] for r in peaks.density(p, own).collect()]
        assert got[n]["density_mean"] == pytest.approx(np.mean(d)) and got[n]["density_median"] == pytest.approx(np.median(d))
        assert got[n]["top1"] == 1.0 and got[n]["cap_can_bind"] is not None
    assert got[13]["n_peaks"] > got[21]["n_peaks"]


def test_index_layouts_are_compared(spark):
    from echomark.plans import studies

    postings = spark.createDataFrame([(7, 1, 10), (7, 1, 12), (7, 2, 5), (9, 2, 6)], "h long, song_id int, t1 int")
    q = spark.createDataFrame([(1, 7, 3), (1, 9, 4), (2, 8, 1)], "query_id long, h long, t1 int")
    assert studies.layouts_agree(q, postings).first()[0] == 0
    got = {r["most"]: tuple(r)[1:] for r in studies.pruning_dry_run(postings, (0, 1, 3)).collect()}
    assert got == {0: (0, 0, 0, True), 1: (1, 1, 1, False), 3: (2, 4, 3, False)}
    nothing = landmarks.prune_report(postings.limit(0), 3).collect()
    assert [tuple(r) for r in nothing] == [("before", 0, 0, 0, False), ("after", 0, 0, 0, False)]


def test_systems_must_share_queries(spark):
    a, b, c = (spark.createDataFrame([(k,) for k in ids], "query_id long") for ids in ((1, 2, 3), (2, 3), (9,)))
    assert tuple(evaluation.overlap(a, b).first()) == (3, 2, 2, True) and tuple(evaluation.overlap(a, a).first()) == (3, 3, 3, False)
    with pytest.warns(UserWarning, match="2 common"):
        evaluation.require_overlap(a, b)
    with pytest.raises(ValueError):
        evaluation.require_overlap(a, c)


def test_headroom_says_what_can_be_gained(spark):
    rows = [(snr, 3.0, True, k < right) for snr, right in ((10.0, 10), (0.0, 5), (-10.0, 1)) for k in range(10)] + [(0.0, 5.0, True, True)]
    got = {r["snr_db"]: (r["len3"], r["len5"], r["usable"], r["note"]) for r in evaluation.headroom(spark.createDataFrame(rows, "snr_db double, length_sec double, is_in_db boolean, correct boolean"), (3, 5)).collect()}
    assert got == {10.0: (0.0, None, False, "saturated"), 0.0: (50.0, 0.0, True, "some"), -10.0: (90.0, None, True, "floor")}


def test_manifests_survive_csv(spark, tmp_path):
    row = (1, 5, "opm", "db", "dev", 3.0, 17, 1, "none", 0, inf, 99)
    df = spark.createDataFrame([row, (2, *row[1:8], "cafe", 4, -5.0, 98)], tables.MANIFEST_SCHEMA)
    tables.write_csv(df, f"{tmp_path}/m")
    assert sorted(map(tuple, tables.read_manifest(spark, f"{tmp_path}/m", csv=True).collect())) == sorted(map(tuple, df.collect()))
    for name, bad in (("repeated", df.unionByName(df)), ("unknown", df.withColumn("noise_type", F.lit("rain"))), ("absent", df.withColumn("noise_type", F.lit(None).cast("string")))):
        bad.write.parquet(f"{tmp_path}/{name}")
        with pytest.raises(ValueError):
            tables.read_manifest(spark, f"{tmp_path}/{name}")


def test_latest_run_is_read_and_checked(spark, tmp_path):
    def rows(system, tag, n):
        return spark.createDataFrame([(system, tag, k, "dev" if k % 2 else "test") for k in range(n)], "system string, cfg_tag string, query_id long, split string")

    at = f"{tmp_path}/runs"
    tables.write_run(rows("base", "aa", 3).unionByName(rows("enh1", "bb", 4)), at, "20260101-0900")
    tables.write_run(rows("base", "cc", 5), at, "20260102-0900")
    assert tables.read_latest(spark, at, "base", "cc").count() == 5 and tables.read_latest(spark, at, "enh1", "bb").count() == 4
    assert {r["query_id"] for r in tables.read_latest(spark, at, "base", "cc", "dev").collect()} == {1, 3}
    for system, tag in (("base", "aa"), ("enh2", "aa")):
        with pytest.raises(ValueError):
            tables.read_latest(spark, at, system, tag)
    with pytest.raises(Exception, match="exist"):
        tables.write_run(rows("base", "cc", 1), at, "20260102-0900")


def test_noise_bank_knows_its_types(spark, tmp_path):
    def bank(kind):
        tables.write_csv(spark.createDataFrame([(kind, "X", f"{kind}.wav", 2.5, 16000.0, -20.0, "ab")], "noise_type string, demand_code string, file string, duration_sec double, fs_source double, rms_dbfs double, sha256 string"), f"{tmp_path}/{kind}")
        return tables.read_noise_bank(spark, f"{tmp_path}/{kind}", "/root")

    assert bank("cafe").first()["n_samples"] == 20000
    with pytest.raises(ValueError):
        bank("rain")

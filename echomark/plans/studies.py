"""Whole studies as single plans: experiments over a manifest, sweeps, probes and gates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dsp
from ..operators import evaluation, landmarks, matching, peaks, signals
from ..sources.files import register
from ..sources.tables import once, write_csv
from .config import Config
from .enrolment import hashes_of_peaks, identify_clips, identify_excerpts, postings_of

#: Places in a track, as parts of its length, at which a holdout song is probed; neighbourhoods of the sweep (fixed values).
PROBES = (0.20, 0.40, 0.60, 0.80)
NEIGHBOURHOODS = (21, 19, 17, 15, 13)


def excerpts(manifest: DataFrame, songs: DataFrame, noise: DataFrame, fs: int) -> DataFrame:
    """(query_id, x, v, snr_db) of every manifest row: the excerpt of its song, and as many samples of its noise, null for clean ones.

    songs has (song_id, samples), noise (noise_type, samples). Excerpts are sliced where the songs are joined, so whole songs do not travel
    with each query; a start outside the song is an error, and noise past its bank's end goes on at the bank's start.
    """
    need = F.round(F.col("length_sec") * fs).cast("int")
    rows = manifest.join(songs.select("song_id", F.col("samples").alias("song")), "song_id")
    fits = (F.col("start_sample") >= 1) & (F.col("start_sample") - 1 + need <= F.size("song"))
    rows = rows.withColumn("x", F.when(fits, F.slice("song", F.col("start_sample").cast("int"), need)).otherwise(F.raise_error(F.lit("the excerpt leaves the song")).cast("array<double>")))
    own = noise.select("noise_type", F.col("samples").alias("bank"))
    rows = rows.join(own, "noise_type", "left")
    # samples past the end of the bank go on at its start, as often as it takes
    at = lambda k: F.pmod(F.greatest(F.col("noise_start"), F.lit(1)) - 1 + k, F.size("bank")).cast("int")
    return rows.withColumn("v", F.transform(F.sequence(F.lit(0), need - 1), lambda k: F.get("bank", at(k)))).select("query_id", "x", "v", "snr_db")


def mixed(x, v, snr: float) -> tuple[np.ndarray, float]:
    """An excerpt with its noise, and the SNR measured."""
    y, measured, _ = dsp.mix_at_snr(np.asarray(x), np.asarray(v) if v is not None else np.zeros(0), snr)
    return y, measured


def synthesize(manifest: DataFrame, songs: DataFrame, noise: DataFrame, fs: int) -> DataFrame:
    """(clip, samples, fs, snr_measured) of every manifest row: its excerpt mixed with its noise at its SNR."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for q, x, v, snr in zip(b["query_id"], b["x"], b["v"], b["snr_db"], strict=True):
                y, measured = mixed(x, v, snr)
                yield pd.DataFrame({"clip": [q], "samples": [y.tolist()], "fs": [fs], "snr_measured": [measured]})

    return excerpts(manifest, songs, noise, fs).mapInPandas(run, "clip long, samples array<double>, fs int, snr_measured double")


def query_peaks(manifest: DataFrame, songs: DataFrame, noise: DataFrame, cfg: Config) -> DataFrame:
    """(clip, seconds, snr_measured, peaks array<struct<t, f, mag_db>>) of every manifest row: mixed and analysed in one kernel, so that no waveform leaves it."""
    fs = cfg.audio.fs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for q, x, v, snr in zip(b["query_id"], b["x"], b["v"], b["snr_db"], strict=True):
                y, measured = mixed(x, v, snr)
                t, f, db = dsp.peaks(dsp.spectrogram(y, fs, cfg, cfg.denoise.enable), cfg)
                rows.append((q, len(y) / fs, measured, [{"t": int(i), "f": int(j), "mag_db": float(m)} for i, j, m in zip(t, f, db, strict=True)]))
            yield pd.DataFrame(rows, columns=["clip", "seconds", "snr_measured", "peaks"])

    return excerpts(manifest, songs, noise, fs).mapInPandas(run, "clip long, seconds double, snr_measured double, peaks array<struct<t: int, f: int, mag_db: float>>")


def run_experiment(manifest: DataFrame, songs: DataFrame, noise: DataFrame, postings: DataFrame, cfg: Config, warmup: int = 20) -> DataFrame:
    """One result row per manifest row, all queries in one plan. Times per query have no meaning in a batch and are null.

    The kernel runs once: its peaks are written to the shared folder, with the lengths and SNRs that belong to them.
    """
    clips = once(query_peaks(manifest, songs, noise, cfg), "peaks")
    peaks_ = clips.select("clip", "seconds", F.inline("peaks"))
    found = matching.identify(clips.select(F.col("clip").alias("query_id")), hashes_of_peaks(peaks_, cfg), postings, cfg.match)
    found = found.join(clips.select(F.col("clip").alias("query_id"), "snr_measured"), "query_id")
    known = F.col("role") == "db"
    out = manifest.join(found, "query_id").withColumn("is_in_db", known).withColumn("correct", known & (F.col("pred1") == F.col("song_id")))
    empty = F.lit(None).cast("double")
    return out.withColumns({"system": F.lit(cfg.system), "cfg_tag": F.lit(cfg.tag), "warmup": F.col("query_id") <= warmup, "t_hash": empty, "t_match": empty, "t_total": empty})


def spot_check(manifest: DataFrame, songs: DataFrame, noise: DataFrame, fs: int, tolerance_db: float = 0.1) -> DataFrame:
    """(snr_db, query_id, n_samples, peak, right_length, in_range, snr_kept, regenerates) of one query for each SNR of a manifest, synthesised twice.

    right_length: round(length_sec * fs) samples; in_range: no sample beyond full scale; snr_kept: the measured SNR is within tolerance_db of the one asked (clean
    ones always); regenerates: both times the same bytes, as no waveform is stored. An excerpt that cannot be synthesised is an error.
    """
    one = manifest.groupBy("snr_db").agg(F.min("query_id").alias("query_id")).select("query_id")
    rows = manifest.join(one, "query_id", "left_semi")

    def digests(own: DataFrame) -> DataFrame:
        made = synthesize(own, songs, noise, fs)
        sound = F.sha2(F.concat_ws(",", F.transform("samples", lambda x: x.cast("string"))), 256)
        return made.select(F.col("clip").alias("query_id"), F.size("samples").alias("n_samples"), F.array_max(F.transform("samples", F.abs)).alias("peak"), "snr_measured", sound.alias("sound"))

    # dealt otherwise the second time, so that neither order nor neighbours make a difference
    again = digests(rows.repartition("query_id", "snr_db")).select("query_id", F.col("sound").alias("again"))
    out = rows.select("query_id", "snr_db", F.round(F.col("length_sec") * fs).alias("need")).join(digests(rows), "query_id").join(again, "query_id")
    clean = F.col("snr_db") == float("inf")
    return out.select(
        "snr_db", "query_id", "n_samples", "peak", (F.col("n_samples") == F.col("need")).alias("right_length"), (F.col("peak") <= 1).alias("in_range"),
        (clean | (F.abs(F.col("snr_measured") - F.col("snr_db")) <= tolerance_db)).alias("snr_kept"), (F.col("sound") == F.col("again")).alias("regenerates"),
    )


def neighbourhood_sweep(clips: DataFrame, cfg: Config, sizes=NEIGHBOURHOODS) -> DataFrame:
    """(nbhd, n_peaks, density_mean, density_median, cap_can_bind, n_postings, n_keys, bytes, top1) of an index for each neighbourhood; top1 is the accuracy of clean probes. Clips are read once for all sizes."""
    cfgs = [replace(cfg, peaks=replace(cfg.peaks, nbhd_f=n, nbhd_t=n)) for n in sizes]
    rows, out = gate_peaks(clips, cfgs), None
    for k, (n, own) in enumerate(zip(sizes, cfgs, strict=True)):
        found = rows.where(F.col("own") == k)
        p = found.where("not excerpt").select("clip", F.inline("peaks"))
        postings = once(landmarks.build_index(landmarks.hashes(p, own)), "postings")
        s = landmarks.index_stats(postings)
        d = peaks.density(p, own).agg(F.sum("n_peaks").alias("n_peaks"), F.avg("density_per_sec").alias("density_mean"), F.percentile("density_per_sec", 0.5).alias("density_median"))
        cap = peaks.budget_audit(clips.sparkSession, own).agg(F.max("cap_can_bind").alias("cap_can_bind"))
        row = d.join(s, F.lit(True)).join(cap, F.lit(True)).join(_top1(found.where("excerpt"), postings, own), F.lit(True))
        row = row.select(F.lit(n).alias("nbhd"), "n_peaks", "density_mean", "density_median", "cap_can_bind", "n_postings", "n_keys", "bytes", "top1")
        out = row if out is None else out.unionByName(row)
    return out


def _at_place(at, seconds: float) -> tuple:
    """(start, n) of an excerpt at a place of a clip (samples, fs), as a part of its length."""
    n = F.least((F.col("fs") * seconds).cast("int"), F.size("samples"))
    return F.greatest(F.lit(1), F.least(F.round(at * F.size("samples")).cast("int"), F.size("samples") - n + 1)), n


def probes(clips: DataFrame, seconds: float = 10.0, places=PROBES) -> DataFrame:
    """(song_id, probe, clip, samples, fs): excerpts of each clip at fixed places."""
    rows = clips.select(F.col("clip").alias("song_id"), "fs", "samples", F.posexplode(F.array(*map(F.lit, places))).alias("probe", "at"))
    start, n = _at_place(F.col("at"), seconds)
    return rows.select("song_id", "probe", (F.col("song_id") * len(places) + F.col("probe")).alias("clip"), F.slice("samples", start, n).alias("samples"), "fs")


def holdout_duplicates(clips: DataFrame, postings: DataFrame, cfg: Config) -> DataFrame:
    """Of each holdout clip its best match in the index, and whether it is suspect."""
    p = probes(clips)
    found = identify_clips(p.select("clip", "samples", "fs"), postings, cfg).withColumnRenamed("query_id", "clip")
    return evaluation.holdout_check(p.select("song_id", "probe", "clip").join(found, "clip"))


def gate_peaks(clips: DataFrame, cfgs: Sequence[Config]) -> DataFrame:
    """fingerprint_with_excerpts() of a 10 s probe from a third of each clip, written once."""
    start, n = _at_place(F.lit(1 / 3), 10.0)
    return once(signals.fingerprint_with_excerpts(clips.withColumns({"start": start, "n": n}), cfgs), "peaks")


def _top1(found: DataFrame, postings: DataFrame, cfg: Config) -> DataFrame:
    """One row: the part of excerpts (clip, seconds, peaks) that find their own clip among postings."""
    out = identify_excerpts(found, postings, cfg)
    return out.agg(F.avg((F.col("pred1") == F.col("query_id")).cast("double")).alias("top1"))


def enrol_gate(clips: DataFrame, cfg: Config, least: float = 0.95) -> DataFrame:
    """One row: clean accuracy of a 10 s probe from a third of each track, and whether it passes. Peaks, hashes and blocks of them are written, no waveform is."""
    rows = gate_peaks(clips, [cfg])
    return _top1(rows.where("excerpt"), postings_of(rows, cfg), cfg).withColumn("passed", F.col("top1") >= least)


def layouts_agree(query_hashes: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: the hits that only one of the two index layouts finds; 0 where they are the same index."""
    a, b = matching.lookup(query_hashes, postings), matching.lookup_lists(query_hashes, landmarks.list_index(postings))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("n_different"))


def pruning_dry_run(postings: DataFrame, limits: tuple[int, ...]) -> DataFrame:
    """(most, n_keys, n_postings, max_len, emptied) that an index would have after pruning at each limit."""
    out = None
    for most in limits:
        row = landmarks.prune_report(postings, most).where("stage = 'after'").select(F.lit(most).alias("most"), "n_keys", "n_postings", "max_len", "emptied")
        out = row if out is None else out.unionByName(row)
    return out


def ranked(rows: DataFrame, key: str, name: str) -> tuple[DataFrame, int]:
    """rows with their place from 1 in order of key, and their number: sorted in ranges of the key, of which only the sizes meet in one place."""
    placed = once(rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    sizes = placed.groupBy(F.shiftright("__at", 33).alias("__p")).count()
    before = sizes.select("__p", (F.sum("count").over(Window.orderBy("__p")) - F.col("count")).alias("__before"))
    out = placed.withColumn("__p", F.shiftright("__at", 33)).join(F.broadcast(before), "__p")
    return out.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__p", "__at", "__before"), placed.count()


def systematic_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n rows at even distances in order of key, first and last included."""
    placed, total = ranked(rows, key, "__i")
    at = sorted({int(1 + k * (total - 1) / max(n - 1, 1) + 0.5) for k in range(n)})
    return placed.where(F.col("__i").isin(at)).drop("__i")


def write_demo(manifest: DataFrame, songs: DataFrame, noise: DataFrame, by: list[str], fs: int, path: str) -> None:
    """The demo's queries as WAV files, one for each combination of `by` in a manifest, and their rows as CSV beside them; all files are there or none."""
    register(manifest.sparkSession)
    rows = evaluation.demo_rows(manifest, by)
    name = F.format_string("query%06d.wav", F.col("clip"))
    synthesize(rows, songs, noise, fs).select(name.alias("name"), "samples", "fs").write.format("audio").mode("overwrite").save(f"{path}/wav")
    write_csv(rows.withColumn("file", F.format_string("wav/query%06d.wav", F.col("query_id"))), f"{path}/manifest")


def constellation_axes(peaks_: DataFrame, cfg: Config) -> DataFrame:
    """Peaks with seconds and hertz for plotting."""
    return peaks_.withColumn("seconds", (F.col("t") - 1) / F.lit(cfg.frame_rate)).withColumn("hz", (F.col("f") - 1) * F.lit(cfg.bin_width_hz))


def accuracy_series(cells: DataFrame) -> DataFrame:
    """Accuracy by SNR for plotting: the clean condition stands one step of 5 dB beyond the highest finite SNR."""
    top = F.max(F.when(F.col("snr_db") < float("inf"), F.col("snr_db"))).over(Window.partitionBy(F.lit(1)))
    return cells.withColumn("x", F.when(F.col("snr_db") < float("inf"), F.col("snr_db")).otherwise(top + 5))


def repertoire_confusion(results: DataFrame, songs: DataFrame) -> DataFrame:
    """(repertoire, predicted, n) of answers by the repertoire of the song asked and of the song found."""
    a = songs.select("song_id", "repertoire")
    b = songs.select(F.col("song_id").alias("pred1"), F.col("repertoire").alias("predicted"))
    return results.select("song_id", "pred1").join(a, "song_id").join(b, "pred1", "left").groupBy("repertoire", F.coalesce("predicted", F.lit("none")).alias("predicted")).agg(F.count("*").alias("n"))


def density_by_snr(clips: DataFrame, cfg: Config) -> DataFrame:
    """(snr_db, density) of clips with snr_db: mean peaks per second."""
    d = peaks.density(signals.fingerprint(clips, cfg), cfg)
    return clips.select("clip", "snr_db").join(d, "clip").groupBy("snr_db").agg(F.avg("density_per_sec").alias("density"))

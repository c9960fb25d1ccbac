"""Query manifests, their invariants, rates with intervals, and paired comparison."""

from __future__ import annotations

import warnings
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import draw, mcnemar, wilson
from ..plans.config import Eval
from .signals import admissible_starts

INF = float("inf")
#: The knee probe's lengths and SNRs, and the part of a noise bank that starts must reach (fixed values).
KNEE_LENGTHS, KNEE_SNRS, LEAST_SPAN = (3.0, 10.0), (INF, 10.0, 5.0, 0.0, -5.0, -10.0, -15.0, -20.0, -25.0), 0.25
REQUIRED = ("is_in_db", "correct", "accepted", "norm_score", "margin", "t_match", "warmup")


def manifest(spark: SparkSession, songs: DataFrame, cfg: Eval, seed: int, fs: int, noise: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """One row per synthetic query: songs x lengths x repetitions x (clean and noises x finite SNRs), holdout songs too.

    songs has (song_id, repertoire, role, split, n_samples), noise (noise_type, n_samples). An excerpt's start depends on song, length and
    repetition only, a noise start on these and the noise, so conditions differ in nothing else. query_id is positional: only songs are ranked, the rest is arithmetic.
    starts (song_id, length_sec, rep, start_sample), as from excerpt_starts(), takes the place of the ungated draw.
    """
    every, first = Window.partitionBy(F.lit(1)), Window.partitionBy(F.lit(1)).orderBy
    shapes = spark.createDataFrame([(float(x), r) for x in cfg.lengths_sec for r in range(1, cfg.reps_per_song + 1)], "length_sec double, rep int")
    shapes = shapes.withColumn("__shape", F.row_number().over(first("length_sec", "rep")) - 1).withColumn("__shapes", F.count("*").over(every))
    finite = sorted((float(s) for s in cfg.snr_db if s != INF), reverse=True)
    noisy = noise.where(F.col("noise_type").isin(*cfg.noise_types)).select("noise_type", F.col("n_samples").alias("noise_samples"), F.array(*map(F.lit, finite)).cast("array<double>").alias("__snrs"))
    clean = spark.createDataFrame([("none", 0, [INF])], "noise_type string, noise_samples long, __snrs array<double>")
    kinds = clean.unionByName(noisy) if INF in cfg.snr_db else noisy
    order = first(F.col("noise_type") != "none", "noise_type")
    kinds = kinds.withColumn("__before", F.sum(F.size("__snrs")).over(order) - F.size("__snrs")).withColumn("__kinds", F.sum(F.size("__snrs")).over(every))
    # starts are drawn where they first differ: once for each excerpt, then once for each kind of noise
    rows = songs.withColumn("__song", F.row_number().over(Window.orderBy("song_id")) - 1).repartition("song_id").crossJoin(F.broadcast(shapes))
    base = [F.lit(str(seed)), F.col("song_id").cast("string"), F.col("length_sec").cast("int").cast("string"), F.col("rep").cast("string")]
    need = F.round(F.col("length_sec") * fs).cast("long")
    start = F.floor(draw(*base, F.lit("excerpt")) * F.greatest(F.col("n_samples") - need + 1, F.lit(1))).cast("long") + 1
    rows = rows.withColumn("start_sample", start) if starts is None else rows.join(starts.select("song_id", "length_sec", "rep", "start_sample"), ["song_id", "length_sec", "rep"])
    rows = rows.crossJoin(F.broadcast(kinds))
    noise_start = F.when(F.col("noise_type") == "none", F.lit(0)).otherwise(F.floor(draw(*base, F.col("noise_type")) * F.greatest(F.col("noise_samples") - need + 1, F.lit(1))) + 1).cast("long")
    rows = rows.withColumn("noise_start", noise_start).select("*", F.posexplode("__snrs").alias("__snr", "snr_db"))
    rows = rows.withColumn("query_id", (F.col("__song").cast("long") * F.col("__shapes") + F.col("__shape")) * F.col("__kinds") + F.col("__before") + F.col("__snr") + 1)
    rows = rows.withColumn("seed", F.floor(draw(*base, F.col("noise_type"), F.col("snr_db").cast("string")) * F.lit(float(1 << 31))).cast("long"))
    return rows.select("query_id", "song_id", "repertoire", "role", "split", "length_sec", "start_sample", "rep", "noise_type", "noise_start", "snr_db", "seed")


def excerpt_starts(samples: DataFrame, lengths: DataFrame, reps: int, gate: float, frame: int, seed: int) -> DataFrame:
    """(song_id, length_sec, rep, start_sample, mode) drawn from the song's admissible starts, evenly and by seed.

    samples has (clip, i, x) with i from 0, lengths (length_sec, need). A song shorter than the excerpt starts at 1 (short); one whose median frame
    energy is zero or that has no admissible start is drawn from all its starts (silent, ungated); else the draw is gated.
    """
    sizes = samples.groupBy("clip").agg(F.count("*").alias("n"))
    found = None
    for r in lengths.collect():  # a handful of excerpt lengths, given by the configuration
        # admissible starts are numbered by time, so that the draw picks the k-th of them
        own = admissible_starts(samples, r["need"], frame, gate).withColumn("k", F.row_number().over(Window.partitionBy("clip").orderBy("i")))
        own = own.withColumn("m", F.count("*").over(Window.partitionBy("clip"))).select("clip", F.lit(r["length_sec"]).alias("length_sec"), F.lit(r["need"]).alias("need"), "i", "k", "m")
        found = own if found is None else found.unionByName(own)
    energy = samples.groupBy("clip", F.floor(F.col("i") / frame).alias("k")).agg(F.sum(F.col("x") * F.col("x")).alias("e"), F.count("*").alias("c")).where(F.col("c") == frame)
    silent = energy.groupBy("clip").agg((F.percentile("e", 0.5) <= 0).alias("silent"))
    gated = found.select("clip", "length_sec", "m").distinct()
    asked = sizes.crossJoin(F.broadcast(lengths)).join(samples.sparkSession.range(1, reps + 1).select(F.col("id").cast("int").alias("rep")), F.lit(True))
    asked = asked.join(silent, "clip", "left").join(gated, ["clip", "length_sec"], "left")
    mode = F.when(F.col("n") <= F.col("need"), "short").when(F.coalesce("silent", F.lit(True)), "silent").when(F.col("m").isNull(), "ungated").otherwise("gated")
    u = draw(F.lit(str(seed)), F.col("clip").cast("string"), F.col("length_sec").cast("int").cast("string"), F.col("rep").cast("string"), F.lit("excerpt"))
    asked = asked.withColumn("mode", mode).withColumn("k", (F.floor(u * F.when(F.col("mode") == "gated", F.col("m")).otherwise(F.greatest(F.col("n") - F.col("need") + 1, F.lit(1)))) + 1).cast("long"))
    out = asked.join(found.select("clip", "length_sec", "k", "i"), ["clip", "length_sec", "k"], "left")
    start = F.when(F.col("mode") == "short", F.lit(1)).when(F.col("mode") == "gated", F.col("i") + 1).otherwise(F.col("k")).cast("long")
    return out.select(F.col("clip").alias("song_id"), "length_sec", "rep", start.alias("start_sample"), "mode")


def manifest_invariants(rows: DataFrame, songs: DataFrame, noise: DataFrame, again: DataFrame, fs: int, checked: DataFrame | None = None, absent: DataFrame | None = None) -> DataFrame:
    """(check, violations) of the properties that make conditions comparable; all are 0 in a sound manifest. again is the manifest built anew.

    With checked, the rows of studies.spot_check(), also synthesis (SNRs at which a query has the wrong length, clips, or misses its SNR) and
    regeneration; with absent, the noise types whose file is not there (catalog.missing_noise, or a listing), also noise_files.

    The manifest is read twice, each time dealt out once: by song for what songs, excerpts and noises have in common, and by query id, together
    with the manifest built anew, for ids and regeneration.
    """
    by_song = _violations_by_song(rows, songs, noise, fs)
    by_id = _violations_by_id(rows, again)
    both = by_song.crossJoin(by_id)  # one row each
    names = ["excerpt_shared", "noise_shared", "split_by_song", "unique_id", "clean_without_noise", "holdout_queried", "excerpt_inside", "noise_known", "noise_span", "regenerated"]
    out = both.select(F.inline(F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(n, F.lit(0)).cast("long").alias("violations")) for n in names))))
    number = lambda df, name: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
    if checked is not None:
        one = checked.agg(F.count(F.when(~(F.col("right_length") & F.col("in_range") & F.col("snr_kept")), 1)).alias("a"), F.count(F.when(~F.col("regenerates"), 1)).alias("b"))
        out = out.unionByName(one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("check"), F.col(c).alias("violations")) for n, c in (("synthesis", "a"), ("regeneration", "b")))))))
    if absent is not None:
        used = rows.where("noise_type <> 'none'").select("noise_type").distinct()
        out = out.unionByName(number(used.join(absent.select("noise_type").distinct(), "noise_type", "left_semi"), "noise_files"))
    return out


def _violations_by_song(rows: DataFrame, songs: DataFrame, noise: DataFrame, fs: int) -> DataFrame:
    """One row of the violations that a song's rows show together."""
    need = F.round(F.col("length_sec") * fs)
    known = songs.select("song_id", F.col("role").alias("own_role"), "n_samples", F.lit(True).alias("is_song"))
    kinds = noise.select("noise_type", F.col("n_samples").alias("bank"))
    all_ = rows.join(known, "song_id", "full").join(F.broadcast(kinds), "noise_type", "left")  # kinds: one row for each noise type
    noisy, count = F.col("noise_type") != "none", lambda c: F.count(F.when(c, 1))
    cells = all_.groupBy("song_id", "length_sec", "rep", "noise_type").agg(
        F.min("start_sample").alias("lo"), F.max("start_sample").alias("hi"), F.min("noise_start").alias("n_lo"), F.max("noise_start").alias("n_hi"), F.min("split").alias("s_lo"), F.max("split").alias("s_hi"),
        count(~noisy & (F.col("noise_start") != 0)).alias("clean"), count(noisy & F.col("bank").isNull()).alias("unknown"),
        count(F.col("is_song") & ((F.col("start_sample") < 1) | (F.col("start_sample") - 1 + need > F.greatest("n_samples", need)))).alias("outside"),
        count((F.col("own_role") == "holdout") & F.col("query_id").isNull()).alias("unasked"), F.max("bank").alias("bank"),
    )
    # what a song's cells have in common needs no further shuffle once they are dealt by song
    cells = cells.repartition("song_id")
    excerpt, song = ["song_id", "length_sec", "rep"], ["song_id"]
    first = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy("noise_type" if keys is excerpt else F.struct("length_sec", "rep", "noise_type"))) == 1
    differ = lambda lo, hi, keys: first(keys) & (F.min(lo).over(Window.partitionBy(*keys)) != F.max(hi).over(Window.partitionBy(*keys)))
    cells = cells.withColumns({"e": differ("lo", "hi", excerpt), "s": differ("s_lo", "s_hi", song)})
    kinds = cells.groupBy("noise_type").agg(
        count(F.col("e")).alias("e"), count(F.col("s")).alias("s"), count(F.col("n_lo") != F.col("n_hi")).alias("n"), *(F.sum(c).alias(c) for c in ("clean", "unknown", "outside", "unasked")), F.max("n_hi").alias("last"), F.max("bank").alias("bank")
    )
    # starts that crowd at the head of a bank leave most of its noise unheard
    span = (F.col("noise_type") != "none") & (F.col("last") < LEAST_SPAN * F.col("bank"))
    sums = {"excerpt_shared": "e", "noise_shared": "n", "split_by_song": "s", "clean_without_noise": "clean", "excerpt_inside": "outside", "noise_known": "unknown", "holdout_queried": "unasked"}
    return kinds.agg(*(F.sum(c).alias(name) for name, c in sums.items()), count(span).alias("noise_span"))


def _violations_by_id(rows: DataFrame, again: DataFrame) -> DataFrame:
    """One row: query ids that stand for several conditions, and rows that the manifest built anew lacks."""
    columns = rows.columns
    both = rows.withColumn("n", F.lit(1)).unionByName(again.select(*columns).withColumn("n", F.lit(-1)))
    same = both.groupBy(*columns).agg(F.sum("n").alias("n"), F.sum(F.greatest("n", F.lit(0))).alias("here"))
    condition = F.struct("song_id", "length_sec", "rep", "noise_type", "snr_db")
    ids = same.groupBy("query_id").agg(F.count_distinct(F.when(F.col("here") > 0, condition)).alias("conditions"), F.sum(F.greatest("n", F.lit(0))).alias("gone"))
    return ids.agg(F.count(F.when(F.col("conditions") > 1, 1)).alias("unique_id"), F.sum("gone").alias("regenerated"))


#: Steps of a factor of two by which values are binned for exact quantiles.
BIN_STEPS = 4096


def quantiles(values: DataFrame, keys: list[str], wanted: list[tuple[str, str, float]]) -> DataFrame:
    """(keys, name, q) of values (keys, v): exact quantiles, each (name, kind, p) either "nearest" (the ceil(p n)-th) or "hazen" (interpolated at p n + 1/2, clamped to the ends).

    Values are counted in bins of their logarithms, which keep their order; only the bins that hold a wanted rank are looked into, by
    distinct value, so that no group's values come together in one row or one sort, ties included. Null values are left out; groups without values give no row.
    """
    v = F.col("v")
    step = lambda x: F.floor(F.least(F.log2(x) * BIN_STEPS, F.lit(1e8))) + F.lit(1 << 24)
    binned = values.where(v.isNotNull()).select(F.struct(*keys, F.lit(1).alias("__one")).alias("g"), "v", F.when(v > 0, step(v)).when(v < 0, -step(-v)).otherwise(F.lit(0)).cast("long").alias("bin"))
    bins = binned.groupBy("g", "bin").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(Window.partitionBy("g").orderBy("bin")))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(kind == "nearest").alias("nearest"), F.lit(float(p)).alias("p")) for name, kind, p in wanted]))
    asked = bins.groupBy("g").agg(F.max("upto").alias("n")).select("g", "n", asked.alias("w")).select("g", "n", "w.*")
    at = F.when(F.col("nearest"), F.greatest(F.lit(1.0), F.ceil(F.col("n") * F.col("p")).cast("double"))).otherwise(F.least(F.greatest(F.col("n") * F.col("p") + 0.5, F.lit(1.0)), F.col("n").cast("double")))
    asked = asked.withColumn("part", at - F.floor(at)).withColumn("lo", F.floor(at)).withColumn("hi", F.when(F.col("nearest"), F.col("lo")).otherwise(F.least(F.col("lo") + 1, F.col("n"))))
    asked = asked.select("g", "name", "part", F.posexplode(F.array("lo", "hi")).alias("end", "rank"))
    inside = (F.col("rank") > F.col("upto") - F.col("c")) & (F.col("rank") <= F.col("upto"))
    places = asked.join(bins, "g").where(inside).select("g", "bin", "name", "part", "end", "rank", (F.col("upto") - F.col("c")).alias("before"))
    held = places.groupBy("g", "bin").agg(F.max("before").alias("before"))
    found = binned.join(held, ["g", "bin"]).groupBy("g", "bin", "v").agg(F.count("*").alias("c"), F.max("before").alias("before"))
    found = found.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("g", "bin").orderBy("v"))).drop("before")
    found = found.join(places, ["g", "bin"]).where(inside)
    out = found.groupBy("g", "name", "part").agg(*[F.max(F.when(F.col("end") == i, v)).alias(x) for i, x in enumerate("ab")])
    return out.select(*[F.col(f"g.{k}").alias(k) for k in keys], "name", (F.col("a") + F.col("part") * (F.col("b") - F.col("a"))).alias("q"))


def metrics(results: DataFrame, keys: list[str]) -> DataFrame:
    """Rates by group, each on its own denominator with its Wilson interval, margins and times.

    Accuracy, operational accuracy and recall are over rows of known songs, precision over all accepted rows, the false-accept rate over
    rows of unknown ones. margin_p05 is by nearest rank, time_p95 interpolated; warm-up rows count for rates but not for times.
    """
    missing = [c for c in (*REQUIRED, *keys) if c not in results.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    count = lambda c: F.count(F.when(c, 1))
    known, hit, said = F.col("is_in_db"), F.col("correct"), F.col("accepted")
    timed = F.when(~F.col("warmup"), F.col("t_match"))
    g = results.groupBy(*keys).agg(
        F.count("*").alias("n"), count(known).alias("n_in_db"), count(~known).alias("n_holdout"), count(said).alias("n_accepted"),
        count(known & hit).alias("n_correct"), count(known & hit & said).alias("n_true_accept"), count(~known & said).alias("n_false_accept"),
        F.min(F.when(known, F.col("margin"))).alias("margin_min"),
    )
    measures = results.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("m"), x.cast("double").alias("v")) for m, x in (("margin", F.when(known, F.col("margin"))), ("time", timed), ("score", F.when(known, F.col("norm_score"))))])).alias("x")).select(*keys, "x.m", "x.v")
    names = {"margin_median": ("margin", "median"), "margin_p05": ("margin", "p05"), "time_median": ("time", "median"), "time_p95": ("time", "p95"), "med_norm_score": ("score", "median")}
    found = quantiles(measures, [*keys, "m"], [("median", "hazen", 0.5), ("p05", "nearest", 0.05), ("p95", "hazen", 0.95)])
    found = found.groupBy(F.struct(*keys, F.lit(1).alias("__one")).alias("__k")).agg(*[F.max(F.when((F.col("m") == m) & (F.col("name") == q), F.col("q"))).alias(c) for c, (m, q) in names.items()])
    for name, k, n in (("accuracy", "n_correct", "n_in_db"), ("operational", "n_true_accept", "n_in_db"), ("precision", "n_true_accept", "n_accepted"), ("recall", "n_true_accept", "n_in_db"), ("far", "n_false_accept", "n_holdout")):
        w = wilson(F.col(k), F.col(n))
        g = g.withColumns({name: w["p"], f"{name}_lo": w["lo"], f"{name}_hi": w["hi"]})
    return g.withColumn("__g", F.struct(*keys, F.lit(1).alias("__one"))).join(found, F.col("__g") == F.col("__k"), "left").drop("__g", "__k")


def paired(a: DataFrame, b: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """Per cell of keys, in-DB rows of two systems on the same queries: accuracies, discordant counts and McNemar's exact test. A query whose content differs between the systems is an error."""
    same = F.lit(True)
    for c in content:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    both = a.alias("a").join(b.alias("b"), F.col("a.query_id") == F.col("b.query_id")).where(F.col("a.is_in_db"))
    right = F.when(same, F.col("a.correct")).otherwise(F.raise_error(F.lit("the systems' queries differ")).cast("boolean"))
    rows = both.select(*[F.col(f"a.{k}").alias(k) for k in keys], right.cast("int").alias("x"), F.col("b.correct").cast("int").alias("y"))
    cells = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("acc_a"), F.avg("y").alias("acc_b"), F.count(F.when((F.col("x") == 1) & (F.col("y") == 0), 1)).alias("only_a"), F.count(F.when((F.col("x") == 0) & (F.col("y") == 1), 1)).alias("only_b"))
    m = mcnemar(F.col("n"), F.col("only_a"), F.col("only_b"))
    out = cells.withColumns({"diff_pp": 100 * m["diff"], "diff_lo_pp": 100 * m["lo"], "diff_hi_pp": 100 * m["hi"], "p": m["p"], "odds": m["odds"]})
    return out.withColumn("significant", F.col("p") < 0.05)


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the queries of two systems, those in common, and whether only a part of either is."""
    both = a.select("query_id", F.lit(1).alias("a")).join(b.select("query_id", F.lit(1).alias("b")), "query_id", "full")
    out = both.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("n_common"))
    return out.withColumn("partial", F.col("n_common") < F.greatest("n_a", "n_b"))


def require_overlap(a: DataFrame, b: DataFrame) -> None:
    """An error if two systems have no query in common, a warning if only some."""
    found = overlap(a, b).first()
    if not found["n_common"]:
        raise ValueError("the systems have no query in common")
    if found["partial"]:
        warnings.warn(f"{found['n_common']} common queries of {found['n_a']} and {found['n_b']}", stacklevel=2)


def verdicts(cells: DataFrame) -> DataFrame:
    """One row: cells gained and lost significantly, largest gain and loss, cells of 10 points difference or more."""
    return cells.agg(F.count(F.when(F.col("significant") & (F.col("diff_pp") > 0), 1)).alias("gains"), F.count(F.when(F.col("significant") & (F.col("diff_pp") < 0), 1)).alias("losses"), F.max("diff_pp").alias("best"), F.min("diff_pp").alias("worst"), F.count(F.when(F.abs("diff_pp") >= 10, 1)).alias("large"))


def headroom(results: DataFrame, lengths: tuple[float, ...] = Eval().lengths_sec) -> DataFrame:
    """100 - accuracy by SNR, a column len<seconds> per length; usable: a cell leaves 10 points to gain; note: saturated (none does), floor (all leave more than 80), every or some."""
    lengths = [float(x) for x in lengths]
    rows = results.where("is_in_db").groupBy("snr_db").pivot("length_sec", lengths).agg(F.round(100 - 100 * F.avg(F.col("correct").cast("double")), 6))
    names = [f"len{x:g}" for x in lengths]
    out = rows.select("snr_db", *[F.col(f"`{x}`").alias(n) for x, n in zip(lengths, names, strict=True)])
    room = F.array(*names)
    usable = F.size(F.filter(room, lambda x: x >= 10))
    note = F.when(usable == 0, "saturated").when(F.forall(F.filter(room, lambda x: x.isNotNull()), lambda x: x > 80), "floor").when(usable == len(names), "every").otherwise("some")
    return out.withColumn("usable", usable > 0).withColumn("note", note)


def knee(cells: DataFrame) -> DataFrame:
    """(length_sec, knee_db): the highest finite SNR at which top-1 accuracy is below 95 %; cells has (length_sec, snr_db, top1)."""
    low = (F.col("top1") < 0.95) & (F.col("snr_db") < INF)
    return cells.groupBy("length_sec").agg(F.max(F.when(low, F.col("snr_db"))).alias("knee_db"))


def knee_manifest(spark: SparkSession, songs: DataFrame, cfg: Eval, seed: int, fs: int, noise: DataFrame, lengths=KNEE_LENGTHS, snrs=KNEE_SNRS) -> DataFrame:
    """The probe's manifest: enrolled songs at two lengths and nine SNRs, all noises and repetitions."""
    return manifest(spark, songs.where("role = 'db'"), replace(cfg, lengths_sec=lengths, snr_db=snrs), seed, fs, noise)


def norm_ratio(cells: DataFrame) -> DataFrame:
    """(length_sec, ratio): the median score per hash at 0 dB over that of clean queries, which shows degradation where accuracy does not yet; cells has (length_sec, snr_db, med_norm_score)."""
    at = lambda x: F.max(F.when(F.col("snr_db") == x, F.col("med_norm_score")))
    return cells.groupBy("length_sec").agg((at(0.0) / F.nullif(at(INF), F.lit(0.0))).alias("ratio"))


def subset_by_song(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """All rows of n songs drawn by seed."""
    songs = rows.select("song_id").distinct().orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("song_id").cast("string")).cast("binary"))).limit(n)
    return rows.join(songs, "song_id", "left_semi")


def demo_rows(rows: DataFrame, keys: list[str], most: int = 30) -> DataFrame:
    """The first query of each group, at most so many."""
    first = Window.partitionBy(*keys).orderBy("query_id")
    return rows.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k").orderBy("query_id").limit(most)


def latest_runs(runs: DataFrame) -> DataFrame:
    """Rows of each system's latest run, by (run_on, run_id)."""
    last = runs.groupBy("system").agg(F.max(F.struct("run_on", "run_id")).alias("__last")).select("system", "__last.run_id")
    return runs.join(last, ["system", "run_id"], "left_semi")


def holdout_check(decisions: DataFrame, suspect: float = 0.15) -> DataFrame:
    """Of each holdout song the probe of the highest norm_score, and whether it looks like a duplicate of an enrolled one."""
    best = decisions.groupBy("song_id").agg(F.max_by(F.struct("pred1", "norm_score"), F.struct("norm_score", -F.col("probe"))).alias("b"))
    return best.select("song_id", "b.pred1", "b.norm_score", (F.col("b.norm_score") >= suspect).alias("suspect"))

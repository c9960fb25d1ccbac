"""From dense time-frequency cells to capped spectral peaks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dsp
from ..plans.config import Config

EPS = 2.220446049250313e-16


def cells_db(cells: DataFrame) -> DataFrame:
    """Adds db: 20 log10 of the magnitude over its clip's maximum."""
    top = F.max("mag").over(Window.partitionBy("clip"))
    return cells.withColumn("db", F.when(top > 0, level_db(F.col("mag"), top)))


def level_db(mag, top):
    return 20 * F.log10(mag / top + F.lit(EPS))


def check_neighbourhood(*sizes: int) -> None:
    if any(n % 2 == 0 or n < 1 for n in sizes):
        raise ValueError("neighbourhoods must be odd")


#: Frames of a tile.
TILE = 256


def pick_fixed(cells: DataFrame, cfg: Config) -> DataFrame:
    """Cells that equal the maximum of their neighbourhood (ties all pass), are not below floor_db and not zero."""
    return _pick(cells, cfg, None, cfg.peaks.floor_db)


def pick_adaptive(cells: DataFrame, cfg: Config) -> DataFrame:
    """As pick_fixed, but above the separable local median by kappa_db instead of a floor."""
    return _pick(cells, cfg, cfg.peaks.kappa_db, None)


def _pick(cells: DataFrame, cfg: Config, kappa_db: float | None, floor_db: float | None) -> DataFrame:
    """Peaks by tiles of TILE frames of a clip, each with the frames beside it that its neighbourhoods reach.

    So a clip of any length is shuffled once, in pieces, and only peaks come back from the kernel, whose time does not depend on the neighbourhood's
    size for maxima. A cell that is not there is in no maximum and no median.
    """
    p = cfg.peaks
    check_neighbourhood(p.nbhd_f, p.nbhd_t)
    reach = p.nbhd_t // 2
    tiles = F.sequence(F.floor((F.col("t") - 1 - reach) / TILE), F.floor((F.col("t") - 1 + reach) / TILE))
    # the clip's maximum comes from an aggregation of its own, not from a window that would gather the clip
    top = cells.groupBy(F.col("clip").alias("__clip")).agg(F.max("mag").alias("__top"))
    rows = cells.select("clip", "t", "f", "mag", F.explode(tiles).alias("tile")).join(top, F.col("clip") == F.col("__clip")).where("__top > 0")
    rows = rows.select("clip", "t", "f", "mag", level_db(F.col("mag"), F.col("__top")).alias("db"), "tile")
    kinds = {c: k for c, k in rows.dtypes}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        t, f, mag, db = (table.column(c).to_numpy() for c in ("t", "f", "mag", "db"))
        i, j = (t - t.min()).astype(np.int64), (f - f.min()).astype(np.int64)
        size = np.full((int(i.max()) + 1, int(j.max()) + 1), -np.inf)
        size[i, j] = mag
        peak = (mag >= dsp.moving_max(dsp.moving_max(size, p.nbhd_f).T, p.nbhd_t).T[i, j]) & (mag > 0) & ((t - 1) // TILE == key[1].as_py())
        if kappa_db is None:
            peak &= db >= floor_db
        else:
            level = np.full(size.shape, np.nan)
            level[i, j] = db
            with np.errstate(invalid="ignore"):
                peak &= db >= dsp.moving_median(dsp.moving_median(level, p.nbhd_f).T, p.nbhd_t).T[i, j] + kappa_db
        return table.filter(pa.array(peak)).select(["clip", "t", "f", "db"])

    found = rows.groupBy("clip", "tile").applyInArrow(run, f"clip {kinds['clip']}, t {kinds['t']}, f {kinds['f']}, db double")
    return _peaks(found)


def _peaks(df: DataFrame) -> DataFrame:
    return df.select("clip", "t", "f", F.col("db").cast("float").alias("mag_db"))


def with_cell(peaks: DataFrame, cfg: Config) -> DataFrame:
    """Adds sec and band of each peak; frames and bins count from 1, the top edge belongs to the last band."""
    edges = cfg.peaks.band_edges_hz
    if len(edges) < 2:
        raise ValueError("at least two band edges are needed")
    hz = (F.col("f") - 1) * F.lit(float(cfg.bin_width_hz))
    band = F.lit(len(edges) - 1)
    for i in range(len(edges) - 2, 0, -1):
        band = F.when(hz < edges[i], F.lit(i)).otherwise(band)
    return peaks.withColumn("sec", (F.floor((F.col("t") - 1) / F.lit(cfg.frame_rate)) + 1).cast("int")).withColumn("band", band.cast("int"))


def band_budget(cfg: Config) -> int:
    return max(1, int(cfg.peaks.density_per_sec / (len(cfg.peaks.band_edges_hz) - 1) + 0.5))


def cap_density(peaks: DataFrame, cfg: Config) -> DataFrame:
    """The strongest peaks of each band and second, by float32 level and then by (t, f)."""
    best = Window.partitionBy("clip", "sec", "band").orderBy(F.col("mag_db").desc(), "t", "f")
    return with_cell(peaks, cfg).withColumn("__k", F.row_number().over(best)).where(F.col("__k") <= band_budget(cfg)).drop("__k", "sec", "band")


def pick(cells: DataFrame, cfg: Config) -> DataFrame:
    """The configured picker, then the density cap, once."""
    pickers = {"fixed": pick_fixed, "adaptive": pick_adaptive}
    if cfg.peaks.mode not in pickers:
        raise ValueError(f"unknown peak mode {cfg.peaks.mode!r}")
    return cap_density(pickers[cfg.peaks.mode](cells, cfg), cfg)


def density(peaks: DataFrame, cfg: Config) -> DataFrame:
    """Of each clip: peaks, seconds, peaks per second."""
    return with_cell(peaks, cfg).groupBy("clip").agg(F.count("*").alias("n_peaks"), F.max("sec").alias("n_secs")).withColumn("density_per_sec", F.col("n_peaks") / F.col("n_secs"))


def budget_audit(spark: SparkSession, cfg: Config) -> DataFrame:
    """The peak-budget formula by band, with totals and the largest odd neighbourhood whose ceiling is 1.5 times the target; an audit only, not a bound."""
    p, edges, k = cfg.peaks, cfg.peaks.band_edges_hz, band_budget(cfg)
    bands = spark.createDataFrame([(i + 1, float(lo), float(hi)) for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True))], "band int, lo_hz double, hi_hz double")
    out = bands.withColumn("n_bins", F.greatest(F.floor(F.col("hi_hz") / cfg.bin_width_hz) - F.floor(F.col("lo_hz") / cfg.bin_width_hz), F.lit(0)))
    out = out.withColumn("ceiling_per_sec", F.lit(cfg.frame_rate / p.nbhd_t) * F.col("n_bins") / p.nbhd_f).withColumn("budget_k", F.lit(k)).withColumn("reachable", F.col("ceiling_per_sec") >= k)
    ceiling = cfg.frame_rate / p.nbhd_t * cfg.n_bins / p.nbhd_f
    fits = [r for r in range(31, 1, -2) if cfg.frame_rate / r * cfg.n_bins / r >= 1.5 * p.density_per_sec]
    return out.withColumn("total_ceiling", F.lit(ceiling)).withColumn("cap_can_bind", F.lit(p.density_per_sec < ceiling)).withColumn("headroom", F.lit(ceiling / max(p.density_per_sec, EPS))).withColumn("suggested_nbhd", F.lit(fits[0] if fits else None).cast("int"))

"""Peak pickers against neighbourhoods looked at one by one."""

from dataclasses import replace

import numpy as np
import pytest

from echomark.functions import dsp
from echomark.operators import peaks
from echomark.plans.config import Config


def windows(x, n, what):
    r = n // 2
    return np.array([[what(row[max(0, k - r) : k + r + 1]) for k in range(len(row))] for row in x])


@pytest.mark.parametrize("n", [1, 3, 5, 9, 31])
@pytest.mark.parametrize("shape", [(1, 1), (4, 2), (3, 7), (5, 31), (2, 100)])
def test_moving_maximum_and_median(n, shape):
    draw = np.random.default_rng(n)
    x = np.round(draw.normal(size=shape), 1)
    assert np.array_equal(dsp.moving_max(x, n), windows(x, n, np.max))
    assert np.array_equal(dsp.moving_median(x, n), windows(x, n, np.median))
    holes = np.where(draw.random(shape) < 0.4, np.nan, x)
    with np.errstate(all="ignore"):
        want = windows(holes, n, lambda v: np.median(v[~np.isnan(v)]) if (~np.isnan(v)).any() else np.nan)
    assert np.array_equal(dsp.moving_median(holes, n), want, equal_nan=True)


@pytest.mark.parametrize("mode", ["fixed", "adaptive"])
def test_pickers_across_tiles(spark, monkeypatch, mode):
    """Tiles shorter than a neighbourhood, ties, zeros, a silent clip and a clip of one cell."""
    monkeypatch.setattr(peaks, "TILE", 4)
    cfg = replace(Config(), peaks=replace(Config().peaks, mode=mode, nbhd_f=5, nbhd_t=11, floor_db=-30.0, kappa_db=3.0))
    draw = np.random.default_rng(8)
    grids = {1: np.round(np.abs(draw.normal(size=(37, 20))), 1), 2: np.zeros((5, 5)), 3: np.ones((1, 1)), 4: np.where(draw.random((30, 6)) < 0.7, 0, draw.random((30, 6)))}
    rows = [(c, i + 1, j + 1, float(x)) for c, g in grids.items() for (i, j), x in np.ndenumerate(g)]
    cells = spark.createDataFrame(rows, "clip long, t int, f int, mag double").repartition(3)
    pick = peaks.pick_fixed if mode == "fixed" else peaks.pick_adaptive
    want = set()
    for c, g in grids.items():
        if g.max() == 0:
            continue
        db = 20 * np.log10(g / g.max() + peaks.EPS)
        top = windows(windows(g, 5, np.max).T, 11, np.max).T
        bound = np.full(g.shape, -30.0) if mode == "fixed" else windows(windows(db, 5, np.median).T, 11, np.median).T + 3
        want |= {(c, i + 1, j + 1, round(float(np.float32(db[i, j])), 4)) for i, j in zip(*np.nonzero((g >= top) & (g > 0) & (db >= bound)), strict=True)}
    got = [(r["clip"], r["t"], r["f"], round(r["mag_db"], 4)) for r in pick(cells, cfg).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert pick(cells.where("false"), cfg).count() == 0


def test_even_neighbourhoods_are_refused(spark):
    cells = spark.createDataFrame([(1, 1, 1, 1.0)], "clip long, t int, f int, mag double")
    with pytest.raises(ValueError, match="odd"):
        peaks.pick_fixed(cells, replace(Config(), peaks=replace(Config().peaks, nbhd_f=4)))

"""Threshold sweeps and operating points against loops over all pairs."""

import random

import pytest

from echomark.operators import tuning

SCHEMA = "norm_score double, margin double, is_in_db boolean, correct boolean"


def brute(rows, taus, rhos):
    out = {}
    known, unknown = sum(r[2] for r in rows), sum(not r[2] for r in rows)
    for tau in taus:
        for rho in rhos:
            ok = [r for r in rows if r[0] is not None and r[0] >= tau and r[1] >= rho]
            tp, fa = sum(r[2] and r[3] for r in ok), sum(not r[2] for r in ok)
            p, r = tp / max(len(ok), 1), tp / known
            out[tau, rho] = (tp, len(ok), fa, p, r, fa / unknown, 2 * p * r / max(p + r, 2.220446049250313e-16))
    return out


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(2)
    out = []
    for _ in range(400):
        known = draw.random() < 0.7
        out.append((draw.choice([0.0, 0.1, 0.25, 0.5, draw.random()]), draw.choice([1.0, 1.5, 2.0, 1 + 9 * draw.random()]), known, known and draw.random() < 0.8))
    return out + [(None, 2.0, True, False)]


def test_sweep_equals_loops(spark, rows):
    taus, rhos = [0.0, 0.1, 0.25, 0.3, 0.5, 0.9, 1.5], [1.0, 1.5, 1.75, 2.0, 99.0]
    cells = tuning.sweep(spark, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(t,) for t in taus], "tau double"), rhos)
    got = {(r["tau"], r["rho"]): tuple(r)[2:] for r in cells.collect()}
    want = brute(rows, taus, rhos)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert got[1.5, 1.0] == got[0.0, 99.0] == (0, 0, 0, 0.0, 0.0, 0.0, 0.0)  # nothing is accepted: rates are 0, not null


def test_sweep_plan_joins_by_equality_only(spark, rows):
    cells = tuning.sweep(spark, spark.createDataFrame(rows, SCHEMA))
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and cells.count() > 100


def test_sweep_needs_unknown_songs(spark):
    for own, why in (([(0.1, 2.0, True, True)], "unknown songs"), ([], "no rows")):
        with pytest.raises(ValueError, match=why):
            tuning.sweep(spark, spark.createDataFrame(own, SCHEMA))


def test_operating_points(spark):
    point = lambda cells, budget: tuple(tuning.operating_point(spark.createDataFrame(cells, "tau double, rho double, recall double, precision double, far double, f1 double"), budget).first())[:2]
    cells = [(0.1, 2.0, 0.9, 0.9, 0.2, 0.9), (0.0, 2.0, 0.5, 0.5, 0.2, 0.5), (0.0, 1.0, 0.4, 0.4, 0.2, 0.4), (0.0, 0.5, 1.0, 1.0, 0.3, 1.0)]
    assert point(cells, 0.01) == (0.0, 1.0)  # none is within the budget: the first of the least rate, whatever its recall
    assert point(cells, 0.2) == (0.1, 2.0) and point(cells, 0.3) == (0.0, 0.5) and point(cells, None) == (0.0, 0.5)
    tied = [(0.2, 1.0, 0.5, 0.5, 0.0, 0.5), (0.1, 2.0, 0.5, 0.5, 0.0, 0.5), (0.1, 1.0, 0.5, 0.4, 0.0, 0.5)]
    assert point(tied, 0.01) == (0.1, 2.0) and point(tied, None) == (0.1, 1.0)
    assert tuning.operating_point(spark.createDataFrame(cells, "tau double, rho double, recall double, precision double, far double, f1 double"), 0.01).first()["within_budget"] is False

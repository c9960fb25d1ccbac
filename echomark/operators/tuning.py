"""Threshold sweeps, operating points and frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .evaluation import quantiles

#: Margins that a sweep tries, and false-accept budgets of the summary table (fixed values).
RHO_GRID = (1.0, 1.1, 1.25, 1.5, 1.75, 2.0, 2.5, 3.0, 4.0, 5.0, 7.0, 10.0)
BUDGETS = (0.001, 0.005, 0.01, 0.02, 0.05, 0.10)
TAUS = 120


def development_rows(results: DataFrame, lo: float = 0.0, hi: float = float("inf")) -> DataFrame:
    """Rows within the SNR range; an error if one is not of the development split."""
    split = F.when(F.col("split") == "dev", F.col("split")).otherwise(F.raise_error(F.lit("tuning is for development rows only")))
    return results.withColumn("split", split).where(F.col("snr_db").between(lo, hi))


def require_holdout(rows: DataFrame) -> tuple[int, int]:
    """How many rows are of songs in the index and how many of unknown ones; an error if there are no rows or none of unknown songs, as no false-accept rate could be measured."""
    n, unknown = rows.agg(F.count("*"), F.count(F.when(~F.col("is_in_db"), 1))).first()
    if not n or not unknown:
        raise ValueError("no rows to tune on" if not n else "no rows of unknown songs")
    return n - unknown, unknown


def tau_grid(rows: DataFrame) -> DataFrame:
    """0 and TAUS quantiles of norm_score from 0 to 0.999, without repeats."""
    wanted = [(str(i), "hazen", 0.999 * i / (TAUS - 1)) for i in range(TAUS)]
    found = quantiles(rows.select(F.lit(1).alias("__all"), F.col("norm_score").cast("double").alias("v")), ["__all"], wanted)
    return found.select(F.col("q").alias("tau")).unionByName(rows.sparkSession.range(1).select(F.lit(0.0).alias("tau"))).distinct()


#: The least denominator of f1 (fixed value).
EPS = 2.220446049250313e-16


def sweep(spark: SparkSession, rows: DataFrame, taus: DataFrame | None = None, rhos=RHO_GRID) -> DataFrame:
    """(tau, rho, tp, n_accepted, n_false_accept, precision, recall, far, f1) of all threshold pairs; precision and f1 are 0 where nothing is accepted. Without rows of unknown songs it is an error.

    Rows are binned by the last grid point that each of their two scores reaches. A pair's counts are those of the bins at or above it on
    both axes, which two running sums over the grid give, one along each axis: the table is read once for the bins, and neither the rows nor
    the bins are joined with the grid but by equality.
    """
    n_in_db, n_holdout = require_holdout(rows)
    taus = tau_grid(rows) if taus is None else taus
    points = [sorted(r[0] for r in taus.distinct().collect()), sorted(float(r) for r in rhos)]  # the grid's axes, TAUS + 1 and a dozen
    ts, rs = (F.array(*map(F.lit, x)) for x in points)
    reached = lambda axis, score: F.size(F.filter(axis, lambda x: x <= F.col(score)))
    count = lambda c: F.count(F.when(c, 1))
    bins = rows.groupBy(reached(ts, "norm_score").alias("i"), reached(rs, "margin").alias("j")).agg(
        count(F.col("is_in_db") & F.col("correct")).alias("tp"), F.count("*").alias("n_accepted"), count(~F.col("is_in_db")).alias("n_false_accept")
    )
    grid = spark.range(1).select(F.posexplode(ts).alias("i", "tau")).select((F.col("i") + 1).alias("i"), "tau", F.posexplode(rs).alias("j", "rho")).withColumn("j", F.col("j") + 1)
    cells = grid.join(bins, ["i", "j"], "left").na.fill(0, ["tp", "n_accepted", "n_false_accept"])
    for own, along in (("i", "j"), ("j", "i")):
        above = Window.partitionBy(own).orderBy(F.col(along).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cells = cells.withColumns({c: F.sum(c).over(above) for c in ("tp", "n_accepted", "n_false_accept")})
    out = cells.select("tau", "rho", "tp", "n_accepted", "n_false_accept")
    out = out.withColumns({"precision": F.col("tp") / F.greatest("n_accepted", F.lit(1)), "recall": F.col("tp") / F.nullif(F.lit(n_in_db), F.lit(0)), "far": F.col("n_false_accept") / F.lit(n_holdout)})
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(EPS)))


def operating_point(cells: DataFrame, budget: float | None = 0.01) -> DataFrame:
    """The chosen cell: with a budget, the best recall (then precision, then lower thresholds) among false-accept rates within it; without, the best f1.

    If no cell is within the budget it is the first of the least rate, in order of tau and rho, and within_budget is false: this system cannot keep that rate.
    """
    if budget is None:
        return cells.orderBy(F.col("f1").desc_nulls_last(), "tau", "rho").limit(1)
    fits = F.col("far") <= budget
    inside = lambda c: F.when(fits, F.col(c)).desc_nulls_last()
    return cells.withColumn("within_budget", fits).orderBy(fits.desc(), F.when(~fits, F.col("far")), inside("recall"), inside("precision"), "tau", "rho").limit(1)


def budget_table(spark: SparkSession, cells: DataFrame, budgets=BUDGETS) -> DataFrame:
    """(budget, recall): the best recall within each false-accept budget."""
    b = spark.createDataFrame([(x,) for x in budgets], "budget double")
    return F.broadcast(b).join(cells, F.col("far") <= F.col("budget"), "left").groupBy("budget").agg(F.max("recall").alias("recall"))


def pareto(points: DataFrame, cost: str, benefit: str) -> DataFrame:
    """Points whose benefit exceeds that of all points of lower cost (of equal cost, of higher benefit)."""
    one = points.groupBy(cost).agg(F.max(benefit).alias(benefit))
    before = Window.orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    return one.withColumn("__top", F.max(benefit).over(before)).where(F.col("__top").isNull() | (F.col(benefit) > F.col("__top"))).drop("__top")

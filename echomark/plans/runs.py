"""Long runs in batches that are committed one by one, so that a run that stops goes on where it stopped."""

from __future__ import annotations

import subprocess
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.segments import exists

LEDGER = "batch long, lo long, hi long, n_rows long, size long, cfg_tag string, revision string, started double, elapsed_sec double"


def revision() -> str:
    """The short commit of the working folder's repository, or unknown: provenance is no reason to stop a run."""
    try:
        found = subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.SubprocessError):
        return "unknown"
    return found.stdout.strip() if found.returncode == 0 else "unknown"


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """A row for each committed batch: its range of the key, rows, configuration, revision, start and seconds."""
    if not exists(spark, f"{root}/ledger"):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{root}/ledger")


def results(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all committed batches; what a stopped batch wrote is not among them."""
    done = [r["batch"] for r in ledger(spark, root).select("batch").collect()]
    if not done:
        raise ValueError(f"no committed batch below {root}")
    return spark.read.option("basePath", f"{root}/rows").parquet(*(f"{root}/rows/batch={k}" for k in done)).drop("batch")


def run_batches(work: DataFrame, key: str, size: int, compute: Callable[[DataFrame], DataFrame], root: str, cfg_tag: str, rev: str | None = None, most: int | None = None) -> int:
    """Computes the rows of work batch by batch, and returns how many batches were computed now; run again with the same root it computes only those that are missing.

    A batch is a range of `size` values of the integer key. Its rows are written first and its ledger row last, which commits it; the count of rows
    comes from the same pass. A ledger of another configuration, revision or batch size is an error, as its rows would not belong together. most bounds
    the batches of this call.
    """
    spark, root = work.sparkSession, root.rstrip("/")
    rev = revision() if rev is None else rev
    lo, hi = work.agg(F.min(key), F.max(key)).first()
    if lo is None:
        raise ValueError("no work")
    known = ledger(spark, root).select("batch", "size", "cfg_tag", "revision").collect()  # one row for each batch
    for r in known:
        if (r["size"], r["cfg_tag"], r["revision"]) != (size, cfg_tag, rev):
            raise ValueError(f"the run below {root} has {r['cfg_tag']} at {r['revision']} in batches of {r['size']}, not {cfg_tag} at {rev} in batches of {size}")
    todo = [k for k in range(lo // size, hi // size + 1) if k not in {r["batch"] for r in known}]
    for k in todo[:most]:
        began, seen = time.time(), Observation(f"batch {k}")
        own = compute(work.where(F.col(key).between(k * size, (k + 1) * size - 1)))
        own.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{root}/rows/batch={k}")
        row = (k, k * size, (k + 1) * size - 1, int(seen.get["n"]), size, cfg_tag, rev, began, time.time() - began)
        spark.createDataFrame([row], LEDGER).coalesce(1).write.mode("append").parquet(f"{root}/ledger")
    return len(todo[:most])

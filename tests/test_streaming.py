"""Stateful identification of a stream against the batch plan."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echomark.operators import landmarks, matching
from echomark.plans.config import Match
from echomark.streaming import stateful

COLUMNS = ["query_id", "n_hashes", "pred1", "score1", "best_delta", "pred2", "score2", "n_postings", "n_candidates", "norm_score", "margin", "accepted"]


@pytest.fixture(scope="module")
def tables(spark):
    """Queries that match a song, several songs alike, none, and one whose hashes are all unknown."""
    draw = random.Random(5)
    postings = [(draw.randrange(60), draw.randrange(1, 30), draw.randrange(0, 25)) for _ in range(500)]
    asked = []
    for q in range(1, 13):
        song = draw.randrange(1, 30)
        asked += [(q, h, t - 3) for h, s, t in postings if s == song or (s == song + 1 and q % 3 == 0)]
        asked += [(q, draw.randrange(90), draw.randrange(0, 20)) for _ in range(draw.randrange(0, 12))]
    asked += [(50, 1000 + k, k) for k in range(5)] + [(51, postings[0][0], 4)]
    return spark.createDataFrame(postings, "h long, song_id int, t1 int"), spark.createDataFrame(asked, "query_id long, h long, t1 int")


def decisions(df):
    return {r["query_id"]: tuple(r[c] if not isinstance(r[c], float) else round(r[c], 9) for c in COLUMNS) for r in df.collect()}


@pytest.mark.parametrize("cfg", [Match(), Match(top_k=2, offset_tol=0), Match(top_k=3, offset_tol=3, tau=0.3, rho=2.0)])
def test_histograms_decide_as_the_plan(tables, cfg):
    postings, asked = tables
    want = decisions(matching.identify(asked.select("query_id").distinct(), asked, postings, cfg))
    hits = matching.lookup(asked, postings).toPandas()
    n = asked.groupBy("query_id").count().toPandas().set_index("query_id")["count"]
    for q in want:
        own = hits[hits["query_id"] == q]
        half = len(own) // 2
        h = stateful.Histogram(*(own[c].to_numpy(np.int64)[:half] for c in ("song_id", "delta")), np.ones(half, np.int64))
        rest = len(own) - half
        h = stateful.Histogram(*(np.concatenate([x, own[c].to_numpy(np.int64)[half:]]) for x, c in ((h.songs, "song_id"), (h.deltas, "delta"))), np.concatenate([h.counts, np.ones(rest, np.int64)]))
        got = dict(zip(COLUMNS, h.decision(q, int(n[q]), cfg, False), strict=False))
        assert tuple(round(x, 9) if isinstance(x, float) else x for x in got.values()) == want[q]


def test_a_stream_cut_at_random_decides_as_the_plan(spark, tables, tmp_path):
    """Five batches, a restart from the checkpoint after the second, early decisions, and a row that comes too late."""
    postings, asked = tables
    cfg = Match(top_k=5, tau=0.3, rho=1.5)
    lists = landmarks.list_index(postings)
    at = f"file://{tmp_path}"
    lists.write.parquet(f"{at}/lists")
    rows = asked.select(F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("t1") * 100).alias("ts"), "query_id", "h", "t1").withColumn("batch", F.floor(F.rand(3) * 3))
    rows.write.parquet(f"{at}/cut")
    rows = spark.read.parquet(f"{at}/cut")
    nobody = [F.lit(None).cast(t).alias(c) for c, t in rows.select("query_id", "h", "t1").dtypes]

    def put(k, df):
        df.coalesce(1).write.parquet(f"{at}/in/batch={k}")

    def run():
        stream = spark.readStream.schema(rows.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in/batch=*")
        found = stateful.identify_stream(stream, spark.read.parquet(f"{at}/lists"), cfg, gap_seconds=5, early_hashes=6)
        stateful.write_stream(found, f"{at}/out", f"{at}/checkpoint").awaitTermination(200)

    for k in range(2):
        put(k, rows.where(f"batch = {k}").drop("batch"))
    run()
    silent = spark.createDataFrame([(99,)], "query_id long").select(F.timestamp_millis(F.lit(1_700_000_000_000)).alias("ts"), "query_id", *nobody[1:])
    put(2, rows.where("batch = 2").drop("batch").unionByName(silent))
    for k in (3, 4):
        put(k, spark.range(1).select(F.timestamp_millis(F.lit(1_700_000_600_000 + k * 1000)).alias("ts"), *nobody))
    put(5, rows.drop("batch").limit(1))
    run()
    got = spark.read.parquet(f"{at}/out")
    known = asked.select("query_id").unionByName(silent.select("query_id")).distinct()
    want = decisions(matching.identify(known, asked, postings, cfg))
    final = got.where("not early")
    assert final.count() == len(want) and decisions(final) == want
    early = got.where("early").collect()
    assert early and len({r["query_id"] for r in early}) == len(early) and all(r["accepted"] and r["n_hashes"] >= 6 for r in early)

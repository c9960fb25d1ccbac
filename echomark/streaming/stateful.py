"""Identification of a stream whose queries arrive in pieces: a histogram of offsets is kept for each query until its time is over."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..plans.config import Match

DECISION = "query_id long, n_hashes long, pred1 int, score1 long, best_delta int, pred2 int, score2 long, n_postings long, n_candidates long, norm_score double, margin double, accepted boolean, early boolean"
STATE = "songs binary, deltas binary, counts binary, n_hashes long, due long, decided boolean"
#: The store that timers and state variables need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Histogram:
    """Counts by song and offset, as three arrays in order of both."""

    def __init__(self, songs: np.ndarray, deltas: np.ndarray, counts: np.ndarray):
        order = np.lexsort((deltas, songs))
        songs, deltas, counts = songs[order], deltas[order], counts[order]
        new = np.ones(len(songs), bool)
        new[1:] = (songs[1:] != songs[:-1]) | (deltas[1:] != deltas[:-1])
        first = np.flatnonzero(new)
        self.songs, self.deltas = songs[first], deltas[first]
        self.counts = np.add.reduceat(counts, first) if len(first) else counts

    def decision(self, query_id: int, n_hashes: int, cfg: Match, early: bool) -> tuple:
        """The row that matching.identify() gives for the query: the top_k songs by their largest count, smoothed over 2 tol + 1 offsets within the query's range."""
        best = []
        edges = np.append(np.flatnonzero(np.diff(self.songs, prepend=self.songs[:1] - 1)), len(self.songs)) if len(self.songs) else np.zeros(1, np.int64)
        raw = np.maximum.reduceat(self.counts, edges[:-1]) if len(edges) > 1 else np.zeros(0, np.int64)
        ids = self.songs[edges[:-1]]
        for k in np.lexsort((ids, -raw))[: cfg.top_k].tolist():
            d, n = self.deltas[edges[k] : edges[k + 1]], self.counts[edges[k] : edges[k + 1]]
            near = (d[:, None] + np.arange(-cfg.offset_tol, cfg.offset_tol + 1)).reshape(-1)
            inside = (near >= self.deltas.min()) & (near <= self.deltas.max())
            at, where = np.unique(near[inside], return_inverse=True)
            score = np.bincount(where, np.repeat(n, 2 * cfg.offset_tol + 1)[inside]).astype(np.int64)
            top = int(score.argmax())
            best.append((-int(score[top]), int(ids[k]), int(at[top])))
        best.sort()
        one, two = ([*best, (0, 0, None), (0, 0, None)])[:2]
        norm, margin = -one[0] / max(n_hashes, 1), -one[0] / max(-two[0], 1)
        return query_id, n_hashes, one[1], -one[0], one[2], two[1], -two[0], int(self.counts.sum()), len(ids), norm, margin, norm >= cfg.tau and margin >= cfg.rho, early


class Voting(StatefulProcessor):
    """Adds what arrives to a query's histogram; decides when no row of it can come any more, and once before that if asked to."""

    def __init__(self, cfg: Match, gap_ms: int, early_hashes: int | None):
        self.cfg, self.gap, self.early = cfg, gap_ms, early_hashes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("histogram", STATE)

    def _load(self) -> tuple[Histogram, int, int, bool]:
        held = self.state.get()
        if held is None:
            return Histogram(*(np.zeros(0, np.int64),) * 3), 0, 0, False
        songs, deltas, counts, n, due, decided = held
        return Histogram(*(np.frombuffer(bytes(x), np.int64) for x in (songs, deltas, counts))), n, due, decided

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None or key[0] != key[0]:
            for _ in rows:
                pass
            return
        h, n, due, decided = self._load()
        songs, deltas, last = [h.songs], [h.deltas], due - self.gap
        for b in rows:
            last = max(last, int(b["ms"].max()))
            b = b[b["h"].notna()]
            n += len(b)
            for tq, found in zip(b["t1"], b["postings"], strict=True):
                if found is not None and len(found):
                    songs.append(np.array([x["song_id"] for x in found], np.int64))
                    deltas.append(np.array([x["t1"] - tq for x in found], np.int64))
        new = sum(map(len, songs)) - len(h.songs)
        h = Histogram(np.concatenate(songs), np.concatenate(deltas), np.concatenate([h.counts, np.ones(new, np.int64)]))
        if last + self.gap != due:
            if due:
                self.handle.deleteTimer(due)
            due = last + self.gap
            self.handle.registerTimer(due)
        if self.early is not None and not decided and n >= self.early:
            row = h.decision(int(key[0]), n, self.cfg, True)
            decided = bool(row[11])
            if decided:
                yield _frame([row])
        self.state.update((h.songs.tobytes(), h.deltas.tobytes(), h.counts.tobytes(), n, due, decided))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        h, n, _, _ = self._load()
        self.state.clear()
        yield _frame([h.decision(int(key[0]), n, self.cfg, False)])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in DECISION.split(", ")]).astype({"best_delta": "Int32"})


def identify_stream(stream: DataFrame, lists: DataFrame, cfg: Match, late: str = "1 minute", gap_seconds: float = 30.0, early_hashes: int | None = None) -> DataFrame:
    """One decision for each query of a stream (ts, query_id, h, t1) against the list layout (h, postings), the row that matching.identify() gives for all its hashes, however they were cut into batches.

    A query is decided once the watermark (the latest ts less `late`) has passed its own last row by gap_seconds. With
    early_hashes a row with early = true comes as soon as that many hashes accept a song, once at most, before the final row. Rows
    without a query only move the watermark on, which counts from the next batch; a row without a hash makes its query known, which is decided even if no hash
    comes; rows that come after the watermark are dropped, as their query may have been decided.
    State is one histogram for each open query; the session must use the RocksDB state store.
    """
    # rows without a query are left to the processor: a filter here would go below the watermark, which they are to move
    rows = stream.withWatermark("ts", late).join(lists, "h", "left")
    rows = rows.select(F.col("query_id").cast("long").alias("query_id"), "ts", F.unix_millis("ts").alias("ms"), "h", "t1", "postings")
    return rows.groupBy("query_id").transformWithStateInPandas(
        statefulProcessor=Voting(cfg, int(gap_seconds * 1000), early_hashes), outputStructType=DECISION, outputMode="Append", timeMode="EventTime"
    )


def write_stream(decisions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends decisions to Parquet files below path until the source has no more rows; started again with its checkpoint it goes on where it stopped."""
    decisions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return decisions.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Substring dedup by MinHash banding of paragraphs, with the sentences and pieces of sentences inside them compared for equality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cells import classes_of_buckets, links_in_cell
from .common import LOWER, Cut, Sets, bands_for, mix, overlap, sequence_hashes, shingle_hashes, sliced, span_hashes, word_bounds

#: Words of a shingle, and samples in a band.
WIDTH, ROWS = 5, 3
#: Probability that a pair at the threshold meets in no band.
MISS = 1e-3
#: Words from which a repeated paragraph, or run of repeated sentences, is removed.
LEAST_WORDS = 20
#: Words from which a sentence is cut into pieces, and words to either side of which a cut has the least hash.
PIECE, REACH = 16, 4
#: Members of an unsettled bucket that are compared as one block.
BLOCK = 512
#: Bytes that end a sentence, and those that may follow such an end.
STOPS, CLOSERS = np.frombuffer(b".!?", np.uint8), np.frombuffer(b"\"')]}", np.uint8)


def content_cuts(words: np.ndarray, par: np.ndarray) -> np.ndarray:
    """Words at which the hash of a word and the next is less than at all words within REACH of the same paragraph: wherever a passage stands, its inner cuts are the same."""
    top = np.uint64((1 << 64) - 1)
    pair = np.full(len(words), top)
    same = par[1:] == par[:-1]
    pair[:-1][same] = mix(words[:-1] ^ mix(words[1:] + np.uint64(1)))[same]
    least = np.full(len(words), top)
    for d in range(1, REACH + 1):
        near = par[d:] == par[:-d]
        least[d:] = np.minimum(least[d:], np.where(near, pair[:-d], top))
        least[:-d] = np.minimum(least[:-d], np.where(near, pair[d:], top))
    return pair < least


def unit_bounds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every word: its text, and whether it opens a paragraph (text between line breaks), and a sentence (up to a word that ends with . ! or ?, closing quotes and brackets aside) or a piece of one of more than PIECE words."""
    n = len(starts)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    line = breaks[starts]
    new_paragraph = np.ones(n, bool)
    new_paragraph[1:] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])
    if not n:
        return doc, new_paragraph, new_paragraph.copy()
    last = ends - 1
    for _ in range(2):
        last = np.where(np.isin(data[last], CLOSERS), np.maximum(last - 1, starts), last)
    new_sentence = new_paragraph.copy()
    new_sentence[1:] |= np.isin(data[last], STOPS)[:-1]
    own = np.cumsum(new_sentence) - 1
    new_sentence |= content_cuts(words, np.cumsum(new_paragraph)) & (np.bincount(own)[own] > PIECE)
    return doc, new_paragraph, new_sentence


class Units:
    """Paragraphs, and sentences or their pieces, as ranges of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = LOWER[data]
        starts, ends, bounds = word_bounds(data, offsets)
        with np.errstate(over="ignore"):
            self.words = span_hashes(data, starts, ends)
            doc, p, s = unit_bounds(data, starts, ends, bounds, self.words)
            n = len(starts)
            self.p_lo, self.s_lo = np.flatnonzero(p), np.flatnonzero(s)
            self.p_hi, self.s_hi = np.append(self.p_lo[1:], n)[: len(self.p_lo)], np.append(self.s_lo[1:], n)[: len(self.s_lo)]
            self.p_hash, self.s_hash = sequence_hashes(self.words, self.p_lo, self.p_hi), sequence_hashes(self.words, self.s_lo, self.s_hi)
        first = np.searchsorted(self.p_lo, bounds[:-1])
        self.p_doc = doc[self.p_lo]
        self.p_number = np.arange(len(self.p_lo)) - first[self.p_doc]
        self.s_par = np.cumsum(p)[self.s_lo] - 1
        self.s_unit = np.arange(len(self.s_lo)) - np.searchsorted(self.s_lo, bounds[:-1])[doc[self.s_lo]]
        self.s_number = np.arange(len(self.s_lo)) - np.searchsorted(self.s_lo, self.p_lo)[self.s_par]


UNIT = "par int, sent int, unit int, words int, h long"


def units(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, par, sent, unit, words, h) of all paragraphs (sent and unit -1) and of all sentences; unit numbers the sentences of a document through its paragraphs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in sliced(batches, text):
            u = Units(data, offsets)
            doc, none = np.concatenate([u.p_doc, u.p_doc[u.s_par]]), np.full(len(u.p_lo), -1)
            columns = (
                np.concatenate([u.p_number, u.p_number[u.s_par]]),
                np.concatenate([none, u.s_number]),
                np.concatenate([none, u.s_unit]),
                np.concatenate([u.p_hi - u.p_lo, u.s_hi - u.s_lo]),
            )
            yield pa.RecordBatch.from_arrays([part.column(doc_id).take(pa.array(doc)), *(pa.array(x.astype(np.int32)) for x in columns), pa.array(np.concatenate([u.p_hash, u.s_hash]))], names=["id", "par", "sent", "unit", "words", "h"])

    kind = docs.select(F.col(doc_id).alias("id")).schema["id"].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"id {kind}, {UNIT}")


def bucket_members(docs: DataFrame, text: str, sets: Sets, least_words: int) -> DataFrame:
    """(key, id) of the paragraphs of least_words words or more: a row for each band, id being the hash of the paragraph's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in sliced(batches, text):
            u = Units(data, offsets)
            long_ = np.flatnonzero(u.p_hi - u.p_lo >= least_words)
            h, at = np.unique(u.p_hash[long_], return_index=True)
            own = long_[at]
            if len(own):
                with np.errstate(over="ignore"):
                    keys = sets.keys(paragraph_samples(u.words, u.p_lo[own], u.p_hi[own], sets)).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(h, sets.bands))], names=["key", "id"])

    return docs.select(text).mapInArrow(run, "key long, id long")


def paragraph_samples(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, sets: Sets) -> np.ndarray:
    """MinHash samples of paragraphs of WIDTH words or more."""
    sizes = hi - lo - WIDTH + 1
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at = np.arange(sizes.sum()) - np.repeat(first, sizes) + np.repeat(lo, sizes)
    x = np.zeros(len(at), np.uint64)
    for j in range(WIDTH):
        x = mix(x ^ words[at + j])
    return np.stack([np.minimum.reduceat((x * a + b) >> np.uint64(24), first) for a, b in zip(sets.a, sets.b, strict=True)], axis=1)


def shingle_sets(ids: DataFrame, places: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, shingles) of the paragraphs of such hashes, from whole texts. places has (h, id, par): a document that holds the paragraph, and its number.

    Of rows that share an id each is looked at; the paragraph is taken from those that hold it there.
    """
    wanted = ids.select(F.col("id").alias("h")).join(places, "h").groupBy("id").agg(F.collect_list(F.struct("par", "h")).alias("wanted"))
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(wanted, "id")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in sliced(batches, "text"):
            u = Units(data, offsets)
            first = np.searchsorted(u.p_doc, np.arange(part.num_rows + 1))
            h, out = [], []
            for i, want in enumerate(part.column("wanted").to_pylist()):
                for w in want:
                    k = first[i] + w["par"]
                    if k >= first[i + 1] or u.p_hash[k] != w["h"]:
                        continue
                    with np.errstate(over="ignore"):
                        out.append(shingle_hashes(u.words[u.p_lo[k] : u.p_hi[k]], np.array([0, u.p_hi[k] - u.p_lo[k]]), WIDTH)[0].tobytes())
                    h.append(w["h"])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(out, pa.binary())], names=["id", "shingles"])

    return own.select("id", "text", "wanted").mapInArrow(pick, "id long, shingles binary").dropDuplicates(["id"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose shingle sets (id, shingles) have 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = overlap(x, y)
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(judge, "a long, b long")


def linked_sets(percent: int):
    """Links among the sets of a cell."""

    def run(table: pa.Table, part: np.ndarray, comps: list, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
        return links_in_cell([np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()], part, comps, p, q, percent)

    return run


def clusters(spark: SparkSession, docs: DataFrame, percent: int = 80, least_words: int = LEAST_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, paragraph, sentence, n_words, cluster_id, n_members, kept) of every repeated passage: all members of its cluster, of which the first in order of (doc_id, paragraph, sentence) is kept and the others are removals.

    Paragraphs of least_words words or more are repeated if equal, or if a chain of pairs with at least `percent` of their
    five-word shingles in common connects them: of pairs that meet in a band none is lost, and MISS is the probability that a pair at the threshold meets in none.
    In other paragraphs, shorter ones included, a sentence (or a line without an end of one, or a piece of a long sentence between cuts that its own words set) is repeated if
    it is equal to another one, and is listed if the run of repeated ones that it stands in, which goes on over line breaks, has least_words words; sentence is its number in the
    paragraph, and null for whole paragraphs.
    A-Z are lower-cased and white space is equal. Null and empty texts have no paragraphs; a row with a null id is
    left out; repeated rows repeat their paragraphs, which makes them members of a cluster, and rows that share an id are one document of all their paragraphs; an empty table gives an empty one; texts of any length are taken
    whole, in memory in proportion to the longest; other columns are ignored.
    """
    cut = Cut(spark)
    docs = docs.select(doc_id, text).where(F.col(doc_id).isNotNull())
    sets = Sets(bands_for(percent / 100, MISS, ROWS), ROWS)
    all_ = cut.table(units(docs, doc_id, text))
    kind = F.col("sent") >= 0
    groups = cut.table(all_.groupBy("h", kind.alias("s")).agg(F.count("*").alias("n"), F.min(F.struct("id", "par", "sent")).alias("first")).where((F.col("n") > 1) | ~F.col("s")))
    places = groups.where("not s").select("h", "first.id", "first.par")
    members = cut.table(bucket_members(docs, text, sets, max(least_words, WIDTH)))
    held: dict[str, DataFrame] = {}

    def confirmed(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        held["sets"] = cut.table(shingle_sets(ids, places, docs, doc_id, text))
        return verified(pairs, held["sets"], percent)

    near = classes_of_buckets(spark, members, confirmed, lambda ids: held["sets"], linked_sets(percent), BLOCK)
    grouped = groups.join(near.select(F.col("node").alias("h"), "component"), "h", "left").withColumn("component", F.when(F.col("s"), F.col("h")).otherwise(F.coalesce("component", "h")))
    whole = grouped.groupBy("component", "s").agg(F.sum("n").alias("members"), F.min("first").alias("head")).where("members > 1")
    named = cut.table(grouped.join(whole, ["component", "s"]).select("h", "s", "members", "head"))
    rows = all_.join(named.select(F.col("h").alias("k"), "s", "members", "head"), (F.col("h") == F.col("k")) & (kind == F.col("s"))).drop("k", "h")
    # dealt by document once, for all windows below; runs are found before sentences of repeated paragraphs are left out, which therefore do not break them
    rows = rows.repartition("id")
    line = Window.partitionBy("id", "s").orderBy("unit")
    # repeated rows of a document do not lengthen its runs
    once = F.when(F.lag("unit").over(line).eqNullSafe(F.col("unit")), 0).otherwise(F.col("words"))
    rows = rows.withColumns({"island": F.col("unit") - F.dense_rank().over(line), "once": once})
    rows = rows.withColumn("run", F.sum("once").over(Window.partitionBy("id", "s", "island")))
    rows = rows.withColumn("whole", F.max(F.when((F.col("sent") < 0) & (F.col("words") >= least_words), 1).otherwise(0)).over(Window.partitionBy("id", "par")))
    rows = rows.where(((F.col("sent") < 0) & (F.col("words") >= least_words)) | ((F.col("sent") >= 0) & (F.col("whole") == 0) & (F.col("run") >= least_words)))
    return rows.select(
        F.col("id").alias(doc_id),
        F.col("par").alias("paragraph"),
        F.when(F.col("sent") >= 0, F.col("sent")).alias("sentence"),
        F.col("words").alias("n_words"),
        F.concat_ws("/", "head.id", "head.par", F.when(F.col("s"), F.col("head.sent"))).alias("cluster_id"),
        F.col("members").alias("n_members"),
        F.struct("id", "par", "sent").eqNullSafe(F.col("head")).alias("kept"),
    )

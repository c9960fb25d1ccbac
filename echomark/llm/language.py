"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, slices, texts

#: Bits of a vector: each stands for +1 (clear) or -1 (set).
BITS = 1024
#: Letters of an n-gram.
GRAM = 3
#: Bytes of text whose n-grams are looked up together, and counts of n-grams by text and vectors of n-grams that are held at a time.
TEXT_BYTES = 192 << 10
CELLS = 1 << 22
VECTORS = 1 << 13


@cache
def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def letter_bits(code_points: np.ndarray, turn: int) -> np.ndarray:
    """Packed random vectors of letters, drawn from their code points, turned by so many places."""
    words = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    packed = mix(mix(code_points.astype(np.uint64)[:, None] + np.uint64(1)) ^ words).view(np.uint8)
    return np.packbits(np.roll(np.unpackbits(packed, axis=1), turn, axis=1), axis=1)


def grams_of(docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each place of an n-gram its text and its number among the distinct n-grams; these, packed by the letters found; the letters; and which texts have a letter.

    Text is lower-cased; what is not a letter separates words. An n-gram has a letter in its middle and a
    letter or a word's edge on either side; its vector binds its letters' vectors, each turned by its place.
    """
    joined = "\0".join(x.replace("\0", " ").lower() for x in docs) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    doc = np.cumsum(points == 0) - (points == 0)
    points = np.where(letters()[points], points, 0).astype(np.int64)
    found = np.unique(points[points > 0]) if len(points) < 4096 else np.flatnonzero(np.bincount(points))
    found = np.concatenate([[0], found[found > 0]])
    table = np.zeros(int(found[-1]) + 1, np.int64)
    table[found] = np.arange(len(found))
    small = table[points]
    middle = np.flatnonzero(small)
    has = np.zeros(len(docs), bool)
    has[doc[middle]] = True
    n = len(found)
    left, right = np.where(middle > 0, small[middle - 1], 0), small[middle + 1]
    code = (left * n + small[middle]) * n + right
    if n**3 <= 1 << 22:
        grams = np.flatnonzero(np.bincount(code, minlength=1))
        place = np.zeros(n**3, np.int64)
        place[grams] = np.arange(len(grams))
        inverse = place[code]
    else:
        grams, inverse = np.unique(code, return_inverse=True)
    return doc[middle], inverse, grams, found, has


def counts_of(n_docs: int, doc: np.ndarray, inverse: np.ndarray, n_grams: int) -> np.ndarray:
    return np.bincount(doc * n_grams + inverse, minlength=n_docs * n_grams).astype(np.float32).reshape(n_docs, n_grams)


def vectors_of(grams: np.ndarray, found: np.ndarray) -> np.ndarray:
    n = len(found)
    bits = letter_bits(found, 2)[grams // (n * n)] ^ letter_bits(found, 1)[grams // n % n] ^ letter_bits(found, 0)[grams % n]
    return 1 - 2 * np.unpackbits(bits, axis=1).astype(np.float32)


def profiles(docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of n-grams by text, the n-grams' vectors, and which texts have a letter."""
    doc, inverse, grams, found, has = grams_of(docs)
    return counts_of(len(docs), doc, inverse, len(grams)), vectors_of(grams, found), has


def bundles(docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bundle of each text's n-gram vectors, and which texts have a letter.

    Texts are halved until counts by text and n-gram fit CELLS, and vectors are made for VECTORS n-grams at a time, so that neither many short texts nor one
    of many n-grams takes more memory.
    """
    doc, inverse, grams, found, has = grams_of(docs)
    if len(docs) > 1 and len(docs) * len(grams) > CELLS:
        half = len(docs) // 2
        left, right = bundles(docs[:half]), bundles(docs[half:])
        return np.concatenate([left[0], right[0]]), np.concatenate([left[1], right[1]])
    counts, out = counts_of(len(docs), doc, inverse, len(grams)), np.zeros((len(docs), BITS))
    for lo in range(0, len(grams), VECTORS):
        out += counts[:, lo : lo + VECTORS] @ vectors_of(grams[lo : lo + VECTORS], found)
    return out, has


def text_parts(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    data, offsets = texts(batch.column(text))
    for lo, hi in slices(offsets, TEXT_BYTES):
        yield batch.slice(lo, hi - lo), [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in range(lo, hi)]


def learn(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, prototype array<double>): the bundle of all n-gram vectors of a language's texts.

    Each task adds up the texts of a language before anything is shuffled, so a language that holds most rows
    sends one vector per task. Rows with null lang or text add nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, own in text_parts(batch, text):
                names = part.column(lang).to_pylist()
                found, _ = bundles(own)
                for name in set(names):
                    sums[name] = sums.get(name, 0) + found[[x == name for x in names]].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([list(x) for x in sums.values()], pa.list_(pa.float64()))], names=["lang", "part"])

    parts = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias(lang), text).mapInArrow(run, "lang string, part array<double>")
    sums = parts.select("lang", F.posexplode("part").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    return sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("rows")).select("lang", F.col("rows.x").alias("prototype"))


def predict(docs: DataFrame, prototypes: dict[str, list[float]], keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with lang_pred and score.

    prototypes has one vector per language, so its size is the number of languages times BITS.
    score is (1 + cosine) / 2 with the best language's prototype; a text that is null or has no letter is `und`
    with score 0; of equal cosines the first language in order is taken.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[x] for x in names], np.float64).reshape(len(names), BITS)
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in text_parts(batch, text):
                found, has = bundles(own)
                norm = np.linalg.norm(found, axis=1)
                has &= (norm > 0) & bool(names)
                if names:
                    cosines = (found @ matrix.T) / np.maximum(norm, 1e-300)[:, None]
                    best = cosines.argmax(axis=1)
                    score = np.where(has, np.clip((1 + cosines[np.arange(len(own)), best]) / 2, 0, 1), 0.0)
                else:
                    best, score = np.zeros(len(own), int), np.zeros(len(own))
                pred = [names[k] if ok else "und" for k, ok in zip(best.tolist(), has.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(score)], names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def identify(docs: DataFrame, learned: Column, keep: list[str], lang: str = "lang", text: str = "text") -> DataFrame:
    """predict() for all rows after learn() on those where `learned` is true.

    An empty table gives an empty one; without any labelled text all are `und`. Repeated rows count in learning and are predicted each; a text of any length is
    taken whole; bytes that are not UTF-8 are no letters; columns that are not kept are ignored, whatever their names.
    """
    found = {r["lang"]: r["prototype"] for r in learn(docs.where(learned), lang, text).collect()}
    return predict(docs, found, keep, text)

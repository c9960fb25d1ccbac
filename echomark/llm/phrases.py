"""Collocations: phrases counted without loss in counting quotient filters of permuted, packed word ids, merged across shards."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, Cut, mix, sliced

#: What ends a piece, and what only separates its words.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
GAP = BREAK.copy()
GAP[[*b" \t"]] = True

#: Bytes of text in a shard, unless a single text is longer.
SHARD_BYTES = 5 << 20
#: Occurrences of phrases that one part of the key space counts.
PART_KEYS = 1 << 21
#: Rows and bytes of words that a join broadcasts at most, after counting both; more are shuffled.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
#: Bits of a key by which shards deal their filters; where there are more parts, groups of shards are merged first.
FIRST_BITS = 10
_ROUNDS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


# ---------------------------------------------------------------- permuted keys


def u64(x: int) -> np.uint64:
    return np.uint64(x)


class Packing:
    """Triples of ids of `bits` bits (the third 0 in pairs) as one key of 3 * bits bits, and a permutation of all such keys.

    A key is held as an upper part of `upper` and a lower part of `lower` bits. Each round of the Feistel network puts a mix of one
    part into the other; undone in reverse order, it gives the ids back, so that a key is the phrase and not a hash of it.
    """

    def __init__(self, bits: int):
        if not 1 <= bits <= 42:
            raise ValueError(f"ids of {bits} bits do not fit; 1 to 42 do")
        self.bits = bits
        whole = 8 * -(-3 * bits // 16)  # whole bytes, so that remainders waste no bits
        self.lower = whole if whole <= min(2 * bits, 64) else -(-3 * bits // 2)
        self.upper = 3 * bits - self.lower

    def _round(self, x: np.ndarray, k: int, width: int) -> np.ndarray:
        return mix(x + _ROUNDS[k]) >> u64(64 - width)

    def permuted(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower parts of the permuted keys of id triples."""
        n, h = self.bits, self.lower
        low = c | (b << u64(n))
        if h < 64:
            low &= u64((1 << h) - 1)
        high = (a << u64(2 * n - h)) | (b >> u64(h - n))
        with np.errstate(over="ignore"):
            for k in (0, 2):
                high = high ^ self._round(low, k, self.upper)
                low = low ^ self._round(high, k + 1, h)
        return high, low

    def ids(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id triples of permuted keys."""
        n, h = self.bits, self.lower
        with np.errstate(over="ignore"):
            for k in (2, 0):
                low = low ^ self._round(high, k + 1, h)
                high = high ^ self._round(low, k, self.upper)
        one = u64((1 << n) - 1)
        rest = low >> u64(n) if n < 64 else np.zeros_like(low)
        return high >> u64(2 * n - h), (rest | ((high & u64((1 << (2 * n - h)) - 1)) << u64(h - n))) & one, low & one


def counted(high: np.ndarray, low: np.ndarray, counts: np.ndarray | None, packing: Packing) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts added up. The stable sort merges runs that are sorted already."""
    if not len(high):
        return high, low, np.zeros(0, np.int64)
    if packing.upper + packing.lower <= 64:
        key = (high << u64(packing.lower)) | low if packing.lower < 64 else low
        if counts is None:
            key = np.sort(key)
        else:
            order = np.argsort(key, kind="stable")
            key, counts = key[order], counts[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        high = key[new] >> u64(packing.lower) if packing.lower < 64 else np.zeros(len(new), np.uint64)
        low = key[new] & u64((1 << packing.lower) - 1)
    else:
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        counts = None if counts is None else counts[order]
        new = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
        n, high, low = len(high), high[new], low[new]
        return high, low, np.diff(np.append(new, n)) if counts is None else np.add.reduceat(counts, new)
    return high, low, np.diff(np.append(new, len(key))) if counts is None else np.add.reduceat(counts, new)


# ---------------------------------------------------------------- filters


def planes(x: np.ndarray, width: int) -> bytes:
    """The lowest bytes of 64-bit values, one plane for each."""
    return np.ascontiguousarray(np.ascontiguousarray(x).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(raw: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T
    return out.view("<u8").reshape(-1).astype(np.uint64)


def filter_of(high: np.ndarray, low: np.ndarray, counts: np.ndarray, packing: Packing, prefix: int) -> bytes:
    """A counting quotient filter of sorted distinct keys that agree in their first `prefix` bits.

    The quotient, the bits after the prefix, is not written: a bit vector has a 1 for each key, and a 0 where the next quotient begins. The remainder is
    written in full, and so is each count: one bit says whether it is 1, the others follow.
    """
    n, width = len(high), packing.upper - prefix
    rest = min(range(width // 8 + 1), key=lambda j: n * j + (n + (1 << (width - 8 * j))) // 8)
    q = width - 8 * rest
    own = high & u64((1 << width) - 1)
    bits = np.zeros(n + (1 << q), bool)
    bits[(own >> u64(8 * rest)).astype(np.int64) + np.arange(n)] = True
    more = counts > 1
    large = counts[more].astype(np.uint64)
    size = max(1, -(-int(large.max()).bit_length() // 8)) if len(large) else 1
    head = np.array([n, len(large), q, rest, size], "<i8").tobytes()
    return b"".join([head, np.packbits(bits).tobytes(), planes(own, rest), planes(low, -(-packing.lower // 8)), np.packbits(more).tobytes(), planes(large, size)])


def keys_of(raw: bytes, packing: Packing, prefix: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys and counts of a filter whose prefix is `first`."""
    n, n_large, q, rest, size = np.frombuffer(raw, "<i8", 5).tolist()
    view, at = memoryview(raw), 40

    def take(k: int) -> memoryview:
        nonlocal at
        at += k
        return view[at - k : at]

    length = n + (1 << q)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(take(-(-length // 8)), np.uint8), count=length))
    quotient = (ones - np.arange(n)).astype(np.uint64)
    high = (quotient << u64(8 * rest)) | from_planes(take(n * rest), n, rest) | u64(first << (packing.upper - prefix))
    width = -(-packing.lower // 8)
    low = from_planes(take(n * width), n, width)
    more = np.unpackbits(np.frombuffer(take(-(-n // 8)), np.uint8), count=n).astype(bool)
    counts = np.ones(n, np.int64)
    counts[more] = from_planes(take(n_large * size), n_large, size).astype(np.int64)
    return high, low, counts


def filters_by_prefix(high: np.ndarray, low: np.ndarray, counts: np.ndarray, packing: Packing, prefix: int) -> Iterator[tuple[int, bytes]]:
    """(prefix, filter) of sorted distinct keys."""
    part = (high >> u64(packing.upper - prefix)).astype(np.int64) if len(high) else np.zeros(0, np.int64)
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(part[lo]), filter_of(high[lo:hi], low[lo:hi], counts[lo:hi], packing, prefix)


def merged(table: pa.Table, packing: Packing, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys and counts of all filters of a table of one prefix."""
    parts, filters = table.column("part").to_pylist(), table.column("filter").to_pylist()
    found = [keys_of(x, packing, prefix, p) for p, x in zip(parts, filters, strict=True)]
    return counted(*(np.concatenate(x) for x in zip(*found, strict=True)), packing)


# ---------------------------------------------------------------- shards


def shards(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(shard, codes, langs, of, words, numbers): texts as numbers of a dictionary of their own, some SHARD_BYTES together.

    codes has a number for each word, negative where a piece begins; entry i of the dictionary is words[i] of the
    language langs[of[i]] and occurs numbers[i] times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part, data, offsets in sliced(batches, "text"):
            data = LOWER[data]
            word = ~GAP[data]
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True
            starts = np.flatnonzero(word & (np.concatenate([[True], ~word[:-1]]) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
            ends = np.flatnonzero(word & (np.concatenate([~word[1:], [True]]) | edge[1:])) + 1 if len(data) else np.zeros(0, np.int64)
            doc = np.searchsorted(offsets, starts, "right") - 1
            piece = np.cumsum(BREAK[data])[starts] if len(data) else starts
            first = np.ones(len(starts), bool)
            first[1:] = (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1])
            # the words' bytes side by side, so that Arrow counts them by value
            inside = np.zeros(len(data) + 1, np.int8)
            inside[starts] += 1
            inside[ends] -= 1
            letters = data[np.cumsum(inside[:-1], dtype=np.int8) > 0] if len(data) else data
            places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
            # words that touch at the border of two texts are still two, as places has them
            words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(letters))])
            names = part.column("lang").dictionary_encode()
            held.append((words, names.dictionary.to_pylist(), names.indices.to_numpy()[doc], first))
            size += len(data)
            if size >= SHARD_BYTES:
                yield shard(held)
                held, size = [], 0
        if held:
            yield shard(held)

    def shard(held: list) -> pa.RecordBatch:
        langs: dict[str, int] = {}
        of = np.concatenate([np.array([langs.setdefault(x, len(langs)) for x in names] or [0], np.int64)[i] for _, names, i, _ in held])
        found = pa.concat_arrays([x[0] for x in held]).dictionary_encode()
        entries = pa.array(of * max(1, len(found.dictionary)) + found.indices.to_numpy()).dictionary_encode()
        codes = entries.indices.to_numpy().astype(np.int64)
        own = entries.dictionary.to_numpy()
        signed = np.where(np.concatenate([x[3] for x in held]), -1 - codes, 1 + codes).astype("<i4")
        words = found.dictionary.take(pa.array(own % max(1, len(found.dictionary)))).cast(pa.binary())
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([uuid.uuid4().hex]),
                pa.array([np.ascontiguousarray(signed.view(np.uint8).reshape(-1, 4).T).tobytes()], pa.binary()),
                one(list(langs), pa.string()),
                one(own // max(1, len(found.dictionary)), pa.int32()),
                pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                one(np.bincount(codes, minlength=len(own)), pa.int64()),
            ],
            names=["shard", "codes", "langs", "of", "words", "numbers"],
        )

    rows = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    return rows.mapInArrow(run, "shard string, codes binary, langs array<string>, of array<int>, words array<binary>, numbers array<bigint>")


def with_dense_ids(spark: SparkSession, cut: Cut, words: DataFrame) -> tuple[DataFrame, int]:
    """words with ids from 1 without gaps, and their number; only the numbers of rows of the partitions are ordered in one place."""
    placed = cut.table(words.withColumn("at", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright("at", 33).alias("p")).count()
    before = sizes.withColumn("before", F.sum("count").over(Window.orderBy("p")) - F.col("count")).select("p", "before")
    ids = placed.withColumn("p", F.shiftright("at", 33)).join(F.broadcast(before), "p").withColumn("id", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1)
    out = cut.table(ids.drop("p", "at", "before"))
    return out, out.count()


def joined(rows: DataFrame, table: DataFrame, on: str, weight: str | None = None) -> DataFrame:
    """rows joined with a written table of one row per key, which is broadcast where it is small in rows, and in bytes of the column weight."""
    bytes_ = F.coalesce(F.sum(F.octet_length(weight)), F.lit(0)) if weight else F.lit(0)
    n, size = table.agg(F.count("*"), bytes_).first()
    return rows.join(F.broadcast(table) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else table, on)


def phrase_counts(spark: SparkSession, docs: DataFrame, least: int, text: str, lang: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases of two and three words with least occurrences or more, their words, and how many words each language has.

    Phrases (w1, w2, w3, a), w3 being 0 in pairs; words (id, lang, word, n) with least occurrences or more; totals (lang, n).
    A phrase holds no word and no phrase that is rarer than itself, so only frequent words get ids and rare ones end a run of ids.
    """
    cut = Cut(spark)
    held = cut.table(shards(docs, text, lang))
    entries = held.select("shard", "langs", F.posexplode(F.arrays_zip("of", "words", "numbers")).alias("code", "x"))
    entries = entries.select("shard", "code", F.expr("langs[x.of]").alias("lang"), F.col("x.words").alias("word"), F.col("x.numbers").alias("n"))
    counts = cut.table(entries.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = cut.table(counts.groupBy("lang").agg(F.sum("n").alias("n")))
    all_words = totals.agg(F.sum("n")).first()[0] or 0
    words, size = with_dense_ids(spark, cut, counts.where(F.col("n") >= least))
    packing = Packing(max(1, size.bit_length()))
    prefix = min(packing.upper, max(0, (2 * all_words // PART_KEYS).bit_length()))
    first = min(prefix, FIRST_BITS)
    groups = 1 << (prefix - first)

    known = joined(entries.withColumnRenamed("lang", "l"), words.withColumnRenamed("lang", "own").drop("n"), "word", "word").where("l = own")
    answers = known.select(F.col("shard").alias("to"), "code", "id")

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        raw = b"".join(left.column("codes").to_pylist())
        signed = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").reshape(-1).astype(np.int64)
        of = np.zeros(int(np.abs(signed).max(initial=0)) + 1, np.uint64)
        of[right.column("code").to_numpy() + 1] = right.column("id").to_numpy().astype(np.uint64)
        w, goes_on = of[np.abs(signed)], signed > 0
        pair = np.flatnonzero((w[:-1] > 0) & (w[1:] > 0) & goes_on[1:])
        triple = pair[:-1][np.diff(pair) == 1]
        none = np.zeros(len(pair), np.uint64)
        a, b, c = np.concatenate([w[pair], w[triple]]), np.concatenate([w[pair + 1], w[triple + 1]]), np.concatenate([none, w[triple + 2]])
        found = counted(*packing.permuted(a, b, c), None, packing)
        group = hash_group(left.column("shard")[0].as_py(), groups)
        rows = [{"part": p, "group": group, "filter": x} for p, x in filters_by_prefix(*found, packing, first)]
        return pa.Table.from_pylist(rows, pa.schema([("part", pa.int64()), ("group", pa.int64()), ("filter", pa.binary())]))

    filters = held.select("shard", "codes").groupBy("shard").cogroup(answers.groupBy("to")).applyInArrow(count, "part long, group long, filter binary")
    if groups > 1:
        filters = filters.groupBy("part", "group").applyInArrow(lambda t: split(t, packing, first, prefix), "part long, group long, filter binary")

    def frequent(table: pa.Table) -> pa.Table:
        high, low, n = merged(table, packing, prefix)
        kept = n >= least
        w = packing.ids(high[kept], low[kept])
        return pa.table({k: pa.array(x.astype(np.int64)) for k, x in zip(("w1", "w2", "w3", "a"), (*w, n[kept]), strict=True)})

    return cut.table(filters.groupBy("part").applyInArrow(frequent, "w1 long, w2 long, w3 long, a long")), words, totals


def hash_group(shard: str, groups: int) -> int:
    return int(shard[:12], 16) % groups


def split(table: pa.Table, packing: Packing, first: int, prefix: int) -> pa.Table:
    """The filters of a group of shards merged, and cut by a longer prefix."""
    found = merged(table, packing, first)
    rows = [{"part": p, "group": 0, "filter": x} for p, x in filters_by_prefix(*found, packing, prefix)]
    return pa.Table.from_pylist(rows, pa.schema([("part", pa.int64()), ("group", pa.int64()), ("filter", pa.binary())]))


# ---------------------------------------------------------------- scores


def strength(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly, for counts below 10^16."""
    wide = lambda x: x.cast("decimal(18,0)")
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def collocations(spark: SparkSession, docs: DataFrame, least: int = 10, top: int = 2000, share: int = 50, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of two or three words by score, then occurrences, then bytes of the phrase.

    Texts, with A-Z lower-cased, are cut into pieces at .,;:!? and line breaks, and pieces at spaces and tabs into words; a phrase is a run of words
    of a piece, and all its a occurrences count, overlapping ones too. Phrases with at least `least` are candidates. A cut into two parts with l
    and r occurrences scores floor(10^6 a^2 / (l r)); a phrase has its lowest cut, of equal ones the first. A pair inside a triple that has at least
    share % of its occurrences is dropped. n is the number of all words of the language.

    Null texts are empty, a null language is `und`; repeated rows count each; texts of any length are taken whole; without candidates, as in an
    empty table, there are no rows; extra columns are ignored, whatever their names.
    """
    phrases, words, totals = phrase_counts(spark, docs, least, text, lang)
    cut = Cut(spark)
    by_id = lambda k: (words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}"), F.col("n").alias(f"n{k}")), f"w{k}", f"word{k}")
    pairs = cut.table(phrases.where("w3 = 0").select(F.struct("w1", "w2").alias("pair"), F.col("a")))
    triples = cut.table(phrases.where("w3 > 0"))

    # every word a phrase names has an id, and every pair inside a triple is a candidate, so no join loses a row
    t = joined(triples.withColumn("pair", F.struct("w1", "w2")), pairs.withColumnRenamed("a", "n12"), "pair").drop("pair")
    t = joined(t.withColumn("pair", F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"))), pairs.withColumnRenamed("a", "n23"), "pair").drop("pair")
    for k in (1, 2, 3):
        t = joined(t, *by_id(k))
    t = t.withColumns({"first": strength(F.col("a"), F.col("n1"), F.col("n23")), "second": strength(F.col("a"), F.col("n12"), F.col("n3"))})
    early = F.col("first") <= F.col("second")
    spaced = lambda *c: F.concat_ws(" ", *(F.col(x).cast("string") for x in c)).alias("phrase")
    t = t.select("w1", spaced("word1", "word2", "word3"), "a", F.when(early, F.col("n1")).otherwise(F.col("n12")).alias("l"), F.when(early, F.col("n23")).otherwise(F.col("n3")).alias("r"), F.least("first", "second").alias("score"))

    inside = triples.select(F.struct("w1", "w2").alias("pair"), "a").unionByName(triples.select(F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")).alias("pair"), "a"))
    longer = inside.groupBy("pair").agg(F.max("a").alias("longer"))
    p = pairs.join(longer, "pair", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).select("pair.w1", "pair.w2", "a")
    p = joined(joined(p, *by_id(1)), *by_id(2))
    p = p.select("w1", spaced("word1", "word2"), "a", F.col("n1").alias("l"), F.col("n2").alias("r"), strength(F.col("a"), F.col("n1"), F.col("n2")).alias("score"))

    both = joined(p.unionByName(t), words.select(F.col("id").alias("w1"), "lang"), "w1", "lang")
    # the first of each share of a language, then the first of these: no task orders more than about the root of what a language has
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    shares = 1 + int((phrases.count() / max(1, top)) ** 0.5)
    both = both.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    first = both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return joined(ranked, totals, "lang", "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


PHRASE_SQL = """
with pieces as (
    select coalesce(lang, 'und') as lang,
        unnest(string_split_regex(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
    from documents),
runs as (select lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') as ws from pieces),
grams as (
    select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) as phrase
    from runs, (values (1), (2), (3)) as sizes(k)),
f as (select lang, k, phrase, count(*) as n from grams group by all),
totals as (select lang, sum(n)::bigint as n from f where k = 1 group by lang),
candidates as (select lang, k, phrase, n as a, string_split(phrase, ' ') as ws from f where k > 1 and n >= 10),
cuts as (
    select c.lang, c.k, c.phrase, c.a, j, x.n as l, y.n as r, ((1000000::hugeint * c.a * c.a) // (x.n::hugeint * y.n))::bigint as score
    from candidates c, (values (1), (2)) as places(j)
    join f x on x.lang = c.lang and x.phrase = array_to_string(c.ws[1 : j], ' ') and x.k = j
    join f y on y.lang = c.lang and y.phrase = array_to_string(c.ws[j + 1 :], ' ') and y.k = c.k - j
    where j < c.k),
lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
longer as (
    select lang, phrase, max(a) as a from (
        select lang, array_to_string(ws[1 : 2], ' ') as phrase, a from candidates where k = 3
        union all select lang, array_to_string(ws[2 : 3], ' '), a from candidates where k = 3) group by all),
kept as (select w.* from lowest w left join longer g on g.lang = w.lang and g.phrase = w.phrase and w.k = 2 where g.a is null or 100 * g.a < 50 * w.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select r.lang, rank, phrase, a, l, r, t.n, score from ranked r join totals t on t.lang = r.lang where rank <= 2000
"""

"""Collocations against counts of a dictionary; keys and filters by round trips."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from echomark.llm import phrases
from echomark.llm.phrases import Packing

SCHEMA = "doc_id long, text string, lang string, word string, shard string, a string, entry string"


def pieces(text):
    plain = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split(r"[ \t]+", p) if w] for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", plain)]


def brute(rows, least, top):
    f, totals = Counter(), Counter()
    for text, lang in rows:
        for ws in pieces(text):
            totals[lang or "und"] += len(ws)
            for k in (1, 2, 3):
                for i in range(len(ws) - k + 1):
                    f[lang or "und", tuple(ws[i : i + k])] += 1
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for lang in totals:
        found = []
        for (own, p), a in candidates.items():
            longer = [b for (o, q), b in candidates.items() if o == own and len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:])]
            if own != lang or any(100 * b >= 50 * a for b in longer):
                continue
            score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    words = ["New", "york", "city", "of", "the", "Émile", "x\x01", "x", "a-b", "\x02", "zürich", "THE"]
    out = [(None, "en"), ("", None), ("  \t\n..", "en"), ("the " * 400, "fr"), ("one", "en"), ("x\x01 y. " * 12 + "x y, " * 12, "en"), ("York" * 3000 + " city of " + "york" * 3000, "en")]
    for _ in range(300):
        own = [draw.choice(["new york city", "of the", "the city", *words]) for _ in range(draw.randrange(1, 30))]
        out.append(("".join(w + draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ! "]) for w in own), draw.choice(["en", "de", None, "und"])))
    return out + out[40:60]


def found(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, lang, "w", "s", "a", "e") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    got = phrases.collocations(spark, docs, **options).collect()
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got)


@pytest.mark.parametrize("shard, part, first", [(8 << 20, 1 << 21, 10), (1500, 64, 2), (400, 900, 10)])
def test_collocations_equal_brute_force(spark, rows, monkeypatch, shard, part, first):
    """In one part, in parts by two levels of merging, and in parts by one."""
    for name, value in (("SHARD_BYTES", shard), ("PART_KEYS", part), ("FIRST_BITS", first)):
        monkeypatch.setattr(phrases, name, value)
    got = found(spark, rows)
    assert got == brute(rows, 10, 2000) and len(got) > 40


def test_small_tables_and_limits(spark, rows, monkeypatch):
    assert found(spark, [("a b c. " * 9, "en")]) == []
    assert found(spark, [("A b c. " * 10, "en")]) == brute([("a b c. " * 10, "en")], 10, 2000) == [("en", 1, "a b c", 10, 10, 10, 30, 10**6)]
    assert found(spark, rows[:0]) == []
    assert found(spark, rows, least=3, top=7) == brute(rows, 3, 7)
    monkeypatch.setattr(phrases, "BROADCAST_ROWS", 2)
    assert found(spark, rows, least=3) == brute(rows, 3, 2000)


@pytest.mark.parametrize("bits", [1, 2, 5, 8, 16, 18, 21, 22, 31, 32, 42])
def test_keys_give_back_their_ids(bits):
    draw = np.random.default_rng(bits)
    ids = [np.concatenate([draw.integers(0, 1 << bits, 4000, dtype=np.uint64), np.array([0, (1 << bits) - 1], np.uint64)]) for _ in range(3)]
    packing = Packing(bits)
    assert packing.upper + packing.lower == 3 * bits
    high, low = packing.permuted(*ids)
    assert int(high.max()) < 1 << packing.upper and int(low.max()) < 1 << packing.lower
    assert all(np.array_equal(x, y) for x, y in zip(packing.ids(high, low), ids, strict=True))
    triples = Counter(zip(*(x.tolist() for x in ids), strict=True))
    assert len(set(zip(high.tolist(), low.tolist(), strict=True))) == len(triples)

    high, low, n = phrases.counted(high, low, None, packing)
    assert dict(zip(zip(*(x.tolist() for x in packing.ids(high, low)), strict=True), n.tolist(), strict=True)) == triples
    n = n + np.where(np.arange(len(n)) % 7 == 0, draw.integers(0, 1 << 40, len(n)), 0)
    for prefix in sorted({0, min(3, packing.upper), packing.upper}):
        back = [phrases.keys_of(x, packing, prefix, p) for p, x in phrases.filters_by_prefix(high, low, n, packing, prefix)]
        assert all(np.array_equal(np.concatenate(x), y) for x, y in zip(zip(*back, strict=True), (high, low, n), strict=True))


def test_filters_are_compact():
    """18-bit ids: a key of a filter takes little more than the bits beyond its quotient."""
    packing, draw = Packing(18), np.random.default_rng(2)
    keys = phrases.counted(*packing.permuted(*(draw.integers(1, 1 << 18, 50_000, dtype=np.uint64) for _ in range(3))), None, packing)
    assert len(phrases.filter_of(*keys, packing, 0)) / len(keys[0]) < 5.5


def test_ids_that_do_not_fit_are_refused():
    with pytest.raises(ValueError):
        Packing(43)


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    draw = random.Random(6)
    rows = [(a, draw.randrange(a, 4 * a), draw.randrange(a, 4 * a)) for a in (draw.randrange(1, 10**k) for k in range(1, 16) for _ in range(20))]
    rows += [(10**15 - 1,) * 3, (10**15 - 2, 10**15 - 1, 10**15 - 1), (3, 3, 3), (1, 10**15 - 1, 10**15 - 1)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", phrases.strength(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(x["s"] == 10**6 * x["a"] ** 2 // (x["l"] * x["r"]) for x in got)

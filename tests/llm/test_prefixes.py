"""The prefix trie against one built node by node."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from echomark.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, depth string, conv string, least string"


def plain(rows):
    """conv -> its turns in order."""
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            out[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {c: [(r, t) for *_, r, t in sorted(x)] for c, x in out.items()}


def reheaded(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + own[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(q[: len(p)] == p and len(q) > len(p) for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].decode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.add((min(own), len(path), parent, len(own), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(df):
    got = [tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(9)
    out = []
    roots = [[(draw.choice(["user", "assistant", None]), draw.choice(["hi", "", None, "höw are you", "x" * 50])) for _ in range(9)] for _ in range(3)]
    for c in [*range(-120, -90, 7), *range(0, 40), *range(100, 330, 3), 10**12, 10**12 + 7]:
        turns = list(draw.choice(roots))[: draw.randrange(1, 10)]
        for i in range(len(turns)):
            if draw.random() < 0.12:
                turns[i] = ("user", f"own {draw.randrange(3)}")
        numbers = [None if draw.random() < 0.05 else i for i in range(len(turns))]
        out += [(c, n, *t, "a", "b", "c") for n, t in zip(numbers, turns, strict=True)]
    out += [(500, 1, "user", "one", "", "", "")] * 3 + [(501, i, "user", str(i % 2), "", "", "") for i in range(120)] + [(502, i, "user", str(i % 2), "", "", "") for i in range(117)]
    out += [(503, i, "user", "say", "", "", "") for i in range(2)] + [(504, 0, "users", "ay", "", "", ""), (None, 1, "user", "no conversation", "", "", "")]
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("block", [1, 2, 4, 7])
def test_trie_equals_brute_force(spark, rows, block, monkeypatch):
    monkeypatch.setattr(prefixes, "CHUNK_BITS", block % 3)
    turns = prefixes.numbered(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert found(prefixes.digest(spark, turns, block)) == brute(plain(rows))


def test_reheaded_conversations(spark, rows):
    turns = prefixes.numbered(spark.createDataFrame(rows, SCHEMA).repartition(3))
    turns = prefixes.with_heads(turns, F.expr("conv - conv % 100"), F.crc32(F.col("conv").cast("string").cast("binary")) % 6)
    assert found(prefixes.digest(spark, turns)) == brute(reheaded(plain(rows)))


def test_joins_that_shuffle_find_the_same(spark, rows, monkeypatch):
    monkeypatch.setattr("echomark.llm.common.BROADCAST_IDS", 3)
    turns = prefixes.numbered(spark.createDataFrame(rows, SCHEMA))
    assert found(prefixes.digest(spark, turns)) == brute(plain(rows))


@pytest.mark.parametrize("texts", [[], [("a",)], [("a", "b", "c", "d", "e")] * 4, [("a", "b", "c", "d", "e")] * 2 + [("a", "b", "c", "d", "e", "f")]])
def test_small_tables(spark, texts):
    rows = [(c, i, "user", t, "", "", "") for c, own in enumerate(texts) for i, t in enumerate(own)]
    assert found(prefixes.digest(spark, prefixes.numbered(spark.createDataFrame(rows, SCHEMA)))) == brute(plain(rows))


def test_only_diverging_blocks_are_taken_apart(spark):
    """Twenty equal conversations and one that differs in its last turn: of five blocks one is looked at by turns."""
    rows = [(c, i, "user", f"t{i}" if i < 19 or c else "other", "", "", "") for c in range(21) for i in range(20)]
    turns = prefixes.numbered(spark.createDataFrame(rows, SCHEMA))
    units = prefixes.shared_units(turns, prefixes.Cut(spark), 4)
    assert {(r["lo"], r["hi"]) for r in units.select("lo", "hi").distinct().collect()} == {(0, 0), (1, 4), (5, 8), (9, 12), (13, 16), (17, 17), (18, 18), (19, 19), (20, 20)}

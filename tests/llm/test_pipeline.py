"""Stages of the corpus pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from echomark.llm import mixing, quality


def prose(draw, n):
    return " ".join("".join(draw.choices("abcdefghij", k=5)) for _ in range(n))


def normal(line):
    return re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line.lower())).strip(" ")


def test_lines_above_the_limit_leave_the_text(spark, sf):
    draw = random.Random(1)
    boiler = ["Read  MORE about us: page {}", "all rights reserved {}"]
    texts = [f"{prose(draw, 20)}\n{boiler[0].format(i)}\r\n\n{prose(draw, 20)}\n" + (boiler[1].format(i) if i % 2 else prose(draw, 2)) for i in range(120)] + ["  plain \n\n text\t" + prose(draw, 30) + "\n"]
    rows = [(i, t, f"s{i % 2}" if i < 110 else "small", 0) for i, t in enumerate(texts)] + [(900, None, "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(3)
    limit = {s: max(5, min(50, 0.1 * len({t for _, t, o, _ in rows if o == s}))) for s in ("s0", "s1", "small")}
    held = {}
    for _, t, s, _ in rows:
        for x in {normal(x) for x in (t or "").split("\n")} - {""}:
            held.setdefault((s, x), set()).add(t)
    over = {k for k, v in held.items() if len(v) > limit[k[0]]}
    assert {s for s, _ in over} == {"s0", "s1", "small"}
    want = {i: None if t is None else "\n".join(x for x in t.split("\n") if (s, normal(x)) not in over) for i, t, s, _ in rows}
    judged = {r["doc_id"]: r for r in quality.judge(docs, count="texts").collect()}
    assert {i: r["clean_text"] for i, r in judged.items()} == want
    assert all(len((want[i] or "").split()) == r["n_words"] - r["n_removed_words"] for i, r in judged.items())
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.quality_rules(spark, docs, sf).collect()}
    assert len(got) == len(texts) and sum(want[i] != t for i, t, _, _ in rows) == 120
    assert got == {i: (want[i], len(want[i])) for i in want if want[i]}


def draw_of(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def mixed(rows, block=32):
    """Copies of (id, text, source) rows, sources of one shard each and at most 200,000 words; targets and quotas by the definition."""
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t or "") for i, t, _ in rows}
    own = defaultdict(list)
    for i, _, s in rows:
        own[s].append(i)
    names = sorted(own)
    size, weight = {s: sum(len(tokens[i]) for i in own[s]) for s in names}, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full = set()
    while True:
        free = sum(size.values()) - sum(3 * size[s] for s in full)
        target = {s: 3 * size[s] if s in full else free * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        more = {s for s in names if target[s] >= 3 * size[s]} - full
        if not more:
            break
        full |= more
    seats = int(sum(size.values()) / block + 0.5)
    quota = Counter(s for _, s in sorted((-target[s] / (2 * i + 1), s) for s in names for i in range(seats))[:seats])
    out, text = [], {i: t for i, t, _ in rows}
    for s in names:
        n = -(-size[s] // block)
        take = min(quota[s], 3 * n)
        first, at, line = draw_of("mix first", s, 0) % n, 0, sorted(own[s], key=lambda i: (draw_of("mix order", i), i))
        chosen = {j for j in range(n) if (j * 1000003 + first) % n < take % n}
        for i in line:
            words = tokens[i]
            part = [w for k, w in enumerate(words) if (at + k) // block in chosen]
            at += len(words)
            whole = take // n + (len(part) == len(words))
            out += [(i, text[i])] * (whole if words else 0)
            if 0 < len(part) < len(words):
                out.append((i, "".join(part).rstrip(" \t\n\x0b\f\r")))
    return out


def test_partial_copies_are_the_blocks_that_the_mix_selects(spark, sf):
    draw = random.Random(2)
    gap = lambda: draw.choice([" ", " ", " ", "  ", "\n", "\t", "\r\n\n"])
    rows = [(i, draw.choice(["", "\n "]) + "".join(w + gap() for w in prose(draw, draw.choice([1, 5, 40, 400, 900])).split()), draw.choice("abcdddddd")) for i in range(120)]
    rows += [(200, None, "a"), (201, " \n", "d")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, n_chars int").repartition(3)
    got, want = corpus_pipeline.source_mixing(spark, docs, sf).collect(), mixed(rows)
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(want) and all(r["n_chars"] == len(r["text"]) for r in got)
    whole = {i: t for i, t, _ in rows}
    assert sum(whole[i] != t for i, t in want) > 20 and sum(not whole[i].lstrip().startswith(t) for i, t in want) > 20
    for r in mixing.mix(spark, docs).collect():
        assert all(0 <= x["lo"] < x["hi"] <= r["size"] for x in r["spans"])
        assert r["size"] == 0 or (r["taken"] - sum(x["hi"] - x["lo"] for x in r["spans"])) % r["size"] == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_tables(spark, sf, name, stage):
    """Nulls in every column, empty and repeated rows, columns named like results, and no rows at all."""
    draw = random.Random(7)
    own = [prose(draw, 80) for _ in range(6)]
    texts = [*own, None, "", " \n\t ", own[0], own[1] + " more", "\n".join([own[2], own[3]]), "é日😀 " * 40]
    clash = {"kept": "mine", "size": 5, "taken": 7, "spans": "s", "target": 0.5, "source_size": 9, "n_words": "keepme", "component_id": 3, "clean_text": "c", "n_removed": 2, "token_ids": "t", "base_failed": "b"}
    rows = [(None if i == 4 else i, t, None if i == 2 else "en", None if i == 3 else f"s{i % 2}", None if i == 5 else len(t or ""), *clash.values()) for i, t in enumerate(texts)]
    kinds = {str: "string", int: "long", float: "double"}
    docs = spark.createDataFrame(rows + [rows[1], rows[6]], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{k} {kinds[type(v)]}" for k, v in clash.items())).repartition(3)
    got, none = stage(spark, docs, sf), stage(spark, docs.limit(0), sf)
    assert none.count() == 0 and none.columns == got.columns
    out = got.collect()
    if name == "bpe_encoding":
        assert len(out) == len(rows) + 2 and {r["n_tokens"] for r in out if r["doc_id"] in (6, 7)} == {0}
        return
    assert got.columns == docs.columns and len(out) >= (3 if name == "suffix_array_dedup" else 6)
    assert all({k: r[k] for k in clash} == clash for r in out)
    assert all(r["text"] and r["n_chars"] == len(r["text"]) for r in out) or name == "minhash_near_dedup"
    assert all(r["lang"] is None for r in out if r["doc_id"] == 2) and all(r["source"] is None for r in out if r["doc_id"] == 3)


def test_near_dedup_stage_keeps_one_of_each_group(spark, sf):
    draw = random.Random(9)
    own = [prose(draw, 90).split() for _ in range(12)]
    rows = []
    for w in own:
        for k in range(4):
            v = list(w)
            v[10 * k : 10 * k + 1] = ["edited"] * (k % 3)
            rows.append(" ".join(v))
    draw.shuffle(rows)
    rows += [rows[0], None, None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(3)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in ((t or "").split() for t in rows)]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    kept = sorted(r["doc_id"] for r in corpus_pipeline.minhash_near_dedup(spark, docs, sf).collect())
    assert kept == [i for i in range(len(rows)) if root(i) == i] and len(kept) == 14


def test_repeated_bytes_stage(spark, sf):
    draw = random.Random(10)
    passage = prose(draw, 60)
    rows = [f"{prose(draw, 30)} {passage} {prose(draw, 30)}" for _ in range(5)] + [prose(draw, 100), passage[:250], "é" * 150 + prose(draw, 5) + "é" * 150, None]
    bodies = [(t or "").encode() for t in rows]
    seen = Counter(b[i : i + 200] for b in bodies for i in range(len(b) - 199))
    want = {}
    for k, b in enumerate(bodies):
        gone = {j for i in range(len(b) - 199) if seen[b[i : i + 200]] > 1 for j in range(i, i + 200)}
        left = bytes(x for i, x in enumerate(b) if i not in gone).decode("utf-8", "ignore")
        if left.strip():
            want[k] = left
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(rows)], "doc_id long, text string, n_chars int").repartition(3)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.suffix_array_dedup(spark, docs, sf).collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()} and 6 not in got and len(want[0]) < len(rows[0])


def test_run_applies_the_stages_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs.limit(0), sf).schema)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, docs.collect()))

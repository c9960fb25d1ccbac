"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from echomark.llm import bpe, common, language, mixing, neardup, paragraphs, ppm, quality, queries, suffixes, urls, vectors

WORDS = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]
SCHEMA = "doc_id long, text string, lang string, source string, kept boolean, size string, component_id string"


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def prose(draw, n):
    return " ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(n))


def alternating(n, a, b):
    """The word whose letter i is b where i has an odd number of binary ones: its polynomials in many bases agree with those of its mirror."""
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def table(spark, texts, **more):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", True, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + more.get("rows", []), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    base = [prose(draw, n) for n in (0, 1, 2, 4, 30, 60, 90, 120, 300, 2000)]
    near = []
    for b in base[5:9]:
        w = b.split()
        for k in range(6):
            v = list(w)
            for _ in range(k):
                v[draw.randrange(len(v))] = "edited" + str(draw.randrange(99))
            near.append(" ".join(v))
    lines = ["\n".join(["repeated line of some words here"] * 5 + [prose(draw, 30)]), "a b\n\n a  b \n"]
    passage = prose(draw, 60)
    return [None, "", "   \n\t", *base, *near, *lines, f"{prose(draw, 20)} {passage} {prose(draw, 9)}", f"start. {passage}. {prose(draw, 40)}", base[6], "x" * 3000 + "é" * 500]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(same, name):
    same(queries.QUERIES[name], queries.SQL[name])


def exact_components(sets, percent):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        common_ = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * common_ >= percent * (len(sets[i]) + len(sets[j]) - common_):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(sets))]


def shingle_set(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def test_near_duplicates(spark, texts):
    docs = table(spark, texts)
    got = {r["doc_id"]: r for r in neardup.classes(spark, docs, width=3, percent=85).collect()}
    sets = [shingle_set(t, 3) for t in texts]
    want = exact_components(sets, 85)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(s), want[i]) for i, s in enumerate(sets)}
    kept = neardup.keep_one(spark, docs.unionByName(docs.where("doc_id = 5")), width=3, percent=85)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, c in enumerate(want) if i == c] and kept.columns == docs.columns


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A group whose members do not all link with the least one, in cells smaller than the group."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    draw = random.Random(8)
    base = prose(draw, 120).split()
    docs = []
    for k in range(24):
        v = list(base)
        for i in range(k % 8):
            v[(k * 7 + i * 13) % 120] = f"w{k}{i}"
        docs.append(" ".join(v))
    got = {r["doc_id"]: r["component_id"] for r in neardup.classes(spark, table(spark, docs), 3, 85).collect()}
    assert got == dict(enumerate(exact_components([shingle_set(t, 3) for t in docs], 85)))


def test_alternating_words_are_no_duplicates(spark):
    own = [alternating(n, *ab) for n in (1024, 4096) for ab in ("ab", "ba")]
    own += [" ".join(alternating(1024, *ab)) for ab in ("ab", "ba")] + [own[0]]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.classes(spark, table(spark, own), 3, 85).collect()}
    sets = [shingle_set(t, 3) for t in own]
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, exact_components(sets, 85), strict=True))} and got[1][1] == 1 and got[6][1] == 0


@pytest.mark.parametrize("length", [200, 1024, 4096])
def test_hashes_of_alternating_words_differ(length):
    data = np.frombuffer((alternating(length, "a", "b") + alternating(length, "b", "a") + alternating(length, "a", "b")).encode(), np.uint8)
    at = np.arange(3) * length
    for h in (common.span_hashes(data, at, at + length), suffixes.SpanHashes(data)(at, at + length), common.sequence_hashes(data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), at, at + length)):
        assert h[0] == h[2] != h[1]


def test_families_on_one_template(spark):
    """No pair is lost where most of a bucket are strangers: near-duplicate pairs of paragraphs, all made from one template."""
    draw = random.Random(12)
    base, own = prose(draw, 120).split(), []
    for f in range(150):
        kin = [w if draw.random() < 0.85 else f"own{f}x{k}" for k, w in enumerate(base)]
        other = list(kin)
        for k in draw.sample(range(120), 2):
            other[k] = f"edit{f}y{k}"
        own += [" ".join(kin), " ".join(other)]
    sets = [shingle_set(t, 5) for t in own]
    want = exact_components(sets, 80)
    assert len(set(want)) == 150
    got = paragraphs.clusters(spark, table(spark, own)).collect()
    assert {r["doc_id"]: r["cluster_id"] for r in got if r["sentence"] is None} == {i: f"{c}/0" for i, c in enumerate(want)}


def test_passages_inside_sentences(spark):
    """A passage of 50 words without sentence ends is found inside other sentences, wherever it stands; unrelated text is not."""
    draw = random.Random(21)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    free = lambda n: " ".join(word() for _ in range(n))
    own = []
    for _ in range(40):
        passage = free(50)
        own += [f"{free(draw.randrange(5, 90))} {passage} {free(draw.randrange(5, 90))}", f"{free(draw.randrange(5, 90))} {passage.upper()} {free(draw.randrange(5, 90))}", free(120)]
    found = Counter()
    for r in paragraphs.clusters(spark, table(spark, own)).collect():
        found[r["doc_id"]] += r["n_words"]
    assert all(20 <= found[i] <= 50 for i in range(len(own)) if i % 3 < 2) and not any(found[i] for i in range(2, len(own), 3))


def test_odd_sketches_estimate_similarity():
    sets, draw = common.Sets(24, 5), np.random.default_rng(1)
    for shared in (950, 850, 500):
        pool = draw.integers(0, 1 << 62, 2000, dtype=np.uint64)
        x, y = np.unique(pool[:1000]), np.unique(pool[1000 - shared : 2000 - shared])
        j = common.overlap(x, y) / (2000 - common.overlap(x, y))
        a, b = (neardup.odd_sketches(sets.samples(s)[None, :])[0] for s in (x, y))
        z, n = int(np.bitwise_count(a ^ b).sum()), neardup.SKETCH_BITS
        assert 1 + n / (4 * 120) * math.log(1 - 2 * z / n) == pytest.approx(j, abs=0.15)


def repeated_bytes(bodies, length):
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    masks = []
    for b in bodies:
        m = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                m[i : i + length] = True
        masks.append(m)
    return masks


@pytest.mark.parametrize("length, heavy", [(24, suffixes.HEAVY), (24, 3), (200, suffixes.HEAVY), (200, 3)])
def test_repeated_strings(spark, texts, length, heavy, monkeypatch):
    from echomark.llm import blocks

    monkeypatch.setattr(blocks, "BLOCK_BYTES", 20000)
    monkeypatch.setattr(blocks, "PART_BYTES", 15000)
    # a common line of its own bytes in many surroundings: one anchor with many fragments
    draw, line = np.random.default_rng(5), "".join(map(chr, np.random.default_rng(6).integers(97, 123, 230)))
    around = lambda: "".join(map(chr, draw.integers(97, 123, 300)))
    texts = [*texts, *(around() + line + around() for _ in range(12))]
    docs = table(spark, texts)
    bodies = [(t or "").encode() for t in texts]
    masks = repeated_bytes(bodies, length)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.digests(docs, length, heavy=heavy).collect()}
    want = {i: (len(b), int(m.sum()), int((m & ~np.concatenate([[False], m[:-1]])).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest()) for i, (b, m) in enumerate(zip(bodies, masks, strict=True))}
    assert got == want
    cut = suffixes.remove_repeats(docs, length, heavy=heavy)
    assert cut.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {i: None if texts[i] is None else np.frombuffer(b, np.uint8)[~m].tobytes().decode("utf-8", "ignore") for i, (b, m) in enumerate(zip(bodies, masks, strict=True))}


def test_runs_over_long_texts(monkeypatch):
    """Anchors of texts longer than a run of the kernel equal those of a single run."""
    data = np.random.default_rng(0).integers(97, 101, 5000).astype(np.uint8)
    whole = suffixes.fragments_of(data, np.array([0, 5000]), 64)
    monkeypatch.setattr(suffixes, "PLACE", 10)
    cut = suffixes.fragments_of(data, np.array([0, 5000]), 64)
    covered = lambda x: sorted((int(s), int(a)) for h, a, lo, hi in zip(*x, strict=True) for s in range(lo, hi + 1))
    assert [s for s, _ in covered(whole)] == [s for s, _ in covered(cut)] == list(range(5000 - 63))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_encoding_equals_the_library(spark, texts, tokenizer):
    more = [*texts, "a<|endoftext|>b", "  lead", "tail  ", "tab\t\tx", "it's we'll 12345", "日本語のテキスト" * 90, "=" * 999, "ab" * 700]
    docs = table(spark, more)
    want = {}
    for i, t in enumerate(more):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.digest(docs, queries.tokenizer_path(), ["doc_id"]).collect()}
    assert got == want
    back = bpe.decode(bpe.encode(docs, queries.tokenizer_path()), queries.tokenizer_path())
    assert all(r["decoded"] == (r["text"] or "") for r in back.collect())


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij", "aé日😀", "the"])
def test_tree_of_unsplit_text(alphabet, tokenizer):
    draw = random.Random(alphabet)
    own = bpe.codec(queries.tokenizer_path())
    for n in (300, 1024, 5000):
        text = "".join(draw.choice(alphabet) for _ in range(n))
        assert own.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_url_aliases(spark):
    pages = [
        (1, "http://a.org/es/1", None), (2, "http://b.org/x", '<link href="http://a.org/es/1" rel="canonical">'), (3, "http://c.org/y", '<META http-equiv="refresh" content="0; url=/z">'),
        (4, "http://c.org/z", '<link rel=canonical href="http://b.org/x">'), (5, "http://d.net/de/9", "<link rel='canonical' href='http://e.example.net/de/8'>"), (6, "http://f.org/", '<link rel="canonical" href="http://d.net/de/9">'),
        (7, None, None), (8, "no scheme", ""), (9, "HTTP://SUB.Example.COM/en/77?x=1#y", None), (10, "https://x.com/en/7", None), (10, "https://x.com/en/7", None), (11, "http://q.com", None),
    ]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(spark, df).collect()}
    assert got[1] == ("a.org", "/es/1", "org/es/", "block")
    assert [got[i][3] for i in (2, 3, 4)] == ["block"] * 3
    assert got[5][2:] == ("net/de/", "block") and got[6][2:] == (None, "allow")
    assert got[7] == got[8] == ("", "", None, "allow")
    assert got[9] == ("sub.example.com", "/en/77", "example.com/en/7", "allow") and got[10][2:] == ("com/en/", "block") and got[11] == ("q.com", "", None, "allow")
    log = spark.createDataFrame([("http://q.com", "http://a.org/es/1")], "a string, b string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(spark, df, edges=log).collect()}[11] == "block"


def random_pages(n):
    """Pages that name one another by absolute, root, folder, dotted, query and scheme-relative targets, with entities, and what they resolve to."""
    from urllib.parse import urljoin, urlsplit

    draw = random.Random(31)
    hosts = ["a.com", "example.com", "b.net", "example.net", "c.org", "d.info", "e.info", "f.info"]
    address = lambda: f"http://{draw.choice(hosts)}/{draw.choice(['en', 'de', 'es', 'x'])}/{draw.randrange(30)}" + draw.choice(["", "", "?q=1&r=2", "/sub/"])
    place = lambda u: (lambda x: x.netloc.lower() + (x.path or "/") + (f"?{x.query}" if x.query else ""))(urlsplit(u))
    rows, edges = [], []
    for i in range(n):
        url, html = address(), ""
        if draw.random() < 0.5:
            t = draw.choice([address(), f"/{draw.choice(['en', 'x'])}/{draw.randrange(30)}", str(draw.randrange(30)), f"../es/{draw.randrange(30)}", f"./{draw.randrange(30)}", "?q=1&r=2", "//d.info/x/1", "../..", "#top", "mailto:x@y.z", f"a/../{draw.randrange(30)}?u=http://k"])
            shown = t.replace("&", "&amp;")
            html = draw.choice([f'<LINK rel="canonical" href="{shown}">', f"<head><meta http-equiv=refresh content='0; url={shown}'></head>"])
            if not t.startswith(("#", "mailto")):
                edges.append((place(url), place(urljoin(url, t))))
        rows.append((i, url, html))
    return rows, edges, place


def test_url_aliases_of_a_random_graph(spark, duck):
    rows, edges, place = random_pages(400)
    rules = [(a, h, p) for a, h, p in urls.RULES]

    def rule(at):
        host, _, rest = at.partition("/")
        fits = [(len(h) + len(p), a == "allow", h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and ("/" + rest.partition("?")[0]).startswith(p)]
        return max(fits, default=None)

    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for i, url, _ in rows:
        seen, todo = {place(url)}, [place(url)]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        own, all_ = rule(place(url)), [r for r in map(rule, seen) if r]
        block = not own[1] if own else any(not r[1] for r in all_) and not any(r[1] for r in all_)
        want[i] = (own and own[2], "block" if block else "allow")
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(spark, df).collect()}
    assert got == want
    assert sum(r is None and v == "block" for r, v in want.values()) > 20
    pages = df.toPandas()  # noqa: F841
    import duckdb

    con = duckdb.connect()
    con.register("pages", pages)
    assert {r[0]: (r[3], r[4]) for r in con.execute(f"select page_id, host, path, rule, verdict from ({urls.URL_SQL})").fetchall()} == want


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(200), draw.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(400, k) for k in range(401, 450)]
    got = {r["node"]: r["component"] for r in common.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}
    assert common.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_language(spark):
    draw = random.Random(2)
    tongues = {"aa": "kralomi", "bb": "štěuxy", "cc": "日本語文字"}
    rows = [(i, " ".join("".join(draw.choice(tongues[t]) for _ in range(5)) for _ in range(20)), t) for i, t in enumerate(draw.choice(sorted(tongues)) for _ in range(80))]
    rows += [(900, None, "aa"), (901, "12 34 !", "aa"), (902, "", None), (903, "kral", None), (904, rows[0][1] * 500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(docs, F.pmod("doc_id", F.lit(4)) != 2, ["doc_id"]).collect()}
    assert all(got[i]["lang_pred"] == t for i, _, t in rows[:80]) and got[904]["lang_pred"] == rows[0][2]
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language.identify(docs, F.lit(False), ["doc_id"]).collect()} == {"und"}


def test_language_equals_brute_force(spark, sf):
    """Predictions and scores over all texts of a table equal those of n-grams bound and bundled one by one."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame([(-1, None, "en"), (-2, "", None), (-3, "Ünï 12 日本x", None), (-4, "1 2", "en"), (None, "the end", "en")], docs.schema)).repartition(3)
    rows = docs.collect()
    vector = {}

    def turned(point, turn):
        if (point, turn) not in vector:
            vector[point, turn] = 1 - 2 * np.unpackbits(language.letter_bits(np.array([point]), turn), axis=1)[0].astype(int)
        return vector[point, turn]

    def bundle(text):
        grams = Counter()
        for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
            points = [0, *map(ord, word), 0]
            grams.update(zip(points, points[1:], points[2:], strict=False))
        return sum((n * turned(a, 2) * turned(b, 1) * turned(c, 0) for (a, b, c), n in grams.items()), np.zeros(language.BITS, int))

    bundles = [bundle(r["text"]) for r in rows]
    learned = [r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 for r in rows]
    sums = defaultdict(lambda: np.zeros(language.BITS, int))
    for r, b, own in zip(rows, bundles, learned, strict=True):
        if own and r["lang"] is not None:
            sums[r["lang"]] += b
    names = sorted(sums)
    got = {(r["doc_id"], r["held_out"]): (r["lang_pred"], r["score"]) for r in language.identify(docs.withColumn("held_out", F.coalesce(F.pmod(common.id_crc(), F.lit(4)) == 2, F.lit(False))), ~F.col("held_out"), ["doc_id", "held_out"]).collect()}
    assert len(got) == len(rows)
    right = 0
    for r, b, own in zip(rows, bundles, learned, strict=True):
        pred, score = got[r["doc_id"], not own]
        if not b.any():
            assert (pred, score) == ("und", 0)
            continue
        cosines = [b @ sums[x] / np.linalg.norm(b) / np.linalg.norm(sums[x]) for x in names]
        assert pred == names[int(np.argmax(cosines))] and score == pytest.approx((1 + max(cosines)) / 2)
        right += not own and pred == r["lang"]
    assert right >= 0.98 * sum(not own and r["lang"] is not None and b.any() for r, b, own in zip(rows, bundles, learned, strict=True))


def test_bundles_are_sums_of_bound_vectors():
    counts, grams, has = language.profiles(["abca", "1"])
    assert counts.shape[0] == 2 and counts[0].sum() == 4 and has.tolist() == [True, False] and set(np.unique(grams)) == {-1.0, 1.0}
    a, b, c = (language.letter_bits(np.array([ord(x)]), t) for x, t in (("a", 2), ("b", 1), ("c", 0)))
    bound = 1 - 2 * np.unpackbits(a ^ b ^ c, axis=1).astype(int)[0]
    assert (grams == bound).all(axis=1).any()


def test_mix(spark):
    draw = random.Random(4)
    rows = [(i, prose(draw, draw.randrange(0, 400)), draw.choice(["a", "b", "c", None, "big", "big", "big", "big"])) for i in range(300)] + [(900, None, "a"), (901, "", "z"), (5, "again one two", "a"), (5, "again one two", "a")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, taken string")
    got = mixing.mix(spark, docs, shard_words=3000).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(spark, docs.repartition(5), shard_words=3000).collect()))
    by = defaultdict(list)
    for r in got:
        assert r["size"] == len(words(r["text"])) and 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(64, 0.03 * own[0]["target"]) and own[0]["target"] <= 3 * own[0]["source_size"]
    assert sum(own[0]["target"] for own in by.values()) == pytest.approx(sum(r["size"] for r in got))


def test_apportionment_takes_the_highest_quotients(spark):
    draw = random.Random(6)
    rows = [("g", k, draw.choice([0.0, 1.0, 1.0, 7.5, 100.0, 1000.0]), 137) for k in range(40)] + [("h", k, 2.0, 3) for k in range(5)] + [("e", 0, 0.0, 5)]
    got = {(r["g"], r["k"]): r["q"] for r in mixing.apportion(spark.createDataFrame(rows, "g string, k int, w double, n long"), ["g"], "k", "w", "n", "q").collect()}
    for g in "ghe":
        own = [(k, w, n) for x, k, w, n in rows if x == g]
        seats = sorted((-w / (2 * i + 1), k) for k, w, n in own if w > 0 for i in range(n))[: own[0][2]]
        assert {k: got[g, k] for k, _, _ in own} == {k: sum(x[1] == k for x in seats) for k, _, _ in own}


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "STRIPE", 16)
    draw = np.random.default_rng(9)
    rows = []
    for k in range(20):
        centre = draw.standard_normal(32)
        rows += [(centre + 0.18 * draw.standard_normal(32), k % 3) for _ in range(draw.integers(1, 40))]
    rows += [rows[0], rows[0], rows[1], (np.zeros(32), 0), (None, 1), (rows[2][0], None), (np.array([1.0, np.nan] * 16), 0), (np.array([np.inf] * 32), 0), (np.ones(5), 0), (np.ones(5), 0), (np.zeros(0), 1)]
    data = [(i, None if v is None else [float(x) for x in v], c) for i, (v, c) in enumerate(rows)]
    data.append((len(data), [1.0, None], 0))
    df = spark.createDataFrame([(*r, "clash") for r in data], "vec_id long, embedding array<double>, label int, id string").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.links(spark, df, 0.93).collect()}
    n = len(data)
    unit = [None if v is None or c is None or not len(v) or None in v or not np.isfinite(v).all() or not np.any(v) else np.array(v) / np.linalg.norm(v) for _, v, c in data]
    link = np.zeros((n, n), bool)
    for i, j in itertools.combinations(range(n), 2):
        if unit[i] is not None and unit[j] is not None and data[i][2] == data[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
            link[i, j] = link[j, i] = True
    label = list(range(n))
    while True:
        new = [min([label[i], *(label[j] for j in np.flatnonzero(link[i]))]) for i in range(n)]
        if new == label:
            break
        label = new
    want = {i: (int(link[i].sum()), label[i]) for i in range(n)}
    assert got == want and link.sum() > 200


@pytest.mark.parametrize("dim", [64, 384, 768])
def test_listing_is_bounded_and_finds_pairs_at_the_threshold(dim):
    draw = np.random.default_rng(dim)
    x, z = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in draw.standard_normal((2, 60, dim)))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    listed, met = 0, np.zeros(60, bool)
    for code in vectors.codes_of(dim, 30):
        a, b = code.filters(x), code.filters(y)
        listed += sum(map(len, a))
        met |= [bool(set(p) & set(q)) for p, q in zip(map(np.ndarray.tolist, a), map(np.ndarray.tolist, b), strict=True)]
    assert listed <= 20 * 60 * vectors.CODES and met.mean() >= 0.9


def test_quality(spark, texts):
    draw = random.Random(1)
    boiler = "Share this page with all of your friends today"
    own = [*texts, *[f"{boiler}\n{prose(draw, 40)}" for _ in range(80)], *[f"{boiler}\nonly {draw.randrange(9999)} six seven eight nine ten eleven" for _ in range(20)]]
    docs = table(spark, own).withColumn("source", F.lit(None).cast("string"))
    got = {r["doc_id"]: r for r in quality.judge(docs, most_docs=30, keep_share=0.5).collect()}
    for i, t in enumerate(own):
        w = words(t)
        grams = Counter(tuple(w_) for w_ in zip(*[re.findall(r"[^\x20\x09-\x0D]+", t or "")[k:] for k in range(5)], strict=False))
        raw = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        inside = {k + d for k in range(len(raw) - 4) if grams[tuple(raw[k : k + 5])] > 1 for d in range(5)}
        r = got[i]
        assert (r["n_words"], r["n_repeat_words"], r["word_chars"]) == (len(raw), len(inside), sum(map(len, raw)))
        assert r["base_failed"] == (len(raw) < 10 or 100 * len(inside) > 20 * len(raw))
        assert len(w) == len(raw)
    first = len(texts)
    assert all(got[i]["kept"] for i in range(first, first + 80)) and not any(got[i]["kept"] for i in range(first + 80, first + 100))


@pytest.mark.parametrize("part_bytes", [1 << 20, 4000])
def test_partial_matching(spark, texts, part_bytes, monkeypatch):
    """Also with parts so many that the branches of frequent pairs of bytes are dealt by three bytes, and with texts that agree in every product of their bytes' places."""
    from echomark.llm import blocks

    monkeypatch.setattr(blocks, "PART_BYTES", part_bytes)
    texts = [*texts, *([alternating(n, *ab) for n in (1024, 4096) for ab in ("ab", "ba")] if part_bytes < 1 << 20 else [])]
    docs = table(spark, texts)
    heavy = []
    monkeypatch.setattr(ppm, "triples_of", lambda *a, own=ppm.triples_of: heavy.append(int(a[3].sum())) or own(*a))
    got = {r["doc_id"]: r for r in ppm.score(docs, F.pmod("doc_id", F.lit(5)) != 1, ["doc_id"]).collect()}
    k, counts, tokens = ppm.ORDER, [defaultdict(Counter) for _ in range(ppm.ORDER + 1)], Counter()
    pad = lambda t: bytes([255]) * k + (t or "").encode() + bytes([254])
    for i, t in enumerate(texts):
        if i % 5 != 1:
            b = pad(t)
            for at in range(k, len(b)):
                for o in range(k + 1):
                    counts[o][b[at - o : at]][b[at]] += 1
            tokens.update([*words(t), None])
    n, v = sum(tokens.values()), len(tokens)

    def surprise(context, symbol):
        gone, total = set(), 0.0
        for o in range(k, -1, -1):
            seen = counts[o].get(context[k - o :])
            if seen:
                live = {x: c for x, c in seen.items() if x not in gone}
                if live:
                    mass = sum(live.values())
                    if symbol in live:
                        return total + math.log10((live[symbol] - 0.5) / mass)
                    total += math.log10(len(live) / 2 / mass)
                gone |= set(seen)
        return total - math.log10(256 - len(gone))

    for i, t in enumerate(texts):
        w, b = [*words(t), None], pad(t)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w), sum(tokens[x] > 0 for x in w), n)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((tokens[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert got[i]["score"] == pytest.approx(sum(surprise(b[at - k : at], b[at]) for at in range(k, len(b))), rel=1e-5)
    assert bool(heavy) == (part_bytes < 1 << 20) and all(0 < x < 200 for x in heavy)


def test_paragraphs(spark, texts):
    draw = random.Random(3)
    p = [prose(draw, 40) for _ in range(4)]
    inline = ". ".join(prose(draw, 12) for _ in range(5)) + "."
    own = [*texts, f"{p[0]}\n{prose(draw, 30)}", f"{prose(draw, 30)}\n\n{p[0].replace("a", "A")}", f"{prose(draw, 15)}. {inline} {prose(draw, 15)}.", f"{prose(draw, 33)}. {inline} {prose(draw, 70)}.", f"{p[2]}\n{p[2]}", prose(draw, 200)]
    got = paragraphs.clusters(spark, table(spark, own)).collect()
    first = len(texts)
    assert {first, first + 1, first + 2, first + 3, first + 4} <= {r["doc_id"] for r in got} and first + 5 not in {r["doc_id"] for r in got}
    units = [(i, k, shingle_set(line, 5)) for i, t in enumerate(own) for k, line in enumerate(x for x in (t or "").split("\n") if words(x)) if len(words(line)) >= 20]
    comps = exact_components([s for _, _, s in units], 80)
    many = Counter(comps)
    assert {(r["doc_id"], r["paragraph"]) for r in got if r["sentence"] is None} == {(i, k) for (i, k, _), c in zip(units, comps, strict=True) if many[c] > 1}
    for members in (lambda own: [list(g) for _, g in itertools.groupby(sorted(own, key=lambda r: r["cluster_id"]), key=lambda r: r["cluster_id"])])([r for r in got if r["sentence"] is None]):
        assert sum(r["kept"] for r in members) == 1


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, sf, tmp_path, name):
    for t in ("documents", "pages", "embeddings", "conversations"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_crc_is_that_of_the_decimal_digits(spark):
    assert spark.createDataFrame([(123,)], "doc_id long").select(common.id_crc()).first()[0] == zlib.crc32(b"123")


@pytest.mark.parametrize("turned", [False, True])
def test_rows_that_share_an_id(spark, turned):
    """A document of several texts: its paragraphs are found whichever row comes first, and it is linked by any of its texts."""
    draw = random.Random(21)
    lines = [prose(draw, 60) for _ in range(4)]
    near = " ".join(w if i != 17 else "edited" for i, w in enumerate(lines[2].split()))
    own = [(1, "\n".join(lines[:3])), (1, lines[3]), (2, near), (3, prose(draw, 50))]
    own = own[::-1] if turned else own
    docs = spark.createDataFrame(own, "doc_id long, text string").coalesce(1)
    got = {(r["doc_id"], r["paragraph"]): r["kept"] for r in paragraphs.clusters(spark, docs).collect()}
    assert got == {(1, 2): True, (2, 0): False}

    a, b = prose(draw, 90), prose(draw, 90)
    close = " ".join(w if i != 17 else "edited" for i, w in enumerate(b.split()))
    own = [(1, a), (1, b), (2, close), (3, prose(draw, 60)), (5, a), (5, close + " x"), (1, a), (None, a)]
    own = own[::-1] if turned else own
    docs = spark.createDataFrame(own, "doc_id long, text string").coalesce(1)
    got = sorted({(r["doc_id"] or 0, r["component_id"] or 0) for r in neardup.classes(spark, docs).collect()})
    assert got == [(0, 0), (1, 1), (2, 1), (3, 3), (5, 1)]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in neardup.keep_one(spark, docs).collect())
    assert kept == sorted([(1, a), (1, b), (3, next(t for i, t in own if i == 3)), (0, a)])


def test_an_id_ties_the_classes_of_its_texts(spark):
    """7 shares a text with 4 and another with 6, which are otherwise strangers."""
    draw = random.Random(22)
    x, y = prose(draw, 50), prose(draw, 50)
    docs = spark.createDataFrame([(4, x), (6, y), (7, x), (7, y), (8, prose(draw, 30))], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in neardup.classes(spark, docs).collect()} == {(4, 4), (6, 4), (7, 4), (8, 8)}


def test_many_short_titles_take_bounded_memory():
    """10,000 titles of six CJK letters, whose n-grams are nearly all distinct: the same bundles as one by one, in less than 500 MB."""
    import tracemalloc

    draw = random.Random(2)
    titles = ["".join(chr(draw.randrange(0x4E00, 0x9FA5)) for _ in range(6)) for _ in range(10_000)]
    language.bundles(titles[:3])
    tracemalloc.start()
    got, has = language.bundles(titles)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6 and has.all()
    for i in (0, 4999, 5000, 9999):
        counts, vectors, _ = language.profiles([titles[i]])
        assert np.array_equal(got[i], (counts @ vectors)[0])


def test_one_text_of_many_grams_is_bundled_in_parts():
    draw = random.Random(3)
    text = "".join(chr(draw.randrange(0x4E00, 0x9FA5)) for _ in range(30_000))
    counts, vectors, _ = language.profiles([text, "abc"])
    assert np.array_equal(language.bundles([text, "abc"])[0], (counts @ vectors).astype(np.float64))

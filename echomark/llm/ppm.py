"""Language-model scores by prediction by partial matching over byte contexts, with symbol exclusion.

The model is the trie of all byte contexts of up to ORDER bytes of the training texts. A node's counts are needed only where
its two latest bytes are known, so parts of the key space by those two bytes hold whole branches; the branch of a frequent pair of bytes is dealt
by three bytes. Blocks of documents ask for the grams that they hold and get the log-probability of each. Nothing of the corpus is pruned
or held in one place but the counts of byte pairs, of which there are 65,536 at most, and what follows the frequent ones, 256 counts each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .blocks import arrow_schema, blocked, packed, rows_of, table_of, table_texts
from .common import LOWER, Cut, mix, sliced, slices, span_hashes, word_bounds

#: Bytes of the longest context.
ORDER = 5
#: Symbols that UTF-8 never uses: before a text's first byte, and after its last.
START, END = 0xFF, 0xFE
#: Bytes of text in a block.
BLOCK_BYTES = 16 << 20
#: The key of the token that ends every text.
END_TOKEN = np.uint64(0)


def gram_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the texts and for their ends: the ORDER symbols before it and itself as one number. And the n + 1 places where each text's grams begin."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    wide = np.full(len(data) + n * (ORDER + 1), START, np.uint8)
    starts = offsets[:-1] + np.arange(n) * (ORDER + 1) + ORDER
    at = np.ones(len(data) + n, np.int64)
    bounds = offsets + np.arange(n + 1)
    if n:
        at[0] = ORDER
        at[bounds[1:-1]] = ORDER + 1
    at = np.cumsum(at)
    body = np.ones(len(at), bool)
    body[bounds[1:] - 1] = False
    wide[at[body]] = data
    wide[starts + sizes] = END
    keys = wide[at].astype(np.uint64)
    for back in range(1, ORDER + 1):
        keys |= wide[at - back].astype(np.uint64) << np.uint64(8 * back)
    return keys, bounds


def token_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and where each text's words begin."""
    data = LOWER[data]
    starts, ends, bounds = word_bounds(data, offsets)
    with np.errstate(over="ignore"):
        return span_hashes(data, starts, ends), bounds


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if counts is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts[:0]


class Counts:
    """Distinct keys of a block with their number in training texts, collected slice by slice."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, train: np.ndarray) -> None:
        seen, _ = counted(keys)
        known, counts = counted(keys[train])
        total = np.zeros(len(seen), np.int64)
        total[np.searchsorted(seen, known)] = counts
        self.keys.append(seen)
        self.counts.append(total)
        self.held += len(seen)
        if self.held > 4_000_000:
            self.close()

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        if self.keys:
            keys, counts = counted(np.concatenate(self.keys), np.concatenate(self.counts))
        else:
            keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.keys, self.counts, self.held = [keys], [counts], 0
        return keys, counts


def gram_part(keys: np.ndarray, parts: int, heavy: np.ndarray) -> np.ndarray:
    """Parts of grams by the two bytes before their symbols, or three where heavy says so of these two."""
    pair = (keys >> np.uint64(8)) & np.uint64(0xFFFF)
    branch = np.where(heavy[pair.astype(np.int64)], (keys >> np.uint64(8)) & np.uint64(0xFFFFFF) | np.uint64(1 << 24), pair)
    return (mix(branch) % np.uint64(parts)).astype(np.int64)


def token_part(keys: np.ndarray, parts: int, heavy: np.ndarray | None = None) -> np.ndarray:
    return (mix(keys) % np.uint64(parts)).astype(np.int64)


class Block:
    """What a block asks for: its distinct grams and tokens in the order of their parts."""

    def __init__(self, table: pa.Table, text: str, parts: int, heavy: np.ndarray):
        self.data, self.offsets = table_texts(table, text)
        train = np.array(table.column("__train").to_pylist(), bool)
        grams, tokens = Counts(), Counts()
        tokens.add(np.full(len(train), END_TOKEN), train)
        for lo, hi in slices(self.offsets):
            for into, (keys, bounds) in ((grams, gram_keys(*self.piece(lo, hi))), (tokens, token_keys(*self.piece(lo, hi)))):
                into.add(keys, np.repeat(train[lo:hi], np.diff(bounds)))
        self.kinds = []
        for into, part_of in ((grams, gram_part), (tokens, token_part)):
            keys, counts = into.close()
            part = part_of(keys, parts, heavy)
            order = np.argsort(part, kind="stable")
            self.kinds.append((keys, counts, order, np.searchsorted(part[order], np.arange(parts + 1))))

    def piece(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        return self.data[self.offsets[lo] : self.offsets[hi]], self.offsets[lo : hi + 1] - self.offsets[lo]


ASK, ASK_ARROW = arrow_schema(part="long", block="long", kind="long", keys="binary", counts="binary")
SAY, SAY_ARROW = arrow_schema(block="long", part="long", kind="long", values="binary")


def ask(text: str, parts: int, heavy: np.ndarray):
    def run(key: tuple, docs: pa.Table) -> pa.Table:
        own, rows = Block(docs, text, parts, heavy), []
        for kind, (keys, counts, order, bounds) in enumerate(own.kinds):
            for part in np.flatnonzero(np.diff(bounds)).tolist():
                at = order[bounds[part] : bounds[part + 1]]
                rows.append({"part": part, "block": key[0].as_py(), "kind": kind} | packed(keys=keys[at], counts=counts[at].astype(np.uint32)))
        return table_of(rows, ASK_ARROW)

    return run


class Level:
    """The contexts of one length: of each gram its count, of each context its total, its number of symbols, and the count of its symbols in the next shorter context."""

    def __init__(self, order: int, grams: np.ndarray, counts: np.ndarray, shorter: Level | None = None):
        self.order, self.mask = order, np.uint64((1 << (8 * (order + 1))) - 1)
        self.grams, self.counts = counted(grams & self.mask, counts)
        contexts = self.grams >> np.uint64(8)
        at = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]])) if len(contexts) else np.zeros(0, np.int64)
        self.contexts = contexts[at]
        self.symbols = np.diff(np.append(at, len(contexts)))
        below = shorter.count(self.grams & shorter.mask) if shorter else np.zeros(len(contexts), np.int64)
        self.total, self.below = (np.add.reduceat(x, at) if len(at) else x[:0] for x in (self.counts, below))

    def count(self, grams: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.grams, grams)
        at[at == len(self.grams)] = 0
        return np.where(self.grams[at] == grams, self.counts[at], 0) if len(self.grams) else np.zeros(len(grams), np.int64)

    def of(self, contexts: np.ndarray) -> tuple[np.ndarray, ...]:
        if not len(self.contexts):
            none = np.zeros(len(contexts), np.int64)
            return none, none, none
        at = np.searchsorted(self.contexts, contexts)
        at[at == len(self.contexts)] = 0
        has = self.contexts[at] == contexts
        return tuple(np.where(has, x[at], 0) for x in (self.total, self.symbols, self.below))


class Shared:
    """What every part knows: the training counts of all pairs of bytes, which pairs are heavy, and the counts of their triples (a heavy pair and the byte after it)."""

    def __init__(self, pairs: np.ndarray, heavy: np.ndarray, triples: np.ndarray, counts: np.ndarray):
        self.pairs, self.heavy, self.triples, self.counts = pairs, heavy, triples, counts


def levels_of(grams: np.ndarray, counts: np.ndarray, shared: Shared) -> list[Level]:
    """Levels 0 to ORDER: 0 and 1 from the pairs, 2 from the part's own grams and the triples of heavy pairs, the others from its own grams."""
    known = np.flatnonzero(shared.pairs).astype(np.uint64)
    own = counts > 0
    grams, counts = grams[own], counts[own]
    out = [Level(0, known, shared.pairs[known.astype(np.int64)])]
    out.append(Level(1, known, shared.pairs[known.astype(np.int64)], out[0]))
    light = ~shared.heavy[((grams >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)]
    out.append(Level(2, np.concatenate([grams[light], shared.triples]), np.concatenate([counts[light], shared.counts]), out[1]))
    for k in range(3, ORDER + 1):
        out.append(Level(k, grams, counts, out[-1]))
    return out


def log_probabilities(grams: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 of the probability of each gram's last symbol after the others.

    From the longest context that training has seen downwards: a symbol seen c times among T has probability
    (c - 1/2) / T, an escape has d / 2 / T for d different symbols. Below an escape the symbols of the longer context
    are excluded from T and d; since they all occur in the shorter context too, what they amount to there
    is a property of the longer context. Below the empty context all symbols not yet excluded are equally likely.
    """
    out = np.zeros(len(grams))
    open_ = np.arange(len(grams))
    gone_total, gone_symbols = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
    for lv in reversed(levels):
        own = grams[open_] & lv.mask
        total, symbols, below = lv.of(own >> np.uint64(8))
        count = lv.count(own)
        left, kinds = total - gone_total[open_], symbols - gone_symbols[open_]
        live = left > 0
        hit = live & (count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[open_] += np.where(hit, np.log10((count - 0.5) / left), np.where(live, np.log10(kinds / 2 / left), 0.0))
        seen = symbols > 0
        gone_total[open_] = np.where(seen, below, 0)
        gone_symbols[open_] = np.where(seen, symbols, 0)
        open_ = open_[~hit]
    out[open_] -= np.log10(256 - gone_symbols[open_])
    return out


def say(shared: Shared):
    def run(key: tuple, asked: pa.Table) -> pa.Table:
        rows, out = list(rows_of(asked)), []
        for kind in (0, 1):
            mine = [r for r in rows if r["kind"] == kind]
            if not mine:
                continue
            keys, counts = np.frombuffer(b"".join(r["keys"] for r in mine), np.uint64), np.frombuffer(b"".join(r["counts"] for r in mine), np.uint32).astype(np.int64)
            distinct, total = counted(keys, counts)
            values = log_probabilities(distinct, levels_of(distinct, total, shared)).astype(np.float32) if kind == 0 else total
            for r in mine:
                at = np.searchsorted(distinct, np.frombuffer(r["keys"], np.uint64))
                out.append({"block": r["block"], "part": r["part"], "kind": kind} | packed(values=values[at]))
        return table_of(out, SAY_ARROW)

    return run


class Lookup:
    """Values of known keys by a table of hashed slots; keys that share a slot are searched for in order."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        bits = max(8, min(24, int(len(keys)).bit_length() + 3))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, np.int32)
        self.table[self.slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.table[self.slot(keys)]
        off = np.flatnonzero(self.keys[at] != keys)
        at[off] = np.searchsorted(self.keys, keys[off])
        return self.values[at]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def corpus_facts(docs: DataFrame, text: str, parts: int) -> tuple[np.ndarray, int, int]:
    """Of the training rows: counts of byte pairs (at most 65,536), tokens, and different tokens.

    Tasks send distinct tokens to parts, which count them; counts of pairs and of tokens are summed by Spark, task by task and then by pair. So no task or driver
    holds the vocabulary, nor what all tasks have sent.
    """
    schema, arrow = arrow_schema(kind="long", part="long", n="long", keys="binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, tokens, seen = np.zeros(1 << 16, np.int64), 0, []
        for _, data, offsets in sliced(batches, text):
            keys, _ = gram_keys(data, offsets)
            pairs += np.bincount((keys & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
            words, _ = token_keys(data, offsets)
            tokens += len(words) + len(offsets) - 1
            seen.append(counted(words)[0])
            if sum(map(len, seen)) > 2_000_000:
                seen = [counted(np.concatenate(seen))[0]]
        rows = [{"kind": 0, "part": k, "n": n} for k, n in zip(np.flatnonzero(pairs).tolist(), pairs[pairs > 0].tolist(), strict=True)]
        rows.append({"kind": 1, "part": 0, "n": tokens})
        words = counted(np.concatenate(seen))[0] if seen else np.zeros(0, np.uint64)
        part = token_part(words, parts)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(bounds)).tolist():
            rows.append({"kind": 2, "part": p} | packed(keys=words[order[bounds[p] : bounds[p + 1]]]))
        yield table_of(rows, arrow).combine_chunks().to_batches()[0]

    def different(key: tuple, sent: pa.Table) -> pa.Table:
        words = counted(np.frombuffer(b"".join(sent.column("keys").to_pylist()), np.uint64))[0]
        return table_of([{"kind": 2, "part": key[0].as_py(), "n": len(words)}], arrow)

    sent = Cut(docs.sparkSession).table(docs.select(text).mapInArrow(run, schema))
    summed = sent.where("kind < 2").groupBy("kind", "part").agg(F.sum("n").alias("n"))
    counts = sent.where("kind = 2").groupBy("part").applyInArrow(different, schema).groupBy("kind").agg(F.sum("n").alias("n")).select("kind", F.lit(0).cast("long").alias("part"), "n")
    facts = summed.unionByName(counts).collect()  # 65,538 rows at most
    pairs, total = np.zeros(1 << 16, np.int64), [0, 0, 0]
    for r in facts:
        if r["kind"]:
            total[r["kind"]] = r["n"]
        else:
            pairs[r["part"]] = r["n"]
    return pairs, total[1], total[2] + (total[1] > 0)


def heavy_pairs(pairs: np.ndarray, parts: int) -> np.ndarray:
    """Pairs of bytes that come more often than half of a part's even share of all."""
    return (parts > 1) & (2 * parts * pairs > pairs.sum())


def triples_of(docs: DataFrame, text: str, parts: int, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the training rows: the triples that begin with a heavy pair, and their counts; 256 for each heavy pair at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counts()
        for _, data, offsets in sliced(batches, text):
            keys = gram_keys(data, offsets)[0] & np.uint64(0xFFFFFF)
            keys = keys[heavy[(keys >> np.uint64(8)).astype(np.int64)]]
            held.add(keys, np.ones(len(keys), bool))
        keys, counts = held.close()
        part = token_part(keys >> np.uint64(8), parts)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [{"part": p} | packed(keys=keys[order[bounds[p] : bounds[p + 1]]], counts=counts[order[bounds[p] : bounds[p + 1]]]) for p in np.flatnonzero(np.diff(bounds)).tolist()]
        yield table_of(rows, ASK_ARROW).combine_chunks().to_batches()[0] if rows else pa.RecordBatch.from_pylist([], ASK_ARROW)

    def merge(key: tuple, sent: pa.Table) -> pa.Table:
        keys, counts = counted(np.frombuffer(b"".join(sent.column("keys").to_pylist()), np.uint64), np.frombuffer(b"".join(sent.column("counts").to_pylist()), np.int64))
        return table_of([{"part": key[0].as_py()} | packed(keys=keys, counts=counts)], ASK_ARROW)

    found = docs.select(text).mapInArrow(run, ASK).groupBy("part").applyInArrow(merge, ASK).collect()
    return np.frombuffer(b"".join(bytes(r["keys"]) for r in found), np.uint64), np.frombuffer(b"".join(bytes(r["counts"]) for r in found), np.int64)


OUT = {"n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double"}


def score(docs: DataFrame, train: Column, keep: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The kept columns with n_tokens, n_known, train_tokens, base_score and score of every row.

    score is the log10 probability of the text's bytes and its end under the model of the training rows; base_score that of
    its words and its end under their smoothed frequencies. Null text counts as empty: one token, the end. Repeated rows
    count and are scored each; without training rows all symbols are equally likely; an empty table gives an empty one. A text of any length is
    scored whole, in memory in proportion to its block; columns of docs that are not kept are ignored, of kept ones those of the results' names are an error.
    """
    rows, parts = blocked(docs.select(*dict.fromkeys([*keep, doc_id, text]), train.alias("__train")), doc_id, text, BLOCK_BYTES)
    pairs, n, v = corpus_facts(docs.where(train).select(text), text, parts)
    heavy = heavy_pairs(pairs, parts)
    triples, counts = triples_of(docs.where(train).select(text), text, parts, heavy) if heavy.any() else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    schema = docs.select(*keep).schema
    for name, kind in OUT.items():
        schema = schema.add(name, kind)
    arrow = to_arrow_schema(schema)
    said = rows.groupBy("__block").applyInArrow(ask(text, parts, heavy), ASK).groupBy("part").applyInArrow(say(Shared(pairs, heavy, triples, counts)), SAY)
    scale = np.log10(n + 0.5 * (v + 1))

    def run(docs: pa.Table, said: pa.Table) -> pa.Table:
        own = Block(docs, text, parts, heavy)
        values = [np.zeros(len(own.kinds[0][0]), np.float32), np.zeros(len(own.kinds[1][0]), np.int64)]
        for r in rows_of(said):
            _, _, order, bounds = own.kinds[r["kind"]]
            values[r["kind"]][order[bounds[r["part"]] : bounds[r["part"] + 1]]] = np.frombuffer(r["values"], values[r["kind"]].dtype)
        grams, tokens = (Lookup(k[0], x) for k, x in zip(own.kinds, values, strict=True))
        total = len(own.offsets) - 1
        n_tokens, n_known, base, own_score = np.ones(total, np.int64), np.zeros(total, np.int64), np.zeros(total), np.zeros(total)
        end = int(tokens(np.full(1, END_TOKEN))[0]) if total else 0
        for lo, hi in slices(own.offsets):
            keys, bounds = gram_keys(*own.piece(lo, hi))
            own_score[lo:hi] = sums(grams(keys), bounds)
            keys, bounds = token_keys(*own.piece(lo, hi))
            counts = tokens(keys) if len(keys) else np.zeros(0, np.int64)
            n_tokens[lo:hi] += np.diff(bounds)
            n_known[lo:hi] = sums(counts > 0, bounds).astype(np.int64) + (end > 0)
            base[lo:hi] = sums(np.log10(counts + 0.5), bounds) + np.log10(end + 0.5)
        base -= n_tokens * scale
        return pa.table([*(docs.column(c) for c in keep), pa.array(n_tokens), pa.array(n_known), pa.array(np.full(total, n, np.int64)), pa.array(base), pa.array(own_score)], schema=arrow)

    return rows.groupBy("__block").cogroup(said.groupBy("block")).applyInArrow(run, schema)

"""Removal of repeated substrings by column-wise construction of a collection's Burrows-Wheeler order and common prefixes.

A document is cut at content-defined anchors: every string of `length` bytes has one least k-mer, its anchor, and a fragment is the run of
strings that share an anchor occurrence. Equal strings have equal anchors at equal offsets, so two equal strings lie in
fragments of one anchor, at one column counted from it. Fragments of anchors that occur more than once
meet in the part of their anchor, where one symbol per fragment and round is put before the suffixes sorted so far: a
stable sort by symbol gives the new order, and minima over the old common prefixes give the new ones. A string is
repeated where the common prefix with a neighbour reaches its length. Columns are kept in a sequential external file.

An anchor with very many fragments, such as a common line in differing surroundings, would bring all of them to one task. Its
fragments are cut into single strings instead, each of which is its own anchor: strings are dealt by their own
hashes, and a repeated one is one entry a block.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from .blocks import arrow_schema, blocked, packed, rows_of, table_of, table_texts
from .common import SLICE_BYTES, mix, slices

#: Bytes of a k-mer.
KMER = 16
#: Bits of a place inside one run of the anchor kernel; longer texts are taken in overlapping runs.
PLACE = 23
#: Fragments of an anchor, distinct within their blocks, beyond which they are cut into single strings: about 100 MB of bytes in one task.
HEAVY = 1 << 18
#: What a part says of a fragment: all its strings are repeated; its bytes are wanted; its result will follow.
DONE, SEND, WAIT = 1, 2, 4


# ---------------------------------------------------------------- anchors


def kmer_hashes(data: np.ndarray) -> np.ndarray:
    raw = np.concatenate([data, np.zeros(16, np.uint8)])
    wide = np.ndarray(shape=(len(data) + 8,), dtype="<u8", buffer=raw.data, strides=(1,))
    n = len(data) - KMER + 1
    return mix(wide[:n] * np.uint64(0x9E3779B97F4A7C15) ^ mix(wide[8 : 8 + n] + np.uint64(0x8EBC6AF09C88C6E3)))


def fragments_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor place, first string, last string) of all fragments, in order."""
    out = []
    for lo in range(0, max(1, len(data) - length + 1), 1 << (PLACE - 1)):
        body = data[lo : lo + (1 << (PLACE - 1)) + length - 1]
        if len(body) < length:
            break
        hashes = kmer_hashes(body)
        low = (hashes & ~np.uint64((1 << PLACE) - 1)) | np.arange(len(hashes), dtype=np.uint64)
        span, width = 1, length - KMER + 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if width > span:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        place = (low & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        n = len(place)
        valid = np.ones(n + length, bool)
        for back in (offsets[1:-1] - lo,):  # strings that would cross the end of a document
            ends = back[(back > 0) & (back < n + length)]
            marks = np.zeros(n + length + 1, np.int64)
            np.add.at(marks, np.maximum(ends - length + 1, 0), 1)
            np.add.at(marks, ends, -1)
            valid = np.cumsum(marks)[: n + length] == 0
        valid = valid[:n]
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
        first = np.flatnonzero(new)
        if not len(first):
            continue
        stops = np.flatnonzero(valid & np.concatenate([new[1:] | ~valid[1:], [True]]))
        out.append((hashes[place[first]], place[first] + lo, first + lo, stops + lo))
    if not out:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


#: Bases of the hashes of fragments: one modulo 2^64, one modulo the prime below.
BASE, SMALL_BASE, PRIME = 0x9E3779B97F4A7C15, 1_000_000_007, (1 << 31) - 1


_kept: dict[tuple[int, int | None], np.ndarray] = {}


def powers(base: int, n: int, modulus: int | None = None) -> np.ndarray:
    """The first n powers of a base, modulo 2^64 or a modulus below 2^32; those that a slice needs are kept."""
    most = SLICE_BYTES + 1
    if n <= most:
        if (base, modulus) not in _kept:
            _kept[base, modulus] = computed_powers(base, most, modulus)
        return _kept[base, modulus][:n]
    return computed_powers(base, n, modulus)


def computed_powers(base: int, n: int, modulus: int | None) -> np.ndarray:
    out = np.ones(1, np.uint64)
    step = base
    while len(out) < n:
        more = out * np.uint64(step)
        out = np.concatenate([out, more % np.uint64(modulus) if modulus else more])
        step = step * step % (modulus or 1 << 64)
    return out[:n]


class SpanHashes:
    """Hashes of long spans of bytes that overlap: differences of running sums over powers of two bases. Modulo 2^64 alone, texts of a regular pattern could meet; the prime keeps them apart."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.down = powers(pow(BASE, -1, 1 << 64), n + 1)
        self.small_down = powers(pow(SMALL_BASE, -1, PRIME), n + 1, PRIME)
        self.sums, self.small = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        symbols = data.astype(np.uint64) + np.uint64(1)
        np.cumsum(symbols * powers(BASE, n), out=self.sums[1:])
        np.cumsum(symbols * powers(SMALL_BASE, n, PRIME), out=self.small[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        p = np.uint64(PRIME)
        small = (self.small[ends] - self.small[starts]) % p * self.small_down[starts] % p  # below 2^62 in between
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64)) ^ mix(small + np.uint64(BASE))


def anchor_keys(anchors: np.ndarray, parts: int) -> np.ndarray:
    """Part and leading bits of anchors. Those that agree in both are counted together, which can only cut more of them."""
    return (anchors % np.uint64(parts)) << np.uint64(32) | anchors >> np.uint64(32)


class Fragments:
    """All fragments of a block's texts, and the distinct ones in the order of their parts; those of heavy anchors (keys) are single strings."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, parts: int, heavy: np.ndarray | None = None):
        found = []
        with np.errstate(over="ignore"):
            for lo, hi in slices(offsets):
                a, place, first, last = fragments_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], length)
                hashes = SpanHashes(data[offsets[lo] : offsets[hi]])
                if heavy is not None and len(heavy):
                    cut = np.isin(anchor_keys(a, parts), heavy)
                    many = (last - first + 1)[cut]
                    single = np.repeat(first[cut], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    own = hashes(single, single + length)
                    found.append((mix(own), own, np.zeros(len(own), np.int64), single + offsets[lo], single + offsets[lo]))
                    a, place, first, last = a[~cut], place[~cut], first[~cut], last[~cut]
                f = mix(hashes(first, last + length) ^ (place - first).astype(np.uint64))
                found.append((a, f, place - first, first + offsets[lo], last + offsets[lo]))
        self.a, self.f, self.anchor, self.first, self.last = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
        part = (self.a % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((self.f, self.a, part))
        a, f = self.a[order], self.f[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (f[1:] != f[:-1])
        at = np.flatnonzero(new)
        self.sample = order[at]  # a place of each distinct fragment
        self.times = np.diff(np.append(at, len(a)))
        self.distinct = np.empty(len(a), np.int64)  # of each fragment, its distinct one
        self.distinct[order] = np.cumsum(new) - 1
        self.parts, starts = np.unique(part[self.sample], return_index=True)
        self.bounds = np.append(starts, len(self.sample))


# ---------------------------------------------------------------- columns


def repeated_runs(lengths: np.ndarray, anchors: np.ndarray, body: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fragment, first, last) of the runs of strings that another fragment holds at the same column.

    Fragments enter from their right ends. state: order, the fragments by their suffixes from the column to the right; common, the
    length (up to `length`) of the prefix that a suffix shares with the one before it.
    """
    m = len(lengths)
    begin = int(anchors.max()) - anchors  # column of a fragment's first byte
    end = begin + lengths
    columns = int(end.max())
    starts = np.concatenate([[0], np.cumsum(lengths)])
    runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    with tempfile.TemporaryFile() as file:
        store = np.memmap(file, np.uint8, "w+", shape=(columns, m))
        for lo in range(0, m, 4096):
            hi = min(m, lo + 4096)
            chunk = np.zeros((hi - lo, columns), np.uint8)
            row = np.repeat(np.arange(hi - lo), lengths[lo:hi])
            col = np.arange(starts[hi] - starts[lo]) - np.repeat(starts[lo:hi] - starts[lo], lengths[lo:hi]) + np.repeat(begin[lo:hi], lengths[lo:hi])
            chunk[row, col] = body[starts[lo] : starts[hi]]
            store[:, lo:hi] = chunk.T
        enter = np.argsort(end, kind="stable")
        enter_at = np.searchsorted(end[enter], np.arange(columns + 2))
        order, common = np.zeros(0, np.int64), np.zeros(0, np.uint8)
        opened = np.full(m, -1, np.int64)
        for c in range(columns - 1, -1, -1):
            fresh = enter[enter_at[c + 1] : enter_at[c + 2]]
            if len(fresh):
                order, common = np.concatenate([fresh, order]), np.concatenate([np.zeros(len(fresh), np.uint8), common])
                common[len(fresh) : len(fresh) + 1] = 0
            if not len(order):
                continue
            # those without a symbol here, and those that can no longer reach the length, leave
            best = np.maximum(common, np.append(common[1:], 0)).astype(np.int64)
            stays = np.flatnonzero((begin[order] <= c) & (best + 1 + c - begin[order] >= np.minimum(length, end[order] - c)))
            symbol = store[c][order[stays]]
            at = stays[np.argsort(symbol, kind="stable")]
            ordered = store[c][order[at]]
            same = np.zeros(len(at), bool)
            same[1:] = ordered[1:] == ordered[:-1]
            k = np.flatnonzero(same)
            new = np.zeros(len(at), np.uint8)
            if len(k):
                new[k] = np.minimum(range_minima(common, at[k - 1] + 1, at[k] + 1) + 1, length)
            order, common = order[at], new
            full = common == length
            hit = full.copy()
            hit[:-1] |= full[1:]
            flagged = np.zeros(m, bool)
            flagged[order[hit]] = True
            closing = np.flatnonzero((opened >= 0) & ~flagged)
            if len(closing):
                runs.append((closing, c + 1 - begin[closing], opened[closing] - begin[closing]))
                opened[closing] = -1
            opened[flagged & (opened < 0)] = c
        closing = np.flatnonzero(opened >= 0)
        runs.append((closing, -begin[closing], opened[closing] - begin[closing]))
        del store
    return tuple(np.concatenate(x) for x in zip(*runs, strict=True))


def range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of values[lo:hi] for many non-empty ranges, from minima of ranges whose sizes are powers of two."""
    sizes = hi - lo
    level = np.frexp(sizes.astype(np.float64))[1] - 1
    out = np.empty(len(lo), np.int64)
    table, span = values, 1
    for p in range(int(level.max()) + 1):
        own = np.flatnonzero(level == p)
        if len(own):
            out[own] = np.minimum(table[lo[own]], table[hi[own] - span])
        table = np.minimum(table[:-span], table[span:]) if len(table) > span else table
        span *= 2
    return out


# ---------------------------------------------------------------- exchange

ASK, ASK_ARROW = arrow_schema(part="long", block="long", a="binary", f="binary", times="binary")
COUNT, COUNT_ARROW = arrow_schema(part="long", block="long", keys="binary", counts="binary")
SAY, SAY_ARROW = arrow_schema(block="long", part="long", codes="binary", f="binary", counts="binary", runs="binary", heavy="binary")
SEND_, SEND_ARROW = arrow_schema(part="long", block="long", f="binary", lengths="binary", anchors="binary", body="binary", wanted="binary")


def count(text: str, length: int, parts: int):
    """By part: a block's anchors, and how many distinct fragments each has there."""

    def run(key: tuple, docs: pa.Table) -> pa.Table:
        own = Fragments(*table_texts(docs, text), length, parts)
        rows = []
        for part, lo, hi in zip(own.parts.tolist(), own.bounds[:-1], own.bounds[1:], strict=True):
            keys, counts = np.unique(anchor_keys(own.a[own.sample[lo:hi]], parts).astype(np.uint32), return_counts=True)
            rows.append({"part": part, "block": key[0].as_py()} | packed(keys=keys, counts=counts.astype(np.uint32)))
        return table_of(rows, COUNT_ARROW)

    return run


def weigh(most: int):
    """To every block: which of its anchors have more than so many fragments in all blocks together."""

    def run(key: tuple, counted: pa.Table) -> pa.Table:
        rows = list(rows_of(counted))
        keys, counts = (np.frombuffer(b"".join(r[c] for r in rows), np.uint32) for c in ("keys", "counts"))
        names, at = np.unique(keys, return_inverse=True)
        heavy = names[np.bincount(at, counts) > most]
        out = []
        for r in rows if len(heavy) else []:
            own = np.intersect1d(np.frombuffer(r["keys"], np.uint32), heavy)
            if len(own):
                out.append({"block": r["block"], "part": r["part"]} | packed(heavy=own.astype(np.uint64) | np.uint64(r["part"] << 32)))
        return table_of(out, SAY_ARROW)

    return run


def heavy_of(said: list[dict]) -> np.ndarray:
    return np.frombuffer(b"".join(r["heavy"] for r in said if r["heavy"] is not None), np.uint64)


def ask(text: str, length: int, parts: int):
    """A block's distinct fragments, by part."""

    def run(key: tuple, docs: pa.Table, weighed: pa.Table) -> pa.Table:
        own = Fragments(*table_texts(docs, text), length, parts, heavy_of(list(rows_of(weighed))))
        rows = []
        for part, lo, hi in zip(own.parts.tolist(), own.bounds[:-1], own.bounds[1:], strict=True):
            s = own.sample[lo:hi]
            rows.append({"part": part, "block": key[0].as_py()} | packed(a=own.a[s], f=own.f[s], times=own.times[lo:hi]))
        return table_of(rows, ASK_ARROW)

    return run


def say(key: tuple, asked: pa.Table) -> pa.Table:
    """What every block is to do with its fragments of this part."""
    rows = list(rows_of(asked))
    counts = [len(r["a"]) // 8 for r in rows]
    a, f, times = (np.frombuffer(b"".join(r[c] for r in rows), kind) for c, kind in (("a", np.uint64), ("f", np.uint64), ("times", np.int64)))
    order = np.lexsort((f, a))
    a, f = a[order], f[order]
    new_a, new_f = np.ones(len(a), bool), np.ones(len(a), bool)
    new_a[1:] = a[1:] != a[:-1]
    new_f[1:] = new_a[1:] | (f[1:] != f[:-1])
    group, anchor = np.cumsum(new_f) - 1, np.cumsum(new_a) - 1
    many = np.bincount(group, times[order])[group] > 1
    shared = np.bincount(anchor, new_f)[anchor] > 1
    codes = np.zeros(len(a), np.uint8)
    codes[many] |= DONE
    codes[shared & new_f] |= SEND
    codes[shared & ~many] |= WAIT
    back = np.empty(len(a), np.uint8)
    back[order] = codes
    out, at = [], 0
    for r, n in zip(rows, counts, strict=True):
        out.append({"block": r["block"], "part": r["part"], "codes": back[at : at + n].tobytes()})
        at += n
    return table_of(out, SAY_ARROW)


def codes_of(own: Fragments, said: list[dict]) -> np.ndarray:
    codes = np.zeros(len(own.sample), np.uint8)
    bounds = {p: (lo, hi) for p, lo, hi in zip(own.parts.tolist(), own.bounds[:-1], own.bounds[1:], strict=True)}
    for r in said:
        if r["codes"] is not None:
            lo, hi = bounds[r["part"]]
            codes[lo:hi] = np.frombuffer(r["codes"], np.uint8)
    return codes


def send(text: str, length: int, parts: int):
    """The bytes of the fragments that parts want from a block, and the fragments whose result it waits for."""

    def run(key: tuple, docs: pa.Table, said: pa.Table) -> pa.Table:
        data, offsets = table_texts(docs, text)
        told = list(rows_of(said))
        own = Fragments(data, offsets, length, parts, heavy_of(told))
        codes = codes_of(own, told)
        rows = []
        for part, lo, hi in zip(own.parts.tolist(), own.bounds[:-1], own.bounds[1:], strict=True):
            give, wait = (own.sample[lo + np.flatnonzero(codes[lo:hi] & bit)] for bit in (SEND, WAIT))
            if len(give) or len(wait):
                sizes = own.last[give] + length - own.first[give]
                body = np.concatenate([data[x : x + n] for x, n in zip(own.first[give].tolist(), sizes.tolist(), strict=True)]) if len(give) else data[:0]
                rows.append({"part": part, "block": key[0].as_py()} | packed(f=own.f[give], lengths=sizes, anchors=own.anchor[give], body=body, wanted=own.f[wait]))
        return table_of(rows, SEND_ARROW)

    return run


def build(length: int):
    """A part's fragments put together; to every block, the runs of those it waits for."""

    def run(key: tuple, sent: pa.Table) -> pa.Table:
        rows = list(rows_of(sent))
        f = np.frombuffer(b"".join(r["f"] for r in rows), np.uint64)
        if not len(f):
            return table_of([], SAY_ARROW)
        lengths, anchors = (np.frombuffer(b"".join(r[c] for r in rows), np.int64) for c in ("lengths", "anchors"))
        body = np.frombuffer(b"".join(r["body"] for r in rows), np.uint8)
        which, first, last = repeated_runs(lengths, anchors, body, length)
        order = np.lexsort((first, f[which]))
        names, runs = f[which][order], np.stack([first[order], last[order]], axis=1).astype(np.int32)
        out = []
        for r in rows:
            wanted = np.frombuffer(r["wanted"], np.uint64)
            lo, hi = np.searchsorted(names, wanted, "left"), np.searchsorted(names, wanted, "right")
            has = np.flatnonzero(hi > lo)
            if len(has):
                counts = (hi - lo)[has]
                take = np.repeat(lo[has] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
                out.append({"block": r["block"], "part": key[0].as_py()} | packed(f=wanted[has], counts=counts, runs=runs[take]))
        return table_of(out, SAY_ARROW)

    return run


def removed_mask(data: np.ndarray, offsets: np.ndarray, length: int, parts: int, said: list[dict]) -> np.ndarray:
    """Which bytes of a block lie in a repeated string."""
    own = Fragments(data, offsets, length, parts, heavy_of(said))
    codes = codes_of(own, said)
    delta = np.zeros(len(data) + 1, np.int64)
    whole = np.flatnonzero(codes[own.distinct] & DONE) if len(own.a) else np.zeros(0, np.int64)
    np.add.at(delta, own.first[whole], 1)
    np.add.at(delta, own.last[whole] + length, -1)
    by_part = {p: (lo, hi) for p, lo, hi in zip(own.parts.tolist(), own.bounds[:-1], own.bounds[1:], strict=True)}
    places = np.argsort(own.distinct, kind="stable")
    place_at = np.searchsorted(own.distinct[places], np.arange(len(own.sample) + 1))
    for r in said:
        if r["f"] is not None:
            lo, hi = by_part[r["part"]]
            names = own.f[own.sample[lo:hi]]
            sort = np.argsort(names)
            f, counts, runs = np.frombuffer(r["f"], np.uint64), np.frombuffer(r["counts"], np.int64), np.frombuffer(r["runs"], np.int32).reshape(-1, 2)
            d = lo + sort[np.searchsorted(names, f, sorter=sort)]
            at = np.concatenate([[0], np.cumsum(counts)])
            for k, x in enumerate(d.tolist()):
                spots = own.first[places[place_at[x] : place_at[x + 1]]]
                for s, e in runs[at[k] : at[k + 1]].tolist():
                    np.add.at(delta, spots + s, 1)
                    np.add.at(delta, spots + e + length, -1)
    return np.cumsum(delta)[: len(data)] > 0


def spans(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Maximal removed runs of each document."""
    starts = mask.copy()
    edge = np.zeros(len(mask) + 1, bool)
    edge[offsets] = True
    starts[1:] &= ~mask[:-1] | edge[1:-1]
    total = np.concatenate([[0], np.cumsum(starts)])
    return total[offsets[1:]] - total[offsets[:-1]]


DIGEST = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}


def exchange(docs: DataFrame, length: int, id_: str, text: str, heavy: int) -> tuple[DataFrame, DataFrame, int]:
    """Blocks, what the parts say of them, and the number of parts."""
    rows, parts = blocked(docs, id_, text)
    bare = rows.select(id_, text, "__block") if set(docs.columns) != {id_, text} else rows
    weighed = bare.groupBy("__block").applyInArrow(count(text, length, parts), COUNT).groupBy("part").applyInArrow(weigh(heavy), SAY)
    said = bare.groupBy("__block").cogroup(weighed.groupBy("block")).applyInArrow(ask(text, length, parts), ASK).groupBy("part").applyInArrow(say, SAY)
    said = weighed.unionByName(said)
    sent = bare.groupBy("__block").cogroup(said.groupBy("block")).applyInArrow(send(text, length, parts), SEND_)
    return rows, said.unionByName(sent.groupBy("part").applyInArrow(build(length), SAY)), parts


def digests(docs: DataFrame, length: int = 200, doc_id: str = "doc_id", text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 after removing each byte that a string of `length` bytes covers which also starts elsewhere in the collection.

    Null text counts as empty, a text shorter than `length` loses nothing, equal rows are two documents, an empty table gives an
    empty one; texts of any length are cut into fragments, so a long one costs memory in proportion to itself only.
    Anchors of more than `heavy` fragments are compared string by string, which changes no result.
    """
    rows, said, parts = exchange(docs.select(doc_id, text), length, doc_id, text, heavy)
    schema = docs.select(doc_id).schema
    for name, kind in DIGEST.items():
        schema = schema.add(name, kind)
    arrow = to_arrow_schema(schema)

    def run(docs: pa.Table, said: pa.Table) -> pa.Table:
        data, offsets = table_texts(docs, text)
        mask = removed_mask(data, offsets, length, parts, list(rows_of(said)))
        gone = np.concatenate([[0], np.cumsum(mask)])
        bounds = offsets.tolist()
        shas = [hashlib.sha256(data[x:y][~mask[x:y]].tobytes()).hexdigest() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.table([docs.column(doc_id), pa.array(np.diff(offsets)), pa.array(gone[offsets[1:]] - gone[offsets[:-1]]), pa.array(spans(mask, offsets)), pa.array(shas, pa.string())], schema=arrow)

    return rows.groupBy("__block").cogroup(said.groupBy("block")).applyInArrow(run, schema)


def remove_repeats(docs: DataFrame, length: int = 200, doc_id: str = "doc_id", text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """The rows with repeated strings cut out of their texts; a character of which a byte is removed goes whole. Null texts stay null."""
    rows, said, parts = exchange(docs, length, doc_id, text, heavy)
    schema, arrow = docs.schema, to_arrow_schema(docs.schema)

    def run(docs: pa.Table, said: pa.Table) -> pa.Table:
        data, offsets = table_texts(docs, text)
        mask = removed_mask(data, offsets, length, parts, list(rows_of(said)))
        bounds, null = offsets.tolist(), docs.column(text).is_null().to_pylist()
        out = [None if gone else data[x:y][~mask[x:y]].tobytes().decode("utf-8", "ignore") for x, y, gone in zip(bounds[:-1], bounds[1:], null, strict=True)]
        return pa.table([pa.array(out, pa.string()) if f.name == text else docs.column(f.name) for f in arrow], schema=arrow)

    return rows.groupBy("__block").cogroup(said.groupBy("block")).applyInArrow(run, schema)

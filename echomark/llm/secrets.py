"""Secrets in texts: known shapes, and stretches of high entropy in a window that slides over candidate strings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced

#: Kinds of known shape, in the order in which spans of one start are listed: pattern, and the least length of its last group (of the whole where it has none).
SHAPES = (
    ("assign", re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE), 6),
    ("access", re.compile(rb"AKIA[A-Z0-9]+"), 20),
    ("hex", re.compile(rb"[0-9a-f]{24,}"), 24),  # a run of 24 or more is found from its start, whatever runs stand before it
)


class CharacterClass(NamedTuple):
    """A kind of span that the window finds: the characters of its candidate strings, and the least entropy in bits of a window that counts."""

    kind: str
    letters: str
    fold: bool
    bits: float


#: Random strings of WINDOW characters have 3.25 bits of 16 symbols (hex) and 4.0 bits of 64 on average.
CLASSES = (
    CharacterClass("entropy_hex", "0123456789abcdef", True, 3.0),
    CharacterClass("entropy_token", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", False, 3.7),
)
WINDOW = 20

#: Candidate strings that are no secrets however evenly their letters are spread: words and numbers, also joined as in paths and slugs, and UUIDs.
ALLOWED = (
    r"[A-Za-z]+[0-9]*|[0-9]+",
    r"[-_/+]*(?:[A-Za-z]+[0-9]*|[0-9]+)(?:[-_/+]+(?:[A-Za-z]+[0-9]*|[0-9]+))*[-_/+]*",
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
)
#: Candidate strings that hold one of these are examples: key names of public manuals and rows of an alphabet.
EXAMPLES = ("EXAMPLE", "example", "0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnop", "ABCDEFGHIJKLMNOP")

#: Windows of a candidate string that are counted in one column of the kernel; a longer string is counted in several, each from its own start.
SEGMENT = 256
_UNIT = 1 << 40


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes, which end where a text does."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(mask) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], mask[:-1]])
    after = np.concatenate([mask[1:], [False]])
    return np.flatnonzero(mask & (~before | edge[:-1])), np.flatnonzero(mask & (~after | edge[1:])) + 1


def high_windows(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, symbols: int, width: int, bits: float) -> np.ndarray:
    """Starts of the windows of `width` symbols inside the given runs whose Shannon entropy is at least `bits`.

    One symbol enters and one leaves per step: the sum of c log c over the window's counts changes by two table entries, for
    all runs at once. The table holds whole numbers (2^-40 bit), so a window's sum does not depend on the windows before it.
    """
    sizes = ends - starts - width + 1
    whole = sizes > 0
    starts, sizes = starts[whole], sizes[whole]
    parts = -(-sizes // SEGMENT)
    part = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(starts, parts) + part * SEGMENT
    sizes = np.minimum(np.repeat(sizes, parts) - part * SEGMENT, SEGMENT)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]

    c = np.arange(width + 1, dtype=np.float64)
    table = np.rint(c * np.log2(np.maximum(c, 1)) * _UNIT).astype(np.int64)
    up, down = np.append(np.diff(table), 0), np.concatenate([[0], -np.diff(table)])
    most = int(np.floor((np.log2(width) - bits) * width * _UNIT))  # what the sum may be at most
    counts, total = np.zeros((len(starts), symbols), np.int16), np.zeros(len(starts), np.int64)
    rows, found = np.arange(len(starts)), []
    for t in range(int(sizes[0]) + width - 1 if len(sizes) else 0):
        k = int(np.searchsorted(-sizes, width - 1 - t, "left"))  # runs that have a symbol here
        if t >= width:
            s = codes[starts[:k] + t - width]
            n = counts[rows[:k], s]
            total[:k] += down[n]
            counts[rows[:k], s] = n - 1
        s = codes[starts[:k] + t]
        n = counts[rows[:k], s]
        total[:k] += up[n]
        counts[rows[:k], s] = n + 1
        if t >= width - 1:
            found.append(starts[:k][total[:k] <= most] + t - width + 1)
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


class Windows:
    """A character class made ready: byte table, codes, allow-list."""

    def __init__(self, of: CharacterClass, width: int, allowed: tuple[str, ...], examples: tuple[str, ...]):
        self.of, self.width = of, width
        self.table, self.codes = np.zeros(256, bool), np.zeros(256, np.int64)
        for i, letter in enumerate(of.letters):
            for x in {letter, letter.upper()} if of.fold else {letter}:
                self.table[ord(x)], self.codes[ord(x)] = True, i
        self.allowed = [re.compile(x.encode()) for x in allowed]
        self.examples = [x.encode() for x in examples]

    def suppressed(self, candidate: bytes) -> bool:
        return any(x in candidate for x in self.examples) or any(x.fullmatch(candidate) for x in self.allowed)

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """Byte ranges: of each candidate string that the allow-list lets pass, the maximal stretches that windows of high entropy cover."""
        starts, ends = runs(self.table[data], offsets)
        at = high_windows(self.codes[data], starts, ends, len(self.of.letters), self.width, self.of.bits)
        covered = np.zeros(len(data) + 1, np.int32)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + self.width, -1)
        lo, hi = runs(np.cumsum(covered[:-1]) > 0, offsets)
        last, drop = -1, False
        for a, b, k in zip(lo.tolist(), hi.tolist(), (np.searchsorted(starts, lo, "right") - 1).tolist(), strict=True):
            if k != last:
                last, drop = k, self.suppressed(data[starts[k] : ends[k]].tobytes())
            if not drop:
                yield a, b


def shape_spans(data: bytes, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the known shapes in a text's bytes, leftmost and without overlap for each kind."""
    out = []
    for k, (_, pattern, least) in enumerate(SHAPES):
        for m in pattern.finditer(data, lo, hi):
            a, b = m.span(pattern.groups)
            if b - a >= least:
                out.append((m.start(), k, m.end()))
    return out


SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer"))


def scan(
    docs: DataFrame,
    keep: list[str],
    text: str = "text",
    classes: tuple[CharacterClass, ...] = CLASSES,
    width: int = WINDOW,
    allowed: tuple[str, ...] = ALLOWED,
    examples: tuple[str, ...] = EXAMPLES,
    redacted: bool = False,
) -> DataFrame:
    """The kept columns with `spans`, an array of (kind, start, end) in code points, end exclusive, by start and then kind; redacted: also with `redacted`, the text with [kind] in place of what spans cover.

    The kinds of SHAPES are always reported. Each character class adds the stretches of its candidate strings (maximal runs
    of its characters) where a window of `width` characters has its bits of entropy, unless the allow-list has the
    whole string (a pattern that matches all of it, or an example inside it) or a span of a known shape holds the stretch.

    A row's spans depend on its own text only, so nothing is shuffled. Null and empty texts have no spans; matches never
    cross texts; a text of any length is taken whole; equal rows have equal spans; an empty table gives an empty one;
    kept columns named like a result are replaced by it, other columns are ignored.
    """
    results = ["spans", "redacted"] if redacted else ["spans"]
    kept = [c for c in dict.fromkeys(keep) if c not in results]
    schema = docs.select(*kept).schema.add("spans", SPANS)
    if redacted:
        schema = schema.add("redacted", "string")
    ready = [Windows(x, width, allowed, examples) for x in classes]
    kinds = [x[0] for x in SHAPES] + [x.kind for x in classes]
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in sliced(batches, "__text"):
            raw, n = data.tobytes(), part.num_rows
            found = [shape_spans(raw, lo, hi) for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            shaped = [list(x) for x in found]
            for k, windows in enumerate(ready, len(SHAPES)):
                for a, b in windows.spans(data, offsets):
                    i = int(np.searchsorted(offsets, a, "right")) - 1
                    if not any(lo <= a and b <= hi for lo, _, hi in shaped[i]):
                        found[i].append((a, k, b))
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            spans, texts_ = [], []
            for i in range(n):
                own, first = sorted(found[i]), int(points[offsets[i]])
                spans.append([{"kind": kinds[k], "start": int(points[a]) - first, "end": int(points[b]) - first} for a, k, b in own])
                if redacted:
                    texts_.append(mask(raw, int(offsets[i]), int(offsets[i + 1]), own, kinds) if part.column("__text")[i].is_valid else None)
            columns = [*(part.column(c) for c in kept), pa.array(spans, span_type)]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(texts_, pa.string())] if redacted else []), names=schema.names)

    return docs.select(*kept, F.col(text).alias("__text")).mapInArrow(run, schema)


def mask(raw: bytes, lo: int, hi: int, spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    """A text with [kind] in place of each maximal stretch that spans cover, named by the span that begins it."""
    out, at = [], lo
    for a, k, b in spans:
        if a >= at:
            out += [raw[at:a], b"[", kinds[k].encode(), b"]"]
        at = max(at, b)
    return b"".join([*out, raw[at:hi]]).decode("utf-8", "replace")


def redact(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with secrets in `text` replaced by [kind]; null stays null, other columns stay as they are, whatever their names."""
    own = {c: f"__own_{c}" for c in docs.columns if c != text}
    found = scan(docs.withColumnsRenamed(own), list(own.values()), text, redacted=True, **options)
    return found.select(*(F.col("redacted" if c == text else own[c]).alias(c) for c in docs.columns))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, joined with commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: how many spans of each known shape it has, a digest of these, and all its spans as one string."""
    found = scan(docs, [doc_id], text)
    base = F.filter("spans", lambda x: x["kind"].isin([k for k, _, _ in SHAPES]))
    number = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(doc_id, *(number(k) for k, _, _ in SHAPES), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))

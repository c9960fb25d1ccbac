"""Byte-level BPE encoding and decoding; long unsplit text by tree concatenation."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import texts

#: The pattern of byte-level pre-tokenizers that use their standard expression (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unsplit bytes from which a piece is halved and its halves are encoded apart.
LEAF_BYTES = 256
#: Distinct pieces whose ids a worker remembers; when full it starts anew.
REMEMBERED = 200_000


def byte_letters() -> dict[str, int]:
    """The printable letters by which byte-level vocabularies write bytes: printable Latin-1 bytes stand for themselves, the others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Known(dict):
    """Ids of pieces met so far; a new one is encoded, and remembered unless it is long."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encode(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of a tokenizer file whose ids follow its merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, letters = spec["model"]["vocab"], byte_letters()
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        flags = [x for x in spec.get("added_tokens", []) if x["single_word"] or x["lstrip"] or x["rstrip"]]
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or flags or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("a byte-level tokenizer without normalizer, prefix space and stripping tokens is needed")
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in self.special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        if [vocabulary[a + b] for a, b in merges] != sorted(vocabulary[a + b] for a, b in merges):
            raise ValueError("ids must follow the order of merges")
        self.leaf = tiktoken.Encoding("leaf", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: token for token, i in ranks.items()} | {i: text.encode() for text, i in self.special.items()}
        self.digits = {i: str(i) for i in self.bytes_of}
        self.split = regex.compile(PATTERN)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known = Known(self.piece)

    # ---- one piece

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of two encoded neighbours' bytes together.

        A window of tokens around the join is encoded anew, and grows until its first token is the left side's
        and its last token the right side's. A sequence of tokens is the encoding of its bytes
        exactly when each neighbouring pair is; then all pairs outside the window are old ones, so the whole is exact.
        """
        i = j = 4
        while True:
            i, j = min(i, len(a)), min(j, len(b))
            window = self.leaf._encode_single_piece(b"".join(self.bytes_of[t] for t in chain(a[len(a) - i :], b[:j])))
            if (i == len(a) or window[0] == a[-i]) and (j == len(b) or window[-1] == b[j - 1]):
                return a[: len(a) - i] + window + b[j:]
            i, j = 2 * i, 2 * j

    def tree(self, leaves: list[list[int]]) -> list[int]:
        while len(leaves) > 1:
            leaves = [self.join(*leaves[k : k + 2]) if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
        return leaves[0]

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of a piece; one of more than LEAF_BYTES bytes is cut into leaves, whose encodings are joined in a tree."""
        body = text.encode()
        if len(body) <= LEAF_BYTES:
            return tuple(self.leaf._encode_single_piece(body))
        return tuple(self.tree([self.leaf._encode_single_piece(body[k : k + LEAF_BYTES]) for k in range(0, len(body), LEAF_BYTES)]))

    # ---- whole texts

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return [*chain.from_iterable(map(self.known.__getitem__, self.split.findall(text)))]

    def encode(self, text: str) -> list[int]:
        if not self.marks or not self.marks.search(text):
            return self.plain(text)
        return [*chain.from_iterable([self.special[x]] if x in self.special else self.plain(x) for x in self.marks.split(text) if x)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def strings(column: pa.Array) -> Iterator[str]:
    """The texts of a column; nulls are empty, bytes that are not UTF-8 become U+FFFD."""
    data, offsets = texts(column)
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield data[lo:hi].tobytes().decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """The rows with an array<int> column of the text's ids. Null counts as empty: no ids."""
    docs = docs.drop(ids)
    schema = StructType([*docs.schema.fields]).add(ids, ArrayType(IntegerType()))
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                out = [own.encode(x) for x in strings(part.column(text))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(out, pa.list_(pa.int32()))], names=[*columns, ids])

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """The rows with a string column of the ids' text; byte sequences that are not UTF-8 become U+FFFD, null ids the empty text."""
    tokens = tokens.drop(text)
    schema = StructType([*tokens.schema.fields]).add(text, "string")
    columns = tokens.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                out = [own.decode(x or []) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(out, pa.string())], names=[*columns, text])

    return tokens.mapInArrow(run, schema)


def digest(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, n_tokens, ids_sha256 and decoded_sha256 of every text, encoded and decoded in one pass so that neither ids nor texts leave the worker.

    Null text counts as empty; bytes that are not UTF-8 count as U+FFFD; texts of any length are encoded whole; repeated rows give repeated rows;
    an empty table gives an empty one; columns that are not kept are left out, whatever their names.
    """
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            counts, a, b = np.zeros(batch.num_rows, np.int64), [], []
            for i, body in enumerate(strings(batch.column(text))):
                ids = own.encode(body)
                counts[i] = len(ids)
                a.append(hashlib.sha256(",".join(map(own.digits.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(counts), pa.array(a, pa.string()), pa.array(b, pa.string())], names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)

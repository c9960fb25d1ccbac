"""Blocks of documents that exchange packed arrays with parts of a keyed table.

A kernel that needs corpus-wide facts about millions of small keys sends, per block of documents and part of the key space, one row that packs
its distinct keys; a part answers each block with one row. What a block or part holds is bounded by the block's bytes and
by the number of parts, both of which follow the input's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Bytes of text in a block, and in the texts that one part of the key space answers for.
BLOCK_BYTES = 4 << 20
PART_BYTES = 24 << 20


def blocked(docs: DataFrame, id_: str, text: str, block_bytes: int | None = None) -> tuple[DataFrame, int]:
    """The rows with a column __block, and the number of parts. Blocks are drawn from ids, rows with one id share theirs."""
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    blocks = max(1, -(-size // (block_bytes or BLOCK_BYTES)))
    return docs.withColumn("__block", F.pmod(F.xxhash64(F.col(id_)), F.lit(blocks))), max(1, -(-size // PART_BYTES))


def packed(**arrays: np.ndarray) -> dict[str, bytes]:
    return {k: np.ascontiguousarray(v).tobytes() for k, v in arrays.items()}


def rows_of(table: pa.Table):
    """Dicts of a table whose binary columns stay bytes, a row at a time."""
    names = table.column_names
    for batch in table.to_batches():
        columns = [batch.column(i) for i in range(len(names))]
        for i in range(batch.num_rows):
            yield {n: c[i].as_py() for n, c in zip(names, columns, strict=True)}


def table_of(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array([r.get(f.name) for r in rows], f.type) for f in schema}, schema=schema)


def arrow_schema(**kinds: str) -> tuple[str, pa.Schema]:
    """A Spark and an Arrow schema; a kind is long or binary."""
    to = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return ", ".join(f"{k} {v}" for k, v in kinds.items()), pa.schema([(k, to[v]) for k, v in kinds.items()])


def table_texts(table: pa.Table, text: str) -> tuple[np.ndarray, np.ndarray]:
    return texts(table.column(text))

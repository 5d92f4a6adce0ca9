"""Texts in bounded blocks, and the exchange of packed hash arrays between blocks.

A block is a set of whole texts, chosen by a hash, of about ``block_bytes`` bytes. Work inside a
block runs on arrays. What blocks must agree on (who else has this hash, who has it first) goes
through *buckets*: a block sends each bucket one row with its distinct hashes as packed bytes, so
a hash that fills a third of the corpus is sent once per block, and a bucket never holds more than
its share of distinct (block, hash) pairs. The exchange that puts texts into blocks is the same
sub-plan in every pass, so Spark runs it once and reuses its files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.hashing import U64

BLOCK_BYTES = 3 << 20
#: Buckets are as many as blocks, up to this number; above it each bucket holds more keys.
MAX_BUCKETS = 1 << 16


def text_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """``(block, id, text)`` and the number of blocks. The hash covers id and text, so repeated ids spread."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, int(-(-total // block_bytes)))
    return rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(count)).cast("int").alias("block"), "id", "text"), count


def buckets_for(blocks: int) -> int:
    return min(blocks, MAX_BUCKETS)


def pack(block: int, buckets: int, key: np.ndarray, **values: np.ndarray) -> pa.Table:
    """One row per bucket: ``key`` and ``values`` of the entries whose key falls there, in the given order."""
    bucket = ((key >> U64(33)) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(cuts[1:], len(bucket))[: len(cuts)]
    columns = {"bucket": pa.array(bucket[cuts], pa.int32()), "block": pa.array([block] * len(cuts), pa.int32())}
    for name, array in {"key": key, **values}.items():
        array = array[order]
        columns[name] = pa.array([array[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())
    return pa.table(columns)


def unpack(table: pa.Table, **dtypes: type) -> tuple[np.ndarray, ...]:
    """The block of every entry, then ``key`` and the named values, of all rows of a bucket or block."""
    out, count = [], None
    for name, dtype in {"key": U64, **dtypes}.items():
        parts = [np.frombuffer(x, dtype=dtype) for x in table.column(name).to_pylist()]
        count = count or [len(p) for p in parts]
        out.append(np.concatenate(parts) if parts else np.empty(0, dtype))
    return (np.repeat(table.column("block").to_numpy().astype(np.int64), count or []), *out)


def to_blocks(block: np.ndarray, **arrays: np.ndarray) -> pa.Table:
    """One row per block with its entries as packed bytes."""
    order = np.argsort(block, kind="stable")
    block = block[order]
    cuts = np.flatnonzero(np.diff(block, prepend=-1))
    ends = np.append(cuts[1:], len(block))[: len(cuts)]
    columns = {"block": pa.array(block[cuts], pa.int32())}
    for name, array in arrays.items():
        array = array[order]
        columns[name] = pa.array([array[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())
    return pa.table(columns)


def gather(table: pa.Table, name: str, dtype: type) -> np.ndarray:
    """All packed entries of one column of a block's rows."""
    parts = [np.frombuffer(x, dtype=dtype) for x in table.column(name).to_pylist()]
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def ordered(table: pa.Table) -> pa.Table:
    """A block's texts by id, then text; a missing id comes first."""
    return table.take(pc.sort_indices(table, sort_keys=[("id", "ascending"), ("text", "ascending")], null_placement="at_start"))


def split_groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts ``key``, and the number of the group of equal keys at each sorted place."""
    order = np.argsort(key, kind="stable")
    group = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
    return order, group


def cogroup(left: DataFrame, right: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Work on each block's rows of two frames. The lambda hides ``self`` from Spark's count of arguments."""
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(lambda a, b: fn(a, b), schema)


def batched(batches: Iterator[pa.RecordBatch], limit: int, column: str) -> Iterator[pa.Table]:
    """Batches of a partition cut or joined to tables of about ``limit`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place = (size + np.cumsum(lengths) - lengths) // limit
        for part in np.unique(place):
            rows = np.flatnonzero(place == part)
            if part > 0 and held:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(batch.slice(int(rows[0]), len(rows)))
            size += int(lengths[rows].sum())
    if held:
        yield pa.Table.from_batches(held)

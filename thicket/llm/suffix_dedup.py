"""De-duplication of long repeated passages with sparse suffix arrays.

Suffixes are retained only where a word 8-gram is the smallest, by hash, of all 8-grams in some
window of ``window`` words. The choice depends on the words alone, so two equal windows retain a
suffix at the same distance from their starts. Retained suffixes are sorted by their content and
compared with their neighbours in that order; the longest common prefix of a suffix with any other
one is the one with a neighbour. Each match is then extended to the left and right: a window is
followed up only if the common prefix from its retained suffix reaches its end, and then its whole
content decides. The first occurrence stays; words of later ones are removed.

A passage that repeats with at least ``window`` words is found wherever it lies; shorter repeats are
left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from thicket.llm import blocks as B
from thicket.llm.hashing import U64, Words, window_hashes, words
from thicket.llm.substring_dedup import OUT, firsts, id_numbers, later_windows, pack_windows, remove

GRAM = 8
#: Words of a suffix that its sort key tells apart: one 8-gram and four more, shortened to 16 bits each.
CHUNKS = 4


def minimisers(gram: np.ndarray, span: int) -> np.ndarray:
    """For every run of ``span`` hashes, the place of its smallest one; the leftmost of equal ones."""
    n = len(gram) - span + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    best, width = np.arange(len(gram)), 1
    while width * 2 <= span:
        left, right = best[:-width], best[width:]
        best, width = np.where(gram[right] < gram[left], right, left), width * 2
    left, right = best[:n], best[span - width : span - width + n]
    return np.where(gram[right] < gram[left], right, left)


def retained(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of retained suffixes, the hash of their first 8-gram, and the packed next four 8-grams."""
    gram = window_hashes(w.hashes(), GRAM)
    starts = w.whole(window)
    at = np.unique(minimisers(gram, window - GRAM + 1)[starts]) if len(starts) else starts
    after = np.zeros(len(at), dtype=U64)
    for chunk in range(1, CHUNKS + 1):
        next_at = at + chunk * GRAM
        inside = next_at + GRAM <= w.first[w.doc[at] + 1]
        part = np.zeros(len(at), dtype=U64)
        part[inside] = gram[next_at[inside]] >> U64(48)
        after = (after << U64(16)) | part
    return at, gram[at], after


def common_chunks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading 16-bit parts two packed keys share."""
    differ = a ^ b
    out = np.zeros(len(a), dtype=np.int64)
    for chunk in range(1, CHUNKS + 1):
        out += (differ >> U64(64 - 16 * chunk)) == 0
    return out


def neighbours(table: pa.Table) -> pa.Table:
    """Sort the suffixes of one bucket and give each the most words it can share with another one."""
    block, key, after, twice = B.unpack(table, after=U64, twice=np.uint8)
    order = np.lexsort((after, key))
    k, a = key[order], after[order]
    shared = np.where(k[1:] == k[:-1], common_chunks(a[1:], a[:-1]), -1)
    best = np.full(len(key), -1, dtype=np.int64)
    best[1:] = shared
    best[:-1] = np.maximum(best[:-1], shared)
    best[twice[order].astype(bool)] = CHUNKS
    reach = np.where(best == CHUNKS, 255, GRAM * (best + 2) - 1).astype(np.uint8)
    found = best >= 0
    pick = order[found]
    return B.to_blocks(block[pick], key=key[pick], after=after[pick], reach=reach[found])


def dedup_passages(
    docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = B.BLOCK_BYTES
) -> DataFrame:
    """Remove later occurrences of passages of at least ``window`` words (8 at least).

    Returns one row per input row: ``id_col``, ``n_words``, ``n_removed``, ``removed`` (word spans,
    end exclusive) and ``kept_text`` (kept words joined by one space). Null, blank and short texts
    lose nothing. A null id counts as the smallest; of repeated rows one keeps its words. Other
    columns are ignored. An empty table gives an empty result.
    """
    if window < GRAM:
        raise ValueError(f"window must be at least {GRAM} words")
    id_type = docs.schema[id_col].dataType.simpleString()
    arrow_id = {"bigint": pa.int64(), "int": pa.int32()}.get(id_type, pa.int64())
    texts, count = B.text_blocks(docs, id_col, text_col, block_bytes)
    buckets = B.buckets_for(count)

    def suffixes(table: pa.Table) -> pa.Table:
        _, key, after = retained(words(table.column("text")), window)
        pair = np.stack([key, after], axis=1)
        lead, group = firsts(pair)
        twice = (np.bincount(group) > 1).astype(np.uint8) if len(pair) else np.empty(0, np.uint8)
        return B.pack(table.column("block")[0].as_py(), buckets, key[lead], after=after[lead], twice=twice)

    def extended(table: pa.Table, found: pa.Table) -> pa.Table:
        empty = pa.table({"bucket": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in ("key", "low", "doc")}})
        if not len(table) or not len(found):
            return empty
        table = B.ordered(table)
        w = words(table.column("text"))
        at, key, after = retained(w, window)
        known = np.stack([B.gather(found, "key", U64), B.gather(found, "after", U64)], axis=1)
        reach_of = B.gather(found, "reach", np.uint8)
        _, group = firsts(np.concatenate([known, np.stack([key, after], axis=1)]))
        reach = np.zeros(group.max() + 1, dtype=np.int64)
        reach[group[: len(known)]] = np.where(reach_of == 255, window, reach_of)
        reach = np.minimum(reach[group[len(known) :]], window)
        at, reach = at[reach > 0], reach[reach > 0]
        low, high = np.maximum(at - (window - GRAM), 0), at + reach - window
        low, high = low[high >= low], high[high >= low]
        step = np.zeros(len(w) + 1, dtype=np.int64)
        np.add.at(step, low, 1)
        np.add.at(step, high + 1, -1)
        near = np.cumsum(step)[:-1] > 0
        starts = w.whole(window)
        starts = starts[near[starts]]
        return pack_windows(table.column("block")[0].as_py(), buckets, w, id_numbers(table.column("id")), starts, window) if len(starts) else empty

    def final(table: pa.Table, later: pa.Table) -> pa.Table:
        return remove(table, later, window, arrow_id)

    sent = texts.groupBy("block").applyInArrow(suffixes, "bucket int, block int, key binary, after binary, twice binary")
    found = sent.groupBy("bucket").applyInArrow(neighbours, "block int, key binary, after binary, reach binary")
    full = B.cogroup(texts, found, extended, "bucket int, block int, key binary, low binary, doc binary")
    later = full.groupBy("bucket").applyInArrow(later_windows, "block int, key binary, low binary")
    return B.cogroup(texts, later, final, OUT.format(id=id_type)).withColumnRenamed("id", id_col)

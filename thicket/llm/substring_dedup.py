"""Exact substring de-duplication with difference-cover anchors.

A window is ``window`` consecutive words of one text. A window repeats if its word sequence also
starts earlier: in a text with a smaller id, or earlier in the same text. Every word covered by a
repeating window is removed.

Anchors are hashed only where the place in the text, modulo ``period``, lies in a difference cover.
For any two places there is a shift below ``period`` that brings both into the cover, so two equal
windows share an anchor of ``window - period + 1`` words at the same distance from their starts.
Anchors that occur once are dropped; only windows that hold a repeated anchor are then extended to
their full length, hashed with 128 bits and given to their first occurrence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from thicket.llm import blocks as B
from thicket.llm.hashing import U64, Words, covered, window_hashes, words

#: Perfect difference sets by period; every difference modulo the period occurs once.
COVERS = {
    1: (0,),
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
}
#: Anchors are at least this long where the window allows it; shorter ones repeat by chance.
ANCHOR_WORDS = 8

OUT = "id {id}, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string"


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The sparsest cover that still leaves a long anchor inside a window."""
    fits = [p for p in COVERS if window - p + 1 >= min(ANCHOR_WORDS, window)]
    return max(fits), COVERS[max(fits)]


def _anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of every cover-aligned anchor."""
    period, cover = cover_for(window)
    size = window - period + 1
    at = w.whole(size)
    at = at[np.isin(w.position()[at] % period, cover)]
    return at, window_hashes(w.hashes(), size)[at]


def repeated_keys(table: pa.Table) -> pa.Table:
    """Of one bucket: to each block, its keys that another block has too or that it has twice itself."""
    block, key, twice = B.unpack(table, twice=np.uint8)
    order, group = B.split_groups(key)
    size = np.bincount(group)
    often = np.zeros(len(key), dtype=bool)
    often[order] = size[group] > 1
    often |= twice.astype(bool)
    return B.to_blocks(block[often], key=key[often])


def distinct_keys(block: int, buckets: int, key: np.ndarray) -> pa.Table:
    key, count = np.unique(key, return_counts=True)
    return B.pack(block, buckets, key, twice=(count > 1).astype(np.uint8))


def id_numbers(ids: pa.ChunkedArray) -> np.ndarray:
    """Integer ids as numbers that keep their order; a missing id is the smallest."""
    return ids.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy().astype(np.int64)


def window_pairs(w: Words, at: np.ndarray, window: int) -> np.ndarray:
    """128-bit hashes of the windows at ``at``, as two columns."""
    return np.stack([window_hashes(w.hashes(k), window, k)[at] for k in (0, 1)], axis=1)


def firsts(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of two hashes: index of the first row of each distinct pair, and the pair's number per row."""
    order = np.lexsort((np.arange(len(pair)), pair[:, 1], pair[:, 0]))
    new = np.ones(len(pair), dtype=bool)
    new[1:] = (pair[order][1:] != pair[order][:-1]).any(axis=1)
    group = np.empty(len(pair), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


def pack_windows(block: int, buckets: int, w: Words, ids: np.ndarray, at: np.ndarray, window: int) -> pa.Table:
    """The distinct windows of a block with the smallest id that holds each."""
    pair = window_pairs(w, at, window)
    lead, _ = firsts(pair)
    return B.pack(block, buckets, pair[lead, 0], low=pair[lead, 1], doc=ids[w.doc[at[lead]]])


def later_windows(table: pa.Table) -> pa.Table:
    """Of one bucket: to each block, its windows that another block holds earlier."""
    block, high, low, doc = B.unpack(table, low=U64, doc=np.int64)
    order = np.lexsort((block, doc, low, high))
    h, l = high[order], low[order]
    later = np.zeros(len(h), dtype=bool)
    later[1:] = (h[1:] == h[:-1]) & (l[1:] == l[:-1])
    pick = order[later]
    return B.to_blocks(block[pick], key=high[pick], low=low[pick])


def member(pair: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Which rows of ``pair`` are among the given pairs."""
    if not len(high) or not len(pair):
        return np.zeros(len(pair), dtype=bool)
    both = np.concatenate([np.stack([high, low], axis=1), pair])
    _, group = firsts(both)
    there = np.zeros(group.max() + 1, dtype=bool)
    there[group[: len(high)]] = True
    return there[group[len(high) :]]


def remove(table: pa.Table, later: pa.Table, window: int, id_type: pa.DataType) -> pa.Table:
    """Texts of a block without the words that later windows cover."""
    table = B.ordered(table)
    w = words(table.column("text"))
    at = w.whole(window)
    gone = np.zeros(len(w), dtype=bool)
    if len(at):
        pair = window_pairs(w, at, window)
        lead, group = firsts(pair)
        repeats = np.ones(len(at), dtype=bool)
        repeats[lead] = False
        repeats |= member(pair, B.gather(later, "key", U64), B.gather(later, "low", U64))
        gone = covered(len(w), at[repeats], window)
    n_words = np.diff(w.first)
    removed, spans, texts = [], [], []
    for row, text in enumerate(table.column("text").to_pylist()):
        a, b = w.first[row], w.first[row + 1]
        own = gone[a:b]
        split = (text or "").encode().split()
        removed.append(int(own.sum()))
        if removed[-1]:
            edge = np.diff(own.astype(np.int8), prepend=0, append=0)
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), strict=True)])
            split = [split[i] for i in np.flatnonzero(~own)]
        else:
            spans.append([])
        texts.append(b" ".join(split).decode())
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({
        "id": table.column("id").cast(id_type), "n_words": pa.array(n_words, pa.int64()),
        "n_removed": pa.array(removed, pa.int64()), "removed": pa.array(spans, span), "kept_text": pa.array(texts, pa.string()),
    })


def dedup_substrings(
    docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = B.BLOCK_BYTES
) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that occurs earlier.

    Returns one row per input row: ``id_col``, ``n_words``, ``n_removed``, ``removed`` (word spans,
    end exclusive) and ``kept_text`` (kept words joined by one space). A null or blank text, or one
    shorter than a window, keeps all its words (none for null). A null id counts as the smallest;
    rows with equal ids are ordered by block, then text, so of repeated rows one keeps its words.
    Other columns are ignored. An empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    arrow_id = {"bigint": pa.int64(), "int": pa.int32()}.get(id_type, pa.int64())
    texts, count = B.text_blocks(docs, id_col, text_col, block_bytes)
    buckets = B.buckets_for(count)

    def anchors(table: pa.Table) -> pa.Table:
        _, key = _anchors(words(table.column("text")), window)
        return distinct_keys(table.column("block")[0].as_py(), buckets, key)

    def candidates(table: pa.Table, repeated: pa.Table) -> pa.Table:
        empty = pa.table({"bucket": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in ("key", "low", "doc")}})
        if not len(table) or not len(repeated):
            return empty
        table = B.ordered(table)
        w = words(table.column("text"))
        at, key = _anchors(w, window)
        at = at[np.isin(key, B.gather(repeated, "key", U64))]
        period, _ = cover_for(window)
        near = np.zeros(len(w), dtype=bool)
        for shift in range(period):
            near[at[at >= shift] - shift] = True
        starts = w.whole(window)
        starts = starts[near[starts]]
        return pack_windows(table.column("block")[0].as_py(), buckets, w, id_numbers(table.column("id")), starts, window) if len(starts) else empty

    def final(table: pa.Table, later: pa.Table) -> pa.Table:
        return remove(table, later, window, arrow_id)

    sent = texts.groupBy("block").applyInArrow(anchors, "bucket int, block int, key binary, twice binary")
    repeated = sent.groupBy("bucket").applyInArrow(repeated_keys, "block int, key binary")
    full = B.cogroup(texts, repeated, candidates, "bucket int, block int, key binary, low binary, doc binary")
    later = full.groupBy("bucket").applyInArrow(later_windows, "block int, key binary, low binary")
    return B.cogroup(texts, later, final, OUT.format(id=id_type)).withColumnRenamed("id", id_col)

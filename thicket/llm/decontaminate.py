"""Benchmark decontamination with one FM-index per shard of training texts.

A shard is a few megabytes of whole texts as Spark reads them; nothing is shuffled. Words become
numbers in the benchmark's vocabulary. A word outside it ends a segment, as no phrase can cross it;
segments shorter than the shortest phrase cannot hold one. The segments, joined by distinct
separators, are indexed: suffix array, Burrows-Wheeler transform, and a wavelet matrix that answers
"how often does this word stand in front" by bit ranks. All phrases are searched backwards at once;
their places come from sampled suffix positions; overlapping places merge into removal spans.

The benchmark's windows are written to the shared folder in blocks of about ``phrase_bytes`` of text,
by the tasks that cut them, and so are the distinct word hashes of the whole benchmark, which are the
vocabulary. A shard is indexed once; then the blocks are mapped from their files and searched one by
one. The driver only learns the names of the files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm import blocks as B
from thicket.llm.hashing import ALNUM, Words, words
from thicket.llm.shared_files import mapped, new_folder, write
from thicket.session import stage

SHARD_BYTES = 4 << 20
#: Every so many places of a shard, the suffix array keeps the position.
SAMPLE = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. Zeros are separators, each its own symbol; the last symbol is one.

    Only places whose rank is still shared are sorted again; as separators differ, no tie outlives
    the longest segment.
    """
    n = len(symbols)
    value = symbols.astype(np.int64)
    stops = np.flatnonzero(symbols == 0)
    value[symbols > 0] += len(stops)
    value[stops] = np.arange(len(stops))
    order = np.argsort(value, kind="stable")
    new = np.diff(value[order], prepend=-1) != 0
    start = np.flatnonzero(new)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = start[np.cumsum(new) - 1]
    open_ = order[np.repeat(np.diff(np.append(start, n)) > 1, np.diff(np.append(start, n)))]
    step = 1
    while len(open_):
        old, ahead = rank[open_], rank[open_ + step]
        order = np.lexsort((ahead, old))
        at, old, ahead = open_[order], old[order], ahead[order]
        index = np.arange(len(at))
        group = np.diff(old, prepend=-1) != 0
        run = group | (np.diff(ahead, prepend=-1) != 0)
        in_group = np.maximum.accumulate(np.where(group, index, 0))
        in_run = np.maximum.accumulate(np.where(run, index, 0))
        rank[at] = old + in_run - in_group
        length = np.diff(np.append(np.flatnonzero(run), len(at)))
        open_ = at[np.repeat(length > 1, length)]
        step *= 2
    out = np.empty(n, dtype=np.int64)
    out[rank] = np.arange(n)
    return out


class WaveletMatrix:
    """Ranks of any symbol in a sequence, one bit row per binary digit of the symbols."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.depth = max(1, int(symbols).bit_length())
        self.ones, self.zeros = [], []
        now = sequence
        for level in range(self.depth - 1, -1, -1):
            bit = (now >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.first = self._down(np.arange(symbols + 1), np.zeros(symbols + 1, dtype=np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for row, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.depth - 1 - row)) & 1
            rank = ones[at]
            at = np.where(bit == 1, zeros + rank, at - rank)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._down(symbol, at) - self.first[symbol]

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before it."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            rank = ones[at]
            bit = ones[at + 1] - rank
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, zeros + rank, at - rank)
        return symbol, at - self.first[symbol]


class FMIndex:
    """Backward search and location in a sequence of symbols; zeros separate."""

    def __init__(self, symbols: np.ndarray, largest: int):
        order = suffix_array(symbols)
        before = symbols[order - 1]
        self.matrix = WaveletMatrix(before, largest)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=largest + 1))])
        kept = (order % SAMPLE == 0) | (before == 0)
        self.kept, self.kept_rank, self.position = kept, np.cumsum(kept) - 1, order[kept]

    def search(self, phrase: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that begin with each phrase; phrases are padded on the right."""
        low = np.zeros(len(length), dtype=np.int64)
        high = np.full(len(length), self.below[-1], dtype=np.int64)
        for step in range(int(length.max(initial=0))):
            live = np.flatnonzero((length > step) & (low < high))
            symbol = phrase[live, length[live] - 1 - step]
            low[live] = self.below[symbol] + self.matrix.rank(symbol, low[live])
            high[live] = self.below[symbol] + self.matrix.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Positions of suffixes, walking back to the nearest sampled one."""
        at, steps = at.copy(), np.zeros(len(at), dtype=np.int64)
        walking = np.flatnonzero(~self.kept[at])
        while len(walking):
            symbol, rank = self.matrix.access_rank(at[walking])
            at[walking] = self.below[symbol] + rank
            steps[walking] += 1
            walking = walking[~self.kept[at[walking]]]
        return self.position[self.kept_rank[at]] + steps


@dataclass
class Phrases:
    """Distinct windows of a block of benchmark items, as numbers in their own vocabulary."""

    vocabulary: np.ndarray
    phrase: np.ndarray
    length: np.ndarray
    item_first: np.ndarray
    item: np.ndarray
    names: list[str | None]

    @classmethod
    def of(cls, names: list, texts: pa.ChunkedArray, window: int) -> Phrases:
        w = words(texts, ALNUM, lower=True)
        vocabulary = np.unique(w.hashes())
        number = np.searchsorted(vocabulary, w.hashes()) + 1
        count = np.diff(w.first)
        starts, lengths, items = [w.whole(window)], [], []
        lengths.append(np.full(len(starts[0]), window))
        items.append(w.doc[starts[0]])
        short = np.flatnonzero((count > 0) & (count < window))
        starts.append(w.first[short]), lengths.append(count[short]), items.append(short)
        start, length, item = map(np.concatenate, (starts, lengths, items))
        padded = np.concatenate([number, np.zeros(window, dtype=np.int64)])
        phrase = padded[start[:, None] + np.arange(window)] if len(start) else np.zeros((0, window), np.int64)
        phrase[np.arange(window) >= length[:, None]] = 0
        phrase, which = np.unique(phrase, axis=0, return_inverse=True)
        which = which.reshape(-1)
        pair = np.unique(np.stack([which, item], axis=1), axis=0) if len(which) else np.zeros((0, 2), np.int64)
        first = np.searchsorted(pair[:, 0], np.arange(len(phrase) + 1))
        return cls(vocabulary, phrase, (phrase > 0).sum(axis=1), first, pair[:, 1], [None if n is None else str(n) for n in names])

    def save(self, uri: str) -> None:
        """One row with a list for each part."""
        arrays = {"vocabulary": self.vocabulary, "phrase": self.phrase.ravel(), "length": self.length, "item_first": self.item_first, "item": self.item}
        columns = {n: pa.array([a], pa.list_(pa.from_numpy_dtype(a.dtype))) for n, a in arrays.items()}
        save(uri, pa.table(columns | {"names": pa.array([self.names], pa.list_(pa.string()))}))

    @classmethod
    def load(cls, uri: str, known: np.ndarray) -> Phrases:
        """A mapped block, its phrases numbered in the vocabulary ``known`` of the whole benchmark."""
        table = load(uri)
        parts = {n: table[n].chunk(0).flatten() for n in table.column_names}
        own = {n: parts[n].to_numpy() for n in ("vocabulary", "phrase", "length", "item_first", "item")}
        number = np.concatenate([[0], np.searchsorted(known, own["vocabulary"]) + 1])
        phrase = number[own["phrase"]].reshape(len(own["length"]), -1)
        return cls(known, phrase, own["length"], own["item_first"], own["item"], parts["names"].to_pylist())


def save(uri: str, table: pa.Table) -> None:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema) as out:
        out.write_table(table)
    write(uri, sink.getvalue())


def load(uri: str) -> pa.Table:
    return pa.ipc.open_file(mapped(uri)).read_all()


def index_shard(w: Words, vocabulary: np.ndarray, shortest: int) -> tuple[FMIndex | None, np.ndarray]:
    """The index of a shard's segments of ``shortest`` words or more, and the word that stands at each of its places."""
    h = w.hashes()
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    known = np.flatnonzero(vocabulary[at] == h) if len(vocabulary) else np.empty(0, np.int64)
    if not len(known):
        return None, known
    begins = (np.diff(known, prepend=-2) != 1) | (np.diff(w.doc[known], prepend=-1) != 0)
    start = np.flatnonzero(begins)
    length = np.diff(np.append(start, len(known)))
    enough = length >= shortest
    known, segment = known[np.repeat(enough, length)], np.repeat(np.arange(int(enough.sum())), length[enough])
    if not len(known):
        return None, known
    place = np.arange(len(known)) + segment + 1
    symbols = np.zeros(int(place[-1]) + 2, dtype=np.int64)
    symbols[place] = at[known] + 1
    word = np.full(len(symbols), -1, dtype=np.int64)
    word[place] = known
    return FMIndex(symbols, len(vocabulary)), word


def find(w: Words, index: FMIndex, word: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words the phrases of one block hit, and the distinct (text, item) pairs."""
    low, high = index.search(phrases.phrase, phrases.length)
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    at = np.repeat(low, count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    first = word[index.locate(at)]
    step = np.zeros(len(w) + 1, dtype=np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + phrases.length[which], -1)
    hit = np.cumsum(step[:-1]) > 0
    pair = np.unique(np.stack([w.doc[first], which], axis=1), axis=0)
    items = phrases.item_first[pair[:, 1] + 1] - phrases.item_first[pair[:, 1]]
    doc = np.repeat(pair[:, 0], items)
    item = phrases.item[np.repeat(phrases.item_first[pair[:, 1]], items) + np.arange(len(doc)) - np.repeat(np.cumsum(items) - items, items)]
    both = np.unique(np.stack([doc, item], axis=1), axis=0)
    return hit, both[:, 0], both[:, 1]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _search(batches: Iterator[pa.RecordBatch], blocks: list[str], vocabulary: str, shortest: int) -> Iterator[pa.RecordBatch]:
    known = load(vocabulary)["hash"].combine_chunks().to_numpy().view(np.uint64)
    one = Phrases.load(blocks[0], known) if len(blocks) == 1 else None  # a single block is read once
    for table in B.batched(batches, SHARD_BYTES, "text"):
        w = words(table.column("text"), ALNUM, lower=True)
        hit = np.zeros(len(w), dtype=bool)
        named = [set() for _ in range(len(table))]
        index, word = index_shard(w, known, shortest) if len(w) else (None, None)
        for uri in blocks if index is not None else []:
            phrases = one or Phrases.load(uri, known)
            own, docs, items = find(w, index, word, phrases)
            hit |= own
            for doc, item in zip(docs.tolist(), items.tolist(), strict=True):
                if phrases.names[item] is not None:
                    named[doc].add(phrases.names[item])
        spans = [[] for _ in named]
        if hit.any():
            change = np.flatnonzero(hit & (np.diff(hit.astype(np.int8), prepend=0) > 0) | hit & (np.diff(w.doc, prepend=-1) != 0))
            stop = np.flatnonzero(hit & ((np.append(hit[1:], False) == 0) | (np.diff(w.doc, append=-1) != 0))) + 1
            for a, b in zip(change.tolist(), stop.tolist(), strict=True):
                doc = int(w.doc[a])
                spans[doc].append({"start": a - int(w.first[doc]), "end": b - int(w.first[doc])})
        text = table.column("text").to_pylist()
        clean = list(text)
        sizes = pc.fill_null(pc.binary_length(table.column("text")), 0).to_numpy().astype(np.int64)
        begin = np.cumsum(sizes) - sizes  # of each text in the joined data of the shard
        for doc, own in enumerate(spans):
            if own:
                data, base, parts, last = text[doc].encode(), int(w.first[doc]), [], 0
                shift = int(begin[doc])
                for s in own:
                    parts.append(data[last : int(w.start[base + s["start"]]) - shift])
                    last = int(w.end[base + s["end"] - 1]) - shift
                clean[doc] = b"".join([*parts, data[last:]]).decode()
        out = {
            "_n_words": pa.array(np.diff(w.first), pa.int64()), "_spans": pa.array(spans, SPANS),
            "_items": pa.array([sorted(x) for x in named], pa.list_(pa.string())), "_clean": pa.array(clean, pa.string()),
        }
        yield from pa.table({n: out[n] if n in out else table.column(n) for n in table.column_names}).to_batches()


def write_phrases(benchmark: DataFrame, window: int, item_col: str, text_col: str, phrase_bytes: int) -> tuple[list[str], str, int]:
    """Write the benchmark's windows in blocks and its vocabulary; the files of both, and the length of the shortest window.

    A retried task writes new files; only those of tasks that counted are named.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // phrase_bytes))
    folder = new_folder(spark, "phrases")

    def block(table: pa.Table) -> pa.Table:
        table = table.sort_by([("item", "ascending"), ("text", "ascending")])
        phrases = Phrases.of(table["item"].to_pylist(), table["text"], window)
        uri = f"{folder}/{uuid.uuid4().hex}.arrow"
        if len(phrases.length):
            phrases.save(uri)
        return pa.table({"uri": [uri], "shortest": pa.array([int(phrases.length.min(initial=window))], pa.int32()), "n": pa.array([len(phrases.length)], pa.int64())})

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in B.batched(batches, SHARD_BYTES, "text"):
            own = np.unique(words(table.column("text"), ALNUM, lower=True).hashes())
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], ["hash"])

    def joined(table: pa.Table) -> pa.Table:
        uri = f"{folder}/{uuid.uuid4().hex}.arrow"
        own = np.sort(table["hash"].to_numpy().view(np.uint64))
        save(uri, pa.table({"hash": own.view(np.int64)}))
        return pa.table({"uri": [uri]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(count)))
    written = stage(dealt.groupBy("block").applyInArrow(block, "uri string, shortest int, n long"))
    rows = written.where("n > 0").orderBy("uri").collect()
    # every task needs the vocabulary whole: eight bytes for each distinct word of the benchmark
    distinct = items.select("text").mapInArrow(hashes, "hash long").distinct()
    named = stage(distinct.groupBy(F.lit(0).alias("all")).applyInArrow(joined, "uri string")).collect()
    if not rows or not named:
        empty = f"{folder}/empty.arrow"
        save(empty, pa.table({"hash": pa.array([], pa.int64())}))
        return [], empty, window
    return [r.uri for r in rows], named[0].uri, min(r.shortest for r in rows)


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", phrase_bytes: int = 1 << 20, carry: Sequence[str] = (),
) -> DataFrame:
    """Mark the words of ``docs`` that lie in any ``window`` consecutive words of a benchmark item.

    Words are runs of letters and digits after lower-casing A-Z (see ``hashing.ALNUM``). An item with
    fewer words than a window, but not none, is one window. Returns one row per input row:
    ``id_col``, ``n_words``, ``n_hit``, ``spans`` (merged word spans, end exclusive), ``items`` (ids
    of items with an occurring window, as sorted strings), ``contaminated``, ``clean_text`` (the text
    without the spans) and the ``carry`` columns. A null text has no words and stays null; a null or wordless item finds
    nothing; an item without id marks words but is not listed; repeated ids stay separate rows.
    Other columns are ignored. An empty benchmark finds nothing; an empty table gives an empty result.
    """
    blocks, vocabulary, shortest = write_phrases(benchmark, window, item_col, item_text_col, phrase_bytes)
    span = "array<struct<start:long,end:long>>"
    out = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("_n_words"),
        F.array().cast(span).alias("_spans"), F.array().cast("array<string>").alias("_items"), F.lit(None).cast("string").alias("_clean"),
        *[F.col(c).alias(f"_c_{i}") for i, c in enumerate(carry)],
    )
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    out = out.mapInArrow(partial(_search, blocks=blocks, vocabulary=vocabulary, shortest=shortest), kinds)
    n_hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(
        F.col("id").alias(id_col), F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"), F.col("_spans").alias("spans"),
        F.col("_items").alias("items"), (n_hit > 0).alias("contaminated"), F.col("_clean").alias("clean_text"),
        *[F.col(f"_c_{i}").alias(c) for i, c in enumerate(carry)],
    )

"""BPE encoding with a minimal acyclic transducer as lexicon, and decoding.

The most frequent words of the corpus, counted over all texts, are encoded once and compiled into a
minimal acyclic automaton: states with the same continuations are one state. Every transition
carries how many words come before it, so a walk through the automaton adds up to the word's number,
and with it to the word's ids. The automaton is one file in the shared folder that workers map into
memory. Words that it does not hold are merged exactly, pair by pair in order of rank.

The vocabulary file is the ``tokenizers`` library's JSON of a BPE with a word-end suffix; its path is
a parameter. Results equal that library's, with special tokens recognised in the text and none added.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from thicket.llm import blocks as B
from thicket.llm.shared_files import mapped, new_folder, write
from thicket.session import stage

#: Words in the automaton, and their longest length in bytes. Neither changes a result.
LEXICON_WORDS, LEXICON_BYTES = 1 << 16, 40
#: Words a worker remembers before it starts afresh.
REMEMBERED = 400_000
BATCH_BYTES = 4 << 20
#: Texts of code points up to U+00FF: letters, numbers and blanks as the tokenizer's pattern sees them.
_LETTERS, _NUMBERS, _BLANKS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = [""] * 256, 0x100
    for b in range(256):
        letters[b] = chr(b) if b in shown else chr(spare)
        spare += b not in shown
    return letters


class Vocabulary:
    """Normaliser, word splitter and merges of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        model = spec["model"]
        odd = [t for t in spec["added_tokens"] if t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]]
        if model["type"] != "BPE" or odd or spec["decoder"] or model["dropout"] or model["ignore_merges"]:
            raise ValueError("only plain BPE with a word-end suffix and plain special tokens is supported")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.token_list = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        # The merges as sorted arrays, for many words at once.
        pair = np.array([a * len(self.ids) + b for a, b in self.merges], dtype=np.int64)
        self.pair_order = np.argsort(pair)
        self.pair_keys = pair[self.pair_order]
        self.merged = np.array([new for _, new in self.merges.values()], dtype=np.int64)
        self.letters = byte_letters()
        self.letter_ids = np.array([self.ids[c] for c in self.letters])
        self.last_ids = np.array([self.ids[c + self.suffix] for c in self.letters])
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        model["vocab"], model["merges"] = {"a": 0}, []
        small = Tokenizer.from_str(json.dumps(spec | {"added_tokens": []}))
        self.normaliser, self.splitter = small.normalizer, small.pre_tokenizer

    def words(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pieces = self.splitter.pre_tokenize_str(self.normaliser.normalize_str(text))
            return [bytes(map(self.byte_of.__getitem__, piece)).decode("utf-8", "surrogateescape") for piece, _ in pieces]
        return _LATIN.findall(text.lower())

    def merge(self, word: str) -> list[int]:
        """Exact ids of one word: the pair of lowest rank, and of these the leftmost, is merged until none is left."""
        data = word.encode("utf-8", "surrogateescape")
        ids = [self.ids[self.letters[b]] for b in data[:-1]] + [self.ids[self.letters[data[-1]] + self.suffix]]
        left, right = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))
        heap = [(*self.merges[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges]
        heap = [(rank, i, new) for rank, new, i in heap]
        heapq.heapify(heap)
        gone = [False] * len(ids)
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = right[i] if not gone[i] else len(ids)
            if j >= len(ids) or self.merges.get((ids[i], ids[j]), (None,))[0] != rank:
                continue
            ids[i], gone[j], right[i] = new, True, right[j]
            if right[i] < len(ids):
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < len(ids) and (ids[a], ids[b]) in self.merges:
                    heapq.heappush(heap, (self.merges[ids[a], ids[b]][0], a, self.merges[ids[a], ids[b]][1]))
        return [x for x, dropped in zip(ids, gone, strict=True) if not dropped]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each two ids, ``len(merges)`` where there is none."""
        key = a * len(self.ids) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_order[at], len(self.merges))

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of every word, as :meth:`merge` gives them.

        Words of one length are rows of a matrix. In a round every row merges its first pair of lowest
        rank and so gets one id shorter; rows without a pair leave. Long words, which are rare, go one by one.
        """
        out: list[bytes] = [b""] * len(words)
        length = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(length).tolist():
            rows = np.flatnonzero(length == size)
            if size > LEXICON_BYTES:
                for i in rows.tolist():
                    out[i] = np.array(self.merge(words[i].decode("utf-8", "surrogateescape")), dtype="<u4").tobytes()
                continue
            letters = np.frombuffer(b"".join(words[i] for i in rows.tolist()), np.uint8).reshape(len(rows), size)
            ids = self.letter_ids[letters]
            ids[:, -1] = self.last_ids[letters[:, -1]]
            rank = self.ranks(ids[:, :-1], ids[:, 1:])
            while len(rows):
                at = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
                best = rank[np.arange(len(rows)), at] if rank.shape[1] else np.full(len(rows), len(self.merges))
                live = best < len(self.merges)
                for i, own in zip(rows[~live].tolist(), ids[~live].astype("<u4"), strict=True):
                    out[i] = own.tobytes()
                rows, ids, rank, at, best = rows[live], ids[live], rank[live], at[live], best[live]
                if not len(rows):
                    break
                row, column = np.arange(len(rows)), np.arange(ids.shape[1] - 1)
                ids = np.take_along_axis(ids, column + (column > at[:, None]), 1)
                ids[row, at] = self.merged[best]
                column = column[:-1]
                rank = np.take_along_axis(rank, column + (column >= at[:, None]), 1)
                for left in (at - 1, at):
                    some = np.flatnonzero((left >= 0) & (left < rank.shape[1]))
                    rank[some, left[some]] = self.ranks(ids[some, left[some]], ids[some, left[some] + 1])
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def build_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of sorted distinct words, with the number of each word spread over its transitions."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]]]] = []
    path: list[list] = [[False, []]]  # of the last word: [final, transitions]

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, moves = path.pop()
            key = (final, tuple(moves))
            if key not in register:
                register[key] = len(states)
                states.append((final, moves))
            path[-1][1][-1] = (path[-1][1][-1][0], register[key])

    last = b""
    for word in words:
        shared = next((i for i, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
        close(shared)
        for byte in word[shared:]:
            path[-1][1].append((byte, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    close(0)
    states.append(tuple(path[0]))
    count = np.zeros(len(states), dtype=np.int64)
    key, target, skip = [], [], []
    for state, (final, moves) in enumerate(states):  # targets come before their sources
        before = int(final)
        for byte, to in moves:
            key.append(state * 256 + byte), target.append(to), skip.append(before)
            before += int(count[to])
        count[state] = before
    return {
        "key": np.array(key, dtype=np.int64), "target": np.array(target, dtype=np.int64), "skip": np.array(skip, dtype=np.int64),
        "final": np.array([f for f, _ in states], dtype=np.int8),
    }


class Lexicon:
    """The compiled automaton, mapped from its file."""

    def __init__(self, uri: str):
        table = pa.ipc.open_file(mapped(uri)).read_all()
        for name in table.column_names:
            setattr(self, name, table.column(name).chunk(0).flatten().to_numpy(zero_copy_only=True))

    @staticmethod
    def save(uri: str, words: list[bytes], ids: list[list[int]]) -> None:
        parts = build_automaton(words)
        parts["first"] = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int64)
        parts["ids"] = np.array([i for x in ids for i in x], dtype=np.uint32)
        table = pa.table({n: pa.array([a], pa.list_(pa.from_numpy_dtype(a.dtype))) for n, a in parts.items()})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, table.schema) as out:
            out.write_table(table)
        write(uri, sink.getvalue())

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of every word, -1 where the automaton does not hold it. All words walk together."""
        number = np.full(len(words), -1, dtype=np.int64)
        live = np.array([i for i, w in enumerate(words) if 0 < len(w) <= LEXICON_BYTES], dtype=np.int64)
        if not len(live) or not len(self.key):
            return number
        length = np.array([len(words[i]) for i in live])
        letters = np.frombuffer(b"".join(words[i].ljust(LEXICON_BYTES, b"\0") for i in live), dtype=np.uint8).reshape(len(live), -1)
        state = np.full(len(live), len(self.final) - 1)
        total = np.zeros(len(live), dtype=np.int64)
        row = np.arange(len(live))
        for at in range(LEXICON_BYTES):
            walking = row[(length[row] > at)]
            if not len(walking):
                break
            wanted = state[walking] * 256 + letters[walking, at]
            move = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            there = self.key[move] == wanted
            state[walking[there]] = self.target[move[there]]
            total[walking[there]] += self.skip[move[there]]
            length[walking[~there]] = -1
            row = row[length[row] >= 0]
        done = row[self.final[state[row]] == 1]
        number[live[done]] = total[done]
        return number


@lru_cache(maxsize=2)
def lexicon(uri: str) -> Lexicon:
    return Lexicon(uri)


class Encoder:
    """Encodes texts with the mapped lexicon and exact merges, remembering words it has met."""

    def __init__(self, path: str, uri: str):
        self.vocabulary, self.lexicon, self.known = vocabulary(path), lexicon(uri), {}

    def learn(self, words: set[str]) -> None:
        """Remember the ids of words: those of the lexicon by its automaton, the others by merging."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(words)
        data = [w.encode("utf-8", "surrogateescape") for w in new]
        number = self.lexicon.find(data)
        first, ids = self.lexicon.first, self.lexicon.ids
        for i in np.flatnonzero(number >= 0).tolist():
            self.known[new[i]] = ids[first[number[i]] : first[number[i] + 1]].astype("<u4").tobytes()
        rest = np.flatnonzero(number < 0).tolist()
        for i, own in zip(rest, self.vocabulary.merge_all([data[i] for i in rest]), strict=True):
            self.known[new[i]] = own

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers. New words of all texts are learnt at once."""
        v = self.vocabulary
        parts = [v.split.split(text) if v.split else [text] for text in texts]
        words = [[None if part in v.special else v.words(part) for part in own] for own in parts]
        self.learn({w for own in words for some in own if some for w in some})
        known = self.known.__getitem__
        return [
            b"".join([np.uint32(v.special[part]).tobytes() if some is None else b"".join(map(known, some)) for part, some in zip(own, found, strict=True)])
            for own, found in zip(parts, words, strict=True)
        ]


def decode(ids: bytes, v: Vocabulary) -> str:
    """Tokens of packed ids, joined by one space, special tokens included."""
    return " ".join(map(v.token_list.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def word_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``(word, n)`` of the tokenizer's words over all texts; counted per batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for table in B.batched(batches, 4 * BATCH_BYTES, "text"):
            seen: Counter = Counter()
            for text in table.column("text").to_pylist():
                for part in v.split.split(text or "") if v.split else [text or ""]:
                    if part not in v.special:
                        seen.update(v.words(part))
            words = [(w, n) for w, n in seen.items() if len(w) <= LEXICON_BYTES and w.isprintable()]
            yield pa.record_batch([pa.array([w for w, _ in words], pa.string()), pa.array([n for _, n in words], pa.int64())], names=["word", "n"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, size: int = LEXICON_WORDS, text_col: str = "text") -> str:
    """Compile the most frequent words of ``docs``, at most ``size`` of them; returns the file's URI.

    The least count comes from a histogram of counts on a logarithmic scale, so the driver gets some
    hundred rows and then at most ``size`` words of at most 40 bytes, whatever the corpus.
    """
    counts = stage(word_counts(docs, path, text_col).withColumn("rank", F.floor(F.log2("n") * 16).cast("int")))
    least, taken = 0, 0
    for r in sorted(counts.groupBy("rank").count().collect(), reverse=True):
        if taken + r["count"] > size:
            break
        least, taken = r["rank"], taken + r["count"]
    top = counts.where(F.col("rank") >= least).select("word").collect() if taken else []
    words = sorted(w for r in top if 0 < len(w := r.word.encode()) <= LEXICON_BYTES)
    v = vocabulary(path)
    uri = f"{new_folder(docs.sparkSession, 'lexicon')}/words.arrow"
    Lexicon.save(uri, words, [np.frombuffer(x, "<u4") for x in v.merge_all(words)])
    return uri


def encode_texts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lexicon_uri: str | None = None
) -> DataFrame:
    """Encode every text, and decode the ids again.

    Returns one row per input row: ``id_col``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit
    numbers as one binary) and ``decoded`` (tokens joined by one space). A null or blank text has no
    ids and decodes to an empty text. Repeated rows give repeated results; other columns are
    ignored; an empty table gives an empty result. Without ``lexicon_uri``, one is built from ``docs``.
    """
    uri = lexicon_uri or build_lexicon(docs, path, text_col=text_col)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, uri)
        for table in B.batched(batches, BATCH_BYTES, "text"):
            ids = encoder.encode([text or "" for text in table.column("text").to_pylist()])
            yield from pa.table({
                "id": table.column("id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids": pa.array(ids, pa.binary()), "decoded": pa.array([decode(x, encoder.vocabulary) for x in ids], pa.string()),
            }).to_batches()

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, f"id {id_type}, n_tokens long, ids binary, decoded string").withColumnRenamed("id", id_col)

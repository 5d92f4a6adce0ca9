"""Fill-in-the-middle over seekable compressed frames.

A text is stored as independent zstandard frames of at most ``frame_units`` code points, each with
its cumulative start. A cut looks up its frame by bisection and decompresses that frame only; all
other frames go into the output as they lie, because joined zstandard frames are again one stream.
Digests and the way back read the ordered frames one at a time, so a task holds one frame in clear
text besides the compressed document.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm import blocks as B
from thicket.session import stage

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Parts in the order in which a form writes them.
ORDER = {"psm": MARKS, "spm": (SUFFIX, PREFIX, MIDDLE)}
FRAME_UNITS = 1 << 16
LEVEL = 3
#: Text that a task holds at once, beside the document at hand.
BATCH_BYTES = 8 << 20
FRAMES = "array<struct<start:bigint,units:int,data:binary>>"
FRAME = pa.struct([("start", pa.int64()), ("units", pa.int32()), ("data", pa.binary())])

Frame = tuple[int, bytes]


def numbered(frames: list[Frame]) -> list[tuple[int, int, bytes]]:
    """Frames with their cumulative starts."""
    out, start = [], 0
    for units, data in frames:
        out.append((start, units, data))
        start += units
    return out


def frame_array(rows: list[list[tuple[int, int, bytes]]]) -> pa.Array:
    """Frames of many documents as one Arrow array of lists."""
    ends = [0]
    for row in rows:
        ends.append(ends[-1] + len(row))
    flat = [f for row in rows for f in row]
    columns = [pa.array([f[i] for f in flat], FRAME.field(i).type) for i in range(3)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(FRAME)))


def store_frames(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame_units: int = FRAME_UNITS) -> DataFrame:
    """The frame store: ``id``, ``n`` (code points), ``marked`` (holds one of the marks) and ``frames``.

    It is written to the shared folder, so that later passes read frames and never the texts. One row
    per input row, repeated rows included; a null text is stored as empty, without frames. Other
    columns are left out. An empty table gives an empty store.
    """
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = given.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        for table in B.batched(batches, BATCH_BYTES, "text"):
            sizes, marked, frames = [], [], []
            for text in table.column("text").to_pylist():
                sizes.append(len(text))
                marked.append(any(m in text for m in MARKS))
                pieces = [text[i : i + frame_units] for i in range(0, len(text), frame_units)]
                frames.append(numbered([(len(p), pack(p.encode())) for p in pieces]))
            out = [table.column("id").combine_chunks(), pa.array(sizes, pa.int64()), pa.array(marked, pa.bool_()), frame_array(frames)]
            yield from pa.table(out, names=["id", "n", "marked", "frames"]).to_batches()

    return stage(given.mapInArrow(run, f"id {kind}, n bigint, marked boolean, frames {FRAMES}"))


def draws(id_col: str, seed: int) -> list[Column]:
    """Four numbers from 0 to 2**32 - 1: the first 8-digit groups of the sha256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


class Frames:
    """The ordered frames of one text: whole frames by place, parts of frames by unit."""

    def __init__(self, frames: list[dict]):
        self.starts = [f["start"] for f in frames]
        self.units = [f["units"] for f in frames]
        self.data = [f["data"] for f in frames]
        self._unpack = zstandard.ZstdDecompressor().decompress
        self._pack = zstandard.ZstdCompressor(level=LEVEL).compress
        self._held: tuple[int, str] = (-1, "")

    def text(self, i: int) -> str:
        """Frame ``i`` in clear text; the last one is kept, because both cuts often share a frame."""
        if self._held[0] != i:
            self._held = i, self._unpack(self.data[i]).decode()
        return self._held[1]

    def between(self, low: int, high: int) -> Iterator[Frame]:
        """Compressed frames of the units from ``low`` to ``high``: only cut frames are opened."""
        i = max(bisect_right(self.starts, low) - 1, 0)
        while low < high:
            start, units = self.starts[i], self.units[i]
            end = min(high, start + units)
            if low == start and end == start + units:
                yield units, self.data[i]
            else:
                part = self.text(i)[low - start : end - start]
                yield end - low, self._pack(part.encode())
            low, i = end, i + 1


def arranged(frames: list[dict], n: int, form: str, first: int, second: int) -> list[tuple[int, int, bytes]]:
    """The frames of the output of a form whose cuts lie after ``first`` and ``second`` units."""
    if form == "plain":
        return [(f["start"], f["units"], f["data"]) for f in frames]
    source, pack = Frames(frames), zstandard.ZstdCompressor(level=LEVEL).compress
    spans = {PREFIX: (0, first), MIDDLE: (first, second), SUFFIX: (second, n)}
    out: list[Frame] = []
    for mark in ORDER[form]:
        out.append((len(mark), pack(mark.encode())))
        out.extend(source.between(*spans[mark]))
    return numbered(out)


def fill_in_middle(
    store: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20
) -> DataFrame:
    """Rearrange every stored text: ``id``, ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` frames.

    Two cuts and the form are drawn from ``seed`` and the id, so that equal ids draw alike and reruns
    agree; a null id draws as an empty one. A text that is empty or holds a mark stays plain, and so do
    ``100 - plain_from`` per cent of the others; of the rest ``spm_below`` per cent put the suffix first.
    """
    h = draws("id", seed)
    drawn = store.withColumns({"_a": h[0] % (F.col("n") + 1), "_b": h[1] % (F.col("n") + 1), "_plain": h[2] % 100, "_spm": h[3] % 100})
    form = F.when((F.col("n") == 0) | F.col("marked") | (F.col("_plain") >= plain_from), "plain").when(F.col("_spm") < spm_below, "spm").otherwise("psm")
    cut = drawn.select("id", "n", form.alias("form"), F.least("_a", "_b").alias("first"), F.greatest("_a", "_b").alias("second"), "frames")
    kind = store.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small(batch, "frames"):
                rows = zip(*[part.column(c).to_pylist() for c in ("frames", "n", "form", "first", "second")], strict=True)
                output = frame_array([arranged(*row) for row in rows])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in ("id", "n", "form", "first", "second")], output],
                    names=["id", "n", "form", "first", "second", "output"],
                )

    out = cut.mapInArrow(run, f"id {kind}, n bigint, form string, first bigint, second bigint, output {FRAMES}")
    split = F.col("form") != "plain"
    return out.select(
        "id", "n", "form", F.when(split, F.col("first")).alias("prefix_chars"), F.when(split, F.col("second") - F.col("first")).alias("middle_chars"), "output"
    )


def small(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``BATCH_BYTES`` of compressed frames; one document is never cut."""
    lists = batch.column(column)
    lengths = pc.binary_length(pc.struct_field(lists.values, "data")).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[lists.offsets.to_numpy()]
    slices = (before[:-1] - before[0]) // BATCH_BYTES
    cuts = [*np.flatnonzero(np.diff(slices, prepend=-1)).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def stream(frames: list[dict]) -> Iterator[bytes]:
    """The text of ordered frames, one frame at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    for f in frames:
        yield unpack(f["data"])


def parts(frames: list[dict], form: str) -> dict[str, tuple[int, int]]:
    """Byte range of each part of an output, found from its marks alone.

    Neither a part nor a part beside a mark can hold a mark, so the first place of each mark, in
    the order of the form, is the true one. Two bytes are carried over the end of a frame.
    """
    todo, ranges, open_mark, opened = [m.encode() for m in ORDER[form]], {}, "", 0
    held, at = b"", 0
    for data in stream(frames):
        held += data
        while todo and (i := held.find(todo[0])) >= 0:
            if open_mark:
                ranges[open_mark] = opened, at + i
            open_mark, opened = todo[0].decode(), at + i + 3
            at, held = opened, held[i + 3 :]
            todo.pop(0)
        keep = held[-2:]
        at, held = at + len(held) - len(keep), keep
    ranges[open_mark] = opened, at + len(held)
    return ranges


def between_bytes(frames: list[dict], low: int, high: int) -> Iterator[bytes]:
    """The bytes from ``low`` to ``high`` of the joined text; frames outside are passed by their header's size."""
    at, unpack = 0, zstandard.ZstdDecompressor().decompress
    for f in frames:
        size = zstandard.frame_content_size(f["data"])
        if at + size > low and at < high:
            yield unpack(f["data"])[max(low - at, 0) : high - at]
        at += size


def restored(frames: list[dict], form: str) -> Iterator[bytes]:
    """The text from an output and its form, piece by piece: prefix, middle, suffix."""
    if form == "plain":
        yield from stream(frames)
        return
    ranges = parts(frames, form)
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from between_bytes(frames, *ranges[mark])


def sha256(pieces: Iterator[bytes]) -> str:
    digest = hashlib.sha256()
    for piece in pieces:
        digest.update(piece)
    return digest.hexdigest()


def digests(done: DataFrame) -> DataFrame:
    """``output_sha256`` and ``restored_sha256`` in place of the ``output`` frames of :func:`fill_in_middle`."""
    rest = [f for f in done.schema if f.name != "output"]
    names = [f.name for f in rest]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small(batch, "output"):
                rows = list(zip(part.column("output").to_pylist(), part.column("form").to_pylist(), strict=True))
                made = pa.array([sha256(stream(f)) for f, _ in rows], pa.string())
                back = pa.array([sha256(restored(f, form)) for f, form in rows], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], made, back], names=[*names, "output_sha256", "restored_sha256"])

    return done.mapInArrow(run, f"{kinds}, output_sha256 string, restored_sha256 string")


def output_text(pieces: list[dict]) -> str:
    """A whole output or stored text in clear, for small ones."""
    return b"".join(stream(pieces)).decode()

"""What filters remove alone, together and in every order, from sorted posting lists.

Documents are range-partitioned by part and id. A *segment* is a run of one part's rows in id order,
at most ``SEGMENT_ROWS`` of them; for each filter it keeps the sorted list of the ids that fail it,
and one list for each label. Lists hold segment ids: places in the segment's id order, so repeated
ids stay apart. Unions and differences of lists are merges by galloping: the shorter list is looked
up in the longer one by bisection, and the runs between are copied whole. Only sizes leave a task.

Sizes of "fails f, fails none of S" for all sets S of other filters add up over segments and hold
every order at once: the step of filter f after the filters of S removes just these documents.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm import blocks as B
from thicket.session import stage

#: The filters of :func:`failures`; the place gives the bit.
FILTERS = ("A", "B", "C", "D", "E")
MIN_WORDS = 200
#: Rows of a segment, and of a list, at most.
SEGMENT_ROWS = 1 << 18
BATCH_BYTES = 8 << 20
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"
SIDE = ("good", "toxic")


def own_failures(text: str) -> int:
    """Bits of filters A to D, which need no other document."""
    data = text.encode()
    found = data.split()  # at space, tab to carriage return
    bits = len(found) < MIN_WORDS
    bits |= (100 * len(set(found)) < 50 * len(found)) << 1
    bits |= (100 * (len(data) - len(data.translate(None, CAPITALS))) > 3 * len(text)) << 2
    return bits | (len(data.translate(None, SYMBOLS)) < len(data)) << 3


def failures(
    docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """``id``, ``part``, ``fails`` (one bit per filter), ``good``, ``toxic``: one row per row of ``docs``.

    A: under 200 words; B: under half of the words distinct; C: over 3 in 100 code points are A-Z;
    D: a symbol; E: the text, told by its sha256, is that of a smaller id anywhere in the table.
    A null text is empty, a null part the empty string; a null id is neither smaller nor larger than
    another. Rows of one id do not fail E by each other. Labels of an id that has several rows hold if
    any of them does; ids without label have neither. Other columns are left out, so names cannot
    clash. An empty table gives an empty result.
    """
    given = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in B.batched(batches, BATCH_BYTES, "text"):
            texts = table.column("text").to_pylist()
            bits = pa.array([own_failures(t) for t in texts], pa.int32())
            text = pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())
            yield from pa.table([table.column("id"), table.column("part"), bits, text], names=["id", "part", "own", "digest"]).to_batches()

    measured = stage(given.mapInArrow(run, "id bigint, part string, own int, digest binary"))
    # Only texts that occur again are looked up. They are written, so that the join can split hot ones.
    first = stage(measured.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("_d"), "first"))
    later = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    out = measured.join(first, F.col("digest") == F.col("_d"), "left").select(
        "id", "part", F.col("own").bitwiseOR(F.when(later, 1 << 4).otherwise(0)).alias("fails")
    )
    if labels is None:
        return out.withColumns({c: F.lit(False) for c in SIDE})
    marks = labels.select(F.col(id_col).cast("bigint").alias("_id"), "quality", "toxic").groupBy("_id").agg(
        *[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(f"_{s}") for c, s in (("quality", "good"), ("toxic", "toxic"))]
    )
    out = out.join(marks, F.col("id") == F.col("_id"), "left")
    return out.select("id", "part", "fails", *[F.coalesce(F.col(f"_{s}"), F.lit(False)).alias(s) for s in SIDE])


def postings(flags: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """The posting lists, written to the shared folder: one row per segment.

    ``part``, ``first`` and ``last`` id, ``ids`` (all ids of the segment in order, packed), and one
    column of packed 32-bit segment ids for each filter and label. ``flags`` is as :func:`failures`
    returns it, for any number of filters. A row number from the written rows parts equal ids in the
    ranges, so one id may have any share of the rows.
    """
    names = [*filters, *SIDE]
    written = stage(flags.select("id", "part", "fails", *SIDE))
    dealt = written.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange("part", "id", "_row").sortWithinPartitions("part", "id", "_row")

    def segment(table: pa.Table) -> dict:
        fails, ids = table.column("fails").to_numpy(), table.column("id")
        chosen = [fails >> i & 1 for i in range(len(filters))] + [table.column(s).to_numpy() for s in SIDE]
        lists = {n: np.flatnonzero(c).astype("<u4").tobytes() for n, c in zip(names, chosen, strict=True)}
        packed = ids.fill_null(np.iinfo(np.int64).min).to_numpy().astype("<i8").tobytes()
        return {"part": table.column("part")[0].as_py(), "first": ids[0].as_py(), "last": ids[-1].as_py(), "n": len(ids), "ids": packed, **lists}

    kinds = ", ".join(["part string, first bigint, last bigint, n bigint, ids binary", *[f"`{n}` binary" for n in names]])
    schema = pa.schema([("part", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), *[(n, pa.binary()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in segments(batches):
            yield pa.RecordBatch.from_pylist([segment(table)], schema)

    return stage(dealt.select("id", "part", "fails", *SIDE).mapInArrow(run, kinds))


def segments(batches: Iterator[pa.RecordBatch], rows: int = SEGMENT_ROWS) -> Iterator[pa.Table]:
    """Runs of one part, cut at ``rows`` rows, of a sorted partition."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        part = batch.column("part")
        codes = part.dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            while a < b:
                if held and (held[0].column("part")[0] != part[a] or sum(map(len, held)) >= rows):
                    yield pa.Table.from_batches(held)
                    held = []
                end = min(b, a + rows - sum(map(len, held)))
                held.append(batch.slice(a, end - a))
                a = end
    if held:
        yield pa.Table.from_batches(held)


def places(long: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the ids of ``short`` lie in ``long``, and which of them it holds."""
    at = np.searchsorted(long, short)
    held = np.zeros(len(short), bool)
    inside = at < len(long)
    held[inside] = long[at[inside]] == short[inside]
    return at, held


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge of two sorted lists: runs of the longer one are copied whole between new ids of the shorter."""
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    at, held = places(long, short)
    return np.insert(long, at[~held], short[~held])


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ids of ``a`` that ``b`` has not."""
    if len(a) <= len(b):
        return a[~places(b, a)[1]]
    at, held = places(a, b)
    return np.delete(a, at[held])


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Number of ids that both lists have."""
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    return int(places(long, short)[1].sum())


def merged(lists: Sequence[np.ndarray]) -> list[np.ndarray]:
    """The union of every set of lists; the place is the set's mask."""
    out = [np.empty(0, "<u4")]
    for mask in range(1, 1 << len(lists)):
        low = (mask & -mask).bit_length() - 1
        out.append(union(out[mask & (mask - 1)], lists[low]))
    return out


def subset_sums(lists: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """Per part, filter and set of other filters: sizes summed over all segments.

    ``part``, ``filter`` (number), ``earlier`` (mask of the set), ``n`` (all documents), ``fails`` (of the
    filter), ``removed`` (fail it and none of the set), ``gone`` (fail the filter or one of the set),
    ``good`` and ``toxic`` of the removed.
    """
    keys = [(f, s) for f in range(len(filters)) for s in range(1 << len(filters)) if not s >> f & 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                value = {c: batch.column(c)[row].as_py() for c in ("part", "n")}
                own = {c: np.frombuffer(batch.column(c)[row].as_py(), "<u4") for c in (*filters, *SIDE)}
                posting = [own[f] for f in filters]
                unions, out = merged(posting), []
                for f, s in keys:
                    left = difference(posting[f], unions[s])
                    out.append({**value, "filter": f, "earlier": s, "fails": len(posting[f]), "removed": len(left), "gone": len(unions[s]) + len(left), **{c: shared(left, own[c]) for c in SIDE}})
                yield pa.RecordBatch.from_pylist(out, schema)

    sums = ["n", "fails", "removed", "gone", *SIDE]
    schema = pa.schema([("part", pa.string()), ("filter", pa.int32()), ("earlier", pa.int32()), *[(c, pa.int64()) for c in sums]])
    kinds = "part string, filter int, earlier int, " + ", ".join(f"{c} bigint" for c in sums)
    sizes = lists.select("part", "n", *filters, *SIDE).mapInArrow(run, kinds)
    return sizes.groupBy("part", "filter", "earlier").agg(*[F.sum(c).alias(c) for c in sums])


def interactions(sums: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from the sums of :func:`subset_sums`.

    Orders are k! rows for k filters, so this report is for few filters; the sums serve any number.
    """
    count = len(filters)
    steps = [
        ("".join(filters[f] for f in order), step + 1, f, sum(1 << g for g in order[:step]))
        for order in permutations(range(count)) for step, f in enumerate(order)
    ]
    orders = sums.sparkSession.createDataFrame(steps, "filter_order string, step int, _f int, _s int")
    full = (1 << count) - 1
    before = F.bit_count("earlier")
    ways = F.lit(0)
    for size in range(count):  # orders in which just the filters of the set come before
        ways = F.when(before == size, math.factorial(size) * math.factorial(count - 1 - size)).otherwise(ways)
    others = F.element_at(F.array(*[F.lit(full - (1 << f)) for f in range(count)]), F.col("filter") + 1)
    per_filter = sums.groupBy("part", "filter").agg(
        F.sum(F.col("removed") * ways).alias("shapley"), F.sum(F.when(F.col("earlier") == others, F.col("removed")).otherwise(0)).alias("unique_fails")
    ).select(F.col("part").alias("_p"), F.col("filter").alias("_g"), "shapley", "unique_fails")
    found = sums.join(orders, (F.col("filter") == F.col("_f")) & (F.col("earlier") == F.col("_s")))
    found = found.join(per_filter, (F.col("part") == F.col("_p")) & (F.col("filter") == F.col("_g")))
    return found.select(
        "part", "filter_order", "step", (F.col("n") - F.col("gone")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
    )

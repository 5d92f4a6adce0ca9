"""K-means for many groups at once, with the same labels at any partitioning.

Vectors are rounded to whole numbers on a common grid. Squared distances and sums of whole numbers
are exact in any order, so neither the cut into blocks nor the order of partial sums can change a
label, and a retried task repeats its result.

Rows are written once as packed blocks, about ``BLOCK_ROWS`` rows of one group each, so a group may
hold any share of the rows. Blocks lie in order of their groups, so that a task sees few groups, and go to
Python workers a few at a time. A round is one pass over the blocks: a block meets the centres of its
group and is assigned by one matrix product, a task adds up the vectors of each centre of the blocks
it has seen, and the sums are combined by group, centre and component. Seeding is k-means|| in its
form without a second pass: a round takes the rows with the largest ``distance / draw``, a sample in
proportion to the distances; the weighted candidates are then reduced to the wanted number of centres.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.ordering import top_per_key
from thicket.session import batch_bytes, stage

#: Steps of the grid up to the largest component: squares summed over ``MAX_DIM`` components are exact in a double.
GRID = 1 << 19
MAX_DIM = 1 << 12
BLOCK_ROWS = 1024
#: Centres that meet a block in one matrix product.
CENTRES_AT_ONCE = 4096
#: Centres of all groups are broadcast up to this size; beyond it they are joined to the blocks by group.
BROADCAST_BYTES = 32 << 20
#: Sums, or rows that may become centres, that a task holds before it sends them on.
HELD_BYTES = 64 << 20
#: Bytes of blocks and their centres that go to a worker at once; a block is a quarter of a megabyte at 64 components.
BATCH_BYTES = 4 << 20
#: Row groups of written blocks: a reader holds one of them.
PACKED = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "8"}
SEED_ROUNDS = 5
ROUNDS = 20
CENTRES = "group long, centre int, c array<bigint>"


def written(df: DataFrame, **options: str) -> DataFrame:
    """:func:`stage` for what workers make of blocks, with few blocks in a batch."""
    with batch_bytes(df.sparkSession, BATCH_BYTES):
        return stage(df, **options)


def on_grid(rows: DataFrame, seed: int = 42) -> DataFrame:
    """``group``, ``node_id``, ``draw`` and the whole-number vector ``q`` of rows ``(group, node_id, emb)``.

    The grid spans the next power of two above the largest component of the table, so that scaling
    itself is exact. Rows without vector are left out.
    """
    rows = rows.where(F.col("emb").isNotNull())
    top, dim = rows.agg(F.max(F.array_max(F.transform("emb", lambda x: F.abs(x.cast("double"))))), F.max(F.size("emb"))).first()
    if (dim or 0) > MAX_DIM:
        raise ValueError(f"vectors of more than {MAX_DIM} components are not exact on this grid")
    scale = GRID / 2.0 ** math.ceil(math.log2(top)) if top else 1.0
    q = F.transform("emb", lambda x: F.round(x.cast("double") * scale).cast("int"))
    return rows.select(F.col("group").cast("long").alias("group"), F.col("node_id").cast("string").alias("node_id"), F.xxhash64(F.lit(seed), "node_id").alias("draw"), q.alias("q"))


def packed(grid: DataFrame) -> DataFrame:
    """The written blocks: ``group``, ``slice``, ``ids``, and packed ``draw`` and ``data``.

    Ranges of group and slice deal them out, as the join by group may leave a large group in one task.
    """
    parts = stage(grid.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("parts")))
    dealt = grid.join(parts, "group").withColumn("slice", F.pmod(F.xxhash64("node_id", F.lit(1)), "parts")).drop("parts")
    dealt = dealt.repartitionByRange("group", "slice")

    def block(table: pa.Table) -> pa.Table:
        table = table.sort_by("node_id")
        data = table["q"].combine_chunks().flatten().to_numpy().astype("<i4")
        one = {"ids": table["node_id"].to_pylist(), "draw": table["draw"].to_numpy().astype("<i8").tobytes(), "data": data.tobytes()}
        return pa.Table.from_pylist([{"group": table["group"][0].as_py(), "slice": table["slice"][0].as_py(), **one}], schema)

    schema = pa.schema([("group", pa.int64()), ("slice", pa.int64()), ("ids", pa.list_(pa.string())), ("draw", pa.binary()), ("data", pa.binary())])
    return written(dealt.groupBy("group", "slice").applyInArrow(block, "group long, slice long, ids array<string>, draw binary, data binary"), **PACKED)


def meet(blocks: DataFrame, centres: DataFrame) -> DataFrame:
    """Blocks with the ``centres`` of their group, in the order of their numbers."""
    per_group = centres.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("centre", "c"))).alias("centres"))
    size = centres.agg(F.sum(F.size("c"))).first()[0] or 0
    return blocks.join(F.broadcast(per_group) if 8 * size <= BROADCAST_BYTES else per_group, "group")


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest centre of every row, the first of equals, and the squared distance."""
    best, label = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    for at in range(0, len(c), CENTRES_AT_ONCE):
        some = c[at : at + CENTRES_AT_ONCE]
        far = (some * some).sum(1)[None] - 2 * (x @ some.T)
        low = far.argmin(1)
        value = far[np.arange(len(x)), low]
        closer = value < best
        best[closer], label[closer] = value[closer], low[closer] + at
    return label, best + (x * x).sum(1)


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """Every block: its other columns, its vectors, the numbers and the vectors of its centres."""
    for batch in batches:
        for i in range(len(batch)):
            row = {n: batch.column(n)[i] for n in batch.schema.names if n not in ("data", "centres")}
            inner = batch.column("centres")[i].values
            number = inner.field("centre").to_numpy()
            c = inner.field("c").flatten().to_numpy().reshape(len(number), -1).astype(float)
            x = np.frombuffer(batch.column("data")[i].as_py(), "<i4").reshape(-1, c.shape[1]).astype(float)
            yield row, x, number, c


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count and sum of the vectors nearest to each centre, over the blocks that a task sees."""
    held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for group, (number, n, total) in held.items():
            some = np.flatnonzero(n)
            if len(some):
                sums = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * total.shape[1], pa.int32()), pa.array(total[some].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(some), pa.int64()), pa.array(number[some], pa.int32()), pa.array(n[some]), sums], ["group", "centre", "n", "s"])
        held.clear()

    for row, x, number, c in met(batches):
        group = row["group"].as_py()
        _, n, total = held.setdefault(group, (number, np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)))
        label, _ = nearest(x, c)
        n += np.bincount(label, minlength=len(c))
        order = np.argsort(label, kind="stable")
        start = np.flatnonzero(np.diff(label[order], prepend=-1))
        total[label[order[start]]] += np.add.reduceat(x[order].astype(np.int64), start, axis=0)
        if sum(t.nbytes for _, _, t in held.values()) > HELD_BYTES:
            yield from sent()
    yield from sent()


def sums(blocks: DataFrame, centres: DataFrame) -> DataFrame:
    """``group``, ``centre``, ``n`` and the sum ``s`` of the vectors nearest to each centre that has any."""
    parts = meet(blocks.select("group", "data"), centres).mapInArrow(add_up, "group long, centre int, n long, s array<bigint>")
    each = parts.select("group", "centre", "n", F.posexplode("s").alias("pos", "v"))
    each = each.groupBy("group", "centre", "pos").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"])
    return each.groupBy("group", "centre").agg(F.first("n").alias("n"), whole.alias("s"))


def moved(blocks: DataFrame, centres: DataFrame) -> DataFrame:
    """The centres after one round: the rounded mean of their rows; a centre without rows stays."""
    # the mean to the nearest whole number, halves upwards, by whole division
    mean = F.expr("transform(s, v -> (2 * v + n - pmod(2 * v + n, 2 * n)) div (2 * n))")
    new = sums(blocks, centres).select("group", "centre", mean.alias("_m"))
    return written(centres.join(new, ["group", "centre"], "left").select("group", "centre", F.coalesce("_m", "c").alias("c"), (F.col("_m") != F.col("c")).alias("_new")))


def lloyd(blocks: DataFrame, centres: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Centres after rounds of assignment and mean, until none moves or ``rounds`` are done."""
    for _ in range(rounds):
        step = moved(blocks, centres)
        centres = step.drop("_new")
        if step.where("_new").isEmpty():
            break
    return centres


def labels(blocks: DataFrame, centres: DataFrame) -> DataFrame:
    """``group``, ``node_id``, ``centre`` (number of the nearest one, the lowest of equals) and squared ``distance`` on the grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, x, number, c in met(batches):
            label, far = nearest(x, c)
            group = pa.array([row["group"].as_py()] * len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([group, row["ids"].values, pa.array(number[label], pa.int32()), pa.array(far.astype(np.int64))], ["group", "node_id", "centre", "distance"])

    return written(meet(blocks.select("group", "ids", "data"), centres).mapInArrow(run, "group long, node_id string, centre int, distance long"))


def mix(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit number for every 64-bit number."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def sampled(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
    """Of every group that a task sees, the ``k`` rows with the largest distance over draw, not yet a centre.

    A task that holds many rows sends them on, and a group may then have more than ``k`` of a task.
    """
    best: dict[int, tuple[np.ndarray, list[str], np.ndarray]] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for group, (rate, ids, x) in best.items():
            if len(rate):
                c = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(rate), pa.int64()), pa.array(rate), pa.array(ids, pa.string()), c], ["group", "rate", "node_id", "c"])
        best.clear()

    for row, x, _, c in met(batches):
        group, k = row["group"].as_py(), row["k"].as_py()
        _, far = nearest(x, c)
        draw = mix(np.frombuffer(row["draw"].as_py(), "<i8").view(np.uint64) + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64)))
        rate = far / ((draw >> np.uint64(11)).astype(float) + 1.0)
        top = np.argsort(-rate, kind="stable")[:k]
        top = top[far[top] > 0]
        new = rate[top], row["ids"].values.take(pa.array(top)).to_pylist(), x[top].astype(np.int64)
        old = best.get(group, (new[0][:0], [], new[2][:0]))
        rate, ids, x = np.concatenate([old[0], new[0]]), old[1] + new[1], np.concatenate([old[2], new[2]])
        order = sorted(range(len(ids)), key=lambda i: (-rate[i], ids[i]))[:k]  # noqa: B023
        best[group] = rate[order], [ids[i] for i in order], x[order]
        if sum(x.nbytes for _, _, x in best.values()) > HELD_BYTES:
            yield from sent()
    yield from sent()


def reduced(table: pa.Table) -> pa.Table:
    """The ``k`` of a group's weighted candidates that are chosen one by one, each the largest in weight times squared distance to those chosen.

    A group has at most ``SEED_ROUNDS * k + 1`` candidates.
    """
    table = table.sort_by("centre")
    c = table["c"].combine_chunks().flatten().to_numpy().reshape(len(table), -1).astype(float)
    weight, k = table["n"].to_numpy().astype(float), table["k"][0].as_py()
    chosen = [int(weight.argmax())]
    far = ((c - c[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(k, len(c)) and (weight * far).max() > 0:
        chosen.append(int((weight * far).argmax()))
        far = np.minimum(far, ((c - c[chosen[-1]]) ** 2).sum(1))
    picked = table.take(pa.array(sorted(chosen)))
    return pa.table({"group": picked["group"], "centre": pa.array(range(len(chosen)), pa.int32()), "c": picked["c"]})


def seeds(grid: DataFrame, blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """First centres: ``group``, ``centre`` and ``c``, at most ``k`` of every group of ``wanted`` (``group``, ``k``)."""
    low = stage(grid.join(wanted.select("group"), "group", "left_semi").groupBy("group").agg(F.min("draw").alias("draw")))
    first = grid.join(low, ["group", "draw"]).groupBy("group").agg(F.min_by("q", "node_id").alias("c"))  # few rows have the lowest draw
    found = stage(first.select("group", F.lit(0).alias("centre"), F.col("c").cast("array<bigint>").alias("c")))
    asked = blocks.join(wanted.select("group", F.col("k").cast("int").alias("k")), "group").select("group", "k", "ids", "draw", "data")
    most = wanted.agg(F.max("k")).first()[0] or 1
    for turn in range(1, SEED_ROUNDS + 1):
        new = meet(asked, found).mapInArrow(partial(sampled, turn=turn), "group long, rate double, node_id string, c array<bigint>")
        new = new.join(wanted, "group")
        rank = top_per_key(new, ["group"], [F.desc("rate"), "node_id"], most, rank="at").where(F.col("at") <= F.col("k"))
        last = found.groupBy("group").agg((F.max("centre")).alias("last"))
        more = rank.join(last, "group").select("group", (F.col("last") + F.col("at")).cast("int").alias("centre"), "c")
        found = written(found.unionByName(more))
    weight = sums(blocks, found).select("group", "centre", "n")
    rated = found.join(weight, ["group", "centre"]).join(wanted, "group")
    return written(rated.select("group", "centre", "c", "n", F.col("k").cast("int").alias("k")).groupBy("group").applyInArrow(reduced, CENTRES))


def cluster(rows: DataFrame, wanted: DataFrame, rounds: int = ROUNDS, seed: int = 42) -> DataFrame:
    """``group``, ``node_id`` and ``centre`` for the groups of ``wanted``: ``(group, k)``, ``k`` centres at most.

    ``rows`` is ``(group, node_id, emb)``. Labels depend on the vectors, ids, numbers of centres and
    the seed only. Equal vectors are never split; a group with fewer distinct vectors than ``k`` has
    fewer centres. An empty table gives an empty result.
    """
    grid = stage(on_grid(rows.join(wanted.select("group"), "group", "left_semi"), seed))
    blocks = packed(grid)
    return labels(blocks, lloyd(blocks, seeds(grid, blocks, wanted), rounds)).select("group", "node_id", "centre")

"""Mix sources to target token counts by entropy balancing, in DataFrame functions only.

Every document gets a rate, its expected number of copies. Among all rates up to ``max_copies`` that
give each source its target, those closest to one in relative entropy are ``exp(lambda * size)``, cut
at ``max_copies``, with one multiplier per source: the solution of a convex dual whose gradient is
*tokens at these rates - target*. Newton steps on it run for all sources at once, over counts of
(source, size) in place of documents; a step that leaves the bracket of the root halves the bracket.

Rates become copies by a draw that depends on the document alone. What chance leaves between a
source's total and its target is mended by the documents nearest to their next rounding, found by
two histograms of 4096 bins; no group of documents is sorted or held.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.ordering import dense_index
from thicket.session import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Rounds until the bracket of a double has no number inside; Newton needs about eight.
MAX_ROUNDS = 200
#: Bins of each of the two histograms of distances to the next rounding.
BINS = 1 << 12
#: Shares of a source that are joined apart.
SALTS = 64
EXACT = "decimal(38,6)"
#: Rounds of mending; large sources need one, sources of a few documents more.
MEND_ROUNDS = 6


def measure(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Written rows ``id``, ``source``, ``size`` (words) and ``draw``, from 0 to 2**52 - 1."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    draw = F.xxhash64(F.lit(seed), F.col(id_col), text).bitwiseAND(F.lit((1 << 52) - 1))
    return stage(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), draw.alias("draw")
    ))


def source_targets(sizes: DataFrame, weights: Sequence[int], max_copies: int) -> DataFrame:
    """Per source: ``sid``, ``source``, ``source_size``, ``weight`` and ``target``.

    ``sizes`` has one row per source with ``source`` and ``source_size``. Sources in code point order,
    null last, take the weights in turn, and the sum of all sizes is shared by weight; a target stops
    at ``max_copies`` times its source's size, and the excess is shared anew until none is above. Each
    round reads one row of sums; sums are whole numbers, so that targets do not depend on their order.
    """
    numbered = dense_index(sizes, [], [F.col("source").isNull(), F.col("source")], "sid")
    turn = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    numbered = stage(numbered.withColumn("weight", turn.cast("bigint")))
    most = F.col("source_size") * max_copies
    total = numbered.agg(F.sum("source_size")).first()[0] or 0
    rest, weight, full = total, None, F.lit(False)
    while True:
        open_weight, stopped = numbered.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, most))).first()
        if weight == open_weight:
            break
        rest, weight = total - (stopped or 0), open_weight
        if not weight:
            break
        full = full | (F.lit(rest).cast("decimal(38,0)") * F.col("weight") > most.cast("decimal(38,0)") * F.lit(weight))
    share = F.lit(float(rest)) * F.col("weight") / F.lit(float(weight or 1))
    return numbered.withColumn("target", F.when(full, most.cast("double")).otherwise(share))


def multipliers(targets: DataFrame, counts: DataFrame, max_copies: int) -> DataFrame:
    """Per ``sid`` the ``multiplier`` of a document's size; null where every document is taken ``max_copies`` times.

    ``counts`` has ``sid``, ``size`` (above 0) and ``n``, its number of documents. Sums are exact decimals,
    so reruns and other partitionings give the same multipliers.
    """
    scale = counts.groupBy("sid").agg(
        (F.sum((F.col("n") * F.col("size") * F.col("size")).cast("decimal(38,0)")).cast("double") / F.sum(F.col("n") * F.col("size"))).alias("scale"),
        F.min("size").alias("least"),
    )
    ratio = F.log(F.col("target") / F.col("source_size"))
    # Between these the root lies: at x_min the smallest document alone would need this multiplier.
    x_min = F.col("least") / F.col("scale")
    state = targets.where((F.col("source_size") > 0) & (F.col("target") < F.col("source_size") * max_copies)).join(scale, "sid").select(
        "sid", "target", "scale", ratio.alias("at"),
        F.when(ratio < 0, ratio / x_min).otherwise(F.lit(0.0)).alias("low"),
        F.when(ratio < 0, F.lit(0.0)).otherwise(F.lit(math.log(max_copies)) / x_min).alias("high"),
        F.lit(False).alias("done"),
    )
    state = stage(state)
    for _ in range(MAX_ROUNDS):
        todo = state.where(~F.col("done"))
        if todo.isEmpty():
            break
        x = F.col("size") / F.col("scale")
        rate = F.exp(F.least(F.col("at") * x, F.lit(math.log(max_copies))))
        tokens = F.col("n") * F.col("size") * rate
        slope = F.when(F.col("at") * x < math.log(max_copies), tokens * x).otherwise(F.lit(0.0))
        sums = counts.join(todo, "sid").groupBy("sid").agg(
            F.sum(tokens.cast(EXACT)).cast("double").alias("got"), F.sum(slope.cast(EXACT)).cast("double").alias("slope")
        )
        step = state.join(sums, "sid", "left")
        low = F.when(F.col("got") < F.col("target"), F.col("at")).otherwise(F.col("low"))
        high = F.when(F.col("got") > F.col("target"), F.col("at")).otherwise(F.col("high"))
        step = step.withColumns({"low": low, "high": high})
        middle = (F.col("low") + F.col("high")) / 2
        newton = F.col("at") + (F.col("target") - F.col("got")) / F.when(F.col("slope") > 0, F.col("slope"))
        following = F.when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(middle)
        near = F.abs(F.col("got") - F.col("target")) <= F.greatest(F.lit(1e-3), F.col("target") * 1e-9)
        shut = (middle <= F.col("low")) | (middle >= F.col("high"))
        ends = F.col("done") | near | shut
        state = stage(step.select("sid", "target", "scale", F.when(ends, F.col("at")).otherwise(following).alias("at"), "low", "high", ends.alias("done")))
    return state.select("sid", (F.col("at") / F.col("scale")).alias("multiplier"))


def nearest_bin(need: DataFrame, sums: DataFrame, key: str) -> DataFrame:
    """Per source the bin of ``key`` in which the running sum of sizes reaches ``need``, and the need left before it.

    ``sums`` has at most ``BINS`` rows per source: the window holds no more.
    """
    running = Window.partitionBy("sid").orderBy(key)
    summed = sums.withColumn("_upto", F.sum("size").over(running)).join(need, "sid")
    over = summed.where(F.col("_upto") >= F.col("need")).groupBy("sid").agg(F.min_by(F.struct(F.col(key).alias("bin"), F.col("size"), (F.col("need") - F.col("_upto") + F.col("size")).alias("left")), key).alias("b"))
    return over.select("sid", "b.*")


def mended(rated: DataFrame, gap: DataFrame, max_copies: int) -> DataFrame:
    """One copy more or less of the documents nearest to their next rounding, until ``need`` words are moved.

    ``gap`` has ``sid``, ``up`` (words are to be added) and ``need``. A document moves once at most, and
    only if its size alone does not widen the gap. Distances are whole numbers below ``BINS ** 2``;
    the first histogram finds the upper half of the limit, the second one the lower half.
    """
    last = BINS * BINS - 1
    place = F.least(F.floor(F.col("part") * (last + 1)), F.lit(last)).cast("bigint")
    away = F.when(F.col("up"), F.lit(last) - place).otherwise(place)
    room = F.when(F.col("up"), F.col("base") < max_copies).otherwise(F.col("base") > 0)
    movable = room & ~F.col("moved") & (F.col("size") > 0) & (F.col("size") < 2 * F.col("gap"))

    def moving(extra: DataFrame) -> DataFrame:
        # Salted, so that a hot source is spread over tasks and its bins are summed before they meet.
        salted = rated.select("sid", "size", "base", "part", "moved", F.floor(F.col("part") * SALTS).alias("salt"))
        extra = extra.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        return salted.join(extra, ["sid", "salt"]).where(movable).select("*", away.alias("away"))

    wide = gap.select("sid", "up", F.col("need").alias("gap"))
    coarse = moving(wide).groupBy("sid", F.floor(F.col("away") / BINS).alias("bin")).agg(F.sum("size").alias("size"))
    first = stage(nearest_bin(gap.select("sid", "need"), coarse, "bin").select("sid", F.col("bin").alias("high_bin"), F.col("left").alias("need")))
    inside = moving(wide.join(first, "sid")).where(F.floor(F.col("away") / BINS) == F.col("high_bin"))
    fine = inside.groupBy("sid", (F.col("away") % BINS).alias("bin")).agg(F.sum("size").alias("size"))
    second = nearest_bin(first.select("sid", "need"), fine, "bin")
    # The last bin is taken if that comes nearer to the target than leaving it.
    takes = F.when(2 * F.col("left") > F.col("size"), F.col("bin")).otherwise(F.col("bin") - 1)
    limit = first.join(second.select("sid", takes.alias("low_bin")), "sid").select("sid", (F.col("high_bin") * BINS + F.col("low_bin")).alias("limit"))
    # Where all movable words are fewer than needed, no bin reaches the need and all move.
    limit = stage(wide.join(limit, "sid", "left").select(F.col("sid").alias("_sid"), "up", "gap", F.coalesce("limit", F.lit(last)).alias("limit")))
    moves = F.coalesce(movable & (away <= F.col("limit")), F.lit(False))
    step = F.when(moves, F.when(F.col("up"), 1).otherwise(-1)).otherwise(0)
    out = rated.join(limit, F.col("sid") == F.col("_sid"), "left").withColumns({"base": F.col("base") + step, "moved": F.col("moved") | moves})
    return stage(out.select(*rated.columns))


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_copies: int = 3, seed: int = 1, near: float = 0.002,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """How often each document is taken: ``id_col``, ``source``, ``size``, ``source_size``, ``target``, ``rate``, ``copies``, ``taken``.

    One row per row of ``docs``; other columns are left out. Size is the number of words (null text: 0)
    and ``taken`` is ``copies * size``, with 0 to ``max_copies`` copies. Null is a source of its own.
    Totals are mended until all lie within ``near`` of their targets, or single documents are too large
    for that. Copies depend on id, text and seed, so reruns agree, and repeated rows are rounded alike; a source
    that is mostly repeats of one row can therefore miss its target by these. An empty text is taken
    once. A source without words has the target 0. An empty table gives an empty result.
    """
    rows = measure(docs, id_col, text_col, source_col, seed)
    counts = stage(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sizes = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = stage(source_targets(sizes, weights, max_copies))
    key = targets.select("sid", F.col("source").alias("_s"))
    by_sid = stage(counts.where("size > 0").join(key, F.col("source").eqNullSafe(F.col("_s"))).select("sid", "size", "n"))
    tilt = multipliers(targets, by_sid, max_copies)
    known = stage(targets.join(tilt, "sid", "left").select("sid", F.col("source").alias("_s"), "source_size", "target", "multiplier"))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(
        F.coalesce(F.least(F.exp(F.least(F.col("multiplier") * F.col("size"), F.lit(700.0))), F.lit(float(max_copies))), F.lit(float(max_copies)))
    )
    raised = F.col("rate") + F.col("draw") / float(1 << 52)
    rated = rows.join(known, F.col("source").eqNullSafe(F.col("_s"))).withColumn("rate", rate)
    rated = rated.withColumns({"base": F.least(F.floor(raised), F.lit(max_copies)).cast("int"), "part": raised - F.floor(raised)})
    rated = stage(rated.select("id", "sid", "source", "size", "source_size", "target", "rate", "base", "part", F.lit(False).alias("moved")))
    for _ in range(MEND_ROUNDS):
        gap = rated.groupBy("sid").agg((F.first("target") - F.sum(F.col("size") * F.col("base"))).alias("gap"), F.first("target").alias("target"))
        gap = stage(gap.where(F.abs("gap") > F.col("target") * near).select("sid", (F.col("gap") > 0).alias("up"), F.abs("gap").alias("need")))
        if gap.isEmpty():
            break
        rated = mended(rated, gap, max_copies)
    copies = F.col("base").cast("bigint")
    return rated.select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", "rate", copies.alias("copies"), (F.col("size") * copies).alias("taken")
    )

"""Exact nearest vectors for a table of queries, of any number.

Queries are packed into blocks of about ``QUERY_BLOCK`` and vectors into blocks where they lie; every
block of the one meets every block of the other in one matrix product, and a task keeps the best ``k``
per query. No query passes through the driver: Spark broadcasts the packed queries by their measured
size or else reads them next to each part of the vectors. Vectors are never shuffled.

An :class:`Index` holds the vectors in blocks of near ones, each with its centre and radius. By the
triangle inequality no vector of a block scores above ``query . centre + |query| * radius``, so a
query first visits its most promising blocks and then only those whose bound reaches its k-th score
so far. The result is the same; what is scored is a share that the index reports. After the first
visits, blocks of queries meet blocks of vectors as above, and a task scores the queries of a block that
reach the other; pairs of a query and a block are not rows, as they may be as many as queries times blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.operators import kmeans
from thicket.ordering import top_per_key
from thicket.session import batch_bytes, stage

QUERY_BLOCK = 4096
STEP = 1024
#: Bytes of pairs of blocks that go to a worker at once; one pair is about four megabytes at 64 dimensions.
PAIR_BYTES = 4 << 20
#: Vectors of an index that its coarse clustering is fitted on, at most about this many; all are assigned.
SAMPLE = 200_000
BLOCK_ROWS = 1024
MOST_CELLS = 4096
#: Blocks of a directory part, which meets a block of queries at once.
DIRECTORY = 4096
#: Blocks that a query visits before its bounds are used.
FIRST = 2
#: Columns of the blocks that a query has visited; their numbers are whole in a double.
VISITED = tuple(f"visited_{i}" for i in range(FIRST))
#: Scores are rounded to nine digits; a bound has to clear a score by more than this to exclude a block.
MARGIN = 1e-8
#: Blocks of queries whose best a task holds, about a megabyte each at ten a query; more are sent on as they are.
HELD = 128


def _matrix(column: pa.Array | pa.ChunkedArray, normalize: bool) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    m = column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1)
    if normalize:
        length = np.linalg.norm(m, axis=1, keepdims=True)
        m = m / np.where(length > 0, length, 1.0)
    return m


class Best:
    """The best ``k`` vectors of each query of a block so far, ties by id."""

    def __init__(self, ids: pa.Array, queries: np.ndarray, tags: pa.Array | None, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.floor = np.full(len(queries), -np.inf)
        self.found: pa.Table | None = None
        if tags is not None:  # queries with the same tags share a column of the test matrix
            listed = [tuple(sorted(set(t or ()), key=repr)) for t in tags.to_pylist()]
            self.groups = list(dict.fromkeys(listed))
            place = {g: i for i, g in enumerate(self.groups)}
            self.group_of = np.array([place[t] for t in listed], np.int64)

    def add(self, ids: pa.Array, x: np.ndarray, tags: pa.Array | None, some: np.ndarray | None = None) -> None:
        """Score vectors for all queries, or for those at the places ``some``."""
        some = np.arange(len(self.queries)) if some is None else some
        for at in range(0, len(x), STEP):
            part = x[at : at + STEP]
            fits = code = None
            if tags is not None:
                coded = tags.slice(at, len(part)).dictionary_encode()
                names = coded.dictionary.to_pylist()
                fits = np.array([[n in g for n in names] + [False] for g in self.groups])
                code = coded.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)
            found = [self._reaching(part, some[of : of + STEP], fits, code) for of in range(0, len(some), STEP)]
            query, row, score = (np.concatenate(c) for c in zip(*found, strict=True))
            self.merge(pa.table({"q": pa.array(query), "id": ids.slice(at, len(part)).take(pa.array(row)), "score": pa.array(score)}))

    def _reaching(self, part: np.ndarray, some: np.ndarray, fits: np.ndarray | None, code: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) that may be among the best, of at most ``STEP`` vectors and queries: a matrix of eight megabytes."""
        scores = self.queries[some] @ part.T
        np.round(scores, 9, out=scores)
        scores += 0.0
        if fits is not None:
            scores[~fits[self.group_of[some]][:, code]] = -np.inf
        low = self.floor[some]
        if len(part) > self.k:
            low = np.maximum(low, np.partition(scores, len(part) - self.k, axis=1)[:, len(part) - self.k])
        query, row = np.nonzero((scores >= low[:, None]) & np.isfinite(scores))
        return some[query], row, scores[query, row]

    def merge(self, new: pa.Table) -> None:
        both = new if self.found is None else pa.concat_tables([self.found, new])
        both = both.sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")])
        q = both["q"].to_numpy()
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        self.found = both.filter(pa.array(rank < self.k))
        full = both.filter(pa.array(rank == self.k - 1))
        self.floor[full["q"].to_numpy()] = full["score"].to_numpy()

    def result(self) -> pa.Table:
        return pa.table({"query_id": self.ids.take(self.found["q"].combine_chunks()), "id": self.found["id"], "score": self.found["score"]})


def packed_queries(queries: DataFrame, normalize: bool, block: int = QUERY_BLOCK, extra: tuple[str, ...] = ()) -> DataFrame:
    """Written blocks of queries: ``qb``, ``q_ids``, ``q_tags``, ``q_data`` and a list of each extra column of doubles."""
    count = max(1, -(-queries.count() // block))
    tagged = "tags" in queries.columns
    kinds = dict(queries.dtypes)
    dealt = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(count)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        one = {"qb": table["qb"][0].as_py(), "q_ids": table["query_id"].to_pylist(), "q_tags": table["tags"].to_pylist() if tagged else None}
        one |= {"q_data": _matrix(table["emb"], normalize).tobytes(), **{c: table[c].to_pylist() for c in extra}}
        return pa.table({n: pa.array([v], t) for (n, v), t in zip(one.items(), types, strict=True)})

    types = [pa.int32(), pa.list_(_arrow(queries, "query_id")), pa.list_(_arrow(queries, "tags") if tagged else pa.string()), pa.binary(), *[pa.list_(pa.float64())] * len(extra)]
    schema = f"qb int, q_ids array<{kinds['query_id']}>, q_tags array<{kinds.get('tags', 'string')}>, q_data binary" + "".join(f", {c} array<double>" for c in extra)
    return stage(dealt.groupBy("qb").applyInArrow(pack, schema))


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _scan(batches: Iterator[pa.RecordBatch], k: int, tagged: bool, reached: Callable[[np.ndarray, pa.RecordBatch, int], np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of one block of vectors and one block of queries each: the best of every block of queries that a task sees.

    With ``reached``, only the queries at the places it returns are scored, by their ``floor`` from the start.
    What is held of a block of queries are its ids and its best; its vectors come with every row.
    """
    held: dict[int, Best] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for own in held.values():
            if own.found is not None:
                yield from own.result().to_batches()
        held.clear()

    for batch in batches:
        for row in range(len(batch)):
            ids, names = batch.column("ids")[row].values, batch.column("q_ids")[row].values
            if not len(ids) or not len(names):
                continue
            queries = np.frombuffer(batch.column("q_data")[row].as_py()).reshape(len(names), -1)
            some = reached(queries, batch, row) if reached else None
            if some is not None and not len(some):
                continue
            number = batch.column("qb")[row].as_py()
            if number not in held:
                if len(held) == HELD:
                    yield from sent()
                copied = names.take(pa.array(np.arange(len(names))))  # a slice would keep its whole batch
                held[number] = Best(copied, queries, batch.column("q_tags")[row].values if tagged else None, k)
                if reached:
                    held[number].floor = _numbers(batch, "floor", row).copy()
            own = held[number]
            own.queries = queries
            own.add(ids, np.frombuffer(batch.column("data")[row].as_py()).reshape(len(ids), -1), batch.column("tags")[row].values if tagged else None, some)
            own.queries = None
    yield from sent()


def _numbers(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray:
    return batch.column(column)[row].values.to_numpy()


def _upper(q: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """What no vector of a block scores above, per query and block."""
    return q @ centres.T + np.linalg.norm(q, axis=1)[:, None] * radius[None] + MARGIN


def _reaching(bound: np.ndarray, blocks: np.ndarray, batch: pa.RecordBatch, row: int) -> np.ndarray:
    """Whether a bound reaches the floor of its query and the query has not visited the block."""
    open_ = bound >= _numbers(batch, "floor", row)[:, None]
    for done in VISITED:
        open_ &= _numbers(batch, done, row)[:, None] != blocks[None]
    return open_


def _reached(q: np.ndarray, batch: pa.RecordBatch, row: int) -> np.ndarray:
    """Places of the queries of a block that reach the row's block of vectors."""
    centre = np.frombuffer(batch.column("centre")[row].as_py())[None]
    block, radius = (batch.column(c)[row].as_py() for c in ("block", "radius"))
    return np.flatnonzero(_reaching(_upper(q, centre, np.array([radius])), np.array([block]), batch, row)[:, 0])


def packed_vectors(vectors: DataFrame, normalize: bool) -> DataFrame:
    """Vectors in blocks where they lie: ``ids``, ``tags`` and ``data``."""
    kinds, tagged = dict(vectors.dtypes), "tag" in vectors.columns
    id_type, tag_type = _arrow(vectors, "id"), _arrow(vectors, "tag") if tagged else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), QUERY_BLOCK):
                part = batch.slice(at, QUERY_BLOCK)
                tags = part.column("tag").to_pylist() if tagged else None
                columns = [pa.array([part.column("id").to_pylist()], pa.list_(id_type)), pa.array([tags], pa.list_(tag_type)), pa.array([_matrix(part.column("emb"), normalize).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "tags", "data"])

    return vectors.mapInArrow(run, f"ids array<{kinds['id']}>, tags array<{kinds.get('tag', 'string')}>, data binary")


def _columns(queries: DataFrame, vectors: DataFrame, tag: str | None, tags: str | None) -> tuple[DataFrame, DataFrame]:
    asked = queries.select("query_id", "emb", *([F.col(tags).alias("tags")] if tag else []))
    return asked, vectors.select("id", "emb", *([F.col(tag).alias("tag")] if tag else []))


def top_k(
    queries: DataFrame,
    vectors: DataFrame | Index,
    k: int,
    normalize: bool = True,
    tag: str | None = None,
    tags: str | None = None,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best vectors of every query, ties by id.

    ``queries`` has (query_id, emb), ``vectors`` (id, emb) or is an :class:`Index` of them. Cosine by
    default; the raw inner product with ``normalize=False``. With ``tag`` (a column of ``vectors``)
    and ``tags`` (an array column of ``queries``) a query only sees vectors whose tag it lists.
    Without an index the result is written, as pairs of blocks need small batches while they are scored.
    """
    if isinstance(vectors, Index):
        return vectors.top_k(queries, k, tags, query_block)
    asked, pool = _columns(queries, vectors, tag, tags)
    blocks = packed_queries(asked, normalize, query_block)
    schema = f"query_id {dict(asked.dtypes)['query_id']}, id {dict(pool.dtypes)['id']}, score double"
    pairs = packed_vectors(pool, normalize).crossJoin(blocks)  # of blocks
    local = pairs.mapInArrow(partial(_scan, k=k, tagged=tag is not None), schema)
    with batch_bytes(queries.sparkSession, PAIR_BYTES):
        return stage(top_per_key(local, ["query_id"], [F.desc("score"), "id"], k, rank="rank"))


def all_scores(queries: DataFrame, vectors: DataFrame, normalize: bool = True) -> DataFrame:
    """(query_id, id, score) of every query with every vector, for reports that want them all."""
    asked, pool = _columns(queries, vectors, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                names, ids = batch.column("q_ids")[row].values, batch.column("ids")[row].values
                if not len(names) or not len(ids):
                    continue
                q = np.frombuffer(batch.column("q_data")[row].as_py()).reshape(len(names), -1)
                x = np.frombuffer(batch.column("data")[row].as_py()).reshape(len(ids), -1)
                for i in range(len(names)):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array([i] * len(ids))), ids, pa.array(x @ q[i])], ["query_id", "id", "score"])

    schema = f"query_id {dict(asked.dtypes)['query_id']}, id {dict(pool.dtypes)['id']}, score double"
    return packed_vectors(pool, normalize).crossJoin(packed_queries(asked, normalize)).mapInArrow(run, schema)  # of blocks


class Index:
    """Vectors written in blocks of near ones, with the directory of their centres and radii.

    A coarse k-means, fitted on about ``SAMPLE`` vectors chosen by a hash of their ids, gives the cells;
    every vector is written to the cell of its nearest centre, in blocks of about ``BLOCK_ROWS``. The
    centre and radius of a block are those of its own vectors, so bounds hold whatever the cells are.
    """

    def __init__(self, vectors: DataFrame, normalize: bool = True, tag: str | None = None):
        self.normalize, self.tagged = normalize, tag is not None
        pool = stage(vectors.where(F.col("emb").isNotNull()).select("id", "emb", *([F.col(tag).alias("tag")] if tag else [])))
        self.kind, self.count = dict(pool.dtypes)["id"], pool.count()
        cells = min(MOST_CELLS, -(-self.count // BLOCK_ROWS))
        named = pool.select(F.lit(0).alias("group"), F.col("id").cast("string").alias("node_id"), "emb")
        keep = max(1, self.count // SAMPLE)
        grid = stage(kmeans.on_grid(named))
        fitted = grid.where(F.pmod(F.xxhash64("node_id", F.lit(7)), F.lit(keep)) == 0)
        wanted = pool.sparkSession.createDataFrame([(0, max(1, cells))], "group long, k int")
        some = kmeans.packed(fitted)
        centres = kmeans.lloyd(some, kmeans.seeds(fitted, some, wanted), rounds=5)
        cell = kmeans.labels(kmeans.packed(grid) if keep > 1 else some, centres).select(F.col("node_id").alias("_n"), F.col("centre").alias("cell"))
        placed = pool.join(cell, F.col("id").cast("string") == F.col("_n")).drop("_n")
        parts = cell.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("parts"))
        dealt = placed.join(parts, "cell").withColumn("slice", F.pmod(F.xxhash64("id"), "parts")).drop("parts")
        self.blocks = stage(dealt.groupBy("cell", "slice").applyInArrow(*self._packer(pool)))
        self.directory = stage(self._directory())

    def _packer(self, pool: DataFrame) -> tuple[Callable[[pa.Table], pa.Table], str]:
        normalize, tagged = self.normalize, self.tagged
        id_type, tag_type = _arrow(pool, "id"), _arrow(pool, "tag") if tagged else pa.string()

        def pack(table: pa.Table) -> pa.Table:
            table = table.sort_by("id")
            x = _matrix(table["emb"], normalize)
            centre = x.mean(0)
            radius = float(np.sqrt(((x - centre) ** 2).sum(1)).max())
            block = table["cell"][0].as_py() << 32 | table["slice"][0].as_py()
            tags = table["tag"].to_pylist() if tagged else None
            values = (block, len(table), table["id"].to_pylist(), tags, x.tobytes(), centre.tobytes(), radius)
            types = (pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(tag_type), pa.binary(), pa.binary(), pa.float64())
            names = ("block", "n", "ids", "tags", "data", "centre", "radius")
            return pa.table({n: pa.array([v], t) for n, v, t in zip(names, values, types, strict=True)})

        kinds = dict(pool.dtypes)
        return pack, f"block long, n long, ids array<{kinds['id']}>, tags array<{kinds.get('tag', 'string')}>, data binary, centre binary, radius double"

    def _directory(self) -> DataFrame:
        rows = self.blocks.select("block", "centre", "radius")
        parts = max(1, -(-rows.count() // DIRECTORY))

        def pack(table: pa.Table) -> pa.Table:
            return pa.table({
                "blocks": pa.array([table["block"].to_pylist()], pa.list_(pa.int64())), "centres": pa.array([b"".join(table["centre"].to_pylist())], pa.binary()),
                "radii": pa.array([table["radius"].to_pylist()], pa.list_(pa.float64())),
            })

        return rows.groupBy(F.pmod(F.xxhash64("block"), F.lit(parts)).alias("part")).applyInArrow(pack, "blocks array<long>, centres binary, radii array<double>")

    def _bounds(self, packed: DataFrame, kind: str, choose: Callable[[np.ndarray, np.ndarray, pa.RecordBatch, int], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        """(query_id, block, bound) for the pairs that ``choose`` picks from the matrix of bounds of two blocks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(len(batch)):
                    ids, blocks = batch.column("q_ids")[row].values, batch.column("blocks")[row].values
                    q = np.frombuffer(batch.column("q_data")[row].as_py()).reshape(len(ids), -1)
                    c = np.frombuffer(batch.column("centres")[row].as_py()).reshape(len(blocks), -1)
                    bound = _upper(q, c, _numbers(batch, "radii", row))
                    a, b = choose(bound, blocks.to_numpy(), batch, row)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), blocks.take(pa.array(b)), pa.array(bound[a, b])], ["query_id", "block", "bound"])

        return self.directory.crossJoin(packed).mapInArrow(run, f"query_id {kind}, block long, bound double")  # of blocks

    def _visit(self, pairs: DataFrame, asked: DataFrame, k: int, query_block: int) -> DataFrame:
        """(query_id, id, score): the best ``k`` of every pair of a query and a block; a block many queries visit is read in several tasks."""
        tagged, kinds = self.tagged, dict(asked.dtypes)
        chunks = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / query_block).alias("chunks"))
        dealt = pairs.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("query_id"), "chunks")).select("query_id", "block", "chunk")
        asking = dealt.hint("merge").join(asked, "query_id")  # ids pack well: the size of their files says little
        read = dealt.select(F.col("block").alias("b"), F.col("chunk").alias("c")).distinct()
        where = read.join(self.blocks.select(F.col("block").alias("b"), "ids", "tags", "data"), "b")
        normalize = self.normalize

        def score(one: pa.Table, vectors: pa.Table) -> pa.Table:
            best = Best(one["query_id"].combine_chunks(), _matrix(one["emb"], normalize), one["tags"].combine_chunks() if tagged else None, k)
            ids = vectors["ids"][0].values
            best.add(ids, np.frombuffer(vectors["data"][0].as_py()).reshape(len(ids), -1), vectors["tags"][0].values if tagged else None)
            return best.result()

        schema = f"query_id {kinds['query_id']}, id {self.kind}, score double"
        return asking.groupBy("block", "chunk").cogroup(where.groupBy("b", "c")).applyInArrow(lambda a, b: score(a, b), schema)

    def search(self, queries: DataFrame, k: int, tags: str | None = None, query_block: int = QUERY_BLOCK) -> tuple[DataFrame, DataFrame]:
        """The result of :func:`top_k`, and the pairs ``(query_id, block)`` that were scored for it."""
        asked = stage(queries.select("query_id", "emb", *([F.col(tags).alias("tags")] if self.tagged else [])))
        kind = dict(asked.dtypes)["query_id"]

        def leading(bound: np.ndarray, *_) -> tuple[np.ndarray, np.ndarray]:
            some = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST]
            return np.repeat(np.arange(len(bound)), some.shape[1]), some.ravel()

        promising = self._bounds(packed_queries(asked, self.normalize, query_block), kind, leading)
        first = stage(top_per_key(promising, ["query_id"], [F.desc("bound"), "block"], FIRST).select("query_id", "block"))
        seen = stage(top_per_key(self._visit(first, asked, k, query_block), ["query_id"], [F.desc("score"), "id"], k))
        floor = seen.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
        blocks = first.groupBy("query_id").agg(F.collect_list("block").alias("_done"))
        done = [F.coalesce(F.get("_done", F.lit(i)), F.lit(-1)).cast("double").alias(c) for i, c in enumerate(VISITED)]
        known = asked.join(floor, "query_id", "left").join(blocks, "query_id", "left")
        known = known.select(*asked.columns, F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), *done)
        packed = packed_queries(known, self.normalize, query_block, ("floor", *VISITED))
        pairs = self.blocks.hint("shuffle_replicate_nl").crossJoin(packed)  # of blocks
        rest = pairs.mapInArrow(partial(_scan, k=k, tagged=self.tagged, reached=_reached), f"query_id {kind}, id {self.kind}, score double")
        second = self._bounds(packed, kind, lambda bound, blocks, batch, row: np.nonzero(_reaching(bound, blocks, batch, row)))
        best = top_per_key(seen.unionByName(rest), ["query_id"], [F.desc("score"), "id"], k, rank="rank")
        return best, first.unionByName(second.select("query_id", "block"))

    def top_k(self, queries: DataFrame, k: int, tags: str | None = None, query_block: int = QUERY_BLOCK) -> DataFrame:
        return self.search(queries, k, tags, query_block)[0]

    def share(self, pairs: DataFrame) -> DataFrame:
        """(scored, pairs, share): how many pairs of a query and a vector the pairs of :meth:`search` stand for, of all."""
        asked = pairs.select("query_id").distinct().count()
        scored = pairs.join(self.blocks.select("block", "n"), "block").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scored"))
        return scored.select("scored", F.lit(asked * self.count).alias("pairs"), (F.col("scored") / F.greatest(F.lit(asked * self.count), F.lit(1))).alias("share"))

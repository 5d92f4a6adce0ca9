"""From a table of questions to triples, chunks and previews."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.operators import retrieval as rt
from thicket.ordering import top_per_key
from thicket.session import stage


class Answer:
    """Both retrieval paths for every question, merged and cut; each result is made when asked for.

    ``k`` is the depth of the paths, ``keep`` the number of merged triples and searched chunks.
    ``limits`` are those of ``retrieval.candidate_nodes``; none by default. ``vectors_of`` is that of
    ``retrieval.rerank_triples``.
    Lists that several results read are staged once.
    """

    def __init__(
        self,
        queries: DataFrame,
        nodes: DataFrame,
        edges: DataFrame,
        node_vecs: DataFrame,
        relation_vecs: DataFrame,
        edge_vecs: DataFrame,
        chunk_vecs: DataFrame,
        chunks: DataFrame,
        k: int = 5,
        keep: int = 20,
        limits: Mapping[str, int] | None = None,
        vectors_of: Callable[[DataFrame], DataFrame] | None = None,
    ):
        self.queries, self.nodes, self.edges, self.chunk_table = stage(queries), nodes, edges, chunks
        self.node_vecs, self.relation_vecs = node_vecs, relation_vecs
        self.edge_vecs, self.chunk_vecs = edge_vecs, chunk_vecs
        self.k, self.keep, self.limits, self.vectors_of = k, keep, dict(limits or {}), vectors_of

    @cached_property
    def by_node(self) -> tuple[DataFrame, DataFrame]:
        """Top nodes and the triples expanded from them."""
        return rt.node_relation_path(
            self.queries, self.nodes, self.edges, self.node_vecs, self.relation_vecs, self.k, **self.limits
        )

    @cached_property
    def by_triple(self) -> DataFrame:
        """Scored triples near the best triples."""
        return rt.triple_path(self.queries, self.edges, self.edge_vecs, self.node_vecs, self.k)

    @cached_property
    def triples(self) -> DataFrame:
        """(query_id, seq, src, relation, dst, score, rank) of both paths."""
        reranked = rt.rerank_triples(self.by_node[1], self.queries, self.nodes, self.edges, self.edge_vecs, self.vectors_of)
        return stage(rt.merge_scored([self.by_triple, reranked], self.keep))

    @property
    def triple_texts(self) -> DataFrame:
        """(query_id, rank, txt)."""
        return rt.format_triples(self.triples, self.nodes)

    @cached_property
    def found_chunks(self) -> DataFrame:
        return stage(rt.search_chunks(self.queries, self.chunk_vecs, self.keep))

    @property
    def ranked_chunks(self) -> DataFrame:
        return rt.rerank_chunks(self.found_chunks, self.queries, self.chunk_vecs)

    @property
    def path_chunks(self) -> DataFrame:
        """(query_id, chunk_id) of both paths and the chunk search, cut to ``k``."""
        ids = (
            rt.chunk_ids(self.by_node[0], self.nodes)
            .unionByName(rt.chunk_ids(rt.triple_ends(self.by_triple), self.nodes))
            .unionByName(self.found_chunks.where(F.col("rank") <= self.k).select("query_id", "chunk_id"))
        )
        return top_per_key(ids.distinct(), ["query_id"], ["chunk_id"], self.k)

    @property
    def chunks(self) -> DataFrame:
        """(query_id, chunk_id, text) behind the merged triples and the best chunks."""
        of_triples = rt.chunk_ids(rt.triple_ends(self.triples), self.nodes)
        ids = of_triples.unionByName(self.ranked_chunks.select("query_id", "chunk_id")).distinct()
        return rt.chunk_texts(ids, self.chunk_table).select("query_id", "chunk_id", "text")

    @property
    def previews(self) -> DataFrame:
        """(query_id, rank, chunk_id, preview)."""
        return rt.format_chunks(self.ranked_chunks, self.chunk_table, shown=200)

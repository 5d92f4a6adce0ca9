"""Batch retrieval over a graph: a table of queries in, ranked rows out.

Frames: ``nodes`` (node_id, label, name, description, schema_type, chunk_id), ``edges`` (seq,
src, relation, dst) without duplicates, vectors (id, emb), ``queries`` (query_id, text, emb,
types as an array), seeds (query_id, node_id, …). Every join is an equi-join on ids, so hubs
are handled by the join's skew splitting, and lists are cut by group limits before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.text import decimals, node_text, property_list, valid_node_text
from thicket.functions.vector import add, cosine, similarity, triple_score
from thicket.operators.graphbuild import first_relations
from thicket.operators.search import Index, all_scores, top_k
from thicket.ordering import dense_index, first_per_key, top_per_key
from thicket.session import stage

MIN_SCORE = 0.05
TRIPLE_THRESHOLD = 0.1

# Words that are no keywords.
STOP_WORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by "
    "can could did do does doing down during each few for from further had has have having he her here hers him his how "
    "i if in into is it its just me more most my no nor not of off on once only or other our out over own same she so "
    "some such than that the their them then there these they this those through to too under until up very was we were "
    "what when where which while who whom why will with would you your"
).split()


# ---- text of nodes and keywords


def node_texts(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", node_text(F.col("name"), F.col("description"), F.col("node_id")).alias("txt"))


def nodes_of_types(nodes: DataFrame, types: list[str]) -> DataFrame:
    """Nodes of the given types, and entities without a type; all nodes when no type is given."""
    if not types:
        return nodes
    return nodes.where(F.array_contains(F.lit([*types, ""]), type_tag()))


def type_tag() -> Column:
    """What a type filter sees: the type, '' for an entity without one, null for anything else."""
    untyped = F.coalesce("schema_type", F.lit("")) == ""
    return F.when(~untyped, F.col("schema_type")).when(F.col("label") == "entity", F.lit(""))


def keywords(queries: DataFrame) -> DataFrame:
    """(query_id, word): lower-cased words over two letters that are no stop words."""
    words = F.split(F.lower("text"), r"[^\p{L}\p{N}#]+")
    kept = F.filter(F.array_distinct(words), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))
    return queries.select("query_id", F.explode(kept).alias("word"))


def text_index(nodes: DataFrame) -> DataFrame:
    """Inverted index (word, node_id) of lower-cased blank-separated words over two letters."""
    words = F.array_distinct(F.split(F.lower("txt"), r"\s+"))
    rows = node_texts(nodes).select(F.explode(words).alias("word"), "node_id")
    return rows.where(F.length("word") > 2)


def keyword_hits(asked: DataFrame, index: DataFrame, per_word: int | None = None, stop_after: int | None = None) -> DataFrame:
    """Nodes whose text has a query's keyword; all of them unless a limit is given.

    With ``per_word``, that many nodes per word count (by id); the limit is on the index, before the
    join, so a word in a third of all nodes sends few rows. With ``stop_after``, words are taken in
    order until more than that many nodes are found.
    """
    used = index.join(asked.select("word").distinct(), "word", "left_semi")
    hits = asked.join(used if per_word is None else top_per_key(used, ["word"], ["node_id"], per_word), "word")
    if stop_after is None:
        return hits.select("query_id", "node_id").distinct()
    first = hits.groupBy("query_id", "node_id").agg(F.min("word").alias("word"))
    new = first.groupBy("query_id", "word").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("query_id").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    reached = new.withColumn("found", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("found") <= stop_after)
    return first.join(reached.select("query_id", "word"), ["query_id", "word"], "left_semi").select("query_id", "node_id")


def substring_hits(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes whose text contains any of a query's keywords as a substring.

    A keyword has at least three letters, so a text that contains it has its first three in a
    row: texts and keywords join on that, and only those pairs are compared in full.
    """
    words = asked.select("word").distinct().withColumn("gram", F.substring("word", 1, 3))
    texts = node_texts(nodes).select("node_id", F.lower("txt").alias("txt"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("txt") - 2, F.lit(1)))
    grams = F.array_distinct(F.transform(starts, lambda i: F.col("txt").substr(i, F.lit(3))))
    # only ids are multiplied by grams; a text meets each of its candidate words once
    pairs = texts.select("node_id", F.explode(grams).alias("gram")).join(words, "gram").select("node_id", "word")
    found = pairs.join(texts, "node_id").where(F.contains("txt", F.col("word"))).select("node_id", "word")
    return asked.join(found, "word").select("query_id", "node_id").distinct()


# ---- neighbourhoods


def named(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Triples with the names of both ends."""
    names = nodes.select("node_id", "name")
    h = names.select(F.col("node_id").alias("src"), F.col("name").alias("src_name"))
    t = names.select(F.col("node_id").alias("dst"), F.col("name").alias("dst_name"))
    return triples.join(h, "src").join(t, "dst")


def touching(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, seq, src, relation, dst): edges with a seed at either end, once per query."""
    s = seeds.select("query_id", F.col("node_id").alias("_n")).distinct()
    out = edges.join(s, F.col("src") == F.col("_n"))
    into = edges.join(s, F.col("dst") == F.col("_n"))
    return out.unionByName(into).select("query_id", "seq", "src", "relation", "dst").distinct()


def first_touching(nodes: DataFrame, edges: DataFrame, order: list, k: int) -> tuple[DataFrame, DataFrame]:
    """The first ``k`` out-edges and in-edges of each listed node.

    Enough to find the first ``k`` edges of any set of these nodes, or to tell whether the set
    touches ``k`` edges at all, and a hub gives ``k`` rows instead of all its edges.
    """
    ids = nodes.select("node_id").distinct()
    out = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi")
    into = edges.join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return top_per_key(out, ["src"], order, k), top_per_key(into, ["dst"], order, k)


def around(seeds: DataFrame, edges: DataFrame, steps: int) -> DataFrame:
    """Distinct nodes (node_id) within ``steps`` out-edges of any seed, as a written table.

    Its size is known, so a few of them pick their edges where these lie.
    """
    nodes = stage(seeds.select("node_id").distinct())
    for _ in range(steps):
        out = edges.join(nodes.withColumnRenamed("node_id", "src"), "src", "left_semi").select(F.col("dst").alias("node_id"))
        nodes = stage(nodes.unionByName(out).distinct())
    return nodes


def one_hop(seeds: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """The first ``k`` edges that touch a query's seeds."""
    out, into = first_touching(seeds, edges, ["seq"], k)
    s = seeds.select("query_id", F.col("node_id").alias("_n")).distinct()
    found = out.join(s, F.col("src") == F.col("_n")).unionByName(into.join(s, F.col("dst") == F.col("_n")))
    rows = found.select("query_id", "seq", "src", "relation", "dst").distinct()
    return top_per_key(rows, ["query_id"], ["seq"], k)


def expand_neighbours(seeds: DataFrame, edges: DataFrame, cumulative: bool = False) -> DataFrame:
    """Edges both ways between seeds and their out-neighbours, one parallel edge per pair.

    ``cumulative`` pairs a seed (by ``rank``) with the out-neighbours of earlier seeds as well.
    """
    ends = around(seeds, edges, 1)  # every wanted pair lies in it
    inside = edges.join(ends.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ends.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    first = stage(first_relations(inside))
    rank = F.col("rank") if "rank" in seeds.columns else F.lit(1)
    s = seeds.select("query_id", "node_id", rank.alias("rank"))
    near = s.join(first.select(F.col("src").alias("node_id"), F.col("dst").alias("near")), "node_id")
    if cumulative:
        seen = near.groupBy("query_id", "near").agg(F.min("rank").alias("_since"))
        pairs = s.join(seen, "query_id").where(F.col("_since") <= F.col("rank"))
    else:
        pairs = near
    both = F.array(
        F.struct(F.col("node_id").alias("src"), F.col("near").alias("dst")),
        F.struct(F.col("near").alias("src"), F.col("node_id").alias("dst")),
    )
    wanted = pairs.select("query_id", F.inline(both)).distinct()
    return wanted.join(first, ["src", "dst"]).where(F.coalesce("relation", F.lit("")) != "").select(
        "query_id", "src", "relation", "dst"
    )


def relation_matched(seeds: DataFrame, edges: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges that touch a query's seeds and have one of its relations (query_id, relation).

    Seeds meet edges by node and relation at once, so the other edges of a hub are not expanded.
    """
    wanted = relations.select("query_id", "relation").distinct()
    s = stage(seeds.select("query_id", F.col("node_id").alias("_n")).distinct().join(wanted, "query_id"))
    triples = edges.select("src", "relation", "dst")
    found = [triples.join(s.withColumnRenamed("_n", end), [end, "relation"]) for end in ("src", "dst")]
    return found[0].unionByName(found[1]).select("query_id", "src", "relation", "dst").distinct()


def reachable(seeds: DataFrame, edges: DataFrame, known: DataFrame, hops: int = 3, key: str = "query_id") -> DataFrame:
    """(key, node_id, hop): nodes that a key's seeds reach within ``hops`` out-edges, seeds at hop 0.

    Only nodes in ``known`` count. All keys search at once: they are numbered, and a row holds the keys
    that have reached a node, 64 of them in the bits of a number. A hop joins the bits that are new
    with the distinct edges and merges them by a bitwise OR, which combines before the shuffle; so it
    ships at most edges times words of bits, however many keys pass through a hub.
    """
    ids = known.select(F.col("id").alias("dst")).distinct()
    steps = stage(edges.select("src", "dst").distinct().join(ids, "dst", "left_semi"))
    numbered = stage(dense_index(seeds.select(F.col(key).alias("_key")).distinct(), [], ["_key"], "_no"))
    merged = F.bit_or("bits").alias("bits")
    own = seeds.select(F.col(key).alias("_key"), "node_id").join(ids, F.col("node_id") == F.col("dst"), "left_semi").join(numbered, "_key")
    own = own.select("node_id", F.floor((F.col("_no") - 1) / 64).alias("word"), F.expr("shiftleft(1L, cast((_no - 1) % 64 AS int))").alias("bits"))
    new = stage(own.groupBy("node_id", "word").agg(merged))
    found, visited = [new.withColumn("hop", F.lit(0))], new
    for hop in range(1, hops + 1):
        reached = new.join(steps, F.col("node_id") == F.col("src")).groupBy(F.col("dst").alias("node_id"), "word").agg(merged)
        seen = visited.groupBy("node_id", "word").agg(F.bit_or("bits").alias("_seen"))
        left = reached.join(seen, ["node_id", "word"], "left")
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_seen", F.lit(0).cast("long"))))
        new = stage(left.select("node_id", "word", fresh.alias("bits")).where("bits <> 0"))
        visited = visited.unionByName(new)
        found.append(new.withColumn("hop", F.lit(hop)))
    every = reduce(DataFrame.unionByName, found)
    bits = F.expr("explode(filter(sequence(0, 63), i -> (shiftrightunsigned(bits, i) & 1L) = 1L))")
    rows = every.select("node_id", "word", "hop", bits.alias("_bit")).withColumn("_no", F.col("word") * 64 + F.col("_bit") + 1)
    return rows.join(numbered, "_no").select(F.col("_key").alias(key), "node_id", "hop")


def out_neighbourhood(centers: DataFrame, edges: DataFrame, known: DataFrame, hops: int = 3) -> DataFrame:
    """(center, node_id, hop): nodes within ``hops`` out-edges, the center at hop 0."""
    return reachable(centers.select("center", F.col("center").alias("node_id")), edges, known, hops, key="center")


def neighbour_triples(around: DataFrame, edges: DataFrame, known: DataFrame, key: str = "center") -> DataFrame:
    """(key, src, relation, dst): in- and out-edges of the nodes around each key, other end known."""
    ids = known.select("id").distinct()
    near = around.select(key, F.col("node_id").alias("_n")).distinct()
    out = near.join(edges, F.col("_n") == F.col("src")).join(ids, F.col("dst") == F.col("id"), "left_semi")
    into = near.join(edges, F.col("_n") == F.col("dst")).join(ids, F.col("src") == F.col("id"), "left_semi")
    return out.unionByName(into).select(key, "src", "relation", "dst").distinct()


def community_nodes(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(comm_id, node_id): members given by name; of equal names the first node counts."""
    ids = first_per_key(nodes.select("name", "node_id"), ["name"], ["node_id"])
    wanted = members.select("comm_id", F.trim("member").alias("name")).distinct()
    return wanted.join(ids, "name").select("comm_id", "node_id")


def chunk_ids(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of found nodes."""
    chunked = nodes.where(F.col("chunk_id").isNotNull()).select("node_id", "chunk_id")
    return found.select("query_id", "node_id").join(chunked, "node_id").select("query_id", "chunk_id").distinct()


def triple_ends(triples: DataFrame) -> DataFrame:
    """(query_id, node_id): both ends of a query's triples."""
    return triples.select("query_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()


def chunk_texts(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """Texts of chunk ids; ids without a chunk are dropped."""
    return ids.join(chunks.select("chunk_id", "text"), "chunk_id")


# ---- vectors of edges, searches


def edge_vectors(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """A stand-in for embedded triples: the sum of the vectors of both ends, id = seq."""
    h = vectors.select(F.col("id").alias("src"), F.col("emb").alias("_h"))
    t = vectors.select(F.col("id").alias("dst"), F.col("emb").alias("_t"))
    return edges.join(h, "src").join(t, "dst").select(F.col("seq").alias("id"), add(F.col("_h"), F.col("_t")).alias("emb"))


def search_nodes(queries: DataFrame, vectors: DataFrame, k: int, most: int | None = None) -> DataFrame:
    """Vector hits, ``3k`` per query, or ``most`` if that is less."""
    return top_k(queries, vectors, 3 * k if most is None else min(3 * k, most)).withColumnRenamed("id", "node_id")


def typed_index(nodes: DataFrame, vectors: DataFrame) -> Index:
    """An index of node vectors with what a type filter sees."""
    return Index(vectors.join(nodes.select(F.col("node_id").alias("id"), type_tag().alias("tag")), "id"), tag="tag")


def search_filtered(queries: DataFrame, nodes: DataFrame, vectors: DataFrame | Index, k: int) -> DataFrame:
    """Vector hits among the nodes a query's types admit (untyped entities always)."""
    asked = queries.withColumn("_tags", F.array_append("types", F.lit("")))
    if isinstance(vectors, Index):
        return top_k(asked, vectors, k, tags="_tags").withColumnRenamed("id", "node_id")
    tagged = vectors.join(nodes.select(F.col("node_id").alias("id"), type_tag().alias("tag")), "id")
    return top_k(asked, tagged, k, tag="tag", tags="_tags").withColumnRenamed("id", "node_id")


def similarities(queries: DataFrame, vectors: DataFrame, clipped: bool = True) -> DataFrame:
    """(query_id, id, score): the cosine of every query with every vector, none below 0 if ``clipped``."""
    scored = all_scores(queries, vectors)
    return scored.withColumn("score", F.greatest(F.lit(0.0), "score")) if clipped else scored


def scored_nodes(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, node_id, score): clipped cosine of given pairs."""
    v = vectors.select(F.col("id").alias("node_id"), F.col("emb").alias("_v"))
    q = queries.select("query_id", F.col("emb").alias("_q"))
    joined = pairs.select("query_id", "node_id").distinct().join(v, "node_id").join(q, "query_id")
    return joined.select("query_id", "node_id", F.round(similarity(F.col("_q"), F.col("_v")), 9).alias("score"))


def triple_path(queries, edges, edge_vecs, node_vecs, k: int = 5, limit: int = 50) -> DataFrame:
    """Scored triples near the best ones: (query_id, seq, src, relation, dst, score).

    The best ``k`` triples seed a three-hop neighbourhood; of the best ``min(2n, limit)`` triples
    overall, those that lie in it (``n`` triples) and score at least 0.1 are kept, ``k`` of them.
    Only the best ``limit`` are tested for lying in it, by their ends; and ``n`` is counted up to
    half of it, above which the minimum does not change, so hubs are not expanded.
    """
    best = stage(top_k(queries, edge_vecs, limit).withColumnRenamed("id", "seq"))
    wide = stage(best.join(edges, "seq"))
    key = ["query_id", "src", "relation", "dst"]
    seeds = wide.where(F.col("rank") <= k).select(*key)
    near = stage(reachable(triple_ends(seeds), edges, node_vecs).select("query_id", "node_id"))
    src_near = near.select("query_id", F.col("node_id").alias("src"))
    dst_near = near.select("query_id", F.col("node_id").alias("dst"))
    src_known = node_vecs.select(F.col("id").alias("src"))
    dst_known = node_vecs.select(F.col("id").alias("dst"))
    inside = (
        wide.join(src_near, ["query_id", "src"], "left_semi").join(dst_known, "dst", "left_semi").select(*key)
        .unionByName(wide.join(dst_near, ["query_id", "dst"], "left_semi").join(src_known, "src", "left_semi").select(*key))
        .unionByName(seeds)
        .distinct()
    )
    ids = stage(near.select("node_id").distinct())
    from_near, into_near = (
        edges.join(ids.withColumnRenamed("node_id", end), end, "left_semi").select("src", "relation", "dst").distinct() for end in ("src", "dst")
    )
    known = from_near.join(dst_known, "dst", "left_semi"), into_near.join(src_known, "src", "left_semi")
    out = first_touching(near, known[0], ["relation", "dst"], limit // 2)[0]
    into = first_touching(near, known[1], ["relation", "src"], limit // 2)[1]
    counts = (
        out.join(src_near, "src").select(*key)
        .unionByName(into.join(dst_near, "dst").select(*key))
        .unionByName(seeds)
        .distinct()
        .groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    kept = (
        wide.join(inside, key, "left_semi")
        .join(counts, "query_id")
        .where((F.col("rank") <= F.least(F.col("n") * 2, F.lit(limit))) & (F.col("score") >= TRIPLE_THRESHOLD))
        .select("query_id", "seq", "src", "relation", "dst", "score")
    )
    return stage(top_per_key(kept, ["query_id"], [F.desc("score"), "seq"], k))


def community_path(queries, comm_vecs, members, nodes, node_vecs, k: int = 3) -> DataFrame:
    """(query_id, node_id): members, with a vector, of the best communities."""
    best = top_k(queries, comm_vecs, k).select("query_id", F.col("id").alias("comm_id"))
    inside = best.join(community_nodes(members, nodes), "comm_id").select("query_id", "node_id").distinct()
    return inside.join(node_vecs.select(F.col("id").alias("node_id")), "node_id", "left_semi")


def dual_path(queries, scored: DataFrame, inside: DataFrame, node_vecs: DataFrame) -> DataFrame:
    """Nodes of the triple path and the community path with scores and where they came from."""
    a = triple_ends(scored).select("query_id", "node_id", F.lit(True).alias("by_triple"), F.lit(False).alias("by_community"))
    b = inside.select("query_id", "node_id", F.lit(False).alias("by_triple"), F.lit(True).alias("by_community"))
    merged = a.unionByName(b).groupBy("query_id", "node_id").agg(
        F.max("by_triple").alias("by_triple"), F.max("by_community").alias("by_community")
    )
    return merged.join(scored_nodes(merged, queries, node_vecs), ["query_id", "node_id"])


def candidate_nodes(queries, nodes, node_vecs, k: int = 5, per_word: int | None = None, stop_after: int | None = None, most: int | None = None) -> DataFrame:
    """(query_id, node_id, score, rank): vector hits and keyword hits merged, the best ``k`` above 0.05.

    The limits are those of :func:`keyword_hits` and :func:`search_nodes`; without them all keyword hits
    count. Vector hits are more than ``k`` and scored alike, so a node beyond them is not among the best ``k``.
    """
    hits = stage(search_nodes(queries, node_vecs, k, most).select("query_id", "node_id", F.greatest(F.lit(0.0), "score").alias("score")))
    worded = keyword_hits(keywords(queries), text_index(nodes), per_word, stop_after)
    extra = worded.join(hits, ["query_id", "node_id"], "left_anti")
    scored = scored_nodes(extra, queries, node_vecs).where(F.col("score") > MIN_SCORE)
    best = top_per_key(hits.unionByName(scored), ["query_id"], [F.desc("score"), "node_id"], k, rank="rank")
    return best.where(F.col("score") > MIN_SCORE)


def paths_to_keywords(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, asked: DataFrame, depth: int = 2) -> DataFrame:
    """Edges on paths of up to ``depth`` out-steps from seeds to nodes whose text has a keyword.

    Searches meet in the middle: nodes are labelled backwards from those with a keyword, by the steps
    that are left, and a path is only taken over edges into a label. So a hub's edges that lead to no
    keyword in time are never walked. Paths visit no node twice. Only edges that leave a node within
    ``depth - 1`` out-steps of a seed can lie on a path, so only these, and the texts they lead to, are read on.
    """
    sources = around(seeds, edges, depth - 1).withColumnRenamed("node_id", "src")
    first = stage(first_relations(edges.join(sources, "src", "left_semi")))
    ends = first.select(F.col("dst").alias("node_id")).distinct()
    label = stage(substring_hits(asked, nodes.join(ends, "node_id", "left_semi")))
    steps = []  # edges into nodes that have a keyword, or reach one in 1, 2, … further steps
    for left in range(depth):
        steps.append(stage(first.join(label.withColumnRenamed("node_id", "dst"), "dst").select("query_id", "src", "relation", "dst")))
        if left + 1 < depth:
            label = steps[-1].select("query_id", F.col("src").alias("node_id")).unionByName(label).distinct()
    hits = steps[0].select("query_id", F.col("dst").alias("end")).distinct()
    path = seeds.select("query_id", F.array("node_id").alias("path"), F.col("node_id").alias("end")).distinct()
    path = path.withColumn("hops", F.array().cast("array<struct<src:string,relation:string,dst:string>>"))
    found = []
    for left in reversed(range(depth)):
        step = F.struct("src", "relation", "dst")
        path = (
            path.join(steps[left].withColumnRenamed("query_id", "_q"), (F.col("query_id") == F.col("_q")) & (F.col("end") == F.col("src")))
            .where(~F.array_contains("path", F.col("dst")))
            .select(
                "query_id", F.array_append("path", F.col("dst")).alias("path"), F.array_append("hops", step).alias("hops"), F.col("dst").alias("end")
            )
        )
        found.append(path if left == 0 else path.join(hits, ["query_id", "end"], "left_semi").select(*path.columns))
    return reduce(DataFrame.unionByName, found).select("query_id", F.inline("hops")).distinct()


def rerank_triples(triples: DataFrame, queries, nodes, edges, edge_vecs, vectors_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, seq, src, relation, dst, score): triples with usable text, scored, above 0.05.

    ``vectors_of`` makes the vectors (id, emb) of given edges (seq, src, dst), where these are not stored.
    """
    usable = node_texts(nodes).where(valid_node_text(F.col("txt"))).select("node_id")
    key = ["src", "relation", "dst"]
    asked = stage(triples.select("query_id", *key).distinct())
    numbered = stage(
        asked.join(edges.select("seq", *key), key)
        .groupBy("query_id", *key)
        .agg(F.min("seq").alias("seq"))
        .join(usable.select(F.col("node_id").alias("src")), "src", "left_semi")
        .join(usable.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    )
    vecs = vectors_of(stage(numbered.select("seq", "src", "dst").distinct())) if vectors_of else edge_vecs
    v = vecs.select(F.col("id").alias("seq"), F.col("emb").alias("_v"))
    joined = numbered.join(v, "seq").join(queries.select("query_id", F.col("emb").alias("_q")), "query_id")
    score = F.round(triple_score(cosine(F.col("_q"), F.col("_v")), F.col("relation")), 9)
    return joined.select("query_id", "seq", "src", "relation", "dst", score.alias("score")).where(F.col("score") > MIN_SCORE)


def node_relation_path(queries, nodes, edges, node_vecs, relation_vecs, k: int = 5, **limits: int) -> tuple[DataFrame, DataFrame]:
    """(top nodes, triples): candidates, under their limits if any, and everything expanded from them."""
    best = stage(candidate_nodes(queries, nodes, node_vecs, k, **limits))
    relations = top_k(queries, relation_vecs, k).select("query_id", F.col("id").alias("relation"))
    parts = [
        expand_neighbours(best, edges),
        paths_to_keywords(best, edges, nodes, keywords(queries)),
        relation_matched(best, edges, relations),
    ]
    return best, parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def typed_path(queries, nodes, edges, node_vecs, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(top nodes, triples) with the search held to a query's types."""
    best = search_filtered(queries, nodes, node_vecs, k)
    return best, one_hop(best, edges, k).select("query_id", "src", "relation", "dst")


def route_by_type(queries, nodes, edges, node_vecs, relation_vecs, k: int = 5, **limits: int) -> tuple[DataFrame, DataFrame]:
    """Typed path for queries whose types exist in the graph, plain path for the rest."""
    present = nodes.where(type_tag().isNotNull()).select(type_tag().alias("t")).distinct()
    asked = queries.select("query_id", F.explode(F.array_append("types", F.lit(""))).alias("t"))
    served = asked.join(present, "t", "left_semi").select("query_id").distinct()
    wants = queries.where(F.size("types") > 0)
    typed = wants.join(served, "query_id", "left_semi")
    plain = queries.where(F.size("types") == 0).unionByName(wants.join(served, "query_id", "left_anti"))
    a, b = typed_path(typed, nodes, edges, node_vecs, k), node_relation_path(plain, nodes, edges, node_vecs, relation_vecs, k, **limits)
    cols = ["query_id", "node_id", "score", "rank"]
    return a[0].select(*cols).unionByName(b[0].select(*cols)), a[1].unionByName(b[1])


def search_chunks(queries, chunk_vecs, k: int = 20) -> DataFrame:
    """Chunks by raw inner product."""
    return top_k(queries, chunk_vecs, k, normalize=False).withColumnRenamed("id", "chunk_id")


def rerank_chunks(found: DataFrame, queries, chunk_vecs, k: int = 10) -> DataFrame:
    """Mean of the index score and the clipped cosine, the best ``k`` per query."""
    v = chunk_vecs.select(F.col("id").alias("chunk_id"), F.col("emb").alias("_v"))
    joined = found.join(v, "chunk_id").join(queries.select("query_id", F.col("emb").alias("_q")), "query_id")
    score = F.round((F.col("score") + similarity(F.col("_q"), F.col("_v"))) / 2, 9)
    out = joined.select("query_id", "chunk_id", score.alias("score"))
    return top_per_key(out, ["query_id"], [F.desc("score"), "chunk_id"], k, rank="rank")


def merge_scored(parts: list[DataFrame], k: int) -> DataFrame:
    """Scored triples of all paths, the best score per triple, the best ``k`` per query."""
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    best = merged.groupBy("query_id", "seq", "src", "relation", "dst").agg(F.max("score").alias("score"))
    return top_per_key(best, ["query_id"], [F.desc("score"), "seq"], k, rank="rank")


def format_triples(scored: DataFrame, nodes: DataFrame, props: Column | None = None) -> DataFrame:
    """Readable triples; keyword edges and ends without usable text are left out."""
    shown = property_list(props) if props is not None else F.lit("")
    texts = nodes.select(
        "node_id", node_text(F.col("name"), F.col("description"), F.col("node_id")).alias("txt"), shown.alias("props")
    ).where(valid_node_text(F.col("txt")))
    h = texts.select(F.col("node_id").alias("src"), F.concat_ws(" ", "txt", "props").alias("h"))
    t = texts.select(F.col("node_id").alias("dst"), F.concat_ws(" ", "txt", "props").alias("t"))
    rows = scored.where(~F.col("relation").isin("represented_by", "kw_filter_by")).join(h, "src").join(t, "dst")
    text = F.concat(
        F.lit("("), "h", F.lit(", "), "relation", F.lit(", "), "t", F.lit(") [score: "), decimals(F.col("score"), "0.000"), F.lit("]")
    )
    return rows.select("query_id", "rank", text.alias("txt"))


def format_chunks(ranked: DataFrame, chunks: DataFrame, shown: int | None = None) -> DataFrame:
    """Chunk previews: id, text (its first ``shown`` characters, if given), score."""
    text = F.col("text") if shown is None else F.substring("text", 1, shown)
    text = F.concat(
        F.lit("[Chunk "), "chunk_id", F.lit("] "), text, F.lit("... [score: "),
        decimals(F.col("score"), "0.000"), F.lit("]"),
    )
    return chunk_texts(ranked, chunks).select("query_id", "rank", "chunk_id", text.alias("preview"))


def merge_questions(parts: DataFrame, owner: str, key: str, order: list, k: int) -> DataFrame:
    """Results of sub-questions under their question: distinct, the first ``k`` as context."""
    best = parts.groupBy(owner, key).agg(F.min(F.struct(*order)).alias("_o"))
    return top_per_key(best, [owner], ["_o", key], k, rank="position").drop("_o")


def sub_questions(answers: DataFrame, column: str) -> DataFrame:
    """(…, position, sub_question) of decompositions, given as an object or as a bare list."""
    item = "array<struct<`sub-question`: string>>"
    plain = F.from_json(column, item)
    wrapped = F.from_json(column, f"struct<sub_questions: {item}>")
    listed = F.when(F.trim(column).startswith("["), plain).otherwise(wrapped["sub_questions"])
    rest = [c for c in answers.columns if c != column]
    rows = answers.select(*rest, F.posexplode(listed).alias("position", "q"))
    return rows.select(*rest, "position", F.col("q").getField("sub-question").alias("sub_question"))

"""Vector tables, neighbourhoods and retrieval for the question table."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from thicket.functions.vector import triple_score
from thicket.operators import retrieval as rt
from thicket.operators import search
from thicket.queries.registry import query
from thicket.queries.shapes import NODE_TEXT
from thicket.session import stage
from thicket.sources import vectorstore as vs

K = 5
#: The limits of the published retrieval, which the oracles state too.
WORD_LIMITS = {"per_word": 50, "stop_after": 200}
LIMITS = {**WORD_LIMITS, "most": 50}


def asked(t):
    types = F.filter(F.split("types", ","), lambda x: x != "")
    return t.question.select("query_id", "emb", "text", types.alias("types"))


class Graph:
    """The graph's tables as a retrieval service keeps them: each built when first read, stored, then read.

    Vectors of edges are not stored: they are sums of stored ones, take far more room than all the rest,
    and a search of the whole question table reads them once.
    """

    stored: dict[tuple[str, str], Graph] = {}

    def __init__(self, t):
        self.tables = t

    @cached_property
    def nodes(self):
        return stage(self.tables.kg_nodes)

    @cached_property
    def edges(self):
        return stage(self.tables.kg_unique)

    @cached_property
    def node_vecs(self):
        return stage(self.tables.node_vec)

    @cached_property
    def edge_vecs(self):
        return self.vectors_of(self.edges)

    def vectors_of(self, edges):
        return rt.edge_vectors(edges, self.node_vecs)

    @classmethod
    def of(cls, t) -> Graph:
        key = t.spark.sparkContext.applicationId, t.folder
        if key not in cls.stored:
            cls.stored[key] = cls(t)
        return cls.stored[key]


def edge_vecs(t):
    return rt.edge_vectors(t.kg_unique, t.node_vec)


# ---- SQL pieces, put together per oracle

Q = "q AS (SELECT query_id, CAST(emb AS DOUBLE[]) AS qe, text, CASE WHEN types = '' THEN [] ELSE string_split(types, ',') END AS tys FROM question)"
NV = "nv AS (SELECT id, CAST(emb AS DOUBLE[]) AS e FROM node_vec)"
EV = """ev AS (SELECT seq, src, relation, dst, list_transform(range(1, 65), lambda i: h.e[i] + t.e[i]) AS e
  FROM kg_unique JOIN nv h ON src = h.id JOIN nv t ON dst = t.id)"""
TX = f"tx AS (SELECT node_id, name, label, schema_type, chunk_id, {NODE_TEXT} AS txt FROM kg_nodes)"
FR = "fr AS (SELECT src, dst, arg_min(relation, seq) AS relation FROM kg_unique GROUP BY 1, 2)"


def ranked(name, source, key, k, where="true", score="list_cosine_similarity(qe, e)"):
    return f"""{name} AS (SELECT * FROM (SELECT query_id, {key}, round({score}, 9) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 9) DESC, {key.split(',')[0].split(' ')[0]}) AS rank FROM q, {source} WHERE {where}) WHERE rank <= {k})"""


HITS = ranked("hits", "nv", "id", 15)
STOP = ", ".join(f"'{w}'" for w in rt.STOP_WORDS)
KW = rf"""kw AS (SELECT DISTINCT query_id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}#]+')) AS word FROM q),
kws AS (SELECT * FROM kw WHERE length(word) > 2 AND word NOT IN ({STOP}))"""
IDX = r"idx AS (SELECT * FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(txt), '\s+')) AS word, node_id FROM tx) WHERE length(word) > 2)"
KH = """ih AS (SELECT word, node_id FROM idx WHERE word IN (SELECT word FROM kws) QUALIFY row_number() OVER (PARTITION BY word ORDER BY node_id) <= 50),
fh AS (SELECT query_id, node_id, min(word) AS word FROM kws JOIN ih USING (word) GROUP BY 1, 2),
wn AS (SELECT query_id, word, count(*) AS n FROM fh GROUP BY 1, 2),
wr AS (SELECT query_id, word, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS found FROM wn),
kh AS (SELECT query_id, node_id FROM fh JOIN wr USING (query_id, word) WHERE found <= 200)"""
ALL_HITS = "kh AS (SELECT DISTINCT query_id, node_id FROM kws JOIN idx USING (word))"
CAND = """cs AS (SELECT query_id, id AS node_id, greatest(0, score) AS score FROM hits
  UNION ALL SELECT query_id, node_id, round(greatest(0, list_cosine_similarity(qe, e)), 9) FROM kh JOIN q USING (query_id) JOIN nv ON nv.id = node_id
  WHERE (query_id, node_id) NOT IN (SELECT (query_id, id) FROM hits) AND round(greatest(0, list_cosine_similarity(qe, e)), 9) > 0.05),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM cs) WHERE rank <= 5 AND score > 0.05)"""
NB = """nbp AS (SELECT DISTINCT query_id, a.src AS u, a.dst AS v FROM cand JOIN fr a ON a.src = node_id),
nb AS (SELECT DISTINCT query_id, f.src, f.relation, f.dst FROM (SELECT query_id, u, v FROM nbp UNION SELECT query_id, v, u FROM nbp) p JOIN fr f ON f.src = u AND f.dst = v)"""
PATHS = """hop1 AS (SELECT DISTINCT query_id, node_id AS s, f.relation AS r1, f.dst AS n1 FROM cand JOIN fr f ON f.src = node_id WHERE f.dst <> node_id),
hop2 AS (SELECT query_id, s, r1, n1, f.relation AS r2, f.dst AS n2 FROM hop1 JOIN fr f ON f.src = n1 WHERE f.dst NOT IN (s, n1)),
has AS (SELECT DISTINCT query_id, node_id FROM kws JOIN tx ON contains(lower(txt), word)),
pt AS (SELECT query_id, s AS src, r1 AS relation, n1 AS dst FROM hop1 WHERE (query_id, n1) IN (SELECT (query_id, node_id) FROM has)
  UNION SELECT query_id, s, r1, n1 FROM hop2 WHERE (query_id, n2) IN (SELECT (query_id, node_id) FROM has)
  UNION SELECT query_id, n1, r2, n2 FROM hop2 WHERE (query_id, n2) IN (SELECT (query_id, node_id) FROM has))"""
RV = "rv AS (SELECT id, CAST(emb AS DOUBLE[]) AS e FROM relation_vec)"
RS = ranked("rs", "rv", "id", 5)
TOUCH = "tch AS (SELECT DISTINCT query_id, seq, src, relation, dst FROM cand JOIN kg_unique ON node_id = src OR node_id = dst)"
RM = "rm AS (SELECT DISTINCT query_id, src, relation, dst FROM tch WHERE (query_id, relation) IN (SELECT (query_id, id) FROM rs))"
ONE = "onehop AS (SELECT * FROM nb UNION SELECT * FROM pt UNION SELECT * FROM rm)"
WIDE = ranked("wide", "ev", "seq, src, relation, dst", 50)
AROUND = """st AS (SELECT DISTINCT src, dst FROM kg_unique WHERE dst IN (SELECT id FROM nv)),
seed AS (SELECT DISTINCT query_id, unnest([src, dst]) AS node_id FROM wide WHERE rank <= 5),
n1 AS (SELECT * FROM seed UNION SELECT query_id, dst FROM seed JOIN st ON src = node_id),
n2 AS (SELECT * FROM n1 UNION SELECT query_id, dst FROM n1 JOIN st ON src = node_id),
n3 AS (SELECT * FROM n2 UNION SELECT query_id, dst FROM n2 JOIN st ON src = node_id),
near AS (SELECT query_id, src, relation, dst FROM n3 JOIN kg_unique ON src = node_id AND dst IN (SELECT id FROM nv)
  UNION SELECT query_id, src, relation, dst FROM n3 JOIN kg_unique ON dst = node_id AND src IN (SELECT id FROM nv)
  UNION SELECT query_id, src, relation, dst FROM wide WHERE rank <= 5)"""
TP = """tp AS (SELECT query_id, seq, src, relation, dst, score FROM wide SEMI JOIN near USING (query_id, src, relation, dst)
  JOIN (SELECT query_id, count(*) AS n FROM near GROUP BY 1) USING (query_id)
  WHERE rank <= least(2 * n, 50) AND score >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) <= 5)"""
CV = "cv AS (SELECT id, CAST(emb AS DOUBLE[]) AS e FROM comm_vec)"
CS = ranked("cms", "cv", "id", 3)
CP = """cp AS (SELECT DISTINCT query_id, node_id FROM cms JOIN comm_member ON comm_id = id JOIN (SELECT name, min(node_id) AS node_id FROM kg_nodes GROUP BY 1) ON name = member
  WHERE node_id IN (SELECT id FROM nv))"""
RR_SCORE = "greatest(0, list_cosine_similarity(qe, e) + CASE WHEN lower(relation) IN ('is', 'was', 'has', 'had', 'contains', 'located', 'born', 'died') THEN 0.1 ELSE 0 END)"
RR = f"""rr AS (SELECT query_id, ev.seq, src, relation, dst, round({RR_SCORE}, 9) AS score FROM onehop JOIN ev USING (src, relation, dst) JOIN q USING (query_id)
  WHERE round({RR_SCORE}, 9) > 0.05)"""
MG = """mg AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank FROM (
  SELECT query_id, seq, src, relation, dst, max(score) AS score FROM (SELECT * FROM tp UNION ALL SELECT * FROM rr) GROUP BY ALL)),
lim AS (SELECT * FROM mg WHERE rank <= 20)"""
CHV = "chv AS (SELECT id, CAST(emb AS DOUBLE[]) AS e FROM chunk_vec)"
CH = ranked("ch", "chv", "id", 20, score="list_dot_product(qe, e)")


def sql(select, *ctes):
    return "WITH " + ",\n".join(ctes) + "\n" + select


NODE_PATH = [Q, NV, EV, TX, FR, HITS, KW, IDX, KH, CAND, NB, PATHS, RV, RS, TOUCH, RM, ONE]
BOTH = [*NODE_PATH, WIDE, AROUND, TP, RR, MG]


def unlimited(ctes):
    """The pieces with every keyword hit instead of the first ones."""
    return [ALL_HITS if c is KH else c for c in ctes]


# ---- vector tables


def sums(df, *keys):
    """Checks per vector that do not need nested output: its length, its first part, and all parts weighted by place."""
    weighted = F.aggregate(F.transform("emb", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return df.select(*keys, F.round(weighted, 5).alias("weighted"), F.round(F.aggregate("emb", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"), F.round(F.col("emb")[0], 6).alias("first"))


PLACED = "list_sum(list_transform(range(1, 65), lambda i: i * e[i]))"
UNIT = f"round({PLACED} / sqrt(list_dot_product(e, e)), 5) AS weighted, round(list_dot_product(e, e) / list_dot_product(e, e), 6) AS norm2, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first"


@query("s26_node_vectors", sql(f"SELECT 'node' AS kind, id, {UNIT} FROM nv", NV))
def _(t):
    return sums(vs.index("node", vs.node_texts(t.kg_nodes), t.node_vec), "kind", "id")


@query("s26_node_texts", "SELECT node_id AS id, trim(coalesce(nullif(trim(name), ''), 'none') || ',' || coalesce(nullif(trim(description), ''), 'none')) AS text FROM kg_nodes")
def _(t):
    return vs.node_texts(t.kg_nodes)


@query("s27_relation_vectors", sql(f"SELECT 'relation' AS kind, id, {UNIT} FROM rv", RV))
def _(t):
    return sums(vs.index("relation", vs.relation_texts(t.kg_edges), t.relation_vec), "kind", "id")


@query("s28_triple_vectors", sql(f"SELECT 'triple' AS kind, seq AS id, {UNIT} FROM ev", NV, EV))
def _(t):
    return sums(vs.index("triple", t.kg_unique.select(F.col("seq").alias("id")), edge_vecs(t)), "kind", "id")


@query("s28_triple_texts", """
WITH x AS (SELECT node_id, trim(coalesce(nullif(trim(name), ''), 'none') || ',' || coalesce(nullif(trim(description), ''), 'none')) AS text FROM kg_nodes)
SELECT seq AS id, h.text || ',' || relation || ',' || t.text AS text FROM kg_unique JOIN x h ON h.node_id = src JOIN x t ON t.node_id = dst""")
def _(t):
    return vs.triple_texts(t.kg_nodes, t.kg_unique)


@query("s29_community_vectors", sql(f"SELECT 'community' AS kind, id, {UNIT} FROM cv", CV))
def _(t):
    named = t.comm_member.groupBy(F.col("comm_id").alias("node_id")).agg(F.min("member").alias("name"))
    nodes = named.withColumns({"label": F.lit("community"), "description": F.lit(None).cast("string")})
    return sums(vs.index("community", vs.community_texts(nodes), t.comm_vec), "kind", "id")


@query("s30_chunk_vectors", sql("SELECT 'chunk' AS kind, id, round(list_sum(list_transform(range(1, 65), lambda i: i * e[i])), 5) AS weighted, round(list_dot_product(e, e), 6) AS norm2, round(e[1], 6) AS first FROM chv WHERE id IN (SELECT chunk_id FROM chunk)", CHV))
def _(t):
    return sums(vs.index("chunk", t.chunk.select(F.col("chunk_id").alias("id")), t.chunk_vec, normalize=False), "kind", "id")


@query("s31_build_or_reuse", sql(f"SELECT 'node' AS kind, id, {UNIT} FROM nv", NV))
def _(t):
    import uuid

    from thicket.session import shared_folder

    path = f"{shared_folder(t.spark)}/index-{uuid.uuid4().hex}"
    items = t.node_vec.select("id")
    build = lambda wanted: vs.index("node", wanted, t.node_vec)
    vs.build_or_reuse(t.spark, path, items, build)
    stored, _reused = vs.build_or_reuse(t.spark, path, items, build)
    return sums(stored, "kind", "id")


@query("x13_similarity", sql("SELECT query_id, id, round(greatest(0, list_cosine_similarity(qe, e)), 6) AS score FROM nv, q", Q, NV))
def _(t):
    return rt.similarities(asked(t), t.node_vec).withColumn("score", F.round("score", 6))


@query("x14_entity_similarity", sql("SELECT query_id, node_id, round(greatest(0, list_cosine_similarity(qe, e)), 6) AS score FROM tx JOIN nv ON id = node_id, q WHERE txt <> ''", Q, NV, TX))
def _(t):
    usable = rt.node_texts(t.kg_nodes).where(rt.valid_node_text(F.col("txt"))).select(F.col("node_id").alias("id"))
    scored = rt.similarities(asked(t), t.node_vec.join(usable, "id"))
    return scored.select("query_id", F.col("id").alias("node_id"), F.round("score", 6).alias("score"))


@query("x15_triple_score", sql(f"SELECT query_id, seq, relation, round({RR_SCORE}, 6) AS score FROM ev, q", Q, NV, EV))
def _(t):
    cosines = rt.similarities(asked(t), edge_vecs(t), clipped=False).withColumnRenamed("id", "seq")
    edges = cosines.join(t.kg_unique.select("seq", "relation"), "seq")
    return edges.select("query_id", "seq", "relation", F.round(triple_score(F.col("score"), F.col("relation")), 6).alias("score"))


# ---- searches


@query("r01_node_search", sql("SELECT query_id, id AS node_id, round(score, 6) AS score, rank FROM hits", Q, NV, HITS))
def _(t):
    return rt.search_nodes(asked(t), t.node_vec, K, most=50).withColumn("score", F.round("score", 6))


@query("r01_all_neighbours", """
SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.vec_id) AS rank
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) a, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b) WHERE rank <= 10""")
def _(t):
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("emb"))
    return search.top_k(vectors.withColumnRenamed("id", "query_id"), vectors, 10).drop("score")


@query("r01_pruned_neighbours", """
SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.vec_id) AS rank
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) a, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b) WHERE rank <= 10""")
def _(t):
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("emb"))
    return search.top_k(vectors.withColumnRenamed("id", "query_id"), search.Index(vectors), 10).drop("score")


@query("r02_relation_search", sql("SELECT query_id, id, rank FROM rs", Q, RV, RS))
def _(t):
    return search.top_k(asked(t), t.relation_vec, K).drop("score")


@query("r03_chunk_search", sql("SELECT query_id, id AS chunk_id, round(score, 6) AS score, rank FROM ch", Q, CHV, CH))
def _(t):
    return rt.search_chunks(asked(t), t.chunk_vec).withColumn("score", F.round("score", 6))


def best(t):
    return stage(rt.candidate_nodes(asked(t), t.kg_nodes, t.node_vec, K, **LIMITS))


@query("j07_one_hop", sql("""
SELECT query_id, seq, src, relation, dst, h.name AS src_name, t.name AS dst_name FROM tch JOIN kg_nodes h ON h.node_id = src JOIN kg_nodes t ON t.node_id = dst
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY seq) <= 5""", Q, NV, TX, HITS, KW, IDX, KH, CAND, TOUCH))
def _(t):
    return rt.named(rt.one_hop(best(t), t.kg_unique, K), t.kg_nodes)


@query("j08_expand_neighbours", sql("SELECT query_id, src, relation, dst FROM nb", Q, NV, TX, FR, HITS, KW, IDX, KH, CAND, NB))
def _(t):
    return rt.expand_neighbours(best(t), t.kg_unique)


@query("j08_expand_cumulative", sql("""
SELECT DISTINCT query_id, f.src, f.relation, f.dst FROM (
  SELECT query_id, c.node_id AS u, o.v FROM cand c JOIN (SELECT query_id, min(rank) AS since, a.dst AS v FROM cand JOIN fr a ON a.src = node_id GROUP BY query_id, a.dst) o USING (query_id) WHERE since <= c.rank) p
JOIN fr f ON (f.src = u AND f.dst = v) OR (f.src = v AND f.dst = u)""", Q, NV, TX, FR, HITS, KW, IDX, KH, CAND))
def _(t):
    return rt.expand_neighbours(best(t), t.kg_unique, cumulative=True)


@query("j09_relation_matched", sql("SELECT query_id, src, relation, dst FROM rm", Q, NV, TX, HITS, KW, IDX, KH, CAND, RV, RS, TOUCH, RM))
def _(t):
    relations = search.top_k(asked(t), t.relation_vec, K).select("query_id", F.col("id").alias("relation"))
    return rt.relation_matched(best(t), t.kg_unique, relations)


@query("j10_out_neighbourhood", sql("""
SELECT center, node_id, min(hop) AS hop FROM w GROUP BY 1, 2""", NV, """st AS (SELECT DISTINCT src, dst FROM kg_unique WHERE dst IN (SELECT id FROM nv))""",
"w0 AS (SELECT id AS center, id AS node_id, 0 AS hop FROM nv)", "w1 AS (SELECT DISTINCT center, dst AS node_id, 1 AS hop FROM w0 JOIN st ON src = node_id)",
"w2 AS (SELECT DISTINCT center, dst AS node_id, 2 AS hop FROM w1 JOIN st ON src = node_id)", "w3 AS (SELECT DISTINCT center, dst AS node_id, 3 AS hop FROM w2 JOIN st ON src = node_id)",
"w AS (FROM w0 UNION ALL FROM w1 UNION ALL FROM w2 UNION ALL FROM w3)"))
def _(t):
    return rt.out_neighbourhood(t.node_vec.select(F.col("id").alias("center")), t.kg_unique, t.node_vec)


@query("j13_neighbour_triples", sql("SELECT query_id, src, relation, dst FROM near", Q, NV, EV, WIDE, AROUND))
def _(t):
    g = Graph.of(t)
    wide = stage(search.top_k(asked(t), g.edge_vecs, K).withColumnRenamed("id", "seq")).join(g.edges, "seq")
    seeds = stage(wide.select("query_id", "src", "relation", "dst"))
    around = rt.reachable(rt.triple_ends(seeds), g.edges, g.node_vecs)
    return rt.neighbour_triples(around, g.edges, g.node_vecs, key="query_id").unionByName(seeds).distinct()


@query("j14_community_nodes", "SELECT comm_id, node_id FROM (SELECT DISTINCT comm_id, member FROM comm_member) JOIN (SELECT name, min(node_id) AS node_id FROM kg_nodes GROUP BY 1) ON name = member")
def _(t):
    return rt.community_nodes(t.comm_member, t.kg_nodes)


@query("j15_chunk_texts", sql("SELECT DISTINCT query_id, n.chunk_id, text FROM cand JOIN kg_nodes n USING (node_id) JOIN chunk c ON c.chunk_id = n.chunk_id", Q, NV, TX, HITS, KW, IDX, KH, CAND))
def _(t):
    return rt.chunk_texts(rt.chunk_ids(best(t), t.kg_nodes), t.chunk)


@query("j16_chunk_ids", sql("SELECT DISTINCT query_id, chunk_id FROM (SELECT query_id, unnest([src, dst]) AS node_id FROM tp) JOIN kg_nodes USING (node_id) WHERE chunk_id IS NOT NULL", Q, NV, EV, WIDE, AROUND, TP))
def _(t):
    g = Graph.of(t)
    scored = rt.triple_path(asked(t), g.edges, g.edge_vecs, g.node_vecs, K)
    return rt.chunk_ids(rt.triple_ends(scored), g.nodes)


@query("r04_triple_path", sql("SELECT query_id, seq, src, relation, dst, round(score, 6) AS score FROM tp", Q, NV, EV, WIDE, AROUND, TP))
def _(t):
    g = Graph.of(t)
    return rt.triple_path(asked(t), g.edges, g.edge_vecs, g.node_vecs, K).withColumn("score", F.round("score", 6))


@query("r05_community_path", sql("SELECT query_id, node_id FROM cp", Q, NV, CV, CS, CP))
def _(t):
    return rt.community_path(asked(t), t.comm_vec, t.comm_member, t.kg_nodes, t.node_vec)


@query("r06_dual_path", sql("""
SELECT query_id, node_id, bool_or(a) AS by_triple, bool_or(NOT a) AS by_community, round(greatest(0, list_cosine_similarity(qe, e)), 6) AS score
FROM (SELECT query_id, unnest([src, dst]) AS node_id, true AS a FROM tp UNION ALL SELECT query_id, node_id, false FROM cp) JOIN q USING (query_id) JOIN nv ON nv.id = node_id
GROUP BY query_id, node_id, qe, e""", Q, NV, EV, WIDE, AROUND, TP, CV, CS, CP))
def _(t):
    q, g = asked(t), Graph.of(t)
    scored = rt.triple_path(q, g.edges, g.edge_vecs, g.node_vecs, K)
    inside = stage(rt.community_path(q, t.comm_vec, t.comm_member, g.nodes, g.node_vecs))
    return rt.dual_path(q, scored, inside, g.node_vecs).withColumn("score", F.round("score", 6))


@query("r07_candidate_nodes", sql("SELECT query_id, node_id, round(score, 6) AS score, rank FROM cand", Q, NV, TX, HITS, KW, IDX, KH, CAND))
def _(t):
    return best(t).withColumn("score", F.round("score", 6))


@query("r07_node_relation_triples", sql("SELECT query_id, src, relation, dst FROM onehop", *unlimited(NODE_PATH)))
def _(t):
    g = Graph.of(t)
    return rt.node_relation_path(stage(asked(t)), g.nodes, g.edges, g.node_vecs, t.relation_vec, K)[1]


TAGGED = "tg AS (SELECT id, e, CASE WHEN coalesce(schema_type, '') <> '' THEN schema_type WHEN label = 'entity' THEN '' END AS tag FROM nv JOIN kg_nodes ON node_id = id)"
FS = ranked("fs", "tg", "id", 5, "tag IS NOT NULL AND list_contains(list_append(tys, ''), tag)")


@query("r08_filtered_search", sql("SELECT query_id, id AS node_id, round(score, 6) AS score, rank FROM fs", Q, NV, TAGGED, FS))
def _(t):
    return rt.search_filtered(asked(t), t.kg_nodes, t.node_vec, K).withColumn("score", F.round("score", 6))


@query("r08_pruned_filtered_search", sql("SELECT query_id, id AS node_id, round(score, 6) AS score, rank FROM fs", Q, NV, TAGGED, FS))
def _(t):
    index = rt.typed_index(t.kg_nodes, t.node_vec)
    return rt.search_filtered(asked(t), t.kg_nodes, index, K).withColumn("score", F.round("score", 6))


TYPED_ONE = """tyt AS (SELECT DISTINCT query_id, seq, src, relation, dst FROM fs JOIN kg_unique ON id = src OR id = dst),
ty1 AS (SELECT query_id, src, relation, dst FROM tyt QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY seq) <= 5)"""


@query("r09_typed_path", sql("SELECT query_id, src, relation, dst FROM ty1", Q, NV, TAGGED, FS, TYPED_ONE))
def _(t):
    return rt.typed_path(asked(t), t.kg_nodes, t.kg_unique, t.node_vec, K)[1]


@query("r10_route_by_type", sql("""
SELECT query_id, id AS node_id, rank FROM fs WHERE query_id IN (SELECT query_id FROM q WHERE len(tys) > 0)
UNION ALL SELECT query_id, node_id, rank FROM cand WHERE query_id IN (SELECT query_id FROM q WHERE len(tys) = 0)""", Q, NV, TX, TAGGED, FS, HITS, KW, IDX, KH, CAND))
def _(t):
    out = rt.route_by_type(asked(t), t.kg_nodes, t.kg_unique, t.node_vec, t.relation_vec, K)[0]
    return out.select("query_id", "node_id", "rank")


@query("r11_text_index", sql("SELECT word, node_id FROM idx", TX, IDX))
def _(t):
    return rt.text_index(t.kg_nodes)


@query("r12_all_keyword_hits", sql("SELECT DISTINCT query_id, node_id FROM kws JOIN idx USING (word)", Q, TX, KW, IDX))
def _(t):
    return rt.keyword_hits(rt.keywords(asked(t)), rt.text_index(t.kg_nodes))


@query("r12_keyword_hits", sql("SELECT query_id, node_id FROM kh", Q, TX, KW, IDX, KH))
def _(t):
    return rt.keyword_hits(rt.keywords(asked(t)), rt.text_index(t.kg_nodes), **WORD_LIMITS)


@query("r12_substring_hits", sql("SELECT DISTINCT query_id, node_id FROM kws JOIN tx ON contains(lower(txt), word)", Q, TX, KW))
def _(t):
    return rt.substring_hits(rt.keywords(asked(t)), t.kg_nodes)


@query("r13_paths_to_keywords", sql("SELECT query_id, src, relation, dst FROM pt", Q, NV, TX, FR, HITS, KW, IDX, KH, CAND, PATHS))
def _(t):
    return rt.paths_to_keywords(best(t), t.kg_unique, t.kg_nodes, rt.keywords(asked(t)))


@query("r14_rerank_triples", sql("SELECT query_id, seq, src, relation, dst, round(score, 6) AS score FROM rr", *NODE_PATH, RR))
def _(t):
    q, g = asked(t), Graph.of(t)
    triples = rt.node_relation_path(q, g.nodes, g.edges, g.node_vecs, t.relation_vec, K, **LIMITS)[1]
    return rt.rerank_triples(triples, q, g.nodes, g.edges, g.edge_vecs, g.vectors_of).withColumn("score", F.round("score", 6))


RC = """rc AS (SELECT * FROM (SELECT query_id, id AS chunk_id, round((score + greatest(0, list_cosine_similarity(qe, e))) / 2, 9) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY round((score + greatest(0, list_cosine_similarity(qe, e))) / 2, 9) DESC, id) AS rank
  FROM ch JOIN chv USING (id) JOIN q USING (query_id)) WHERE rank <= 10)"""


@query("r15_rerank_chunks", sql("SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM rc", Q, CHV, CH, RC))
def _(t):
    q = asked(t)
    return rt.rerank_chunks(rt.search_chunks(q, t.chunk_vec), q, t.chunk_vec).withColumn("score", F.round("score", 6))


def final(t, limits=LIMITS):
    from thicket.plans.ask import Answer

    g = Graph.of(t)
    return Answer(asked(t), g.nodes, g.edges, g.node_vecs, t.relation_vec, g.edge_vecs, t.chunk_vec, t.chunk, K, limits=limits, vectors_of=g.vectors_of)


@query("f03_merged_triples", sql("SELECT query_id, seq, rank, round(score, 6) AS score FROM lim", *BOTH))
def _(t):
    return final(t).triples.select("query_id", "seq", "rank", F.round("score", 6).alias("score"))


@query("r16_path_chunk_ids", sql("""
SELECT DISTINCT query_id, chunk_id FROM (
  SELECT query_id, chunk_id FROM cand JOIN kg_nodes USING (node_id) UNION ALL SELECT query_id, chunk_id FROM (SELECT query_id, unnest([src, dst]) AS node_id FROM tp) JOIN kg_nodes USING (node_id)
  UNION ALL SELECT query_id, id FROM ch WHERE rank <= 5) WHERE chunk_id IS NOT NULL
QUALIFY dense_rank() OVER (PARTITION BY query_id ORDER BY chunk_id) <= 5""", *BOTH, CHV, CH))
def _(t):
    return final(t).path_chunks


X07 = """ft AS (SELECT query_id, rank, '(' || h.txt || ' ' || ', ' || relation || ', ' || t.txt || ' ' || ') [score: ' || printf('%.3f', score) || ']' AS txt
  FROM lim JOIN tx h ON h.node_id = src JOIN tx t ON t.node_id = dst WHERE relation NOT IN ('represented_by', 'kw_filter_by'))"""


@query("x07_format_triples", sql("SELECT query_id, rank, txt FROM ft", *BOTH, X07))
def _(t):
    return final(t).triple_texts


RESULT_CHUNKS = """allc AS (SELECT DISTINCT query_id, chunk_id FROM (SELECT query_id, unnest([src, dst]) AS node_id FROM lim) JOIN kg_nodes USING (node_id) WHERE chunk_id IS NOT NULL
  UNION SELECT query_id, chunk_id FROM rc)"""


@query("r17_result_chunks", sql("SELECT query_id, chunk_id, text FROM allc JOIN chunk USING (chunk_id)", *unlimited(BOTH), CHV, CH, RC, RESULT_CHUNKS))
def _(t):
    return final(t, limits=None).chunks


@query("r17_chunk_previews", sql("""
SELECT query_id, rank, chunk_id, '[Chunk ' || chunk_id || '] ' || substr(text, 1, 200) || '... [score: ' || printf('%.3f', score) || ']' AS preview FROM rc JOIN chunk USING (chunk_id)""", Q, CHV, CH, RC))
def _(t):
    q = asked(t)
    ranked = rt.rerank_chunks(stage(rt.search_chunks(q, t.chunk_vec)), q, t.chunk_vec)
    return rt.format_chunks(ranked, t.chunk, shown=200)


@query("r18_merge_questions", sql("""
SELECT grp, txt, position FROM (SELECT grp, txt, row_number() OVER (PARTITION BY grp ORDER BY r, g, txt) AS position
  FROM (SELECT grp, txt, min(rank) AS r, arg_min(query_id, [rank, query_id]) AS g FROM (SELECT *, CAST(floor(query_id / 5) AS BIGINT) AS grp FROM ft) GROUP BY 1, 2)) WHERE position <= 20""", *BOTH, X07))
def _(t):
    parts = final(t).triple_texts.withColumn("grp", F.floor(F.col("query_id") / 5).cast("long"))
    return rt.merge_questions(parts, "grp", "txt", ["rank", "query_id"], 20)


@query("r19_query_keywords", sql("SELECT query_id, word FROM kws", Q, KW))
def _(t):
    return rt.keywords(asked(t))


@query("r20_sub_questions", """
SELECT conv_id, turn, CAST(unnest([0, 1]) AS INTEGER) AS position, unnest([role, 'turn ' || turn]) AS sub_question FROM conversations""")
def _(t):
    items = F.array(F.struct(F.col("role").alias("sub-question")), F.struct(F.concat(F.lit("turn "), "turn").alias("sub-question")))
    answer = F.when(F.col("turn") % 2 == 0, F.to_json(items)).otherwise(F.to_json(F.struct(items.alias("sub_questions"))))
    return rt.sub_questions(t.conversations.select("conv_id", "turn", answer.alias("answer")), "answer")

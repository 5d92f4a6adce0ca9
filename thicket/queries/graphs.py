"""Chunking, graph building, graph views and edits."""

from pyspark.sql import functions as F

from thicket.operators import graphbuild as gb
from thicket.operators import graphviews as gv
from thicket.queries.registry import query

TOK = r"regexp_extract_all(text, '[ \t\n\r\f]*[^ \t\n\r\f]+')"


def chunk_sql(size=1000, overlap=50, tail=100, docs="documents", name="pieces"):
    step = size - overlap
    return rf"""
tok_{name} AS (SELECT doc_id, text, {TOK} AS tok FROM {docs}),
starts_{name} AS (SELECT doc_id, text, tok, len(tok) AS n, list_filter(range(0, greatest(len(tok), 1), {step}), lambda s: s = 0 OR len(tok) - s >= {tail}) AS st FROM tok_{name}),
cut_{name} AS (SELECT doc_id, text, tok, n, st, unnest(st) AS s, generate_subscripts(st, 1) - 1 AS ordinal FROM starts_{name}),
win_{name} AS (SELECT *, CASE WHEN ordinal = len(st) - 1 THEN n ELSE least(s + {size}, n) END AS e FROM cut_{name} WHERE n > {size}),
{name} AS (
  SELECT sha256(doc_id || ':' || ordinal) AS chunk_id, doc_id, CAST(ordinal AS INTEGER) AS ordinal, array_to_string(list_slice(tok, s + 1, e), '') AS text, CAST(e - s AS INTEGER) AS n_tokens
  FROM win_{name} WHERE e - s >= 5 AND length(trim(array_to_string(list_slice(tok, s + 1, e), ''))) >= 5
  UNION ALL SELECT sha256(doc_id || ':0'), doc_id, 0, text, CAST(n AS INTEGER) FROM starts_{name} WHERE n <= {size})"""


@query("k01_chunks", "WITH " + chunk_sql() + " SELECT * FROM pieces")
def _(t):
    return gb.chunks(t.documents)


@query("k01_small_chunks", "WITH " + chunk_sql(60, 20, 30) + " SELECT * FROM pieces")
def _(t):
    return gb.chunks(t.documents, size=60, overlap=20, min_tail=30)


@query("k02_titled_chunks", "WITH titled AS (SELECT doc_id, trim(source || ' ' || text) AS text FROM documents), " + chunk_sql(docs="titled") + " SELECT * FROM pieces")
def _(t):
    return gb.chunks(t.documents, title="source")


@query("k02_whole_documents", "SELECT sha256(doc_id || ':0') AS chunk_id, doc_id, 0 AS ordinal, trim(source || ' ' || text) AS text FROM documents")
def _(t):
    return gb.chunks(t.documents, title="source", split=False).drop("n_tokens")


WORDS = r"""
words AS (SELECT chunk_id, doc_id, ordinal, regexp_extract_all(text, '\p{Lu}\p{Ll}{2,}') AS w FROM pieces),
resp AS (SELECT *, len(w) AS n FROM words WHERE len(w) > 0),
attrs AS (SELECT chunk_id, doc_id, ordinal, w[1] AS entity, unnest(['words: ' || n, 'capitalized']) AS attribute, unnest([0, 1]) AS j FROM resp),
pairs AS (SELECT chunk_id, doc_id, ordinal, w[1] AS topic, unnest(range(0, n - 1)) AS i, unnest(list_slice(w, 1, n - 1)) AS h, unnest(list_slice(w, 2, n)) AS t FROM resp WHERE n > 1),
mentions AS (
  SELECT chunk_id, entity AS name, 'topic' AS type, [doc_id, ordinal, 0, 0, j] AS seq FROM attrs
  UNION ALL SELECT chunk_id, h, CASE WHEN h = topic THEN 'topic' END, [doc_id, ordinal, 1, i, 0] FROM pairs
  UNION ALL SELECT chunk_id, t, CASE WHEN t = topic THEN 'topic' END, [doc_id, ordinal, 1, i, 1] FROM pairs),
entities AS (SELECT sha256('entity' || chr(1) || name) AS node_id, name, type AS schema_type, chunk_id FROM mentions QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq) = 1)"""
BUILD = "WITH " + chunk_sql() + "," + WORDS


def parsed(t):
    return gb.parse(gb.rule_responses(gb.chunks(t.documents)))


@query("k03_parsed_responses", BUILD + """
SELECT p.chunk_id, coalesce(w.n, 0) > 0 AS accepted, CASE WHEN w.n > 0 THEN CAST(w.n - 1 AS INTEGER) END AS triples FROM pieces p LEFT JOIN resp w USING (chunk_id)""")
def _(t):
    return parsed(t).select("chunk_id", F.col("r").isNotNull().alias("accepted"), F.size("r.triples").alias("triples"))


@query("k04_entities", BUILD + " SELECT node_id, 'entity' AS label, 2 AS level, name, schema_type, chunk_id FROM entities")
def _(t):
    p = parsed(t)
    return gb.entities(gb.attribute_rows(p), gb.triple_rows(p))


@query("k05_attribute_nodes", BUILD + """
SELECT sha256(concat_ws(chr(1), 'attribute', chunk_id, entity, 0, j)) AS node_id, 'attribute' AS label, 1 AS level, attribute AS name, CAST(NULL AS VARCHAR) AS schema_type, chunk_id FROM attrs""")
def _(t):
    return gb.attribute_nodes(gb.attribute_rows(parsed(t)))


@query("k05_attribute_edges", BUILD + """
SELECT sha256('entity' || chr(1) || entity) AS src, 'has_attribute' AS relation, sha256(concat_ws(chr(1), 'attribute', chunk_id, entity, 0, j)) AS dst FROM attrs""")
def _(t):
    return gb.attribute_edges(gb.attribute_rows(parsed(t))).drop("seq")


@query("k06_entity_edges", BUILD + """
SELECT sha256('entity' || chr(1) || h) AS src, 'co_occurs' AS relation, sha256('entity' || chr(1) || t) AS dst FROM pairs""")
def _(t):
    return gb.entity_edges(gb.triple_rows(parsed(t))).drop("seq")


@query("k07_unique_edges", "SELECT src, relation, dst, min(seq) AS seq FROM kg_edges GROUP BY src, relation, dst")
def _(t):
    return gb.unique_edges(t.kg_edges)


@query("k08_relationships", """
SELECT e.seq, s.label AS s_label, s.name AS s_name, s.schema_type AS s_type, e.relation, t.label AS t_label, t.name AS t_name, t.schema_type AS t_type
FROM kg_edges e JOIN kg_nodes s ON e.src = s.node_id JOIN kg_nodes t ON e.dst = t.node_id""")
def _(t):
    return gb.relationships(t.kg_nodes, t.kg_edges)


@query("k09_evolve_schema", """
WITH cur AS (SELECT 'nodes' AS kind, lower(n_name) AS name FROM nation UNION ALL SELECT 'relations', relation FROM kg_edges WHERE relation <> 'contains' GROUP BY relation),
prop AS (SELECT 'nodes' AS kind, lower(p_type) AS name, p_partkey AS seq FROM part UNION ALL SELECT 'relations', relation, seq FROM kg_edges)
SELECT kind, name, NULL AS seq, false AS is_new FROM cur
UNION ALL SELECT kind, name, min(seq), true FROM prop ANTI JOIN cur USING (kind, name) GROUP BY 1, 2""")
def _(t):
    relations = t.kg_edges.select(F.lit("relations").alias("kind"), F.col("relation").alias("name"), "seq")
    current = t.nation.select(F.lit("nodes").alias("kind"), F.lower("n_name").alias("name")).unionByName(
        relations.where(F.col("name") != "contains").select("kind", "name").distinct()
    )
    types = t.part.select(F.lit("nodes").alias("kind"), F.lower("p_type").alias("name"), F.col("p_partkey").alias("seq"))
    return gb.evolve_schema(current, types.unionByName(relations))


@query("k10_build_counts", BUILD + """
SELECT p.doc_id, count(*) FILTER (w.n > 0) AS succeeded, count(*) FILTER (w.n IS NULL) AS failed FROM pieces p LEFT JOIN resp w USING (chunk_id) GROUP BY 1""")
def _(t):
    return gb.build_counts(parsed(t))


@query("k10_build_graph", BUILD + """
SELECT 'entity' AS kind, count(*) AS n FROM entities UNION ALL SELECT 'attribute', count(*) FROM attrs
UNION ALL SELECT 'edge', (SELECT count(DISTINCT (h, t)) FROM pairs) + (SELECT count(*) FROM attrs)""")
def _(t):
    nodes, edges = gb.to_graph(parsed(t))
    kinds = nodes.select(F.col("label").alias("kind")).unionByName(edges.select(F.lit("edge").alias("kind")))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("k10_build_rows", BUILD + """
SELECT 'node' AS kind, node_id AS id, 'entity' AS label, name AS value FROM entities
UNION ALL SELECT 'node', sha256(concat_ws(chr(1), 'attribute', chunk_id, entity, 0, j)), 'attribute', attribute FROM attrs
UNION ALL SELECT 'edge', sha256('entity' || chr(1) || entity), 'has_attribute', sha256(concat_ws(chr(1), 'attribute', chunk_id, entity, 0, j)) FROM attrs
UNION ALL SELECT DISTINCT 'edge', sha256('entity' || chr(1) || h), 'co_occurs', sha256('entity' || chr(1) || t) FROM pairs""")
def _(t):
    nodes, edges = gb.to_graph(parsed(t))
    rows = nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), "label", F.col("name").alias("value"))
    return rows.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("src").alias("id"), F.col("relation").alias("label"), F.col("dst").alias("value")))


@query("k11_adjacency", "SELECT DISTINCT src, dst FROM kg_edges")
def _(t):
    return gb.adjacency(t.kg_edges)


TRIPLE_STRINGS = """
fr AS (SELECT src, dst, arg_min(relation, seq) AS relation FROM kg_edges GROUP BY 1, 2),
strings AS (SELECT DISTINCT src AS node_id, h.name || ' ' || relation || ' ' || t.name AS txt FROM fr JOIN kg_nodes h ON h.node_id = src JOIN kg_nodes t ON t.node_id = dst
  UNION ALL SELECT node_id, name FROM kg_nodes WHERE node_id NOT IN (SELECT src FROM kg_edges))"""


@query("k12_triple_strings", f"WITH {TRIPLE_STRINGS} SELECT node_id, txt FROM strings")
def _(t):
    return gb.triple_strings(t.kg_nodes, t.kg_edges)


@query("k13_hashed_terms", f"""WITH {TRIPLE_STRINGS},
w AS (SELECT node_id, unnest(string_split(lower(txt), ' ')) AS w FROM strings)
SELECT node_id, CAST(('0x' || substr(md5(w), 1, 4)) AS BIGINT) % 64 AS bucket, count(*) AS n FROM w WHERE w <> '' GROUP BY 1, 2""")
def _(t):
    return gb.hashed_terms(gb.triple_strings(t.kg_nodes, t.kg_edges))


@query("a18_node_sizes", """
WITH ends AS (SELECT s_name AS id FROM kg_triples UNION ALL SELECT t_name FROM kg_triples), d AS (SELECT id, count(*) AS degree FROM ends GROUP BY 1)
SELECT id, degree, CAST(floor(5 + 15 * sqrt((degree - (SELECT min(degree) FROM d)) / ((SELECT max(degree) FROM d) - (SELECT min(degree) FROM d))) + 0.5) AS BIGINT) AS size FROM d""")
def _(t):
    return gv.node_sizes(gv.view_nodes(t.kg_triples, shown=30), gv.view_links(t.kg_triples))


VIEW = """
ends AS (SELECT s_name AS id, coalesce(s_type, s_label) AS category, seq * 2 AS k FROM kg_triples UNION ALL SELECT t_name, coalesce(t_type, t_label), seq * 2 + 1 FROM kg_triples),
vnodes AS (SELECT id, substr(id, 1, 30) AS name, arg_min(category, k) AS category, 25 AS size FROM ends WHERE id <> '' GROUP BY id)"""


@query("a19_view_stats", f"WITH {VIEW} SELECT (SELECT count(*) FROM vnodes) AS total_nodes, (SELECT count(*) FROM kg_triples) AS total_edges, (SELECT count(DISTINCT category) FROM vnodes) AS categories")
def _(t):
    return gv.view_stats(gv.view_nodes(t.kg_triples, shown=30), gv.view_links(t.kg_triples))


@query("l01_view_nodes", f"WITH {VIEW} SELECT * FROM vnodes")
def _(t):
    return gv.view_nodes(t.kg_triples, shown=30)


@query("l01_view_links", "SELECT seq, s_name AS source, t_name AS target, relation AS name, 1 AS value FROM kg_triples")
def _(t):
    return gv.view_links(t.kg_triples)


@query("l01_view_categories", f"WITH {VIEW} SELECT DISTINCT category FROM vnodes")
def _(t):
    return gv.view_categories(gv.view_nodes(t.kg_triples, shown=30))


@query("l02_standard_view", "SELECT p_partkey AS id, coalesce(CASE WHEN p_size > 10 THEN p_size END, 25) AS size FROM part")
def _(t):
    nodes = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("size"))
    return gv.standard_view(nodes, "size", 25)


@query("l03_set_category", """
SELECT seq, s_name, CASE WHEN s_name = 'small ring' THEN 'jewel' ELSE s_type END AS s_type, t_name, CASE WHEN t_name = 'small ring' THEN 'jewel' ELSE t_type END AS t_type FROM kg_triples""")
def _(t):
    return gv.set_category(t.kg_triples, "small ring", "jewel").select("seq", "s_name", "s_type", "t_name", "t_type")


@query("l04_add_edges", """
SELECT seq, s_label, s_name, s_type, relation, t_label, t_name, t_type FROM kg_triples
UNION ALL SELECT (SELECT max(seq) FROM kg_triples) + conv_id * 100 + turn + 1, 'entity', 'talk' || conv_id, 'talk', 'said_by', 'attribute', role, 'attribute' FROM conversations""")
def _(t):
    new = t.conversations.select(
        F.concat(F.lit("talk"), "conv_id").alias("source"), F.lit("talk").alias("source_category"), F.lit("said_by").alias("relation"),
        F.col("role").alias("target"), F.lit("attribute").alias("target_category"), (F.col("conv_id") * 100 + F.col("turn") + 1).alias("no"),
    )
    return gv.add_edges(t.kg_triples, new, "no")


@query("l05_add_nodes", """
SELECT seq, s_name, s_type, relation, t_name, t_type FROM kg_triples
UNION ALL SELECT (SELECT max(seq) FROM kg_triples) + n_nationkey + 1, 'new ' || n_name, NULL, 'self', 'new ' || n_name, NULL FROM nation""")
def _(t):
    new = t.nation.select(
        F.concat(F.lit("new "), "n_name").alias("name"), F.lit("entity").alias("category"), (F.col("n_nationkey") + 1).alias("no")
    )
    return gv.add_nodes(t.kg_triples, new, "no").select("seq", "s_name", "s_type", "relation", "t_name", "t_type")


@query("l06_delete_node", "SELECT seq, s_name, relation, t_name FROM kg_triples WHERE s_name <> 'small ring' AND t_name <> 'small ring'")
def _(t):
    return gv.delete_node(t.kg_triples, "small ring").select("seq", "s_name", "relation", "t_name")


FIRST = "(SELECT min(seq) FROM kg_triples WHERE s_name = 'small ring' AND relation = 'contains' AND t_name = 'Supplier#000000007')"


@query("l07_delete_edge", f"SELECT seq, s_name, relation, t_name FROM kg_triples WHERE seq <> coalesce({FIRST}, -1)")
def _(t):
    out = gv.delete_edge(t.kg_triples, "small ring", "contains", "Supplier#000000007")
    return out.select("seq", "s_name", "relation", "t_name")


@query("l08_update_edge", f"""
SELECT seq, s_name, CASE WHEN seq = {FIRST} THEN 'holds' ELSE relation END AS relation, t_name, CASE WHEN seq = {FIRST} THEN 'attribute' ELSE t_label END AS t_label,
  CASE WHEN seq = {FIRST} THEN 'attribute' ELSE t_type END AS t_type FROM kg_triples""")
def _(t):
    out = gv.update_edge(
        t.kg_triples, "small ring", "contains", "Supplier#000000007", new_relation="holds", new_target_category="attribute"
    )
    return out.select("seq", "s_name", "relation", "t_name", "t_label", "t_type")


@query("p27_category_subgraph", f"""WITH {VIEW}, kept AS (SELECT id FROM vnodes WHERE category = 'customer' UNION SELECT c_name FROM customer WHERE c_name NOT IN (SELECT id FROM vnodes))
SELECT s_name AS source, t_name AS target FROM kg_triples WHERE s_name IN (FROM kept) AND t_name IN (FROM kept)
UNION ALL SELECT c_name, c_name FROM customer WHERE c_name IN (FROM kept)""")
def _(t):
    rels = gv.add_nodes(
        t.kg_triples,
        t.customer.select(F.col("c_name").alias("name"), F.lit("customer").alias("category"), (F.col("c_custkey") + 1).alias("no")),
        "no",
    )
    links = gv.category_subgraph(gv.view_nodes(rels), gv.view_links(rels), "customer")[1]
    return links.select("source", "target")


@query("p28_search_nodes", f"WITH {VIEW} SELECT id, category FROM vnodes WHERE name ILIKE '%ring%' OR category ILIKE '%ring%' ORDER BY id LIMIT 10")
def _(t):
    return gv.search_nodes(gv.view_nodes(t.kg_triples, shown=30), "ring").select("id", "category")


@query("p25_nodes_of_types", "SELECT node_id FROM kg_nodes WHERE schema_type IN ('nation', 'supplier') OR (schema_type IS NULL AND label = 'entity')")
def _(t):
    from thicket.operators.retrieval import nodes_of_types

    return nodes_of_types(t.kg_nodes, ["nation", "supplier"]).select("node_id")


@query("w08_graph_node_page", f"WITH {VIEW} SELECT id, category FROM vnodes ORDER BY id LIMIT 20 OFFSET 20")
def _(t):
    from thicket.ordering import page

    return page(gv.view_nodes(t.kg_triples, shown=30).select("id", "category"), ["id"], 2)

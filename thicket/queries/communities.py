"""Similarity, clustering, keywords and super nodes."""

from pyspark.sql import functions as F

from thicket.operators import community as cm
from thicket.operators import kmeans
from thicket.operators.graphbuild import hashed_terms, hashed_vectors, triple_strings
from thicket.ordering import top_per_key
from thicket.queries.graphs import TRIPLE_STRINGS
from thicket.queries.registry import query
from thicket.queries.search import NV, sql
from thicket.session import stage

PAIRS = "pr AS (SELECT concat('P', p_partkey) AS a, concat('P', p_partkey + 1) AS b FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part))"
ADJ = "adj AS (SELECT DISTINCT src, dst FROM kg_unique WHERE src IN (SELECT node_id FROM kg_nodes WHERE level = 2) AND dst IN (SELECT node_id FROM kg_nodes WHERE level = 2)), dg AS (SELECT src, count(*) AS n FROM adj GROUP BY 1)"
JAC = """jac AS (SELECT a, b, coalesce(c.n, 0) / (coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(c.n, 0) + 1e-9) AS jaccard FROM pr
  LEFT JOIN (SELECT a, b, count(*) AS n FROM pr JOIN adj p ON p.src = a JOIN adj q ON q.src = b AND q.dst = p.dst GROUP BY 1, 2) c USING (a, b)
  LEFT JOIN dg x ON x.src = a LEFT JOIN dg y ON y.src = b)"""
KEYS = """dgr AS (SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM kg_edges UNION ALL SELECT dst FROM kg_edges) GROUP BY 1),
mem AS (SELECT comm_id, node_id, coalesce(degree, 0) AS degree, e, count(*) OVER (PARTITION BY comm_id) AS size, max(coalesce(degree, 0)) OVER (PARTITION BY comm_id) AS md
  FROM assigned LEFT JOIN dgr USING (node_id) JOIN nv ON id = node_id),
dimavg AS (SELECT comm_id, i, avg(e[i]) AS m FROM mem, range(1, 65) r(i) GROUP BY 1, 2),
mid AS (SELECT comm_id, list(m ORDER BY i) AS c FROM dimavg GROUP BY 1),
sc AS (SELECT comm_id, node_id, size, CASE WHEN size > 5 THEN round(0.3 * degree / greatest(md, 1) + 0.7 * list_cosine_similarity(e, c), 9) END AS score FROM mem JOIN mid USING (comm_id)),
key5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY comm_id ORDER BY score DESC NULLS LAST, node_id) AS rank FROM sc) WHERE rank <= 5)"""


def pairs(t):
    ids = t.part.select("p_partkey")
    nxt = ids.select((F.col("p_partkey") - 1).alias("k"))
    p = ids.join(nxt, F.col("p_partkey") == F.col("k"), "left_semi")
    return p.select(F.concat(F.lit("P"), "p_partkey").alias("a"), F.concat(F.lit("P"), F.col("p_partkey") + 1).alias("b"))


def entities(t):
    return t.kg_nodes.where(F.col("level") == 2).select("node_id")


@query("k14_jaccard", sql("SELECT a, b, round(jaccard, 6) AS jaccard FROM jac", PAIRS, ADJ, JAC))
def _(t):
    return cm.jaccard(pairs(t), t.kg_unique, entities(t)).withColumn("jaccard", F.round("jaccard", 6))


@query("k15_blended", sql("""
SELECT a, b, round(0.3 * jaccard + 0.7 * list_cosine_similarity(x.e, y.e), 6) AS score FROM jac JOIN nv x ON x.id = a JOIN nv y ON y.id = b""", NV, PAIRS, ADJ, JAC))
def _(t):
    return cm.blended(pairs(t), t.kg_unique, entities(t), t.node_vec).withColumn("score", F.round("score", 6))


def vectored(t):
    """Level-2 nodes with hashed vectors of their one-hop strings: every node has one."""
    return stage(hashed_vectors(hashed_terms(triple_strings(t.kg_nodes, t.kg_unique))))


@query("k13_hashed_vectors", f"""WITH {TRIPLE_STRINGS.replace('kg_edges', 'kg_unique')},
w AS (SELECT node_id, unnest(string_split(lower(txt), ' ')) AS w FROM strings),
b AS (SELECT node_id, CAST(('0x' || substr(md5(w), 1, 4)) AS BIGINT) % 64 AS bucket, count(*) AS n FROM w WHERE w <> '' GROUP BY 1, 2),
f AS (SELECT node_id, bucket, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY node_id)) AS FLOAT) AS DOUBLE) AS x FROM b)
SELECT node_id AS id, 64 AS dim, round(sum((bucket + 1) * x), 6) AS weighted, round(max(x), 6) AS largest FROM f GROUP BY 1""")
def _(t):
    v = vectored(t)
    weighted = F.aggregate(F.transform("emb", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return v.select("id", F.size("emb").alias("dim"), F.round(weighted, 6).alias("weighted"), F.round(F.array_max("emb").cast("double"), 6).alias("largest"))


#: The published limits of clustering.
MOST, LARGEST = 200, 100


def limits(t):
    return {"most_clusters": MOST, "cap": cm.community_cap(entities(t).count(), MOST), "largest": LARGEST}


@query("k16_first_clusters")
def _(t):
    return cm.first_clusters(entities(t), vectored(t), MOST)


# one grid of whole numbers, three fixed centres for every nation's customers
GRID = f"""sc AS (SELECT {kmeans.GRID} / pow(2, ceil(log2(max(abs(x))))) AS s FROM (SELECT unnest(e) AS x FROM nv JOIN assigned ON id = node_id)),
gr AS (SELECT comm_id AS g, node_id, list_transform(e, lambda x: CAST(round(x * s) AS BIGINT)) AS q FROM assigned JOIN nv ON id = node_id, sc),
c0 AS (SELECT g, centre, q AS c FROM (SELECT g, q, row_number() OVER (PARTITION BY g ORDER BY node_id) - 1 AS centre FROM gr) WHERE centre < 3)"""


def assign_sql(r):
    return f"""a{r} AS (SELECT g, node_id, q, centre, d FROM (SELECT g, node_id, q, centre, d, row_number() OVER (PARTITION BY g, node_id ORDER BY d, centre) AS best FROM
  (SELECT g, node_id, q, centre, list_sum(list_transform(range(1, 65), lambda i: (q[i] - c[i]) * (q[i] - c[i]))) AS d FROM gr JOIN c{r} USING (g))) WHERE best = 1)"""


def move_sql(r):
    return f"""m{r} AS (SELECT g, centre, list(CAST((2 * s + n - ((2 * s + n) % (2 * n) + 2 * n) % (2 * n)) // (2 * n) AS BIGINT) ORDER BY i) AS m FROM
  (SELECT g, centre, i, sum(q[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) x(i) GROUP BY g, centre, i) GROUP BY g, centre),
c{r + 1} AS (SELECT g, centre, coalesce(m, c) AS c FROM c{r} LEFT JOIN m{r} USING (g, centre))"""


def fixed_centres(t):
    rows = t.assigned.join(t.node_vec, F.col("node_id") == F.col("id")).select(F.col("comm_id").alias("group"), "node_id", "emb")
    grid = stage(kmeans.on_grid(rows))
    first = top_per_key(grid, ["group"], ["node_id"], 3, rank="rank")
    return kmeans.packed(grid), first.select("group", (F.col("rank") - 1).cast("int").alias("centre"), F.col("q").cast("array<bigint>").alias("c"))


@query("k16_labels_of_fixed_centres", sql('SELECT g AS "group", node_id, centre::INTEGER AS centre, d::BIGINT AS distance FROM a0', NV, GRID, assign_sql(0)))
def _(t):
    return kmeans.labels(*fixed_centres(t))


@query("k16_three_rounds", sql('SELECT g AS "group", node_id, centre::INTEGER AS centre, d::BIGINT AS distance FROM a3', NV, GRID,
                               *[x for r in range(3) for x in (assign_sql(r), move_sql(r))], assign_sql(3)))
def _(t):
    blocks, centres = fixed_centres(t)
    return kmeans.labels(blocks, kmeans.lloyd(blocks, centres, rounds=3))


@query("k17_communities", "SELECT node_id, 1::BIGINT AS communities FROM kg_nodes WHERE level = 2")
def _(t):
    found = cm.detect(entities(t), t.kg_unique, vectored(t), **limits(t))
    return found.groupBy("node_id").agg(F.count(F.lit(1)).alias("communities"))


# given clusters (nations) and sub-clusters of customers, with edges inside a nation
SUBBED = """ck AS (SELECT comm_id AS cluster, node_id, CAST(substr(node_id, 2) AS BIGINT) AS k FROM assigned),
subbed AS (SELECT cluster, k % 6 AS sub, cluster * 6 + k % 6 AS comm_id, node_id FROM ck),
inner_edges AS (SELECT x.node_id AS src, y.node_id AS dst FROM ck x JOIN ck y ON x.cluster = y.cluster AND (x.k + y.k) % 3 = 0 AND x.k <> y.k)"""
HEADS = """heads AS (SELECT comm_id // 6 AS cluster, comm_id % 6 AS sub, node_id FROM key5 WHERE rank = 1),
ha AS (SELECT x.cluster, src, dst FROM inner_edges JOIN heads x ON src = x.node_id JOIN heads y ON dst = y.node_id AND x.cluster = y.cluster),
hd AS (SELECT src, count(*) AS n FROM ha GROUP BY src),
hp AS (SELECT x.cluster, x.sub AS a, y.sub AS b, x.node_id AS na, y.node_id AS nb, round(list_cosine_similarity(p.e, q.e), 9) AS cos
  FROM heads x JOIN heads y ON x.cluster = y.cluster AND x.sub < y.sub JOIN nv p ON p.id = x.node_id JOIN nv q ON q.id = y.node_id),
hb AS (SELECT hp.cluster, a, b, count(*) AS n FROM hp JOIN ha u ON u.src = na JOIN ha v ON v.src = nb AND u.dst = v.dst GROUP BY 1, 2, 3),
ss AS (SELECT cluster, sub, count(*) AS n FROM subbed GROUP BY 1, 2),
may AS (SELECT * FROM (SELECT hp.cluster, a, b, round(0.3 * coalesce(hb.n, 0) / (coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(hb.n, 0) + 1e-9) + 0.7 * cos, 9) AS score, cos
  FROM hp LEFT JOIN hb USING (cluster, a, b) LEFT JOIN hd x ON x.src = na LEFT JOIN hd y ON y.src = nb
  JOIN ss s1 ON s1.cluster = hp.cluster AND s1.sub = a JOIN ss s2 ON s2.cluster = hp.cluster AND s2.sub = b WHERE s1.n + s2.n <= 40)
  WHERE score >= 0.35)"""
GREEDY = """ends AS (SELECT cluster, a, b, score, a AS e FROM may UNION ALL SELECT cluster, a, b, score, b FROM may),
loop(cluster, a, b, score, e, state, r) AS (SELECT cluster, a, b, score, e, 0, 0 FROM ends UNION ALL
  SELECT cluster, a, b, score, e, CASE WHEN n_best = 2 THEN 1 ELSE 0 END, r + 1 FROM (
    SELECT *, sum(CASE WHEN best = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY cluster, a, b) AS n_best FROM (
      SELECT *, row_number() OVER (PARTITION BY cluster, e ORDER BY score DESC, a, b) AS best FROM (
        SELECT *, max(hit) OVER (PARTITION BY cluster, a, b) AS dropped FROM (
          SELECT *, max(state) OVER (PARTITION BY cluster, e) AS hit FROM loop))
      WHERE dropped = 0))),
matched AS (SELECT DISTINCT cluster, a, b FROM loop WHERE state = 1)"""
FIXED = [NV, SUBBED, KEYS.replace("FROM assigned", "FROM subbed"), HEADS, GREEDY]
NUMBERED = """mg2 AS (SELECT s.cluster, coalesce(a, s.sub) AS merged, node_id FROM subbed s LEFT JOIN matched m ON m.cluster = s.cluster AND m.b = s.sub),
gz AS (SELECT cluster, merged, count(*) AS n, sum(count(*)) OVER (PARTITION BY cluster) AS size FROM mg2 GROUP BY 1, 2),
gp AS (SELECT cluster, merged, row_number() OVER (ORDER BY size DESC, cluster, n DESC, merged) AS place FROM gz),
gq AS (SELECT cluster, merged, CASE WHEN place <= 60 THEN place ELSE min(place) FILTER (place > 60) OVER (PARTITION BY cluster) END AS place FROM gp),
gn AS (SELECT cluster, merged, dense_rank() OVER (ORDER BY place) - 1 AS comm_id FROM gq)"""


def given_clusters(t):
    k = F.substring("node_id", 2, 20).cast("long")
    rows = t.assigned.select(F.col("comm_id").cast("int").alias("cluster"), k.alias("k"), "node_id")
    other = rows.select("cluster", F.col("k").alias("k2"), F.col("node_id").alias("dst"))
    edges = rows.join(other, "cluster").where("(k + k2) % 3 = 0 AND k <> k2").select(F.col("node_id").alias("src"), "dst")
    return stage(rows.select("cluster", (k % 6).alias("sub"), "node_id")), stage(edges)


@query("k17_numbered_communities", sql("SELECT comm_id::BIGINT AS comm_id, node_id FROM mg2 JOIN gn USING (cluster, merged)", *FIXED, NUMBERED))
def _(t):
    subs, edges = given_clusters(t)
    merged = cm.merge_subclusters(subs, edges, t.node_vec, merge_at=0.35, largest=40)
    return cm.number_communities(subs.join(merged, ["cluster", "sub"]), cap=60)


@query("k18_greedy_matching", sql("SELECT cluster::INTEGER AS cluster, a, b FROM matched", *FIXED))
def _(t):
    subs, edges = given_clusters(t)
    return cm.greedy_matching(cm.merge_candidates(subs, edges, t.node_vec, merge_at=0.35, largest=40))


@query("k18_merged_subclusters")
def _(t):
    v = vectored(t)
    subs = stage(cm.split_clusters(cm.first_clusters(entities(t), v, MOST), v, MOST))
    return cm.merge_subclusters(subs, t.kg_unique, v, largest=LARGEST)


@query("k19_centers", sql("SELECT comm_id, node_id FROM key5 WHERE rank = 1", NV, KEYS))
def _(t):
    return cm.centers(t.assigned, t.kg_edges, t.node_vec)


@query("k20_keywords", sql("SELECT comm_id, node_id, rank, round(score, 6) AS score FROM key5", NV, KEYS))
def _(t):
    return cm.keywords(t.assigned, t.kg_edges, t.node_vec).withColumn("score", F.round("score", 6))


@query("k21_super_nodes", """
SELECT 'comm_4_' || comm_id AS node_id, 'community' AS label, 4 AS level, coalesce(n_name, 'Community_' || comm_id) AS name, 'Community of ' || count(*) || ' members' AS description
FROM assigned LEFT JOIN (SELECT * FROM nation WHERE n_regionkey > 1) ON n_nationkey = comm_id GROUP BY comm_id, n_name HAVING count(*) >= 2""")
def _(t):
    names = t.nation.where(F.col("n_regionkey") > 1).select(
        F.col("n_nationkey").cast("long").alias("comm_id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("summary")
    )
    return cm.super_nodes(t.assigned, names)


@query("k21_member_edges", """
SELECT node_id AS src, 'member_of' AS relation, 'comm_4_' || comm_id AS dst FROM assigned WHERE comm_id IN (SELECT comm_id FROM assigned GROUP BY 1 HAVING count(*) >= 2)""")
def _(t):
    return cm.member_edges(t.assigned)


@query("k22_keyword_nodes", sql("SELECT 'kw_' || comm_id || '_' || node_id AS node_id, 'keyword' AS label, 3 AS level, name FROM key5 JOIN (SELECT node_id, name FROM kg_nodes) USING (node_id) WHERE size >= 2", NV, KEYS))
def _(t):
    return cm.keyword_nodes(cm.large_keywords(t.assigned, t.kg_edges, t.node_vec), t.kg_nodes)


@query("k22_keyword_edges", sql("""
SELECT node_id AS src, 'represented_by' AS relation, 'kw_' || comm_id || '_' || node_id AS dst FROM key5 WHERE size >= 2
UNION ALL SELECT 'kw_' || comm_id || '_' || node_id, 'keyword_of', 'comm_4_' || comm_id FROM key5 WHERE size >= 2
UNION ALL SELECT node_id, 'kw_filter_by', 'kw_' || comm_id || '_' || node_id FROM key5 WHERE size >= 2""", NV, KEYS))
def _(t):
    return cm.keyword_edges(cm.large_keywords(t.assigned, t.kg_edges, t.node_vec))


@query("k23_naming_batches", sql("""
SELECT CAST(floor((row_number() OVER (ORDER BY comm_id) - 1) / 5) AS BIGINT) AS batch, comm_id,
 '{"id":' || comm_id || ',"center":"' || center || '","members":[' || names || '],"size":' || size || '}' AS request
FROM (SELECT comm_id, max(size) AS size, string_agg('"' || name || '"', ',' ORDER BY node_id) FILTER (rn <= 10) AS names FROM
  (SELECT a.*, n.name, count(*) OVER (PARTITION BY comm_id) AS size, row_number() OVER (PARTITION BY comm_id ORDER BY node_id) AS rn FROM assigned a JOIN kg_nodes n USING (node_id)) GROUP BY 1)
JOIN (SELECT comm_id, name AS center FROM key5 JOIN (SELECT node_id, name FROM kg_nodes) USING (node_id) WHERE rank = 1) USING (comm_id) WHERE size >= 2""", NV, KEYS))
def _(t):
    return cm.naming_batches(t.assigned, t.kg_nodes, t.kg_edges, t.node_vec)


@query("k24_level4")
def _(t):
    nodes, edges = cm.build_level4(t.kg_nodes, t.kg_unique, vectored(t), **limits(t))
    kinds = nodes.select(F.col("label").alias("kind")).unionByName(edges.select(F.col("relation").alias("kind")))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))

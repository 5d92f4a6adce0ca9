"""Data sources, parameters, paths, chart shapes, set operations and scalar functions."""

import json

from pyspark.sql import functions as F

from thicket.functions import jsonpath, text
from thicket.operators import charts, setops
from thicket.plans.datasource import MAX_ROWS, DataSource, cache_key_column, filled_column, preview_source, run_source, run_sql, soft_column
from thicket.queries.registry import query

DAILY_SQL = """
SELECT to_date(ts) AS day, count(*) AS total, count_if(status = 1) AS ok, count_if(status = 0) AS failed
FROM login_log WHERE ts >= (SELECT max(ts) FROM login_log) - make_interval(0, 0, 0, :days)
GROUP BY to_date(ts)"""
DAILY = """
WITH daily AS (SELECT CAST(ts AS DATE) AS day, count(*) AS total, count(*) FILTER (status = 1) AS ok, count(*) FILTER (status = 0) AS failed
FROM login_log WHERE ts >= (SELECT max(ts) FROM login_log) - INTERVAL {days} DAY GROUP BY 1)"""
DAYS = ({"name": "days", "type": "integer", "default": 30},)


@query("s01_bound_sql", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'F'")
def _(t):
    sql = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > :low AND o_orderstatus = :status"
    return run_sql(t.spark, sql, {"low": 400000.0, "status": "F"}, {"orders": t.orders})


@query("s02_data_source_axis", DAILY.format(days=14) + """
SELECT row_number() OVER (ORDER BY day) AS position, day AS x, CAST(unnest([0, 1, 2]) AS INTEGER) AS series_no,
       unnest(['all', 'ok', 'failed']) AS series, CAST(unnest([total, ok, failed]) AS DOUBLE) AS value FROM daily""")
def _(t):
    source = DataSource(
        "daily", "sql", sql=DAILY_SQL, params=DAYS, field_mapping={"day": "date"}, result_type="chart-axis",
        order=("date",), chart={"series_names": ["all"]},
    )
    return run_source(t.spark, source, {"days": "14"}, {"login_log": t.login_log})


@query("s02_data_source_list", "SELECT id, duration AS seconds, status FROM scheduler_log WHERE status = 'failed' ORDER BY duration DESC, id LIMIT 1000")
def _(t):
    source = DataSource(
        "failed", "sql", sql="SELECT id, status, duration FROM scheduler_log WHERE status = :status",
        params=({"name": "status", "required": True},), field_mapping={"duration": "seconds"}, order=(F.desc("seconds"), "id"),
    )
    return run_source(t.spark, source, {"status": "failed"}, {"scheduler_log": t.scheduler_log}, cap=MAX_ROWS)


@query("s03_preview", "SELECT id, status FROM scheduler_log WHERE status = 'running' ORDER BY id LIMIT 100")
def _(t):
    source = DataSource("p", "sql", sql="SELECT id, status FROM scheduler_log WHERE status = 'running'", order=("id",))
    return preview_source(t.spark, source, {}, {"scheduler_log": t.scheduler_log})


def api_response():
    """An order as an API would answer: a code and two items under ``data``."""
    first = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"))
    second = F.struct((F.col("o_orderkey") * 2).alias("id"), F.col("o_orderpriority").alias("state"))
    data = F.struct(F.array(first, second).alias("items"))
    return F.to_json(F.struct(F.lit(0).alias("code"), data.alias("data")))


@query("s05_api_rows", """
SELECT o_orderkey AS response, o_orderkey AS id, o_orderstatus AS state FROM orders UNION ALL SELECT o_orderkey, o_orderkey * 2, o_orderpriority FROM orders""")
def _(t):
    responses = t.orders.select(F.col("o_orderkey").alias("response"), api_response().alias("body"))
    source = DataSource("api", "api", data_path="data.items", row_schema="id bigint, state string", order=("response",), result_type="rows")
    return run_source(t.spark, source, {}, {"responses": responses})


@query("p01_field_mapping", "SELECT o_totalprice AS price, o_orderkey AS id, o_custkey, o_orderstatus FROM orders")
def _(t):
    from thicket.plans.datasource import map_fields

    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return map_fields(orders, {"o_totalprice": "price", "o_orderkey": "id", "nothing": "gone"})


@query("p02_value_at_path", """
SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS missing FROM events""")
def _(t):
    p = F.col("props")
    return t.events.select("event_id", jsonpath.value_at(p, "k").alias("k"), jsonpath.value_at(p, "k.x.0").alias("missing"))


@query("p03_index_path", "SELECT o_orderkey, o_orderpriority AS state, o_orderkey * 2 AS id FROM orders")
def _(t):
    body = t.orders.select("o_orderkey", api_response().alias("body"))
    return body.select(
        "o_orderkey",
        jsonpath.value_at(F.col("body"), "data.items[1].state").alias("state"),
        jsonpath.value_at(F.col("body"), "data.items.1.id").cast("long").alias("id"),
    )


@query("p03_set_at_path", "SELECT o_orderkey, o_orderstatus AS state, o_totalprice AS price, 'EUR' AS unit FROM orders")
def _(t):
    rows = t.orders.select("o_orderkey", F.struct(F.col("o_orderstatus").alias("state")).alias("props"), "o_totalprice")
    rows = jsonpath.set_at(jsonpath.set_at(rows, "props.price.amount", F.col("o_totalprice")), "props.price.unit", F.lit("EUR"))
    return rows.select("o_orderkey", "props.state", F.col("props.price.amount").alias("price"), "props.price.unit")


@query("p04_map_over_defaults", """
SELECT o_orderkey, o_orderstatus AS label, 'none' AS color, o_orderpriority AS second FROM orders""")
def _(t):
    body = t.orders.select("o_orderkey", api_response().alias("body"))
    cols = jsonpath.map_fields(
        F.col("body"),
        {"data.items[0].state": "label", "data.color": "color", "data.items[1].state": "second"},
        {"label": F.lit("?"), "color": F.lit("none")},
    )
    return body.select("o_orderkey", *cols)


@query("p05_merged_params", "SELECT o_orderkey FROM orders WHERE o_totalprice > 450000 AND o_orderpriority = '1-URGENT'")
def _(t):
    from thicket.plans.datasource import merge_params

    declared = [{"name": "low", "type": "float"}, {"name": "priority", "default": "1-URGENT"}, {"name": "unused"}]
    params = merge_params(declared, {"low": "450000"})
    return run_sql(
        t.spark, "SELECT o_orderkey FROM orders WHERE o_totalprice > :low AND o_orderpriority = :priority", params, {"orders": t.orders}
    )


@query("p06_soft_conversion", """
SELECT l_orderkey, l_linenumber, coalesce(CAST(TRY_CAST(l_returnflag AS INTEGER) AS VARCHAR), l_returnflag) AS flag,
       coalesce(CAST(TRY_CAST(CAST(l_partkey AS VARCHAR) AS INTEGER) AS VARCHAR), '') AS part FROM lineitem""")
def _(t):
    part = F.col("l_partkey").cast("string")
    return t.lineitem.select("l_orderkey", "l_linenumber", soft_column(F.col("l_returnflag"), "integer").alias("flag"), soft_column(part, "integer").alias("part"))


@query("p07_fill_placeholders", "SELECT user_id, '{\"q\": \"user ' || user_id || ' of ' || event_type || '\"}' AS body FROM events")
def _(t):
    body = json.dumps({"q": "user {user} of {kind}"})
    return t.events.select("user_id", filled_column(body, {"user": F.col("user_id"), "kind": F.col("event_type")}).alias("body"))


# ---- chart shapes

_BY_DAY = DAILY.format(days=30)


def _daily(t):
    return run_sql(t.spark, DAILY_SQL, {"days": 30}, {"login_log": t.login_log})


@query("c01_shape_tree", """
WITH RECURSIVE tree AS (SELECT id, parent_id, id AS root_id, 0 AS depth FROM dept WHERE parent_id IS NULL
  UNION ALL SELECT c.id, c.parent_id, t.root_id, t.depth + 1 FROM dept c JOIN tree t ON c.parent_id = t.id) SELECT * FROM tree""")
def _(t):
    source = DataSource("t", "sql", sql="SELECT id, parent_id, name FROM dept", result_type="tree")
    return run_source(t.spark, source, {}, {"dept": t.dept}).select("id", "parent_id", "root_id", "depth")


@query("c02_object", _BY_DAY + " SELECT * FROM daily ORDER BY total DESC, day LIMIT 1")
def _(t):
    source = DataSource("o", "sql", sql=DAILY_SQL, params=DAYS, result_type="object", order=(F.desc("total"), "day"))
    return run_source(t.spark, source, {}, {"login_log": t.login_log})


@query("c03_value", _BY_DAY + " SELECT day FROM daily ORDER BY total DESC, day LIMIT 1")
def _(t):
    source = DataSource("v", "sql", sql=DAILY_SQL, params=DAYS, result_type="value", order=(F.desc("total"), "day"))
    return run_source(t.spark, source, {}, {"login_log": t.login_log})


@query("c04_axis", """
SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_discount) AS position, l_shipdate AS x, CAST(unnest([0, 1, 2]) AS INTEGER) AS series_no,
  unnest(['Qty', 'l_discount', 'gone']) AS series, unnest([l_quantity, l_discount, 0.0]) AS value FROM lineitem""")
def _(t):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_discount"]
    rows = t.lineitem.select(*key)
    return charts.axis(rows, key, "l_shipdate", ["l_quantity", "l_discount", "gone"], ["Qty"])


@query("c05_pie", "SELECT row_number() OVER (ORDER BY n DESC, k) AS position, k AS name, n AS value FROM (SELECT p_brand AS k, count(*) AS n FROM part GROUP BY 1)")
def _(t):
    counts = t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return charts.pie(counts, [F.desc("n"), "p_brand"])


@query("c06_gauge", "SELECT o_totalprice AS value, o_orderpriority AS name, 100 AS max FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def _(t):
    return charts.gauge(t.orders, [F.desc("o_totalprice"), "o_orderkey"], "o_totalprice", "o_orderpriority")


@query("c07_radar", """
SELECT row_number() OVER (ORDER BY k) AS position, k AS indicator, mx AS max, CAST(unnest([0, 1]) AS INTEGER) AS series_no,
  unnest(['Low', 'cnt']) AS series, unnest([mn, CAST(cnt AS DOUBLE)]) AS value
FROM (SELECT p_type AS k, max(p_retailprice) AS mx, min(p_retailprice) AS mn, count(*) AS cnt FROM part GROUP BY 1)""")
def _(t):
    stats = t.part.groupBy(F.col("p_type").alias("name")).agg(
        F.max("p_retailprice").alias("max"), F.min("p_retailprice").alias("mn"), F.count(F.lit(1)).alias("cnt")
    )
    return charts.radar(stats, ["name"], series_names=["Low"])


@query("c08_scatter", """
SELECT row_number() OVER (ORDER BY p_partkey) AS position, p_size AS x, p_retailprice AS y, 0 AS size, p_name AS name FROM part""")
def _(t):
    return charts.scatter(t.part, ["p_partkey"], "p_size", "p_retailprice", "gone", "p_name")


@query("c09_heatmap", """
WITH r AS (SELECT row_number() OVER (ORDER BY event_id) AS position, event_type AS x, user_id AS y, value FROM events),
 xs AS (SELECT x, row_number() OVER (ORDER BY min(position)) - 1 AS xi FROM r GROUP BY x), ys AS (SELECT y, row_number() OVER (ORDER BY min(position)) - 1 AS yi FROM r GROUP BY y)
SELECT position, xi, yi, x, y, value FROM r JOIN xs USING (x) JOIN ys USING (y)""")
def _(t):
    return charts.heatmap(t.events, ["event_id"], "event_type", "user_id", "value")


def _written(t):
    return t.kg_edges.select("seq", F.format_string("['%s', '%s', '%s']", "src", "relation", "dst").alias("txt"))


@query("c10_retrieved_links", "SELECT seq, src AS source, dst AS target, substr(relation, 1, 15) AS name, relation FROM kg_edges")
def _(t):
    return charts.retrieved_links(_written(t), "txt", ["seq"], shown=15)


@query("c10_retrieved_nodes", "SELECT DISTINCT id, substr(id, 1, 20) AS name FROM (SELECT src AS id FROM kg_edges UNION ALL SELECT dst FROM kg_edges)")
def _(t):
    return charts.retrieved_nodes(charts.retrieved_links(_written(t), "txt"), shown=20)


@query("c11_question_triples", """
SELECT 'sq_' || conv_id AS source, 'triple_' || conv_id || '_' || turn AS target, substr(role, 1, 15) AS link_name, substr('turn ' || turn, 1, 20) AS node_name, role AS head, 'turn ' || turn AS relation
FROM conversations WHERE turn < 5""")
def _(t):
    said = t.conversations.select("conv_id", "turn", F.format_string("[%s, 'turn %d', end]", "role", "turn").alias("txt"))
    return charts.question_triples(said, "conv_id", "turn", "txt", k=5, link_shown=15, node_shown=20)


@query("c12_reasoning_chain", """
SELECT conv_id, CASE WHEN turn = 0 THEN 'question' ELSE 'step_' || (turn - 1) END AS source, 'step_' || turn AS target, substr(text, 1, 20) AS name, text FROM conversations""")
def _(t):
    return charts.reasoning_chain(t.conversations, "conv_id", "turn", "text", shown=20)


# ---- set operations


@query("f01_union_distinct", "SELECT src, relation, dst FROM kg_edges WHERE relation = 'contains' UNION SELECT src, relation, dst FROM kg_edges WHERE src LIKE 'P1%' UNION SELECT src, relation, dst FROM kg_edges WHERE dst LIKE 'S1%'")
def _(t):
    e = t.kg_edges.drop("seq")
    return setops.union_distinct(
        e.where(F.col("relation") == "contains"), e.where(F.col("src").startswith("P1")), e.where(F.col("dst").startswith("S1"))
    )


@query("f02_deduplicate", "SELECT h, r, t, min(seq) AS seq FROM turn_triple GROUP BY h, r, t")
def _(t):
    return setops.deduplicate(t.turn_triple)


@query("f03_merge_scored", """
SELECT k, max(score) AS score FROM (SELECT l_partkey AS k, l_discount AS score FROM lineitem UNION ALL SELECT p_partkey, p_size / 1000 FROM part) GROUP BY 1""")
def _(t):
    a = t.lineitem.select(F.col("l_partkey").alias("k"), F.col("l_discount").alias("score"))
    b = t.part.select(F.col("p_partkey").alias("k"), (F.col("p_size") / 1000).alias("score"))
    return setops.merge_scored([a, b], ["k"])


@query("f03_merge_scored_raw", "SELECT k, score FROM (SELECT l_partkey AS k, l_discount AS score FROM lineitem UNION ALL SELECT p_partkey, p_size / 1000 FROM part)")
def _(t):
    a = t.lineitem.select(F.col("l_partkey").alias("k"), F.col("l_discount").alias("score"))
    b = t.part.select(F.col("p_partkey").alias("k"), (F.col("p_size") / 1000).alias("score"))
    return setops.merge_scored([a, b], ["k"], raw=True)


_CONSISTENT = """
SELECT (SELECT count(DISTINCT id) FROM node_vec) AS current, (SELECT count(*) FROM (SELECT id FROM node_vec EXCEPT SELECT node_id FROM kg_nodes)) AS missing,
 (SELECT count(*) FROM (SELECT node_id FROM kg_nodes EXCEPT SELECT id FROM node_vec)) AS extra,
 (SELECT count(*) FROM (SELECT id FROM node_vec EXCEPT SELECT node_id FROM kg_nodes)) = 0
   AND (SELECT count(*) FROM (SELECT node_id FROM kg_nodes EXCEPT SELECT id FROM node_vec)) <= (SELECT count(DISTINCT id) FROM node_vec) * {tol} AS consistent"""


@query("f04_consistency", _CONSISTENT.format(tol=0.1))
def _(t):
    return setops.consistency(t.node_vec.select("id"), t.kg_nodes.select(F.col("node_id").alias("id")), "id")


@query("f05_strict_consistency", _CONSISTENT.format(tol=0))
def _(t):
    return setops.consistency(t.node_vec.select("id"), t.kg_nodes.select(F.col("node_id").alias("id")), "id", tolerance=0)


@query("f06_diff", """
WITH n AS (SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN upper(p_name) ELSE p_name END AS name, CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_brand END AS brand FROM part WHERE p_size <> 7)
SELECT coalesce(o.p_partkey, n.id) AS id, 'name' AS field, n.name AS new_value FROM part o FULL JOIN n ON o.p_partkey = n.id WHERE o.p_name IS DISTINCT FROM n.name
UNION ALL SELECT coalesce(o.p_partkey, n.id), 'brand', n.brand FROM part o FULL JOIN n ON o.p_partkey = n.id WHERE o.p_brand IS DISTINCT FROM n.brand""")
def _(t):
    old = t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.array("p_type", "p_name").alias("tags"),
    )
    new = t.part.where(F.col("p_size") != 7).select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") > 40, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"),
        F.when(F.col("p_type") != "PROMO", F.col("p_brand")).alias("brand"),
        F.array("p_name", "p_type").alias("tags"),
    )
    return setops.diff(old, new, "id").where(F.col("field") != "tags")


@query("f07_union_listing", "SELECT 'nation' AS kind, n_name AS name FROM nation UNION ALL SELECT 'region', r_name FROM region")
def _(t):
    a = t.nation.select(F.lit("nation").alias("kind"), F.col("n_name").alias("name"))
    return a.unionByName(t.region.select(F.lit("region").alias("kind"), F.col("r_name").alias("name"))).orderBy("kind", "name")


# ---- scalar functions

NODE_TEXT = "CASE WHEN trim(coalesce(trim(name), '') || ' ' || coalesce(trim(description), '')) = '' THEN '[Node: ' || node_id || ']' ELSE trim(coalesce(trim(name), '') || ' ' || coalesce(trim(description), '')) END"


@query("x01_sanitized", "SELECT node_id, coalesce(trim(description), '') AS value, array_to_string([name, label], ', ') AS listed FROM kg_nodes")
def _(t):
    return t.kg_nodes.select(
        "node_id", text.sanitized(F.col("description")).alias("value"), text.sanitized_list(F.array("name", "label")).alias("listed")
    )


@query("x02_name_and_description", """
SELECT node_id, CASE WHEN label = 'entity' THEN name ELSE label END AS name, coalesce(trim(description), '') AS description FROM kg_nodes""")
def _(t):
    props = F.when(F.col("label") == "entity", F.create_map(F.lit("name"), F.col("name")))
    name = F.coalesce(F.try_element_at(props, F.lit("name")), F.col("label"))
    return t.kg_nodes.select("node_id", text.sanitized(name).alias("name"), text.sanitized(F.col("description")).alias("description"))


@query("x03_node_text", f"SELECT node_id, {NODE_TEXT} AS txt FROM kg_nodes")
def _(t):
    return t.kg_nodes.select("node_id", text.node_text(F.col("name"), F.col("description"), F.col("node_id")).alias("txt"))


@query("x04_index_text", """
SELECT node_id, trim(coalesce(nullif(trim(name), ''), 'none') || ',' || coalesce(nullif(trim(description), ''), 'none')) AS txt FROM kg_nodes""")
def _(t):
    return t.kg_nodes.select("node_id", text.index_text(F.col("name"), F.col("description")).alias("txt"))


@query("x05_property_list", """
SELECT node_id, CASE WHEN schema_type IS NULL THEN '[tag: x]' ELSE '[schema_type: ' || schema_type || ', tag: x]' END AS txt FROM kg_nodes""")
def _(t):
    props = F.create_map(
        F.lit("name"), F.col("name"), F.lit("tag"), F.lit("x"), F.lit("schema_type"), F.col("schema_type"),
        F.lit("chunk id"), F.col("chunk_id"), F.lit("level"), F.col("level").cast("string"),
    )
    return t.kg_nodes.select("node_id", text.property_list(props).alias("txt"))


@query("x06_triple_text", """
SELECT seq, h.txt || ' ' || relation || ' ' || t.txt AS txt FROM kg_edges
JOIN (SELECT node_id, NT AS txt FROM kg_nodes) h ON src = h.node_id JOIN (SELECT node_id, NT AS txt FROM kg_nodes) t ON dst = t.node_id""".replace("NT", NODE_TEXT))
def _(t):
    nodes = t.kg_nodes.select("node_id", text.node_text(F.col("name"), F.col("description"), F.col("node_id")).alias("txt"))
    h = nodes.select(F.col("node_id").alias("src"), F.col("txt").alias("ht"))
    d = nodes.select(F.col("node_id").alias("dst"), F.col("txt").alias("dt"))
    e = t.kg_edges.join(h, "src").join(d, "dst")
    return e.select("seq", text.triple_text(F.col("ht"), F.col("relation"), F.col("dt")).alias("txt"))


@query("p26_valid_text", f"SELECT node_id FROM (SELECT node_id, {NODE_TEXT} AS t FROM kg_nodes) WHERE t <> '' AND NOT starts_with(t, '[Error') AND NOT starts_with(t, '[Unknown')")
def _(t):
    nodes = t.kg_nodes.withColumn("t", text.node_text(F.col("name"), F.col("description"), F.col("node_id")))
    return nodes.where(text.valid_node_text(F.col("t"))).select("node_id")


@query("x08_fill_template", "SELECT id, 'Dear ' || name || ', ' || coalesce(CAST(manager_id AS VARCHAR), '') || ' ' AS txt FROM users WHERE manager_id IS NULL OR manager_id <> 0 UNION ALL SELECT id, 'Dear ' || name || ',  ' FROM users WHERE manager_id = 0")
def _(t):
    values = {"user.name": F.col("name"), "boss": F.col("manager_id")}
    return t.users.select("id", text.fill_template(F.lit("Dear ${user.name}, ${boss} ${x.y}"), values).alias("txt"))


@query("x09_clean_response", """
SELECT doc_id, trim(text, E' \\t\\n\\r') AS txt FROM documents""")
def _(t):
    said = F.concat(F.lit("\r\n```json\r\n"), F.regexp_replace("text", r"\A[ \t\n\r]+|[ \t\n\r]+\z", ""), F.lit("\n```​ "))
    return t.documents.select("doc_id", text.clean_response(said).alias("txt"))


@query("x10_byte_size", """
SELECT o_orderkey, CASE WHEN b = 0 THEN '0 bytes' WHEN b >= 1073741824 THEN printf('%.2f', b / 1073741824) || ' GB' WHEN b >= 1048576 THEN printf('%.2f', b / 1048576) || ' MB'
  WHEN b >= 1024 THEN printf('%.2f', b / 1024) || ' KB' ELSE b || ' bytes' END AS txt FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 37 AS b FROM orders)""")
def _(t):
    return t.orders.select("o_orderkey", text.byte_size(F.col("o_orderkey") * F.col("o_orderkey") * 37).alias("txt"))


@query("x11_serialized_row", """
SELECT o_orderkey, '{"id":' || o_orderkey || ',"day":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '","raw":"' || o_orderstatus || '"}' AS txt FROM orders""")
def _(t):
    row = F.struct(
        F.col("o_orderkey").alias("id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("day"),
        F.decode(F.encode("o_orderstatus", "UTF-8"), "UTF-8").alias("raw"),
    )
    return t.orders.select("o_orderkey", F.to_json(row).alias("txt"))


@query("x12_counters_map", "SELECT p_partkey, CAST(p_size AS BIGINT) AS keys, p_partkey AS expires, CAST(NULL AS BIGINT) AS bad FROM part")
def _(t):
    stats = F.format_string("keys=%d,expires=%d,bad=x", "p_size", "p_partkey")
    m = t.part.select("p_partkey", text.counters_map(stats).alias("m"))
    return m.select("p_partkey", F.col("m")["keys"].alias("keys"), F.col("m")["expires"].alias("expires"), F.col("m")["bad"].alias("bad"))


@query("x16_valid_triples", "SELECT seq, h, r, t FROM turn_triple WHERE t <> ''")
def _(t):
    from thicket.operators.graphbuild import valid_triples

    raw = t.turn_triple.select(
        "seq", F.when(F.col("t") == "", F.array("h", "r")).otherwise(F.array("h", "r", "t", F.lit("rest"))).alias("parts")
    )
    return valid_triples(raw, "parts").select("seq", "h", "r", "t")


@query("x17_keep_recent", """
SELECT event_id, user_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10""")
def _(t):
    from thicket.ordering import top_per_key

    return top_per_key(t.events.select("event_id", "user_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10)


@query("x18_child_paths", """
SELECT c.id, p.path || p.id || '/' AS path, p.level + 1 AS level FROM dept c JOIN dept p ON c.parent_id = p.id""")
def _(t):
    p = t.dept.select(F.col("id").alias("parent_id"), F.col("path").alias("pp"), F.col("level").alias("pl"))
    child = t.dept.select("id", "parent_id").join(p, "parent_id")
    return child.select("id", F.concat("pp", "parent_id", F.lit("/")).alias("path"), (F.col("pl") + 1).alias("level"))


@query("x19_cache_key", "SELECT o_orderkey, 'datasource:' || o_orderpriority || ':' || substr(md5('[(''a'', ' || o_orderkey || '), (''b'', ''' || o_orderstatus || ''')]'), 1, 8) AS key FROM orders")
def _(t):
    key = cache_key_column(F.col("o_orderpriority"), {"a": F.col("o_orderkey"), "b": F.col("o_orderstatus")}, texts=["b"])
    return t.orders.select("o_orderkey", key.alias("key"))


@query("x20_durations", """
SELECT o_orderkey, CASE WHEN us < 1000 THEN us || 'μs' WHEN us < 1000000 THEN printf('%.2f', us / 1000) || 'ms' ELSE printf('%.2f', us / 1000000) || 's' END AS duration,
 CASE WHEN ms = 0 THEN 'permanent' WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN CAST(floor(ms / 1000) AS BIGINT) || 's' WHEN ms < 3600000 THEN CAST(floor(ms / 60000) AS BIGINT) || 'min'
      WHEN ms < 86400000 THEN CAST(floor(ms / 3600000) AS BIGINT) || 'h' ELSE CAST(floor(ms / 86400000) AS BIGINT) || 'd' END AS ttl
FROM (SELECT o_orderkey, o_orderkey * 211 AS us, o_orderkey * o_orderkey * 3 AS ms FROM orders)""")
def _(t):
    us, ms = F.col("o_orderkey") * 211, F.col("o_orderkey") * F.col("o_orderkey") * 3
    return t.orders.select("o_orderkey", text.duration_text(us).alias("duration"), text.ttl_text(ms).alias("ttl"))


@query("x21_letter_case", """
SELECT p_partkey, upper(p_name[1]) || p_name[2:] AS cap, lower(p_brand[1]) || p_brand[2:] AS low, 'parent' || upper(p_name[1]) || p_name[2:] AS camel,
  split_part(p_name, ' ', 1) || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS kebab FROM part""")
def _(t):
    return t.part.select(
        "p_partkey",
        text.capitalized(F.col("p_name")).alias("cap"),
        text.lower_first(F.col("p_brand")).alias("low"),
        text.camel_key(F.col("p_name"), F.lit("parent")).alias("camel"),
        text.kebab_to_camel(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("kebab"),
    )


@query("x22_zoned_dates", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'soon' ELSE strftime(o_orderdate + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') END AS txt FROM orders""")
def _(t):
    raw = F.when(F.col("o_orderstatus") == "P", "soon").otherwise(F.col("o_orderdate").cast("string"))
    return t.orders.select("o_orderkey", text.zoned_date(raw, "yyyy-MM-dd HH:mm:ss", "Asia/Shanghai").alias("txt"))


@query("x23_first_non_null", "SELECT node_id, coalesce(schema_type, chunk_id, label) AS value FROM kg_nodes")
def _(t):
    return t.kg_nodes.select("node_id", F.coalesce("schema_type", "chunk_id", "label").alias("value"))


@query("x24_nested_value", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def _(t):
    return t.events.select("event_id", jsonpath.required_value_at(F.col("props"), "k").cast("int").alias("k"))

"""Log statistics, monitor statistics, windows and pages."""

from pyspark.sql import functions as F

from thicket.operators import filters, logstats, monitor
from thicket.ordering import first_per_key, number_pages, page, top
from thicket.queries.registry import query
from thicket.functions.text import tokens

SINCE_30 = "ts >= (SELECT max(ts) FROM login_log) - INTERVAL 30 DAY"
SINCE_24H = "ts >= (SELECT max(ts) FROM login_log) - INTERVAL 24 HOUR"


@query("a01_login_kpis", f"""
SELECT count(*) AS total_logins, count(*) FILTER (status = 1) AS success_logins,
       count(*) FILTER (status = 0) AS failed_logins,
       round(count(*) FILTER (status = 1) / count(*) * 100, 2) AS success_rate,
       count(DISTINCT user_id) AS unique_users, count(DISTINCT login_ip) AS unique_ips
FROM login_log WHERE {SINCE_30}""")
def _(t):
    return logstats.login_kpis(t.login_log)


@query("a02_ip_stats", f"""
SELECT login_ip, ip_location, count(*) FILTER (status = 1) AS login_count, count(*) FILTER (status = 0) AS failed_count,
       max(ts) AS last_login_time
FROM login_log WHERE {SINCE_30} GROUP BY 1, 2 ORDER BY login_count DESC, login_ip, ip_location LIMIT 10""")
def _(t):
    return logstats.ip_stats(t.login_log)


@query("a03_device_stats", f"""
SELECT device_type, browser_type, os_type, count(*) AS login_count, max(ts) AS last_login_time
FROM login_log WHERE {SINCE_30} AND status = 1 GROUP BY 1, 2, 3""")
def _(t):
    return logstats.device_stats(t.login_log)


@query("a04_user_stats", f"""
SELECT user_id, username, count(*) FILTER (status = 1) AS total_logins, count(*) FILTER (status = 0) AS failed_logins,
       max(ts) FILTER (status = 1) AS last_login_time, max(login_ip) FILTER (status = 1) AS max_ip,
       arg_max(login_ip, ts) FILTER (status = 1) AS last_ip
FROM login_log WHERE {SINCE_30} GROUP BY 1, 2 ORDER BY total_logins DESC, user_id LIMIT 10""")
def _(t):
    return logstats.user_stats(t.login_log)


@query("a05_daily_stats", f"""
SELECT CAST(ts AS DATE) AS date, count(*) AS total_logins, count(*) FILTER (status = 1) AS success_logins,
       count(*) FILTER (status = 0) AS failed_logins, count(DISTINCT user_id) AS unique_users
FROM login_log WHERE {SINCE_30} GROUP BY 1""")
def _(t):
    return logstats.daily_stats(t.login_log)


@query("a06_suspicious_logins", f"""
SELECT username, login_ip, count(*) AS failures, max(ts) AS last_attempt
FROM login_log WHERE status = 0 AND ts >= (SELECT max(ts) FROM login_log) - INTERVAL 720 HOUR
GROUP BY 1, 2 HAVING count(*) >= 3""")
def _(t):
    return logstats.suspicious_logins(t.login_log, threshold=3, hours=720)


@query("a07_login_counts", f"""
SELECT user_id, count(*) FILTER (status = 1) AS success_count, count(*) FILTER (status = 0) AS failed_count
FROM login_log WHERE {SINCE_30} GROUP BY 1""")
def _(t):
    return logstats.login_counts(t.login_log)


@query("a08_locked_users", f"""
SELECT username, count(*) FILTER (status = 0 AND {SINCE_24H}) AS failures,
       count(*) FILTER (status = 0 AND {SINCE_24H}) >= 2 AS locked
FROM login_log GROUP BY 1""")
def _(t):
    return logstats.locked_users(t.login_log, threshold=2, hours=24)


@query("a09_login_ips", f"SELECT DISTINCT user_id, login_ip FROM login_log WHERE {SINCE_30}")
def _(t):
    return logstats.login_ips(t.login_log)


@query("a10_unread_counts", """
SELECT recipient_id, msg_type, count(*) AS unread FROM message WHERE status = 'unread' GROUP BY 1, 2
UNION ALL SELECT recipient_id, NULL, count(*) FROM message WHERE status = 'unread' GROUP BY 1""")
def _(t):
    return logstats.unread_counts(t.message)


@query("a11_scheduler_statistics", """
SELECT (SELECT count(*) FROM scheduler_job WHERE NOT is_deleted) AS total_jobs,
       (SELECT count(*) FROM scheduler_job WHERE NOT is_deleted AND status = 1) AS enabled_jobs,
       (SELECT count(*) FROM scheduler_job WHERE NOT is_deleted AND status = 0) AS disabled_jobs,
       (SELECT count(*) FROM scheduler_job WHERE NOT is_deleted AND status = 2) AS paused_jobs,
       count(*) AS total_executions, count(*) FILTER (status = 'success') AS success_executions,
       count(*) FILTER (status = 'failed') AS failed_executions,
       round(count(*) FILTER (status = 'success') / count(*) * 100, 2) AS success_rate
FROM scheduler_log""")
def _(t):
    return logstats.scheduler_statistics(t.scheduler_job, t.scheduler_log)


@query("a20_token_totals", r"""
SELECT role, count(*) AS texts, CAST(sum(len(regexp_extract_all(text, '[ \t\n\r\f]*[^ \t\n\r\f]+'))) AS BIGINT) AS tokens
FROM conversations GROUP BY 1""")
def _(t):
    return logstats.token_totals(t.conversations, "role", "text", tokens)


@query("a21_hit_ratio", """
SELECT host, CAST(sum(cpu) AS BIGINT) AS hits, CAST(sum(pid) AS BIGINT) AS reads,
       round(sum(cpu) / (sum(cpu) + sum(pid)) * 100, 2) AS hit_ratio FROM samples GROUP BY 1""")
def _(t):
    return monitor.hit_ratio(t.samples, F.col("cpu"), F.col("pid"), ["host"])


@query("a22_largest_tables", """
SELECT kb_id, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes FROM kb_file GROUP BY 1 ORDER BY bytes DESC, kb_id LIMIT 20""")
def _(t):
    sizes = t.kb_file.groupBy("kb_id").agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"))
    return monitor.largest(sizes, "bytes", "kb_id")


@query("a23_categories", "SELECT DISTINCT category FROM page_def WHERE category IS NOT NULL AND category <> ''")
def _(t):
    return t.page_def.where(F.col("category") != "").select("category").distinct()


@query("a24_process_summary", """
SELECT count(*) AS total_processes, count(*) FILTER (host = 'view') AS running_processes,
       count(*) FILTER (host = 'click') AS sleeping_processes, count(*) FILTER (cpu > 1 OR counter > 1) AS busy
FROM samples""")
def _(t):
    state = F.when(F.col("host") == "view", "running").when(F.col("host") == "click", "sleeping")
    return monitor.process_summary(t.samples.withColumn("state", state), "cpu", "counter", "state")


@query("a24_top_processes", """
SELECT id AS pid, round(CAST(cpu AS DOUBLE), 2) AS cpu, round(counter, 2) AS mem FROM samples
WHERE cpu > 1 OR counter > 1 ORDER BY cpu DESC, pid LIMIT 20""")
def _(t):
    return monitor.top_processes(t.samples.withColumn("cpu", F.col("cpu").cast("double")), "id", "cpu", "counter")


@query("a25_fold_executions", """
SELECT code, count(l.id) AS total_run_count, count(*) FILTER (l.status = 'success') AS success_count,
       count(*) FILTER (l.status = 'failed') AS failure_count, max(start_time) AS last_run_time,
       arg_max(l.status, latest) AS last_run_status, arg_max(result, latest) AS last_run_result
FROM scheduler_job j LEFT JOIN (SELECT *, epoch(start_time) * 100000000 + id AS latest FROM scheduler_log) l ON j.code = l.job_code
GROUP BY 1""")
def _(t):
    return logstats.fold_executions(t.scheduler_job, t.scheduler_log)


@query("a26_accuracy", """
SELECT count(quality) AS judged, CAST(sum(quality) AS BIGINT) AS accepted, round(avg(quality), 6) AS accuracy FROM labels""")
def _(t):
    return logstats.accuracy(t.labels)


@query("a27_percent_rings", """
SELECT p_partkey, p_size, p_retailprice, round(p_size / coalesce(nullif(p_retailprice, 0), 100) * 100, 4) AS percent FROM part""")
def _(t):
    return monitor.percent_rings(t.part.select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice")


@query("a28_keyspace_summary", """
SELECT CAST(sum(n) AS BIGINT) AS total_keys, CAST(sum(x) AS BIGINT) AS total_expires, CAST(round(avg(ttl)) AS BIGINT) AS avg_ttl,
       CASE WHEN sum(x) / sum(n) * 100 >= 80 THEN 'success' WHEN sum(x) / sum(n) * 100 >= 50 THEN 'warning'
            WHEN sum(x) / sum(n) * 100 >= 20 THEN 'info' ELSE 'danger' END AS bucket
FROM (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS x, max(o_totalprice) AS ttl FROM orders GROUP BY 1)""")
def _(t):
    spaces = t.orders.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("o_orderstatus") == "F").alias("x"),
        F.max("o_totalprice").alias("ttl"),
    )
    return monitor.keyspace_summary(spaces, "n", "x", "ttl")


@query("a29_slow_log_summary", """
SELECT count(*) AS entries, round(avg(o_totalprice), 4) AS avg_duration, max(o_totalprice) AS max_duration FROM orders""")
def _(t):
    return monitor.slow_log_summary(t.orders, "o_totalprice")


@query("a29_slow_log_severity", """
SELECT o_orderkey, o_totalprice, round(o_totalprice / (SELECT max(o_totalprice) FROM orders) * 100, 4) AS share,
       CASE WHEN o_totalprice >= 1000000 THEN 'danger' WHEN o_totalprice >= 100000 THEN 'warning'
            WHEN o_totalprice >= 10000 THEN 'info' ELSE 'success' END AS severity FROM orders""")
def _(t):
    return monitor.slow_log_severity(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("a30_table_totals", """
SELECT count(*) AS tables, CAST(sum(files) AS BIGINT) AS total_rows, CAST(sum(bytes) AS BIGINT) AS total_bytes
FROM (SELECT kb_id, count(*) AS files, sum(file_size) AS bytes FROM kb_file GROUP BY 1)""")
def _(t):
    sizes = t.kb_file.groupBy("kb_id").agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"))
    return monitor.table_totals(sizes, "files", "bytes")


# ---- windows, order, pages

@query("w01_last_login", """
SELECT user_id, id, ts, login_ip, device_type FROM login_log WHERE status = 1
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) = 1""")
def _(t):
    return logstats.last_login(t.login_log)


@query("w02_moving_averages", """
SELECT l_partkey, l_orderkey, l_linenumber, cents,
       CASE WHEN count(*) OVER w = 5 THEN round(sum(cents) OVER w / 5, 2) END AS ma5,
       CASE WHEN count(*) OVER v = 10 THEN round(sum(cents) OVER v / 10, 2) END AS ma10
FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)
WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, cents ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
       v AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, cents ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def _(t):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents")
    bars = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", cents)
    return monitor.moving_averages(
        bars, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "cents"], "cents"
    ).drop("l_shipdate", "l_suppkey")


@query("w03_ranking", """
SELECT row_number() OVER (ORDER BY v DESC, c_name) AS rank, c_name AS name, v AS value,
       CASE WHEN v >= 10000 THEN printf('%.1f', v / 10000) || '万' ELSE printf('%.0f', v) END AS display
FROM (SELECT c_name, round(sum(o_totalprice), 2) AS v FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name)""")
def _(t):
    spent = (
        t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"))
        .groupBy("c_custkey", "c_name")
        .agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    )
    return monitor.ranking(spent, "c_name", "spent")


@query("w04_counter_rates", """
SELECT id, host, ts, counter, coalesce(CASE WHEN d > 0 THEN greatest(0, round((counter - p) / d, 6)) ELSE 0 END, 0) AS rate
FROM (SELECT id, host, ts, counter, lag(counter) OVER w AS p, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS d
      FROM samples WINDOW w AS (PARTITION BY host ORDER BY ts, id))""")
def _(t):
    rates = monitor.counter_rates(t.samples.select("id", "host", "ts", "counter"), "host", "ts", "counter", "id")
    return rates.withColumn("rate", F.round("rate", 6))


@query("w05_page", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40""")
def _(t):
    return page(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 3)


@query("w05_page_total", "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    return filters.filter_by(t.orders, equals={"o_orderstatus": "F"}).agg(F.count(F.lit(1)).alias("total"))


@query("w05_number_pages", """
SELECT o_orderkey, position, CAST(floor((position - 1) / 20) + 1 AS BIGINT) AS page
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders)""")
def _(t):
    pages = number_pages(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"])
    return pages.drop("o_totalprice")


@query("w06_logs_of_user", f"""
SELECT id, ts, username, login_ip, status FROM login_log WHERE user_id = 7 AND {SINCE_30} ORDER BY ts DESC, id DESC LIMIT 20""")
def _(t):
    mine = filters.filter_by(filters.since(t.login_log, "ts", days=30), equals={"user_id": 7})
    return page(mine.select("id", "ts", "username", "login_ip", "status"), [F.desc("ts"), F.desc("id")])


@query("w06_logs_of_ip", f"""
SELECT id, ts, username, status FROM login_log WHERE login_ip = '10.0.0.3' AND {SINCE_30} ORDER BY ts DESC, id DESC LIMIT 20 OFFSET 20""")
def _(t):
    mine = filters.filter_by(filters.since(t.login_log, "ts", days=30), equals={"login_ip": "10.0.0.3"})
    return page(mine.select("id", "ts", "username", "status"), [F.desc("ts"), F.desc("id")], 2)


@query("w07_announcement_order", """
SELECT id, is_top, priority, publish_time FROM announcement ORDER BY is_top DESC, priority DESC, publish_time DESC NULLS LAST, id LIMIT 50""")
def _(t):
    return top(
        t.announcement.select("id", "is_top", "priority", "publish_time"),
        [F.desc("is_top"), F.desc("priority"), F.desc_nulls_last("publish_time"), "id"],
        50,
    )


@query("w08_graph_edge_page", "SELECT seq, src, relation, dst FROM kg_edges ORDER BY seq LIMIT 20 OFFSET 20")
def _(t):
    return page(t.kg_edges, ["seq"], 2)


@query("w09_conversation_messages", "SELECT conv_id, turn, role, text FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", "role", "text").orderBy("conv_id", "turn")


@query("w10_user_conversations", """
SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY 1 ORDER BY last_turn DESC, conv_id LIMIT 20""")
def _(t):
    talks = t.conversations.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("messages"), F.max("turn").alias("last_turn")
    )
    return page(talks, [F.desc("last_turn"), "conv_id"])


@query("w11_job_executions", """
SELECT id, job_code, status, start_time, duration FROM scheduler_log WHERE job_id = 11 ORDER BY start_time DESC, id DESC LIMIT 20""")
def _(t):
    runs = filters.filter_by(t.scheduler_log, equals={"job_id": 11})
    return page(runs.drop("job_id", "result"), [F.desc("start_time"), F.desc("id")])


@query("w12_inbox", """
SELECT id, recipient_id, msg_type, status, created FROM message
WHERE msg_type = '1-URGENT' AND status = 'unread' ORDER BY created DESC, id DESC LIMIT 20""")
def _(t):
    inbox = filters.filter_by(t.message, equals={"msg_type": "1-URGENT", "status": "unread"})
    return page(inbox.drop("amount"), [F.desc("created"), F.desc("id")])


@query("w13_first_per_key", """
SELECT event_id, ts, user_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""")
def _(t):
    return first_per_key(
        t.events.select("event_id", "ts", "user_id", "event_type"), ["user_id", "event_type"], ["event_id"]
    )


@query("w14_key_search", r"""
SELECT id, path, size FROM file_item WHERE regexp_matches(path, '^/e./src1.*\.txt$') AND type = 'file' ORDER BY path LIMIT 20""")
def _(t):
    found = monitor.key_search(t.file_item, "/e?/src1*.txt", "path", "file")
    return page(found.select("id", "path", "size"), ["path"])


@query("w15_latest_entries", "SELECT id, start_time, duration FROM scheduler_log ORDER BY start_time DESC, id DESC LIMIT 10")
def _(t):
    return top(t.scheduler_log.select("id", "start_time", "duration"), [F.desc("start_time"), F.desc("id")], 10)


@query("w16_rolling_history", """
SELECT id, host, cents, avg(cents) OVER w AS mean_value, max(cents) OVER w AS max_value
FROM (SELECT *, CAST(round(counter * 100) AS BIGINT) AS cents FROM samples) WINDOW w AS (PARTITION BY host ORDER BY ts, id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def _(t):
    cents = F.round(F.col("counter") * 100).cast("long").alias("cents")
    return monitor.rolling_history(t.samples.select("id", "host", "ts", cents), "host", ["ts", "id"], "cents").drop("ts")

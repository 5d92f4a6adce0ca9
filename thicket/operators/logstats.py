"""Statistics over login and execution logs.

Every statistic is one hash aggregate with map-side combine; look-backs become a filter on the
time column that reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.operators.filters import since


def succeeded() -> Column:
    return F.col("status") == 1


def failed() -> Column:
    return F.col("status") == 0


# Labels of login states and failure reasons.
STATUS_LABELS = {0: "失败", 1: "成功"}
FAILURE_LABELS = {
    0: "未知错误",
    1: "用户不存在",
    2: "密码错误",
    3: "用户已禁用",
    4: "用户已锁定",
    5: "用户不激活",
    6: "账户异常",
    7: "其他错误",
}
UNKNOWN_LABEL = "未知"


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Rounded percentage, 0 when there is nothing to divide by."""
    return F.when(whole > 0, F.round(part / whole * 100, digits)).otherwise(F.lit(0.0))


def login_kpis(log: DataFrame, days: int = 30, as_of=None) -> DataFrame:
    counts = since(log, "ts", as_of, days=days).agg(
        F.count(F.lit(1)).alias("total_logins"),
        F.count_if(succeeded()).alias("success_logins"),
        F.countDistinct("user_id").alias("unique_users"),
        F.countDistinct("login_ip").alias("unique_ips"),
    )
    return counts.select(
        "total_logins",
        "success_logins",
        (F.col("total_logins") - F.col("success_logins")).alias("failed_logins"),
        percent(F.col("success_logins"), F.col("total_logins")).alias("success_rate"),
        "unique_users",
        "unique_ips",
    )


def ip_stats(log: DataFrame, days: int = 30, limit: int = 10, as_of=None) -> DataFrame:
    return (
        since(log, "ts", as_of, days=days)
        .groupBy("login_ip", "ip_location")
        .agg(
            F.count_if(succeeded()).alias("login_count"),
            F.count_if(failed()).alias("failed_count"),
            F.max("ts").alias("last_login_time"),
        )
        .orderBy(F.desc("login_count"), "login_ip", "ip_location")
        .limit(limit)
    )


def device_stats(log: DataFrame, days: int = 30, as_of=None) -> DataFrame:
    return (
        since(log, "ts", as_of, days=days)
        .where(succeeded())
        .groupBy("device_type", "browser_type", "os_type")
        .agg(F.count(F.lit(1)).alias("login_count"), F.max("ts").alias("last_login_time"))
        .orderBy(F.desc("login_count"))
    )


def user_stats(log: DataFrame, days: int = 30, limit: int = 10, as_of=None) -> DataFrame:
    """``max_ip`` is the largest address among successes; ``last_ip`` is that of the latest one."""
    return (
        since(log, "ts", as_of, days=days)
        .groupBy("user_id", "username")
        .agg(
            F.count_if(succeeded()).alias("total_logins"),
            F.count_if(failed()).alias("failed_logins"),
            F.max(F.when(succeeded(), F.col("ts"))).alias("last_login_time"),
            F.max(F.when(succeeded(), F.col("login_ip"))).alias("max_ip"),
            F.max_by("login_ip", F.when(succeeded(), F.struct("ts", "id"))).alias("last_ip"),
        )
        .orderBy(F.desc("total_logins"), "user_id", "username")
        .limit(limit)
    )


def daily_stats(log: DataFrame, days: int = 30, as_of=None) -> DataFrame:
    return (
        since(log, "ts", as_of, days=days)
        .groupBy(F.to_date("ts").alias("date"))
        .agg(
            F.count(F.lit(1)).alias("total_logins"),
            F.count_if(succeeded()).alias("success_logins"),
            F.count_if(failed()).alias("failed_logins"),
            F.countDistinct("user_id").alias("unique_users"),
        )
        .orderBy("date")
    )


def suspicious_logins(log: DataFrame, threshold: int = 5, hours: int = 1, as_of=None) -> DataFrame:
    return (
        since(log, "ts", as_of, hours=hours)
        .where(failed())
        .groupBy("username", "login_ip")
        .agg(F.count(F.lit(1)).alias("failures"), F.max("ts").alias("last_attempt"))
        .where(F.col("failures") >= threshold)
    )


def login_counts(log: DataFrame, days: int = 30, as_of=None) -> DataFrame:
    return (
        since(log, "ts", as_of, days=days)
        .groupBy("user_id")
        .agg(F.count_if(succeeded()).alias("success_count"), F.count_if(failed()).alias("failed_count"))
    )


def locked_users(log: DataFrame, threshold: int = 5, hours: int = 1, as_of=None) -> DataFrame:
    """Lock decision for every user seen in the log, not only those with failures."""
    recent = since(log, "ts", as_of, hours=hours).where(failed()).select("username", F.lit(1).alias("_f"))
    everyone = log.select("username", F.lit(0).alias("_f"))
    return (
        everyone.unionByName(recent)
        .groupBy("username")
        .agg(F.sum("_f").alias("failures"))
        .select("username", "failures", (F.col("failures") >= threshold).alias("locked"))
    )


def login_ips(log: DataFrame, days: int = 30, as_of=None) -> DataFrame:
    return since(log, "ts", as_of, days=days).select("user_id", "login_ip").distinct()


def last_login(log: DataFrame) -> DataFrame:
    """Latest success per user; ``max_by`` combines on the map side, no per-user sort."""
    return (
        log.where(succeeded())
        .groupBy("user_id")
        .agg(F.max_by(F.struct("id", "ts", "login_ip", "device_type"), F.struct("ts", "id")).alias("r"))
        .select("user_id", "r.*")
    )


def scheduler_statistics(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Jobs and executions in one row; the two partial counts are added, not joined."""
    job_part = jobs.where(~F.col("is_deleted")).select(
        F.lit("job").alias("kind"), F.col("status").cast("string").alias("state")
    )
    run_part = runs.select(F.lit("run").alias("kind"), F.col("status").alias("state"))
    is_job, is_run, state = F.col("kind") == "job", F.col("kind") == "run", F.col("state")
    counts = job_part.unionByName(run_part).agg(
        F.count_if(is_job).alias("total_jobs"),
        F.count_if(is_job & (state == "1")).alias("enabled_jobs"),
        F.count_if(is_job & (state == "0")).alias("disabled_jobs"),
        F.count_if(is_job & (state == "2")).alias("paused_jobs"),
        F.count_if(is_run).alias("total_executions"),
        F.count_if(is_run & (state == "success")).alias("success_executions"),
        F.count_if(is_run & (state == "failed")).alias("failed_executions"),
    )
    return counts.withColumn(
        "success_rate", percent(F.col("success_executions"), F.col("total_executions"))
    )


def fold_executions(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Run counters and last outcome of every job, zero for jobs that never ran."""
    folded = runs.groupBy("job_code").agg(
        F.count(F.lit(1)).alias("total_run_count"),
        F.count_if(F.col("status") == "success").alias("success_count"),
        F.count_if(F.col("status") == "failed").alias("failure_count"),
        F.max_by(
            F.struct("start_time", "status", "result"), F.struct("start_time", "id")
        ).alias("last"),
    )
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return jobs.select("code").join(folded, F.col("code") == F.col("job_code"), "left").select(
        "code",
        count("total_run_count"),
        count("success_count"),
        count("failure_count"),
        F.col("last.start_time").alias("last_run_time"),
        F.col("last.status").alias("last_run_status"),
        F.col("last.result").alias("last_run_result"),
    )


def unread_counts(messages: DataFrame) -> DataFrame:
    """Unread messages per recipient and type, with the recipient's total on a null type row."""
    unread = messages.where(F.col("status") == "unread")
    return unread.rollup("recipient_id", "msg_type").agg(F.count(F.lit(1)).alias("unread")).where(
        F.col("recipient_id").isNotNull()
    )


def accuracy(verdicts: DataFrame, column: str = "quality") -> DataFrame:
    """Share of accepted answers in a table of 0/1 verdicts."""
    return verdicts.agg(
        F.count(column).alias("judged"),
        F.sum(F.col(column).cast("long")).alias("accepted"),
        F.round(F.avg(F.col(column).cast("int")), 6).alias("accuracy"),
    )


def token_totals(texts: DataFrame, key: str, column: str, tokens) -> DataFrame:
    """Sum of tokens per key; ``tokens`` turns a text column into an array of tokens."""
    return texts.groupBy(key).agg(
        F.count(F.lit(1)).alias("texts"), F.sum(F.size(tokens(F.col(column)))).alias("tokens")
    )

"""Per-user request quotas over the usage log.

The usage log is an append-only fact table; plans are a dimension of a
handful of rows (broadcast), users a dimension that grows with sign-ups
(left to AQE).  Aggregations are partial before the shuffle, so a user
holding a third of all requests does not create a hot reducer:

* ``quota_admission`` ranks inside (user, day, minute) and adds the counts of
  the earlier minutes (at most 1440 rows per user and day), so a user-day of
  any size is ranked in pieces and any day limit is exact;
* ``minute_usage`` partitions by (user, minute bucket) instead of user, and
  counts the part of the trailing minute that lies in the previous bucket
  with probe rows, so each window partition holds at most two minutes of one
  user's requests.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import encode as E

PREDICT_ENDPOINT = "POST /predict"
MINUTE_US = 60_000_000


def plans_frame(spark: SparkSession, plans: Sequence[tuple] = tuple(C.PLANS)) -> DataFrame:
    """S5 rows: (plan_id, plan_name, limit_per_minute, limit_per_day, monthly_price)."""
    return spark.createDataFrame(
        [(int(p[0]), p[1], int(p[2]), int(p[3]), float(p[4])) for p in plans],
        "plan_id int, plan_name string, limit_per_minute int, limit_per_day int, monthly_price double")


def predict_rows(usage: DataFrame) -> DataFrame:
    """The stored log holds ``POST /predict*`` rows with a known user."""
    return usage.where(F.col("endpoint").startswith(PREDICT_ENDPOINT) & F.col("user_id").isNotNull())


def plan_limits(users: DataFrame, db_plans: DataFrame, static_plans: DataFrame,
                default_plan_id: int = C.DEFAULT_PLAN_ID) -> DataFrame:
    """minute/day limits per user: stored plan -> static table -> default plan.

    Both plan tables are a handful of rows: broadcast left joins, then
    ``coalesce`` picks the first level that knows the plan.
    """
    db = db_plans.select(F.col("plan_id").alias("_db_id"), F.col("limit_per_minute").alias("_db_min"),
                         F.col("limit_per_day").alias("_db_day"))
    st = static_plans.select(F.col("plan_id").alias("_st_id"), F.col("limit_per_minute").alias("_st_min"),
                             F.col("limit_per_day").alias("_st_day"))
    dflt = static_plans.where(F.col("plan_id") == default_plan_id).select(
        F.col("limit_per_minute").alias("_df_min"), F.col("limit_per_day").alias("_df_day"))
    out = (users.join(F.broadcast(db), users.subscription_plan_id == db._db_id, "left")
                .join(F.broadcast(st), users.subscription_plan_id == st._st_id, "left")
                .crossJoin(F.broadcast(dflt)))  # one row
    source = (F.when(F.col("_db_id").isNotNull(), "db")
               .when(F.col("_st_id").isNotNull(), "static").otherwise("default"))
    return out.select(*users.columns,
                      F.coalesce("_db_min", "_st_min", "_df_min").alias("limit_per_minute"),
                      F.coalesce("_db_day", "_st_day", "_df_day").alias("limit_per_day"),
                      source.alias("limit_source"))


def users_from_log(usage: DataFrame) -> DataFrame:
    """User dimension as seen by the log: one row per (user, plan)."""
    return usage.select("user_id", "subscription_plan_id").distinct()


def _as_of(as_of: str) -> Column:
    return F.to_timestamp(F.lit(as_of))


def quota_status(usage: DataFrame, limits: DataFrame, as_of: str) -> DataFrame:
    """U1 (+A21, J3): limits, usage since midnight and in the last minute,
    remaining (never negative; minute limit 0 once the day is used up),
    can-predict flag and percent of the day used, as of ``as_of``.

    Usage bounds are inclusive (``>=``) and nothing after ``as_of`` counts.
    """
    t = _as_of(as_of)
    midnight = F.date_trunc("day", t)
    minute_ago = t - F.expr("INTERVAL 1 MINUTE")
    ts = F.col("request_timestamp")
    today = predict_rows(usage).where((ts >= midnight) & (ts <= t))
    counts = today.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("usage_day"),
        F.count_if(ts >= minute_ago).alias("usage_minute"))
    out = limits.join(counts, "user_id", "left")
    day = F.coalesce("usage_day", F.lit(0)).cast("bigint")
    minute = F.coalesce("usage_minute", F.lit(0)).cast("bigint")
    minute_limit = F.when(day >= F.col("limit_per_day"), F.lit(0)).otherwise(F.col("limit_per_minute"))
    rem_min = F.greatest(F.lit(0), minute_limit - minute).cast("bigint")
    rem_day = F.greatest(F.lit(0), F.col("limit_per_day") - day).cast("bigint")
    return out.select(
        "user_id", "subscription_plan_id",
        minute_limit.cast("int").alias("limit_per_minute"), F.col("limit_per_day").cast("int").alias("limit_per_day"),
        minute.alias("usage_minute"), day.alias("usage_day"),
        rem_min.alias("remaining_minute"), rem_day.alias("remaining_day"),
        ((rem_min > 0) & (rem_day > 0)).alias("can_predict"),
        F.round(day / F.col("limit_per_day") * 100, 6).alias("pct_day_used"))


def quota_response(status: DataFrame) -> DataFrame:
    """U1 response shape: nested limits / current_usage / remaining."""
    return status.select(
        "user_id", "subscription_plan_id",
        F.struct(F.col("limit_per_minute").alias("per_minute"), F.col("limit_per_day").alias("per_day")).alias("limits"),
        F.struct(F.col("usage_minute").alias("minute"), F.col("usage_day").alias("day")).alias("current_usage"),
        F.struct(F.col("remaining_minute").alias("minute"), F.col("remaining_day").alias("day")).alias("remaining"))


def quota_admission(usage: DataFrame, limits: DataFrame) -> DataFrame:
    """Replay the day limit over the log.

    A request is admitted when fewer than ``limit_per_day`` requests of the
    same user and day precede it (ordered by time, then id).  Rejected calls
    are logged too, so every row counts.  The rank of a request in its day is
    its rank in its minute plus the counts of the day's earlier minutes.
    """
    minute = F.floor(F.unix_micros("request_timestamp") / MINUTE_US)
    rows = predict_rows(usage).withColumns({"_day": F.to_date("request_timestamp"), "_minute": minute})
    counts = rows.groupBy("user_id", "_day", "_minute").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("user_id", "_day").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("user_id", "_day", "_minute",
                            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("user_id", "_day", "_minute").orderBy("request_timestamp", "id")
    ranked = (rows.join(offsets, ["user_id", "_day", "_minute"])
                  .withColumn("_prior", F.col("_before") + F.row_number().over(within) - 1))
    out = ranked.join(limits.select("user_id", "limit_per_day"), "user_id", "left")
    admitted = F.coalesce(F.col("_prior") < F.col("limit_per_day"), F.lit(False))
    return out.select("id", "user_id", "request_timestamp", "limit_per_day",
                      admitted.alias("admitted"),
                      F.when(admitted, F.col("status_code")).otherwise(F.lit(429)).alias("status_code"))


def minute_windows(usage: DataFrame) -> DataFrame:
    """Fixed one-minute windows per user (the limiter's fixed-window
    strategy), counted with a partial aggregation."""
    rows = predict_rows(usage)
    return (rows.groupBy("user_id", F.window("request_timestamp", "1 minute").alias("w"))
                .agg(F.count(F.lit(1)).alias("requests"))
                .select("user_id", F.col("w.start").alias("window_start"),
                        F.col("w.end").alias("window_end"), "requests"))


def minute_usage(usage: DataFrame) -> DataFrame:
    """For every request, the user's requests in ``[ts - 60 s, ts]``.

    Each request lies in minute bucket ``b``; its trailing minute covers the
    requests of bucket ``b`` up to ``ts`` and those of bucket ``b - 1`` from
    ``ts - 60 s`` on.  A probe row at ``ts - 60 s`` is added to bucket
    ``b - 1``; one running count per (user, bucket) then answers both parts.
    """
    rows = predict_rows(usage).select("id", "user_id", "request_timestamp",
                                      F.unix_micros("request_timestamp").alias("_t"))
    real = rows.select("id", "user_id", "_t", F.lit(1).alias("_real"))
    probe = rows.select("id", "user_id", (F.col("_t") - MINUTE_US).alias("_t"), F.lit(0).alias("_real"))
    both = real.unionByName(probe).withColumn("_b", F.floor(F.col("_t") / MINUTE_US))
    part = Window.partitionBy("user_id", "_b")
    upto = part.orderBy("_t", "_real").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = both.select(
        "id", "_real",
        F.sum("_real").over(upto).alias("_upto"),
        F.sum("_real").over(part).alias("_all"))
    # real row: requests of its bucket with t' <= t; probe row: requests of
    # the previous bucket with t' >= t - 60 s
    contrib = F.when(F.col("_real") == 1, F.col("_upto")).otherwise(F.col("_all") - F.col("_upto"))
    per_id = counted.groupBy("id").agg(F.sum(contrib).alias("requests_last_minute"))
    return rows.join(per_id, "id").select("id", "user_id", "request_timestamp", "requests_last_minute")


# ---- U7 / S12: usage record shaping -------------------------------------------

def usage_records(requests: DataFrame) -> DataFrame:
    """Shape handled requests into usage rows.

    Input columns: ``user_id, method, path, status_code, started_at,
    elapsed_s, forwarded_for, client_host, predicted_price, is_cached``.
    Only ``POST /predict*`` with a known user is kept, whatever the status.
    """
    kept = requests.where((F.col("method") == "POST") & F.col("path").startswith("/predict")
                          & F.col("user_id").isNotNull())
    return kept.select(
        "user_id",
        F.col("started_at").alias("request_timestamp"),
        F.concat_ws(" ", "method", "path").alias("endpoint"),
        "status_code",
        E.first_forwarded_ip("forwarded_for", "client_host").alias("ip_address"),
        (F.col("elapsed_s") * 1000).alias("response_time_ms"),
        F.col("predicted_price").cast("decimal(12,2)").alias("predicted_price"),
        F.coalesce(F.col("is_cached"), F.lit(False)).alias("is_cached"))


def append_log(batch: DataFrame, path: str, batch_id: str | int) -> None:
    """Append one batch of usage rows to the log in ``path``.

    A batch owns a folder named by its id and overwrites it, and Spark commits
    a folder only when all its tasks have ended: a batch that is replayed after
    a failure, or a task that ran twice, adds no row twice."""
    batch.write.mode("overwrite").parquet(f"{path}/_batch={batch_id}")


def read_log(spark, path: str) -> DataFrame:
    """All appended batches of the log."""
    return spark.read.parquet(path).drop("_batch")

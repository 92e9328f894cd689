"""Registered usage/quota queries (J1, J3, U1-U3, U7, W3, W4) and oracles.

Test limits are small (minute 1, day 2/3/5) so every branch fires on the
fixture: plans 1-2 come from the stored plan table, plan 3 only from the
static table, plan 4 from neither (falls back to the default plan).
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import functions as F

from ..operators import usage as U
from ..session import shared_path
from .common import AS_OF, usage
from .oracle import with_usage
from .registry import register

# ---- fixed test values: stored plans and the static fallback table ----------
DB_PLANS = [(1, "Free", 1, 2, 0.0), (2, "Basic", 1, 3, 9.99)]
STATIC_PLANS = [(1, "Free", 1, 2, 0.0), (2, "Basic", 1, 3, 9.99), (3, "Premium", 1, 5, 19.99)]


def _values(plans) -> str:
    return ", ".join(f"({p[0]}, '{p[1]}', {p[2]}, {p[3]}, {p[4]})" for p in plans)


LIMITS_CTE = f"""
db AS (SELECT * FROM (VALUES {_values(DB_PLANS)}) AS t(plan_id, plan_name, limit_per_minute, limit_per_day, monthly_price)),
st AS (SELECT * FROM (VALUES {_values(STATIC_PLANS)}) AS t(plan_id, plan_name, limit_per_minute, limit_per_day, monthly_price)),
users AS (SELECT DISTINCT user_id, subscription_plan_id FROM usage_log),
lim AS (SELECT u.user_id, u.subscription_plan_id,
               coalesce(db.limit_per_minute, st.limit_per_minute, (SELECT limit_per_minute FROM st WHERE plan_id = 1)) AS limit_per_minute,
               coalesce(db.limit_per_day, st.limit_per_day, (SELECT limit_per_day FROM st WHERE plan_id = 1)) AS limit_per_day,
               CASE WHEN db.plan_id IS NOT NULL THEN 'db' WHEN st.plan_id IS NOT NULL THEN 'static' ELSE 'default' END AS limit_source
        FROM users u LEFT JOIN db ON u.subscription_plan_id = db.plan_id
                     LEFT JOIN st ON u.subscription_plan_id = st.plan_id),
pred AS (SELECT * FROM usage_log WHERE starts_with(endpoint, 'POST /predict') AND user_id IS NOT NULL)"""


def _limits(spark, sf):
    log = usage(spark, sf)
    return U.plan_limits(U.users_from_log(log), U.plans_frame(spark, DB_PLANS),
                         U.plans_frame(spark, STATIC_PLANS))


@register("plan_limits", with_usage(f"WITH {LIMITS_CTE}\nSELECT * FROM lim"))
def q_plan_limits(spark, sf):
    return _limits(spark, sf)


@register("quota_status", with_usage(f"""WITH {LIMITS_CTE},
c AS (SELECT user_id, count(*) AS usage_day,
             count(*) FILTER (WHERE request_timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 1 MINUTE) AS usage_minute
      FROM pred WHERE request_timestamp >= date_trunc('day', TIMESTAMP '{AS_OF}')
                  AND request_timestamp <= TIMESTAMP '{AS_OF}' GROUP BY user_id),
j AS (SELECT lim.*, CAST(coalesce(c.usage_day, 0) AS BIGINT) AS d, CAST(coalesce(c.usage_minute, 0) AS BIGINT) AS m
      FROM lim LEFT JOIN c ON lim.user_id = c.user_id),
k AS (SELECT *, CASE WHEN d >= limit_per_day THEN 0 ELSE limit_per_minute END AS ml FROM j)
SELECT user_id, subscription_plan_id, CAST(ml AS INT) AS limit_per_minute, CAST(limit_per_day AS INT) AS limit_per_day,
       m AS usage_minute, d AS usage_day, CAST(greatest(0, ml - m) AS BIGINT) AS remaining_minute,
       CAST(greatest(0, limit_per_day - d) AS BIGINT) AS remaining_day,
       greatest(0, ml - m) > 0 AND greatest(0, limit_per_day - d) > 0 AS can_predict,
       round(d / limit_per_day * 100, 6) AS pct_day_used
FROM k"""))
def q_quota_status(spark, sf):
    return U.quota_status(usage(spark, sf), _limits(spark, sf), AS_OF)


@register("quota_response", with_usage(f"""WITH {LIMITS_CTE},
c AS (SELECT user_id, count(*) AS usage_day,
             count(*) FILTER (WHERE request_timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 1 MINUTE) AS usage_minute
      FROM pred WHERE request_timestamp >= date_trunc('day', TIMESTAMP '{AS_OF}')
                  AND request_timestamp <= TIMESTAMP '{AS_OF}' GROUP BY user_id),
j AS (SELECT lim.*, CAST(coalesce(c.usage_day, 0) AS BIGINT) AS d, CAST(coalesce(c.usage_minute, 0) AS BIGINT) AS m
      FROM lim LEFT JOIN c ON lim.user_id = c.user_id),
k AS (SELECT *, CASE WHEN d >= limit_per_day THEN 0 ELSE limit_per_minute END AS ml FROM j)
SELECT user_id, subscription_plan_id,
       '{{"limits":{{"per_minute":' || ml || ',"per_day":' || limit_per_day || '}},"current_usage":{{"minute":' || m
       || ',"day":' || d || '}},"remaining":{{"minute":' || greatest(0, ml - m) || ',"day":'
       || greatest(0, limit_per_day - d) || '}}}}' AS response
FROM k"""))
def q_quota_response(spark, sf):
    """U1 response shape: the nested record as JSON text."""
    nested = U.quota_response(U.quota_status(usage(spark, sf), _limits(spark, sf), AS_OF))
    return nested.select("user_id", "subscription_plan_id",
                         F.to_json(F.struct("limits", "current_usage", "remaining")).alias("response"))


@register("quota_admission", with_usage(f"""WITH {LIMITS_CTE},
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(request_timestamp AS DATE)
                                   ORDER BY request_timestamp, id) AS rn FROM pred)
SELECT r.id, r.user_id, r.request_timestamp, lim.limit_per_day,
       coalesce(r.rn - 1 < lim.limit_per_day, false) AS admitted,
       CASE WHEN coalesce(r.rn - 1 < lim.limit_per_day, false) THEN r.status_code ELSE 429 END AS status_code
FROM r LEFT JOIN lim ON r.user_id = lim.user_id"""))
def q_quota_admission(spark, sf):
    return U.quota_admission(usage(spark, sf), _limits(spark, sf))


@register("minute_windows", with_usage("""
SELECT user_id, time_bucket(INTERVAL 1 MINUTE, request_timestamp) AS window_start,
       time_bucket(INTERVAL 1 MINUTE, request_timestamp) + INTERVAL 1 MINUTE AS window_end,
       count(*) AS requests
FROM usage_log WHERE starts_with(endpoint, 'POST /predict') AND user_id IS NOT NULL
GROUP BY 1, 2, 3"""))
def q_minute_windows(spark, sf):
    return U.minute_windows(usage(spark, sf))


@register("minute_usage", with_usage("""
SELECT id, user_id, request_timestamp,
       count(*) OVER (PARTITION BY user_id ORDER BY request_timestamp
                      RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS requests_last_minute
FROM usage_log WHERE starts_with(endpoint, 'POST /predict') AND user_id IS NOT NULL"""))
def q_minute_usage(spark, sf):
    return U.minute_usage(usage(spark, sf))


def handled_requests(spark, sf):
    """Handled HTTP requests as the middleware sees them, derived from events:
    method/path from the event type, a forwarded-for header on some calls."""
    from ..sources.tables import read_table
    ev = read_table(spark, sf, "events")
    is_view = F.col("event_type") == "view"
    return ev.select(
        F.col("user_id"),
        F.when(is_view, "GET").otherwise("POST").alias("method"),
        F.when(is_view, "/cached-predictions").otherwise("/predict").alias("path"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        F.col("ts").cast("timestamp").alias("started_at"),
        (F.col("value") / 1000).alias("elapsed_s"),
        F.when(F.col("event_id") % 3 == 0,
               F.concat(F.lit(" 10.1.0."), (F.col("user_id") % 250).cast("string"), F.lit(", 172.16.0.1")))
         .alias("forwarded_for"),
        F.concat(F.lit("192.168.0."), (F.col("user_id") % 250).cast("string")).alias("client_host"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("double"))
         .otherwise(F.round(F.col("value") * 100, 2)).alias("predicted_price"),
        (F.col("event_type") == "click").alias("is_cached"))


@register("usage_append", """
SELECT user_id, CAST(ts AS TIMESTAMP) AS request_timestamp, 'POST /predict' AS endpoint,
       CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
       CASE WHEN event_id % 3 = 0 THEN trim(split_part(' 10.1.0.' || CAST(user_id % 250 AS VARCHAR) || ', 172.16.0.1', ',', 1))
            ELSE '192.168.0.' || CAST(user_id % 250 AS VARCHAR) END AS ip_address,
       value / 1000 * 1000 AS response_time_ms,
       CAST(CASE WHEN event_type = 'error' THEN NULL ELSE round(value * 100, 2) END AS DOUBLE) AS predicted_price,
       event_type = 'click' AS is_cached
FROM events WHERE event_type <> 'view' AND user_id IS NOT NULL""")
def q_usage_append(spark, sf):
    """Two batches (even and odd days) appended to a log, the second one
    twice as after a failure, and read back."""
    rows = U.usage_records(handled_requests(spark, sf))
    path = shared_path(spark, "usage-log", uuid.uuid4().hex)
    for batch_id in (0, 1, 1):
        U.append_log(rows.where(F.dayofmonth("request_timestamp") % 2 == batch_id), path, batch_id)
    return U.read_log(spark, path).withColumn("predicted_price", F.col("predicted_price").cast("double"))


# ---- prediction cache (SC5, SC6) ------------------------------------------------

def cache_requests(spark, sf):
    """Prediction requests (POST rows of the log) keyed by the hash of their payload."""
    from ..operators.scoring import payload_hash
    from ..sources.tables import read_table
    ev = read_table(spark, sf, "events")
    return ev.where(F.col("event_type") != "view").select(
        F.col("event_id").alias("id"), payload_hash("props").alias("request_key"),
        F.col("ts").cast("timestamp").alias("request_timestamp"),
        (F.col("event_type") != "error").alias("succeeded"))


_REPLAY_SQL = """WITH RECURSIVE
p AS (SELECT event_id AS id, sha256('{"k":' || coalesce(json_extract_string(props, '$.k'), 'null') || '}') AS request_key,
             CAST(ts AS TIMESTAMP) AS request_timestamp, event_type <> 'error' AS succeeded,
             round(value * 100, 2) AS price
      FROM events WHERE event_type <> 'view'),
ev AS (SELECT *, row_number() OVER (PARTITION BY request_key ORDER BY request_timestamp, id) AS rn FROM p),
r AS (SELECT request_key, rn, id, request_timestamp, succeeded,
             CASE WHEN succeeded THEN request_timestamp + INTERVAL 3600 SECOND END AS expiry,
             false AS cache_hit, succeeded AS computed, CASE WHEN succeeded THEN price END AS held,
             CASE WHEN succeeded THEN price END AS cached
      FROM ev WHERE rn = 1
      UNION ALL
      SELECT e.request_key, e.rn, e.id, e.request_timestamp, e.succeeded,
             CASE WHEN r.expiry IS NOT NULL AND e.request_timestamp < r.expiry THEN r.expiry
                  WHEN e.succeeded THEN e.request_timestamp + INTERVAL 3600 SECOND ELSE r.expiry END,
             coalesce(r.expiry IS NOT NULL AND e.request_timestamp < r.expiry, false),
             NOT coalesce(r.expiry IS NOT NULL AND e.request_timestamp < r.expiry, false) AND e.succeeded,
             CASE WHEN r.expiry IS NOT NULL AND e.request_timestamp < r.expiry THEN r.held
                  WHEN e.succeeded THEN e.price ELSE r.held END,
             CASE WHEN r.expiry IS NOT NULL AND e.request_timestamp < r.expiry THEN r.held
                  WHEN e.succeeded THEN e.price END
      FROM r JOIN ev e ON e.request_key = r.request_key AND e.rn = r.rn + 1)"""


_REPLAYED: dict[tuple[int, str], str] = {}


def replayed(spark, sf):
    """The replay of the log, stored once per session."""
    from ..operators import scoring
    key = (id(spark.sparkContext), sf.rstrip("/"))
    if key not in _REPLAYED:
        path = shared_path(spark, "replay", f"{zlib.crc32(key[1].encode()):08x}")
        scoring.cache_replay(cache_requests(spark, sf), "request_key", "request_timestamp", "id",
                             success="succeeded").write.mode("overwrite").parquet(path)
        _REPLAYED[key] = path
    return spark.read.parquet(_REPLAYED[key])


@register("cache_replay", _REPLAY_SQL + """
SELECT id, request_key, request_timestamp, succeeded, cache_hit, computed FROM r""")
def q_cache_replay(spark, sf):
    return replayed(spark, sf)


@register("cache_live", _REPLAY_SQL + f"""
SELECT request_key, max(request_timestamp) AS computed_at,
       3600.0 - CAST(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(request_timestamp)) AS DOUBLE) / 1000000 AS ttl_seconds
FROM r WHERE computed AND request_timestamp <= TIMESTAMP '{AS_OF}'
GROUP BY request_key
HAVING 3600.0 - CAST(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(request_timestamp)) AS DOUBLE) / 1000000 > 0""")
def q_cache_live(spark, sf):
    from ..operators import scoring
    return scoring.cache_live(replayed(spark, sf), "request_key", "request_timestamp", AS_OF)


def cache_purges(spark, sf):
    """Deletions of the cache: every 500th view of the log stands for one."""
    from ..sources.tables import read_table
    ev = read_table(spark, sf, "events")
    return ev.where((F.col("event_type") == "view") & (F.col("event_id") % 500 == 0)).select(
        F.col("ts").cast("timestamp").alias("purged_at"))


PURGED_REPLAY_SQL = _REPLAY_SQL.replace("'}') AS request_key", """'}') || '#' || CAST((
             SELECT count(*) FROM events x WHERE x.event_type = 'view' AND x.event_id % 500 = 0
             AND CAST(x.ts AS TIMESTAMP) <= CAST(events.ts AS TIMESTAMP)) AS VARCHAR) AS request_key""")


@register("cache_purge", PURGED_REPLAY_SQL + """
SELECT id, split_part(request_key, '#', 1) AS request_key, request_timestamp, succeeded, cache_hit, computed FROM r""")
def q_cache_purge(spark, sf):
    """SC6: the replay of the log with deletions of the whole cache."""
    from ..operators import scoring
    keyed = scoring.with_generation(cache_requests(spark, sf), "request_key", "request_timestamp", cache_purges(spark, sf))
    out = scoring.cache_replay(keyed, "request_key", "request_timestamp", "id", success="succeeded")
    return scoring.without_generation(out, "request_key")

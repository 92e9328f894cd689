"""SQL text shared by the DuckDB oracle strings.

Every oracle string inlines the two derived views as CTEs over the
pre-registered base tables, then states the operator in plain SQL.
Numeric outputs follow two rules so both engines produce bit-identical
doubles: money sums are integer cents divided once, and any other float
result is rounded to 6 decimals on both sides.
"""

from __future__ import annotations

AS_OF_YEAR = 2002
AS_OF = "2024-01-15 12:00:00"

LISTINGS_SQL = """
SELECT p.p_brand                                                            AS brand,
       p.p_name                                                             AS model,
       lower(p.p_type)                                                      AS vehicleType,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'benzin' WHEN '2-HIGH' THEN 'diesel'
            WHEN '3-MEDIUM' THEN 'lpg' WHEN '4-NOT SPECIFIED' THEN 'andere' ELSE 'elektro' END AS fuelType,
       CASE l.l_linestatus WHEN 'F' THEN 'automatik' ELSE 'manuell' END     AS gearbox,
       CASE l.l_returnflag WHEN 'A' THEN 'ja' WHEN 'N' THEN 'nein' END      AS notRepairedDamage,
       l.l_quantity * 25 - 25                                               AS powerPS,
       CAST(p.p_size * 3000 AS DOUBLE)                                      AS kilometer,
       CAST(year(l.l_shipdate) - (l.l_linenumber - 1) * 4 AS INT)           AS yearOfRegistration,
       CAST(month(l.l_shipdate) AS INT)                                     AS monthOfRegistration,
       round(l.l_extendedprice / 5, 2)                                      AS price
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN orders o ON l.l_orderkey = o.o_orderkey
"""

# cleaned (P2-P6, P1 with the cleanup list) then encoded and decoded
MARKET_SQL = f"""
SELECT brand, model, vehicleType, fuelType,
       CASE gearbox WHEN 'automatik' THEN 'Automatic' WHEN 'manuell' THEN 'Manual' END AS gearbox,
       CASE notRepairedDamage WHEN 'ja' THEN 'Yes' WHEN 'nein' THEN 'No' END AS notRepairedDamage,
       powerPS, kilometer, yearOfRegistration, price,
       CAST({AS_OF_YEAR} - yearOfRegistration AS INT) AS age
FROM listings
WHERE brand IS NOT NULL AND model IS NOT NULL AND vehicleType IS NOT NULL
  AND fuelType IS NOT NULL AND gearbox IS NOT NULL AND notRepairedDamage IS NOT NULL
  AND powerPS IS NOT NULL AND kilometer IS NOT NULL AND yearOfRegistration IS NOT NULL
  AND monthOfRegistration IS NOT NULL AND price IS NOT NULL
  AND price BETWEEN 200 AND 20000 AND powerPS > 0 AND powerPS <= 1000
  AND fuelType <> 'Other' AND notRepairedDamage <> 'NaN'
"""

USAGE_SQL = """
SELECT event_id AS id, user_id, CAST(user_id % 4 + 1 AS INT) AS subscription_plan_id,
       CAST(ts AS TIMESTAMP) AS request_timestamp,
       CASE event_type WHEN 'view' THEN 'GET /cached-predictions' ELSE 'POST /predict' END AS endpoint,
       CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status_code,
       value AS response_time_ms
FROM events
"""

PLANS_SQL = """
SELECT * FROM (VALUES (1, 'Free', 10, 100, 0.0), (2, 'Basic', 50, 1000, 9.99),
                      (3, 'Premium', 100, 5000, 19.99))
       AS t(plan_id, plan_name, limit_per_minute, limit_per_day, monthly_price)
"""


def _ctes(defs: str, body: str) -> str:
    """Prefix CTE definitions; a body with its own WITH continues the list."""
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {defs},\n{stripped[5:]}"
    return f"WITH {defs}\n{body}"


def with_listings(body: str) -> str:
    return _ctes(f"listings AS ({LISTINGS_SQL})", body)


def with_market(body: str) -> str:
    return _ctes(f"listings AS ({LISTINGS_SQL}),\nmarket AS ({MARKET_SQL})", body)


def with_usage(body: str) -> str:
    return _ctes(f"usage_log AS ({USAGE_SQL})", body)


# cleaned with the training drop list, strictly encoded
TRAINING_SQL = f"""
SELECT brand, model, vehicleType, fuelType,
       CAST(CASE gearbox WHEN 'automatik' THEN 1 WHEN 'manuell' THEN 0 END AS INT) AS gearbox,
       CAST(CASE notRepairedDamage WHEN 'ja' THEN 1 WHEN 'nein' THEN 0 END AS INT) AS notRepairedDamage,
       powerPS, kilometer, price, CAST({AS_OF_YEAR} - yearOfRegistration AS INT) AS age
FROM listings
WHERE brand IS NOT NULL AND model IS NOT NULL AND vehicleType IS NOT NULL
  AND fuelType IS NOT NULL AND gearbox IS NOT NULL AND notRepairedDamage IS NOT NULL
  AND powerPS IS NOT NULL AND kilometer IS NOT NULL AND yearOfRegistration IS NOT NULL
  AND monthOfRegistration IS NOT NULL AND price IS NOT NULL
  AND price BETWEEN 200 AND 20000 AND powerPS > 0 AND powerPS <= 1000
  AND fuelType <> 'Other' AND notRepairedDamage <> 'NaN'
"""

def _text_sql(c: str) -> str:
    if c in ("powerPS", "kilometer", "price"):
        c = f"CAST(round({c} * 100) AS BIGINT)"
    return f"coalesce(CAST({c} AS VARCHAR), '\\N')"


# the split key: md5 over salt, seed and every training column
SPLIT_KEY_SQL = "substr(md5(concat_ws('|', 'split', '15', " + ", ".join(_text_sql(c) for c in (
    "brand", "model", "vehicleType", "fuelType", "gearbox", "notRepairedDamage", "powerPS", "kilometer", "age",
    "price")) + ")), 1, 8)"


def with_training(body: str) -> str:
    return _ctes(f"listings AS ({LISTINGS_SQL}),\ntraining AS ({TRAINING_SQL}),\n"
                 f"keyed AS (SELECT *, {SPLIT_KEY_SQL} AS _key FROM training),\n"
                 f"train AS (SELECT * EXCLUDE (_key) FROM keyed WHERE _key >= '33333333'),\n"
                 f"test AS (SELECT * EXCLUDE (_key) FROM keyed WHERE _key < '33333333')", body)

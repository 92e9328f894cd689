"""Registered market queries (cleaning, aggregates, rankings) and their
DuckDB oracle text."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import encode as E
from ..operators import clean, comparables, market
from ..sources import tables
from .common import AS_OF_YEAR, listings, market as market_df
from .oracle import with_listings, with_market
from .registry import register

# integer-cent mean, written the same way on both engines
MEAN_MONEY = "CAST(SUM(CAST(round(price * 100) AS BIGINT)) AS DOUBLE) / (COUNT(price) * CAST(100 AS DOUBLE))"


def _mean_exact(c: str) -> str:
    return f"CAST(SUM(CAST({c} AS DECIMAL(18,6))) AS DOUBLE) / COUNT({c})"


# ---- cleaning (P1-P12) ---------------------------------------------------------

@register("derive_age", with_listings(f"""
SELECT *, CAST({AS_OF_YEAR} - yearOfRegistration AS INT) AS age FROM listings"""))
def q_derive_age(spark, sf):
    return clean.derive_age(listings(spark, sf), AS_OF_YEAR)


@register("drop_null_rows", with_listings("""
SELECT * FROM listings WHERE brand IS NOT NULL AND model IS NOT NULL AND vehicleType IS NOT NULL
  AND fuelType IS NOT NULL AND gearbox IS NOT NULL AND notRepairedDamage IS NOT NULL
  AND powerPS IS NOT NULL AND kilometer IS NOT NULL AND yearOfRegistration IS NOT NULL
  AND monthOfRegistration IS NOT NULL AND price IS NOT NULL"""))
def q_drop_null_rows(spark, sf):
    return clean.drop_null_rows(listings(spark, sf))


@register("drop_redundant", with_listings("""
SELECT brand, model, vehicleType, fuelType, gearbox, notRepairedDamage, powerPS, kilometer, price
FROM listings"""))
def q_drop_redundant(spark, sf):
    # training drop list: the view carries two of its twelve names
    return clean.drop_columns(listings(spark, sf), C.COLUMNS_TO_DROP, missing="ignore")


CLEAN_BODY = f"""
SELECT brand, model, vehicleType, fuelType, gearbox, notRepairedDamage, powerPS, kilometer,
       yearOfRegistration, price, CAST({AS_OF_YEAR} - yearOfRegistration AS INT) AS age
FROM listings
WHERE brand IS NOT NULL AND model IS NOT NULL AND vehicleType IS NOT NULL
  AND fuelType IS NOT NULL AND gearbox IS NOT NULL AND notRepairedDamage IS NOT NULL
  AND powerPS IS NOT NULL AND kilometer IS NOT NULL AND yearOfRegistration IS NOT NULL
  AND monthOfRegistration IS NOT NULL AND price IS NOT NULL
  AND price BETWEEN 200 AND 20000 AND powerPS > 0 AND powerPS <= 1000
  AND fuelType <> 'Other' AND notRepairedDamage <> 'NaN'"""


@register("clean_listings", with_listings(CLEAN_BODY))
def q_clean_listings(spark, sf):
    return clean.clean_listings(listings(spark, sf), AS_OF_YEAR)


@register("year_range", with_listings("""
SELECT * FROM listings WHERE yearOfRegistration BETWEEN 1980 AND 2023"""))
def q_year_range(spark, sf):
    return clean.year_range(listings(spark, sf))


@register("encode_binary", with_listings(f"""
SELECT brand, model, vehicleType, fuelType,
       CAST(CASE gearbox WHEN 'automatik' THEN 1 WHEN 'manuell' THEN 0 END AS INT) AS gearbox,
       CAST(CASE notRepairedDamage WHEN 'ja' THEN 1 WHEN 'nein' THEN 0 END AS INT) AS notRepairedDamage,
       powerPS, kilometer, price, age
FROM ({CLEAN_BODY.replace('yearOfRegistration,', '', 1)}) c"""))
def q_encode_binary(spark, sf):
    return clean.training_listings(listings(spark, sf), AS_OF_YEAR)


@register("decode_binary", with_market("SELECT * FROM market"))
def q_decode_binary(spark, sf):
    return market_df(spark, sf)


@register("encode_request", with_market("""
SELECT brand, model, vehicleType, fuelType, powerPS, kilometer, yearOfRegistration, price, age,
       CAST(coalesce(lower(notRepairedDamage) = 'yes', false) AS INT) AS notRepairedDamage,
       CAST(coalesce(lower(gearbox) = 'automatic', false) AS INT) AS gearbox
FROM market"""))
def q_encode_request(spark, sf):
    # the decoded dashboard values are exactly what a score request carries
    return clean.encode_request(market_df(spark, sf))


@register("translate_values", with_listings("""
SELECT brand, model, gearbox, notRepairedDamage, powerPS, kilometer, yearOfRegistration,
       monthOfRegistration, price,
       CASE fuelType WHEN 'benzin' THEN 'petrol' WHEN 'diesel' THEN 'diesel' WHEN 'lpg' THEN 'lpg'
            WHEN 'cng' THEN 'cng' WHEN 'hybrid' THEN 'hybrid' WHEN 'elektro' THEN 'electric'
            WHEN 'andere' THEN 'other' END AS fuelType,
       CASE vehicleType WHEN 'limousine' THEN 'sedan' WHEN 'kleinwagen' THEN 'small car'
            WHEN 'kombi' THEN 'station wagon' WHEN 'bus' THEN 'bus' WHEN 'cabrio' THEN 'convertible'
            WHEN 'coupe' THEN 'coupe' WHEN 'suv' THEN 'suv' WHEN 'andere' THEN 'other' END AS vehicleType
FROM listings"""))
def q_translate_values(spark, sf):
    return clean.translate_values(listings(spark, sf))


@register("rename_columns", with_market("""
SELECT brand, model, vehicleType AS vehicle_type, fuelType AS fuel_type, powerPS AS power_ps,
       kilometer, yearOfRegistration AS year_of_registration, gearbox,
       notRepairedDamage AS not_repaired_damage, price, age
FROM market"""))
def q_rename_columns(spark, sf):
    return clean.rename_columns(market_df(spark, sf))


# ---- explorer, bands, age groups (P17, P21, P22) ------------------------------

EXPLORE_FUELS = ["diesel", "lpg"]
EXPLORE_PRICE = (1000, 15000)
EXPLORE_COLUMNS = ["brand", "model", "vehicleType", "fuelType", "powerPS", "kilometer", "age", "price"]


@register("explore", with_market(f"""
SELECT {', '.join(EXPLORE_COLUMNS)} FROM market
WHERE fuelType IN ('diesel', 'lpg') AND price BETWEEN {EXPLORE_PRICE[0]} AND {EXPLORE_PRICE[1]}"""))
def q_explore(spark, sf):
    return clean.explore(market_df(spark, sf), fuels=EXPLORE_FUELS, price_min=EXPLORE_PRICE[0],
                         price_max=EXPLORE_PRICE[1], columns=EXPLORE_COLUMNS)


@register("explore_counts", with_market(f"""
SELECT count(*) FILTER (WHERE fuelType IN ('diesel', 'lpg')
                        AND price BETWEEN {EXPLORE_PRICE[0]} AND {EXPLORE_PRICE[1]}) AS n_shown,
       count(*) AS n_total
FROM market"""))
def q_explore_counts(spark, sf):
    flag = F.col("fuelType").isin(EXPLORE_FUELS) & F.col("price").between(*EXPLORE_PRICE)
    return clean.explore_counts(market_df(spark, sf), flag)


@register("price_bands", with_listings("""
SELECT count(*) AS rows,
       count(*) FILTER (WHERE price > 20000) AS above_20000,
       count(*) FILTER (WHERE price BETWEEN 200 AND 20000) AS within_20000,
       count(*) FILTER (WHERE price > 30000) AS above_30000,
       count(*) FILTER (WHERE price BETWEEN 200 AND 30000) AS within_30000,
       count(*) FILTER (WHERE price > 40000) AS above_40000,
       count(*) FILTER (WHERE price BETWEEN 200 AND 40000) AS within_40000
FROM listings WHERE yearOfRegistration BETWEEN 1980 AND 2023"""))
def q_price_bands(spark, sf):
    return market.price_bands(clean.year_range(listings(spark, sf)))


AGE_GROUP_SQL = """CASE WHEN age > 0 AND age <= 3 THEN '0-3' WHEN age > 3 AND age <= 5 THEN '4-5'
     WHEN age > 5 AND age <= 10 THEN '6-10' WHEN age > 10 AND age <= 15 THEN '11-15'
     WHEN age > 15 AND age <= 20 THEN '16-20' WHEN age > 20 AND age <= 100 THEN '20+' END"""


@register("age_groups", with_market(f"""
SELECT age_group, CAST(list_position({[*C.AGE_LABELS]}, age_group) AS INT) AS position,
       count(*) AS count, {MEAN_MONEY} AS avg_price
FROM (SELECT *, {AGE_GROUP_SQL} AS age_group FROM market) t
WHERE age_group IS NOT NULL GROUP BY age_group"""))
def q_age_groups(spark, sf):
    df = market_df(spark, sf).withColumns({"age_group": E.age_group("age"), "position": E.age_group_order("age")})
    return (df.where(F.col("age_group").isNotNull()).groupBy("age_group", "position")
              .agg(F.count(F.lit(1)).alias("count"), market.mean_money("price").alias("avg_price")))


# ---- aggregates (A1-A10, A12, A18, A22) ---------------------------------------

@register("market_overview", with_market(f"""
SELECT count(*) AS row_count, count(DISTINCT brand) AS brand_count, {MEAN_MONEY} AS avg_price,
       {_mean_exact('age')} AS avg_age, {_mean_exact('powerPS')} AS avg_power
FROM market"""))
def q_market_overview(spark, sf):
    return market.market_overview(market_df(spark, sf))


@register("price_by_year", with_market(f"""
SELECT yearOfRegistration, {MEAN_MONEY} AS avg_price FROM market
WHERE yearOfRegistration >= 1990 GROUP BY yearOfRegistration"""))
def q_price_by_year(spark, sf):
    return market.price_by_year(market_df(spark, sf))


@register("year_change", with_market(f"""
SELECT yearOfRegistration, avg_price,
       round(CASE WHEN prev > 0 THEN (avg_price - prev) / prev * 100 END, 6) AS pct_change
FROM (SELECT yearOfRegistration, avg_price, lag(avg_price) OVER (ORDER BY yearOfRegistration) AS prev
      FROM (SELECT yearOfRegistration, {MEAN_MONEY} AS avg_price FROM market
            WHERE yearOfRegistration >= 1990 GROUP BY yearOfRegistration) s) t"""))
def q_year_change(spark, sf):
    return market.year_change(market_df(spark, sf))


@register("year_annotations", with_market(f"""
SELECT e.event_year, e.label, s.avg_price
FROM (SELECT yearOfRegistration, {MEAN_MONEY} AS avg_price FROM market
      WHERE yearOfRegistration >= 1990 GROUP BY yearOfRegistration) s
JOIN (VALUES (1994, 'Financial Crisis'), (1999, 'COVID-19')) AS e(event_year, label)
  ON s.yearOfRegistration = e.event_year"""))
def q_year_annotations(spark, sf):
    # the fixture's years end in 2001, so the two events are placed on it
    return market.year_annotations(market_df(spark, sf),
                                   events=[(1994, "Financial Crisis"), (1999, "COVID-19")])


@register("price_by_age", with_market(f"""
SELECT age, {MEAN_MONEY} AS avg_price FROM market GROUP BY age"""))
def q_price_by_age(spark, sf):
    return market.price_by_age(market_df(spark, sf))


@register("brand_compare", with_market(f"""
WITH top AS (SELECT brand FROM (SELECT brand, count(*) AS c FROM market WHERE brand IS NOT NULL
             GROUP BY brand ORDER BY c DESC, brand ASC LIMIT 15) t ORDER BY c DESC, brand ASC LIMIT 5)
SELECT brand, {MEAN_MONEY} AS avg_price, count(*) AS count FROM market
WHERE brand IN (SELECT brand FROM top) GROUP BY brand"""))
def q_brand_compare(spark, sf):
    return market.brand_compare(market_df(spark, sf))


@register("value_counts", with_market("""
SELECT vehicleType, count(*) AS count FROM market WHERE vehicleType IS NOT NULL GROUP BY vehicleType"""))
def q_value_counts(spark, sf):
    return market.value_counts(market_df(spark, sf), "vehicleType")


@register("value_counts_raw", with_listings("""
SELECT notRepairedDamage, count(*) AS count FROM listings
WHERE notRepairedDamage IS NOT NULL GROUP BY notRepairedDamage"""))
def q_value_counts_raw(spark, sf):
    return market.value_counts(listings(spark, sf), "notRepairedDamage")


@register("model_counts", with_market("""
SELECT brand, model, count(*) AS count FROM market GROUP BY brand, model"""))
def q_model_counts(spark, sf):
    return market.group_counts(market_df(spark, sf), ["brand", "model"])


@register("type_model_counts", with_market("""
SELECT vehicleType, model, brand, count(*) AS count FROM market GROUP BY vehicleType, model, brand"""))
def q_type_model_counts(spark, sf):
    return market.group_counts(market_df(spark, sf), ["vehicleType", "model", "brand"])


@register("top_brands", with_market("""
SELECT brand, count(*) AS count FROM market WHERE brand IS NOT NULL GROUP BY brand
ORDER BY count DESC, brand ASC LIMIT 10"""))
def q_top_brands(spark, sf):
    return market.top_keys(market_df(spark, sf), "brand", 10)


def _ranked_sql(keys: str, order: str) -> str:
    not_null = " AND ".join(f"{k} IS NOT NULL" for k in keys.split(", "))
    return with_market(f"SELECT {keys}, count(*) AS count FROM market WHERE {not_null} GROUP BY {keys} "
                       f"ORDER BY count {order}, {keys} LIMIT 10")


@register("bottom_brands", _ranked_sql("brand", "ASC"))
def q_bottom_brands(spark, sf):
    return market.top_keys(market_df(spark, sf), "brand", 10, ascending=True)


@register("bottom_models", _ranked_sql("model", "ASC"))
def q_bottom_models(spark, sf):
    return market.top_keys(market_df(spark, sf), "model", 10, ascending=True)


@register("top_brand_models", _ranked_sql("brand, model", "DESC"))
def q_top_brand_models(spark, sf):
    return market.top_keys(market_df(spark, sf), ["brand", "model"], 10)


@register("bottom_brand_models", _ranked_sql("brand, model", "ASC"))
def q_bottom_brand_models(spark, sf):
    return market.top_keys(market_df(spark, sf), ["brand", "model"], 10, ascending=True)


PROFILE_COLS = tables.LISTING_COLUMNS


def _profile_sql() -> str:
    parts = []
    numeric = {"powerPS", "kilometer", "yearOfRegistration", "monthOfRegistration", "price"}
    for c in PROFILE_COLS:
        zero = f"count(*) FILTER (WHERE {c} = 0)" if c in numeric else "CAST(0 AS BIGINT)"
        parts.append(f"""SELECT '{c}' AS column_name, count({c}) AS non_null,
       count(*) FILTER (WHERE {c} IS NULL) AS nulls, {zero} AS zeros,
       round(count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100, 6) AS null_pct,
       round({zero} / count(*) * 100, 6) AS zero_pct FROM listings""")
    return with_listings("\nUNION ALL\n".join(parts))


@register("profile", _profile_sql())
def q_profile(spark, sf):
    return market.profile(listings(spark, sf), PROFILE_COLS)


NUNIQUE_COLS = ["brand", "model", "vehicleType", "fuelType", "gearbox", "notRepairedDamage",
                "powerPS", "kilometer", "yearOfRegistration", "price", "age"]


@register("nunique", with_market("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique FROM market" for c in NUNIQUE_COLS)))
def q_nunique(spark, sf):
    return market.nunique(market_df(spark, sf), NUNIQUE_COLS)


@register("describe_price", with_market("""
SELECT count(price) AS count, round(avg(price), 6) AS mean,
       round(quantile_cont(price, 0.5), 6) AS median, CAST(min(price) AS DOUBLE) AS min,
       CAST(max(price) AS DOUBLE) AS max, round(quantile_cont(price, 0.05), 6) AS p05,
       round(quantile_cont(price, 0.95), 6) AS p95
FROM market"""))
def q_describe_price(spark, sf):
    return market.describe(market_df(spark, sf), "price")


def _histogram_sql(bins: int, column: str = "price") -> str:
    return f"""
(WITH b AS (SELECT CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi FROM market),
     c AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor(({column} - lo) / ((hi - lo) / {bins})), {bins - 1}) END AS INT) AS bin,
                  count(*) AS count
           FROM market, b WHERE {column} IS NOT NULL GROUP BY 1)
SELECT g.bin, round(b.lo + g.bin * ((b.hi - b.lo) / {bins}), 6) AS bin_start,
       round(b.lo + (g.bin + 1) * ((b.hi - b.lo) / {bins}), 6) AS bin_end, coalesce(c.count, 0) AS count
FROM (SELECT CAST(range AS INT) AS bin FROM range({bins})) g CROSS JOIN b LEFT JOIN c ON g.bin = c.bin)"""


@register("histogram", with_market(f"SELECT * FROM {_histogram_sql(50)} h"))
def q_histogram(spark, sf):
    return market.histogram(market_df(spark, sf), "price", 50)


_COARSE_BINS = [("powerPS", 30), ("kilometer", 10), ("price", 5)]


@register("histograms_coarse", with_market("\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, * FROM {_histogram_sql(n, c)} h" for c, n in _COARSE_BINS)))
def q_histograms_coarse(spark, sf):
    """A12 at the 5, 10 and 30 bins of the exploration."""
    out = None
    for c, n in _COARSE_BINS:
        part = market.histogram(market_df(spark, sf), c, n).withColumn("feature", F.lit(c))
        out = part if out is None else out.unionByName(part)
    return out


@register("facets", with_market(f"""
WITH g AS (SELECT model, gearbox, count(*) AS c FROM market GROUP BY model, gearbox),
     m AS (SELECT model, first(gearbox ORDER BY c DESC, gearbox ASC) AS gearbox_mode FROM g GROUP BY model),
     w AS (SELECT CAST(min(kilometer) AS INT) AS min_km,
                  CAST(least(max(kilometer), {float(C.FACET_KM_CAP)}) AS INT) AS max_km,
                  min(yearOfRegistration) AS min_year, CAST({AS_OF_YEAR} AS INT) AS max_year FROM market),
     f AS (SELECT a.model, list_sort(list_distinct(list(a.vehicleType))) AS vehicle_types,
       list_sort(list_distinct(list(a.fuelType))) AS fuel_types,
       any_value(m.gearbox_mode) AS gearbox_mode,
       CAST(min(a.powerPS) AS INT) AS min_power,
       CAST(least(max(a.powerPS), {float(C.FACET_POWER_CAP)}) AS INT) AS max_power,
       count(*) AS listings
FROM market a JOIN m ON a.model = m.model GROUP BY a.model)
SELECT f.*, w.* FROM f CROSS JOIN w"""))
def q_facets(spark, sf):
    return market.facets(market_df(spark, sf), AS_OF_YEAR)


@register("brand_models", with_market("""
SELECT brand, list_sort(list_distinct(list(model))) AS models FROM market
WHERE model IS NOT NULL GROUP BY brand"""))
def q_brand_models(spark, sf):
    return market.brand_models(market_df(spark, sf))


@register("top_models_per_brand", with_market("""
SELECT brand, model, count, rank FROM (
  SELECT brand, model, count, row_number() OVER (PARTITION BY brand ORDER BY count DESC, model ASC) AS rank
  FROM (SELECT brand, model, count(*) AS count FROM market WHERE model IS NOT NULL GROUP BY brand, model) c) r
WHERE rank <= 10"""))
def q_top_models_per_brand(spark, sf):
    return market.top_per_group(market_df(spark, sf), "brand", "model", 10)


# ---- comparables (J2, T4, A20) ------------------------------------------------

_BAND = """l.brand = r.brand AND l.model = r.model
      AND l.powerPS BETWEEN r.req_powerPS * CAST(0.3 AS DOUBLE) AND r.req_powerPS * CAST(1.3 AS DOUBLE)
      AND l.kilometer BETWEEN r.req_kilometer * CAST(0.3 AS DOUBLE) AND r.req_kilometer * CAST(1.3 AS DOUBLE)"""
_REQ = "req AS (SELECT DISTINCT brand, model, powerPS AS req_powerPS, kilometer AS req_kilometer FROM market)"


@register("similar_listings", with_market(f"""
WITH {_REQ},
m AS (SELECT r.brand, r.model, r.req_powerPS, r.req_kilometer, l.powerPS, l.kilometer, l.vehicleType,
             l.fuelType, l.yearOfRegistration, l.price, l.gearbox, l.notRepairedDamage
      FROM req r JOIN market l ON {_BAND}),
rk AS (SELECT *, row_number() OVER (PARTITION BY brand, model, req_powerPS, req_kilometer
                 ORDER BY price, powerPS, kilometer, vehicleType, fuelType, yearOfRegistration,
                          gearbox, notRepairedDamage) AS rank FROM m)
SELECT brand, model, req_powerPS, req_kilometer, rank, powerPS, kilometer, vehicleType, fuelType,
       yearOfRegistration, price FROM rk WHERE rank <= 10"""))
def q_similar_listings(spark, sf):
    df = market_df(spark, sf)
    return comparables.similar_listings(df, comparables.distinct_requests(df))


@register("price_verdict", with_market(f"""
WITH {_REQ},
s AS (SELECT r.brand, r.model, r.req_powerPS, r.req_kilometer, count(*) AS n,
             sum(CAST(round(l.price * 100) AS BIGINT)) AS c
      FROM req r JOIN market l ON {_BAND} GROUP BY r.brand, r.model, r.req_powerPS, r.req_kilometer),
v AS (SELECT m.*, CAST(coalesce(s.n, 0) AS BIGINT) AS n_similar,
             CAST(s.c AS DOUBLE) / (s.n * CAST(100 AS DOUBLE)) AS avg_similar_price
      FROM market m LEFT JOIN s ON m.brand = s.brand AND m.model = s.model
           AND m.powerPS = s.req_powerPS AND m.kilometer = s.req_kilometer)
SELECT *, price - avg_similar_price AS price_diff,
       CASE WHEN avg_similar_price IS NULL THEN NULL WHEN abs(price - avg_similar_price) < 100 THEN 'close'
            WHEN price - avg_similar_price > 0 THEN 'higher' ELSE 'lower' END AS verdict
FROM v"""))
def q_price_verdict(spark, sf):
    df = market_df(spark, sf)
    return comparables.price_verdict(df, df)


# ---- validation (P15, P16, J5) and sampling (P20) --------------------------------

_REQ_FIELDS = ["vehicleType", "gearbox", "powerPS", "model", "kilometer", "fuelType", "brand",
               "notRepairedDamage", "yearOfRegistration"]


@register("validate_requests", with_listings(f"""
SELECT coalesce(vehicleType, 'coupe') AS vehicleType, coalesce(gearbox, 'automatic') AS gearbox,
       coalesce(powerPS, 190.0) AS powerPS, coalesce(model, 'a5') AS model,
       coalesce(kilometer, 125000.0) AS kilometer, coalesce(fuelType, 'diesel') AS fuelType,
       coalesce(brand, 'audi') AS brand, coalesce(notRepairedDamage, 'no') AS notRepairedDamage,
       coalesce(yearOfRegistration, 2010) AS yearOfRegistration,
       coalesce(coalesce(powerPS, 190.0) > 0 AND coalesce(kilometer, 125000.0) > 0
                AND coalesce(yearOfRegistration, 2010) BETWEEN 1885 AND {AS_OF_YEAR}, false) AS is_valid
FROM listings"""))
def q_validate_requests(spark, sf):
    """P15 over the raw listing rows taken as score requests."""
    return clean.validate_requests(listings(spark, sf).select(*_REQ_FIELDS), AS_OF_YEAR)


def _candidates(spark, sf):
    from ..sources.tables import read_table
    cu = read_table(spark, sf, "customer")
    k = F.col("c_custkey")
    prefix = (F.when(k % 4 == 0, "u").when(k % 4 == 1, "us").when(k % 4 == 2, "use").otherwise("user"))
    name = F.when(k % 97 == 0, F.repeat(F.lit("x"), 51)).otherwise(F.concat(prefix, (k % 400).cast("string")))
    email = F.concat(F.lower("c_mktsegment"), F.lit("."), F.col("c_nationkey").cast("string"), F.lit("@mail.test"))
    return cu.select(k.alias("candidate_id"), name.alias("username"), email.alias("email"))


def _existing(spark, sf):
    from ..sources.tables import read_table
    u = F.col("user_id")
    ev = read_table(spark, sf, "events").where(u.isNotNull()).select("user_id").distinct()
    email = F.when(u % 2 == 0, F.concat(F.lit("building."), (u % 25).cast("string"), F.lit("@mail.test"))) \
             .otherwise(F.concat(F.lit("u"), u.cast("string"), F.lit("@mail.test")))
    return ev.select(F.concat(F.lit("user"), u.cast("string")).alias("username"), email.alias("email"))


@register("validate_users", """
WITH cand AS (SELECT c_custkey AS candidate_id,
                     CASE WHEN c_custkey % 97 = 0 THEN repeat('x', 51)
                          ELSE CASE c_custkey % 4 WHEN 0 THEN 'u' WHEN 1 THEN 'us' WHEN 2 THEN 'use' ELSE 'user' END
                               || CAST(c_custkey % 400 AS VARCHAR) END AS username,
                     lower(c_mktsegment) || '.' || CAST(c_nationkey AS VARCHAR) || '@mail.test' AS email
              FROM customer),
     ex AS (SELECT 'user' || CAST(user_id AS VARCHAR) AS username,
                   CASE WHEN user_id % 2 = 0 THEN 'building.' || CAST(user_id % 25 AS VARCHAR) || '@mail.test'
                        ELSE 'u' || CAST(user_id AS VARCHAR) || '@mail.test' END AS email
            FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL) e),
     f AS (SELECT c.*, NOT (length(c.username) BETWEEN 3 AND 50) AS bad_username_length,
                  c.username IN (SELECT username FROM ex) AS username_taken,
                  c.email IN (SELECT email FROM ex) AS email_taken,
                  count(*) OVER (PARTITION BY c.username) > 1 AS username_repeated,
                  count(*) OVER (PARTITION BY c.email) > 1 AS email_repeated
           FROM cand c)
SELECT *, NOT (bad_username_length OR username_taken OR email_taken OR username_repeated OR email_repeated) AS is_valid
FROM f""")
def q_validate_users(spark, sf):
    """Registration candidates (from customers) checked against the
    registered users (from the request log) and against each other."""
    return clean.validate_users(_candidates(spark, sf), _existing(spark, sf))


_MARKET_COLS = ["brand", "model", "vehicleType", "fuelType", "gearbox", "notRepairedDamage",
                "powerPS", "kilometer", "yearOfRegistration", "price", "age"]
_MONEY_LIKE = {"powerPS", "kilometer", "price"}


def _canonical_sql(c: str) -> str:
    return (f"CAST(CAST(round({c} * 100) AS BIGINT) AS VARCHAR)" if c in _MONEY_LIKE
            else f"CAST({c} AS VARCHAR)")


@register("sample_k", with_market(f"""
SELECT {", ".join(_MARKET_COLS)} FROM market
ORDER BY md5(concat_ws('|', '0', {", ".join(_canonical_sql(c) for c in _MARKET_COLS)})),
         {", ".join(f"{c} ASC NULLS FIRST" for c in _MARKET_COLS)}
LIMIT 5000"""))
def q_sample_k(spark, sf):
    """P20: 5000 rows chosen by a seeded row hash (a sampling operator: the
    limit is the feature)."""
    return market.sample_k(market_df(spark, sf), 5000, seed=0)

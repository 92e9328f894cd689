"""Registered statistics queries (A11, A13-A17, A23, A25) and oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import config as C
from ..functions import encode as E
from ..operators import clean, features, stats
from ..session import shared_path
from .common import listings, market as market_df
from .oracle import with_listings, with_market
from .registry import register

CORR_COLS = ["price", "powerPS", "kilometer", "age"]


def _pearson_long_sql(source: str, cols: list[str]) -> str:
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            val = "any_value(CAST(1.0 AS DOUBLE))" if i == j else f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6)"
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {val} AS corr, "
                         f"{str(i > j).lower()} AS lower_triangle FROM {source}")
    return "\nUNION ALL\n".join(parts)


def _box_sql(group: str, source: str = "market") -> str:
    same = " AND ".join(f"m.{g} = b.{g}" for g in group.split(", "))
    keys = ", ".join(f"b.{g}" for g in group.split(", "))
    return with_market(f"""
WITH src AS (SELECT * FROM {source}),
     q AS (SELECT {group}, count(*) AS count, quantile_cont(price, 0.25) AS q1,
                  quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.75) AS q3
           FROM src WHERE price IS NOT NULL GROUP BY {group}),
     b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT {keys}, any_value(b.count) AS count, round(any_value(b.q1), 6) AS q1,
       round(any_value(b.median), 6) AS median, round(any_value(b.q3), 6) AS q3,
       round(min(CASE WHEN m.price >= b.lo AND m.price <= b.hi THEN m.price END), 6) AS whisker_low,
       round(max(CASE WHEN m.price >= b.lo AND m.price <= b.hi THEN m.price END), 6) AS whisker_high,
       count(*) FILTER (WHERE NOT (m.price >= b.lo AND m.price <= b.hi)) AS outliers
FROM src m JOIN b ON {same} WHERE m.price IS NOT NULL
GROUP BY {keys}""")


_AGE_GROUP_SQL = "CASE " + " ".join(
    f"WHEN age > {lo} AND age <= {hi} THEN '{label}'"
    for lo, hi, label in zip(C.AGE_BINS[:-1], C.AGE_BINS[1:], C.AGE_LABELS)) + " END"


@register("box_stats", _box_sql("vehicleType"))
def q_box_stats(spark, sf):
    return stats.box_stats(market_df(spark, sf), "price", "vehicleType")


@register("box_stats_brand", _box_sql("brand"))
def q_box_stats_brand(spark, sf):
    return stats.box_stats(market_df(spark, sf), "price", "brand")


@register("box_stats_age_group", _box_sql(
    "age_group", f"(SELECT *, {_AGE_GROUP_SQL} AS age_group FROM market) x WHERE age_group IS NOT NULL"))
def q_box_stats_age_group(spark, sf):
    grouped = market_df(spark, sf).withColumn("age_group", E.age_group("age")).where("age_group is not null")
    return stats.box_stats(grouped, "price", "age_group")


@register("box_stats_type_gearbox", _box_sql("vehicleType, gearbox"))
def q_box_stats_type_gearbox(spark, sf):
    """Vehicle types with the gearbox as the second key (the chart's colour)."""
    return stats.box_stats(market_df(spark, sf), "price", ["vehicleType", "gearbox"])


@register("kde", with_market("""
WITH v AS (SELECT CAST(price AS DOUBLE) AS x FROM market WHERE price IS NOT NULL),
     s AS (SELECT count(*) AS n, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi FROM v),
     s2 AS (SELECT n, lo, sd * pow(CAST(n AS DOUBLE), -0.2) AS h, (hi - lo) / 199 AS step FROM s),
     c AS (SELECT x, count(*) AS k FROM v GROUP BY x),
     g AS (SELECT CAST(range AS INT) AS i FROM range(200)),
     t AS (SELECT g.i, s2.lo + g.i * s2.step AS gx, s2.n, s2.h,
                  c.k * exp(-0.5 * ((s2.lo + g.i * s2.step - c.x) / s2.h) * ((s2.lo + g.i * s2.step - c.x) / s2.h)) AS contrib
           FROM g CROSS JOIN s2 CROSS JOIN c)
SELECT i AS point, round(any_value(gx), 6) AS x,
       round(sum(contrib) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 12) AS density
FROM t GROUP BY i"""))
def q_kde(spark, sf):
    return stats.kde(market_df(spark, sf), "price")


@register("corr_pearson", with_market(_pearson_long_sql("market", CORR_COLS)))
def q_corr_pearson(spark, sf):
    return stats.corr_pearson(market_df(spark, sf), CORR_COLS)


_RANKS = ", ".join(
    f"CAST(rank() OVER (ORDER BY {c}) AS DOUBLE) + CAST(count(*) OVER (PARTITION BY {c}) - 1 AS DOUBLE) / 2 AS {c}"
    for c in CORR_COLS)


@register("corr_spearman", with_market(
    f"WITH ranked AS (SELECT {_RANKS} FROM market)\n" + _pearson_long_sql("ranked", CORR_COLS)))
def q_corr_spearman(spark, sf):
    return stats.corr_spearman(market_df(spark, sf), CORR_COLS)


def _kendall_sql(x: str) -> str:
    return f"""
WITH d AS (SELECT {x} AS x, price AS y FROM listings
           WHERE yearOfRegistration BETWEEN 1980 AND 2023
             AND {x} IS NOT NULL AND price IS NOT NULL),
     c AS (SELECT x, y, count(*) AS n FROM d GROUP BY x, y),
     cum AS (SELECT x, y, sum(n) OVER (PARTITION BY x ORDER BY y) AS upto FROM c),
     lv AS (SELECT DISTINCT x AS lx FROM c),
     probe AS (SELECT c.x, c.y, c.n, lv.lx FROM c CROSS JOIN lv WHERE lv.lx <> c.x),
     hit AS (SELECT p.x, p.y, p.n, p.lx, coalesce(k.upto, 0) AS below
             FROM probe p ASOF LEFT JOIN cum k ON k.x = p.lx AND p.y > k.y),
     pr AS (SELECT sum(CASE WHEN lx < x THEN n * below ELSE 0 END) AS nc,
                   sum(CASE WHEN lx > x THEN n * below ELSE 0 END) AS nd FROM hit),
     tt AS (SELECT count(*) AS n FROM d),
     tx AS (SELECT sum(t * (t - 1) / 2) AS tx FROM (SELECT count(*) AS t FROM d GROUP BY x) a),
     ty AS (SELECT sum(t * (t - 1) / 2) AS ty FROM (SELECT count(*) AS t FROM d GROUP BY y) a)
SELECT '{x}' AS col_a, 'price' AS col_b, CAST(nc AS DECIMAL(38,0)) AS concordant,
       CAST(nd AS DECIMAL(38,0)) AS discordant,
       round((nc - nd) / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)), 6) AS tau_b
FROM pr, tt, tx, ty"""


@register("corr_kendall", with_listings(_kendall_sql("monthOfRegistration")))
def q_corr_kendall(spark, sf):
    return stats.corr_kendall(clean.year_range(listings(spark, sf)), "monthOfRegistration", "price")


@register("corr_kendall_year", with_listings(_kendall_sql("yearOfRegistration")))
def q_corr_kendall_year(spark, sf):
    return stats.corr_kendall(clean.year_range(listings(spark, sf)), "yearOfRegistration", "price")


SKEW_COLS = ["price", "powerPS", "kilometer", "age"]


def _skew_sql(c: str) -> str:
    return (f"SELECT '{c}' AS column_name, round(sqrt(count(*)) * sum(power(x - m, 3)) / "
            f"power(sum(power(x - m, 2)), 1.5), 6) AS skewness FROM "
            f"(SELECT CAST({c} AS DOUBLE) AS x, avg(CAST({c} AS DOUBLE)) OVER () AS m FROM market "
            f"WHERE {c} IS NOT NULL) t")


@register("skewness", with_market("\nUNION ALL\n".join(_skew_sql(c) for c in SKEW_COLS)))
def q_skewness(spark, sf):
    return stats.skewness_table(market_df(spark, sf), SKEW_COLS)


OUTLIER_COLS = ["powerPS", "kilometer", "age"]


def _outlier_sql(c: str) -> str:
    return (f"SELECT '{c}' AS feature, round(lo, 6) AS lower, round(hi, 6) AS upper, "
            f"(SELECT count(*) FROM market WHERE {c} < lo OR {c} > hi) AS outliers FROM "
            f"(SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM "
            f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM market) q) b")


@register("outlier_counts", with_market("\nUNION ALL\n".join(_outlier_sql(c) for c in OUTLIER_COLS)))
def q_outlier_counts(spark, sf):
    return stats.outlier_counts(market_df(spark, sf), OUTLIER_COLS)


@register("clip_counts", with_market("\nUNION ALL\n".join(_outlier_sql(c) for c in OUTLIER_COLS)))
def q_clip_counts(spark, sf):
    """A23 in the pass that clips and stores the rows."""
    df = market_df(spark, sf)
    model = features.OutlierClipper(inputCols=list(OUTLIER_COLS)).fit(df)
    clipped, seen = model.transform_counted(df)
    clipped.write.parquet(shared_path(spark, "out", f"clipped-{uuid.uuid4().hex}"))
    rows = [(c, float(lo), float(hi), int(seen.get[c])) for c, (lo, hi) in model.bounds.items()]
    out = spark.createDataFrame(rows, "feature string, lower double, upper double, outliers long")
    return out.select("feature", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "outliers")


@register("ols_trend", with_market("""
SELECT vehicleType, count(*) AS n, round(regr_slope(price, powerPS), 6) AS slope,
       round(regr_intercept(price, powerPS), 6) AS intercept, round(regr_r2(price, powerPS), 6) AS r2
FROM market GROUP BY vehicleType"""))
def q_ols_trend(spark, sf):
    return stats.ols_trend(market_df(spark, sf), "powerPS", "price", "vehicleType")


@register("lowess_trend", with_market("""
WITH data AS (SELECT fuelType AS grp, CAST(kilometer AS DOUBLE) AS x, CAST(price AS DOUBLE) AS y
              FROM market WHERE kilometer IS NOT NULL AND price IS NOT NULL AND fuelType IS NOT NULL),
     pts AS (SELECT grp, x, count(*) AS n, sum(y) AS sy FROM data GROUP BY grp, x),
     rng AS (SELECT grp, min(x) AS lo, max(x) AS hi, count(*) AS total FROM data GROUP BY grp),
     g AS (SELECT grp, point, lo + point * (hi - lo) / 49 AS x0,
                  ceil(total * (CAST(2 AS DOUBLE) / 3)) AS k
           FROM rng CROSS JOIN range(0, 50) t(point)),
     j AS (SELECT g.grp, g.point, g.x0, g.k, p.x, p.n, p.sy, abs(p.x - g.x0) AS d
           FROM g JOIN pts p ON g.grp = p.grp),
     c AS (SELECT *, sum(n) OVER (PARTITION BY grp, point ORDER BY d
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM j),
     h AS (SELECT grp, point, min(d) AS h FROM c WHERE cum >= k GROUP BY grp, point),
     u AS (SELECT j.*, CASE WHEN h.h > 0 THEN j.d / h.h WHEN j.d = 0 THEN 0.0 ELSE 1.0 END AS u
           FROM j JOIN h ON j.grp = h.grp AND j.point = h.point),
     w AS (SELECT *, CASE WHEN u < 1 THEN pow(1 - pow(u, 3), 3) ELSE 0.0 END AS wt, x - x0 AS dx FROM u),
     s AS (SELECT grp, point, first(x0) AS x, sum(wt * n) AS s0, sum(wt * n * dx) AS s1,
                  sum(wt * n * dx * dx) AS s2, sum(wt * sy) AS t0, sum(wt * sy * dx) AS t1
           FROM w GROUP BY grp, point),
     f AS (SELECT *, CASE WHEN abs(s0 * s2 - s1 * s1) > 1e-12
                          THEN (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) ELSE 0.0 END AS slope FROM s)
SELECT grp AS fuelType, point, round(x, 6) AS x, round((t0 - slope * s1) / s0, 6) AS fitted FROM f"""))
def q_lowess_trend(spark, sf):
    """Price vs kilometer per fuel type (also tested against a NumPy
    reference)."""
    return stats.lowess_trend(market_df(spark, sf), "kilometer", "price", "fuelType")


@register("lowess_robust")
def q_lowess_robust(spark, sf):
    """A26 with three robust rounds (tested against a NumPy loop)."""
    return stats.lowess_trend(market_df(spark, sf), "kilometer", "price", "fuelType", robust_rounds=3)

"""Market aggregates, rankings and the comparable-listing search.

Aggregations are single ``groupBy``/``agg`` passes (partial aggregation runs
map-side, so a key holding a third of all rows costs one partial row per map
task, not a hot reducer).  Top-k per group uses ``row_number() <= k``, which
Catalyst plans with a map-side ``WindowGroupLimit`` before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import encode as E
from .stats import exact_quantiles


def cents(c: str | Column = "price") -> Column:
    """Money as exact integer cents (sums are then order-independent).
    Prices are whole cents by contract; finer fractions round half up."""
    return F.round(E.col_(c) * 100).cast("bigint")


def mean_money(c: str | Column = "price") -> Column:
    """Exact mean of a money column: integer-cent sum divided once."""
    return F.sum(cents(c)) / (F.count(E.col_(c)) * F.lit(100.0))


def mean_exact(c: str | Column) -> Column:
    """Mean from an exact decimal sum (six decimals kept), divided once."""
    return F.sum(E.col_(c).cast("decimal(18,6)")).cast("double") / F.count(E.col_(c)).cast("double")


# ---- A1 ---------------------------------------------------------------------

def market_overview(df: DataFrame, approx: bool = False) -> DataFrame:
    distinct = (F.approx_count_distinct("brand") if approx else F.count_distinct("brand"))
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        distinct.alias("brand_count"),
        mean_money("price").alias("avg_price"),
        mean_exact("age").alias("avg_age"),
        mean_exact("powerPS").alias("avg_power"),
    )


# ---- A2, W1, J4 ---------------------------------------------------------------

def price_by_year(df: DataFrame, start: int = C.YEAR_SERIES_START) -> DataFrame:
    """A2: mean price per registration year, from ``start`` on."""
    return (df.where(F.col("yearOfRegistration") >= start)
              .groupBy("yearOfRegistration")
              .agg(mean_money("price").alias("avg_price")))


def year_change(df: DataFrame, start: int = C.YEAR_SERIES_START) -> DataFrame:
    """Percent change against the previous point of the yearly series.

    The window runs over the aggregated series (one row per year), so the
    single-partition ordering holds tens of rows regardless of data size.
    """
    series = price_by_year(df, start)
    prev = F.lag("avg_price").over(Window.orderBy("yearOfRegistration"))
    change = F.when(prev > 0, (F.col("avg_price") - prev) / prev * 100)
    return series.withColumn("pct_change", F.round(change, 6))


def year_annotations(df: DataFrame, start: int = C.YEAR_SERIES_START,
                     events: Sequence[tuple[int, str]] = tuple(C.YEAR_EVENTS)) -> DataFrame:
    """Annotate event years that exist in the yearly series."""
    spark = df.sparkSession
    ev = spark.createDataFrame(list(events), "event_year int, label string")
    series = price_by_year(df, start)
    return (series.join(F.broadcast(ev), series.yearOfRegistration == ev.event_year)
                  .select("event_year", "label", "avg_price"))


# ---- A3, A4, P18 ------------------------------------------------------------

def price_by_age(df: DataFrame) -> DataFrame:
    return df.groupBy("age").agg(mean_money("price").alias("avg_price"))


def top_keys(df: DataFrame, key: str | Sequence[str], k: int, ascending: bool = False) -> DataFrame:
    """K most (or least) frequent keys or key tuples without nulls,
    ties by key."""
    keys = [key] if isinstance(key, str) else list(key)
    counts = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    order = F.col("count").asc() if ascending else F.col("count").desc()
    return counts.orderBy(order, *[F.col(c).asc() for c in keys]).limit(k)


def brand_compare(df: DataFrame, top_n: int = 15, default_n: int = 5,
                  selected: Sequence[str] | None = None) -> DataFrame:
    """P18 + A4 + count: mean price and count for the selected brands
    (default: the 5 most frequent of the top 15), highest mean first.

    The selection is a bounded key list (<= top_n rows), joined back with a
    broadcast left-semi join.
    """
    if selected:
        keys = df.sparkSession.createDataFrame([(b,) for b in selected], "brand string")
    else:
        keys = top_keys(df, "brand", top_n).limit(default_n).select("brand")
    chosen = df.join(F.broadcast(keys), "brand", "left_semi")
    return chosen.groupBy("brand").agg(mean_money("price").alias("avg_price"),
                                       F.count(F.lit(1)).alias("count"))


# ---- A5-A9 -------------------------------------------------------------------

def value_counts(df: DataFrame, key: str) -> DataFrame:
    """A5: frequency per non-null key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def group_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count per key tuple."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def _long(df_one_row: DataFrame, names: Sequence[str], prefixes: Sequence[str],
          value_names: Sequence[str]) -> DataFrame:
    """Turn one wide row ``{prefix}_{name}`` into one row per name."""
    parts = []
    for n in names:
        fields = ", ".join(f"`{p}_{n}`" for p in prefixes)
        parts.append(f"'{n}', {fields}")
    expr = f"stack({len(names)}, {', '.join(parts)}) as (column_name, {', '.join(value_names)})"
    return df_one_row.selectExpr(expr)


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Non-null, null and zero counts per column in one scan."""
    columns = list(columns or df.columns)
    numeric = {f.name for f in df.schema.fields
               if f.dataType.typeName() in ("integer", "long", "double", "float", "decimal", "short")}
    aggs = []
    for c in columns:
        aggs.append(F.count(F.col(c)).alias(f"nn_{c}"))
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"null_{c}"))
        zero = F.count_if(F.col(c) == 0) if c in numeric else F.lit(0).cast("bigint")
        aggs.append(zero.alias(f"zero_{c}"))
    aggs.append(F.count(F.lit(1)).alias("_rows"))
    wide = df.agg(*aggs)
    long = _long(wide.drop("_rows"), columns, ["nn", "null", "zero"],
                 ["non_null", "nulls", "zeros"])
    return long.crossJoin(wide.select("_rows")).select(
        "column_name", "non_null", "nulls", "zeros",
        F.round(F.col("nulls") / F.col("_rows") * 100, 6).alias("null_pct"),
        F.round(F.col("zeros") / F.col("_rows") * 100, 6).alias("zero_pct"))


def nunique(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct non-null values per column.  One column at a time (each
    reads only its own column and combines map-side), instead of one
    aggregation that copies every row once per column."""
    columns = list(columns or df.columns)
    out = None
    for c in columns:
        one = df.where(F.col(c).isNotNull()).select(c).distinct().agg(F.count(F.lit(1)).alias("n_unique")).select(
            F.lit(c).alias("column_name"), "n_unique")
        out = one if out is None else out.unionByName(one)
    return out


# ---- A10, P21 ----------------------------------------------------------------

def describe(df: DataFrame, c: str) -> DataFrame:
    """A10: mean / median / min / max / p5 / p95 (exact, linear interpolation)."""
    p05, median, p95 = exact_quantiles(df, {c: (0.05, 0.5, 0.95)})[c] or (None, None, None)
    number = lambda x: F.round(F.lit(x).cast("double"), 6)
    return (df.agg(F.avg(c).alias("_mean"), F.min(c).alias("min"), F.max(c).alias("max"), F.count(c).alias("count"))
              .select("count", F.round("_mean", 6).alias("mean"), number(median).alias("median"),
                      F.col("min").cast("double").alias("min"), F.col("max").cast("double").alias("max"),
                      number(p05).alias("p05"), number(p95).alias("p95")))


def price_bands(df: DataFrame, thresholds: Sequence[int] = (20_000, 30_000, 40_000),
                target: str = "price") -> DataFrame:
    """Counts above each threshold and inside each [200, t] range, one pass."""
    aggs = []
    for t in thresholds:
        aggs.append(F.count_if(F.col(target) > t).alias(f"above_{t}"))
        aggs.append(F.count_if(F.col(target).between(C.PRICE_MIN, t)).alias(f"within_{t}"))
    return df.agg(F.count(F.lit(1)).alias("rows"), *aggs)


# ---- A12 -------------------------------------------------------------------

def histogram(df: DataFrame, c: str, bins: int) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin is right-closed.

    Two passes: a global min/max (one row) and a grouped count keyed by the
    bin index; the one-row bounds frame is broadcast.
    """
    bounds = df.agg(F.min(c).cast("double").alias("_lo"), F.max(c).cast("double").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    idx = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col(c) - F.col("_lo")) / width), F.lit(bins - 1))).cast("int")
    binned = (df.where(F.col(c).isNotNull()).select(c).crossJoin(F.broadcast(bounds))
                .select(idx.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(binned, "bin", "left").crossJoin(F.broadcast(bounds))
                .select("bin",
                        F.round(F.col("_lo") + F.col("bin") * width, 6).alias("bin_start"),
                        F.round(F.col("_lo") + (F.col("bin") + 1) * width, 6).alias("bin_end"),
                        F.coalesce(F.col("count"), F.lit(0)).alias("count")))


# ---- A18, A22 ----------------------------------------------------------------

def facets(df: DataFrame, as_of_year: int) -> DataFrame:
    """A18 + A22: the bounds and choices of the request form per model --
    vehicle and fuel types (sorted distinct), gearbox mode (smallest on ties),
    power range with its cap; kilometre and year ranges are those of all
    listings, capped and up to ``as_of_year``.

    ``collect_set`` is bounded by the number of *distinct* category values
    (tens), never by rows; the whole-table bounds are one row.
    """
    per_model = df.groupBy("model").agg(
        F.array_sort(F.collect_set("vehicleType")).alias("vehicle_types"),
        F.array_sort(F.collect_set("fuelType")).alias("fuel_types"),
        F.mode("gearbox", deterministic=True).alias("gearbox_mode"),
        F.min("powerPS").cast("int").alias("min_power"),
        F.least(F.max("powerPS"), F.lit(float(C.FACET_POWER_CAP))).cast("int").alias("max_power"),
        F.count(F.lit(1)).alias("listings"),
    )
    whole = df.agg(F.min("kilometer").cast("int").alias("min_km"),
                   F.least(F.max("kilometer"), F.lit(float(C.FACET_KM_CAP))).cast("int").alias("max_km"),
                   F.min("yearOfRegistration").alias("min_year"), F.lit(as_of_year).alias("max_year"))
    return per_model.crossJoin(F.broadcast(whole))  # one row


def brand_models(df: DataFrame) -> DataFrame:
    """Sorted distinct models per brand."""
    return df.where(F.col("model").isNotNull()).groupBy("brand").agg(
        F.array_sort(F.collect_set("model")).alias("models"))


# ---- W5 ---------------------------------------------------------------------

def top_per_group(df: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """The k most frequent ``key`` values within each ``group``."""
    counts = df.where(F.col(key).isNotNull()).groupBy(group, key).agg(
        F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy(group).orderBy(F.col("count").desc(), F.col(key).asc())
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ---- P20 ---------------------------------------------------------------------

def canonical(df: DataFrame, c: str) -> Column:
    """A column as text that every engine renders the same way: strings as
    they are, integers in decimal, fractional numbers as integer hundredths."""
    t = df.schema[c].dataType.typeName()
    if t in ("double", "float", "decimal"):
        return cents(c).cast("string")
    return F.col(c).cast("string")


def sample_k(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """P20: ``min(k, n)`` rows chosen by a seeded row hash.

    The ``limit`` is the feature; ordering by a hash keeps it deterministic
    and runs as a distributed top-k (TakeOrderedAndProject).  The hash is
    ``md5`` of the seed and the row's canonical text, so the same rows are
    chosen whatever the engine or partitioning; ties fall to the columns.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[canonical(df, c) for c in df.columns])
    order = [F.col("_h"), *[F.col(c).asc_nulls_first() for c in df.columns]]
    return df.withColumn("_h", F.md5(text)).orderBy(*order).limit(k).drop("_h")


# ---- S3, T6 ------------------------------------------------------------------

def db_slice(df_stored: DataFrame, min_year: int = 2010, n: int = 1000) -> DataFrame:
    """S3: project + rename back to camelCase + ``year >= min_year`` +
    ``LIMIT n`` with a total order so the slice is deterministic."""
    out = df_stored.where(F.col("year_of_registration") >= min_year).select(
        "brand", "model", F.col("vehicle_type").alias("vehicleType"),
        F.col("fuel_type").alias("fuelType"), F.col("power_ps").alias("powerPS"),
        "kilometer", F.col("year_of_registration").alias("yearOfRegistration"),
        "gearbox", F.col("not_repaired_damage").alias("notRepairedDamage"), "price")
    return out.orderBy(*[F.col(c).asc_nulls_first() for c in out.columns]).limit(n)

"""Comparable listings (J2, T4, W5) and the price verdict.

A request matches listings of the same brand and model whose power lies in
[0.3 p, 1.3 p] and kilometres in [0.3 k, 1.3 k].  Plan:

1. listings are pre-aggregated to *cells* (brand, model, power, km) with
   count and integer-cent price sum, and the 10 cheapest rows per cell are
   kept by ``row_number() <= 10`` (map-side ``WindowGroupLimit``);
2. each request's band is expanded to the log-scale bins it overlaps
   (a handful per dimension) and joined to the cells on
   (brand, model, power bin, km bin) -- an equi join, so a popular
   (brand, model) never pairs every request with every cell;
3. the exact band is a residual filter; sums over matched cells give count
   and mean.  The cheapest 10 rows of a request lie in the matched cells
   whose minimum price ranks within the first 10 (a cell ranked lower has 10
   rows at or below its price ahead of it, ties kept).  The ranks are taken side
   by side, as the sums are: first over the kilometres, once per power of a
   (brand, model) and asked kilometre value, then over the powers of a request,
   which so meets at most the first cells of each power.  Of the cell with rank
   c only the first ``10 - c + 1`` rows are expanded (each cheaper cell has a
   row ahead of them) before the final ``row_number() <= 10``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from .market import cents

BIN_RATIO = 1.5
ZERO_BIN = -(10 ** 6)
_EPS = 1e-9

DISPLAY = ["powerPS", "kilometer", "vehicleType", "fuelType", "yearOfRegistration", "price"]
TIE_ORDER = ["price", "powerPS", "kilometer", "vehicleType", "fuelType", "yearOfRegistration",
             "gearbox", "notRepairedDamage"]


def _bin(c: Column) -> Column:
    """Log-scale bin of a non-negative value; values <= 0 share one bin."""
    return F.when(c > 0, F.floor(F.log(c) / math.log(BIN_RATIO))).otherwise(F.lit(ZERO_BIN)).cast("long")


def _bin_range(v: Column, lo_f: float, hi_f: float) -> Column:
    """Bins overlapped by [lo_f * v, hi_f * v] (one extra-safe step each side
    of a floating boundary); empty when the band is empty."""
    lo = F.floor(F.log(v * lo_f) / math.log(BIN_RATIO) - _EPS).cast("long")
    hi = F.floor(F.log(v * hi_f) / math.log(BIN_RATIO) + _EPS).cast("long")
    return (F.when(v > 0, F.sequence(lo, hi))
             .when(v == 0, F.array(F.lit(ZERO_BIN).cast("long")))
             .otherwise(F.array().cast("array<long>")))


def listing_cells(listings: DataFrame, k: int = C.SIMILAR_TOP_K):
    """(cells, top rows per cell) of the listing side."""
    key = ["brand", "model", "powerPS", "kilometer"]
    cells = (listings.groupBy(*key)
                     .agg(F.count(F.lit(1)).alias("_n"), F.sum(cents("price")).alias("_cents"),
                          # as a struct a missing price counts as the least, as it ranks
                          F.min(F.struct("price")).alias("_minkey"))
                     .withColumn("_pb", _bin(F.col("powerPS")))
                     .withColumn("_kb", _bin(F.col("kilometer"))))
    w = Window.partitionBy(*key).orderBy(*[F.col(c).asc() for c in TIE_ORDER])
    top = (listings.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
                   .select(*key, *[c for c in TIE_ORDER if c not in key], "_r"))
    return cells, top


def matched_cells(requests: DataFrame, cells: DataFrame,
                  lo_f: float = C.SIMILAR_LOW, hi_f: float = C.SIMILAR_HIGH) -> DataFrame:
    """(request, cell) pairs inside the band, via the binned equi join."""
    p, km = F.col("req_powerPS"), F.col("req_kilometer")
    probes = (requests
              .withColumn("_pb", F.explode(_bin_range(p, lo_f, hi_f)))
              .withColumn("_kb", F.explode(_bin_range(km, lo_f, hi_f))))
    c = cells.select(F.col("brand").alias("_cb"), F.col("model").alias("_cm"), "powerPS",
                     "kilometer", "_n", "_cents", "_minkey", F.col("_pb").alias("_cpb"),
                     F.col("_kb").alias("_ckb"))
    cond = [F.col("brand") == F.col("_cb"), F.col("model") == F.col("_cm"),
            F.col("_pb") == F.col("_cpb"), F.col("_kb") == F.col("_ckb")]
    # both sides grow with the data, and a static size estimate does not see
    # the explodes: a sort-merge join, which can spill on either side
    joined = probes.join(c.hint("merge"), cond)
    band = (F.col("powerPS").between(p * F.lit(lo_f), p * F.lit(hi_f))
            & F.col("kilometer").between(km * F.lit(lo_f), km * F.lit(hi_f)))
    return joined.where(band).select("brand", "model", "req_powerPS", "req_kilometer",
                                     "powerPS", "kilometer", "_n", "_cents", "_minkey")


def distinct_requests(listings: DataFrame) -> DataFrame:
    """Every distinct listed car spec as a request (brand, model, power, km)."""
    return (listings.select("brand", "model", F.col("powerPS").alias("req_powerPS"),
                            F.col("kilometer").alias("req_kilometer")).distinct())


REQ_KEY = ["brand", "model", "req_powerPS", "req_kilometer"]


def similar_listings(listings: DataFrame, requests: DataFrame,
                     k: int = C.SIMILAR_TOP_K) -> DataFrame:
    """The ``k`` cheapest comparable listings per request."""
    cells, top = listing_cells(listings, k)
    # The k cheapest rows lie in the cells whose cheapest price ranks within
    # the first k (``rank`` keeps every cell tied at the boundary), in the strip
    # of each power as in the whole band.
    def first(cells: DataFrame, *key: str) -> DataFrame:
        cheapest = F.rank().over(Window.partitionBy(*key).orderBy("_minkey"))
        return cells.withColumn("_cr", cheapest).where(F.col("_cr") <= k)

    kilometres = requests.select("brand", "model", "req_kilometer").distinct()
    strip = ["brand", "model", "req_kilometer", "powerPS"]
    strips = (first(_in_band(kilometres, cells, "kilometer", ["brand", "model"]), *strip)
              .groupBy(*strip).agg(F.collect_list(F.struct("kilometer", "_minkey")).alias("_cells")))
    m = _in_band(requests.select(*REQ_KEY), strips, "powerPS", ["brand", "model", "req_kilometer"])
    m = first(m.select(*REQ_KEY, "powerPS", F.inline("_cells")), *REQ_KEY).drop("_minkey")
    # c - 1 cells have a cheaper row, and r - 1 rows of its cell come before a row
    cand = (m.join(top, ["brand", "model", "powerPS", "kilometer"]).where(F.col("_cr") + F.col("_r") <= k + 1)
            .drop("_cr", "_r"))
    w = Window.partitionBy(*REQ_KEY).orderBy(*[F.col(c).asc() for c in TIE_ORDER])
    ranked = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("brand", "model", "req_powerPS", "req_kilometer", "rank", *DISPLAY)


def _match_sums(listings: DataFrame, requests: DataFrame) -> DataFrame:
    """Count and cent sum of all comparables, per request that has any.

    The band is a rectangle, so its sums are taken side by side: first over the
    kilometres, once per power of a (brand, model) and asked kilometre value,
    then over the powers of a request.  A request so meets the powers of its band
    instead of all its cells."""
    cells, _ = listing_cells(listings)
    kilometres = requests.select("brand", "model", "req_kilometer").distinct()
    strips = (_in_band(kilometres, cells, "kilometer", ["brand", "model"])
              .groupBy("brand", "model", "req_kilometer", "powerPS")
              .agg(F.sum("_n").alias("_n"), F.sum("_cents").alias("_cents")))
    m = _in_band(requests.select(*REQ_KEY), strips, "powerPS", ["brand", "model", "req_kilometer"])
    return m.groupBy(*REQ_KEY).agg(F.sum("_n").alias("_ns"), F.sum("_cents").alias("_c"))


def _in_band(requests: DataFrame, cells: DataFrame, side: str, key: list[str],
             lo_f: float = C.SIMILAR_LOW, hi_f: float = C.SIMILAR_HIGH) -> DataFrame:
    """Requests joined with the cells of equal ``key`` whose ``side`` lies in the
    request's band, as an equi join on its log-scale bins."""
    v = F.col(f"req_{side}")
    probes = requests.withColumn("_bin", F.explode(_bin_range(v, lo_f, hi_f)))
    c = cells.withColumn("_bin", _bin(F.col(side)))
    # see matched_cells
    return probes.join(c.hint("merge"), [*key, "_bin"]).where(F.col(side).between(v * F.lit(lo_f), v * F.lit(hi_f)))


def _summary_cols() -> list[Column]:
    n = F.coalesce("_ns", F.lit(0)).cast("bigint")
    return [n.alias("n_similar"), (F.col("_c") / (F.col("_ns") * F.lit(100.0))).alias("avg_similar_price")]


def similar_summary(listings: DataFrame, requests: DataFrame) -> DataFrame:
    """A20 part: number and mean price of *all* comparables per request."""
    agg = _match_sums(listings, requests)
    return (requests.join(agg, REQ_KEY, "left")
               .select("brand", "model", "req_powerPS", "req_kilometer", *_summary_cols()))


def verdict(pred: Column, avg: Column, close: float = C.VERDICT_CLOSE) -> Column:
    diff = pred - avg
    return (F.when(avg.isNull(), F.lit(None).cast("string"))
             .when(F.abs(diff) < close, "close").when(diff > 0, "higher").otherwise("lower"))


def price_verdict(listings: DataFrame, asking: DataFrame, price_col: str = "price") -> DataFrame:
    """Compare a price per row of ``asking`` (brand, model, powerPS,
    kilometer, price...) with the mean of its comparables."""
    reqs = asking.select("brand", "model", F.col("powerPS").alias("req_powerPS"),
                         F.col("kilometer").alias("req_kilometer")).distinct()
    sums = _match_sums(listings, reqs).withColumnRenamed("req_powerPS", "powerPS") \
                                      .withColumnRenamed("req_kilometer", "kilometer")
    # requests without any comparable simply find no row here (count 0)
    out = asking.join(sums, ["brand", "model", "powerPS", "kilometer"], "left") \
                .select(*asking.columns, *_summary_cols())
    return out.select(*asking.columns, "n_similar", "avg_similar_price",
                      (F.col(price_col) - F.col("avg_similar_price")).alias("price_diff"),
                      verdict(F.col(price_col), F.col("avg_similar_price")).alias("verdict"))


def requests_frame(spark, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), "brand string, model string, req_powerPS double, req_kilometer double")

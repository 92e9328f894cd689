"""Statistical reductions: box statistics, density, correlations, moments,
outlier counts and trend lines (A11, A13-A17, A23, A25).

Scale rules used throughout:

* pre-aggregate by value (``groupBy(value).count()``) before any per-value
  work, so cost follows the number of distinct values, not rows;
* global orderings (ranks, running counts) use ``ordered_prefix``: the
  distinct values are split into value ranges, each range is scanned in
  order and range totals become offsets -- no single-partition window;
* exact quantiles come from value counts and the same prefix sums
  (``exact_quantiles``, ``group_quantiles``): no buffer of all distinct values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..session import ensure_checkpoint_dir, stored


# ---- distributed exclusive prefix sums ------------------------------------------

def ordered_prefix(df: DataFrame, order_col: str, value_cols: Sequence[str],
                   partitions: int | None = None,
                   cuts: Sequence[float] | None = None, groups: Sequence[str] = ()) -> DataFrame:
    """Add ``cum_<v>`` = sum of ``v`` over rows with a smaller ``order_col``
    (of the same ``groups``, if any).

    ``df`` must hold one row per distinct ``order_col`` value (and group).  Cut points
    for ``n`` ranges are taken once with ``approxQuantile`` (``n - 1``
    values on the driver), so the range tag of a row is a pure expression
    and every branch of the plan agrees on it.  Each range's running sum is
    a window over that range only; per-range totals (one row per range)
    become offsets.  Non-numeric keys fall back to ``repartitionByRange``
    with a reliable checkpoint fixing the sampled tag.  ``cuts`` may be
    passed in (any sorted values: they only tag ranges, correctness does not
    depend on them), e.g. from one ``approxQuantile`` over several columns.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    numeric = df.schema[order_col].dataType.typeName() in (
        "integer", "long", "double", "float", "short", "decimal")
    if numeric:
        if cuts is None:
            probs = [i / n for i in range(1, n)]
            cuts = df.approxQuantile(order_col, probs, 1.0 / (4 * n)) if n > 1 else []
        cuts = sorted(set(cuts))
        arr = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
        pid = F.size(F.filter(arr, lambda c: c < F.col(order_col).cast("double")))
        tagged = df.withColumn("_pid", pid)
    else:
        ensure_checkpoint_dir(spark)
        tagged = (df.repartitionByRange(n, order_col)
                    .withColumn("_pid", F.spark_partition_id())).checkpoint(eager=True)
    groups = list(groups)
    totals = tagged.groupBy(*groups, "_pid").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    w_tot = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, "_pid", *[F.coalesce(F.sum(f"_t_{v}").over(w_tot), F.lit(0))
                                     .alias(f"_o_{v}") for v in value_cols])
    w = Window.partitionBy(*groups, "_pid").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.select("*", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"_l_{v}")
                                 for v in value_cols])
    # without groups, offsets hold one row per range: a bounded broadcast
    out = local.join(offsets if groups else F.broadcast(offsets), [*groups, "_pid"])
    return out.select(*df.columns, *[(F.col(f"_o_{v}") + F.col(f"_l_{v}")).alias(f"cum_{v}")
                                     for v in value_cols])


_NUMERIC = ("integer", "long", "double", "float", "short", "decimal", "byte")


def average_rank(df: DataFrame, c: str, cuts: Sequence[float] | None = None) -> DataFrame:
    """Distinct values of ``c`` with their average (tie) rank, 1-based."""
    counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
    pre = ordered_prefix(stored(counts, "counts"), c, ["_n"], cuts=cuts)
    return pre.select(c, (F.col("cum__n") + (F.col("_n") + 1) / 2.0).alias(f"rank_{c}"))


def shared_cuts(df: DataFrame, columns: Sequence[str]) -> dict[str, list[float]]:
    """Range cut points for every numeric column from one ``approxQuantile``
    pass over the rows (one job instead of one per column)."""
    num = [c for c in columns if df.schema[c].dataType.typeName() in _NUMERIC]
    if not num:
        return {}
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n <= 1:
        return {c: [] for c in num}
    probs = [i / n for i in range(1, n)]
    qs = df.select(*[F.col(c).cast("double").alias(c) for c in num]).approxQuantile(num, probs, 1.0 / (4 * n))
    return dict(zip(num, qs))


# ---- exact quantiles -------------------------------------------------------------

def exact_quantiles(df: DataFrame, probs: dict[str, Sequence[float]]) -> dict[str, list[float] | None]:
    """Exact quantiles (linear interpolation) of several numeric columns;
    None for a column without values.

    The (column, value) counts of all columns are stored once; running counts
    come from ``ordered_prefix``, and only the values at the wanted positions
    (two per level) reach the driver.
    """
    columns = list(probs)
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v"))
                                for i, c in enumerate(columns)]))
    counts = stored(df.select(pairs.alias("p")).select("p.*").where("_v is not null").groupBy("_c", "_v")
                    .agg(F.count(F.lit(1)).alias("_n")), "counts")
    totals = {r["_c"]: r["n"] for r in counts.groupBy("_c").agg(F.sum("_n").alias("n")).collect()}  # a row a column
    at = {i: [(totals[i] - 1) * p for p in probs[columns[i]]] for i in totals}
    wanted = {i: sorted({x for h in hs for x in (math.floor(h), math.ceil(h))}) for i, hs in at.items()}
    found: dict[tuple[int, int], float] = {}
    if wanted:
        places = F.create_map(*[x for i, w in wanted.items() for x in (
            F.lit(i), F.array(*[F.lit(v).cast("long") for v in w]))])
        pos = ordered_prefix(counts, "_v", ["_n"], groups=["_c"])
        inside = F.filter(places[F.col("_c")], lambda i: (i >= F.col("cum__n")) & (i < F.col("cum__n") + F.col("_n")))
        found = {(r["_c"], r["i"]): r["_v"] for r in pos.select("_c", "_v", F.explode(inside).alias("i")).collect()}
    out: dict[str, list[float] | None] = {}
    for i, c in enumerate(columns):
        out[c] = [found[i, math.floor(h)] * (1 - (h - math.floor(h))) + found[i, math.ceil(h)] * (h - math.floor(h))
                  for h in at[i]] if i in totals else None
    return out


def group_quantiles(counts: DataFrame, value: str, groups: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Exact quantiles per group from value counts (``groups``, ``value``,
    ``_n``): one column per entry of ``probs``, and ``count``."""
    groups = list(groups)
    pos = ordered_prefix(counts, value, ["_n"], groups=groups)
    rows = pos.join(counts.groupBy(*groups).agg(F.sum("_n").alias("_total")), groups)
    v, first = F.col(value).cast("double"), F.col("cum__n")
    aggs = [F.first("_total").alias("count")]
    for name, p in probs.items():
        h = (F.col("_total") - 1) * F.lit(float(p))
        for part, place in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            here = (first <= place) & (place < first + F.col("_n"))
            aggs.append(F.min(F.when(here, v)).alias(f"_{part}_{name}"))
    out = rows.groupBy(*groups).agg(*aggs)
    share = {n: (F.col("count") - 1) * F.lit(float(p)) - F.floor((F.col("count") - 1) * F.lit(float(p)))
             for n, p in probs.items()}
    return out.select(*groups, "count", *[
        (F.col(f"_lo_{n}") * (1 - share[n]) + F.col(f"_hi_{n}") * share[n]).alias(n) for n in probs])


# ---- A11 box statistics ---------------------------------------------------------

def box_stats(df: DataFrame, value: str, group: str | Sequence[str], factor: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (most extreme values inside q +- factor*IQR) and
    outlier count per group, all from the (group, value) counts."""
    groups = [group] if isinstance(group, str) else list(group)
    counts = stored(df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n")), "counts")
    q = group_quantiles(counts, value, groups, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    q = q.withColumn("_lo", F.col("q1") - factor * (F.col("q3") - F.col("q1"))) \
         .withColumn("_hi", F.col("q3") + factor * (F.col("q3") - F.col("q1")))
    v = F.col(value).cast("double")
    inside = (v >= F.col("_lo")) & (v <= F.col("_hi"))
    ext = (counts.join(q.select(*groups, "_lo", "_hi"), groups)
               .groupBy(*groups)
               .agg(F.min(F.when(inside, v)).alias("whisker_low"),
                    F.max(F.when(inside, v)).alias("whisker_high"),
                    F.sum(F.when(inside, 0).otherwise(F.col("_n"))).alias("outliers")))
    return q.join(ext, groups).select(
        *groups, "count", F.round("q1", 6).alias("q1"), F.round("median", 6).alias("median"),
        F.round("q3", 6).alias("q3"), F.round("whisker_low", 6).alias("whisker_low"),
        F.round("whisker_high", 6).alias("whisker_high"), "outliers")


# ---- A13 kernel density --------------------------------------------------------

def kde(df: DataFrame, c: str, grid: int = 200) -> DataFrame:
    """Gaussian KDE on ``grid`` equally spaced points over [min, max] with
    Scott's bandwidth ``h = stddev_samp * n^(-1/5)``.

    Values are pre-aggregated to (value, count); each distinct value emits
    its contribution to the fixed grid with ``explode(sequence)``, then one
    grouped sum per grid point.
    """
    vals = df.where(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("x"))
    stats = vals.agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("x").alias("_sd"),
                     F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    stats = stats.withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    counts = vals.groupBy("x").agg(F.count(F.lit(1)).alias("_k"))
    step = (F.col("_hi") - F.col("_lo")) / (grid - 1)
    pts = (counts.crossJoin(F.broadcast(stats))  # one-row frame
                 .select("x", "_k", "_n", "_h", "_lo", step.alias("_step"),
                         F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i")))
    g = F.col("_lo") + F.col("i") * F.col("_step")
    z = (g - F.col("x")) / F.col("_h")
    contrib = F.col("_k") * F.exp(-0.5 * z * z)
    dens = pts.groupBy("i").agg(
        F.first(g).alias("grid_x"),
        (F.sum(contrib) / (F.first("_n") * F.first("_h") * math.sqrt(2 * math.pi))).alias("_d"))
    return dens.select(F.col("i").alias("point"), F.round("grid_x", 6).alias("x"),
                       F.round("_d", 12).alias("density"))


# ---- A14-A16 correlations -----------------------------------------------------

def corr_pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson matrix in long form (one aggregation)."""
    cols = list(columns)
    aggs = [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c_{i}_{j}")
            for i, a in enumerate(cols) for j, b in enumerate(cols) if j < i]
    wide = df.agg(*aggs)
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                val = "CAST(1.0 AS DOUBLE)"
            else:
                val = f"c_{max(i, j)}_{min(i, j)}"
            rows.append(f"'{a}', '{b}', {val}, {str(i > j).lower()}")
    expr = f"stack({len(rows)}, {', '.join(rows)}) as (col_a, col_b, corr, lower_triangle)"
    return wide.selectExpr(expr).select("col_a", "col_b", F.round("corr", 6).alias("corr"),
                                        "lower_triangle")


def corr_spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spearman = Pearson on average ranks (ranks from ``ordered_prefix``).

    Rows are first aggregated to distinct value tuples, so ranks are joined to
    tuples, not rows.  Columns without nulls share one ranking; a pair with a
    null in either column is ranked on the rows complete for that pair.
    """
    cols = list(columns)
    tuples = stored(df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_w")), "tuples")
    nulls = tuples.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    full = [c for c in cols if not nulls[c]]
    cuts = shared_cuts(df, cols)

    def ranks(rows: DataFrame, names: Sequence[str]) -> DataFrame:
        out = rows
        for c in names:
            counts = rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.sum("_w").alias("_n"))
            pre = ordered_prefix(counts, c, ["_n"], cuts=cuts.get(c))
            rank = pre.select(F.col(c).alias("_v"), (F.col("cum__n") + (F.col("_n") + 1) / 2.0).alias(f"rank_{c}"))
            out = out.join(rank, F.col(c) == F.col("_v")).drop("_v")
        return out

    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[:i]]
    shared = [p for p in pairs if p[0] in full and p[1] in full]
    one = [_weighted_corr(ranks(tuples, full), shared)] if shared else []
    one += [_weighted_corr(ranks(tuples.where(F.col(a).isNotNull() & F.col(b).isNotNull()), (a, b)), [(a, b)])
            for a, b in pairs if (a, b) not in shared]
    wide = one[0]
    for more in one[1:]:
        wide = wide.crossJoin(more)  # one-row frames
    return _matrix(wide, cols)


def _weighted_corr(rows: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """One row with ``c_<a>__<b>``: Pearson of the rank columns, weight ``_w``."""
    names = sorted({c for p in pairs for c in p})
    w = F.col("_w").cast("double")
    means = rows.agg(*[(F.sum(w * F.col(f"rank_{c}")) / F.sum(w)).alias(f"_m_{c}") for c in names])
    j = rows.crossJoin(F.broadcast(means))  # one-row frame
    d = {c: F.col(f"rank_{c}") - F.col(f"_m_{c}") for c in names}
    return j.agg(*[(F.sum(w * d[a] * d[b]) / F.sqrt(F.sum(w * d[a] * d[a]) * F.sum(w * d[b] * d[b]))
                    ).alias(f"c_{a}__{b}") for a, b in pairs])


def _matrix(wide: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long symmetric matrix from one row with ``c_<a>__<b>`` (a after b)."""
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            hi, lo = (a, b) if i > j else (b, a)
            val = "CAST(1.0 AS DOUBLE)" if i == j else f"`c_{hi}__{lo}`"
            rows.append(f"'{a}', '{b}', {val}, {str(i > j).lower()}")
    expr = f"stack({len(rows)}, {', '.join(rows)}) as (col_a, col_b, corr, lower_triangle)"
    return wide.selectExpr(expr).select("col_a", "col_b", F.round("corr", 6).alias("corr"), "lower_triangle")


KENDALL_BASE = 16


def corr_kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall tau-b between any two orderable columns, exact for any
    cardinality and row count (``_kendall_pairs_by_digits``); no pair of rows
    or cells is ever materialised."""
    data = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    return _kendall_result(data, x, y, _kendall_pairs_by_digits(data, x, y))


def _kendall_result(data: DataFrame, x: str, y: str, pairs: DataFrame) -> DataFrame:
    """tau-b from the one-row (nc, nd) frame plus the tie counts of x and y."""
    def ties(c: str, name: str) -> DataFrame:
        return data.groupBy(c).agg(F.count(F.lit(1)).alias("t")).agg(
            F.sum(F.col("t").cast("decimal(38,0)") * (F.col("t") - 1).cast("decimal(18,0)")).alias(f"{name}2"),
            F.sum("t").alias(f"n_{name}")).select((F.col(f"{name}2").cast("double") / 2).alias(name), f"n_{name}")
    tx, ty = ties(x, "tx"), ties(y, "ty").drop("n_ty")
    return _kendall_tau(pairs.crossJoin(tx).crossJoin(ty), x, y)  # three one-row frames


def _kendall_tau(row: DataFrame, x: str, y: str) -> DataFrame:
    """Final projection of a one-row frame with nc, nd, tx, ty, n_tx."""
    d = [F.col(c).cast("double") for c in ("n_tx", "tx", "ty", "nc", "nd")]
    n0 = d[0] * (d[0] - 1) / 2
    tau = (d[3] - d[4]) / F.sqrt((n0 - d[1]) * (n0 - d[2]))
    # pair counts pass the bigint range beyond ~4.3e9 rows: exact decimals
    return row.select(
        F.lit(x).alias("col_a"), F.lit(y).alias("col_b"),
        F.col("nc").cast("decimal(38,0)").alias("concordant"),
        F.col("nd").cast("decimal(38,0)").alias("discordant"),
        F.round(tau, 6).alias("tau_b"))


def _dense_rank(data: DataFrame, c: str, name: str) -> DataFrame:
    """Distinct values of ``c`` with their 0-based dense rank ``name``."""
    vals = stored(data.select(c).distinct().withColumn("_one", F.lit(1).cast("long")), "values")
    return ordered_prefix(vals, c, ["_one"]).select(c, F.col("cum__one").alias(name))


def _kendall_pairs_by_digits(data: DataFrame, x: str, y: str,
                             base: int = KENDALL_BASE) -> DataFrame:
    """Exact concordant/discordant counts for an ``x`` of any cardinality.

    Write the dense rank d of x in ``base`` digits (m of them).  Two points
    with different x first differ at one digit position l: they share the
    higher digits (their *group* g) and differ at digit l.  Level l pivots
    the cells (g, y) on that digit, so it is the low-cardinality algorithm
    applied inside every group at once.  The running counts per group come
    from one ``ordered_prefix`` over the composite key (g, rank of y) --
    groups are contiguous in that order, so the counts of earlier groups are
    a per-group offset, and their contribution is removed with group-level
    sums (one row per group), never by a window over a whole group.  Sums
    are exact decimals.
    """
    cells = stored(data.groupBy(x, y).agg(F.count(F.lit(1)).alias("_n")), "cells")
    rx, ry = _dense_rank(cells, x, "_dx"), _dense_rank(cells, y, "_ry")
    n_x, n_y = rx.count(), ry.count()
    m = 1
    while base ** m < n_x:
        m += 1
    ranked = stored(cells.join(rx, x).join(ry, y).select("_dx", "_ry", "_n"), "ranked")
    ranges = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def even(size: int) -> list[float]:
        """Cuts of a dense key 0..size-1 into equal ranges."""
        return sorted({float(size * i // ranges) for i in range(1, ranges)})
    names = [f"_c{i}" for i in range(base)]
    dec = "decimal(38,0)"
    parts = []
    for level in range(m):
        s = base ** (m - 1 - level)
        lvl = (ranked.select(F.floor(F.col("_dx") / (s * base)).cast("long").alias("_g"), "_ry",
                             (F.floor(F.col("_dx") / s) % base).cast("int").alias("_t"), "_n")
                     .groupBy("_g", "_ry").pivot("_t", list(range(base))).agg(F.sum("_n"))
                     .na.fill(0))
        lvl = lvl.toDF("_g", "_ry", *names).withColumn(
            "_key", F.col("_g") * F.lit(n_y) + F.col("_ry"))
        groups = -(-n_x // (s * base))
        pre = ordered_prefix(lvl, "_key", names, cuts=even(groups * n_y))
        c = [F.col(nm).cast(dec) for nm in names]
        b = [F.col(f"cum_{nm}").cast(dec) for nm in names]
        # rows: the same sums as the single-level path, with running counts
        # that still include every earlier group
        below, run = [], F.lit(0).cast(dec)
        for i in range(base):
            below.append(run)
            run = run + b[i]
        row_nc = sum((c[i] * below[i] for i in range(base)), F.lit(0).cast(dec))
        row_same = sum((c[i] * b[i] for i in range(base)), F.lit(0).cast(dec))
        row_ny = sum(c, F.lit(0).cast(dec))
        rows = pre.agg(F.sum(row_nc).alias("nc"), F.sum(row_same).alias("same"),
                       F.sum(row_ny * run).alias("nytb"))
        # groups: off_i(g) = points of earlier groups at digit i
        tot = lvl.groupBy("_g").agg(*[F.sum(nm).alias(nm) for nm in names])
        gp = ordered_prefix(tot, "_g", names, cuts=even(groups))
        t = [F.col(nm).cast(dec) for nm in names]
        off = [F.col(f"cum_{nm}").cast(dec) for nm in names]
        obelow, orun = [], F.lit(0).cast(dec)
        for i in range(base):
            obelow.append(orun)
            orun = orun + off[i]
        g_nc = sum((t[i] * obelow[i] for i in range(base)), F.lit(0).cast(dec))
        g_same = sum((t[i] * off[i] for i in range(base)), F.lit(0).cast(dec))
        g_ny = sum(t, F.lit(0).cast(dec))
        grp = gp.agg(F.sum(g_nc).alias("g_nc"), F.sum(g_same).alias("g_same"),
                      F.sum(g_ny * orun).alias("g_nytb"))
        nc = F.col("nc") - F.col("g_nc")
        nd = (F.col("nytb") - F.col("g_nytb")) - (F.col("same") - F.col("g_same")) - nc
        parts.append(rows.crossJoin(grp).select(nc.alias("nc"), nd.alias("nd")))  # one row each
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.agg(F.sum("nc").alias("nc"), F.sum("nd").alias("nd"))


# ---- A17 skewness ---------------------------------------------------------------

def skewness_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population (biased) skewness per column, long form."""
    wide = df.agg(*[F.skewness(F.col(c).cast("double")).alias(f"s_{c}") for c in columns])
    parts = ", ".join(f"'{c}', `s_{c}`" for c in columns)
    return wide.selectExpr(f"stack({len(columns)}, {parts}) as (column_name, skewness)") \
               .select("column_name", F.round("skewness", 6).alias("skewness"))


# ---- A23 outlier counts ---------------------------------------------------------

def iqr_bounds(df: DataFrame, columns: Sequence[str], factor: float = C.OUTLIER_FACTOR) -> DataFrame:
    """One-row frame with ``lo_<c>``/``hi_<c>`` for each column."""
    row = []
    for c, q in exact_quantiles(df, {c: (0.25, 0.75) for c in columns}).items():
        lo, hi = (None, None) if q is None else (q[0] - factor * (q[1] - q[0]), q[1] + factor * (q[1] - q[0]))
        row += [F.lit(lo).cast("double").alias(f"lo_{c}"), F.lit(hi).cast("double").alias(f"hi_{c}")]
    return df.sparkSession.range(1).select(*row)


def outlier_counts(df: DataFrame, columns: Sequence[str], factor: float = C.OUTLIER_FACTOR) -> DataFrame:
    b = iqr_bounds(df, columns, factor)
    joined = df.select(*columns).crossJoin(F.broadcast(b))  # one-row bounds frame
    aggs = []
    for c in columns:
        out = (F.col(c) < F.col(f"lo_{c}")) | (F.col(c) > F.col(f"hi_{c}"))
        aggs += [F.first(f"lo_{c}").alias(f"lo_{c}"), F.first(f"hi_{c}").alias(f"hi_{c}"),
                 F.count_if(out).alias(f"n_{c}")]
    wide = joined.agg(*aggs)
    parts = ", ".join(f"'{c}', `lo_{c}`, `hi_{c}`, `n_{c}`" for c in columns)
    return wide.selectExpr(f"stack({len(columns)}, {parts}) as (feature, lower, upper, outliers)") \
               .select("feature", F.round("lower", 6).alias("lower"),
                       F.round("upper", 6).alias("upper"), "outliers")


# ---- A25 OLS trend ---------------------------------------------------------------

def ols_trend(df: DataFrame, x: str, y: str, group: str) -> DataFrame:
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.regr_slope(F.col(y), F.col(x)), 6).alias("slope"),
        F.round(F.regr_intercept(F.col(y), F.col(x)), 6).alias("intercept"),
        F.round(F.regr_r2(F.col(y), F.col(x)), 6).alias("r2"))


# ---- A26 LOWESS trend ----------------------------------------------------------

BUCKETS = 1024


def lowess_trend(df: DataFrame, x: str, y: str, group: str, frac: float = 2 / 3,
                 grid: int = 50, robust_rounds: int = 0) -> DataFrame:
    """Local linear LOWESS per group on ``grid`` evenly spaced points over the
    group's x range.

    At each grid point x0 the bandwidth is the distance to the
    ``ceil(frac * n)``-th nearest observation (counting repeats); weights are
    tricube(d / h).  Observations are pre-aggregated, so each grid point pairs
    with the *distinct* x values of its group only (grid x distinct values,
    never observation pairs), in partial sums.

    Each of ``robust_rounds`` rounds interpolates the fit between the grid
    points, takes the residuals of all observations, and weighs them by the
    bisquare of the residual over six times the group's median absolute
    residual (counts of residual ranges, then only the range that holds the median
    in order; no group in one task) for the next fit.  A median of
    zero leaves the weights as they are; an observation beside a grid point
    that has lost all its weight keeps weight 1.
    """
    cells = stored(df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(group).isNotNull())
                   .groupBy(F.col(group), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
                   .agg(F.count(F.lit(1)).alias("_n")), "lowess")
    pts = stored(cells.groupBy(group, "_x").agg(F.sum("_n").alias("_n")), "lowess-x")
    rng = pts.groupBy(group).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.sum("_n").alias("_total"))
    steps = max(grid - 1, 1)
    g = (rng.select(group, "_total", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"),
                    "_lo", "_hi")
            .withColumn("x0", F.col("_lo") + F.col("point") * (F.col("_hi") - F.col("_lo")) / steps)
            .withColumn("_k", F.ceil(F.col("_total") * F.lit(frac))))
    points = stored(_with_bandwidth(pts, g, group), "lowess-grid")  # groups x grid rows
    fits = _local_fits(cells.withColumn("_r", F.lit(1.0)), points, group)
    for _ in range(robust_rounds):
        fits = _local_fits(_bisquare(cells, stored(fits, "lowess-fit"), group, steps), points, group)
    return fits.select(group, "point", F.round("x0", 6).alias("x"), F.round("fit", 6).alias("fitted"))


def _with_bandwidth(pts: DataFrame, g: DataFrame, group: str) -> DataFrame:
    """Grid points with ``_h``: distances fall into ``BUCKETS`` ranges, the
    counts of the ranges tell which one holds the k-th observation, and only its
    distances are put in order."""
    d = g.join(pts, group).withColumn("_d", F.abs(F.col("_x") - F.col("x0")))
    far = F.col("_hi") - F.col("_lo")
    d = d.withColumn("_b", F.when(far > 0, F.floor(F.col("_d") / far * BUCKETS)).otherwise(0))
    key = [group, "point"]
    upto = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (d.groupBy(*key, "_b", "_k").agg(F.sum("_n").alias("_m"))
              .withColumn("_before", F.coalesce(F.sum("_m").over(upto), F.lit(0)))
              .where((F.col("_before") < F.col("_k")) & (F.col("_before") + F.col("_m") >= F.col("_k")))
              .select(*key, "_b", "_before"))
    near = Window.partitionBy(*key).orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    h = (d.join(ranges, [*key, "_b"]).withColumn("_cum", F.col("_before") + F.sum("_n").over(near))
         .where(F.col("_cum") >= F.col("_k")).groupBy(*key).agg(F.min("_d").alias("_h")))
    return g.join(h, key)


def _local_fits(weighted: DataFrame, points: DataFrame, group: str) -> DataFrame:
    """``points`` with ``fit``, from cells with robustness weight ``_r``."""
    w = F.col("_n") * F.col("_r")
    pts = weighted.groupBy(group, "_x").agg(F.sum(w).alias("_w"), F.sum(w * F.col("_y")).alias("_wy"))
    dx = F.col("_x") - F.col("x0")
    d = F.abs(dx)
    u = F.when(F.col("_h") > 0, d / F.col("_h")).otherwise(F.when(d == 0, 0.0).otherwise(1.0))
    wt = F.when(u < 1, F.pow(1 - F.pow(u, 3), 3)).otherwise(F.lit(0.0))
    sums = points.join(pts, group).groupBy(*points.columns).agg(
        F.sum(wt * F.col("_w")).alias("s0"), F.sum(wt * F.col("_w") * dx).alias("s1"),
        F.sum(wt * F.col("_w") * dx * dx).alias("s2"), F.sum(wt * F.col("_wy")).alias("t0"),
        F.sum(wt * F.col("_wy") * dx).alias("t1"))
    den = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    slope = F.when(F.abs(den) > 1e-12, (F.col("s0") * F.col("t1") - F.col("s1") * F.col("t0")) / den) \
             .otherwise(F.lit(0.0))
    fit = F.when(F.col("s0") > 0, (F.col("t0") - slope * F.col("s1")) / F.col("s0"))
    return sums.withColumn("fit", fit).select(*points.columns, "fit")


def _bisquare(cells: DataFrame, fits: DataFrame, group: str, steps: int) -> DataFrame:
    """Cells with ``_r`` from their residuals to the interpolated fit.  The
    residuals are taken anew in each pass over the cells."""
    after = Window.partitionBy(group).orderBy("point")  # the grid points of a group
    spans = fits.select(group, F.col("point").alias("_p"), F.col("x0").alias("_x0"), F.col("fit").alias("_f0"),
                        F.lead("x0").over(after).alias("_x1"), F.lead("fit").over(after).alias("_f1"))
    ends = fits.groupBy(group).agg(F.first("_lo").alias("_a"), F.first("_hi").alias("_b"))
    far = F.col("_b") - F.col("_a")
    place = F.when(far > 0, F.least(F.floor((F.col("_x") - F.col("_a")) / far * steps), F.lit(steps))).otherwise(0)
    at = cells.join(ends, group).withColumn("_p", place.cast("int")).drop("_a", "_b").join(spans, [group, "_p"])
    share = F.when(F.col("_x1") > F.col("_x0"), (F.col("_x") - F.col("_x0")) / (F.col("_x1") - F.col("_x0"))).otherwise(0.0)
    fit = F.when(F.col("_x1").isNull() | (share <= 0), F.col("_f0")).otherwise(
        F.col("_f0") + share * (F.col("_f1") - F.col("_f0")))
    rows = at.select(group, "_x", "_y", "_n", F.abs(F.col("_y") - fit).alias("_e"))
    u = F.col("_e") / (6 * F.col("_s"))
    r = F.when(F.col("_s") > 0, F.when(u < 1, F.pow(1 - u * u, 2)).otherwise(0.0)).otherwise(1.0)
    median = stored(_group_median(rows, "_e", group), "lowess-median").withColumnRenamed("median", "_s")
    return rows.join(median, group, "left").select(group, "_x", "_y", "_n", F.coalesce(r, F.lit(1.0)).alias("_r"))


#: Ranges of ``_group_median`` per factor e of the value.
MEDIAN_RANGES = 256


def _group_median(rows: DataFrame, value: str, group: str) -> DataFrame:
    """Exact median of the non-negative ``value`` per group (weight ``_n``): the
    counts of logarithmic ranges tell which of them hold the middle, and only
    their values are put in order."""
    v = F.col(value)
    rows = rows.where(v.isNotNull()).select(group, v, "_n", F.when(F.isnan(v), F.lit(2 ** 63 - 1)).when(
        v > 0, F.floor(F.log(v) * MEDIAN_RANGES)).otherwise(F.lit(-10 ** 6)).cast("long").alias("_range"))
    counts = stored(rows.groupBy(group, "_range").agg(F.sum("_n").alias("_m")), "median-ranges")
    whole = Window.partitionBy(group)
    lo, hi = F.floor((F.col("_total") - 1) * 0.5), F.ceil((F.col("_total") - 1) * 0.5)
    holds = [(F.col("_before") <= p) & (p < F.col("_before") + F.col("_m")) for p in (lo, hi)]
    middle = stored(
        counts.withColumn("_total", F.sum("_m").over(whole))
        .withColumn("_before", F.coalesce(F.sum("_m").over(
            whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .where(holds[0] | holds[1]).groupBy(group).agg(
            F.min("_range").alias("_first"), F.max("_range").alias("_last"), F.min("_before").alias("_before"),
            F.first("_total").alias("_total")), "median-middle")
    near = stored(rows.join(middle.select(group, "_first", "_last"), group)
                  .where(F.col("_range").between(F.col("_first"), F.col("_last")))
                  .groupBy(group, value).agg(F.sum("_n").alias("_n")), "median-values")
    ordered = ordered_prefix(near, value, ["_n"], groups=[group]).join(middle.select(group, "_before", "_total"), group)
    start = F.col("_before") + F.col("cum__n")
    ends = ordered.groupBy(group).agg(*[F.min(F.when((start <= p) & (p < start + F.col("_n")), v)).alias(name)
                                        for name, p in (("_v0", lo), ("_v1", hi))], F.first("_total").alias("_total"))
    share = (F.col("_total") - 1) * 0.5 - lo
    return ends.select(group, (F.col("_v0") * (1 - share) + F.col("_v1") * share).alias("median"))

"""Mixing sources to target weights.

Sources in code-point order (null last) weigh 5, 2, 1 in turn and share all
words; a target stops at three times its source, the excess is shared again by
weight.  Inside a source documents stand in the order of a hash key; the mix
takes whole epochs and then the prefix of that order whose words fill the rest
of the budget exactly (the last document is taken in part).

The prefix sums are distributed: keys are cut into ``BUCKETS`` key ranges, the
ranges of a source are summed and accumulated (at most ``BUCKETS`` rows a
source), and only the one range that holds the cut is sorted by document.  The
driver sees three totals a round of the target shares and nothing else.

Defined results: null or empty text has size 0 and takes 0; a source of size 0
has target 0; null sources are one source, the last; repeated rows are separate
documents with equal keys and may differ only where the cut falls between them;
an empty table gives an empty result; columns of ``docs`` named like a result
column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marktwert.llm import common as C

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def _key(id_col: str, seed: int) -> F.Column:
    return F.md5(F.encode(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), "utf-8"))


def ranked(spark: SparkSession, df: DataFrame, *order) -> DataFrame:
    """``df`` with ``_rank`` (from 0) in a global order, without one task that
    reads all rows: rows inside ranges, then one offset per range."""
    ranges = C.store(spark, df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy("_range").count()
    offsets = sums.select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return (ranges.withColumn("_in", inside).join(F.broadcast(offsets), "_range")
            .withColumn("_rank", F.col("_in") + F.col("_offset")).drop("_in", "_offset", "_range"))


def targets(spark: SparkSession, sizes: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Target words of each source: ``sizes`` has ``source``, ``source_size``.

    Rounds of two aggregates each fix the sources whose share exceeds
    ``most`` times their size; exact integers throughout.
    """
    turn = F.col("_rank") % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int"))
    rows = C.store(spark, ranked(spark, sizes, F.col("source").asc_nulls_last())
                   .select("source", "source_size", weight.cast("long").alias("weight")), "weights")
    exact = "decimal(38,0)"
    total = int(rows.agg(F.sum("source_size")).first()[0] or 0)
    left, share, full = total, None, F.lit(False)
    bound = F.col("source_size").cast(exact) * most
    while True:
        open_weight = int(rows.where(~full).agg(F.sum("weight")).first()[0] or 0)
        if not open_weight:
            break
        share = (left, open_weight)
        full_now = bound.cast(exact) * F.lit(open_weight).cast("decimal(18,0)") < (
            F.col("weight").cast(exact) * F.lit(left).cast("decimal(18,0)"))
        now_left = total - int(rows.where(full_now).agg(F.sum(bound)).first()[0] or 0)
        full = full_now
        if now_left == left:
            break
        left = now_left
    left, open_weight = share or (0, 1)
    by_weight = F.col("weight").cast("double") * F.lit(float(left)) / F.lit(float(open_weight))
    floor = F.expr(f"cast(cast(weight as decimal(18,0)) * cast({left} as decimal(19,0)) div {open_weight} as bigint)")
    return rows.select("source", "source_size", F.when(full, (F.col("source_size") * most).cast("double"))
                       .otherwise(by_weight).alias("target"),
                       F.when(full, F.col("source_size") * most).otherwise(floor).alias("budget"))


def mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
        text_col: str = "text", weights=WEIGHTS, most: int = MOST_EPOCHS, seed: int = 1) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken``."""
    slim = docs.select(
        F.col(source_col).alias("source"), F.substring(_key(id_col, seed), 1, 3).alias("bucket"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    buckets = C.store(spark, slim.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    goal = targets(spark, buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    goal = goal.withColumns({
        "epochs": F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0).cast("long")})
    goal = goal.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    goal = C.store(spark, goal, "targets")
    running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")
    edge = (buckets.withColumn("before", running).join(goal.withColumnRenamed("source", "_s"),
                                                      F.col("source").eqNullSafe(F.col("_s")))
            .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
            .select("_s", F.col("bucket").alias("_edge"), F.col("before").alias("_before")))
    cuts = C.store(spark, goal.select(F.col("source").alias("_s"), "source_size", "target", "epochs", "rest").join(
        edge.withColumnRenamed("_s", "_t"), F.col("_s").eqNullSafe(F.col("_t")), "left").drop("_t"), "cuts")
    names = ("size", "source_size", "target", "taken")
    rows = docs.drop(*names).withColumns({
        "_key": _key(id_col, seed),
        "size": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")})
    cuts = cuts.select("_s", *[F.col(c).alias(f"_{c}") for c in ("source_size", "target", "epochs", "rest")],
                       "_edge", "_before")
    rows = rows.join(cuts, F.col(source_col).eqNullSafe(F.col("_s")))
    bucket = F.substring("_key", 1, 3)
    on_edge = F.coalesce(bucket == F.col("_edge"), F.lit(False))
    inside = rows.where(~on_edge).withColumn(
        "_part", F.when(F.col("_edge").isNull() | (F.col("_rest") == 0), F.lit(0).cast("long"))
        .when(bucket < F.col("_edge"), F.col("size")).otherwise(F.lit(0).cast("long")))
    order = Window.partitionBy("_s").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_before") + F.sum("size").over(order)
    at_edge = rows.where(on_edge).withColumn("_upto", upto).withColumn(
        "_part", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("_rest") - F.col("_upto") + F.col("size")))
    ).drop("_upto")
    return (inside.unionByName(at_edge)
            .withColumns({"source_size": F.col("_source_size"), "target": F.col("_target"),
                          "taken": F.col("_epochs") * F.col("size") + F.col("_part")})
            .drop("_key", "_s", "_source_size", "_target", "_epochs", "_rest", "_edge", "_before", "_part"))


def mixed_copies(spark: SparkSession, docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: a row per copy of a taken document, with ``epoch`` (from
    0) and ``words`` (of this copy that count; the last copy may be partial)."""
    rows = mix(spark, docs, **kw).where("taken > 0")
    copies = F.expr("sequence(0, cast((taken + size - 1) div size as int) - 1)")
    return (rows.withColumn("epoch", F.explode(copies))
            .withColumn("words", F.least("size", F.expr("taken - epoch * size"))))

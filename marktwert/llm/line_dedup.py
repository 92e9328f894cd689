"""Line dedup by range-partitioned hashes (DataFrame functions only).

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in
lower case.  A key of at least ``MIN_CHARS`` code points that is found in at
least ``MIN_DOCS`` documents loses its lines in all of them but the largest id.
The result is no text but a compressed bitmap per document: ``keep`` holds the
set bits as runs of line numbers (``start``, ``length``).

* Lines become (16-byte digest, id, row digest, line number), stored once; no
  text is shuffled to find repeats.
* The digests are dealt in ranges and sorted by (digest, id descending); the
  window that streams over a digest's occurrences, first the largest id, uses
  that partitioning and order as they are.
* Hot digests are found by a frequency sketch (``approx_top_k``): at most
  ``HOT_KEYS`` digests with over 1/``HOT_KEYS`` of all lines.  Their
  occurrences are salted by id over as many pieces as there are shuffle
  partitions; the pieces' totals are at most ``HOT_KEYS`` rows.  The sketch only
  decides where rows go, never what is dropped.

Defined results: a null or empty text is one empty line; rows of one id are one
document (a line that they share is found in one document); a null id is one
document that ranks below all others; repeated rows have equal bitmaps; an
empty table gives an empty result; of ``docs`` all columns stay, those named
like a result column are replaced.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marktwert.llm import common as C

MIN_CHARS = 20
MIN_DOCS = 3
HOT_KEYS = 1000
SKETCH_ITEMS = 10_000
WHITE = C.WHITE.decode()


def split_lines(text: F.Column) -> F.Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``_key``, ``_doc``, ``_row``, ``_pos`` of every line long enough."""
    rows = docs.select(F.col(id_col).alias("_doc"), _row_digest(text_col).alias("_row"),
                       F.posexplode(split_lines(F.col(text_col))).alias("_pos", "_line"))
    rows = rows.withColumn("_line", F.btrim("_line", F.lit(WHITE))).where(F.char_length("_line") >= min_chars)
    key = F.unhex(F.md5(F.translate("_line", ascii_uppercase, ascii_lowercase)))
    return rows.select(key.alias("_key"), "_doc", "_row", "_pos")


def _row_digest(text_col: str) -> F.Column:
    """Tells rows of equal id and different text apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _hot(lines: DataFrame) -> list[int]:
    """Hashes of the digests that hold at least 1/``HOT_KEYS`` of the lines."""
    sketch = F.expr(f"approx_top_k(xxhash64(_key), {HOT_KEYS}, {SKETCH_ITEMS})")
    found, total = lines.agg(sketch, F.count(F.lit(1))).first()
    return [r["item"] for r in found or [] if r["count"] * HOT_KEYS >= total]


def dropped_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``_doc``, ``_row``, ``_pos`` of the lines to drop."""
    lines = C.store(spark, _occurrences(docs, id_col, text_col, min_chars), "lines", compression="zstd")
    hot = _hot(lines)
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt = F.lit(0)
    if hot:
        salt = F.when(F.xxhash64("_key").isin(hot), 1 + F.pmod(F.xxhash64("_doc"), F.lit(pieces))).otherwise(0)
    dealt = lines.withColumn("_salt", salt.cast("int")).repartitionByRange("_key", "_salt")
    run = Window.partitionBy("_key", "_salt")
    marks = (dealt.withColumn("_nth", F.dense_rank().over(run.orderBy(F.col("_doc").desc_nulls_last())))
             .withColumn("_docs", F.max("_nth").over(run))
             .where((F.col("_salt") > 0) | ((F.col("_docs") >= min_docs) & (F.col("_nth") > 1)))
             .drop("_nth"))
    found = ["_doc", "_row", "_pos"]
    if not hot:
        return marks.select(*found)
    marks = C.store(spark, marks, "marks", compression="zstd")
    salted = marks.where("_salt > 0")
    totals = (salted.groupBy("_key", "_salt").agg(F.max("_docs").alias("n"), F.max("_doc").alias("top"))
              .groupBy("_key").agg(F.sum("n").alias("_n"), F.max("top").alias("_top")))
    # at most HOT_KEYS rows
    in_hot = (salted.join(F.broadcast(totals), "_key")
              .where((F.col("_n") >= min_docs) & ~F.col("_doc").eqNullSafe(F.col("_top"))))
    return marks.where("_salt = 0").select(*found).unionByName(in_hot.select(*found))


def keep_bitmaps(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 **limits) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``keep``."""
    lost = (dropped_lines(spark, docs, id_col, text_col, **limits)
            .groupBy("_doc", "_row").agg(F.array_sort(F.collect_set("_pos")).alias("_lost")))
    rows = docs.drop("n_lines", "n_dropped", "keep").withColumns({
        "n_lines": F.size(split_lines(F.col(text_col))).cast("long"), "_digest": _row_digest(text_col)})
    rows = rows.join(lost, F.col(id_col).eqNullSafe(F.col("_doc")) & (F.col("_digest") == F.col("_row")), "left")
    return rows.withColumns({
        "n_dropped": F.coalesce(F.size("_lost"), F.lit(0)).cast("long"),
        "keep": _runs(F.coalesce("_lost", F.array().cast("array<int>")), F.col("n_lines").cast("int"))}
    ).drop("_doc", "_row", "_digest", "_lost")


def _runs(lost: F.Column, n: F.Column) -> F.Column:
    """The gaps between the sorted line numbers ``lost`` in 0..n-1."""
    before = F.concat(F.array(F.lit(-1)), lost)
    after = F.concat(lost, F.array(n))
    runs = F.zip_with(before, after, lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def kept_text(text_col: str = "text", keep_col: str = "keep") -> F.Column:
    """The kept lines joined by newlines, decoded from the bitmap."""
    both = F.array(F.struct(F.col(keep_col).alias("keep"), split_lines(F.col(text_col)).alias("lines")))
    # a lambda over one pair, so the text is split once and not once a run
    kept = F.transform(both, lambda p: F.array_join(F.flatten(F.transform(
        p["keep"], lambda r: F.slice(p["lines"], r["start"] + 1, r["length"]))), "\n"))
    return F.when(F.col("n_dropped") == 0, F.coalesce(F.col(text_col), F.lit(""))).otherwise(kept[0])

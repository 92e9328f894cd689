"""Document fingerprints: SpotSigs.

Anchors are the most frequent words of the corpus.  At each anchor a spot is
formed: the anchor and the chain of the next content words (words that are no
anchors).  The multiset of spot hashes is the fingerprint; a text without any
anchor takes every word as an anchor.  Fingerprints are compared by weighted
Jaccard (sum of minima over sum of maxima); a pair whose sizes alone rule the
threshold out is pruned, and the join deals fingerprints to partitions by size
so that a similar pair meets in a common partition.

``neighbours`` compares each text with an edited form of itself and with the
next document by id.  Ids are cut into ranges; the first row of the next range
is copied to each range, and one pass over sorted rows sees every successor.

Defined results: null text is empty; a text without words has the empty
fingerprint, equal to other empty ones (likeness 1) and unlike all else (0);
equal texts have equal fingerprints; rows order by (id, text), null ids last,
so repeated rows follow each other; a single row is its own successor; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marktwert.llm import common as C

ANCHORS = 64
CHAIN = 3
RANGES_PER_PARTITION = 4
_JOIN = np.uint64(0xC2B2AE3D27D4EB4F)


def _word_counts(batches) -> Iterator[pa.RecordBatch]:
    for batch in C.pieces(batches):
        texts = C.as_bytes(batch.column(0))
        seen = [C.Words(texts[lo:hi], C.ALNUM_WORDS).hashes() for lo, hi in C.slices(texts)]
        word, n = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])


def common_words(docs: DataFrame, text_col: str = "text", n: int = ANCHORS) -> np.ndarray:
    """Hashes of the ``n`` most frequent words of all texts, sorted."""
    counts = docs.select(text_col).mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(n).collect()
    return np.sort(np.array([r["word"] for r in top], np.int64).view(np.uint64))


def spots(texts: list[bytes], anchors: np.ndarray, chain: int = CHAIN) -> list[np.ndarray]:
    """Sorted 32-bit spot hashes (with repeats) of each text."""
    words = C.Words(texts, C.ALNUM_WORDS)
    h, first = words.hashes(), words.first
    anchor = np.zeros(len(h), bool)
    if len(anchors) and len(h):
        at = np.minimum(np.searchsorted(anchors, h), len(anchors) - 1)
        anchor = anchors[at] == h
    content = np.flatnonzero(~anchor)
    counts = np.diff(first)
    text_of = np.repeat(np.arange(len(texts)), counts)
    per_text = np.bincount(text_of[anchor], minlength=len(texts))
    every = (per_text == 0)[text_of] if len(h) else anchor
    spot = np.flatnonzero(anchor | every)
    value = h[spot].copy()
    if len(content) and len(spot):
        end = first[1:][text_of[spot]]
        at = np.searchsorted(content, spot, side="right")
        for _ in range(chain):
            ok = at < len(content)
            follow = content[np.minimum(at, len(content) - 1)]
            ok &= follow < end
            value = C.mix(value * _JOIN + np.where(ok, h[follow], np.uint64(0)))
            at = at + 1
    value = (C.mix(value) >> np.uint64(32)).astype(np.uint32)
    cuts = np.searchsorted(text_of[spot], np.arange(len(texts) + 1)) if len(h) else np.zeros(len(texts) + 1, int)
    return [np.sort(value[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def likeness(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Weighted Jaccard of two spot multisets, 0 where sizes rule out
    ``threshold``."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return 0.0
    if len(a) == len(b) and np.array_equal(a, b):
        return 1.0
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = y[at] == x
    shared = int(np.minimum(n[both], m[at[both]]).sum())
    return shared / (len(a) + len(b) - shared)


def as_text(spot: np.ndarray) -> str:
    """Fingerprint as text: eight hex digits a spot, ascending."""
    return spot.astype(">u4").tobytes().hex()


# ---- each text, its edited form and its successor --------------------------
def _edited(text: str, after: str) -> str:
    cut = len(text) // 4
    return text[:len(text) - cut] + after[:cut]


def _pairs(batches, anchors, chain: int) -> Iterator[pa.RecordBatch]:
    anchors = anchors.value

    def results(ids, texts):  # the last row is the successor only
        edited = [_edited(a, b) for a, b in zip(texts[:-1], texts[1:])]
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        raw_edited = [t.encode("utf-8", "surrogatepass") for t in edited]
        prints, prints_edited = [], []
        for lo, hi in C.slices(raw):
            prints += spots(raw[lo:hi], anchors, chain)
        for lo, hi in C.slices(raw_edited):
            prints_edited += spots(raw_edited[lo:hi], anchors, chain)
        n = len(edited)
        return pa.RecordBatch.from_arrays([
            pa.array(ids[:n], kind), pa.array([len(t) for t in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in raw_edited], pa.string()),
            pa.array([as_text(p) for p in prints[:n]], pa.string()),
            pa.array([as_text(p) for p in prints_edited], pa.string()),
            pa.array([likeness(prints[i], prints_edited[i]) for i in range(n)], pa.float64()),
            pa.array([likeness(prints[i], prints[i + 1]) for i in range(n)], pa.float64())], names)

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held, kind = None, None
    for batch in batches:
        kind = batch.column("id").type
        rows = list(zip(batch.column("range").to_pylist(), batch.column("tail").to_pylist(),
                        batch.column("id").to_pylist(), batch.column("text").to_pylist()))
        if held is not None:
            rows.insert(0, held)
        at = 0
        while at < len(rows) - 1:
            # a stretch of rows of one range, up to its tail row
            to = at
            while to + 1 < len(rows) and rows[to][1] == 0:
                to += 1
            if to > at:
                for lo in range(at, to, 512):
                    part = rows[lo:min(lo + 512, to) + 1]
                    yield results([r[2] for r in part], [r[3] or "" for r in part])
                at = to
            if rows[at][1] == 1:  # the tail row: copies after the first are not needed
                at += 1
                while at < len(rows) and rows[at][1] == 1:
                    at += 1
        held = rows[at] if at < len(rows) else None


def neighbours(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               anchors: int = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """Per row: ``id``, ``n_chars``, ``edited_sha256``, both fingerprints and
    the likeness to the edited text and to the next document."""
    frequent = spark.sparkContext.broadcast(common_words(docs, text_col, anchors))
    kind = docs.schema[id_col].dataType.simpleString()
    ids = docs.select(F.col(id_col).alias("id"))
    parts = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = C.store(spark, ids.where("id is not null").repartitionByRange(parts, "id")
                     .select("id", F.spark_partition_id().alias("range")), "ids")
    # the least id of each range: as many rows as ranges
    cuts = [r[0] for r in ranges.groupBy("range").agg(F.min("id").alias("id")).orderBy("id").select("id").collect()]
    some_null = not ids.where("id is null").isEmpty()
    last = len(cuts) - (0 if some_null else 1)  # null ids: a range of their own, the last
    starts = np.array(cuts)

    @F.pandas_udf("range int, tail_of int")
    def place(values: pd.Series, null: pd.Series) -> pd.DataFrame:
        """Range of an id, and for the first id of a range the range before."""
        known, null = values.to_numpy().astype(starts.dtype), null.to_numpy()
        range_ = np.where(null, last, np.searchsorted(starts, known, side="right") - 1)
        before = np.where(range_ > 0, range_ - 1, last)
        is_start = null | np.isin(known, starts)
        return pd.DataFrame({"range": range_.astype(np.int32),
                             "tail_of": np.where(is_start, before, -1).astype(np.int32)})

    if cuts:
        where = place(F.coalesce("id", F.lit(cuts[0]).cast(kind)), F.col("id").isNull())
    else:  # only null ids
        where = F.struct(F.lit(0).alias("range"), F.lit(0).alias("tail_of"))
    placed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("p", where)
    copies = F.when(F.col("p.tail_of") >= 0, F.array(
        F.struct(F.col("p.range").alias("range"), F.lit(0).alias("tail")),
        F.struct(F.col("p.tail_of").alias("range"), F.lit(1).alias("tail")))).otherwise(
        F.array(F.struct(F.col("p.range").alias("range"), F.lit(0).alias("tail"))))
    dealt = (placed.select("id", "text", F.explode(copies).alias("c")).select("c.range", "c.tail", "id", "text")
             .repartition("range").sortWithinPartitions("range", "tail", F.col("id").asc_nulls_last(), "text"))
    return dealt.mapInArrow(
        partial(_pairs, anchors=frequent, chain=chain),
        f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


# ---- join ------------------------------------------------------------------
def _fingerprints(batches, anchors, chain: int) -> Iterator[pa.RecordBatch]:
    for batch in C.pieces(batches):
        texts = C.as_bytes(batch.column("text"))
        prints = []
        for lo, hi in C.slices(texts):
            prints += spots(texts[lo:hi], anchors.value, chain)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([as_text(p) for p in prints], pa.string()),
             pa.array([p.astype(np.int64) for p in prints], pa.list_(pa.int64()))], ["id", "fingerprint", "spots"])


def similar_pairs(spark: SparkSession, docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id",
                  text_col: str = "text", anchors: int = ANCHORS, chain: int = CHAIN) -> tuple[DataFrame, DataFrame]:
    """Pairs of *different* fingerprints with at least ``threshold`` likeness
    (columns ``a``, ``b``, ``likeness``; fingerprint keys) and the membership
    (``id``, ``key``).  Sizes are cut into partitions whose width follows the
    threshold, so a similar pair lies in one or in two next to each other;
    inside, only the rarest spots of each fingerprint are indexed (as many as a
    similar pair cannot avoid sharing)."""
    kind = docs.schema[id_col].dataType.simpleString()
    frequent = spark.sparkContext.broadcast(common_words(docs, text_col, anchors))
    prints = C.store(spark, docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        partial(_fingerprints, anchors=frequent, chain=chain), f"id {kind}, fingerprint string, spots array<long>")
        .withColumn("key", F.sha2("fingerprint", 256)), "prints")
    one = C.store(spark, prints.where(F.size("spots") > 0).groupBy("key").agg(F.first("spots").alias("spots"))
                  .withColumn("n", F.size("spots"))
                  .withColumn("part", F.floor(F.log(F.col("n")) / np.log(1 / threshold)).cast("int")), "one")
    each = one.select("key", "n", "part", F.explode("spots").alias("spot")).withColumn(
        "nth", F.row_number().over(Window.partitionBy("key", "spot").orderBy("spot")))
    weight = each.groupBy("spot").count()
    order = Window.partitionBy("key").orderBy("count", "spot", "nth")
    rare = (each.join(weight, "spot").withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1))
    left = rare.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("part").alias("_p"), "spot", "nth")
    right = rare.select(F.col("key").alias("b"), F.col("n").alias("nb"),
                        F.explode(F.array("part", F.col("part") - 1)).alias("_p"), "spot", "nth", "part")
    fits = F.least("na", "nb") >= threshold * F.greatest("na", "nb")
    found = (left.join(right, ["_p", "spot", "nth"]).where(fits)
             .where((F.col("part") > F.col("_p")) | (F.col("a") < F.col("b"))).select("a", "b").distinct())

    @F.pandas_udf("double")
    def compare(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeness(np.sort(a), np.sort(b), threshold) for a, b in zip(x, y)])

    spots_of = one.select("key", "spots")
    pairs = (found.join(spots_of.select(F.col("key").alias("a"), F.col("spots").alias("sa")), "a")
             .join(spots_of.select(F.col("key").alias("b"), F.col("spots").alias("sb")), "b")
             .select("a", "b", compare("sa", "sb").alias("likeness")).where(F.col("likeness") >= threshold))
    return pairs, prints.select("id", "key")

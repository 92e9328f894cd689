"""Benchmark decontamination by Wu-Manber multi-pattern search.

The test strings are the windows of ten consecutive words of every benchmark
item (an item of fewer words is one window).  Texts and windows are laid out
alike: lower-cased words between single spaces.  A shift table over hashed
blocks (the last bytes of the search window) tells how far a position can be
moved; positions with shift zero look up the windows by suffix and prefix block
and are compared directly.  Windows are searched in classes of similar length,
so one short item does not shorten the shifts of the others.  The scan moves
many cursors at once, each over its own stretch of the buffer.

Windows reach the tasks in blocks of at most ``BLOCK_BYTES`` (one broadcast
each, whatever the size of the benchmark); a document carries the word ranges
and items found so far from block to block, in one stage without a shuffle.

Defined results: null or empty text has no words and no hits; items without
words give no window; equal windows of several items report all of them;
repeated documents and repeated items give equal results; a null item id is
reported as the text ``null``; an empty table on either side gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marktwert.llm import common as C

WINDOW = 10
BLOCK_BYTES = 16_000_000
STRETCH = 512
_MUL = np.uint64(0x9E3779B97F4A7C15)
_NEWLINE = 10


# ---- layout ----------------------------------------------------------------
class Layout:
    """Texts as `` w1 w2 ... wn `` each, between newlines, in one buffer."""

    def __init__(self, texts: list[bytes]):
        raw = b"\n" * 8 + b" " + b" \n ".join([t.translate(C.ALNUM_WORDS) for t in texts]) + b" \n"
        raw += b"\n" * (-len(raw) % 8 + 8)
        loose = np.frombuffer(raw, np.uint8)
        keep = np.ones(len(loose), bool)
        keep[1:] = (loose[1:] != C.SPACE) | (loose[:-1] != C.SPACE)
        packed = loose[keep]
        self.size = len(packed)
        self.buf = np.concatenate([packed, np.full(-len(packed) % 8 + 8, _NEWLINE, np.uint8)])
        space = self.buf == C.SPACE
        word = ~space & (self.buf != _NEWLINE)
        self.word_at = np.flatnonzero(word[1:] & space[:-1]) + 1
        breaks = np.flatnonzero(self.buf == _NEWLINE)
        text_at = np.concatenate([[8], breaks[breaks >= 8][:len(texts)] + 1])
        self.first = np.searchsorted(self.word_at, text_at[:len(texts) + 1])


def _windows(batches, id_col: str, text_col: str, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(id_col).to_pylist(), C.as_bytes(batch.column(text_col))
        rows = []
        for item, text in zip(ids, texts):
            words = text.translate(C.ALNUM_WORDS).split(b" ")
            words = [w for w in words if w]
            for i in range(max(len(words) - width, 0) + 1 if words else 0):
                part = words[i:i + width]
                rows.append((b" " + b" ".join(part) + b" ", len(part), "null" if item is None else item))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([r[2] for r in rows], pa.string())], ["window", "words", "item"])


# ---- search ----------------------------------------------------------------
class _Class:
    """Shift table and suffix buckets of windows with lengths in [m, 2m)."""

    def __init__(self, windows: list[bytes], numbers: list[int]):
        self.windows, self.m = windows, min(map(len, windows))
        self.block = min(8, self.m)
        self.drop = np.uint64(8 * (8 - self.block))
        steps = self.m - self.block + 1
        self.bits = int(min(26, max(12, np.ceil(np.log2(16 * steps * len(windows))))))
        heads = np.frombuffer(b"".join(w[:self.m] for w in windows), np.uint8).reshape(len(windows), self.m)
        self.shift = np.full(1 << self.bits, min(steps, 255), np.uint8)
        for end in range(self.block, self.m + 1):
            value = np.zeros(len(windows), np.uint64)
            for k in range(self.block):
                value |= heads[:, end - self.block + k].astype(np.uint64) << np.uint64(8 * k)
            at = self._hash(value)
            self.shift[at] = np.minimum(self.shift[at], min(self.m - end, 255))
            if end == self.block:
                prefix = value
        keys = C.mix(value * _MUL + prefix)
        order = np.argsort(keys, kind="stable")
        self.keys, self.numbers = keys[order], np.asarray(numbers)[order]
        self.windows = [windows[i] for i in order]

    def _hash(self, value: np.ndarray) -> np.ndarray:
        return (value * _MUL >> np.uint64(64 - self.bits)).astype(np.int64)

    def _block(self, long_words: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The block of bytes that ends before each position."""
        at = end - 8
        low, bit = at >> 3, (at & 7).astype(np.uint64) << np.uint64(3)
        value = long_words[low] >> bit
        value |= (long_words[low + 1] << np.uint64(1)) << (np.uint64(63) - bit)
        return value >> self.drop

    def find(self, layout: Layout, data: bytes) -> list[tuple[int, int]]:
        """(byte position, window number) of every occurrence."""
        long_words = layout.buf.view("<u8")
        starts = np.arange(8 + self.m, layout.size + 1, STRETCH)
        limit = np.minimum(starts + STRETCH, layout.size + 1)
        end, hits = starts, []
        while len(end):
            jump = self.shift[self._hash(self._block(long_words, end))]
            stop = jump == 0
            if stop.any():
                hits.append(end[stop])
            end = end + np.maximum(jump, 1)
            on = end < limit
            if not on.all():
                end, limit = end[on], limit[on]
        if not hits:
            return []
        end = np.concatenate(hits)
        keys = C.mix(self._block(long_words, end) * _MUL + self._block(long_words, end - self.m + self.block))
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        out = []
        for i in np.flatnonzero(hi > lo).tolist():
            at = int(end[i]) - self.m
            for w in range(int(lo[i]), int(hi[i])):
                if data.startswith(self.windows[w], at):
                    out.append((at, int(self.numbers[w])))
        return out


class Searcher:
    """All windows of one block, in classes by length."""

    def __init__(self, windows: list[bytes]):
        by: dict[int, list[int]] = {}
        for i, w in enumerate(windows):
            by.setdefault(len(w).bit_length(), []).append(i)
        self.classes = [_Class([windows[i] for i in g], g) for g in by.values()]

    def find(self, layout: Layout) -> list[tuple[int, int]]:
        data = layout.buf.tobytes()
        return [hit for c in self.classes for hit in c.find(layout, data)]


def _scan(batches, patterns, text_col: str) -> Iterator[pa.RecordBatch]:
    """Add word ranges and items of one block to ``_ranges`` and ``_items``."""
    windows, words, items = patterns.value
    searcher = Searcher(windows) if windows else None
    for batch in C.pieces(batches):
        texts = C.as_bytes(batch.column(text_col))
        ranges = [list(x) for x in batch.column("_ranges").to_pylist()]
        found = [set(x) for x in batch.column("_items").to_pylist()]
        counts = []
        for lo, hi in C.slices(texts):
            layout = Layout(texts[lo:hi])
            counts.append(np.diff(layout.first))
            hits = searcher.find(layout) if searcher else []
            if hits:
                word = np.searchsorted(layout.word_at, [h[0] + 1 for h in hits])
                doc = np.searchsorted(layout.first, word, side="right") - 1
                for (_, w), i, d in zip(hits, word.tolist(), doc.tolist()):
                    at = i - int(layout.first[d])
                    ranges[lo + d] += [at, at + words[w]]
                    found[lo + d].update(items[w])
        n_words = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        n_hit = []
        for r in ranges:
            reached, hit = 0, 0
            for a, b in sorted(zip(r[0::2], r[1::2])):
                hit += max(b - max(a, reached), 0)
                reached = max(reached, b)
            n_hit.append(hit)
        columns = {name: batch.column(name) for name in batch.schema.names}
        columns |= {"_ranges": pa.array(ranges, pa.list_(pa.int64())),
                    "_items": pa.array([sorted(f) for f in found], pa.list_(pa.string())),
                    "_n_words": pa.array(n_words, pa.int64()), "_n_hit": pa.array(n_hit, pa.int64())}
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``_n_words``, ``_n_hit``, ``_ranges`` (word ranges of the
    occurrences, start and end in turn) and ``_items`` (sorted item ids)."""
    cut = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    windows = C.store(spark, cut.mapInArrow(
        partial(_windows, id_col="item", text_col="text", width=width),
        "window binary, words int, item string")
        .groupBy("window", "words").agg(F.collect_set("item").alias("items")), "windows")
    weight = F.octet_length("window") + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x))
    total = windows.agg(F.sum(weight)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = docs.withColumns({"_ranges": F.array().cast("array<long>"), "_items": F.array().cast("array<string>"),
                            "_n_words": F.lit(0).cast("long"), "_n_hit": F.lit(0).cast("long")})
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])
    for block in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).collect()
        patterns = spark.sparkContext.broadcast(([bytes(r["window"]) for r in rows], [r["words"] for r in rows],
                                                 [r["items"] for r in rows]))
        out = out.mapInArrow(partial(_scan, patterns=patterns, text_col=text_col), schema)
    return out


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame,
                      text_col: str = "text") -> DataFrame:
    """Documents without any benchmark window, columns unchanged."""
    return (contamination(spark, docs, benchmark, text_col).where("_n_hit = 0")
            .drop("_ranges", "_items", "_n_words", "_n_hit"))

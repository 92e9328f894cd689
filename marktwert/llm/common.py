"""Shared helpers of the text operators: shared-folder tables, word and shingle
hashing in NumPy, streaming over sorted runs.

All hashing is vectorised over one Arrow batch at a time; a batch is cut into
slices of ``SLICE_BYTES`` of text so temporary arrays stay bounded (a longer
single text forms a slice of its own).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marktwert.session import remove_path, shared_path

SLICE_BYTES = 500_000
PIECE_ROWS = 1000
SPACE = 0x20
WHITE = bytes([0x20, *range(0x09, 0x0E)])

_rng = np.random.default_rng(20240229)
_BYTE_VALUES = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_RADIX = np.uint64(0x9E3779B97F4A7C15)
_JOIN = np.uint64(0xD1342543DE82EF95)


_folder: ContextVar[str] = ContextVar("folder", default="llm")


@contextmanager
def scratch(spark: SparkSession, name: str):
    """Tables stored inside the block lie in one folder, which goes at its end:
    store what is needed later outside, with :func:`store_at`."""
    folder = f"{_folder.get()}/{name}-{uuid.uuid4().hex}"
    before = _folder.set(folder)
    try:
        yield
    finally:
        _folder.reset(before)
        remove_path(spark, shared_path(spark, folder))


def store_at(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to a new folder and read it back."""
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store(spark: SparkSession, df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write ``df`` to a fresh folder of the shared checkpoint
    directory and read it back, so a lost executor re-reads files."""
    path = shared_path(spark, _folder.get(), f"{name}-{uuid.uuid4().hex}")
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``PIECE_ROWS`` rows and 8 MB where the session has Spark's
    defaults: a batch of 10,000 texts lies several times in the buffers of the
    JVM and of each Python worker, beside the executor's heap."""
    for key, default, value in (("maxRecordsPerBatch", "10000", str(PIECE_ROWS)), ("maxBytesPerBatch", "64MB", "8MB")):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, default).lower() in (default.lower(), "67108864b", "67108864"):
            spark.conf.set(key, value)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str) -> F.Column:
    """crc32 of the id as text, modulo 4, is 2 (false for a null id)."""
    crc = F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8"))
    return F.coalesce(F.pmod(crc, F.lit(4)) == 2, F.lit(False))


def word_table(separators: bytes | None = None, word_bytes: bytes | None = None) -> bytes:
    """256-byte translation: lower-case A-Z, every separator becomes a space."""
    keep = set(range(256)) - set(separators) if separators is not None else set(word_bytes)
    return bytes((b + 32 if 65 <= b <= 90 else b) if b in keep else SPACE for b in range(256))


#: Words ``[^\x20\x09-\x0D]+`` after lower-casing A-Z.
SPACE_WORDS = word_table(separators=WHITE)
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM_WORDS = word_table(word_bytes=bytes([*range(48, 58), *range(65, 91), *range(97, 123),
                                           *range(128, 256)]))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in small batches, so that what Python copies of
    a batch stays small (a batch may hold 10,000 texts)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts sum to about ``limit`` bytes."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


class Words:
    """Word boundaries of several texts laid out in one byte buffer.

    ``buf`` holds the translated bytes, texts separated by one newline byte
    that belongs to no word; ``start``/``end`` are byte positions of the words
    and ``first[i]:first[i + 1]`` are the words of text ``i``.
    """

    def __init__(self, texts: list[bytes], table: bytes):
        joined = b"\n" + b"\n".join([t.translate(table) for t in texts]) + b"\n"
        self.buf = np.frombuffer(joined, np.uint8)
        self.is_word = (self.buf != SPACE) & (self.buf != 10)
        step = np.diff(self.is_word.view(np.int8))
        self.start = np.flatnonzero(step == 1) + 1
        self.end = np.flatnonzero(step == -1) + 1
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.text_at = np.concatenate([[1], 1 + np.cumsum(lengths + 1)])
        self.first = np.searchsorted(self.start, self.text_at)

    def hashes(self) -> np.ndarray:
        """A mixed 64-bit polynomial hash of each word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        lengths = self.end - self.start
        at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        powers = np.multiply.accumulate(np.concatenate(
            [np.ones(1, np.uint64), np.full(int(lengths.max()), _RADIX)]))
        place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
        values = _BYTE_VALUES[self.buf[self.is_word]] * powers[place]
        return mix(np.add.reduceat(values, at))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(hashes: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct ``k``-word shingle hashes of each text; a text with
    fewer words gives its whole sequence as one shingle, one without words
    the empty set."""
    n = len(hashes)
    if n >= k:
        grams = hashes[:n - k + 1].copy()
        for j in range(1, k):
            grams = grams * _JOIN + hashes[j:n - k + 1 + j]
        grams = mix(grams + np.uint64(k))
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= k:
            out.append(np.unique(grams[lo:hi - k + 1]))
        elif hi > lo:
            h = hashes[lo:lo + 1].copy()
            for j in range(lo + 1, hi):
                h = h * _JOIN + hashes[j]
            out.append(mix(h + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fixed_binary(matrix: np.ndarray) -> pa.Array:
    """Rows of a 2-d array as a binary column."""
    rows = np.ascontiguousarray(matrix)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets),
                                                         pa.py_buffer(rows.tobytes())])


def matrix(column: pa.Array, dtype: str) -> np.ndarray:
    """Inverse of :func:`fixed_binary` (all rows equally long, no nulls)."""
    column = column.cast(pa.binary())
    if not len(column):
        return np.zeros((0, 0), dtype)
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup the batches of a partition sorted by ``keys`` so that no run of
    equal keys is cut; at most one run beyond a batch is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = [batch.column(k)[batch.num_rows - 1] for k in keys]
        cut = batch.num_rows
        low, high = 0, batch.num_rows - 1
        while low < high:  # first row of the last run
            mid = (low + high) // 2
            if [batch.column(k)[mid] for k in keys] == last:
                high = mid
            else:
                low = mid + 1
        cut = low
        if cut:
            held[-1] = batch.slice(0, cut)
            yield pa.Table.from_batches(held)
            held = [batch.slice(cut)]
        elif len(held) > 1 and [held[-2].column(k)[held[-2].num_rows - 1] for k in keys] != last:
            yield pa.Table.from_batches(held[:-1])
            held = held[-1:]
    if held:
        yield pa.Table.from_batches(held)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as stars: every node to the least node of its
    component within the partition."""
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not held:
        return
    u, v = (np.concatenate(x) for x in zip(*held))
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[:len(u)], ends[len(u):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        if (root[a] == low).all() and (root[b] == low).all():
            break
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != root[root]).any():
            root = root[root]
    leaf = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[root[leaf]])], ["u", "v"])


def connected_components(spark: SparkSession, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Components of an undirected graph (columns ``u``, ``v`` of type long).

    Each round contracts the links inside every partition to stars (a map over
    file splits, so a small graph is done at once) and, unless one star forest
    is left, joins the stars by a large-star and a small-star step: grouped
    minima joined back, so a hub is never gathered in one place.  Returns
    ``node``, ``root`` for every node that has a link; the root is the least
    node of its component.
    """
    current = store(spark, edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links")
    for _ in range(max_rounds):
        current = store(spark, current.mapInArrow(_contract, "u long, v long"), "stars")
        ends = current.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x"))
        inner = current.select(F.col("v").alias("u")).join(current.select("u"), "u", "left_semi")
        if ends.where("m <> x").isEmpty() and inner.isEmpty():
            break
        both = current.select("u", "v").union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        down = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        current = store(spark, down.join(low, "u").where("v <> m")
                        .select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
                        .union(low.select("u", "m")).distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots).distinct()

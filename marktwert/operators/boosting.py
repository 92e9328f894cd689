"""Gradient-boosted regression trees over feature histograms (M1, M2).

What ``pyspark.ml``'s trees lack and the shipped model uses: an L2 term on leaf
values, columns sampled once per tree, the error of every iteration on the
training and validation rows, and a patience in rounds with truncation at the
best one.

* Features are cut once into at most 256 bins (approximate quantiles, one
  aggregation) and stored as one byte each beside label and margin.  The passes of
  a tree read blocks of at most ``BLOCK_ROWS`` of these rows with their bins column
  by column, so they move and read whole arrays.
* A node with more than ``localRows`` rows is split by a distributed histogram:
  every task sums gradients per (node, feature, bin).  While the sums of all tasks
  have at most ``SUMS`` cells, the driver adds them up, so a level is one stage
  without a shuffle, and of two siblings only the smaller one is summed (the other
  is the rest of the parent's sums); beyond that a grouped sum adds the tasks up, a
  window over the bins of a (node, feature) finds the best split, and one row per
  node reaches the driver.
* Once a node has at most ``localRows`` rows, its whole subtree is grown by one
  task (rows are dealt by node), so deep levels cost one job together, and a
  task never holds more than ``localRows`` rows.
* Margins are stored every ``STORE_EVERY`` trees (the folder before is removed).
  In between, the rows with the margins of the latest tree are persisted by the
  first pass of the next one, so a pass walks no tree twice; lineage stays short
  and a lost executor re-reads files and adds the trees of the current stretch.

Gradients are fixed-point integers, so sums and with them the trees do not
depend on the order in which tasks finish.  Rows are sampled by a hash of their
bins and label, columns by a seeded generator.  Splits are chosen by gain, then
the least feature and bin.

Defined results: a missing feature value (NaN) goes right; rows without a label
are left out of the fit; a constant label gives single-leaf trees; no training
rows raises ``ValueError``.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLWritable)
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..session import remove_path, shared_path

STORE_EVERY = 20
CELLS = 4_000_000  # histogram cells that a task holds: more nodes take more passes
SUMS = 4_000_000  # histogram cells of all tasks together that the driver adds up
NODE = "feature int, bin int, threshold double, left int, right int, value double, gain double, cover long"
TREE = f"tree int, node int, {NODE}"
BLOCK_ROWS = 16_384
DENSE = 4  # rows a cell, from which on a subtree's level is summed for all cells
ROWS = "_row long, _bins binary, _y double, _held boolean, _margin double"
BLOCKS = "_row binary, _bins binary, _y binary, _held binary, _margin binary"  # arrays of a block


class Tree:
    """One tree as arrays; ``left`` is -1 in leaves."""

    def __init__(self, rows: Sequence[dict]):
        self._set(np.array([r["feature"] for r in rows], np.int64), np.array([r["bin"] for r in rows], np.int64),
                  np.array([r["threshold"] for r in rows], np.float64), np.array([r["left"] for r in rows], np.int64),
                  np.array([r["right"] for r in rows], np.int64), np.array([r["value"] for r in rows], np.float64))
        self.rows = list(rows)

    def _set(self, feature, bin_, threshold, left, right, value) -> None:
        self.feature, self.bin, self.threshold, self.left, self.right, self.value = feature, bin_, threshold, left, right, value
        # a leaf leads to itself, so a walk is the same steps for all rows
        own = np.arange(len(left))
        self.next = np.stack([np.where(left < 0, own, left), np.where(left < 0, own, right)], axis=1).ravel()
        self.steps, level = 0, np.arange(min(1, len(left)))
        while (level := level[left[level] >= 0]).size:
            self.steps, level = self.steps + 1, np.concatenate([left[level], right[level]])

    def __reduce__(self):  # tasks need the arrays alone
        return _tree, (self.feature, self.bin, self.threshold, self.left, self.right, self.value)

    def leaves(self, x: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Node in which each row of ``x`` ends; ``cut`` is ``bin`` for binned
        rows and ``threshold`` for raw ones."""
        return self.walk(np.ascontiguousarray(x.T), cut)

    def walk(self, columns: np.ndarray, cut: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """:meth:`leaves` of ``rows`` (all), given a line per feature."""
        n, flat = columns.shape[1], columns.reshape(-1)
        rows = np.arange(n) if rows is None else rows
        first, at = self.feature * n, np.zeros(len(rows), np.int64)
        for _ in range(self.steps):
            at = self.next.take(2 * at + ~(flat.take(first.take(at) + rows) <= cut.take(at)))
        return at


def _tree(*arrays) -> Tree:
    t = Tree.__new__(Tree)
    t._set(*arrays)
    return t


def _leaf(value: float = 0.0, cover: int = 0) -> dict:
    return {"feature": 0, "bin": 0, "threshold": 0.0, "left": -1, "right": -1, "value": value, "gain": 0.0, "cover": cover}


class _Rules:
    """What decides about splits; all sums are integers of 1 / ``unit``."""

    def __init__(self, depth: int, step: float, l2: float, least_gain: float, least_rows: float, unit: float,
                 bins: int, columns: np.ndarray):
        self.depth, self.step, self.l2, self.least_gain = depth, step, l2, max(least_gain, 1e-6)
        self.least_rows, self.unit, self.bins, self.columns = least_rows, unit, bins, columns

    def value(self, g: int, n: int) -> float:
        return -self.step * (g / self.unit) / (n + self.l2)


def grow(columns: np.ndarray, g: np.ndarray, depth: int, rules: _Rules) -> list[dict]:
    """The subtree of some rows (``columns`` holds a line per column of the tree),
    level by level, from ``depth`` on.  While nodes have many rows, the sums of all
    cells are kept and of two siblings only the smaller one is summed."""
    nodes = [_leaf(rules.value(int(g.sum()), len(g)), len(g))]
    rows, node = np.arange(len(g)), np.zeros(len(g), np.int64)
    open_nodes, sums = [0], None
    for _ in range(depth, rules.depth):
        if not open_nodes:
            break
        if len(open_nodes) * rules.bins * DENSE <= len(rows):
            sums = _level_sums(columns, g, rows, node, open_nodes, nodes, sums, rules)
            best = _best_of_sums(*sums, rules)
        else:
            sums, best = None, _best_splits(columns, g, rows, node, len(open_nodes), rules)
        split = [k for k in range(len(open_nodes)) if best[k] is not None]
        if not split:
            break
        left, column, cut = (np.full(len(open_nodes), x) for x in (-1, 0, 0))
        for i, k in enumerate(split):
            gain, column[k], cut[k], gl, nl, gr, nr = best[k]
            nodes[open_nodes[k]].update(feature=int(rules.columns[column[k]]), bin=int(cut[k]), left=len(nodes),
                                        right=len(nodes) + 1, gain=gain)
            left[k] = 2 * i
            nodes += [_leaf(rules.value(gl, nl), nl), _leaf(rules.value(gr, nr), nr)]
        goes = left[node] >= 0
        rows, node = rows[goes], node[goes]
        low = columns.reshape(-1).take(column[node] * columns.shape[1] + rows) <= cut[node]
        node = left[node] + ~low
        if sums is not None:
            sums = tuple(x[:, split] for x in sums)
        open_nodes = list(range(len(nodes) - 2 * len(split), len(nodes)))
    return nodes


def _tally(columns, rows, first_cell, g, g_sum, n_sum) -> None:
    """Add gradient and number of rows per cell to the sums of each column.
    ``bincount`` adds floats: as many rows at once as give exact integers."""
    size = g_sum.shape[1]
    at_once = int(min(2.0**53 // max(1, np.abs(g).max(initial=0)), 2**30))
    if not at_once:
        for k, column in enumerate(columns):
            np.add.at(g_sum[k], first_cell + column.take(rows), g)
            n_sum[k] += np.bincount(first_cell + column.take(rows), minlength=size)
        return
    for lo in range(0, len(rows), at_once):
        some, base, weights = rows[lo:lo + at_once], first_cell[lo:lo + at_once], g[lo:lo + at_once].astype(np.float64)
        for k, column in enumerate(columns):
            cell = base + column.take(some)
            n_sum[k] += np.bincount(cell, minlength=size)
            g_sum[k] += np.bincount(cell, weights, size).astype(np.int64)


def _level_sums(columns, g, rows, node, open_nodes, nodes, parents, rules):
    """Sums per (column, open node, bin); open nodes come in pairs of siblings if
    the sums of their ``parents`` are given."""
    n_columns, count = len(columns), len(open_nodes)
    if parents is None:
        g_sum, n_sum = (np.zeros((n_columns, count * rules.bins), np.int64) for _ in range(2))
        _tally(columns, rows, node * rules.bins, g[rows], g_sum, n_sum)
        return tuple(x.reshape(n_columns, count, rules.bins) for x in (g_sum, n_sum))
    cover = np.array([nodes[k]["cover"] for k in open_nodes])
    less = 2 * np.arange(count // 2) + (cover[1::2] < cover[::2])
    is_less = np.zeros(count, bool)
    is_less[less] = True
    some = np.flatnonzero(is_less[node])
    g_sum, n_sum = (np.zeros((n_columns, count // 2 * rules.bins), np.int64) for _ in range(2))
    _tally(columns, rows[some], (node[some] >> 1) * rules.bins, g[rows[some]], g_sum, n_sum)
    out = []
    for mine, whole in zip((g_sum, n_sum), parents):
        both = np.empty((n_columns, count, rules.bins), np.int64)
        both[:, less] = mine.reshape(whole.shape)
        both[:, less ^ 1] = whole - both[:, less]
        out.append(both)
    return tuple(out)


def _best_of_sums(g, n, rules):
    """Best (gain, column, bin, sums of both sides) of each node from its sums
    (column, node, bin); of equal gains the least column and bin."""
    gl, nl = g.cumsum(axis=2), n.cumsum(axis=2)
    gt, nt = gl[:1, :, -1:], nl[:1, :, -1:]
    gain = np.where(n > 0, _gain(gl, nl, gt, nt, rules), -np.inf)
    gain[~(gain > rules.least_gain)] = -np.inf
    most, each = gain.max(axis=2), np.arange(g.shape[1])
    column = most.argmax(axis=0)
    cut = gain[column, each].argmax(axis=1)
    found: list = [None] * len(each)
    for k in np.flatnonzero(most[column, each] > -np.inf).tolist():
        c, b = int(column[k]), int(cut[k])
        x, y = int(gl[c, k, b]), int(nl[c, k, b])
        found[k] = (float(gain[c, k, b]), c, b, x, y, int(gt[0, k, 0]) - x, int(nt[0, k, 0]) - y)
    return found


def _best_splits(columns, g, rows, node, count, rules):
    """Best (gain, column, bin, sums of both sides) of each open node.  Only
    filled cells are looked at: an empty bin splits like the filled one before."""
    total_g = np.bincount(node, g[rows], count)
    total_n = np.bincount(node, minlength=count).astype(np.float64)
    best = np.full(count, rules.least_gain)
    found: list = [None] * count
    weights, first_cell = g[rows].astype(np.float64), node * rules.bins
    for column in range(len(columns)):
        cell = first_cell + columns[column][rows]
        filled = np.bincount(cell, minlength=count * rules.bins)
        at = np.flatnonzero(filled)
        owner = at // rules.bins
        starts = np.flatnonzero(np.diff(owner, prepend=-1))  # every open node has rows
        g_cell, n_cell = np.bincount(cell, weights, count * rules.bins)[at], filled[at]
        gl, nl = np.cumsum(g_cell), np.cumsum(n_cell)
        gl -= (gl[starts] - g_cell[starts])[owner]
        nl -= (nl[starts] - n_cell[starts])[owner]
        gain = _gain(gl, nl, total_g[owner], total_n[owner], rules)
        most = np.maximum.reduceat(gain, starts)
        better = np.flatnonzero(most > best)
        if not len(better):
            continue
        top = np.flatnonzero(gain == most[owner])
        first = np.empty(count, np.int64)
        first[owner[top][::-1]] = top[::-1]
        for k in better.tolist():
            best[k], i = most[k], first[k]
            x, y = int(gl[i]), int(nl[i])
            found[k] = (float(most[k]), column, int(at[i] % rules.bins), x, y, int(total_g[k]) - x, int(total_n[k]) - y)
    return found


def _gain(gl, nl, g, n, rules):
    unit, l2 = rules.unit, rules.l2
    left, right, both = gl / unit, (g - gl) / unit, g / unit
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 0.5 * (left * left / (nl + l2) + right * right / (n - nl + l2) - both * both / (n + l2))
    return np.where((nl >= rules.least_rows) & (n - nl >= rules.least_rows), gain, -np.inf)


# ---- distributed parts ----------------------------------------------------------

KINDS = {"_row": np.int64, "_y": np.float64, "_held": np.bool_, "_margin": np.float64}


def _block(row: Row) -> dict[str, np.ndarray]:
    """The arrays of a block."""
    block = {c: np.frombuffer(row[c], KINDS.get(c, np.uint8)) for c in row.__fields__}
    return {**block, "_bins": block["_bins"].reshape(-1, len(block["_y"]))}


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stored rows as blocks."""
    for batch in batches:
        arrays = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in KINDS}
        bins = _matrix(batch.column("_bins"))
        for lo in range(0, batch.num_rows, BLOCK_ROWS):
            block = {c: x[lo:lo + BLOCK_ROWS] for c, x in arrays.items()} | {"_bins": bins[lo:lo + BLOCK_ROWS].T}
            names = [f.split()[0] for f in BLOCKS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([block[c].tobytes()], pa.binary()) for c in names], names)


class _Blocks:
    """Rows as blocks, persisted by their first pass (no plan per pass)."""

    def __init__(self, blocks: RDD):
        self.rdd = blocks.persist(StorageLevel.MEMORY_AND_DISK)

    @property
    def storageLevel(self) -> StorageLevel:
        return self.rdd.getStorageLevel()

    def unpersist(self) -> None:
        self.rdd.unpersist()

    def collect(self) -> list[dict]:
        """Hash and margin of all rows, for small tables."""
        return [{"_row": r, "_margin": m} for b in self.rdd.collect() for r, m in zip(b["_row"].tolist(), b["_margin"].tolist())]


def _matrix(column: pa.Array) -> np.ndarray:
    """The bytes of rows of equal length (none null) as they lie in the column."""
    n, flat = len(column), column.cast(pa.binary())
    _, offsets, data = flat.buffers()
    ends = np.frombuffer(offsets, np.int32)[[flat.offset, flat.offset + n]]
    return np.frombuffer(data, np.uint8)[ends[0]:ends[1]].reshape(n, -1)


def _sampled(row: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """A share of the rows, by a 64-bit mix of row hash, seed and tree."""
    x = row.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) < share * 2.0**53


class _Rows:
    """The training rows of a block that the tree samples, with gradient and
    node so far."""

    def __init__(self, partial: Tree | None, tree: int, seed: int, share: float, unit: float):
        self.partial, self.tree = partial, tree
        self.seed, self.share, self.unit = seed, share, unit

    def __call__(self, block: dict[str, np.ndarray]):
        use = ~block["_held"]
        if self.share < 1:
            use &= _sampled(block["_row"], self.seed, self.tree, self.share)
        rows = np.flatnonzero(use)
        g = np.rint((block["_margin"][rows] - block["_y"][rows]) * self.unit).astype(np.int64)
        node = self.partial.walk(block["_bins"], self.partial.bin, rows) if self.partial else np.zeros(len(g), np.int64)
        return rows, g, node


class _Histogram:
    """Task sums of gradient and rows per (node, column, bin): one record per node
    and column or, ``packed``, one for all of them."""

    def __init__(self, rows: _Rows, nodes: list[int], rules: _Rules, size: int, packed: bool = False):
        self.rows, self.nodes, self.rules, self.size, self.packed = rows, nodes, rules, size, packed

    def __call__(self, blocks: Iterator[dict]) -> Iterator[tuple]:
        place = np.full(self.size, -1)
        place[self.nodes] = np.arange(len(self.nodes))
        shape = (len(self.rules.columns), len(self.nodes) * self.rules.bins)
        g_sum, n_sum = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        for block in blocks:
            rows, g, node = self.rows(block)
            node = place[node]
            here = np.flatnonzero(node >= 0)
            _tally([block["_bins"][c] for c in self.rules.columns], rows[here], node[here] * self.rules.bins, g[here],
                   g_sum, n_sum)
        g_sum, n_sum = (x.reshape(len(self.rules.columns), len(self.nodes), self.rules.bins) for x in (g_sum, n_sum))
        if self.packed:
            yield g_sum, n_sum
            return
        for i, node in enumerate(self.nodes):
            for column in np.flatnonzero(n_sum[:, i].any(axis=1)).tolist():
                yield (node, column), (g_sum[column, i], n_sum[column, i])


def _split_rows(sums: RDD, rules: _Rules) -> RDD:
    """Best split per node of the summed histograms of its columns."""
    def best(cell: tuple) -> tuple:
        (node, column), (g, n) = cell
        s = _found((g[None], n[None]), rules)
        return node, (-math.inf if s["gain"] is None else s["gain"], -column, s)

    def found(node: tuple) -> tuple:
        gain, column, s = node[1]
        return node[0], {**s, "column": column if gain > -math.inf else 0}
    added = sums.reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]))
    return added.map(best).reduceByKey(lambda a, b: max(a, b, key=lambda x: x[:2])).map(found)


def _added_up(packed: Iterable, nodes: list[int], rules: _Rules) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sums per (column, bin) of each node from the packed sums of all tasks."""
    shape = (len(rules.columns), len(nodes), rules.bins)
    g, n = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    for g_task, n_task in packed:
        g += g_task
        n += n_task
    return {node: (g[:, i], n[:, i]) for i, node in enumerate(nodes)}


def _found(sums: tuple[np.ndarray, np.ndarray], rules: _Rules) -> dict | None:
    """Best split of a node from its sums per (column, bin); none without rows."""
    g, n = sums
    gt, nt = int(g[0].sum()), int(n[0].sum())
    if not nt:
        return None
    gain, column, cut, gl, nl = (_best_of_sums(g[:, None], n[:, None], rules)[0] or (None, 0, 0, 0, 0))[:5]
    return {"gain": gain, "column": -column, "bin": -cut, "gl": gl, "nl": nl, "gt": gt, "nt": nt}


class _Deal:
    """Rows of the small open nodes, a record per block and node: the tree's
    columns and the gradient."""

    def __init__(self, rows: _Rows, nodes: list[int], columns: np.ndarray, size: int):
        self.rows, self.nodes, self.columns, self.size = rows, nodes, columns, size

    def __call__(self, blocks: Iterator[dict]) -> Iterator[tuple]:
        place = np.full(self.size, -1)
        place[self.nodes] = np.arange(len(self.nodes))
        for block in blocks:
            rows, g, node = self.rows(block)
            node = place[node]
            order = np.argsort(node, kind="stable")
            order = order[np.searchsorted(node[order], 0):]
            ends = np.searchsorted(node[order], np.arange(len(self.nodes) + 1))
            columns, g = block["_bins"][self.columns].take(rows[order], axis=1), g[order]
            for k in np.flatnonzero(np.diff(ends)).tolist():
                some = slice(ends[k], ends[k + 1])
                yield self.nodes[k], (np.ascontiguousarray(columns[:, some]), g[some])


def _node_table(root: int, rows: list[dict]) -> pa.Table:
    out = pa.Table.from_pylist(rows)
    kinds = {"feature": pa.int32(), "bin": pa.int32(), "left": pa.int32(), "right": pa.int32(),
             "value": pa.float64(), "gain": pa.float64(), "cover": pa.int64()}
    return pa.table({"root": pa.array([root] * len(rows), pa.int32()), "node": pa.array(range(len(rows)), pa.int32()),
                     **{c: out.column(c).cast(kind) for c, kind in kinds.items()}})


def _parts(covers: dict[int, int], parts: int) -> dict[int, int]:
    """Nodes dealt to tasks, the largest first, each to the one with least rows."""
    rows, dealt = [0] * parts, {}
    for node in sorted(covers, key=lambda k: (-covers[k], k)):
        dealt[node] = min(range(parts), key=rows.__getitem__)
        rows[dealt[node]] += covers[node]
    return dealt


def _finisher(depths: dict[int, int], rules: _Rules):
    """The subtrees of the nodes dealt to a task."""
    def finish(records: Iterator[tuple]) -> Iterator[tuple]:
        blocks: dict[int, list] = {}
        for node, block in records:
            blocks.setdefault(node, []).append(block)
        for node in list(blocks):
            columns, g = zip(*blocks.pop(node))
            yield node, grow(np.concatenate(columns, axis=1), np.concatenate(g), depths[node], rules)
    return finish


def _stretch_grower(rules: list[_Rules], first: int, seed: int, share: float):
    """Consecutive trees over the rows of one small table."""
    def stretch(table: pa.Table) -> pa.Table:
        bins = np.ascontiguousarray(_matrix(table.column("_bins").combine_chunks()).T)
        row, y, margin = (table.column(c).to_numpy() for c in ("_row", "_y", "_margin"))
        out = []
        for k, rule in enumerate(rules):
            use = np.flatnonzero(_sampled(row, seed, first + k, share)) if share < 1 else np.arange(len(row))
            g = np.rint((margin[use] - y[use]) * rule.unit).astype(np.int64)
            nodes = grow(bins[rule.columns].take(use, axis=1), g, 0, rule) if len(use) else [_leaf()]
            out.append(_node_table(first + k, nodes))
            tree = Tree([{**n, "threshold": 0.0} for n in nodes])
            margin = margin + tree.value.take(tree.walk(bins, tree.bin))
        return pa.concat_tables(out)
    return stretch


FINISHED = "root int, node int, feature int, bin int, left int, right int, value double, gain double, cover long"


class _Add:
    """Blocks with the margins after one more tree."""

    def __init__(self, tree: Tree):
        self.tree = tree

    def __call__(self, block: dict) -> dict:
        return {**block, "_margin": block["_margin"] + self.tree.value.take(self.tree.walk(block["_bins"], self.tree.bin))}


class _AddAll:
    """Margins after the pending trees; the first row of a batch has the sums of
    its squared errors after each, on training rows, then on held-out ones, and
    their numbers."""

    def __init__(self, pending: list[Tree]):
        self.pending = pending

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            margin, y, held = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_margin", "_y", "_held"))
            bins, errors = np.ascontiguousarray(_matrix(batch.column("_bins")).T), []
            for t in self.pending:
                margin = margin + t.value.take(t.walk(bins, t.bin))
                square = (margin - y) ** 2
                errors.append((float(square[~held].sum()), float(square[held].sum())))
            facts = [[x for side in zip(*errors) for x in side] + [float((~held).sum()), float(held.sum())]]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("_row", "_bins", "_y", "_held")], pa.array(margin),
                 pa.array(facts + [None] * (len(y) - 1), pa.list_(pa.float64()))],
                ["_row", "_bins", "_y", "_held", "_margin", "_errors"])


class _Bin:
    """Features as one byte each."""

    def __init__(self, cuts: list[np.ndarray]):
        self.cuts = cuts

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(self.cuts))
            packed = np.stack([np.searchsorted(c, x[:, k]) for k, c in enumerate(self.cuts)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes() for r in packed], pa.binary()), batch.column("_y"), batch.column("_held")],
                ["_bins", "_y", "_held"])


def bin_cuts(rows: DataFrame, d: int, max_bins: int) -> list[np.ndarray]:
    """Cuts of each feature: its distinct approximate quantiles (a value up to
    and with cut ``b`` is in bin ``b``)."""
    levels = F.array(*[F.lit(i / max_bins) for i in range(1, max_bins)])
    found = rows.agg(*[F.percentile_approx(F.when(~F.isnan(F.col("x")[k]), F.col("x")[k]), levels, 100 * max_bins)
                       .alias(f"q{k}") for k in range(d)]).first()
    return [np.unique(np.array(q if q is not None else [0.0])) for q in found]


# ---- estimator -------------------------------------------------------------------

class _BoostParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    maxIter = Param(Params._dummy(), "maxIter", "most trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "learning rate", TypeConverters.toFloat)
    subsample = Param(Params._dummy(), "subsample", "share of rows per tree", TypeConverters.toFloat)
    colsample = Param(Params._dummy(), "colsample", "share of columns per tree", TypeConverters.toFloat)
    l2 = Param(Params._dummy(), "l2", "L2 term on leaf values", TypeConverters.toFloat)
    minGain = Param(Params._dummy(), "minGain", "least gain of a split", TypeConverters.toFloat)
    minRows = Param(Params._dummy(), "minRows", "least rows of a child", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "bins per feature, at most 256", TypeConverters.toInt)
    localRows = Param(Params._dummy(), "localRows", "rows of a node that one task may hold", TypeConverters.toInt)
    validationCol = Param(Params._dummy(), "validationCol", "true: held out of the fit, for the curve",
                          TypeConverters.toString)
    patience = Param(Params._dummy(), "patience", "rounds without a better validation error before the fit stops "
                     "(0: never)", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        p = C.GBT_PARAMS
        self._setDefault(labelCol=C.TARGET, maxIter=p["n_estimators"], maxDepth=p["max_depth"],
                         stepSize=p["learning_rate"], subsample=p["subsample"], colsample=p["colsample_bytree"],
                         seed=p["random_state"], l2=1.0, minGain=0.0, minRows=1.0, maxBins=256, localRows=50_000,
                         validationCol="", patience=0)


class HistGBTRegressor(Estimator, _BoostParams, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees for squared error with the shipped model's settings."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol=C.TARGET, predictionCol="prediction", maxIter=None,
                 maxDepth=None, stepSize=None, subsample=None, colsample=None, seed=None, l2=None, minGain=None,
                 minRows=None, maxBins=None, localRows=None, validationCol=None, patience=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "HistGBTRegressionModel":
        if not 2 <= self.getOrDefault("maxBins") <= 256:
            raise ValueError("maxBins is from 2 to 256")
        return _Fit(self, df).run()


class _Fit:
    """One fit: the stored rows, the trees so far and the error curve."""

    def __init__(self, est: HistGBTRegressor, df: DataFrame):
        self.est, self.spark = est, df.sparkSession
        get = est.getOrDefault
        held = F.coalesce(F.col(get("validationCol")).cast("boolean"), F.lit(False)) if get("validationCol") else F.lit(False)
        rows = df.select(vector_to_array(get("featuresCol")).alias("x"), F.col(get("labelCol")).cast("double").alias("_y"),
                         held.alias("_held")).where("_y is not null and not isnan(_y)")
        self.folder = None
        train = rows.where("not _held")
        facts = train.agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("mean"), F.min("_y").alias("lo"),
                          F.max("_y").alias("hi"), F.max(F.size("x")).alias("d")).first()
        if not facts["n"]:
            raise ValueError("no labelled training rows")
        self.n, self.d, self.base = facts["n"], facts["d"], round(facts["mean"], 6)
        spread = max(facts["hi"] - facts["lo"], 1e-9) * 4
        bits = min(20, 61 - math.ceil(math.log2(self.n + 1)) - math.ceil(math.log2(spread + 1)))
        self.unit = 2.0**bits
        self.cuts = bin_cuts(train, self.d, get("maxBins"))
        binned = rows.mapInArrow(_Bin(self.cuts), "_bins binary, _y double, _held boolean")
        self._store(binned.select(F.xxhash64("_bins", "_y").alias("_row"), "_bins", "_y", "_held",
                                  F.lit(self.base).alias("_margin")))
        self.pending: list[Tree] = []
        self.live: _Blocks | None = None
        self.stale: _Blocks | None = None
        self.trees: list[Tree] = []
        self.curve: list[tuple[float, float | None]] = []

    def _store(self, rows: DataFrame) -> None:
        before = self.folder
        self.folder = shared_path(self.spark, "boosting", uuid.uuid4().hex)
        rows.write.parquet(self.folder)
        self.state = self.spark.read.schema(ROWS).parquet(self.folder)
        self.tasks = self.state.rdd.getNumPartitions()
        if before:
            remove_path(self.spark, before)

    def run(self) -> "HistGBTRegressionModel":
        get = self.est.getOrDefault
        best, stopped = 0, None
        while len(self.trees) < get("maxIter") and stopped is None:
            until = min(len(self.trees) + STORE_EVERY, get("maxIter"))
            if self.n <= get("localRows"):
                self._add_trees(self._stretch(len(self.trees), until))
            while len(self.trees) < until:
                self._add_trees([self._tree(len(self.trees))])
                if len(self.trees) < until:
                    self._advance(self.trees[-1])
            self._release()
            first = len(self.curve)
            self._add_margins()
            for k in range(first, len(self.curve)) if get("patience") and get("validationCol") else ():
                if self.curve[k][1] is not None and self.curve[k][1] < (self.curve[best][1] or math.inf):
                    best = k
                if k - best >= get("patience"):
                    stopped = k
                    break
        remove_path(self.spark, self.folder)
        keep = best + 1 if get("patience") and get("validationCol") else len(self.trees)
        seen = len(self.curve) if stopped is None else stopped + 1
        model = HistGBTRegressionModel()
        self.est._copyValues(model)
        model._init(self.base, self.d, [t.rows for t in self.trees[:keep]], self.curve[:seen])
        return model

    def _add_trees(self, trees: list[Tree]) -> None:
        self.trees += trees
        self.pending += trees

    def _advance(self, tree: Tree) -> None:
        """The rows with the margins after ``tree``, persisted by their first
        pass; those that they are made from stay until then."""
        after = _Blocks(self._blocks().map(_Add(tree)))
        if self.stale is not None:
            self.stale.unpersist()
        self.stale, self.live = self.live, after

    def _current(self) -> DataFrame | _Blocks:
        return self.state if self.live is None else self.live

    def _blocks(self) -> RDD:
        if self.live is None:
            self.live = _Blocks(self.state.mapInArrow(_pack, BLOCKS).rdd.map(_block))
        return self.live.rdd

    def _release(self) -> None:
        for rows in (self.stale, self.live):
            if rows is not None:
                rows.unpersist()
        self.stale = self.live = None

    def _rules(self, t: int) -> _Rules:
        get = self.est.getOrDefault
        rng = np.random.default_rng([get("seed") % 2**32, t])
        columns = np.sort(rng.permutation(self.d)[:max(1, math.ceil(get("colsample") * self.d))])
        return _Rules(get("maxDepth"), get("stepSize"), get("l2"), get("minGain"), get("minRows"), self.unit,
                      max(len(c) for c in self.cuts) + 1, columns)

    def _stretch(self, first: int, until: int) -> list[Tree]:
        """The next trees of a table of at most ``localRows`` rows, grown by one
        task in one job: the trees that :meth:`_tree` gives."""
        get = self.est.getOrDefault
        grown = _stretch_grower([self._rules(t) for t in range(first, until)], first, get("seed"), get("subsample"))
        rows = (self.state.where("not _held").select(F.lit(0).alias("node"), "_row", "_bins", "_y", "_margin")
                .groupBy("node").applyInArrow(grown, FINISHED).collect())  # STORE_EVERY trees
        trees: dict[int, dict[int, dict]] = {}
        for r in rows:
            trees.setdefault(r["root"], {})[r["node"]] = r.asDict()
        return [self._with_thresholds([trees[k][i] for i in range(len(trees[k]))]) for k in sorted(trees)]

    def _with_thresholds(self, nodes: list[dict]) -> Tree:
        for n in nodes:
            n["threshold"] = self._threshold(n["feature"], n["bin"]) if n["left"] >= 0 else 0.0
        return Tree(nodes)

    def _add_margins(self) -> None:
        """Store the margins; the errors of the stretch are observed in the
        same pass."""
        k = len(self.pending)
        added = self.state.mapInArrow(_AddAll(self.pending), f"{ROWS}, _errors array<double>")
        seen = Observation()
        sums = [F.sum(F.col("_errors")[i]).alias(f"e{i}") for i in range(2 * k + 2)]
        self._store(added.observe(seen, *sums).select("_row", "_bins", "_y", "_held", "_margin"))
        found = seen.get
        for i in range(k):
            self.curve.append(tuple(math.sqrt(found[f"e{i + k * h}"] / found[f"e{2 * k + h}"]) if found[f"e{2 * k + h}"] else None
                                    for h in (0, 1)))
        self.pending = []

    def _tree(self, t: int) -> Tree:
        rules = self._rules(t)
        nodes, depth = [_leaf(cover=int(self.n))], {0: 0}
        big, small = ([0], []) if self.n > self.est.getOrDefault("localRows") else ([], [0])
        known: dict[int, tuple] = {}
        while big:
            nodes, big, known = self._split(t, nodes, big, depth, rules, small, known)
        if small:
            self._finish(t, nodes, small, depth, rules)
        return self._with_thresholds(nodes)

    def _threshold(self, feature: int, b: int) -> float:
        cuts = self.cuts[feature]
        return float(cuts[b]) if b < len(cuts) else math.inf

    def _rows(self, t: int, nodes: list[dict]) -> _Rows:
        partial = Tree(nodes) if len(nodes) > 1 else None
        return _Rows(partial, t, self.est.getOrDefault("seed"), self.est.getOrDefault("subsample"), self.unit)

    def _split(self, t, nodes, big, depth, rules, small, parents):
        """Split the big nodes of a level; children are big, small or leaves.
        ``parents`` holds the sums of the level above by node, if they were added
        up by the driver; then one of two siblings is summed."""
        cells = rules.bins * len(rules.columns)
        at_once = max(1, CELLS // cells)
        next_big: list[int] = []
        rows = self._rows(t, nodes)
        found, known = {}, {}
        asked = [min((nodes[p]["left"], nodes[p]["right"]), key=lambda k: nodes[k]["cover"]) for p in parents] or big
        if self.tasks * len(asked) * cells <= SUMS:
            packed = self._blocks().mapPartitions(_Histogram(rows, asked, rules, len(nodes), packed=True))
            sums = _added_up(packed.collect(), asked, rules)  # a record per task
            for p, one in zip(parents, asked):
                other = nodes[p]["left"] + nodes[p]["right"] - one
                sums[other] = tuple(x - y for x, y in zip(parents[p], sums[one]))
            known = {node: sums[node] for node in big}
            found = {node: s for node in big if (s := _found(known[node], rules))}
        for lo in range(0, 0 if known else len(big), at_once):
            some = big[lo:lo + at_once]
            sums = self._blocks().mapPartitions(_Histogram(rows, some, rules, len(nodes)))
            found.update(_split_rows(sums, rules).collect())  # a record per node
        for node in big:
            s = found.get(node)
            if s is None:
                continue
            if node == 0:
                nodes[0].update(value=rules.value(s["gt"], s["nt"]), cover=s["nt"])
            if s["gain"] is None:
                continue
            nodes[node].update(feature=int(rules.columns[-s["column"]]), bin=-s["bin"], left=len(nodes),
                               right=len(nodes) + 1, gain=s["gain"])
            for g, n in ((s["gl"], s["nl"]), (s["gt"] - s["gl"], s["nt"] - s["nl"])):
                child = len(nodes)
                depth[child] = depth[node] + 1
                nodes.append(_leaf(rules.value(g, n), n))
                if depth[child] < rules.depth:
                    (next_big if n > self.est.getOrDefault("localRows") else small).append(child)
        return nodes, next_big, {p: s for p, s in known.items() if {nodes[p]["left"], nodes[p]["right"]} & {*next_big}}

    def _finish(self, t, nodes, small, depth, rules) -> None:
        """Grow the subtrees of the small nodes, each in one task."""
        covers = {n: nodes[n]["cover"] for n in small}
        parts = max(1, min(len(small), max(self.spark.sparkContext.defaultParallelism,
                                           2 * sum(covers.values()) // self.est.getOrDefault("localRows"))))
        dealt = self._blocks().mapPartitions(_Deal(self._rows(t, nodes), small, rules.columns, len(nodes)))
        done = dealt.partitionBy(parts, _parts(covers, parts).__getitem__).mapPartitions(_finisher({n: depth[n] for n in small}, rules))
        trees = dict(done.collect())  # at most 2 ** (maxDepth + 1) nodes
        for root in sorted(trees):
            found = trees[root]
            place = {k: root if k == 0 else len(nodes) + k - 1 for k in range(len(found))}
            nodes.extend(_leaf() for _ in range(len(found) - 1))
            for k, r in enumerate(found):
                row = {c: r[c] for c in ("feature", "bin", "value", "gain", "cover")}
                row.update(left=place.get(r["left"], -1), right=place.get(r["right"], -1))
                nodes[place[k]].update(row)


class _ModelWriter(DefaultParamsWriter):
    """Parameters as JSON, trees and curve as Parquet."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        m, spark = self.instance, self.sparkSession
        spark.createDataFrame(m.tree_rows(), TREE).coalesce(1).write.parquet(f"{path}/trees")
        spark.createDataFrame([(m.base, m.numFeatures, [c[0] for c in m.curve], [c[1] for c in m.curve])],
                              "base double, d int, train array<double>, validation array<double>").write.parquet(f"{path}/fit")


class _ModelReader(DefaultParamsReader):
    def load(self, path: str) -> "HistGBTRegressionModel":
        m = super().load(path)
        spark = SparkSession.getActiveSession()
        rows = spark.read.parquet(f"{path}/trees").orderBy("tree", "node").collect()
        trees: list[list[dict]] = []
        for r in rows:
            if r["node"] == 0:
                trees.append([])
            trees[-1].append(r.asDict())
        fit = spark.read.parquet(f"{path}/fit").first()
        m._init(fit["base"], fit["d"], trees, list(zip(fit["train"], fit["validation"])))
        return m


class _Coded:
    """Raw features as their places among the thresholds of all trees, a line per
    feature; a missing value comes after all of them."""

    def __init__(self, trees: list[Tree], d: int):
        feature, threshold, left = (np.concatenate([np.empty(0), *(getattr(t, c) for t in trees)])
                                    for c in ("feature", "threshold", "left"))
        self.levels, cuts = [], np.zeros(len(left), np.int64)
        for k in range(d):
            here = np.flatnonzero((feature == k) & (left >= 0))
            self.levels.append(np.unique(threshold[here]))
            cuts[here] = np.searchsorted(self.levels[k], threshold[here])
        self.cuts = np.split(cuts, np.cumsum([len(t.left) for t in trees])[:-1])

    def codes(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(level, rows[:, k]) for k, level in enumerate(self.levels)]).astype(np.uint16)


class HistGBTRegressionModel(Model, _BoostParams, MLReadable, MLWritable):
    """Fitted trees.  ``curve`` holds (training RMSE, validation RMSE or None)
    of every round that was looked at; ``trees`` ends at the best one."""

    def _init(self, base: float, d: int, trees: list[list[dict]], curve: list) -> None:
        self.base, self.numFeatures, self.curve = base, d, curve
        self.trees = [Tree(t) for t in trees]

    def write(self) -> DefaultParamsWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> DefaultParamsReader:
        return _ModelReader(cls)

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    def tree_rows(self) -> list[tuple]:
        names = [c.split()[0] for c in NODE.split(", ")]
        return [(t, k, *[r[c] for c in names]) for t, tree in enumerate(self.trees) for k, r in enumerate(tree.rows)]

    def _transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.base, self.trees))

        @F.pandas_udf(T.DoubleType())
        def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            base, trees = shared.value
            coded = None
            for x in batches:
                if not len(x):
                    yield pd.Series([], dtype=float)
                    continue
                rows, out = np.stack(x.to_numpy()), np.full(len(x), base)
                coded = coded or _Coded(trees, rows.shape[1])
                columns = coded.codes(rows)
                for t, cut in zip(trees, coded.cuts):
                    out += t.value.take(t.walk(columns, cut))
                yield pd.Series(out)
        return df.withColumn(self.getPredictionCol(), predict(vector_to_array(self.getFeaturesCol())))

    def staged_errors(self, df: DataFrame) -> DataFrame:
        """RMSE over labelled rows after each tree: ``iteration`` from 1."""
        shared = df.sparkSession.sparkContext.broadcast((self.base, self.trees))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base, trees = shared.value
            sums, n, coded = np.zeros(len(trees)), 0, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y = np.array(batch.column("x").to_pylist(), np.float64), batch.column("y").to_numpy()
                margin, n = np.full(len(y), base), n + len(y)
                coded = coded or _Coded(trees, x.shape[1])
                columns = coded.codes(x)
                for k, (t, cut) in enumerate(zip(trees, coded.cuts)):
                    margin += t.value.take(t.walk(columns, cut))
                    sums[k] += float(((margin - y) ** 2).sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, len(trees) + 1, dtype=np.int32)), pa.array(sums),
                                              pa.array(np.full(len(trees), n))], ["iteration", "s", "n"])
        rows = df.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"))
        return (rows.where("y is not null").mapInArrow(run, "iteration int, s double, n long").groupBy("iteration")
                .agg(F.sqrt(F.sum("s") / F.sum("n")).alias("rmse")))

    def importances(self) -> np.ndarray:
        """Share of the total gain per feature slot."""
        out = np.zeros(self.numFeatures)
        for t in self.trees:
            for r in t.rows:
                if r["left"] >= 0:
                    out[r["feature"]] += r["gain"]
        return out / out.sum() if out.sum() else out


def source_importances(importances: np.ndarray, loadings: np.ndarray, names: Sequence[str]) -> dict[str, float]:
    """Importances of components carried back to their inputs: a component's
    share is dealt by its squared loadings (they sum to 1), then summed by
    input name."""
    weight = (loadings ** 2) / np.maximum((loadings ** 2).sum(axis=0), 1e-300)
    out: dict[str, float] = {}
    for name, share in zip(names, weight @ importances):
        out[name] = out.get(name, 0.0) + float(share)
    return out

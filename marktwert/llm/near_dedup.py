"""MinHash near-dedup by the chosen-path set similarity join.

Every text becomes its set of distinct word shingles.  Equal sets are one
*class*; only classes are joined.  A class is embedded as ``TOKENS`` minwise
tokens.  Each of ``TREES`` independent trees starts with the path of two tokens
of its own (a node by one token holds every text with one common shingle, so it
would nearly always branch) and branches a node into two children by the values
of two token coordinates drawn from the node's own key, so a class needs nothing
but its tokens to find its nodes.  A node of at most ``NODE`` classes is compared
exhaustively on 2-bit token sketches and set sizes; larger ones branch again.
A pair of similarity 0.8 is missed by all trees with a probability of about 8e-8
at the first nodes; below them all draws come from ``BRANCHES`` coordinates, so
the miss grows with the depth of its nodes: about 7e-6 at depth 2, 3e-5 at 3,
7e-5 at 4, 3e-4 at 10.
Every candidate is confirmed on the full shingle sets of both texts.

Skew.  A large group of near copies never splits, so groups are collapsed
first: in ``PROPOSAL_ROUNDS`` rounds every class proposes two neighbours of
another label (the most similar one, and the least of the clearly similar ones,
which makes a hub), confirmed links give labels, and the full join then looks
for pairs of different labels only.  A node with one label ends.  In a large
node where one label outweighs the rest, only the rest meets the chunks of that
label.  A large node that did not split at depth ``SPLIT_DEPTH`` is compared in
blocks, cell by cell.  So the work on a group of copies follows its size, and
no pair is dropped.  Counts are combined before they are shuffled; a hub's
candidates are dealt to salted parts.

Rows move only to nodes with two labels, and texts only for candidates: a
bitmap of fixed size over the hashed keys keeps most others out of the shuffle
(saturated, it just passes more).  In
the large nodes, where one class may have many candidates, rows without a
similar sketch in their chunk are dropped, then texts go to the chunks once a
row, not once a pair, and pairs are confirmed on the spot.

Defined results: null text, empty text and text without words have an empty
set, no links and form their own component; fewer words than a shingle give one
shingle; rows with equal sets are linked; repeated rows get equal results; a
null id takes part in links, and ``component_id`` ignores null ids (null only if
no member has one); other columns of ``docs`` are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marktwert.llm import common as C

#: Minwise tokens of a sketch; the first ``BRANCHES`` of them choose branches.
TOKENS = 256
BRANCHES = 32
TREES = 16
NODE = 300
#: Trees of the rounds that propose neighbours.
PROPOSAL_ROUNDS = ((0, 1, 2, 3, 4), (5, 6, 7, 8, 9))
SPLIT_DEPTH = 2
#: A large node beyond this many chunks branches on, whatever its depth.
MAX_CELLS = 40
MAX_DEPTH = 24
PAIRS_AT_ONCE = 400_000
#: Equal 2-bit tokens of 256: five standard deviations below the mean of a
#: similarity of 0.8, and that mean.
LEAST_EQUAL = 189
CLEARLY_EQUAL = 218
HUB_PART = 128
FILTER_BITS = 1 << 24

_rng = np.random.default_rng(7)
_MUL = _rng.integers(1, 2**64, TOKENS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**64, TOKENS, dtype=np.uint64)
#: One salt per tree or branch (array product: wraps silently).
_SALT = np.arange(2 * TOKENS + 3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


# ---- classes ---------------------------------------------------------------
def _tokens(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens (16 bit) of non-empty sets."""
    out = np.empty((len(sets), TOKENS), np.uint16)
    if not sets:
        return out
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    for j in range(TOKENS):
        least = np.minimum.reduceat(flat * _MUL[j] + _ADD[j], at)
        out[:, j] = (C.mix(least) >> np.uint64(48)).astype(np.uint16)
    return out


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    words = C.Words(texts, C.SPACE_WORDS)
    return C.shingle_sets(words.hashes(), words.first, k)


def _describe(batches, k: int, id_col: str, text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in C.pieces(batches):
        texts, ids = C.as_bytes(batch.column(text_col)), batch.column(id_col)
        for lo, hi in C.slices(texts):
            sets = _sets(texts[lo:hi], k)
            # sets under four shingles are similar to equal sets only
            large = [i for i, s in enumerate(sets) if len(s) >= 4]
            tokens = _tokens([sets[i] for i in large])
            where = np.full(len(sets), -1)
            where[large] = np.arange(len(large))
            where = pa.array(where, pa.int64(), mask=where < 0)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_digest(s) for s in sets], pa.binary()),
                 C.fixed_binary(tokens[:, :BRANCHES]).take(where), C.fixed_binary(_sketch(tokens)).take(where)],
                ["id", "n", "rid", "sig", "sketch"])


# ---- nodes -----------------------------------------------------------------
#: What a row of a node carries: to be counted, compared, or branched again.
_COUNT = "node long, lab long"
_LEAF = "node long, n long, cid long, lab long, sketch binary"
_TRACE = "node long, n long, cid long, lab long, sig binary, sketch binary"


def _sketch(tokens: np.ndarray) -> np.ndarray:
    """2 bits of each token, four to a byte."""
    low = (tokens & np.uint16(3)).astype(np.uint8)
    return low[:, 0::4] | (low[:, 1::4] << 2) | (low[:, 2::4] << 4) | (low[:, 3::4] << 6)


def _branch(batches, trees: tuple[int, ...] | None, schema: str) -> Iterator[pa.RecordBatch]:
    """Rows of the first nodes (tree ``r``: the path of tokens 2r and 2r + 1),
    or, without ``trees``, of the children of each row's node."""
    names = [f.split()[0] for f in schema.split(", ")]
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            part = batch.slice(lo, 4096)
            tokens = C.matrix(part.column("sig"), "<u2")
            if trees is not None:
                nodes = [C.mix((tokens[:, 2 * r].astype(np.uint64) << np.uint64(16) | tokens[:, 2 * r + 1]) + _SALT[r + 3])
                         for r in trees]
            else:
                node = part.column("node").to_numpy().view(np.uint64)
                nodes = []
                for branch in (1, 2):
                    drawn = C.mix(node + _SALT[branch])
                    value = tokens[np.arange(len(node)), (drawn % np.uint64(BRANCHES)).astype(np.int64)]
                    nodes.append(C.mix(drawn ^ C.mix(value.astype(np.uint64))))
            rest = [part.column(c) for c in names[1:]]
            for node in nodes:
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *rest], names)


def _similar(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers i < j of similar sketches inside each run of ``keys`` (rows
    sorted by keys and n) with different labels, and their equal tokens.
    ``side`` (if present): rows of side 1 were copied to every chunk, two of
    them meet in chunk 0 only; 2 and 3 are the two row blocks of a cell, of
    which only rows of different blocks meet."""
    count = batch.num_rows
    n = batch.column("n").to_numpy()
    key = [batch.column(k).to_numpy() for k in keys]
    new = np.ones(count, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
    run = np.cumsum(new) - 1
    ends = np.append(np.flatnonzero(new)[1:], count)[run]
    # sizes of a similar pair: 80 % of the larger is at most the smaller
    big = int(n.max()) + 1
    reach = np.searchsorted(run * (2 * big) + n, run * (2 * big) + np.minimum(n + n // 4, big), side="right")
    partners = np.maximum(np.minimum(reach, ends) - np.arange(count) - 1, 0)
    total = np.concatenate([[0], np.cumsum(partners)])
    sketch, label = C.matrix(batch.column("sketch"), "<u8"), batch.column("lab").to_numpy()
    side = batch.column("side").to_numpy() if "side" in batch.schema.names else None
    at = 0
    while at < count:
        to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS_AT_ONCE, side="right")) - 1)
        size = partners[at:to]
        i = np.repeat(np.arange(at, to), size)
        j = i + 1 + np.arange(len(i)) - np.repeat(total[at:to] - total[at], size)
        ok = label[i] != label[j]
        if side is not None:
            ok &= (side[i] != side[j]) | (side[i] == 0) | (side[i] == 1) & (key[1][i] == 0)
        i, j = i[ok], j[ok]
        same = np.full(len(i), TOKENS)
        for w in range(sketch.shape[1]):
            x = sketch[i, w] ^ sketch[j, w]
            same -= np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555))
        ok = same >= LEAST_EQUAL
        if ok.any():
            yield i[ok], j[ok], same[ok]
        at = to


def _batches(tables) -> Iterator[pa.RecordBatch]:
    for table in tables:
        yield table.combine_chunks().to_batches()[0]


def _all_pairs(batches, keys: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in _batches(C.whole_runs(batches, keys)):
        cid = batch.column("cid").to_numpy()
        for i, j, _ in _similar(batch, keys):
            a, b = np.minimum(cid[i], cid[j]), np.maximum(cid[i], cid[j])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _proposals(batches, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Per class of a run: its most similar partner of another label with the
    number of equal tokens, and the least clearly similar partner."""
    for batch in _batches(C.whole_runs(batches, keys)):
        cid, count = batch.column("cid").to_numpy(), batch.num_rows
        best, score = np.full(count, -1), np.full(count, -1)
        hub = np.full(count, np.iinfo(np.int64).max)
        for i, j, same in _similar(batch, keys):
            for x, y in ((i, j), (j, i)):
                order = np.argsort(same, kind="stable")
                x_, y_, s_ = x[order], y[order], same[order]
                top = np.full(count, -1)
                top[x_] = np.arange(len(x_))  # the last write is the most similar
                rows = np.flatnonzero(top >= 0)
                pick = top[rows]
                better = s_[pick] > score[rows]
                best[rows[better]], score[rows[better]] = y_[pick[better]], s_[pick[better]]
                clear = same >= CLEARLY_EQUAL
                np.minimum.at(hub, x[clear], cid[y[clear]])
        rows = np.flatnonzero(best >= 0)
        hubs = hub[rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cid[rows]), pa.array(cid[best[rows]]), pa.array(score[rows]),
             pa.array(hubs, pa.int64(), mask=hubs == np.iinfo(np.int64).max)], ["cid", "best", "score", "hub"])


def _deal(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, "n", "cid")


def _columns(*more: str) -> list[str]:
    return ["node", *more, "n", "cid", "lab", "sketch"]


def _own_part(parts: F.Column) -> F.Column:
    return F.pmod(F.xxhash64("cid"), parts)


def _perhaps_in(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The ``rows`` whose ``key`` is in ``wanted``, and a few others: a filter by
    a bitmap of at most ``FILTER_BITS / 64`` words over the hashed keys, which is
    the most that is ever broadcast (saturated, it just passes more)."""
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bit = F.expr("shiftleft(1L, cast(_place % 64 as int))")
    words = (wanted.select(place.alias("_place")).groupBy((F.expr("_place div 64")).alias("_word"))
             .agg(F.bit_or(bit).alias("_bits")))
    return (rows.withColumn("_place", place).join(F.broadcast(words), F.expr("_place div 64") == F.col("_word"))
            .where(F.col("_bits").bitwiseAND(bit) != 0).select(*rows.columns))


def _in_nodes(rows: DataFrame, nodes: DataFrame, *more: str) -> DataFrame:
    """The rows of ``nodes`` (each listed once) with the columns ``more`` of their
    node: most others go before the shuffle of the join.  An inner join, as a semi
    join is pushed below the filter."""
    nodes = nodes.select("node", *more)
    return _perhaps_in(rows, nodes, "node").join(nodes, "node").select(*rows.columns, *more)


def _walk(spark: SparkSession, recs: DataFrame, trees: tuple[int, ...], node_limit: int, deepest: int):
    """Nodes level by level: (rows of small nodes, the rows of the level by
    schema, the list of large nodes with ``c`` and ``parts``, whether this level is
    the last).  Nodes with one label are left out.  The rows of a level are branched
    each time from those of the level above in its large nodes, which are moved and
    stored once."""
    parents, roots = recs.select("n", "cid", "lab", "sig", "sketch"), trees
    for depth in range(1, deepest + 1):
        def rows(schema: str, parents=parents, roots=roots) -> DataFrame:
            return parents.mapInArrow(partial(_branch, trees=roots, schema=schema), schema)

        counts = rows(_COUNT).groupBy("node").agg(F.count("*").alias("c"), F.min("lab").alias("lo"), F.max("lab").alias("hi"))
        mixed = C.store(spark, counts.where("lo <> hi").select("node", "c"), "nodes")
        small = _in_nodes(rows(_LEAF), mixed.where(F.col("c") <= node_limit))
        big = C.store(spark, mixed.where(F.col("c") > node_limit).withColumn(
            "parts", F.ceil(F.col("c") / node_limit).cast("long")), "big")
        if big.isEmpty():
            yield small, None, None, True
            return
        onward = yield small, rows, big, depth == deepest
        if depth == deepest:
            return
        parents = C.store(spark, _in_nodes(rows(_TRACE), big if onward is None else onward), "trace")
        roots = None


def _proposed(spark: SparkSession, recs: DataFrame, trees: tuple[int, ...], node_limit: int) -> DataFrame:
    """Pairs of classes with their proposed neighbours: at most two a class.
    Nodes that are still large at ``SPLIT_DEPTH`` are cut into chunks."""
    dealt = []
    for small, rows, big, last in _walk(spark, recs, trees, node_limit, SPLIT_DEPTH):
        dealt.append(small.withColumn("part", F.lit(0).cast("long")).select(_columns("part")))
        if last and big is not None:
            dealt.append(_in_nodes(rows(_LEAF), big, "parts").withColumn("part", _own_part(F.col("parts")))
                         .select(_columns("part")))
    keys = ["node", "part"]
    found = _deal(_union(dealt), keys).mapInArrow(partial(_proposals, keys=keys), "cid long, best long, score long, hub long")
    best = found.groupBy("cid").agg(F.max(F.struct("score", "best")).alias("best"), F.min("hub").alias("hub"))
    pairs = best.select("cid", F.explode(F.array("best.best", "hub")).alias("other")).where("other is not null")
    return pairs.select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")).distinct()


def _remaining(spark: SparkSession, recs: DataFrame, trees: int, node_limit: int) -> tuple[DataFrame, DataFrame | None]:
    """For all pairs of different labels that meet in a node: the candidate
    pairs of small nodes, and the rows of large nodes dealt to (node, part)."""
    compared, dealt = [], []
    columns = [*_columns("part"), "side"]
    zero = F.lit(0).cast("long")
    walk = _walk(spark, recs, tuple(range(trees)), node_limit, MAX_DEPTH)
    step, depth = next(walk), 1
    while True:
        small, level, big, last = step
        compared.append(small.select(_columns()))
        if big is None:
            break
        # the heaviest label of each large node
        heaviest = (_in_nodes(level(_COUNT), big).groupBy("node", "lab").agg(F.count("*").alias("k")).groupBy("node")
                    .agg(F.max(F.struct("k", "lab")).alias("t")))
        top = C.store(spark, big.join(heaviest, "node").select(
            "node", F.col("t.lab").alias("top"), (F.col("c") - F.col("t.k")).alias("rest"), "parts"), "top")
        every = F.sequence(zero, F.col("parts") - 1)
        uneven = F.col("rest") <= node_limit
        cells = ~uneven & ((F.col("parts") <= MAX_CELLS) & F.lit(depth >= SPLIT_DEPTH) | F.lit(last))
        rows = _in_nodes(level(_LEAF), top.where(uneven | cells), "top", "rest", "parts").withColumn(
            "own", _own_part(F.col("parts")))
        # one label outweighs the rest: the rest meets every chunk of that label
        chunks = (rows.where(uneven).withColumn("side", F.when(F.col("lab") == F.col("top"), 0).otherwise(1).cast("long"))
                  .withColumn("part", F.explode(F.when(F.col("side") == 0, F.array("own")).otherwise(every))))
        # exhaustive in blocks: the rows of block x meet those of block y in cell (x, y)
        blocks = (rows.where(cells).withColumn("y", F.explode(every))
                  .withColumn("part", F.least("own", "y") * F.col("parts") + F.greatest("own", "y"))
                  .withColumn("side", F.when(F.col("own") == F.col("y"), 0).when(F.col("own") < F.col("y"), 2)
                              .otherwise(3).cast("long")))
        dealt += [chunks.select(columns), blocks.select(columns)]
        onward = C.store(spark, top.where(~uneven & ~cells).select("node"), "onward")
        if last or onward.isEmpty():
            break
        step, depth = walk.send(onward), depth + 1
    pairs = _deal(_union(compared), ["node"]).mapInArrow(partial(_all_pairs, keys=["node"]), "a long, b long").distinct()
    return pairs, _union(dealt) if dealt else None


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.union(more)
    return out


# ---- confirmation ----------------------------------------------------------
def _needed_texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``text`` of the documents whose id is in ``ids``, and of a few others."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _perhaps_in(texts, ids, "id").select("text")


def _with_rid(batches, k: int) -> Iterator[pa.RecordBatch]:
    for batch in C.pieces(batches):
        texts = C.as_bytes(batch.column("text"))
        rid = [_digest(s) for lo, hi in C.slices(texts) for s in _sets(texts[lo:hi], k)]
        yield pa.RecordBatch.from_arrays([pa.array(rid, pa.binary()), batch.column("text")], ["rid", "text"])


def _confirmed(batches, k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links of each hub (role 0) with its candidates (role 1)."""
    for batch in _batches(C.whole_runs(batches, ["a", "salt"])):
        texts = C.as_bytes(batch.column("text"))
        a, salt, role, cid = (batch.column(c).to_numpy() for c in ("a", "salt", "role", "cid"))
        links, hub, of = [], None, None
        for lo, hi in C.slices(texts):
            for i, own in enumerate(_sets(texts[lo:hi], k), lo):
                if role[i] == 0:
                    hub, of = own, (a[i], salt[i])
                elif of == (a[i], salt[i]):
                    both = len(np.intersect1d(hub, own, assume_unique=True))
                    if 100 * both >= percent * (len(hub) + len(own) - both):
                        links.append((a[i], cid[i]))
        found = np.array(links, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])


def _confirm(spark, docs, recs, pairs, k, percent, id_col, text_col) -> DataFrame:
    """Links among the candidate ``pairs`` (a < b), by the full shingle sets.
    Candidates go to their hub ``a``, a hub with many to several parts."""
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_PART).cast("long").alias("salts"))
    hub_rows = hubs.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"),
                           F.lit(0).alias("role"), F.col("a").alias("cid"))
    rows = (pairs.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"),
                                         F.lit(1).alias("role"), F.col("b").alias("cid")).unionByName(hub_rows))
    keys = recs.select("cid", "rid", "least")
    roles = C.store(spark, rows.join(keys, "cid"), "roles")
    texts = _needed_texts(docs, roles.select(F.col("least").alias("id")), id_col, text_col)
    moved = (texts.mapInArrow(partial(_with_rid, k=k), "rid binary, text string")
             .join(roles.drop("least"), "rid").select("a", "salt", "role", "cid", "text"))
    return (moved.repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "cid")
            .mapInArrow(partial(_confirmed, k=k, percent=percent), "u long, v long").distinct())


def _met(batches, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows that have a similar row of another label in their run."""
    for batch in _batches(C.whole_runs(batches, keys)):
        met = np.zeros(batch.num_rows, bool)
        for i, j, _ in _similar(batch, keys):
            met[i] = met[j] = True
        yield batch.filter(pa.array(met))


def _dense_links(batches, keys: list[str], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Confirmed links of similar rows in each run; two labels that are linked
    in a run need no further pair there."""
    for batch in _batches(C.whole_runs(batches, keys)):
        cid, lab = batch.column("cid").to_numpy(), batch.column("lab").to_numpy()
        texts, sets, links = batch.column("text"), {}, []
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        for i, j, _ in _similar(batch, keys):
            need = [r for r in np.unique(np.concatenate([i, j])).tolist() if r not in sets]
            raw = C.as_bytes(texts.take(pa.array(need, pa.int64())))
            for lo, hi in C.slices(raw):
                sets.update(zip(need[lo:hi], _sets(raw[lo:hi], k)))
            for x, y in zip(i.tolist(), j.tolist()):
                p, q = find(int(lab[x])), find(int(lab[y]))
                if p == q:
                    continue
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    links.append((cid[x], cid[y]))
                    root[max(p, q)] = min(p, q)
        found = np.array(links, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])


def _confirm_dense(spark, docs, recs, dealt, k, percent, id_col, text_col) -> DataFrame:
    """Links among the rows of large nodes: each row that has a similar one
    takes its text along."""
    keys = ["node", "part"]
    dealt = C.store(spark, _deal(dealt, keys).mapInArrow(partial(_met, keys=keys), dealt.schema), "dealt")
    need = C.store(spark, recs.select("cid", "rid", "least").join(dealt.select("cid").distinct(), "cid", "left_semi"), "need")
    texts = (_needed_texts(docs, need.select(F.col("least").alias("id")), id_col, text_col)
             .mapInArrow(partial(_with_rid, k=k), "rid binary, text string")
             .join(need.select("rid", "cid"), "rid").groupBy("cid").agg(F.min("text").alias("text")))
    return (_deal(dealt.join(texts, "cid"), keys)
            .mapInArrow(partial(_dense_links, keys=keys, k=k, percent=percent), "u long, v long").distinct())


# ---- the operator ----------------------------------------------------------
def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 2, percent: int = 80, trees: int = TREES,
                    node_limit: int = NODE) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n_shingles``, ``class`` (digest of
    the shingle set, null if empty) and ``component_id`` (least id reachable)."""
    if percent < 80:
        raise ValueError("the sketches and trees are laid out for a similarity of 80 % or more")
    id_type = docs.schema[id_col].dataType.simpleString()
    sigs = C.store(spark, docs.select(id_col, text_col).mapInArrow(
        partial(_describe, k=shingle, id_col=id_col, text_col=text_col),
        f"id {id_type}, n long, rid binary, sig binary, sketch binary"), "signatures")
    recs = C.store(spark, sigs.where("rid is not null").groupBy("rid").agg(
        F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"), F.min("id").alias("least"))
        .withColumn("cid", F.monotonically_increasing_id()), "classes")
    joined = recs.where("n >= 4").select("cid", "n", "sig", "sketch")
    # label of each class with links, where it is not the class itself
    labels = C.store(spark, joined.select("cid", F.col("cid").alias("lab")).limit(0), "labels")
    check = (shingle, percent, id_col, text_col)
    rounds = [partial(_proposed, trees=t, node_limit=node_limit) for t in PROPOSAL_ROUNDS if max(t) < trees]
    for candidates in [*rounds, partial(_remaining, trees=trees, node_limit=node_limit)]:
        labelled = C.store(spark, joined.join(labels, "cid", "left").withColumn("lab", F.coalesce("lab", "cid")), "labelled")
        pairs, dealt = candidates(spark, labelled.select("cid", "n", "sig", "sketch", "lab")), None
        if isinstance(pairs, tuple):
            pairs, dealt = pairs
        pairs = C.store(spark, pairs, "pairs")
        links = [] if pairs.isEmpty() else [_confirm(spark, docs, recs, pairs, *check)]
        if dealt is not None:
            links.append(_confirm_dense(spark, docs, recs, dealt, *check))
        if not links:
            continue
        found = _union(links)
        for end in ("u", "v"):  # links between labels
            found = (found.join(labels, F.col(end) == F.col("cid"), "left")
                     .withColumn(end, F.coalesce("lab", end)).select("u", "v"))
        merged = C.connected_components(spark, found)
        labels = C.store(spark, labels.join(merged, F.col("lab") == F.col("node"), "left")
                         .select("cid", F.coalesce("root", "lab").alias("lab"))
                         .union(merged.where("node <> root").select("node", "root")), "labels")
    named = recs.select("rid", "cid", "least").join(labels, "cid", "left").select(
        "rid", "least", F.coalesce("lab", "cid").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = C.store(spark, named.join(least, "root").select("rid", "component_id"), "components")
    return (sigs.select("id", "n", "rid").join(named, "rid", "left")
            .select("id", F.col("n").alias("n_shingles"), F.col("rid").alias("class"),
                    F.when(F.col("rid").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")))


def keep_one_per_group(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = 5) -> DataFrame:
    """``docs`` without the near duplicates of a document that stays (the
    least id of each group); repeated rows of one document become one row.
    Rows with a null id stay unless equal rows repeat."""
    found = C.store(spark, near_duplicates(spark, docs, id_col, text_col, shingle), "groups")
    gone = found.where(F.col("id") != F.col("component_id")).select(F.col("id").alias("_gone")).distinct()
    kept = docs.join(gone, docs[id_col] == F.col("_gone"), "left_anti")
    repeated = found.groupBy("id").count().where("count > 1").select(F.col("id").alias("_again"))
    if repeated.isEmpty():
        return kept
    again = docs[id_col].eqNullSafe(F.col("_again"))
    return kept.join(repeated, again, "left_anti").union(
        kept.join(repeated, again, "left_semi").dropDuplicates([id_col, text_col]))

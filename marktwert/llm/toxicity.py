"""Toxicity: a linear-chain conditional random field over words.

Words of a sentence form a chain of two states (0 fine, 1 toxic).  Emission
weights belong to hashed features of a word (the word, its first four to six
bytes, its last four, its neighbours); two-state transitions join neighbours.
Forward-backward passes give each word's marginal; a document's score comes
from its largest marginal and its expected number of toxic words through a
logistic curve; words over ``SPAN_AT`` give the offending offsets.

Labels exist per document.  Training draws a bounded, hash-chosen sample
(``max_toxic`` and ``max_clean`` documents, texts whole) and labels the words:
a word is toxic in a toxic document if the word or a prefix of it occurs in
enough toxic documents of the sample and (nearly) never in clean ones.  The
field is fitted to these labelled words on the driver, whose memory the two
bounds limit; scoring is one pass without a shuffle.

Chains are scored side by side, longest first.  A chain ends with its sentence
or line, or after ``CHAIN`` words; every word of a text is scored.

Defined results: null and empty texts, and texts without words, get the score
of a document without toxic words and no spans; without a labelled row of both
classes every score is 0; repeated rows get equal results; null labels do not
train; other columns pass through (columns named like a result are replaced);
an empty table gives an empty result.
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

BINS = 1 << 18
CHAIN = 200
MAX_TOXIC = 1000
MAX_CLEAN = 1500
SPAN_AT = 0.5
_SALT = np.arange(1, 12, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


class Chains:
    """Words of several texts with features and chain limits."""

    def __init__(self, texts: list[bytes]):
        self.words = w = C.Words(texts, C.ALNUM_WORDS)
        raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        n = len(w.start)
        h = w.hashes()
        lengths = w.end - w.start
        keys = [h]
        part = np.zeros(n, np.uint64)
        for k in range(6):  # first bytes
            byte = np.where(k < lengths, w.buf[np.minimum(w.start + k, len(w.buf) - 1)], 0)
            part = C.mix(part + byte.astype(np.uint64) + _SALT[k])
            if k >= 3:
                keys.append(part)
        part = np.zeros(n, np.uint64)
        for k in range(4):  # last bytes
            byte = np.where(k < lengths, w.buf[np.maximum(w.end - 1 - k, 0)], 0)
            part = C.mix(part + byte.astype(np.uint64) + _SALT[k])
        keys.append(part)
        text_of = np.repeat(np.arange(len(texts)), np.diff(w.first))
        sentence = np.cumsum(_ENDS[raw])[w.start] if n else np.zeros(0, np.int64)
        new = np.ones(n, bool)
        if n:
            new[1:] = (sentence[1:] != sentence[:-1]) | (text_of[1:] != text_of[:-1])
        before, after = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        if n:
            before[1:] = np.where(new[1:], np.uint64(0), h[:-1])
            after[:-1] = np.where(new[1:], np.uint64(0), h[1:])
        keys += [before, after]
        # long sentences go on in a further chain
        at = np.flatnonzero(new)
        place = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
        new |= place % CHAIN == 0
        self.text_of = text_of
        self.keys = [C.mix(k ^ _SALT[i]) for i, k in enumerate(keys)]
        self.features = np.stack([(k & np.uint64(BINS - 1)).astype(np.int32) for k in self.keys], 1) if n else (
            np.zeros((0, 7), np.int32))
        self.at = np.flatnonzero(new)
        self.size = np.diff(np.append(self.at, n))


def forward_backward(score: np.ndarray, trans: np.ndarray, at: np.ndarray, size: np.ndarray):
    """Marginals of state 1 and the summed marginals of state pairs.

    ``score``: emission of state 1 against state 0 per word; ``trans``: 2x2
    scores; chains start at ``at`` with ``size`` words.
    """
    n = len(score)
    order = np.argsort(-size, kind="stable")
    at, size = at[order], size[order]
    emit = np.exp(np.clip(score, -30, 30))
    t = np.exp(np.clip(trans, -30, 30))
    alpha, beta = np.empty((n, 2)), np.empty((n, 2))
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # chains longer than k
    a0, a1 = np.ones(len(at)), np.ones(len(at))
    for k in range(longest):
        m = active[k]
        i = at[:m] + k
        if k:
            b0, b1 = a0[:m], a1[:m]
            a0, a1 = b0 * t[0, 0] + b1 * t[1, 0], (b0 * t[0, 1] + b1 * t[1, 1])
        else:
            a0, a1 = a0[:m], a1[:m]
        a1 = a1 * emit[i]
        total = a0 + a1
        a0, a1 = a0 / total, a1 / total
        alpha[i, 0], alpha[i, 1] = a0, a1
    b0, b1 = np.ones(len(at)), np.ones(len(at))
    for k in range(longest - 1, -1, -1):
        m = active[k]
        i = at[:m] + k
        more = active[k + 1] if k + 1 < longest else 0
        c0, c1 = np.ones(m), np.ones(m)
        if more:
            x0, x1 = b0[:more], b1[:more] * emit[i[:more] + 1]
            c0[:more] = t[0, 0] * x0 + t[0, 1] * x1
            c1[:more] = t[1, 0] * x0 + t[1, 1] * x1
            total = c0 + c1
            c0, c1 = c0 / total, c1 / total
        b0, b1 = c0, c1
        beta[i, 0], beta[i, 1] = c0, c1
    joint = alpha * beta
    marginal = joint[:, 1] / joint.sum(1) if n else np.zeros(0)
    follows = np.ones(n, bool)
    follows[at] = False
    j = np.flatnonzero(follows)
    pair = alpha[j - 1][:, :, None] * t[None] * (beta[j] * np.stack([np.ones(len(j)), emit[j]], 1))[:, None, :]
    pair = pair / pair.sum((1, 2), keepdims=True) if len(j) else pair
    return marginal, pair.sum(0) if len(j) else np.zeros((2, 2))


class Field:
    """Weights of the field and of the document curve."""

    def __init__(self, weights, bias, trans, curve):
        self.weights, self.bias, self.trans, self.curve = weights, bias, trans, curve

    def marginals(self, chains: Chains) -> np.ndarray:
        score = self.weights[chains.features].sum(1, dtype=np.float64) + self.bias
        return forward_backward(score, self.trans, chains.at, chains.size)[0]


def document_features(marginal: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: logit of the largest marginal, log of the expected number of
    toxic words."""
    n = len(first) - 1
    most, expected = np.zeros(n), np.zeros(n)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        most[full] = np.maximum.reduceat(marginal, first[full])
        expected[full] = np.add.reduceat(np.where(marginal > 0.05, marginal, 0.0), first[full])
    most = np.clip(most, 1e-4, 1 - 1e-4)
    return np.stack([np.log(most / (1 - most)), np.log1p(expected), np.ones(n)], 1)


def word_labels(blocks: list[tuple[np.ndarray, Chains]], toxic: np.ndarray, least: int = 4,
                odds: float = 20.0) -> list[np.ndarray]:
    """Label of each word of the sample from the document labels: 1 in a toxic
    text if the word, or a prefix of four to six bytes, lies in at least
    ``least`` toxic texts and ``odds`` times rarer in clean ones."""
    n_toxic, n_clean = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    labels = [np.zeros(len(c.text_of), bool) for _, c in blocks]
    for f in range(4):
        pairs = [np.unique(np.stack([c.keys[f], part[c.text_of].astype(np.uint64)], 1), axis=0) for part, c in blocks]
        pair = np.concatenate(pairs)
        value, at = np.unique(pair[:, 0], return_inverse=True)
        where = toxic[pair[:, 1].astype(np.int64)]
        yes, no = np.bincount(at[where], minlength=len(value)), np.bincount(at[~where], minlength=len(value))
        strong = (yes >= least) & (yes / n_toxic > odds * (no + 0.25) / n_clean)
        for label, (part, c) in zip(labels, blocks):
            if len(label):
                label |= strong[np.searchsorted(value, c.keys[f])] & toxic[part][c.text_of]
    return labels


def fit(texts: list[bytes], toxic: np.ndarray, epochs: int = 6, rate: float = 0.3, decay: float = 1e-6) -> Field:
    """Fit the field by Adagrad over blocks of texts, then the curve."""
    weights, trans, bias = np.zeros(BINS + 1), np.zeros((2, 2)), -3.0
    sum_w, sum_t, sum_b = np.full(BINS + 1, 1e-6), np.full((2, 2), 1e-6), 1e-6
    order = np.random.default_rng(5).permutation(len(texts))
    parts = [(p, Chains([texts[i] for i in p])) for p in np.array_split(order, max(1, len(texts) // 60))]
    labels = word_labels(parts, toxic)
    blocks = [(part, chains, label.astype(np.float64)) for (part, chains), label in zip(parts, labels)]
    for _, chains in parts:
        del chains.keys
    rng = np.random.default_rng(6)
    for _ in range(epochs):
        for part, chains, y in blocks:
            n = len(y)
            if not n:
                continue
            features = chains.features.copy()
            # half of the words without their identity: unseen forms must be told by their parts
            features[rng.random(n) < 0.5, 0] = BINS
            weights[BINS] = 0.0
            score = weights[features].sum(1) + bias
            p, pairs = forward_backward(score, trans, chains.at, chains.size)
            follows = np.ones(n, bool)
            follows[chains.at] = False
            j = np.flatnonzero(follows)
            seen = np.bincount((2 * y[j - 1] + y[j]).astype(np.int64), minlength=4).reshape(2, 2)
            rest = y - p
            hot = np.flatnonzero(np.abs(rest) > 1e-4)
            g = np.bincount(features[hot].ravel(), np.repeat(rest[hot], features.shape[1]), BINS + 1)
            g -= decay * n * weights
            sum_w += g * g
            weights += rate * g / np.sqrt(sum_w)
            g_t = seen - pairs
            sum_t += g_t * g_t
            trans += rate * g_t / np.sqrt(sum_t)
            g_b = float(rest.sum())
            sum_b += g_b * g_b
            bias += rate * g_b / np.sqrt(sum_b)
    field = Field(weights[:BINS].astype(np.float32), bias, trans, np.zeros(3))
    x, z = [], []
    for part, chains, _ in blocks:
        x.append(document_features(field.marginals(chains), chains.words.first))
        z.append(toxic[part])
    field.curve = _logistic(np.concatenate(x), np.concatenate(z).astype(np.float64))
    return field


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC,
          max_clean: int = MAX_CLEAN) -> Field | None:
    """Fit on at most ``max_toxic`` and ``max_clean`` documents, those with the
    least hash of the id.  ``labels`` holds id and label (default: ``docs``
    does).  The sample is chosen by ids alone; only its texts are fetched.
    None if a class is missing."""
    known = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    rated = known if labels is None else known.select(id_col).join(labels.select(id_col, label_col), id_col)
    ids = rated.select(F.col(id_col).alias("id"), F.col(label_col).alias("y"),
                       F.xxhash64(F.lit("toxicity"), F.col(id_col)).alias("h")).where("y in (0, 1)").distinct()
    picked = {r["id"]: r["y"] == 1 for y, most in ((0, max_clean), (1, max_toxic))
              for r in ids.where(F.col("y") == y).orderBy("h", "id").limit(most).collect()}
    if len(set(picked.values())) < 2:
        return None
    chosen = spark.createDataFrame([(i,) for i in picked], ids.select("id").schema)  # bounded by the two limits
    texts = (known.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
             .groupBy("id").agg(F.min("text").alias("text")).orderBy("id").collect())
    return fit([r["text"].encode("utf-8", "surrogatepass") for r in texts],
               np.array([picked[r["id"]] for r in texts], bool))


def _score(batches, field, text_col: str) -> Iterator[pa.RecordBatch]:
    field = field.value
    for batch in C.pieces(batches):
        texts = C.as_bytes(batch.column(text_col))
        score, spans = [], []
        for lo, hi in C.slices(texts):
            if field is None:
                score.append(np.zeros(hi - lo))
                spans += [[] for _ in range(lo, hi)]
                continue
            chains = Chains(texts[lo:hi])
            marginal, w = field.marginals(chains), chains.words
            x = document_features(marginal, w.first) @ field.curve
            score.append(1 / (1 + np.exp(-np.clip(x, -30, 30))))
            found: list[list[dict]] = [[] for _ in range(lo, hi)]
            bad = np.flatnonzero(marginal > SPAN_AT)
            if len(bad):
                raw = np.frombuffer(b"\n" + b"\n".join(texts[lo:hi]) + b"\n", np.uint8)
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before a byte
                base = points[w.text_at[chains.text_of[bad]]]
                for d, a, b, p in zip(chains.text_of[bad].tolist(), (points[w.start[bad]] - base).tolist(),
                                      (points[w.end[bad]] - base).tolist(), marginal[bad].tolist()):
                    found[d].append({"start": a, "end": b, "p": p})
            spans += found
        columns = {name: batch.column(name) for name in batch.schema.names}
        columns["score"] = pa.array(np.concatenate(score) if score else np.zeros(0), pa.float64())
        columns["spans"] = pa.array(spans, pa.list_(pa.struct(
            [("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])))
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def tag(spark: SparkSession, docs: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``spans`` (start, end in code points, p)."""
    docs = docs.drop("score", "spans")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                         T.StructField("p", T.DoubleType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()),
                           T.StructField("spans", T.ArrayType(span))])
    return docs.mapInArrow(partial(_score, field=spark.sparkContext.broadcast(field), text_col=text_col), schema)

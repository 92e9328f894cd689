"""Language ID by multilingual mixture inference.

Training counts hashed character trigrams per language (a bounded, hash-chosen
sample of the labelled rows, ``max_training`` documents; every text whole).  A
text is then a mixture: expectation-maximisation over its trigram counts
estimates the share of each language.  The language set is chosen by penalised
likelihood: starting from the most likely single language, the language with
the next largest share joins while the log-likelihood gains more than the
penalty times log(trigrams).  The prediction is the largest share of the set,
the score that share.

The model is ``languages x BINS`` numbers; more than ``max_languages`` labels
raise.  Texts are independent, so inference is one pass without a shuffle.

Defined results: null text or text without a letter gives ``und``, score 0 and
no languages; so does every text if no labelled row exists; rows with a null
label or null text do not train; ties go to the first language by code point;
repeated rows get equal results; other columns pass through (columns named like
a result are replaced); an empty table gives an empty result.
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

BINS = 1 << 14
MAX_TRAINING = 200_000
MAX_LANGUAGES = 400
SMOOTHING = 0.05
ROUNDS = 12
PENALTY = 3.0
UNKNOWN = "und"

#: ASCII characters that are no letters read as a blank.
_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


def trigram_bins(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each trigram (-1: blanks only) and where each text's start.
    A text stands between blanks, so no trigram crosses into the next."""
    codes = np.frombuffer(("  " + "  ".join([t.lower() for t in texts]) + "  ").encode("utf-32-le", "surrogatepass"),
                          np.uint32)
    low = codes < 128
    codes = np.where(low, _FOLD[np.where(low, codes, 0)], codes).astype(np.uint64)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    value = C.mix((a << np.uint64(42)) | (b << np.uint64(21)) | c)
    bins = (value & np.uint64(BINS - 1)).astype(np.int32)
    bins[(b == 32) & ((a == 32) | (c == 32))] = -1
    lengths = np.fromiter((len(t.lower()) for t in texts), np.int64, len(texts))
    return bins, np.concatenate([[0], np.cumsum(lengths + 2)])


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def _pieces(texts: list[str]):
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > C.SLICE_BYTES:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def _count(batches, max_languages: int) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in C.pieces(batches):
        texts, langs = _texts(batch.column("text")), batch.column("lang").to_pylist()
        for lo, hi in _pieces(texts):
            bins, at = trigram_bins(texts[lo:hi])
            names, which = np.unique(np.array(langs[lo:hi], object), return_inverse=True)
            code = np.repeat(which.astype(np.int64), np.diff(at))[:len(bins)] * BINS + bins
            found = np.bincount(code[bins >= 0], minlength=len(names) * BINS).reshape(len(names), BINS)
            for k, name in enumerate(names.tolist()):
                if name not in counts and len(counts) >= max_languages:
                    raise ValueError(f"more than {max_languages} languages")
                counts[name] = counts.get(name, 0) + found[k]
    for name, row in counts.items():
        full = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(full), pa.string()), pa.array(full.astype(np.int32)),
             pa.array(row[full].astype(np.int64))], ["lang", "bin", "n"])


class Model:
    """Trigram probabilities, a row per bin, a column per language."""

    def __init__(self, languages: list[str], counts: np.ndarray, smoothing: float = SMOOTHING):
        self.languages = languages
        p = counts.T.astype(np.float64) + smoothing
        self.p = p / p.sum(axis=0) if languages else p
        self.log_p = np.log(self.p) if languages else p


def train(spark: SparkSession, labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
          id_col: str = "doc_id", max_training: int = MAX_TRAINING, max_languages: int = MAX_LANGUAGES) -> Model:
    """Fit on at most about ``max_training`` labelled rows, chosen by a hash of
    the id (all of them if there are fewer)."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    n = rows.count()
    if n > max_training:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("train"), F.col(id_col)), F.lit(1_000_000))
                          < int(1_000_000 * max_training / n))
    counts = (rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
              .mapInArrow(partial(_count, max_languages=max_languages), "lang string, bin int, n long")
              .groupBy("lang", "bin").agg(F.sum("n").alias("n")))
    found = C.store(spark, counts, "trigrams")
    languages = sorted(r[0] for r in found.select("lang").distinct().limit(max_languages + 1).collect())
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    table = np.zeros((len(languages), BINS))
    place = {name: i for i, name in enumerate(languages)}
    for r in found.toLocalIterator():  # languages x BINS rows at most
        table[place[r["lang"]], r["bin"]] = r["n"]
    return Model(languages, table)


def _mixture(p: np.ndarray, counts: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Shares of the columns of ``p`` and the log-likelihood they reach."""
    share = np.full(p.shape[1], 1.0 / p.shape[1])
    total = counts.sum()
    for _ in range(rounds):
        share = share * ((counts / (p @ share)) @ p) / total
    return share, float(counts @ np.log(p @ share))


def infer(model: Model, bins: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> list[tuple[str, float]]:
    """Languages of a text with their shares, largest first."""
    tally = np.bincount(bins, minlength=BINS)
    full = np.flatnonzero(tally)
    counts, p = tally[full].astype(np.float64), model.p[full]
    single = counts @ model.log_p[full]
    best = int(np.argmax(single))
    chosen, share, reached = [best], np.ones(1), float(single[best])
    price = penalty * np.log(counts.sum() + 1)
    every, _ = _mixture(p, counts, rounds)
    for k in np.argsort(-every, kind="stable").tolist():
        if k in chosen:
            continue
        tried, value = _mixture(p[:, [*chosen, k]], counts, rounds)
        if value - reached <= price:
            break
        chosen, share, reached = [*chosen, k], tried, value
    order = sorted(range(len(chosen)), key=lambda i: (-share[i], chosen[i]))
    return [(model.languages[chosen[i]], float(share[i])) for i in order]


def _predict(batches, model, text_col: str) -> Iterator[pa.RecordBatch]:
    model = model.value
    for batch in C.pieces(batches):
        texts = _texts(batch.column(text_col))
        out: list[list[tuple[str, float]]] = []
        for lo, hi in _pieces(texts):
            bins, at = trigram_bins(texts[lo:hi])
            for i in range(lo, hi):
                own = bins[at[i - lo]:at[i - lo + 1]]
                own = own[own >= 0]
                known = model.languages and len(own) and any(map(str.isalpha, texts[i]))
                out.append(infer(model, own) if known else [])
        columns = {name: batch.column(name) for name in batch.schema.names}
        columns["lang_pred"] = pa.array([x[0][0] if x else UNKNOWN for x in out], pa.string())
        columns["score"] = pa.array([min(max(x[0][1], 0.0), 1.0) if x else 0.0 for x in out], pa.float64())
        columns["languages"] = pa.array([",".join(f"{n}:{s:.3f}" for n, s in x) for x in out], pa.string())
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def identify(spark: SparkSession, docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``languages`` (name:share)."""
    docs = docs.drop("lang_pred", "score", "languages")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("languages", T.StringType())])
    return docs.mapInArrow(partial(_predict, model=spark.sparkContext.broadcast(model), text_col=text_col), schema)


def keep_identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents whose languages can be told, one or several; all documents if
    no row is labelled.  Columns unchanged."""
    model = train(spark, docs)
    if not model.languages:
        return docs
    found = identify(spark, docs.select(*[F.col(c).alias(f"_in_{c}") for c in docs.columns]), model, "_in_text")
    return found.where(F.col("lang_pred") != UNKNOWN).select(*[F.col(f"_in_{c}").alias(c) for c in docs.columns])

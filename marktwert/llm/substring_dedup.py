"""Substring dedup by hashing lines, paragraphs, sentence chains and chunks.

Units are normalised pieces of text (lower-cased, white space as one blank):

* each line, however short, and each paragraph between blank lines;
* inside a paragraph, from each line or sentence start, the *chain* of sentences
  to the first end after ``min_words`` words, also across line ends (then at
  most ``MAX_CHAIN`` words);
* over the whole text the *chunks* from a content-defined cut to the first cut
  after ``min_words`` words.  A hash of two words makes the cut, so a passage
  that is wrapped otherwise or has no whole sentence is found as well, but for
  some words at its edges.  Runs of one word are cut at equal steps.

Units overlap; a passage set into the middle of another text is found.  Scripts
without blanks count a word a code point.  Digests are grouped over all
documents; the earliest occurrence by (id, offset) stays and every other one is
removed.  Offsets of the removed spans in the original text (code points) are
kept with the result.

One digest may stand for a third of all units: the earliest occurrence is a
partial minimum, and the join back is on the digest with the skew split of
adaptive execution; no occurrence list is ever gathered.  A bitmap of fixed size
over the repeated digests keeps most other units out of that join (saturated, it
just passes more).  Removal lists are per document.

Defined results: null text stays null with no units; empty text and lines of
blanks and sentence ends alone stay as they are; a document without anything left keeps
its row with an empty text; rows that repeat both id and text are one document
and share its result; null ids rank last; equal ids with different texts rank
by a hash of the text; other columns pass through; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marktwert.llm import common as C

MIN_WORDS = 10
#: A sentence chain across line ends is at most this long; a cut is chosen at one of ``CUT_EVERY`` words.
MAX_CHAIN = 60
CUT_EVERY = 8
#: Bits of the filter of repeated digests.
FILTER_BITS = 1 << 26
_PARAGRAPH = re.compile(r"[^\n]+(?:\n[^\n]*[^\x20\x09-\x0D\n][^\n]*)*")
_LINE = re.compile(r"[^\n]+")
#: Marks that end a sentence without a blank after them (CJK, Indic, Arabic, ellipsis).
_WIDE = "\u3002\uff01\uff1f\uff0e\uff61\u0964\u0965\u061f\u06d4\u2026"
_SENTENCE = re.compile(r"[^\x20\x09-\x0D][^.!?%s]*(?:[.!?]+(?![\x20\x09-\x0D])[^.!?%s]*)*[.!?%s]*" % (_WIDE, _WIDE, _WIDE))
_ENDS = " .!?" + _WIDE
#: Thai to Khmer, kana, CJK: written without blanks between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
                       "\U00020000-\U0003ffff]")
_WHITE = " \t\x0b\x0c\r\n"
#: White space of ``str.split`` beside the class ``[\x20\x09-\x0D]``.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_RADIX = np.uint64(0x9E3779B97F4A7C15)
_BLANK = " \t\x0b\x0c\r"


def units(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised text) of every unit, by place."""
    found: dict[tuple[int, int], str] = {}
    plain = _OTHER_SPACE.search(text) is None
    unspaced = not text.isascii() and _UNSPACED.search(text) is not None
    for paragraph in _PARAGRAPH.finditer(text):
        starts, ends, parts, counts, last_of_line = [], [], [], [], []
        for line in _LINE.finditer(text, *paragraph.span()):
            first = len(parts)
            for m in _SENTENCE.finditer(text, *line.span()):
                start, end = m.span()
                # ``split`` without arguments is ``normal`` where the text has no other white space
                part = " ".join(text[start:end].lower().split()) if plain else normal(text[start:end])
                starts.append(start)
                ends.append(end)
                parts.append(part)
                counts.append(n_words(part) if unspaced else part.count(" ") + 1)
            last = len(parts) - 1
            if last < first:
                continue
            last_of_line += [last] * (last + 1 - first)
            _add(found, starts, ends, parts, first, last)
        if not parts:
            continue
        n = len(parts)
        if last_of_line[0] < n - 1:
            _add(found, starts, ends, parts, 0, n - 1)
        j, words = 0, 0
        for i in range(n):
            while j < n and words < min_words:
                words += counts[j]
                j += 1
            if words < min_words:
                break
            end = j - 1
            inside = end <= last_of_line[i]
            if inside:
                _add(found, starts, ends, parts, i, end)
            longer, more = words, end
            while more + 1 < n and parts[more][-1] not in _ENDS and longer <= MAX_CHAIN:
                more += 1
                longer += counts[more]
            if longer <= MAX_CHAIN and not (inside and more == end):
                _add(found, starts, ends, parts, i, more)
            words -= counts[i]
    for a, b, unit in _chunks(text, min_words):
        found.setdefault((a, b), unit)
    for (a, b), unit in sorted(found.items(), key=_start):
        yield a, b, unit


def _start(item: tuple[tuple[int, int], str]) -> int:
    return item[0][0]


def _add(found: dict[tuple[int, int], str], starts: list[int], ends: list[int], parts: list[str], i: int, j: int) -> None:
    place = starts[i], ends[j]
    if place not in found:
        unit = " ".join(parts[i:j + 1]) if j > i else parts[i]
        if unit.strip(_ENDS):
            found[place] = unit


def _chunks(text: str, min_words: int) -> Iterator[tuple[int, int, str]]:
    """Units from a content-defined cut to the first cut after ``min_words``
    words.  A cut stands before two words whose hash is 0 modulo
    ``CUT_EVERY``, so it does not depend on lines or sentences."""
    if text.count(" ") < min_words and text.isascii() and len(text.split()) <= min_words:
        return
    low = text.lower()
    if len(low) != len(text):  # some letter becomes two
        low = "".join([x if len(x) == 1 else c for c in text for x in (c.lower(),)])
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = (codes != 32) & ((codes < 9) | (codes > 13))
    split = np.zeros(len(codes) + 1, bool)  # a border of a word before the code point
    split[0] = split[-1] = True
    split[1:-1] = word[1:] != word[:-1]
    if not text.isascii():
        alone = np.zeros(len(codes), bool)
        alone[[m.start() for m in _UNSPACED.finditer(text)]] = True
        split[:-1] |= alone
        split[1:] |= alone
    at = np.flatnonzero(split)
    is_word = word[at[:-1]]
    start, end = at[:-1][is_word], at[1:][is_word]
    if len(start) <= min_words:
        return
    offset = np.arange(len(codes)) - np.repeat(at[:-1], np.diff(at))
    powers = np.multiply.accumulate(np.concatenate(
        [np.ones(1, np.uint64), np.full(int(offset.max()), _RADIX)]))
    hashes = C.mix(np.add.reduceat((codes.astype(np.uint64) + np.uint64(1)) * powers[offset], at[:-1])[is_word])
    pairs = C.mix(hashes[:-1] * _RADIX + hashes[1:]) % np.uint64(CUT_EVERY)
    same = hashes[:-1] == hashes[1:]
    after = np.concatenate([[False], same[:-1]])
    step = max(min_words, 2 * CUT_EVERY)
    if same.any():  # in a run of one word every ``step`` words, and behind the run
        i = np.arange(len(same))
        nth = i - np.maximum.accumulate(np.where(same & ~after, i, 0))
        pairs = np.where(same, nth % step, np.where(after, 1, pairs))
        behind = np.flatnonzero(after & ~same) + 1
    else:
        behind = []
    border = np.zeros(len(start) + 1, bool)
    border[:-2] = pairs == 0
    border[behind] = True
    border[[0, len(start)]] = True
    cuts = np.flatnonzero(border)
    to = np.searchsorted(cuts, cuts + min_words)
    some = to < len(cuts)
    first, last = start[cuts[some]], end[cuts[to[some]] - 1]
    kept = word.copy()  # one blank between words
    kept[1:] |= word[:-1]
    folded = np.where(word, codes, 32)[kept].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    place = np.concatenate([[0], np.cumsum(kept)])
    for a, b, x, y in zip(first.tolist(), last.tolist(), place[first].tolist(), place[last].tolist()):
        yield a, b, folded[x:y]


def n_words(text: str) -> int:
    """Words of a normalised text."""
    n = text.count(" ") + 1
    return n if text.isascii() else max(n, len(_UNSPACED.findall(text)))


def normal(text: str) -> str:
    return " ".join(re.split(r"[\x20\x09-\x0D]+", text.strip(_WHITE).lower()))


def _units(batches, min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in C.pieces(batches):
        ids, keys, texts = batch.column("id"), batch.column("h"), batch.column("text").to_pylist()
        at, start, end, digest = [], [], [], []

        def flush():
            rows = pa.array(at, pa.int64())
            return pa.RecordBatch.from_arrays(
                [ids.take(rows), keys.take(rows), pa.array(start, pa.int32()), pa.array(end, pa.int32()),
                 pa.array(digest, pa.binary())], ["id", "h", "start", "end", "digest"])

        for i, text in enumerate(texts):
            found = list(units(text or "", min_words))
            at += [i] * len(found)
            start += [a for a, _, _ in found]
            end += [b for _, b, _ in found]
            digest += [blake2b(unit.encode("utf-8", "surrogatepass"), digest_size=16).digest() for _, _, unit in found]
            if len(at) > 100_000:
                yield flush()
                at, start, end, digest = [], [], [], []
        yield flush()


def cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """``text`` without the union of ``spans``, and that union.  A line of
    which only white space would be left goes with its line end."""
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and (a <= merged[-1][1] or not text[merged[-1][1]:a].strip(_BLANK)):
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    out, at = [], 0
    for k, (a, b) in enumerate(merged):
        left, right = a, b
        while left and text[left - 1] in _BLANK:
            left -= 1
        while right < len(text) and text[right] in _BLANK:
            right += 1
        if (left == 0 or text[left - 1] == "\n") and (right == len(text) or text[right] == "\n"):
            a, b = left, min(right + 1, len(text))
            if b == right and a and a > at:
                a -= 1
            merged[k] = (a, b)
        out.append(text[at:a])
        at = max(at, b)
    out.append(text[at:])
    return "".join(out), merged


def _rebuild(batches, text_col: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in C.pieces(batches):
        texts, spans, n_units = [], [], []
        for text, found in zip(batch.column(text_col).to_pylist(), batch.column("_spans").to_pylist()):
            if text is None or not found:
                texts.append(text)
                spans.append([])
                continue
            clean, merged = cut(text, [(f["start"], f["end"]) for f in found])
            texts.append(clean)
            spans.append([{"start": a, "end": b} for a, b in merged])
        columns = {n: batch.column(n) for n in names}
        columns[text_col] = pa.array(texts, columns[text_col].type)
        columns["removed"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _maybe(found: DataFrame, first: DataFrame) -> DataFrame:
    """The units whose digest is in ``first``, and some others: a filter by at
    most ``FILTER_BITS / 64`` words, which is the most that is broadcast."""
    place = F.pmod(F.xxhash64("digest"), F.lit(FILTER_BITS))
    bit = F.expr("shiftleft(1L, cast(_place % 64 as int))")
    words = (first.select(place.alias("_place")).groupBy(F.expr("_place div 64").alias("_word"))
             .agg(F.bit_or(bit).alias("_bits")))
    return (found.withColumn("_place", place).join(F.broadcast(words), F.expr("_place div 64") == F.col("_word"))
            .where(F.col("_bits").bitwiseAND(bit) != 0).select(*found.columns))


def repeated_units(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_words: int = MIN_WORDS) -> DataFrame:
    """``id``, ``h`` and the ``spans`` to remove, a row per document that
    repeats a unit of an earlier place."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    # stored, so that the texts are cut into units once
    found = C.store(spark, rows.mapInArrow(partial(_units, min_words=min_words),
                                           f"id {id_type}, h long, start int, end int, digest binary"), "units", compression="zstd")
    # units of one digest and start differ in blanks at the end alone: one occurrence
    place = F.struct(F.col("id").isNull().alias("last"), "id", "h", "start")
    # stored, so that the join below reads two shuffles, of which a hot digest's partition can be split
    first = C.store(spark, found.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("first"))
                    .where("n > 1").select("digest", "first"), "firsts")
    again = _maybe(found, first).join(first, "digest").where(place != F.col("first"))
    return (again.groupBy("id", "h").agg(F.collect_set(F.struct("start", "end")).alias("spans")))


def dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated units cut out of ``text_col`` and a column
    ``removed`` (array of start, end in the original text)."""
    docs = docs.drop("removed")
    again = repeated_units(spark, docs, id_col, text_col, min_words).select(
        F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("spans").alias("_spans"))
    again = C.store(spark, again, "removals")
    joined = docs.join(again, F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_h")), "left")
    names = docs.columns
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("removed", span)])
    return joined.select(*names, "_spans").mapInArrow(partial(_rebuild, text_col=text_col, names=names), schema)


def without_repeats(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The cleaned documents, columns unchanged (``n_chars`` counts the text
    that is left, where that column exists)."""
    out = dedup(spark, docs, min_words=min_words).select(*docs.columns)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out

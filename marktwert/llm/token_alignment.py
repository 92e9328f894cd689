"""Alignment of two tokenizers over the bytes of a text, by pointer jumping.

A (byte-level BPE) encodes a space and the text, B (pieces with byte fallback)
the text, before which it puts that space itself.  Both token lists tile the
same bytes.  Every token points to the farthest-right token of the other side
that overlaps it (a B token that ends where its A token ends is terminal); the
pointers of all texts of a slice are doubled at once until they stand still.  A
token's terminal then labels its group: the least stretch of bytes at whose ends
tokens of both sides end.

* One map pass encodes and aligns the texts, in slices of bounded bytes.  Texts
  are cut before single spaces between two signs, where neither tokenizer has a
  token across (checked of B's pieces; A's pre-tokenizer never does), and each
  distinct stretch is encoded once while it is among the last ``KNOWN`` ones.
  The pass stores per text the numbers, the digest of its groups and its linked
  id pairs with their counts (sorted, differences only).
* Corpus counts of id pairs are summed per task, then by one grouped sum.
* The pair table (at most the product of the vocabularies, whatever the corpus)
  goes back to the texts in blocks of at most ``BLOCK`` pairs; each block adds
  its part to a text's sums, so driver and tasks hold one block.

Defined results: texts that are null, empty, or whose joined tokens of either
side are not a space and the text have no tokens: zeros and empty groups;
strings of special tokens are plain text; repeated rows and ids (null ones too)
are rows of their own; an empty table gives an empty result; other columns are
left out.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marktwert.llm import common as C

FOLDER = "/opt/tokenizers"
BYTE_BPE = f"{FOLDER}/byte_bpe_50k.json"
PIECE_BPE = f"{FOLDER}/piece_bpe_32k.model"
KNOWN = 500_000
TOGETHER = 20_000
BLOCK = 2_000_000
LINKS_HELD = 2_000_000
_SIGNS = re.compile(r"[!-~\w](?:.*[!-~\w])?\Z", re.DOTALL)
_CUT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def byte_level() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the other bytes follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Pair:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        back = byte_level()
        names = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(back[c] for c in t) if t and all(c in back for c in t) else b"" for t in names]
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace("▁", " ").encode()
                        for i in range(self.b.get_piece_size())]
        self.a_len = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_len = np.array([len(t) for t in self.b_bytes], np.int64)
        self.n_a, self.n_b = len(self.a_bytes), len(self.b_bytes)
        # decimal ids followed by the sign after them: within or at the end of
        # the A tokens of a group, then of its B tokens
        self.names = [b"%d%c" % (i, sign) for n, signs in ((self.n_a, b",|"), (self.n_b, b",;"))
                      for sign in signs for i in range(n)]

        self.parts = not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.n_b))
        self.forget()

    def forget(self) -> None:
        """No stretch is known: ``at`` numbers the known ones, ``ids`` and
        ``first`` hold their ids of both sides, ``fine`` tells whether both
        sides' tokens join to a space and the stretch."""
        self.at: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int64)] * 2
        self.first = [np.zeros(1, np.int64)] * 2
        self.fine = np.zeros(0, bool)

    def learn(self, words: list[str]) -> None:
        """Encode new stretches.  Those that begin and end with a sign are
        encoded in long rows with spaces between, as in a text, and told apart
        by their bytes; if the bytes of a row do not fit, one by one."""
        rows, alone, held = [[]], [w for w in words if not _SIGNS.match(w)], 0
        for word in (w for w in words if _SIGNS.match(w)):
            rows[-1].append(word)
            held += len(word)
            if held > TOGETHER:
                rows.append([])
                held = 0
        alone += self._learn([r for r in rows if r])
        self._learn([[w] for w in alone], last=True)

    def _learn(self, rows: list[list[str]], last: bool = False) -> list[str]:
        """Encode rows of stretches; returns those of rows with other bytes
        (with ``last`` they are learnt as not fine)."""
        texts = [" ".join(r) for r in rows]
        a = [x.ids for x in self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        whole = [b" " + t.encode() for t in texts]
        ok = [joined(self.a_bytes, x) == joined(self.b_bytes, y) == t for x, y, t in zip(a, b, whole)]
        use = [k for k in range(len(rows)) if ok[k] or last]
        words = [w for k in use for w in rows[k]]
        ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(words)))
        for k, (found, size) in enumerate(((a, self.a_len), (b, self.b_len))):
            flat = np.fromiter(chain.from_iterable(found[i] for i in use), np.int64)
            if last:
                stop = np.cumsum(np.fromiter((len(found[i]) for i in use), np.int64, len(use)))
            else:
                stop = np.searchsorted(np.cumsum(size[flat]), ends) + 1
            self.first[k] = np.append(self.first[k], self.first[k][-1] + stop)
            self.ids[k] = np.append(self.ids[k], flat)
        self.fine = np.append(self.fine, [ok[k] for k in use for _ in rows[k]])
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words))))
        return [w for k, row in enumerate(rows) if not (ok[k] or last) for w in row]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A over a space and each text and of B over each text, all in
        a row, and their numbers per text."""
        cut = [_CUT.split(t) if self.parts else [t] for t in texts]
        distinct = set(chain.from_iterable(cut))
        new = list(distinct.difference(self.at))
        if len(self.at) + len(new) > KNOWN:
            self.forget()
            new = list(distinct)
        if new:
            self.learn(new)
        n_words = np.fromiter(map(len, cut), np.int64, len(cut))
        word = np.fromiter(map(self.at.__getitem__, chain.from_iterable(cut)), np.int64, int(n_words.sum()))
        starts = np.cumsum(n_words) - n_words
        doubtful = ~np.logical_and.reduceat(self.fine[word], starts) if texts else np.zeros(0, bool)
        all_ids, all_n = [], []
        for ids, first in zip(self.ids, self.first):
            n = first[word + 1] - first[word]
            before = np.cumsum(n) - n
            all_ids.append(ids[np.repeat(first[word] - before, n) + np.arange(int(n.sum()))])
            all_n.append(np.add.reduceat(n, starts) if texts else n)
        bad = np.fromiter((not t for t in texts), bool, len(texts))
        for k in np.flatnonzero(doubtful & ~bad).tolist():
            lo = [int(n[:k].sum()) for n in all_n]
            sides = [ids[x:x + n[k]].tolist() for ids, n, x in zip(all_ids, all_n, lo)]
            bad[k] = any(joined(names, side) != b" " + texts[k].encode()
                         for names, side in zip((self.a_bytes, self.b_bytes), sides))
        for k in (0, 1):
            all_ids[k] = all_ids[k][np.repeat(~bad, all_n[k])]
            all_n[k] = np.where(bad, 0, all_n[k])
        return all_ids, all_n


def joined(names: list[bytes], ids: list[int]) -> bytes:
    return b"".join(map(names.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def terminals(over_a: np.ndarray, over_b: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group label (the terminal B token) of every A and B token: ``over_a`` and
    ``over_b`` are the other side's token over a token's last byte, ``apart``
    tells that it goes on beyond the B token."""
    n = len(over_a)
    points = np.concatenate([n + over_a, np.where(apart, over_b, n + np.arange(len(over_b)))])
    while True:
        further = points[points]
        if (further == points).all():
            return points[:n] - n, points[n:] - n
        points = further


class Aligned:
    """A slice of texts, encoded and aligned."""

    def __init__(self, tok: Pair, texts: list[str]):
        n = len(texts)
        self.tok = tok
        (self.a, self.b), (self.n_a, self.n_b) = tok.encode(texts)
        a_end, b_end = np.cumsum(tok.a_len[self.a]), np.cumsum(tok.b_len[self.b])
        a_text, b_text = np.repeat(np.arange(n), self.n_a), np.repeat(np.arange(n), self.n_b)
        over_a = np.searchsorted(b_end, a_end)                 # B token over an A token's last byte
        over_b = np.searchsorted(a_end, b_end)
        apart = a_end[over_b] > b_end                          # B tokens that end within an A token
        self.a_group, self.b_group = terminals(over_a, over_b, apart)
        # an overlap ends where its A token ends, or its B token within it
        self.link_text = np.concatenate([a_text, b_text[apart]])
        self.link = np.concatenate([self.a * tok.n_b + self.b[over_a], (self.a[over_b] * tok.n_b + self.b)[apart]])
        last = self.b_group == np.arange(len(self.b))
        self.n_groups = np.bincount(b_text[last], minlength=n)
        self.n_links = np.bincount(self.link_text, minlength=n)

    def groups(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        tok, na, nb = self.tok, len(self.a), len(self.b)
        if not na:
            return [b""] * len(self.n_a)
        # a group's A tokens stand before its B tokens; labels rise with the bytes
        place = np.concatenate([np.arange(na) + np.searchsorted(self.b_group, self.a_group),
                                np.arange(nb) + np.searchsorted(self.a_group, self.b_group, "right")])
        a_last = np.append(self.a_group[1:] != self.a_group[:-1], True)
        b_last = np.append(self.b_group[1:] != self.b_group[:-1], True)
        name = np.empty(na + nb, np.int64)
        name[place] = np.concatenate([self.a + tok.n_a * a_last, 2 * tok.n_a + self.b + tok.n_b * b_last])
        stop = np.cumsum(self.n_a + self.n_b).tolist()
        out = []
        for lo, hi in zip([0, *stop], stop):
            out.append(b"".join(map(tok.names.__getitem__, name[lo:hi].tolist()))[:-1])
        return out

    def pairs(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Distinct linked id pairs of each text (sorted codes) and their counts."""
        order = np.lexsort((self.link, self.link_text))
        text, code = self.link_text[order], self.link[order]
        first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (text[1:] != text[:-1]))) if len(code) else code
        times = np.diff(np.append(first, len(code)))
        cut = np.searchsorted(text[first], np.arange(len(self.n_a) + 1))
        return [(code[first[lo:hi]], times[lo:hi]) for lo, hi in zip(cut[:-1], cut[1:])]


def _pack(x: np.ndarray) -> bytes:
    """64-bit numbers as byte planes (zero planes compress to nothing)."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(column: pa.Array) -> list[np.ndarray]:
    return [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view("<i8").ravel()
            for x in column.cast(pa.binary()).to_pylist()]


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = BYTE_BPE,
            b_path: str = PIECE_BPE, digest: bool = False, pairs: bool = False) -> DataFrame:
    """Per text its numbers of tokens, groups and links and its ``groups``
    (written out, or as SHA-256 with ``digest``); with ``pairs`` also the
    packed ``_codes`` and ``_times`` of its linked id pairs."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    fields = [T.StructField(id_col, rows.schema["_id"].dataType), *[T.StructField(c, T.LongType()) for c in NUMBERS],
              T.StructField("groups", T.StringType())]
    if pairs:
        fields += [T.StructField(c, T.BinaryType()) for c in ("_codes", "_times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = pair(a_path, b_path)
        for batch in C.pieces(batches):
            texts = C.as_bytes(batch.column("_text"))
            for lo, hi in C.slices(texts):
                x = Aligned(tok, [t.decode() for t in texts[lo:hi]])
                groups = x.groups()
                if digest:
                    groups = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
                else:
                    groups = [g.decode() for g in groups]
                out = [batch.column("_id").slice(lo, hi - lo),
                       *[pa.array(c, pa.int64()) for c in (x.n_a, x.n_b, x.n_groups, x.n_links)],
                       pa.array(groups, pa.string())]
                if pairs:
                    found = x.pairs()
                    out += [pa.array([_pack(np.diff(c, prepend=0)) for c, _ in found], pa.binary()),
                            pa.array([_pack(t) for _, t in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, [f.name for f in fields])
    return rows.mapInArrow(run, T.StructType(fields))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the id pairs of a partition, summed before they are shuffled."""
    codes, times, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def merged():
        code, at = np.unique(np.concatenate(codes), return_inverse=True)
        return code, np.bincount(at, np.concatenate(times), len(code)).astype(np.int64)
    for batch in batches:
        for c, t in zip(_unpack(batch.column("_codes")), _unpack(batch.column("_times"))):
            codes.append(np.cumsum(c))
            times.append(t)
            held += len(t)
            if held > LINKS_HELD:
                code, time = merged()
                if len(code) > LINKS_HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(time)], ["code", "n"])
                    code = time = np.zeros(0, np.int64)
                codes, times, held = [code], [time], len(code)
    code, time = merged()
    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(time)], ["code", "n"])


def pair_counts(spark: SparkSession, stored: DataFrame, n_b: int) -> DataFrame:
    """``code`` (A id times B's vocabulary plus B id), ``n`` links in the corpus
    and ``best``: no A id has more links with this B id."""
    counts = C.store(spark, stored.select("_codes", "_times").mapInArrow(_sums, "code long, n long")
                     .groupBy("code").agg(F.sum("n").alias("n")), "pair-counts")
    b = F.pmod("code", F.lit(n_b)).alias("_b")
    most = counts.groupBy(b).agg(F.max("n").alias("_most"))
    return counts.withColumn("_b", b).join(most, "_b").select("code", "n", (F.col("n") == F.col("_most")).alias("best"))


def alignment(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              a_path: str = BYTE_BPE, b_path: str = PIECE_BPE, block: int = BLOCK) -> DataFrame:
    """Per text the numbers of :func:`aligned`, the SHA-256 of its groups as
    ``groups`` and, over the corpus-wide counts of linked id pairs, ``n_best``
    (links with the most frequent partner of their B id) and ``count_sum``."""
    n_b = pair(a_path, b_path).n_b
    encoded = aligned(docs, id_col, text_col, a_path, b_path, digest=True, pairs=True)
    stored = C.store(spark, encoded.withColumn("_row", F.monotonically_increasing_id()), "aligned", compression="zstd")
    counts = C.store(spark, pair_counts(spark, stored, n_b), "pairs")
    size = counts.count()
    blocks = max(1, -(-size // block))
    number = F.pmod(F.xxhash64("code"), F.lit(blocks))
    keys = [id_col, *NUMBERS, "groups", "_row"]
    schema = T.StructType([*[stored.schema[c] for c in keys], T.StructField("n_best", T.LongType()),
                           T.StructField("count_sum", T.LongType())])
    parts = []
    for k in range(blocks):
        table = counts.where(number == k).orderBy("code").toArrow()
        known = spark.sparkContext.broadcast(tuple(
            table.column(c).to_numpy() for c in ("code", "n", "best")))
        parts.append(stored.mapInArrow(functools.partial(_add_block, known, keys), schema))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if blocks > 1:
        out = out.groupBy(*keys).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.drop("_row")


def _add_block(known, keys: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's links that the block knows: how many with a best partner, and
    the sum of their counts."""
    code, n, best = known.value
    for batch in C.pieces(batches):
        n_best, total = [], []
        for c, t in zip(_unpack(batch.column("_codes")), _unpack(batch.column("_times"))):
            c = np.cumsum(c)
            at = np.minimum(np.searchsorted(code, c), max(len(code) - 1, 0))
            here = code[at] == c if len(code) else np.zeros(len(c), bool)
            at, t = at[here], t[here]
            n_best.append(int(t[best[at]].sum()))
            total.append(int((t * n[at]).sum()))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], pa.array(n_best, pa.int64()),
                                          pa.array(total, pa.int64())], [*keys, "n_best", "count_sum"])

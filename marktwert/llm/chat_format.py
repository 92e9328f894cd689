"""Chat formatting by incremental black-box rendering.

A template is any function from a list of ``(role, text)`` turns to a string.
The operator renders successive prefixes of a conversation and compares
consecutive outputs: where the longer output extends the shorter one, the
extension is the span of the new turn.  Rendering once more with a probe
character in place of the text shows where the text lies inside the span.  A
template whose longer output changes the shorter one *rewrites history*; this is
reported, and its spans are found by exchanging one turn at a time in the whole
conversation.

``chatml`` marks turns with control strings and escapes control strings inside
roles and texts reversibly (a backslash after the first character; backslashes
are doubled), so ``parse`` gives back exactly what was rendered.

Conversations stream through sorted partitions, one held at a time: a
conversation is one output row, so it must fit a task; rendering its prefixes
costs the square of its number of turns.

Defined results: null text and null role are empty; turns order by (turn, role,
text), repeated rows are repeated turns; an empty text has an empty span; a
null conversation id is a conversation of its own; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marktwert.llm import common as C

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

START, END = "<|im_start|>", "<|im_end|>"
# ---- fixed values: control strings of common chat templates ----------------
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
TRAINED_ROLE = "assistant"


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescape(text: str) -> str:
    """Inverse of :func:`escape`: ``\\\\`` is a backslash, a lone one goes."""
    parts = text.split("\\\\")
    return "\\".join(p.replace("\\", "") for p in parts)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    parts = role.split("\\\\")
    return "\\".join(p.replace("\\n", "\n").replace("\\", "") for p in parts)


def chatml(turns: list[Turn]) -> str:
    return "".join(f"{START}{escape_role(r)}\n{escape(t)}{END}\n" for r, t in turns)


def parse(output: str) -> list[Turn]:
    """The turns that ``chatml`` rendered."""
    turns = []
    for piece in output.split(START)[1:]:
        role, _, text = piece.partition("\n")
        turns.append((unescape_role(role), unescape(text[:-len(END) - 1])))
    return turns


def probe_for(turns: list[Turn]) -> str:
    """A private-use character that none of the turns holds."""
    used = set("".join(r + t for r, t in turns))
    return next(chr(c) for c in range(0xE000, 0x110000) if chr(c) not in used)


def _between(without: str, after: str, probe: str) -> tuple[int, int]:
    """Where the text of a turn lies in ``after``: ``without`` is the same
    output with the probe character in place of that text."""
    start = without.index(probe)
    return start, len(after) - (len(without) - start - 1)


def locate(render: Template, turns: list[Turn]) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """Output, (turn start, turn end, text start, text end) of each turn, and
    whether the template rewrites history."""
    spans, out, rewrites, probe = [], render([]), False, probe_for(turns)
    for k in range(1, len(turns) + 1):
        longer = render(turns[:k])
        if not longer.startswith(out):
            rewrites = True
            break
        role = turns[k - 1][0]
        probed = render([*turns[:k - 1], (role, probe)])
        spans.append((len(out), len(longer), *_between(probed, longer, probe)))
        out = longer
    if not rewrites:
        return out, spans, False
    out, spans = render(turns), []
    for k, (role, _) in enumerate(turns):
        probed = render([*turns[:k], (role, probe), *turns[k + 1:]])
        gone = render([*turns[:k], *turns[k + 1:]])
        a, b = _between(probed, out, probe) if probe in probed else (0, 0)
        start = min(len(os.path.commonprefix([gone, out])), a)
        tail = len(os.path.commonprefix([gone[::-1], out[::-1]]))
        spans.append((start, max(b, min(len(out) - tail, len(out))), a, b))
    return out, spans, True


def _format(batches, render: Template) -> Iterator[pa.RecordBatch]:
    for table in C.whole_runs(batches, ["conv"]):
        conv, roles, texts = (table.column(c).to_pylist() for c in ("conv", "role", "text"))
        rows, lo = [], 0
        while lo < len(conv):
            hi = lo
            while hi < len(conv) and conv[hi] == conv[lo]:
                hi += 1
            turns = list(zip(roles[lo:hi], texts[lo:hi]))
            out, spans, rewrites = locate(render, turns)
            rows.append((conv[lo], out, [dict(zip(("role", "start", "end", "text_start", "text_end"), (r, *s)))
                                         for (r, _), s in zip(turns, spans)], rewrites))
            lo = hi
        span = pa.struct([("role", pa.string()), *[(n, pa.int64()) for n in ("start", "end", "text_start", "text_end")]])
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], table.schema.field("conv").type), pa.array([r[1] for r in rows], pa.string()),
             pa.array([r[2] for r in rows], pa.list_(span)), pa.array([r[3] for r in rows], pa.bool_())],
            ["conv_id", "formatted", "turns", "rewrites_history"])


def format_conversations(rows: DataFrame, render: Template = chatml) -> DataFrame:
    """A row per conversation: ``conv_id``, ``formatted``, ``turns`` (role,
    span of the turn, span of its text; code points) and ``rewrites_history``."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    empty = F.lit("")
    sorted_rows = (rows.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", empty).alias("role"),
                               F.coalesce("text", empty).alias("text"))
                   .repartition("conv").sortWithinPartitions("conv", "turn", "role", "text"))
    return sorted_rows.drop("turn").mapInArrow(
        partial(_format, render=render),
        f"conv_id {kind}, formatted string, turns array<struct<role:string,start:long,end:long,text_start:long,"
        "text_end:long>>, rewrites_history boolean")


def _read_back(batches, trained: str) -> Iterator[pa.RecordBatch]:
    for batch in C.pieces(batches):
        counts, said, learned = [], [], []
        for out, spans in zip(batch.column("formatted").to_pylist(), batch.column("turns").to_pylist()):
            turns = parse(out)
            counts.append(len(turns))
            said.append("".join(f"{r}\n{t}\n" for r, t in turns))
            learned.append("".join(unescape(out[s["text_start"]:s["text_end"]]) for s in spans if s["role"] == trained))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(counts, pa.int64()), pa.array(said, pa.string()),
             pa.array(learned, pa.string()), batch.column("formatted")],
            ["conv_id", "n_turns", "said", "learned", "formatted"])


def read_back(formatted: DataFrame, trained: str = TRAINED_ROLE) -> DataFrame:
    """Turns and trained text of ``chatml`` output, from the output alone:
    ``n_turns``, ``said`` (role and text lines), ``learned`` (under the mask)."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "turns").mapInArrow(
        partial(_read_back, trained=trained),
        f"conv_id {kind}, n_turns long, said string, learned string, formatted string")

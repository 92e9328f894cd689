"""Conversation structure repair by a bidirectional search of the edit lattice.

A conversation is well formed if the initials of its roles spell
``(s?(ua)+)?``.  Edits of a row: Keep (0), Rerole to user or assistant (2),
Delete (3, required for a blank or duplicate row), and Insert of a user or
assistant row without text (2) anywhere; an undeleted truncated row adds 1.

Nodes of the lattice are (rows read, last role): Keep, Rerole and Delete read a
row, Insert does not.  Dijkstra runs from the first node forward and from the
accepting ends in reverse until the two fronts cost more together than the best
meeting; by then every cheapest repair crosses from a settled forward node to a
settled reverse node.  Among all of them the least audit (the edits' initials)
is read off greedily: the edit letters of a node lead to different nodes, so
the first letters decide.  Costs are integers and no audit is kept per node, so
a search holds a few numbers per row.

Rows are dealt by conversation and sorted by turn (nulls first, then role and
text); a task streams over them and holds one conversation at a time, as its
repaired rows are one result row.

Defined results: a null role or text is one space; an empty role has no initial
and cannot be kept; a null conversation id is one conversation; rows of equal
turn stand in the order of role and text; an empty table gives an empty result;
other columns are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marktwert.llm import common as C

WHITE = C.WHITE.decode()
ENDS = (".", "!", "?")
DELETE, INSERT, KEEP, REROLE = "DIKR"
INSERT_COST, REROLE_COST, DELETE_COST, TRUNCATED_COST = 2, 2, 3, 1
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}

#: Last role seen: none, system, user, assistant; the initials that may follow.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The initial that a new or re-roled row takes.
DUE = ("u", "u", "a", "u")
ACCEPT = (0, 3)
BEFORE = tuple([(s, i) for s in range(4) for i, t in NEXT[s].items() if t == goal] for goal in range(4))


class Lattice:
    """The edit graph of one conversation: ``initials``, ``must_go`` (blank or
    duplicate) and ``cut`` (truncated) per row.  Node ``4 * i + s``: i rows
    read, last role s."""

    def __init__(self, initials: list[str], must_go: list[bool], cut: list[bool]):
        self.initials, self.must_go, self.cut = initials, must_go, cut
        self.n = len(initials)

    def goals(self) -> list[int]:
        return [4 * self.n + s for s in ACCEPT]

    def out(self, node: int) -> Iterator[tuple[str, int, int]]:
        """(edit, cost, next node) in the order of the edits' letters."""
        i, s = divmod(node, 4)
        due = NEXT[s][DUE[s]]
        if i < self.n:
            yield DELETE, DELETE_COST, node + 4
        yield INSERT, INSERT_COST, 4 * i + due
        if i < self.n and not self.must_go[i]:
            extra = TRUNCATED_COST * self.cut[i]
            kept = NEXT[s].get(self.initials[i])
            if kept is not None:
                yield KEEP, extra, 4 * (i + 1) + kept
            yield REROLE, REROLE_COST + extra, 4 * (i + 1) + due

    def into(self, node: int) -> Iterator[tuple[int, int]]:
        """(cost, previous node)."""
        i, t = divmod(node, 4)
        for s, initial in BEFORE[t]:
            if initial == DUE[s]:
                yield INSERT_COST, 4 * i + s
        if not i:
            return
        yield DELETE_COST, node - 4
        if not self.must_go[i - 1]:
            extra = TRUNCATED_COST * self.cut[i - 1]
            for s, initial in BEFORE[t]:
                if initial == self.initials[i - 1]:
                    yield extra, 4 * (i - 1) + s
                if initial == DUE[s]:
                    yield REROLE_COST + extra, 4 * (i - 1) + s


def cheapest(lattice: Lattice) -> tuple[int, str]:
    """Cost and least audit of the cheapest repairs."""
    best, ahead, back = _meet(lattice)
    useful = _leads_on(lattice, best, ahead, back)
    node, audit, goals = 0, [], set(lattice.goals())
    crossed = ahead[0] + back.get(0, best + 1) == best
    while not (crossed and node in goals):
        for edit, cost, to in lattice.out(node):
            if crossed:
                if to in back and back[node] == cost + back[to]:
                    break
            elif to in back and ahead[node] + cost + back[to] == best:
                crossed = True
                break
            elif to in useful and ahead[node] + cost == ahead[to]:
                break
        audit.append(edit)
        node = to
    return best, "".join(audit)


def _meet(lattice: Lattice) -> tuple[int, dict[int, int], dict[int, int]]:
    """Least cost and the settled costs of both directions, when no open pair
    of nodes can meet at that cost or less."""
    inf = DELETE_COST * lattice.n + 1  # deleting all rows is a repair
    settled: tuple[dict, dict] = ({}, {})
    heaps = ([(0, 0)], [(0, g) for g in sorted(lattice.goals())])
    best = inf
    while True:
        tops = [h[0][0] if h else inf for h in heaps]
        if tops[0] + tops[1] > best or tops == [inf, inf]:
            return best, *settled
        side = 0 if tops[0] <= tops[1] else 1
        cost, node = heapq.heappop(heaps[side])
        mine, other = settled[side], settled[1 - side]
        if node in mine:
            continue
        mine[node] = cost
        if node in other:
            best = min(best, cost + other[node])
        steps = ((c, to) for _, c, to in lattice.out(node)) if side == 0 else lattice.into(node)
        for step, to in steps:
            if to in other:
                best = min(best, cost + step + other[to])
            if to not in mine and cost + step < inf:
                heapq.heappush(heaps[side], (cost + step, to))


def _leads_on(lattice: Lattice, best: int, ahead: dict[int, int], back: dict[int, int]) -> set[int]:
    """Settled forward nodes from which a cheapest repair goes on."""
    useful = set()
    for node in sorted(ahead, key=lambda x: (ahead[x], x // 4), reverse=True):
        if ahead[node] + back.get(node, best + 1) == best:
            useful.add(node)
            continue
        for _, cost, to in lattice.out(node):
            if (to in back and ahead[node] + cost + back[to] == best) or (
                    to in useful and ahead[node] + cost == ahead[to]):
                useful.add(node)
                break
    return useful


def apply_audit(audit: str, rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The repaired (role, text) rows."""
    out, at, state = [], 0, 0
    for edit in audit:
        if edit == INSERT:
            row = (ROLE[DUE[state]], "")
        else:
            row = rows[at]
            at += 1
            if edit == DELETE:
                continue
            if edit == REROLE:
                row = (ROLE[DUE[state]], row[1])
        state = NEXT[state][row[0][:1]]
        out.append(row)
    return out


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """``blank``, ``duplicate``, ``truncated`` or nothing: each row's first."""
    seen, out = set(), []
    for row in rows:
        body = row[1].rstrip(WHITE)
        out.append("blank" if not body else "duplicate" if row in seen
                   else "truncated" if not body.endswith(ENDS) else "")
        seen.add(row)
    return out


def _repaired(turns: list[int | None], rows: list[tuple[str, str]]) -> dict:
    found = faults(rows)
    initials = [role[:1] for role, _ in rows]
    cost, audit = cheapest(Lattice(initials, [f in ("blank", "duplicate") for f in found],
                                   [f == "truncated" for f in found]))
    known = {t for t in turns if t is not None}
    return {"n_rows": len(rows), "gaps": max(known) - min(known) + 1 - len(known) if known else 0,
            **{f: found.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            "cost": cost, "audit": audit,
            "repaired": [{"role": r, "text": t} for r, t in apply_audit(audit, rows)]}


COUNTS = ["n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired array<struct<role: string, text: string>>"


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """One row per conversation: the counts of its faults, the cost and audit
    of the cheapest repair, and the repaired rows."""
    said = [F.coalesce(F.col(c), F.lit(" ")).alias(a) for c, a in ((role_col, "_role"), (text_col, "_text"))]
    dealt = (rows.select(F.col(id_col).alias("_conv"), F.col(turn_col).cast("long").alias("_turn"), *said)
             .repartition("_conv").sortWithinPartitions("_conv", F.col("_turn").asc_nulls_first(), "_role", "_text"))
    kind = dealt.schema["_conv"].dataType
    schema = T.StructType([T.StructField(id_col, kind), *T._parse_datatype_string(RESULT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in C.whole_runs(C.pieces(batches), ["_conv"]):
            conv, turn, role, text = (table.column(c).to_pylist() for c in ("_conv", "_turn", "_role", "_text"))
            out, lo = [], 0
            for hi in range(1, len(conv) + 1):
                if hi == len(conv) or conv[hi] != conv[lo]:
                    out.append({id_col: conv[lo], **_repaired(turn[lo:hi], list(zip(role[lo:hi], text[lo:hi])))})
                    lo = hi
            yield pa.RecordBatch.from_pylist(out, arrow)
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    return dealt.mapInArrow(run, schema)


def damage(rows: DataFrame) -> DataFrame:
    """Conversation rows with planted faults, by the crc32 of ``conv_id:turn``
    (a null is one space): of 20 remainders 0 drops the row, 1 empties its
    text, 2 removes its sentence ends, 3 repeats it and 4 makes its role user."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    ids = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.encode(F.concat_ws(":", *ids), "utf-8")) % 20
    copies = F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(copies).alias("_copy")).drop("_copy")

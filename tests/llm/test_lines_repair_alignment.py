"""Line dedup, conversation repair and tokenizer alignment against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from llm_fixtures import SMALL_SF, make_docs, odd_rows  # noqa: F401
from llm_brute import lower

from marktwert.llm import common as C
from marktwert.llm import conversation_repair as R
from marktwert.llm import line_dedup, queries, token_alignment as TA

WHITE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def order(rows):
    return sorted(rows, key=repr)


# ---- line dedup --------------------------------------------------------------
def brute_lines(rows, min_chars=20, min_docs=3):
    holders = defaultdict(set)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            key = lower(line.strip(WHITE))
            if len(key) >= min_chars:
                holders[key].add(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            found = holders.get(lower(line.strip(WHITE)), set())
            top = max((x for x in found if x is not None), default=None)
            if len(found) < min_docs or doc_id == top:
                kept.append(line)
        out.append((doc_id, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return order(out)


def kept(df):
    from pyspark.sql import functions as F
    text = F.sha2(F.encode(line_dedup.kept_text(), "utf-8"), 256)
    return order((r[0], r[1], r[2], r[3]) for r in df.select("doc_id", "n_lines", "n_dropped", text).collect())


@pytest.fixture
def line_rows(odd_rows):
    rng = random.Random(5)
    shared = [f"Shared line number {i} of some length{'!' * i}" for i in range(6)] + ["short", "  SHARED line number 0 of some length\t"]
    rows = [(100 + i, "\n".join(rng.choice(shared + [f"own line of document {i} number {j}" for j in range(4)])
                                for _ in range(rng.randrange(1, 12)))) for i in range(40)]
    return [(r[0], r[1]) for r in odd_rows] + rows + rows[:3] + [(100, rows[1][1]), (None, rows[2][1]), (200, "\n\n")]


@pytest.mark.parametrize("hot", [1000, 1])
def test_line_dedup_equals_brute_force(spark, make_docs, line_rows, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_KEYS", hot)
    out = line_dedup.keep_bitmaps(spark, make_docs(line_rows))
    assert {"text", "lang", "size", "keep"} <= set(out.columns)
    assert kept(out) == brute_lines(line_rows)


def test_line_dedup_on_the_table_and_empty(spark):
    docs = C.documents(spark, SMALL_SF)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = order(tuple(r)[:4] for r in queries.op11_line_dedup(spark, SMALL_SF).collect())
    assert got == brute_lines(rows)
    assert line_dedup.keep_bitmaps(spark, docs.limit(0)).count() == 0


def test_keep_bitmaps_are_runs(spark, make_docs):
    line = "a line of more than twenty signs"
    out = line_dedup.keep_bitmaps(spark, make_docs([(i, f"x\n{line}\n{line}\ny\nz") for i in range(3)]))
    runs = {r["doc_id"]: [tuple(k) for k in r["keep"]] for r in out.collect()}
    assert runs == {0: [(0, 1), (3, 2)], 1: [(0, 1), (3, 2)], 2: [(0, 5)]}


# ---- conversation repair -----------------------------------------------------
def brute_repair(initials, must_go, cut):
    """Least (cost, audit) by relaxing every node until nothing changes."""
    n, best, todo = len(initials), {(0, 0): (0, "")}, [(0, 0)]
    while todo:
        i, s = todo.pop()
        cost, audit = best[i, s]
        due = "uuau"[s]
        steps = [("I", 2, i, due)]
        if i < n:
            steps.append(("D", 3, i + 1, ""))
            if not must_go[i]:
                steps += [("K", cut[i], i + 1, initials[i]), ("R", 2 + cut[i], i + 1, due)]
        for edit, c, j, initial in steps:
            t = s if edit == "D" else {"": -1, "s": 1 if s == 0 else -1, "u": 2 if s != 2 else -1,
                                       "a": 3 if s == 2 else -1}.get(initial, -1)
            label = (cost + c, audit + edit)
            if t >= 0 and label[0] <= 3 * n and label < best.get((j, t), (1 << 30, "")):
                best[j, t] = label
                todo.append((j, t))
    return min(best[n, s] for s in (0, 3) if (n, s) in best)


def test_search_equals_relaxation():
    rng = random.Random(1)
    for initials in itertools.chain(itertools.product("suat", repeat=3), ["".join(rng.choices("suuaatx ", k=rng.randrange(12)))
                                                                          for _ in range(1500)]):
        must = [rng.random() < 0.2 for _ in initials]
        cut = [not m and rng.random() < 0.3 for m in must]
        cost, audit = R.cheapest(R.Lattice(list(initials), must, cut))
        assert (cost, audit) == brute_repair(list(initials), must, cut)
        roles = "".join(r[:1] for r, _ in R.apply_audit(audit, [(c, "t") for c in initials]))
        assert re.fullmatch("(s?(ua)+)?", roles)


def test_long_conversation_is_repaired():
    n = 20_000
    initials = ["u" if i % 3 else "a" for i in range(n)]
    cost, audit = R.cheapest(R.Lattice(initials, [False] * n, [False] * n))
    roles = "".join(r[:1] for r, _ in R.apply_audit(audit, [(c, "t") for c in initials]))
    assert cost > 0 and re.fullmatch("(s?(ua)+)?", roles)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_s, turn_s = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{conv_s}:{turn_s}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute_conversations(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in damaged(rows):
        groups[conv].append((turn, role, text))
    out = []
    for conv in {r[0] for r in rows}:
        found = sorted(groups[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {t for t, _, _ in found if t is not None}
        faults, seen = [], set()
        for _, role, text in found:
            body = re.sub(f"[{WHITE}]+\\Z", "", text)
            faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in found]
        cost, audit = brute_repair(initials, [f in ("b", "d") for f in faults], [f == "t" for f in faults])
        said, at, previous = [], 0, ""
        for edit in audit:
            due = {"u": "assistant"}.get(previous, "user")
            if edit != "I":
                at += 1
            if edit == "D":
                continue
            role, text = (due, "") if edit == "I" else found[at - 1][1:]
            said.append(((due if edit == "R" else role) + ":" + text))
            previous = said[-1][0]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"),
                    faults.count("t"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                    cost, audit, sha("\n".join(said))))
    return order(out)


def test_repair_query_equals_brute_force(spark, tmp_path):
    rows = [tuple(r) for r in C.documents(spark, SMALL_SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    odd = [(None, 0, "user", "Hi."), (None, None, None, None), (None, 2, "assistant", "Yes."), (900, None, "system", " "),
           (900, None, "user", "x" * 50_000), (901, 5, "tool", "done."), (901, 5, "tool", "done."), (901, 9, "", "empty."),
           (902, 0, "user", "Long. " * 3), (902, 0, "assistant", "Same turn."), (903, None, "user", "")]
    schema = "conv_id long, turn long, role string, text string, cost long, audit string, _conv string"
    extra = spark.createDataFrame([(*r, 1, "x", "y") for r in rows + odd], schema)
    extra.write.parquet(str(tmp_path / "conversations.parquet"))
    out = queries.op12_conversation_repair(spark, str(tmp_path))
    assert order(tuple(r) for r in out.collect()) == brute_conversations(rows + odd)


def test_repair_of_an_empty_table(spark):
    empty = C.documents(spark, SMALL_SF, "conversations").limit(0)
    assert R.repair(empty).count() == 0


# ---- tokenizer alignment -----------------------------------------------------
@pytest.fixture(scope="module")
def tokenizers_pair():
    return TA.Pair(TA.BYTE_BPE, TA.PIECE_BPE)


def brute_alignment(tok, rows):
    """Whole texts encoded at once, overlaps found token by token."""
    docs, corpus = [], Counter()
    for doc_id, text in rows:
        text = text or ""
        a = tok.a.encode(" " + text, add_special_tokens=False).ids
        b = tok.b.encode(text)
        whole = b" " + text.encode()
        if not text or TA.joined(tok.a_bytes, a) != whole or TA.joined(tok.b_bytes, b) != whole:
            a, b = [], []
        ranges = []
        for ids, names in ((a, tok.a_bytes), (b, tok.b_bytes)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(names[i]), i))
                at = out[-1][1]
            ranges.append(out)
        cuts = sorted({e for _, e, _ in ranges[0]} & {e for _, e, _ in ranges[1]})
        groups, k = [], [0, 0]
        for cut in cuts:
            sides = []
            for s in (0, 1):
                ids = []
                while k[s] < len(ranges[s]) and ranges[s][k[s]][1] <= cut:
                    ids.append(str(ranges[s][k[s]][2]))
                    k[s] += 1
                sides.append(",".join(ids))
            groups.append("|".join(sides))
        links, j0 = [], 0
        for x, y, i in ranges[0]:
            while j0 < len(ranges[1]) and ranges[1][j0][1] <= x:
                j0 += 1
            for u, v, j in itertools.islice(ranges[1], j0, None):
                if u >= y:
                    break
                links.append((i, j))
        corpus.update(links)
        docs.append((doc_id, len(a), len(b), len(cuts), ";".join(groups), links))
    most = defaultdict(int)
    for (_, j), n in corpus.items():
        most[j] = max(most[j], n)
    return order((d, na, nb, ng, len(links), sum(corpus[x] == most[x[1]] for x in links), sum(corpus[x] for x in links),
                  sha(groups) if na else "") for d, na, nb, ng, groups, links in docs)


def rows_of(df):
    return order((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"])
                 for r in df.collect())


ODD_TEXTS = ["<|endoftext|> and </s> <s> inside", "▁ sign of a piece", "\x00 nul", "a  b   c\n\n d", "x" * 300, "日本語のテキスト", "🙂🙂 é",
             " lead and trail ", "tab\tand blank ", "don't it's 12345 67", "é é", "﻿mark", "\r\n\r\n", " ", "\n"]


@pytest.mark.parametrize("block", [TA.BLOCK, 500])
def test_alignment_equals_brute_force(spark, make_docs, odd_rows, tokenizers_pair, block):
    rows = [(r[0], r[1]) for r in odd_rows] + [(300 + i, t) for i, t in enumerate(ODD_TEXTS)]
    got = TA.alignment(spark, make_docs(rows), block=block)
    assert rows_of(got) == brute_alignment(tokenizers_pair, rows)


def test_alignment_on_the_table(spark, tokenizers_pair):
    docs = C.documents(spark, SMALL_SF)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = queries.op13_token_alignment(spark, SMALL_SF).withColumnRenamed("groups_sha256", "groups")
    assert rows_of(out) == brute_alignment(tokenizers_pair, rows)
    assert TA.alignment(spark, docs.limit(0)).count() == 0


def test_groups_written_out_and_forgetting(tokenizers_pair, monkeypatch):
    texts = ["The quick brown fox", "straße und Öl", "", "fox The quick"] * 3
    want = TA.Aligned(tokenizers_pair, texts).groups()
    monkeypatch.setattr(TA, "KNOWN", 3)
    assert TA.Aligned(TA.Pair(TA.BYTE_BPE, TA.PIECE_BPE), texts).groups() == want
    assert want[2] == b"" and want[0].count(b"|") == want[0].count(b";") + 1

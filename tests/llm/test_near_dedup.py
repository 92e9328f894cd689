from __future__ import annotations

import random
import re

import numpy as np
import pytest

from marktwert.llm import common as C
from marktwert.llm import near_dedup as N

from llm_fixtures import SMALL_SF, make_docs, odd_rows  # noqa: F401
from llm_brute import components, shingles


def result(df):
    return sorted((r["id"] is None, r["id"] or 0, r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in df.collect())


def expected(rows, k):
    sets = [shingles(t, k) for _, t in rows]
    comp = components(sets)
    out = []
    for (i, _), s, members in zip(rows, sets, comp):
        ids = [rows[m][0] for m in members if rows[m][0] is not None]
        least = (min(ids) if ids else None) if s else i
        out.append((i is None, i or 0, len(s), least if least is not None else -1))
    return sorted(out)


@pytest.mark.parametrize("k", [2, 5])
def test_odd_rows_equal_brute_force(spark, make_docs, odd_rows, k):
    got = result(N.near_duplicates(spark, make_docs(odd_rows), shingle=k))
    assert got == expected([r[:2] for r in odd_rows], k)


@pytest.mark.parametrize("node_limit", [800, 12])
def test_large_group_of_near_copies_and_chains(spark, make_docs, node_limit):
    """One group of 150 near copies (larger than a node), a chain of edits and
    unrelated texts with common words; small nodes force every branch."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(4):
            w[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(100)]
    for i in range(12):
        rows.append((1000 + i, " ".join(chain)))
        chain[8 * i % 100] = f"new{i}"
    for i in range(60):
        rows.append((2000 + i, "the of and in the of and " + " ".join(f"u{rng.randrange(80)}" for _ in range(60))))
    got = result(N.near_duplicates(spark, make_docs(rows), shingle=2, node_limit=node_limit))
    assert got == expected(rows, 2)


def test_blocks_at_the_depth_limit(spark, make_docs, monkeypatch):
    monkeypatch.setattr(N, "SPLIT_DEPTH", 1)
    rng = random.Random(5)
    rows = []
    for i in range(40):  # two texts each; all share most shingles of a common start
        w = [f"s{j}" for j in range(60)] + [f"o{i}_{j}" for j in range(30)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:-2] + [f"z{i}", "end"]))]
    rng.shuffle(rows)
    got = result(N.near_duplicates(spark, make_docs(rows), shingle=2, node_limit=8))
    assert got == expected(rows, 2)


def test_empty_table(spark, make_docs):
    assert N.near_duplicates(spark, make_docs([])).count() == 0
    assert N.keep_one_per_group(spark, make_docs([])).count() == 0


def test_one_of_each_group_stays(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    kept = N.keep_one_per_group(spark, docs, shingle=5)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect())
    assert ids == [1, 4, 5, 6, 7, 9, 10, 11, 11, 13, 14, 15] or 1 in ids and not {2, 3, 12} & set(ids)
    assert len(ids) == len([i for i in ids if i != 11]) + 2


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    for n, m in ((1, 0), (50, 30), (60, 120)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        df = spark.createDataFrame(edges, "u long, v long") if edges else spark.createDataFrame([], "u long, v long")
        got = {r["node"]: r["root"] for r in C.connected_components(spark, df).collect()}
        root = list(range(n))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in edges:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
        assert got == want


def test_recall_of_the_trees():
    """A pair of similarity 0.8 shares a node at every depth in some tree."""
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(300):
        common = rng.integers(0, 2**63, 80, dtype=np.uint64)
        a = np.unique(np.concatenate([common, rng.integers(0, 2**63, 10, dtype=np.uint64)]))
        b = np.unique(np.concatenate([common, rng.integers(0, 2**63, 10, dtype=np.uint64)]))
        tokens = N._tokens([a, b])
        nodes = [{(r, int(t[2 * r]), int(t[2 * r + 1])) for r in range(N.TREES)} for t in tokens]
        missed += not (nodes[0] & nodes[1])
        low = N._sketch(tokens)
        same = sum(int(((low[0] ^ low[1]) >> s & 3 == 0).sum()) for s in (0, 2, 4, 6))
        assert same >= N.LEAST_EQUAL
    assert missed == 0


def test_words_and_shingles_equal_the_regex():
    rng = random.Random(9)
    texts = ["".join(rng.choice("aB \t\n\x0b\x1c\x00é.9") for _ in range(rng.randrange(60))) for _ in range(300)]
    words = C.Words([t.encode() for t in texts], C.SPACE_WORDS)
    h = words.hashes()
    by_hash: dict[int, str] = {}
    for i, t in enumerate(texts):
        want = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        own = h[words.first[i]:words.first[i + 1]].tolist()
        assert len(own) == len(want)
        for x, w in zip(own, want):
            assert by_hash.setdefault(x, w) == w
    sets = C.shingle_sets(h, words.first, 2)
    assert [len(s) for s in sets] == [len(shingles(t, 2)) for t in texts]


@pytest.mark.parametrize("node_limit", [N.NODE, 10])
def test_whole_table_equals_the_inverted_index(spark, node_limit):
    """All links of the table by an index on its shingles; small nodes send
    most pairs through several levels of branching."""
    docs = C.documents(spark, SMALL_SF)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    got = result(N.near_duplicates(spark, docs, node_limit=node_limit))
    assert got == expected(rows, 2)


def test_rows_of_large_nodes_without_a_similar_one_stay_behind():
    import pyarrow as pa
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, N.TOKENS // 4, dtype=np.uint8)
    sketch = np.stack([base, base, *rng.integers(0, 256, (4, len(base)), dtype=np.uint8)])
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 1, 1, 1, 2, 2]), pa.array([0] * 6), pa.array([50] * 6), pa.array(range(6)), pa.array(range(6)),
         C.fixed_binary(sketch)], ["node", "part", "n", "cid", "lab", "sketch"])
    out = [c for b in N._met(iter([batch]), ["node", "part"]) for c in b.column("cid").to_pylist()]
    assert out == [0, 1]


def test_small_table_has_all_documents(spark):
    docs = C.documents(spark, SMALL_SF)
    assert N.near_duplicates(spark, docs).count() == docs.count()


def test_a_level_of_large_nodes_is_moved_once(spark, make_docs, monkeypatch):
    """Near copies of one text, more than a node holds: the rows of a level are
    joined to the list of large nodes once and stored, so the level below reads files."""
    rng = random.Random(3)
    base, rows = [f"w{i}" for i in range(200)], []
    for i in range(60):
        w = list(base)
        w[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w)))
    stored, plain = [], C.store

    def store(spark, df, name, **options):
        if name == "nodes" and stored[-1] in ("trace", "pairs"):
            reads.append((stored[-1], [f for f in df.inputFiles() if "/trace-" in f]))
        stored.append(name)
        return plain(spark, df, name, **options)
    reads = []
    monkeypatch.setattr(C, "store", store)
    got = result(N.near_duplicates(spark, make_docs(rows), shingle=2, node_limit=12))
    assert got == expected(rows, 2)
    below = [files for after, files in reads if after == "trace"]
    assert below and all(below)

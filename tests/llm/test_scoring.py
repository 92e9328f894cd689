"""Toxicity field and SpotSigs fingerprints."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_brute import lower
from llm_fixtures import SMALL_SF, make_docs, odd_rows, prose  # noqa: F401

from marktwert.llm import common as C
from marktwert.llm import queries, spotsigs, toxicity

WORD = "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


# ---- toxicity --------------------------------------------------------------
def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(4)
    trans = rng.normal(size=(2, 2))
    size = np.array([1, 5, 3, 7, 1])
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    score = rng.normal(size=size.sum()) * 2
    marginal, pairs = toxicity.forward_backward(score, trans, at, size)
    want_pairs = np.zeros((2, 2))
    for a, n in zip(at, size):
        weights, total = np.zeros(n), 0.0
        pair = np.zeros((2, 2))
        for y in itertools.product([0, 1], repeat=int(n)):
            w = np.exp(sum(score[a + k] for k in range(n) if y[k]) + sum(trans[y[k - 1], y[k]] for k in range(1, n)))
            total += w
            weights += w * np.array(y)
            for k in range(1, n):
                pair[y[k - 1], y[k]] += w
        assert marginal[a:a + n] == pytest.approx(weights / total)
        want_pairs += pair / total
    assert pairs == pytest.approx(want_pairs)


def test_forward_backward_without_words():
    marginal, pairs = toxicity.forward_backward(np.zeros(0), np.zeros((2, 2)), np.zeros(0, int), np.zeros(0, int))
    assert len(marginal) == 0 and not pairs.any()


def toxic_rows():
    rng = random.Random(3)
    rows = []
    for i in range(240):
        words = prose(rng, rng.randint(20, 90)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "snargle" + rng.choice("abcdefgh")]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_field_tags_words_and_unseen_forms(spark, make_docs, odd_rows):  # noqa: F811
    rows = toxic_rows()
    labelled = spark.createDataFrame(rows + [(900, None, 1), (901, "x", None)], "doc_id long, text string, toxic int")
    field = toxicity.train(spark, labelled)
    texts = [(1, "it is fine. but you are snarglez here"), (2, "all of it is fine in here"), (3, None), (4, ""),
             (5, "é ü vile, and more"), (6, "of the " * 3000 + "vile")]
    got = {r["doc_id"]: r for r in toxicity.tag(spark, make_docs(texts), field).collect()}
    assert [got[i]["score"] >= 0.3 for i in range(1, 7)] == [True, False, False, False, True, True]
    cut = lambda i, t: [t[s["start"]:s["end"]] for s in got[i]["spans"]]
    assert cut(1, texts[0][1]) == ["snarglez"] and cut(5, texts[4][1]) == ["vile"] and cut(6, texts[5][1]) == ["vile"]
    assert got[3]["spans"] == [] and 0 <= got[3]["score"] <= 1
    again = {r["doc_id"]: r["score"] for r in toxicity.tag(spark, make_docs(texts), toxicity.train(spark, labelled)).collect()}
    assert again == {i: got[i]["score"] for i in again}
    odd = toxicity.tag(spark, make_docs(odd_rows), field)
    assert odd.count() == len(odd_rows) and odd.where("score < 0 or score > 1 or score is null").count() == 0
    assert toxicity.tag(spark, make_docs([]), field).count() == 0


def test_without_both_classes_every_score_is_zero(spark, make_docs):  # noqa: F811
    one = spark.createDataFrame([(1, "a b", 1)], "doc_id long, text string, toxic int")
    assert toxicity.train(spark, one) is None
    assert [r["score"] for r in toxicity.tag(spark, make_docs([(1, "a"), (2, None)]), None).collect()] == [0.0, 0.0]


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op2_toxicity(spark, sf).toPandas()
    assert len(got) == C.documents(spark, sf).count()
    held = got.merge(C.documents(spark, sf, "labels").toPandas(), on="doc_id")
    held = held[held.held_out]
    assert (held.predicted == held.toxic).mean() > 0.93
    assert held[held.toxic == 0].predicted.mean() < 0.03


# ---- SpotSigs --------------------------------------------------------------
def brute_spots(text, anchors, chain=3):
    words = re.findall(WORD, lower(text))
    if not any(w in anchors for w in words):
        anchors_at = range(len(words))
    else:
        anchors_at = [i for i, w in enumerate(words) if w in anchors]
    return Counter((words[i], tuple([w for w in words[i + 1:] if w not in anchors][:chain])) for i in anchors_at)


def jaccard(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    return sum((a & b).values()) / sum((a | b).values())


def anchors_of(texts, n=spotsigs.ANCHORS):
    words = Counter(w for t in texts for w in re.findall(WORD, lower(t)))
    return words


def check_neighbours(spark, docs, rows):
    anchors = spotsigs.common_words(docs)
    every = {w for _, t in rows for w in re.findall(WORD, lower(t))}
    hashed = {w: int(C.Words([w.encode()], C.ALNUM_WORDS).hashes()[0]) for w in every}
    common = {w for w, h in hashed.items() if h in set(anchors.tolist())}
    counts = anchors_of([t for _, t in rows])
    if len(common) == spotsigs.ANCHORS:
        assert min(counts[w] for w in common) >= max([counts[w] for w in every - common], default=0)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        edited = text[:len(text) - len(text) // 4] + after[:len(text) // 4]
        a, b, c = (brute_spots(x, common) for x in (text, edited, after))
        want.append((i is None, i or 0, len(text), hashlib.sha256(edited.encode()).hexdigest(), sum(a.values()),
                     round(jaccard(a, b), 6), round(jaccard(a, c), 6)))
    got = spotsigs.neighbours(spark, docs).collect()
    assert sorted((r["id"] is None, r["id"] or 0, r["n_chars"], r["edited_sha256"], len(r["fingerprint"]) // 8,
                   round(r["near_edited"], 6), round(r["near_next"], 6)) for r in got) == sorted(want)
    return got


def test_neighbours_of_odd_rows(spark, make_docs, odd_rows):  # noqa: F811
    rows = [r[:2] for r in odd_rows]
    got = check_neighbours(spark, make_docs(odd_rows), rows)
    prints = {}
    for r in got:
        prints.setdefault(r["id"], set()).add(r["fingerprint"])
    assert prints[1] == prints[2] == prints[12] and prints[4] == prints[5] == {""}


def test_neighbours_of_the_table(spark):
    docs = C.documents(spark, SMALL_SF)
    check_neighbours(spark, docs, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_neighbours_of_one_row_null_ids_and_no_row(spark, make_docs):  # noqa: F811
    one = spotsigs.neighbours(spark, make_docs([(5, "the abcd efgh")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    nulls = spotsigs.neighbours(spark, make_docs([(None, "b c d e"), (None, "a b")])).collect()
    assert len(nulls) == 2
    assert spotsigs.neighbours(spark, make_docs([])).count() == 0


def test_similar_pairs_equal_brute_force(spark, make_docs):  # noqa: F811
    rng = random.Random(12)
    rows = []
    for i in range(30):
        base = prose(rng, rng.randint(30, 120)).split()
        rows.append((3 * i, " ".join(base)))
        rows.append((3 * i + 1, " ".join(base[: int(len(base) * 0.8)] + prose(rng, 12).split())))
        rows.append((3 * i + 2, " ".join(base)))
    docs = make_docs(rows)
    pairs, members = spotsigs.similar_pairs(spark, docs, 0.5, anchors=8)
    anchors = spotsigs.common_words(docs, n=8)
    prints = {i: spotsigs.spots([t.encode()], anchors)[0] for i, t in rows}
    key = {r["id"]: r["key"] for r in members.collect()}
    got = {frozenset((r["a"], r["b"])) for r in pairs.collect()}
    for i, j in itertools.combinations(prints, 2):
        if key[i] != key[j]:
            assert (frozenset((key[i], key[j])) in got) == (spotsigs.likeness(prints[i], prints[j]) >= 0.5)
    assert key[0] == key[2]

"""Substring dedup, decontamination, mixing, language ID and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from llm_fixtures import SMALL_SF, make_docs, odd_rows  # noqa: F401
from llm_brute import lower
from pyspark.sql import functions as F

import corpus_pipeline
from marktwert.llm import common as C
from marktwert.llm import decontaminate, language_id, mixing, queries, substring_dedup

WORD = "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


# ---- substring dedup -------------------------------------------------------
def brute_dedup(rows):
    """Sequential pass over documents in rank order."""
    firsts, places = {}, defaultdict(list)
    for key, text in sorted({(r[0] is None, r[0] or 0, r[1] or ""): r[1] for r in rows}.items()):
        for a, b, unit in substring_dedup.units(text or ""):
            if firsts.setdefault(unit, (key, a)) != (key, a):
                places[key].append((a, b))
    return [substring_dedup.cut(r[1], places[(r[0] is None, r[0] or 0, r[1] or "")])[0] if r[1] else r[1] for r in rows]


def key(row):
    return (row[0] is None, row[0] or 0, row[1] is None, row[1] or "")


def test_substring_dedup_equals_a_sequential_pass(spark, make_docs, odd_rows):
    rows = [r for r in odd_rows if r[0] != 11]  # equal ids with two texts rank by a hash
    got = substring_dedup.dedup(spark, make_docs(rows))
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key) == sorted(
        zip([r[0] for r in rows], brute_dedup(rows)), key=key)


def test_substring_dedup_on_the_table(spark):
    docs = C.documents(spark, SMALL_SF)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.dedup(spark, docs).collect()}
    assert got == dict(zip([r[0] for r in rows], brute_dedup(rows)))


def test_passage_inside_other_lines_is_cut_and_offsets_hold(spark, make_docs):
    passage = " ".join(f"Alpha{i} beta{i} gamma{i} delta{i} epsilon{i} zeta{i} eta{i} theta{i}." for i in range(8))
    rows = [(1, f"first own words here {passage} and more of the first"), (2, "nothing shared\nat all in here"),
            (3, f"other start of text\nother middle {passage} another end"), (4, passage)]
    out = {r["doc_id"]: r for r in substring_dedup.dedup(spark, make_docs(rows)).collect()}
    assert out[1]["text"] == rows[0][1] and out[2]["text"] == rows[1][1]
    assert "gamma5" not in out[3]["text"] and out[3]["text"].startswith("other start of text\nother middle")
    assert out[3]["text"].endswith("another end")
    assert "delta5" not in out[4]["text"]
    for i, text in ((3, rows[2][1]), (4, rows[3][1])):
        kept, at = "", 0
        for s in out[i]["removed"]:
            kept += text[at:s["start"]]
            at = s["end"]
        assert kept + text[at:] == out[i]["text"]


def test_blanks_at_a_line_end_make_no_second_occurrence(spark, make_docs):
    """A line with blanks at its end and the chunk without them are one place."""
    words = " ".join(f"word{i}" for i in range(12))
    rows = [(1, words + "  "), (2, "other " + words + " \t\nend"), (3, "alone " * 3)]
    out = {r["doc_id"]: r["text"] for r in substring_dedup.dedup(spark, make_docs(rows)).collect()}
    assert out[1] == words + "  " and out[3] == "alone " * 3
    assert {k: out[k] for k in out} == dict(zip([1, 2, 3], brute_dedup(rows)))


def test_scratch_tables_go_and_stored_results_stay(spark):
    import os
    from marktwert.session import shared_path
    path = shared_path(spark, "kept", "scratch-test")
    with C.scratch(spark, "t"):
        inner = C.store(spark, spark.range(5).toDF("x"), "a")
        folder = inner.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
        out = C.store_at(spark, inner.where("x > 1"), path)
    assert out.count() == 3 and not os.path.exists(folder)


def test_units_cover_lines_and_sentence_runs():
    text = "One two three four five six. Seven eight nine ten eleven twelve.\nshort line\n\n" + "x " * 12
    found = list(substring_dedup.units(text))
    assert [u for _, _, u in found][0] == "one two three four five six. seven eight nine ten eleven twelve."
    assert found[-1][2] == " ".join("x" * 12)
    assert all(text[a:b].strip() for a, b, _ in found)
    assert list(substring_dedup.units("")) == [] == list(substring_dedup.units(" \n\t.. \n"))


def test_sentences_are_split_by_a_pattern_only_where_a_text_has_other_white_space(monkeypatch):
    slow, calls = substring_dedup.normal, []
    monkeypatch.setattr(substring_dedup, "normal", lambda text: calls.append(text) or slow(text))
    plain = "One two\tthree. Four  five\x0bsix!\nSeven eight nine ten eleven. \u4e2d\u56fd\u3002\n\nA b"
    assert {u for _, _, u in substring_dedup.units(plain)} >= {"one two three. four five six!", "a b"}
    assert not calls
    odd = "One\xa0two  three.\x1cFour\tfive"  # neither of the two signs separates words
    assert [u for _, _, u in substring_dedup.units(odd)] == ["one\xa0two three.\x1cfour five"] and calls


def test_short_lines_and_lines_without_blanks_are_units(spark, make_docs):
    chinese = "\u6211\u4eec\u6bcf\u5929\u90fd\u5728\u8fd9\u91cc\u5de5\u4f5c"
    rows = [(1, f"Share this\nown words of one\n{chinese}"), (2, f"share  THIS\nwords of two\n{chinese}\n..."),
            (3, "words of three\n...\nShare this"), (4, "Share this")]
    out = {r["doc_id"]: r["text"] for r in substring_dedup.dedup(spark, make_docs(rows)).collect()}
    assert out == {1: rows[0][1], 2: "words of two\n...", 3: "words of three\n...", 4: ""}
    assert substring_dedup.n_words(chinese) == len(chinese) == 10 and substring_dedup.n_words("a b c") == 3


def test_passages_across_line_ends_and_without_sentences_are_cut(spark, make_docs):
    rng = random.Random(8)
    word = lambda tag: f"{tag}{rng.randrange(10**6)}"

    def wrapped(words, width):
        return "\n".join(" ".join(words[i:i + width]) for i in range(0, len(words), width))
    sentences = [w + ("." if i % 12 == 11 else "") for i, w in enumerate(word("s") for _ in range(72))]
    unmarked = [word("u") for _ in range(120)]
    han = "".join(chr(0x4e00 + rng.randrange(3000)) for _ in range(30)) + "\u3002"
    rows = [(1, wrapped(sentences, 7)), (2, "own start\n" + wrapped(sentences, 5) + "\nown end"),
            (3, " ".join([word("a") for _ in range(20)] + unmarked + [word("b") for _ in range(20)])),
            (4, wrapped([word("c") for _ in range(9)] + unmarked + [word("d") for _ in range(9)], 6)),
            (5, "the " * 100), (6, "own " + "the " * 57 + "last"),
            (7, f"\u6211{han}"), (8, f"\u4f60\u3002{han}"), (9, f"\u4ed6\u3002{han}")]
    out = {r["doc_id"]: r["text"] for r in substring_dedup.dedup(spark, make_docs(rows)).collect()}
    assert all(out[i] == dict(rows)[i] for i in (1, 3, 7))
    left = [w for w in out[2].split() if w in set(sentences)]
    assert out[2].startswith("own start") and out[2].endswith("own end") and len(left) <= 12
    assert sum(w in set(unmarked) for w in out[4].split()) <= 40
    assert sum(w[0] in "cd" for w in out[4].split()) == 18
    assert out[6].count("the") < 16 and out[6].startswith("own") and out[6].endswith("last")
    assert out[9].strip("\u3002") == "\u4ed6"
    assert out[5].count("the") < 32


# ---- decontamination -------------------------------------------------------
def brute_contamination(docs, items, width=10):
    windows = defaultdict(set)
    for item, text in items:
        w = re.findall(WORD, lower(text))
        for i in range(max(len(w) - width, 0) + 1 if w else 0):
            windows[tuple(w[i:i + width])].add("null" if item is None else str(item))
    out = []
    for i, text in docs:
        w = re.findall(WORD, lower(text))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if (its := windows.get(tuple(w[at:at + n]))):
                    hit.update(range(at, at + n))
                    found |= its
        out.append((i is None, i or 0, len(w), len(hit), sorted(found)))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 200])
def test_contamination_equals_brute_force(spark, make_docs, odd_rows, block_bytes):
    rng = random.Random(4)
    vocabulary = ["a", "bb", "Ccc", "dd9", "é", "x" * 300]
    docs = [(100 + i, " ".join(rng.choice(vocabulary) + rng.choice(["", ".", "\n", ", ", "-"])
                               for _ in range(rng.randrange(60)))) for i in range(60)]
    docs += [r[:2] for r in odd_rows]
    items = [(1, "a bb ccc"), (2, "A"), (3, None), (4, ""), (5, " ".join(rng.choice(vocabulary[:4]) for _ in range(14))),
             (6, "dd9, é"), (7, "a bb ccc"), (None, "bb bb"), (8, " ".join(docs[3][1].split()[2:20])),
             (9, " ".join(odd_rows[0][1].split()[5:40])), (9, " ".join(odd_rows[0][1].split()[5:40]))]
    bench = spark.createDataFrame([(i, t, "e") for i, t in items], "item_id long, text string, window string")
    got = decontaminate.contamination(spark, make_docs(docs), bench, block_bytes=block_bytes)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["_n_words"], r["_n_hit"], sorted(r["_items"]))
                  for r in got.collect()) == brute_contamination(docs, items)


def test_contamination_of_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = make_docs([(1, "a b"), (2, None)])
    assert decontaminate.drop_contaminated(spark, docs, none).count() == 2
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    kept = decontaminate.drop_contaminated(spark, docs, some)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2]
    assert decontaminate.contamination(spark, make_docs([]), some).count() == 0


def test_search_finds_every_position():
    rng = random.Random(8)
    windows = sorted({(" " + " ".join(rng.choice(["ab", "abc", "b", "cab"]) for _ in range(rng.choice([1, 2, 5, 9]))) + " ")
                      .encode() for _ in range(40)})
    texts = [" ".join(rng.choice(["ab", "abc", "b", "cab", "zz"]) for _ in range(rng.randrange(3000))).encode()
             for _ in range(6)] + [b""]
    layout = decontaminate.Layout(texts)
    data = layout.buf.tobytes()
    want = sorted((m.start(), k) for k, w in enumerate(windows) for m in re.finditer(b"(?=" + re.escape(w) + b")", data))
    assert sorted(decontaminate.Searcher(windows).find(layout)) == want


# ---- mixing ----------------------------------------------------------------
def test_targets_stop_at_the_bound_and_share_all(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 1000), ("d", 3), ("ä", 0), (None, 500)]
    got = {r["source"]: r for r in mixing.targets(spark, spark.createDataFrame(
        sizes, "source string, source_size long")).collect()}
    assert set(got) == {s for s, _ in sizes}
    assert all(r["target"] <= 3 * r["source_size"] + 1e-9 for r in got.values())
    assert sum(r["target"] for r in got.values()) == pytest.approx(2513)
    # order a b c d ä null weighs 5 2 1 5 2 1; a, d and ä are at their bounds
    assert (got["a"]["target"], got["d"]["target"], got["ä"]["target"]) == (30, 9, 0)
    assert got["b"]["target"] == pytest.approx(2 * got["c"]["target"])


def test_mix_meets_its_budgets(spark, make_docs, odd_rows):
    rng = random.Random(1)
    rows = [(100 + i, "word " * rng.randrange(40), "en", rng.choice(["a", "b", "c", "d", None])) for i in range(400)]
    docs = make_docs(rows + odd_rows).repartition(5)
    got = mixing.mix(spark, docs).collect()
    assert len(got) == len(rows) + len(odd_rows)
    by = defaultdict(list)
    for r in got:
        assert r["size"] == len(re.findall("[^\x20\x09-\x0D]+", r["text"] or ""))
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    for rows_ in by.values():
        assert sum(r["size"] for r in rows_) == rows_[0]["source_size"]
        assert abs(sum(r["taken"] for r in rows_) - rows_[0]["target"]) <= 1
    again = mixing.mix(spark, docs.repartition(3)).collect()
    order = lambda rs: sorted((r["doc_id"] or -1, r["text"] or "", r["taken"]) for r in rs)
    assert order(got) == order(again)
    copies = mixing.mixed_copies(spark, docs)
    assert copies.agg(F.sum("words")).first()[0] == sum(r["taken"] for r in got)
    assert mixing.mix(spark, make_docs([])).count() == 0


# ---- language ID -----------------------------------------------------------
def test_trigrams_equal_a_loop():
    texts = ["", "Ab", "é-1 Xß", "  ", "a\nb"]
    bins, at = language_id.trigram_bins(texts)
    for i, t in enumerate(texts):
        alone, _ = language_id.trigram_bins([t])
        assert bins[at[i]:at[i + 1]][:len(t) + 1].tolist() == alone[:len(t) + 1].tolist()


def test_mixture_shares_and_rejections(spark, make_docs, odd_rows):
    rng = random.Random(6)
    alphabet = {"xx": "abcdefg", "yy": "hijklmn", "zz": "opqrstu"}

    def text(lang, n):
        return " ".join("".join(rng.choice(alphabet[lang]) for _ in range(rng.randint(2, 7))) for _ in range(n))
    train = [(i, text(k, 60), k) for i, k in enumerate(list(alphabet) * 30)] + [(900, None, "xx"), (901, "abc", None)]
    model = language_id.train(spark, make_docs(train))
    assert model.languages == ["xx", "yy", "zz"]
    mixed = text("xx", 70) + " " + text("zz", 30)
    rows = [(1, text("yy", 1)), (2, mixed), (3, None), (4, ""), (5, "12 34 !!"), (6, text("zz", 3000))]
    docs = make_docs(rows)
    got = {r["doc_id"]: r for r in language_id.identify(spark, docs, model).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 7)] == ["yy", "xx", "und", "und", "und", "zz"]
    assert 0.6 < got[2]["score"] < 0.8 and got[2]["languages"].count(":") == 2
    assert got[3]["score"] == got[5]["score"] == 0 and got[6]["score"] > 0.99
    nothing = language_id.train(spark, make_docs([(1, "abc", None)]))
    assert {r["lang_pred"] for r in language_id.identify(spark, docs, nothing).collect()} == {"und"}
    docs = make_docs([(*r[:2], r[2] or "en") for r in odd_rows])
    kept = language_id.keep_identified(spark, docs)
    assert kept.columns == docs.columns
    assert not {4, 5, 6, 13} & {r["doc_id"] for r in kept.collect()}
    with pytest.raises(Exception, match="languages"):
        language_id.train(spark, make_docs(train), max_languages=2)


def test_mixture_equals_a_plain_loop():
    rng = np.random.default_rng(0)
    model = language_id.Model(["a", "b"], rng.integers(1, 50, (2, language_id.BINS)))
    bins = rng.integers(0, 300, 500)
    share = {"a": 0.5, "b": 0.5}
    column = {"a": 0, "b": 1}
    for _ in range(language_id.ROUNDS):
        new = {"a": 0.0, "b": 0.0}
        for x in bins:
            total = sum(share[k] * model.p[x, column[k]] for k in share)
            for k in share:
                new[k] += share[k] * model.p[x, column[k]] / total / len(bins)
        share = new
    tally = np.bincount(bins, minlength=language_id.BINS)
    full = np.flatnonzero(tally)
    got, _ = language_id._mixture(model.p[full], tally[full].astype(float), language_id.ROUNDS)
    assert got == pytest.approx([share["a"], share["b"]])


def test_language_accuracy_on_held_out_rows(spark):
    got = queries.op10_language_id(spark, "/root/testdata/sf0.01").toPandas()
    docs = C.documents(spark, "/root/testdata/sf0.01").select("doc_id", "lang").toPandas()
    held = got.merge(docs, on="doc_id")
    held = held[held.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97


# ---- pipeline --------------------------------------------------------------
def test_stages_keep_the_columns_and_survive_odd_rows(spark, odd_rows, tmp_path):
    docs = spark.createDataFrame([(i, t, k, s, len(t or "")) for i, t, k, s in odd_rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        at = rows
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, SMALL_SF)
            if n < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == rows.columns
            path = str(tmp_path / f"{n}-{rows is docs}")
            out.write.parquet(path)
            at = spark.read.schema(out.schema).parquet(path)
        assert "words" in at.columns


def test_pipeline_equals_its_stages_by_brute_force(spark):
    """Every stage's decisions on the table against plain Python."""
    from llm_brute import components, shingles
    docs = C.documents(spark, SMALL_SF)
    first = C.store(spark, corpus_pipeline.identify_language(spark, docs, SMALL_SF), "t")
    left = {r["doc_id"]: r["text"] for r in first.collect()}
    assert {r["doc_id"] for r in docs.collect() if any(map(str.isalpha, r["text"] or ""))} - set(left) == set()
    second = C.store(spark, corpus_pipeline.drop_near_duplicates(spark, first, SMALL_SF), "t")
    ids = sorted(left)
    groups = components([shingles(left[i], 5) for i in ids])
    want = {ids[min(g)] for g in groups}
    assert {r["doc_id"] for r in second.collect()} == want
    third = C.store(spark, corpus_pipeline.cut_repeats(spark, second, SMALL_SF), "t")
    rows = [(i, left[i]) for i in sorted(want)]
    clean = dict(zip([r[0] for r in rows], brute_dedup(rows)))
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in third.collect()} == {
        i: (t, len(t)) for i, t in clean.items()}
    fourth = C.store(spark, corpus_pipeline.drop_benchmark_leaks(spark, third, SMALL_SF), "t")
    items = [(r["item_id"], r["text"]) for r in C.documents(spark, SMALL_SF, "benchmark").collect()]
    assert {r["doc_id"] for r in fourth.collect()} == {
        r[1] for r in brute_contamination(sorted(clean.items()), items) if not r[3]}
    last = corpus_pipeline.mix_sources(spark, fourth, SMALL_SF).toPandas()
    assert (last.words > 0).all() and (last.groupby(["doc_id", "epoch"]).size() == 1).all()
    whole = corpus_pipeline.run(spark, SMALL_SF).toPandas()
    columns = ["doc_id", "epoch", "words"]
    assert sorted(map(tuple, whole[columns].values)) == sorted(map(tuple, last[columns].values))


def test_digest_of_no_items_is_of_the_empty_text(spark):
    rows = queries.op5_decontamination(spark, SMALL_SF).where("n_items = 0").select("items_sha256").distinct().collect()
    assert [r[0] for r in rows] == [hashlib.sha256(b"").hexdigest()]


def test_a_text_in_three_languages_stays_and_unlabelled_tables_pass(spark, make_docs):
    rng = random.Random(5)
    letters = {"x1": "abcdefgh", "x2": "ijklmnop", "x3": "qrstuvwx"}

    def text(lang, n=60):
        return " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(n))
    rows = [(i, text(lang), lang) for i, lang in enumerate(list(letters) * 8)]
    rows += [(100, " ".join(text(lang) for lang in letters), None), (101, "12 34", None)]
    docs = make_docs(rows)
    scores = {r["doc_id"]: r["score"] for r in language_id.identify(spark, docs, language_id.train(spark, docs)).collect()}
    assert scores[100] < 0.4
    assert {r["doc_id"] for r in language_id.keep_identified(spark, docs).collect()} == {r[0] for r in rows} - {101}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.keep_identified(spark, unlabelled).count() == len(rows)

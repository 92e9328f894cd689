"""Chat formatting, WARC archives and HTML extraction."""

from __future__ import annotations

import gzip
import hashlib
import html
import io
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import SMALL_SF

from marktwert.llm import chat_format, html_extract, queries, warc
from marktwert.llm import common as C

SNIPPETS = st.text(st.sampled_from("ab\\\n<|>[]/sINT im_start|end"), max_size=30) | st.sampled_from(
    [*chat_format.CONTROL, "\\", "\\\\", "<\\s>", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n"])
TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "tool\nx", "<s>"]), st.lists(SNIPPETS).map("".join)),
                 max_size=6)


# ---- chat ------------------------------------------------------------------
@settings(max_examples=300, deadline=None)
@given(TURNS)
def test_round_trip_and_spans(turns):
    out, spans, rewrites = chat_format.locate(chat_format.chatml, turns)
    assert not rewrites and chat_format.parse(out) == turns
    assert [chat_format.unescape(out[a:b]) for _, _, a, b in spans] == [t for _, t in turns]
    assert [out[a:b] for a, b, _, _ in spans] == [chat_format.chatml([t]) for t in turns]
    body = out.replace(chat_format.START, "").replace(chat_format.END, "")
    assert not any(c in body for c in chat_format.CONTROL)


def test_a_template_that_rewrites_history_is_reported():
    def last_only(turns):  # drops what stands in braces from all but the last turn
        return "".join(f"[{r}]" + (t if k == len(turns) - 1 else re.sub(r"\{.*?\}", "", t)) + "\n"
                       for k, (r, t) in enumerate(turns))
    turns = [("user", "hello"), ("assistant", "{think}yes"), ("user", "more"), ("assistant", "{hm}done")]
    out, spans, rewrites = chat_format.locate(last_only, turns)
    assert rewrites and out == "[user]hello\n[assistant]yes\n[user]more\n[assistant]{hm}done\n"
    assert [out[a:b] for _, _, a, b in spans] == ["hello", "yes", "more", "{hm}done"]
    assert not chat_format.locate(last_only, turns[:1])[2]


def test_conversations_with_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, None, "x"), (2, 0, None, "x"), (3, 5, "assistant", ""),
            (None, 0, "user", "n"), (None, 1, "assistant", "</s>"), (4, 0, "assistant", "long " * 4000),
            (4, 1, "assistant", " probe"), (5, None, "user", "no turn")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows],
                               "conv_id long, turn long, role string, text string, conv string, formatted string")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    assert {k: (r["n_turns"], r["said"]) for k, r in got.items() if k != 4} == {
        1: (2, "user\n\nassistant\nb\n"), 2: (2, "\nx\n\nx\n"), 3: (1, "assistant\n\n"),
        None: (2, "user\nn\nassistant\n</s>\n"), 5: (1, "user\nno turn\n")}
    assert got[4]["learned"] == "long " * 4000 + " probe" and got[None]["learned"] == "</s>"
    assert chat_format.format_conversations(df.limit(0)).count() == 0


# ---- WARC ------------------------------------------------------------------
def test_archives_round_trip_with_odd_rows(spark, tmp_path):
    long = "ü" * 100_000
    rows = [(1, "http://a/", long), (2, "http://b/\r\nX: y", long), (3, None, None), (4, "u", ""), (5, "u", "x" * 99),
            (6, "u", "x" * 99), (7, "u", "y" * 100), (8, "u", "y" * 100), (None, "u", "y" * 100), (8, "u", "y" * 100),
            (9, "u", "WARC/1.1\r\n\r\n" * 20), (10, "u", "\r\n\r\nend\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "d", "f") for r in rows],
                                  "page_id long, url string, html string, digest string, first string").repartition(3)
    path = str(tmp_path / "w")
    warc.write(pages, path)
    got = warc.read(spark, path).withColumn("page", warc.page_number("record_id")).withColumn(
        "of", warc.page_number("refers_to")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(h for i, _, h in rows if i == r["page"]) or ""
        raw = text.encode()
        assert r["payload_bytes"] == len(raw)
        assert r["payload_digest"] == "sha256:" + hashlib.sha256(raw).hexdigest()
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == raw and r["refers_to"] is None
    kinds = sorted((r["page"] or 0, r["record_type"], r["of"]) for r in got)
    assert [k for k in kinds if k[1] == "revisit"] == [(0, "revisit", 7), (2, "revisit", 1), (8, "revisit", 7), (8, "revisit", 7)]
    assert next(r for r in got if r["page"] == 2)["target_uri"] == "http://b/%0D%0AX: y"
    heads = warc.read(spark, path, payload=False)
    only = heads.where("record_type = 'revisit' and target_uri in ('u', 'v')")
    assert only.count() == 3 and only.where("payload is not null").count() == 0
    assert "record_type" not in only.select("target_uri")._jdf.queryExecution().executedPlan().toString().split("Filter")[0]
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_unwanted_blocks_are_sought_past():
    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            Counting.taken += n
            return super().read(n)
    head = "WARC/1.1\r\nWARC-Type: {}\r\nContent-Length: {}\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 5000\r\n\r\n" + b"z" * 5000
    data = b"".join(head.format(t, len(block)).encode() + block + b"\r\n\r\n" for t in ("response", "revisit", "response"))
    assert [r[0] for r in warc.read_records(Counting(data), {"record_type": {"revisit"}}, True)] == ["revisit"]
    assert Counting.taken == len(block)
    assert [r[5] for r in warc.read_records(Counting(data), {}, False)] == [5000] * 3
    assert Counting.taken == len(block)
    zipped = gzip.GzipFile(fileobj=io.BytesIO(b"".join(gzip.compress(p) for p in (data, data))))
    assert len(list(warc.read_records(zipped, {"record_type": {"response"}}, False))) == 4


# ---- HTML ------------------------------------------------------------------
def plain(text):
    return html_extract.extract(text, frozenset())


@pytest.mark.parametrize("page, want", [
    ("", ""),
    ("just text &amp; more&nbsp;here", "just text & more here"),
    ("<nav>menu</nav><article><h1>T</h1><p>a <b>b</b>c<br>d<p>e</article><footer>f</footer>", "T a bc d e"),
    ("<article><p>one</p><aside>no</aside><div class='share'>no</div><section id=comments><p>no</p></section>two</article>",
     "one two"),
    ("<body><header>no</header><div class=\"main-text\"><p>yes\n\n yes</p></div><form>no<input></form>", "yes yes"),
    ("<article>a<script>var t='</article>x'</script>b<!-- no --><style>p{}</style>c</article>d", "a b c"),
    ("<article><header><h1>Title</h1></header><p>x &lt;b&gt;</p></article>", "Title x <b>"),
    ("<article><p>unclosed <i>text", "unclosed text"),
    ("<div class=\"cookie-notice\">no</div><div id='sidebar'>no</div><p>yes</p><div class='ad'>no<p>no</div>", "yes"),
    ("<a href='x>y'>in</a>line < 3", "inline < 3"),
    ("<script>never closed <p>x", ""),
])
def test_structure(page, want):
    assert plain(page) == want


def test_template_text_of_a_host_is_dropped(spark):
    body = "<html><body><div class=x><p>Welcome to our site</p></div><div class=y><p>{}</p></div><p>Call us now</p></body></html>"
    rows = [(i, f"http://h.example/{i}", body.format(f"story {i} &amp; more")) for i in range(20)]
    rows += [(50, None, body.format("alone")), (51, "http://one.example/", body.format("single")), (52, "http://h.example/", None),
             (53, "http://h.example/", ""), (54, "http://h.example/z", body.format("long " * 30000)), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame([(*r, "t", "e") for r in rows], "page_id long, url string, html string, text string, token string")
    got = [(r["id"], r["text"]) for r in html_extract.main_text(spark, pages).collect()]
    assert len(got) == len(rows)
    texts = dict(got)
    assert all(texts[i] == f"story {i} & more" for i in range(20))
    assert texts[51] == "Welcome to our site single Call us now" and texts[50] == "Welcome to our site alone Call us now"
    assert texts[52] == texts[53] == "" and texts[54] == ("long " * 30000).strip()
    assert html_extract.main_text(spark, pages.limit(0)).count() == 0


def test_copies_of_a_page_do_not_make_a_template(spark):
    page = "<html><body><div class=x><p>Main text of {0}</p></div><div class=y><p>more of {0}</p></div></body></html>"
    rows = [(i, f"http://copies.example/{i}", page.format("one")) for i in range(7)]
    rows += [(10 + i, f"http://few.example/{i}", page.format(f"page {i % 2}")) for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["id"]: r["text"] for r in html_extract.main_text(spark, pages).collect()}
    assert all(got[i] == "Main text of one more of one" for i in range(7))
    assert all(got[10 + i] == f"Main text of page {i % 2} more of page {i % 2}" for i in range(6))


def test_the_template_decides_inside_articles(spark):
    page = ("<body><div class=top><p>Site name</p></div><article><h1>Story {0}</h1><div class=tools><p>Tell your friends"
            "</p></div><p>Words of {0}</p></article></body>")
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(8)]
    rows += [(20 + i, f"http://copies.example/{i}", page.format("one") + f"<p>view {i}</p>") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["id"]: r["text"] for r in html_extract.main_text(spark, pages).collect()}
    assert all(got[i] == f"Story {i} Words of {i}" for i in range(8))
    assert all(got[20 + i] == "Story one Tell your friends Words of one" for i in range(5))
    assert html_extract.extract(rows[0][2], frozenset()) == "Story 0 Tell your friends Words of 0"


def test_classes_share_their_vectors(spark):
    page = "<div class=a><p>Every page</p></div>{}<div class=b>x{}</div>"
    rows = [(i, "http://h/", page.format("<ul><li>some</ul>" if i % 2 else "", i)) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, host string, html string").withColumn("host", html_extract.host_of("host"))
    found = {t % (1 << 64) for t in html_extract.templates(spark, df).collect()[0]["template"]}
    token = lambda x: html_extract.xxhash.xxh64_intdigest(x)
    assert {token("/div.a") & ~1, token("/div.b") & ~1, token("/div.a|Every page") | 1} <= found
    assert token("/ul") & ~1 in found and token("/ul|some") | 1 in found
    assert not any(token(f"/div.b|x{i}") | 1 in found for i in range(10))


def test_pages_of_the_table(spark):
    got = {r["page_id"]: r for r in queries.op8_html_extract(spark, SMALL_SF).collect()}
    for r in C.documents(spark, SMALL_SF, "pages").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S).group(1)
        inner = re.sub(r"</?(?:h1|p|br|li|ul)[^>]*>", " ", inner)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", inner)).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def _main(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["id"]: r["text"] for r in html_extract.main_text(spark, pages).collect()}


def test_an_article_with_near_copies_keeps_its_text(spark):
    shared = [f"Paragraph {c} of one article that several pages of the host carry." for c in "abc"]
    page = "<body><div class=x><p>Read on</p></div><article><h1>Title</h1>{}<p>{}</p></article></body>"
    own = [f"Only page {i} has this line." for i in range(4)]
    rows = [(i, f"http://h.example/{i}", page.format("".join(f"<p>{p}</p>" for p in shared), own[i])) for i in range(4)]
    plain_page = "<body><div class=x><p>Read on</p></div><div class=y><p>{}</p><p>{}</p></div></body>"
    # near copies beside other pages of a host: the template is still found
    rows += [(10 + i, f"http://mixed.example/{i}", plain_page.format(" ".join(shared), own[i])) for i in range(4)]
    rows += [(20 + i, f"http://mixed.example/o{i}", plain_page.format(f"Something else {i * 'and more '}.", f"End {i}"))
             for i in range(4)]
    got = _main(spark, rows)
    for i in range(4):
        assert got[i] == " ".join(["Title", *shared, own[i]])
        assert got[10 + i] == " ".join([*shared, own[i]])
        assert got[20 + i] == f"Something else {i * 'and more '}.".replace(" .", " .") + f" End {i}"


def test_a_menu_without_a_telling_name_goes(spark):
    page = "<body><div class=q1><p>Home</p><p>Shop</p></div><div class=q2><p>{}</p></div><div class=q3><p>Imprint</p></div></body>"
    got = _main(spark, [(i, f"http://h.example/{i}", page.format(f"Long own words of the page {i} " * 3)) for i in range(6)])
    assert all(got[i] == (f"Long own words of the page {i} " * 3).strip() for i in range(6))


def test_text_without_a_fixed_place_is_no_template(spark):
    a, b = "<div class=a><p>Alpha</p></div>", "<div class=b><p>Beta</p></div>"
    page = "<body><div class=t><p>Top</p></div>{}<div class=z><p>{}</p></div></body>"
    own = [f"The own words of page number {i}." for i in range(6)]
    got = _main(spark, [(i, f"http://h.example/{i}", page.format(a + b if i % 2 else b + a, own[i])) for i in range(6)])
    assert all(got[i] == ("Alpha Beta " if i % 2 else "Beta Alpha ") + own[i] for i in range(6))


def test_order_and_nesting_of_classes():
    outer, inner = [(1, 7), (2, 7), (3, 7)], [(11, 8), (12, 8)]
    ranks, crossing, slots = html_extract.nested([outer[0], *inner, *inner, *outer[1:]])
    assert ranks == {1: [0], 2: [1], 3: [2], 11: [0, 0], 12: [1, 1]}
    assert not crossing and slots == {7: {(0, 0)}, 8: {(7, 1)}}
    ranks, crossing, slots = html_extract.nested([outer[0], inner[0], outer[1], inner[1], outer[2]])
    assert crossing == {8}
    _, crossing, slots = html_extract.nested([outer[0], *inner, outer[1], *inner, outer[2]])
    assert not crossing and slots[8] == {(7, 1), (7, 2)}
    assert html_extract.nested([]) == ({}, set(), {})


def test_classes_against_explicit_vectors(spark):
    rng = random.Random(5)
    parts = [f"<div class=c{k}><p>Text {k}</p></div>" for k in range(6)]
    pages = ["<body>" + "".join(rng.choices(["", p, p + p], [2, 6, 1])[0] for p in parts) + f"<div class=own><p>own {i}</p></div>"
             for i in range(25)]
    df = spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(pages)], "id long, host string, html string")
    got = html_extract.templates(spark, df.withColumn("host", html_extract.host_of("host"))).collect()[0]
    vectors = {}
    for i, page in enumerate(pages):
        for token, _, _ in html_extract.placed(page):
            vectors.setdefault(token, [0] * len(pages))[i] += 1
    groups = {}
    for token, vector in vectors.items():
        if sum(n > 0 for n in vector) >= 12.5:
            groups.setdefault(tuple(vector), set()).add(token)
    want = {frozenset(g) for g in groups.values() if len(g) >= 2 and any(t % 2 == 0 for t in g)}
    found = {}
    for row in got["classes"]:
        found.setdefault(row["class"], set()).add(row["token"] % (1 << 64))
    assert {frozenset(g) for g in found.values()} == want and len(want) > 3
    assert {t % (1 << 64) for t in got["template"]} == frozenset().union(*want)

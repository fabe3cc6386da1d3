import base64
import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from attestry.llm import html_template as H
from attestry.llm import warc as W

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script></head><body class='has-sidebar'><header class=masthead>Site</header>"
    "<nav><ul><li><a href=/>Home</a></ul></nav><div class=\"cookie-notice\">We use cookies</div><div class=ad>Buy {n}</div>"
    "<article><h1>Title &amp; {n}</h1><p><b>First   line\nof {n}.<br><p>Second &lt;b&gt; line</p><form><input value=x>Name</form>"
    "<div id='comments'><p>Reader says {n}</p></div></article><aside>Other</aside><footer>&copy; {n}</footer>"
)
PLAIN = "<html><body><div id=top>menu <a href=x>a</a></div><div class=story{n}><p>Story {n} told at length in many words.</p><p>And more of it.</p></div><div class=footer>end</div></body></html>"


def test_article_without_its_surroundings(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(n=i)) for i in range(4)] + [(10 + i, f"http://b.example/{i}", PLAIN.format(n=i)) for i in range(4)]
    rows += [(20, None, None), (21, "", ""), (22, "http://c.example/", "<p>Lone &eacute;t&#233; &middot; x"), (23, "http://d.example/", "just text < 3 & more"), (0, "http://a.example/0", PAGE.format(n=0))]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in H.main_text(df).collect()}
    assert H.main_text(df).count() == len(rows)
    for i in range(4):
        assert got[i].text == f"Title & {i}\n\nFirst line of {i}.\n\nSecond <b> line" and got[i].n_chars == len(got[i].text)
        assert got[10 + i].text == f"Story {i} told at length in many words.\n\nAnd more of it."
    assert got[20].text == "" == got[21].text and got[20].n_chars == 0
    assert got[22].text == "Lone été · x" and got[23].text == "just text < 3 & more"
    assert H.main_text(df.filter("false")).count() == 0


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "category-search", "tag-related", "has-share-buttons", "widget"])
def test_wrappers_with_such_names_keep_their_text(name):
    story = "<h1>Title</h1><p>A story told at some length.</p>"
    want = "Title\n\nA story told at some length."
    for page in (f"<div id=page class='{name}'><article>{story}</article></div>", f"<article class='post {name}'>{story}</article>", f"<div class='{name}'>{story}</div>"):
        page = f"<html><body><nav>Home</nav>{page}<footer>end</footer></body></html>"
        assert H.extract(page, ()) == want and sum(x[1] for x in H.roles(page).values() if not x[2]) == 33
    assert H.extract("<article>a <math><mi>x</mi></math> b</article>", ()) == "a x b"


def test_headline_and_lead_beside_the_content(spark):
    page = "<html><body><div class=wrap><h1>Head {n}</h1><p class=lead>A lead of more than twenty letters {n}.</p><div class=content><p>" + "Long text {n}. " * 60 + "</p></div></div><div class=footer>end</div></body></html>"
    other = "<html><body><div class=wrap><h1>Head {n}</h1><p class=lead>A lead of more than twenty letters {n}.</p></div><div class=story><p>" + "Other text {n}. " * 60 + "</p></div></body></html>"
    rows = [(i, f"http://a.example/{i}", (other if i == 5 else page).format(n=i)) for i in range(6)]
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, text in got.items():
        assert text.startswith(f"Head {i}\n\nA lead of more than twenty letters {i}.\n\n") and text.count("text") == 60 and "end" not in text


def test_tags_are_read_as_html_does():
    assert H.extract("<p data-t=it's>Hello world one</p><p>two</p><p>it's three</p>", ()) == "Hello world one\n\ntwo\n\nit's three"
    assert H.extract("<p class=a\"b title='x > y' data-z=\"<p>\">one<a href=/x/>two</a></p><!-- <p>no --><p>three</ >four<p", ()) == "onetwo\n\nthreefour"
    assert H.extract("<body><header><h1>Site</h1></header><p>A</p></body>", ()) == "A"
    assert H.extract("<article><header><h1>Head</h1></header><p>A</p></article>", ()) == "Head\n\nA"
    assert H.extract("<ul><li>a<li><b>b<li>c<ul><li>d</ul><li>e</ul>", ()).split() == list("abcde")


def test_names_alone_take_nothing_from_an_article():
    page = "<article><p class='notice'>a</p><div class='related work'>b</div><p class='form'>c</p><section id='search'>d</section><math>e</math></article>"
    assert H.extract(page, ()) == "a\n\nb\n\nc\n\nd\n\ne"


def test_menu_without_a_name_is_template(spark):
    page = "<html><body><div class=top><a href=/>Home</a> and our address in Long Street 12</div><div class=col><h2>Head {n}</h2><p>Short story {n}.</p></div><div class=low>All rights</div></body></html>"
    rows = [(i, f"http://a.example/{i}", page.format(n=i)) for i in range(6)] + [(3, "http://a.example/3", page.format(n=3))] * 2
    got = H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 8 and all(r.text == f"Head {r.page_id}\n\nShort story {r.page_id}." for r in got)


def test_equal_pages_are_no_template(spark):
    page = "<html><body><div class=top>Menu</div><div class=col><p>Story told once.</p></div></body></html>"
    rows = [(i, f"http://a.example/{i}", page) for i in range(6)] + [(10 + i, f"http://b.example/{i}", page.replace("once", f"{i % 2}")) for i in range(6)]
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "Menu\n\nStory told once." for i in range(6))
    assert all(got[10 + i] == f"Menu\n\nStory told {i % 2}." for i in range(6))  # two different pages: no wording is template


def test_nested_elements_take_linear_time():
    began = time.time()
    assert len(H.roles("<div>" * 100_000 + "x")) == 100_001 and H.extract("<div>" * 100_000 + "x", ()) == "x"
    assert H.extract("<p><b>x" * 50_000, ()).count("x") == 50_000
    assert time.time() - began < 30


def test_classes_equal_brute_force(spark):
    """Folded vectors give the classes that whole occurrence vectors of every page give."""
    draw = random.Random(3)
    names = ["a", "b", "c", "d", "e"]
    pages = []
    for i in range(40):
        parts = [f"<div class={x}>" * (1 + (x == "e")) + (f"word {i}" if x in "ab" else f"fixed {x}") + "</div>" * (1 + (x == "e")) for x in names if x in "ace" or draw.random() < 0.5]
        pages.append((i % 17, f"http://h{i % 3}.example/{i}", "<html><body>" + "".join(parts) + "</body></html>"))
    pages += pages[:7] + pages[:7]
    got: dict[tuple, set] = {}
    for r in H.tokens(spark.createDataFrame(pages, "page_id long, url string, html string")).filter("kind = 0").collect():
        got.setdefault((r.host, r.rows, r.v1, r.v2), set()).add(r.token)
    want: dict[tuple, set] = {}
    for host in {u.split("/")[2] for _, u, _ in pages}:
        own = [H.roles(h) for _, u, h in pages if u.split("/")[2] == host]
        for token in set().union(*own):
            want.setdefault((host, *[r[token].n if token in r else 0 for r in own]), set()).add(token)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    texts = H.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert all("fixed c" not in r.text and "fixed e" not in r.text and "word" in r.text for r in texts)


def test_very_long_page():
    page = "<html><body><article>" + "".join(f"<p>line {i}</p>" for i in range(20_000)) + "</article></body></html>"
    assert H.extract(page, ()).count("\n\n") == 19_999


def test_classes_of_equal_occurrence_nest_into_a_template(spark):
    df = spark.createDataFrame([(i, f"http://a.example/{i}", PAGE.format(n=i)) for i in range(5)], "page_id long, url string, html string")
    mains = {r.host: r.main for r in H.templates(df).collect()}
    assert mains["a.example"].endswith("/article") and mains["*"] == mains["a.example"]


PAGES = [
    (1, "http://x.example/é", "<p>same</p>", 0), (2, None, "<p>same</p>", 0), (3, "http://x.example/3", "WARC/1.1\r\nWARC-Type: response\r\n\r\nnot a record\r\n\r\n", 0),
    (4, "http://x\r\ny/", None, 0), (5, "http://x.example/5", "", 0), (6, "u", "tail\r\n", 0), (7, "u", "é" * 300_000, 0), (8, "u", "twice", 0), (8, "u", "twice", 0), (9, "u", "\n\r\n\n", 0), (10, "u", "\x00 ﻿x", 0),
]


@pytest.mark.parametrize("least", [0, 1])
def test_round_trip(spark, least):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string, kind int").repartition(3)
    got = W.round_trip(df, least).collect()
    assert len(got) == len(PAGES)
    for page, url, html, _ in PAGES:
        raw = (html or "").encode()
        same = [p for p, _, h, _ in PAGES if (h or "").encode() == raw]
        mine = [r for r in got if r.page_id == page]
        assert all(r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode() and r.url == url for r in mine)
        revisits = len(raw) >= least and page != max(same)
        if page == 8:
            assert sorted((r.record_type, r.refers_to) for r in mine) == [("response", None), ("revisit", 8)]
        else:
            assert [(r.record_type, r.refers_to) for r in mine] == [("revisit", max(same)) if revisits else ("response", None)]


@pytest.mark.parametrize("least", [0, 1000])
def test_null_ids_and_small_repeats_are_captures_of_their_own(spark, least):
    rows = [(None, "a", "n"), (None, "b", "n"), (None, "c", "n"), (8, "u", "twice"), (8, "v", "twice"), (9, "w", "once")]
    got = W.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), least).collect()
    assert sorted((r.page_id or 0, r.url) for r in got) == sorted((i or 0, u) for i, u, _ in rows)
    assert sum(r.record_type == "revisit" for r in got) == (0 if least else 3)
    assert {r.refers_to for r in got if r.page_id is None} == {None}


def test_assembly_nests_each_capture(spark, tmp_path):
    df = spark.createDataFrame(PAGES[:3], "page_id long, url string, html string, kind int")
    W.write(W.captures(df), f"file://{tmp_path}/a")
    rows = W.assemble(W.read(spark, f"file://{tmp_path}/a", with_payload=True)).collect()
    assert len(rows) == 3
    for r in rows:
        assert [x.concurrent_to for x in r.request] == [x.concurrent_to for x in r.metadata] == [r.capture] and (r.response is None) != (r.revisit is None)
    assert {bytes(r.response.payload).decode() for r in rows if r.response} == {PAGES[1][2], PAGES[2][2]}
    assert W.round_trip(df.filter(F.lit(False))).count() == 0


def test_assembly_loses_no_record_of_a_capture(spark):
    rows = [("response", "r1", None), ("request", "q1", "r1"), ("request", "q2", "r1"), ("metadata", "m1", "r1"), ("metadata", "m2", "r1"), ("metadata", "m3", "r1"), ("metadata", "lone", None)]
    got = {r.capture: r for r in W.assemble(spark.createDataFrame(rows, "kind string, record_id string, concurrent_to string")).collect()}
    assert sorted(x.record_id for x in got["r1"].request) == ["q1", "q2"] and sorted(x.record_id for x in got["r1"].metadata) == ["m1", "m2", "m3"]
    assert got["r1"].response.record_id == "r1" and got["lone"].response is None and [x.record_id for x in got["lone"].metadata] == ["lone"]

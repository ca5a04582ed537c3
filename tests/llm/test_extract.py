"""Page extraction: structure, broken markup, and host boilerplate against brute force."""

import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from contrail.llm import extract
from contrail.llm.queries import QUERIES


def text_of(html):
    text, loose = extract.read_page(html)
    return text if text is not None else loose


def test_structure():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="ad box">buy <div>more</div> now</div>
    <div id="cookie-notice">we use</div><main><article class="post"><header><h2>Head &amp; line</h2></header><p>One<br>two <b>th</b>ree
    &lt;4&gt;&#233;</p><aside>side</aside><form>f<input></form><script>var t="</p>";</script><p>a < b &copy; x</p><!-- c -->
    <section class="comments"><p>first!</p></section><ul><li>i</li><li>j</ul></article></main><footer>foot</footer></body>"""
    assert text_of(page) == "Head & line One two three <4>é a < b © x i j"


def test_wrappers():
    assert text_of('<form id=f>q<div class="wrap has-sidebar"><article>a<form>b</form></article></div></form>') == "a"
    assert text_of('<div class="sidebar-left">s</div><p>t</p><form>u</form>') == ["t"]
    assert text_of('<div class="with-ads no-nav">x</div>') == ["x"]


def test_broken_markup():
    assert text_of("") == [] and text_of("plain <b>text") == ["plain text"]
    assert text_of("<article>a<div class='ad'>x</article>b") == "a"
    assert text_of("<article>a <p title=\"x>b</p> c</article>") == "a b c"
    assert text_of("<article>a<script>never closed") == "a"
    assert text_of("<article><p>a</p><!-- open <p>b</p></article>") == "a"
    assert text_of("<article>x<br/>y<img src=a>z</article") == "x yz"
    assert text_of("<ARTICLE>A</ARTICLE><article class=comment>no</article>") == "A"
    start = time.time()
    for piece in ("<", "<p>", "<a \"", "<!-", "</div>", "<div class=ad>", "&", "<article>", " "):
        extract.read_page(piece * 60_000)
    assert time.time() - start < 20


def test_drawings_and_formulas():
    assert text_of("<article><p>one <svg class=i /> two</p><p>three</p></article>") == "one two three"
    assert text_of("<article>a<svg><g/><svg><text>x</text></svg><text>y</text></svg>b</article>") == "ab"
    assert text_of("<article>a <svg><text>x</text> b<p>c</p></article><p>d</p>") == "a x b c"
    assert text_of("<article>a <svg><svg/><path d='>'/></svg>b <template><p>no</p></template>c</article>") == "a b c"
    formula = "<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding=tex>x=2</annotation></math>"
    assert text_of(f"<article>so {formula} holds<math/> here</article>") == "so x=2 holds here"
    assert text_of("<article>a<noscript><img src=x></noscript>b<noscript>c</article>") == "abc"
    start = time.time()
    for piece in ("<svg>", "<template>", "<svg><template>", "<svg", "<svg>'"):
        extract.read_page("<article>a" + piece * 60_000)
    assert time.time() - start < 20


def test_sections_of_an_article_stay():
    for name in ("notice-of-motion", "copyright-law", "social-history", "search-results", "reply-brief", "menu_of_the_day"):
        assert text_of(f"<article><p>a</p><div class='{name}'>b</div><p id={name}>c</p></article>") == "a b c"
        assert text_of(f"<article class='post {name}'><p>a</p></article>") == "a"
        assert text_of(f"<main><section class='post-content {name}'>a</section></main>") == "a"
    for name in ("ad", "ad-box", "share-buttons", "related-posts", "comment-list", "cookie-notice", "newsletter_signup-form"):
        assert text_of(f"<article><p>a</p><div class='x {name}'>b</div><p>c</p></article>") == "a c"


def test_suffix_array():
    draw = np.random.default_rng(3)
    for n in (1, 2, 7, 60):
        codes = draw.integers(0, 3, n)
        assert extract.suffix_array(codes).tolist() == sorted(range(n), key=lambda i: codes[i:].tolist())


def test_stretches_against_brute_force():
    draw = random.Random(4)
    for _ in range(60):
        codes = [draw.randint(0, 2) for _ in range(draw.randint(1, 40))]
        size = draw.randint(1, 4)
        order, numbers = extract.stretches(np.array(codes), size)
        number = dict(zip(order.tolist(), numbers.tolist()))
        for a in range(len(codes)):
            for b in range(a):
                same = max(a, b) + size <= len(codes) and codes[a : a + size] == codes[b : b + size]
                assert (number[a] == number[b]) == same


def test_pieces_hold_every_stretch_once():
    draw = random.Random(5)
    for n in (0, 1, 7, 8, 9, 300):
        tokens = [draw.choice("abc") for _ in range(n)]
        seen, places = set(), []
        anchors = {}
        for key, first, end, fresh in extract.pieces(tokens):
            for at in range(first, end - extract.REACH + 1):
                own = tuple(tokens[at : at + extract.REACH])
                assert fresh == (own not in seen)
                assert anchors.setdefault(own, key) == key
                seen.add(own)
                places.append(at)
        assert places == list(range(max(0, n - extract.REACH + 1)))


def test_pages(spark):
    menu = "<p>Home news sport weather travel food and more</p>"
    rows = [(k, f"http://Host.example/{k}", f"{menu}<p>unique{k} words only here{k}</p><div>All rights kept by the host of pages</div>") for k in range(40)]
    rows += [(100, None, None), (101, "x", ""), (102, "http://other.example/", "<p>a b</p>"), (103, "u", "<article>q</article>"), (103, "u", "<article>q</article>"), (None, None, "<i>z</i>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("loose", F.lit(1))
    for most in (4096, 0):
        found = [tuple(r) for r in extract.extract(pages, key_pieces=most).collect()]
        assert len(found) == len(rows)
        texts = {(i, u): t for i, u, t, _ in found}
        for k in range(40):
            assert texts[k, f"http://Host.example/{k}"] == f"unique{k} words only here{k}"
        assert texts[100, None] == "" and texts[101, "x"] == "" and texts[102, "http://other.example/"] == "a b"
        assert texts[103, "u"] == "q" and texts[None, None] == "z"
        assert all(n == len(t) for _, _, t, n in found)
    assert extract.extract(pages.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    found = QUERIES["op9_extraction"](spark, folder).collect()
    assert len(found) == len(pages)
    for row in found:
        body = re.search("<article>(.*)</article>", pages[row.page_id].html, re.S).group(1)
        plain = re.sub("<br>|</?(p|h1)>", " ", body).replace("<b>", "").replace("</b>", "")
        for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
            plain = plain.replace(name, sign)
        assert row.url == pages[row.page_id].url and row.n_chars == len(row.text)
        assert row.text == " ".join(plain.split()) or "&am" in body


def test_items_left_open():
    for n in (1, 62, 63, 64, 500):
        item = '<li class="nav-item"><a href=x>menu</a>'
        assert text_of(f"<nav><ul>{item * n}</ul></nav><article><p>story</article>") == "story"
        assert text_of(f"<ul>{item * n}</ul><article>story</article>") == "story"
        assert text_of("<nav>" + "<span class=ad>x" * n + "</nav><main>story</main>") == "story"
    assert text_of("<article>a<ul><li class=share>s<li>b<li class=share>t<ul><li>u<li>v</ul>w</li><li>c</ul>d</article>") == "a b c d"
    assert text_of("<article>a<dl><dt class=ad>x<dd>b</dl><p class=promo>y<p>c<p class=promo>z<div>d</div></article>") == "a b c d"
    assert text_of('<p class="share">s<article>story</article>') == "story"
    assert text_of("<ul class=menu><li class=item>a<ul class=nav><li>b</li><li>c</li></ul></li><li>d</ul><p>e") == ["e"]
    start = time.time()
    for piece in ("<li class=nav>", "<li class=nav><ul>", "<p class=ad><span class=ad>", "<li class=ad></div>", "<nav><li>"):
        extract.read_page(piece * 40_000)
    assert time.time() - start < 20


def own_words(draw, n):
    return " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def texts_of(spark, rows, **how):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = extract.extract(pages, **how).collect()
    assert len(found) == len(rows)
    return {r.page_id: r.text for r in found}


def test_pages_count_for_the_whole_host(spark):
    draw = random.Random(11)
    notice = "this section is kept by the council of the town"
    menu = "".join(f"<li>{word}" for word in "home news sport weather travel food more".split())
    own = {k: own_words(draw, 25) for k in range(300)}
    rows = [(k, f"http://big.example/{k}", f"<ul>{menu}</ul><p>{own[k]}</p>" + f"<p>{notice}</p>" * (k < 5)) for k in range(300)]
    for most in (4096, 1):
        assert texts_of(spark, rows, key_pieces=most) == own


def test_near_copies_and_phrases_stay(spark):
    draw = random.Random(12)
    parts = [own_words(draw, 40) for _ in range(5)]
    phrase = "as the old saying of the sailors of the north goes"
    rows, wanted = [], {}
    for k in range(30):  # one word of one paragraph differs; all others are the same on every page
        mine = [*parts]
        mine[k % 2] = mine[k % 2].rsplit(" ", 1)[0] + f" word{k}"
        rows.append((k, "http://copies.example/x", "".join(f"<p>{part}</p>" for part in mine)))
        wanted[k] = " ".join(mine)
    for k in range(100, 104):  # few near copies with a line of their own
        rows.append((k, "http://few.example/x", "".join(f"<p>{part}</p>" for part in [*parts, f"written for the day number {k}"])))
        wanted[k] = " ".join([*parts, f"written for the day number {k}"])
    for k in range(200, 240):  # a phrase inside of sentences
        wanted[k] = f"{own_words(draw, 9)} {phrase} {own_words(draw, 9)}"
        rows.append((k, "http://said.example/x", f"<p>{wanted[k]}</p>"))
    rows += [(k, "http://many.example/x", f"<p>{parts[0]}</p><p>{parts[1]}</p>") for k in range(300, 360)]  # exact copies
    wanted |= {k: f"{parts[0]} {parts[1]}" for k in range(300, 360)}
    assert texts_of(spark, rows) == wanted


def test_copies_do_not_meet_in_one_group(spark):
    rows = [(k, "http://copies.example/x", "<p>one text of seven words on it</p>") for k in range(2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = extract.extract(pages)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    assert {(r.page_id, r.text) for r in found.collect()} == {(k, "one text of seven words on it") for k in range(2000)}


def brute_texts(rows):
    """The host step over (page_id, url, blocks) of distinct pages with own words on most of each page, place by place."""
    hosts = {}
    for _, url, blocks in rows:
        hosts.setdefault(url, set()).add(tuple(blocks))
    out = {}
    for page_id, url, blocks in rows:
        streams = [extract.stream(list(page)) for page in hosts[url]]
        holds = [{tuple(s[at : at + 8]) for at in range(len(s) - 7)} for s in streams]
        mine = extract.stream(blocks)
        count = [sum(tuple(mine[at : at + 8]) in held for held in holds) for at in range(len(mine) - 7)]
        whole, often = [False] * len(mine), [False] * len(mine)
        for at, n in enumerate(count):
            if n >= 3:
                whole[at : at + 8] = [True] * 8
                if n >= 0.05 * len(holds):
                    often[at : at + 8] = [True] * 8
        stays = [token != extract.MARK for token in mine]
        marks = [at for at, token in enumerate(mine) if token == extract.MARK]
        for i in range(len(marks)):
            for j in range(i + 1, len(marks)):  # any run of whole blocks
                if all(whole[marks[i] : marks[j] + 1]) and marks[j] - marks[i] - (j - i) >= 6:
                    stays[marks[i] : marks[j]] = [False] * (marks[j] - marks[i])
        for first in range(len(mine)):
            for end in range(first + 12, min(len(mine), first + 40) + 1):
                if all(often[first:end]) and sum(token != extract.MARK for token in mine[first:end]) >= 12:
                    stays[first:end] = [False] * (end - first)
        out[page_id] = " ".join(token for token, stay in zip(mine, stays) if stay)
    return out


def test_host_step_against_brute_force(spark):
    draw = random.Random(21)
    shared = [own_words(draw, n) for n in (2, 5, 6, 7, 11, 12, 13, 20)]
    rows = []
    for host in range(3):
        for k in range((8, 30, 90)[host]):
            blocks = []
            for _ in range(draw.randint(1, 4)):
                block = own_words(draw, draw.randint(25, 40))
                if draw.random() < 0.4:  # shared words inside of a block, the rare ones on few pages
                    block += " " + shared[min(draw.randrange(8), draw.randrange(8))] + " " + own_words(draw, 3)
                blocks.append(block)
                if draw.random() < 0.4:
                    blocks.append(shared[draw.randrange(8)])
            rows.append((1000 * host + k, f"http://h{host}.example/", blocks))
    wanted = brute_texts(rows)
    html = [(i, u, "".join(f"<p>{b}</p>" for b in blocks)) for i, u, blocks in rows]
    assert any(wanted[i] != " ".join(blocks) for i, _, blocks in rows)
    for most in (4096, 2):
        assert texts_of(spark, html, key_pieces=most) == wanted


def test_menus_and_notices_inside_blocks_go(spark):
    draw = random.Random(13)
    menu = "".join(f"<li>{own_words(draw, 1)}" for _ in range(84))
    notice = "please read the terms of use of this site before you write"
    own = {k: (own_words(draw, 30), own_words(draw, 30)) for k in range(100)}
    rows = [(k, "http://n.example/", f"<ul>{menu}</ul><p>{a} {notice} {b}</p>") for k, (a, b) in own.items()]
    assert texts_of(spark, rows) == {k: f"{a} {b}" for k, (a, b) in own.items()}


def test_teasers_beside_the_text(spark):
    teaser = "".join(f"<article><h3>more of topic {k} to read here</h3></article>" for k in range(3))
    draw = random.Random(14)
    own = {k: own_words(draw, 60) for k in range(20)}
    rows = [(k, "http://t.example/", f"<div>{teaser}</div><div class=text><p>{text}</p></div>") for k, text in own.items()]
    assert texts_of(spark, rows) == own
    assert text_of("<article>a longer article</article><p>b</p><article>c</article>") == "a longer article c"
    assert text_of("<p>a longer text outside</p><main><article>a</article><article>c</article></main>") == "a c"


def test_a_long_page(spark):
    draw = random.Random(15)
    text = own_words(draw, 200_000)
    assert texts_of(spark, [(1, "http://l.example/", f"<p>{text}</p>"), (2, "http://l.example/", "<p>short</p>")]) == {1: text, 2: "short"}

"""Pages, archives and conversations."""

import gzip
import io
import time

import pytest
from pyspark.sql import functions as F

from tracewright.llm import chat, html_page, html_template, queries, warc


# --- pages --------------------------------------------------------------------------------------


def test_main_text_without_boilerplate():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>x";</script></head><body>
    <header>Site</header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
    <main><article><h1>Title &amp; more</h1><p><b>First   para.<br><p>Second&nbsp;para <i>in</i>line.<aside>see also</aside>
    <form><input><button>Send</button></form><pre>x
    y</pre><div class="comments"><p>Reader says</p></div></article></main><div id="sidebar">side</div><footer>&copy; foot</footer>"""
    assert html_template.main_text(page) == "Title & more\n\nFirst para.\n\nSecond para inline.\n\nx y"


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("no markup at all", "no markup at all"), ("<p>a<p>b", "a\n\nb"), ("<nav>x</nav>", ""), ("a < b <!-- c", "a < b"), ("<p>one</b></i></p>two", "one\n\ntwo")])
def test_odd_pages(page, text):
    assert html_template.main_text(page) == text


def test_template_text_of_a_host_goes(spark):
    page = lambda i: f"<html><body><div><p>Welcome to our site of many words</p><p>Unique story {i} told at length</p><p>Shared closing words of every page</p></div></body></html>"
    rows = [(i, f"http://one.example.com/{i}", page(i)) for i in range(12)] + [(100, "http://two.example.com/", page(100)), (101, None, None), (101, None, None)]
    out = {r["page_id"]: r["text"] for r in html_template.extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, tokens int")).collect()}
    assert out[3] == "Unique story 3 told at length"
    assert out[100].startswith("Welcome") and out[101] == ""


def texts_of(spark, rows):
    return {r["page_id"]: r["text"] for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_the_template_alone_finds_the_text(spark):
    """Pages of the generator with all elements that mean something turned into div, without classes: the text is the same."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    plain = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", r"<(/?)(nav|article|footer|header|main|aside)\b", "<$1div"), r' class="[^"]*"', ""))
    big = {r["host"] for r in pages.groupBy(html_template._host(F.col("url")).alias("host")).count().where("count >= 5").collect()}
    assert big
    rows = pages.select("page_id", html_template._host(F.col("url")).alias("host"), "html").collect()
    want = {r["page_id"]: html_template.main_text(r["html"]) for r in rows if r["host"] in big}
    got = {r["page_id"]: r["text"] for r in html_template.extract(plain).collect()}
    assert {i: got[i] for i in want} == want
    # without the template, and with another one, it is not
    assert all(html_template.main_text(r["html"]) != want[r["page_id"]] for r in plain.select("page_id", html_template._host(F.col("url")).alias("host"), "html").collect() if r["host"] in big)
    host = sorted(big)[0]
    found = html_template.templates(plain).where(F.col("__host") == F.xxhash64(F.lit(host))).first()
    assert found and len(found["tokens_of"]) > 10 and found["region"]
    template = html_template.Template(dict(zip(found["tokens_of"], found["class_of"], strict=True)), {c: found["class_of"].count(c) for c in found["class_of"]}, {n: t for n, t in zip(found["numbers_of"], found["times_of"], strict=True) if t}, dict(zip(found["slots_of"], found["roles_of"], strict=True)), found["region"])
    turned = html_template.Template(dict(zip(list(template.of)[1:] + list(template.of)[:1], template.of.values(), strict=True)), template.size, {n: t + 1 for n, t in template.times.items()}, {s + 1: r for s, r in template.roles.items()}, template.region + 2)
    page = next(r["html"] for r in plain.withColumn("host", html_template._host(F.col("url"))).collect() if r["host"] == host)
    assert html_template.main_text(page, template) in want.values() and html_template.main_text(page, turned) != html_template.main_text(page, template)


def test_labels_that_occur_several_times_go(spark):
    """A label three times on each of 12 pages, and one as often as there are entries, which differs by page."""
    entry = lambda i, k: f"<div><b>Posted in:</b><p>Entry {k} of page {i}, told in words of its own {i * 7919 + k}</p></div>"
    same_count = [(i, "http://a.example.com/", f"<body>{''.join(entry(i, k) for k in range(3))}</body>") for i in range(12)]
    other_count = [(100 + i, "http://b.example.com/", f"<body>{''.join(entry(i, k) for k in range(2 + i % 4))}</body>") for i in range(12)]
    out = texts_of(spark, same_count + other_count)
    assert all("Posted" not in t and t.count("Entry") == (3 if i < 100 else 2 + i % 4) for i, t in out.items())


def test_menus_inside_main_go_by_the_template(spark):
    page = lambda i: f"<main><h2>Title {i}</h2><p>Story {i} with <a href=x>a link</a> and words enough</p><ul class='more-stories'>{''.join(f'<li><a href=y>Other story {i + k}</a></li>' for k in range(4))}</ul></main>"
    out = texts_of(spark, [(i, "http://a.example.com/", page(i)) for i in range(12)])
    assert out == {i: f"Title {i}\n\nStory {i} with a link and words enough" for i in range(12)}


def test_an_article_of_links_is_kept(spark):
    page = lambda i: f"<article><ul>{''.join(f'<li><a href=y>Source {i}, {k}</a></li>' for k in range(4))}</ul></article>"
    out = texts_of(spark, [(i, "http://a.example.com/", page(i)) for i in range(6)])
    assert out == {i: "\n\n".join(f"Source {i}, {k}" for k in range(4)) for i in range(6)}


def test_small_hosts_and_hosts_of_copies(spark):
    """Hosts of one or two pages, and of copies of one page that differ in one block, have no template: nothing varies enough to tell by."""
    two = [(i, "http://two.example.com/", f"<body><div><p>Welcome</p><p>Story {i}</p></div><div class='cookie-notice'>Cookies</div></body>") for i in range(2)]
    words = " ".join(f"w{k}" for k in range(80))
    copies = [(100 + i, "http://copies.example.com/", f"<body><div><p>{words}</p><p>{words[::-1]}</p><p>Copy {i}</p></div></body>") for i in range(30)]
    out = texts_of(spark, two + copies)
    assert out[0] == "Welcome\n\nStory 0"
    assert all(out[100 + i] == f"{words}\n\n{words[::-1]}\n\nCopy {i}" for i in range(30))


def test_crossing_and_unordered_classes_are_no_template():
    a, b = 10, 20
    t = html_template.Template({1: a, 2: a, 3: a, 5: b, 6: b}, {a: 3, b: 2})
    slots, spans, bad = html_template.cut([1, 7, 5, 8, 6, 2, 9, 3], t)
    assert not bad and len(spans[a]) == 1 and len({slots[1], slots[3], slots[6]}) == 3 and slots[0] == html_template.CONSTANT
    assert html_template.cut([1, 5, 2, 6, 3], t)[2] == {b}
    assert html_template.cut([5, 5, 6], t)[2] == {b}


@pytest.mark.parametrize("piece", ["<a x='y\" ", "<a x='y\" >", "<!", "<!--", "<", "<b>", "</x>", "<p><b>", "<a href='", "<script>", "<svg>", "<li>", "<div class=\"a", "<a class   ", "&amp"])
def test_reading_takes_linear_time(piece):
    """3 MB of what a reader might search again and again."""
    start = time.time()
    html_page.read(piece * (3_000_000 // len(piece)))
    assert time.time() - start < 30


def test_an_article_keeps_what_its_host_repeats(spark):
    page = lambda i: f"<html><body><div><p>Site words</p></div><article><p>Part of a series</p><p>Story {i}</p><p>A passage shared by all</p></article></body></html>"
    pages = spark.createDataFrame([(i, f"http://one.example.com/{i}", page(i)) for i in range(12)], "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in html_template.extract(pages).collect()}
    assert out == {i: f"Part of a series\n\nStory {i}\n\nA passage shared by all" for i in range(12)}


@pytest.mark.parametrize(
    "page",
    [
        "<body class='single no-sidebar'><article><p>Text</p></article></body>",
        "<html class='js sidebar'><body class='header-fixed'><p>Text</p></body></html>",
        "<div id='page' class='with-sidebar'><p>Text</p></div>",
        "<div id='page' class='sidebar-right'><main><article><p>Text</p></article></main><div class='sidebar'>side</div></div>",
        "<main class='content has-comments'><p>Text</p></main>",
        "<main class='content comments-open'><div class='wrap sidebar-left'><article class='post promo'><p>Text</p><div class='share'>Share</div></article></div></main>",
        "<article><p>Text</p><div class='comments'><article class='comment'>Reader</article></div></article><div class='related-posts'><article>Other</article></div>",
        "<div class='sidebar-right'><article><p>Text</p></article><div class='promo'><article>Other</article></div></div>",
        "<div><p>Text</p></div><div id='comments'><article class='comment'>Reader</article></div>",
        "<main><p>Text</p></main><aside><article>Other</article></aside>",
        "<body class='single right-sidebar'><article><p>Text</p></article></body>",
        "<article><div class='side-by-side'>Te</div></article>".replace("Te", "Text"),
        "<article><div class='share-price'>Text</div></article>",
        "<article><p>Text</p><div class='share-buttons'>Share</div><div class='related-posts'>R</div><div class='cookie-notice'>C</div></article>",
    ],
)
def test_wrappers_with_boilerplate_words_keep_the_text(page):
    assert html_template.main_text(page) == "Text"


@pytest.mark.parametrize("mark", ['<svg class="i"/>', "<svg><path d=''/></svg>", "<math />", "<svg>", "<object data=x>", "<audio src=x>", "<video src=x>", "<canvas>", "<select>"])
def test_raw_elements_without_an_end_tag(mark):
    assert html_template.main_text(f"<article><p>One</p>{mark}<p>Two</p></article>") == "One\n\nTwo"
    if mark.endswith("/>"):
        assert html_template.main_text(f"<article><p>One</p>{mark}<p>Two</p><svg>x</svg><p>Three</p></article>") == "One\n\nTwo\n\nThree"
    assert html_template.main_text("<article><p>One</p><script>var x;<p>Two</p></article>") == "One"


def test_pages_of_the_generator(spark, small):
    out = queries.QUERIES["op4_html_main_text"](spark, small).toPandas()
    assert len(out) == spark.read.parquet(f"{small}/pages.parquet").count()
    assert (out.n_chars == out.text.map(len)).all() and (out.n_chars > 0).all()
    assert not out.text.str.contains("track(", regex=False).any() and not out.text.str.contains("<p>").any()


# --- archives -----------------------------------------------------------------------------------

PAGES = [(1, "http://a/", "same"), (2, "http://b/", "same"), (9, None, "same"), (3, "http://c/\r\nX: y", "other\r\n\r\nWARC/1.1"), (4, "u", None), (5, "u", ""), (6, "u", "é" * 100_000), (7, "u", "twice"), (7, "u", "twice"), (None, "u", "same")]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, payload string")
    archives, folder = warc.archived(pages)
    rows = warc.read_archives(archives, folder).collect()
    assert len(rows) == len(PAGES) and not any(r["problem"] for r in rows)
    by = {r["page_id"]: r for r in rows}
    for i, _, html in PAGES:
        raw = (html or "").encode()
        assert by[i]["payload_bytes"] == len(raw) and by[i]["payload_digest"] == warc.digest(raw)
        if by[i]["record_type"] == "response":
            assert bytes(by[i]["payload"]) == raw
    assert {i: by[i]["refers_to"] for i in (1, 2, 9, 4, 5, 7, None)} == {1: 9, 2: 9, 9: None, 4: 5, 5: None, 7: None, None: 9}


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r["page_id"]: r["refers_to"] for r in warc.referred(pages, least=3).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


def test_records_are_members_that_gunzip_reads():
    data = warc.record(1, "u", b"x" * 10, None)
    assert gzip.decompress(data).startswith(b"WARC/1.1\r\n") and gzip.decompress(data).endswith(b"x\r\n\r\n")


def read(data):
    return list(warc.Reader(io.BytesIO(data).read))


def test_damaged_archives():
    one, two = warc.record(1, "u", b"first", None), warc.record(2, "u", b"second", None)
    assert [r.payload for r in read(one + two)] == [b"first", b"second"]
    assert read(b"") == []
    cut = read(one + two[:-20])
    assert cut[0].payload == b"first" and cut[1].problem.startswith("EOFError")
    noisy = read(b"garbage" + one)
    assert noisy[0].problem and noisy[-1].payload == b"first"
    plain = gzip.decompress(one).replace(b"first", b"fUrst")
    assert read(gzip.compress(plain))[0].problem == "payload digest"
    assert read(gzip.compress(gzip.decompress(one)[:-2]))[0].problem is not None


# --- conversations ------------------------------------------------------------------------------


def rendered(spark, rows):
    out = chat.format_preferences(chat.paired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")))
    return sorted(((r["pair_id"], r["part"], r["turn"], r["role"], r["rendered"], r["loss_start"], r["loss_end"]) for r in out.collect()), key=str)


def test_prefix_is_rendered_once(spark):
    say = lambda c, t, r, x: (c, t, r, x, "mine")
    rows = [say(0, 0, "user", "hi"), say(0, 1, "assistant", "yes"), say(0, 2, "user", "bye"), say(1, 0, "user", "hi"), say(1, 1, "assistant", "no"), say(1, 2, "user", "bye")]
    got = rendered(spark, rows)
    assert [(p, t) for _, p, t, *_ in got] == [("chosen", 1), ("chosen", 2), ("prompt", 0), ("rejected", 1), ("rejected", 2)]
    text, lo, hi = next((x, a, b) for _, p, t, _, x, a, b in got if (p, t) == ("chosen", 1))
    assert text[lo:hi] == "yes<|im_end|>"
    assert all(a is None for _, p, _, r, _, a, _ in got if p == "prompt" or r != "assistant")


def test_odd_conversations(spark):
    say = lambda c, t, r, x: (c, t, r, x, None)
    rows = [say(2, 0, "user", "same"), say(3, 0, "user", "same"), say(3, 0, "user", "same"), say(4, 0, None, None), say(4, None, "user", "late"), say(None, 0, "user", "lost"), say(7, 0, "assistant", "<|im_end|>")]
    got = rendered(spark, rows)
    assert (1, "prompt", 0, "user", "<|im_start|>user\nsame<|im_end|>\n", None, None) in got and len(got) == 5
    assert any(p is None and part == "chosen" for p, part, *_ in got)
    assert any("<| im_end|><|im_end|>" in x for *_, x, _, _ in got)
    assert any(t is None for _, _, t, *_ in got)


def test_siblings_alike_are_opened_once(monkeypatch):
    """Elements of one place, tag and attributes are worked out once, however many there are, and are read as before."""
    opened, entered = [], html_page._entered
    monkeypatch.setattr(html_page, "_entered", lambda *x: opened.append(x[1]) or entered(*x))
    tokens = html_page.read("<ul>" + '<li class="ad"><a href="x">one</a></li><li>two</li>' * 50 + "</ul>")
    assert len(opened) == 4
    assert [(t.text, t.soft, t.linked) for t in tokens if t.text] == [("one", True, 3), ("two", False, 0)] * 50

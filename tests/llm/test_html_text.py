import html
import math
import random
import re
import time

import duckdb
import pytest

from mishear.llm import html_text
from mishear.llm.html_text import content

LONG = "A sentence of some length, with a comma, stands here. Another one follows it, and one more, until the paragraph is long enough."


def test_names_are_only_a_prior():
    for wrapper in ("has-sidebar", "no-sidebar", "elementor-widget", "sidebar", "widget modal"):
        assert content(f'<body><div class="{wrapper}"><article><h1>Head</h1><p>{LONG}</p></article></div>') == ["Head", LONG], wrapper
        assert content(f'<body><p>Menu</p><div class="{wrapper}"><p>{LONG}</p></div>')[-1] == LONG, wrapper
    assert content(f'<article><p class="social-science">{LONG}</p><x-box class="widget"><p>Kept too.</p></x-box></article>') == [LONG, "Kept too."]


def test_named_boilerplate_stays_out():
    comment = '<section id="comments"><article class="comment-body"><p>Great, read. I, agree, fully, too.</p></article></section>'
    for page in (f"<main><p>{LONG}</p>{comment}</main>", f"<article><p>{LONG}</p></article>{comment}", f"<div><p>{LONG}</p></div>{comment}"):
        assert content(page) == [LONG]
    assert content(f'<article><p>{LONG}</p><div class="share-buttons">Share, now.</div><div class="ad">Buy, now.</div></article>') == [LONG]
    assert content('<div class="ad">Buy, now.</div>') == [] and content("<aside><article><p>x</p></article></aside>") == []


def test_links_and_formulas_of_an_article_stay():
    sources = "<ul><li><a href=/1>First source</a><li><a href=/2>Second source</a></ul><table><tr><td><a href=/3>Cell</a></table>"
    page = f"<h2><a href=#x>Setup</a></h2><p>{LONG}</p><p><a href=/r>Read the full report</a></p>{sources}<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p>"
    whole = ["Setup", LONG, "Read the full report", "First source", "Second source", "Cell", "Let x=1."]
    assert content(f"<article>{page}</article>") == whole
    assert {"Setup", LONG, "Read the full report", "Let x=1."} <= set(content(f"<body><div>{page}</div></body>"))


def test_every_article_and_sibling_of_the_content_stays():
    two = f"<{{0}}><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></{{0}}><{{0}}><h2>More</h2><p>A short one, in brief.</p></{{0}}>"
    whole = ["Head", *[LONG] * 4, "More", "A short one, in brief."]
    assert content(two.format("article")) == whole
    assert content(f'<body><div>Home, here</div>{two.format("div")}</body>') == whole


def test_ratios_against_brute_force():
    r = random.Random(6)
    words = lambda n: " ".join(r.choice(["one", "two,", "three.", "four"]) for _ in range(n))
    for _ in range(50):
        parts = [[(r.choice(["p", "h2", "div"]), words(r.randint(1, 40)), words(r.randint(0, 9))) for _ in range(r.randint(1, 6))] for _ in range(r.randint(1, 4))]
        page = "<body>" + "".join(f"<section>{''.join(f'<{t}>{x} <a>{y}</a></{t}>' for t, x, y in own)}</section>" for own in parts)
        # aggregate: all blocks of a tag share their path
        total = {}
        for t, x, y in (b for own in parts for b in own):
            whole = " ".join(f"{x} {y}".split())
            length, marks, n = total.get(t, (0, 0, 0))
            total[t] = (length + len(whole) - len(y), marks + whole.count(",") + whole.count("."), n + 1)
        raw = {t: length / n * (1 + marks) / n for t, (length, marks, n) in total.items()}
        # smooth along a section (each div is a container of its own), fuse
        smooth = {}
        for own in parts:
            inner = [t for t, _, _ in own if t != "div"]
            for k, t in enumerate(inner):
                near = raw[inner[max(0, k - 1)]], raw[inner[min(len(inner) - 1, k + 1)]]
                smooth.setdefault(t, []).append(near[0] / 4 + raw[t] / 2 + near[1] / 4)
            for t, _, _ in own:
                if t == "div":
                    smooth.setdefault(t, []).append(raw[t])
        want = {t: sum(v) / len(v) for t, v in smooth.items()}
        blocks = html_text.scan(page)
        got = {b.element.name: v for p, v in html_text.ratios(blocks).items() for b in blocks if b.element.path == p}
        assert got == pytest.approx(want)
        # threshold, without a root
        scores = {t: math.log2(1 + v) for t, v in want.items()}
        above = {t for t, v in scores.items() if v >= max(scores.values()) - html_text.SPREAD and v > 0}
        assert above <= {b.element.name for b in blocks if b.text in content(page)}


def pages():
    return [h for (h,) in duckdb.connect().execute("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()]


def article(page):
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    blocks = re.split(r"</?(?:h1|p)>", inner)
    text = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks]
    return [t for t in text if t]


def test_articles_of_the_test_pages(monkeypatch):
    every = pages()
    whole = [article(p) for p in every]
    assert [content(p) for p in every] == whole
    # it is the ratios that choose: without them most pages change
    ratios = html_text.ratios
    monkeypatch.setattr(html_text, "ratios", lambda blocks: dict.fromkeys(ratios(blocks), 50.0))
    assert sum(content(p) != w for p, w in zip(every, whole)) > 0.9 * len(every)


def test_pages_without_article():
    plain = [re.sub(r"(</?)article", r"\1div", p) for p in pages()]
    assert sum(content(p) == article(q) for p, q in zip(plain, pages())) > 0.97 * len(plain)
    bare = [re.sub(r"</?article>", "", p) for p in pages()]
    assert sum(content(p) == article(q) for p, q in zip(bare, pages())) > 0.97 * len(bare)


def test_header_of_an_article_and_nested_parts_stay():
    inner = f"<header><h1>Head</h1><p>By me</p></header><div class=body><p>{LONG}</p><p>{LONG}</p><figure><img><figcaption>Seen here</figcaption></figure><section id=market-share><h2>On</h2><div><div><div>Deep</div></div></div></section></div>"
    assert content(f"<body><header>Site</header><article>{inner}</article><aside>See also</aside>") == ["Head", "By me", LONG, LONG, "Seen here", "On", "Deep"]


def test_damaged_pages_take_linear_time():
    assert content("İ" * 200 + f"<p>one, two.</p><script>x</script><p>{LONG}</p><p>{LONG}</p>")[-2:] == [LONG, LONG]
    start = time.process_time()
    for bad in ("<a ", "<a \"'>", "<div>", "<p></div>", "<!x", "<button>", "<x-a hidden>", "<span class=ad>", "</p>", "<![CDATA[", "<script>", "&am", "<li><ul>"):
        content(f"<article><p>{LONG}</p></article>" + bad * (1_000_000 // len(bad)))
    assert time.process_time() - start < 60
    deep = "<div>" * 50_000 + f"<p>{LONG}</p>" + "</p></div>" * 50_000
    assert content(deep) == [LONG]
    assert content(f"<p>{LONG} <a href=") == [LONG] and content("&am<b>p;</b> <i hidden>no <b>no</b></i>yes, it is.") == ["&amp; yes, it is."]


def test_no_rows_and_clashing_columns(spark):
    rows = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(rows).count() == 0
    clash = spark.createDataFrame([(1, "u", f"<p>{LONG}", "other")], "page_id long, url string, html string, text string")
    assert html_text.extract(clash).collect()[0].text == LONG

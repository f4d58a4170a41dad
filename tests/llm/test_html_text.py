import html
import random
import re
import time

from pyspark.sql import functions as F

from spanglass.llm import html_text, queries

SF = "/root/testdata/sf0.01"


def test_query_equals_article_of_each_page(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.QUERIES["op3_html_text"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search("<article>(.*?)</article>", pages[r.page_id], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"<(?:/?p|br|/?h1)>", body)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


P = "<p>" + "The river rose over night and took the bridge with it. " * 3 + "</p>"
T = " ".join(P[3:-4].split())


def test_without_an_article_the_densest_region_is_kept():
    page = f"<html><head><title>t</title></head><body><header>Site</header><div class='menu'><a href=/>Home</a></div><div><a>Other</a><br><a>Links</a></div>{P}<p>So it was.</p>{P}<ul><li><a>x</a></li></ul><div id=footer>(c)</div></body>"
    assert html_text.main_text(page) == f"{T}\n\nSo it was.\n\n{T}"


def test_boilerplate_inside_an_article_goes():
    page = f"<article><h1>A &amp; B&nbsp;&eacute;</h1>{P}<div class='ad box'>Buy</div><aside>See</aside><form><input>Name</form><script>'</article>'</script><p>Short<br>end</p><section id=comments><p>First!</p></section></article><footer>x</footer>"
    assert html_text.main_text(page) == f"A & B é\n\n{T}\n\nShort\n\nend"


def test_broken_and_edge_pages(spark):
    assert html_text.main_text("<article><p>cut <b>of") == "cut of"
    assert html_text.main_text("<article><p>a < b &am</article>") == "a < b &am"
    assert html_text.main_text("<article><!-- x <p>y") == ""
    df = spark.createDataFrame([(1, None), (1, ""), (2, "<article>" + "<p>w</p>" * 50_000 + "</article>")], "text int, html string")
    got = [r.t for r in df.select(html_text.extracted("html").alias("t")).collect()]
    assert got[:2] == ["", ""] and got[2].count("w") == 50_000
    assert df.limit(0).select(html_text.extracted(F.col("html"))).count() == 0


def test_main_text_beside_article_cards_is_kept():
    cards = "".join(f"<article><h3><a href=/{i}>Another story {i}</a></h3><p>Teaser {i}.</p></article>" for i in range(3))
    page = f"<body><div>{P * 3}</div><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul><div>{cards}</div></body>"
    assert html_text.main_text(page) == "\n\n".join([T] * 3)
    assert html_text.main_text(f"<body><div>{P}</div>{cards[: len(cards) // 3]}</body>").startswith(T)
    assert html_text.main_text(f"<body><div>{P}</div><article><p>Own text.</p></article></body>") == f"{T}\n\nOwn text."


def test_every_region_is_kept_on_either_side_of_links():
    links = "<ul>" + "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(4)) + "</ul>"
    assert html_text.main_text(f"<body><div>{P}</div>{links}<div>{P}{P}</div>{links}<p>Bye.</p></body>") == "\n\n".join([T] * 3)


def test_table_pages_without_article_tags_give_the_same_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("plain", F.regexp_replace("html", "<(/?)article>", "<$1div>"))
    got = pages.select(html_text.extracted("html").alias("a"), html_text.extracted("plain").alias("b")).collect()
    assert [r.b for r in got] == [r.a if len(r.a) >= html_text.SURGE else r.b for r in got] and any(r.b for r in got)


def test_named_wrappers_of_the_text_stay_and_named_parts_go():
    for name in ("content has-sidebar", "no-sidebar", "social-enabled", "content social", "page-widget"):
        assert html_text.main_text(f"<body><div class='{name}'><h1>Head</h1><article>{P}</article></div></body>").endswith(T)
        assert html_text.main_text(f"<body><div class='{name}'><p>{P * 2}</div><p>End.</p></body>").startswith(f"{T}\n\n{T}")
        assert html_text.main_text(f"<main><h1>Head</h1><div id='{name}'>{P}</div></main>") == f"Head\n\n{T}"
    for name in ("sidebar", "site-footer", "cookie_notice", "box ad", "main-nav", "related-posts"):
        assert html_text.main_text(f"<body><div>{P * 2}</div><div class='{name}'>{P}</div></body>") == f"{T}\n\n{T}"
        assert html_text.main_text(f"<article>{P}<p>One <span class='{name}'>not <b>this</b></span> two.</article>") == f"{T}\n\nOne two."
    others = f"<article>{P}</article>" * 5
    assert html_text.main_text(f"<body><article>{P}</article><div id=comments>{others}</div></body>") == T


def test_formulas_and_noscript_text_of_an_article_stay():
    assert html_text.main_text("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><noscript><p>A table.</p></noscript></article>") == "So x=2 holds.\n\nA table."


def test_short_pages_quotes_and_links_inside_text():
    assert html_text.main_text("<body><p>Short page text.</p></body>") == "Short page text."
    assert html_text.main_text(f"<article><p class='share'>Shared words.</p>{P}</article>") == f"Shared words.\n\n{T}"
    assert html_text.main_text('<article><p>See <a href="foo>the page</a> and on.</p></article>') == "See the page and on."
    assert html_text.main_text(f"<body><div>{P}<p><a href=/x>A line that is all link</a></p>{P}</div></body>") == f"{T}\n\nA line that is all link\n\n{T}"
    deep = "<div>" * 40_000 + P + "</b>" * 40_000 + "</div>" * 40_000
    assert html_text.main_text(deep) == T


def plain_regions(weights, surge, window):
    """The method in its plainest words: which lines lie between a surge point and the next dive point."""
    n = len(weights)
    sums = [sum(weights[i : i + window]) for i in range(n)]
    kept, i = [], 0
    while i < n:
        if weights[i] > 0:
            j = i
            while j < n and sums[j] > 0:
                j += 1
            if any(s >= surge for s in sums[i:j]):
                kept += [k for k in range(i, j)]
            i = j
        i += 1
    return kept


def test_regions_equal_the_plain_definition():
    rng = random.Random(2)
    for _ in range(500):
        w = [rng.choice([0, 0, 0, 5, 30, 90]) for _ in range(rng.randint(0, 30))]
        assert [i for a, b in html_text.regions(w) for i in range(a, b)] == plain_regions(w, html_text.SURGE, html_text.WINDOW)


def test_tags_that_never_close_take_linear_time():
    for part in ("<a b ", '<a "', "<script x ", '<a ">"', "</script", "<!x ", "<p class='", "< ", "<svg><!-- "):
        page = f"<p>{T}</p>" + part * (1_000_000 // len(part))
        began = time.process_time()
        assert html_text.main_text(page).startswith(T)
        html_text.main_text(page + ">")
        assert time.process_time() - began < 12, part
    began = time.process_time()
    html_text.main_text("<a b " * 200_000)
    assert time.process_time() - began < 1


def test_self_closed_icons_and_unclosed_comments():
    assert html_text.main_text(f"<article><p>One <svg class='i'/> two.</p>{P}<iframe src=x/>{P}</article>") == f"One two.\n\n{T}\n\n{T}"
    assert html_text.main_text(f"<article>{P}<script src='x'/>not this</script>{P}</article>") == f"{T}\n\n{T}"
    assert html_text.main_text(f"<article>{P}<!-- never closed <p>x</p>") == T == html_text.main_text(f"<article>{P}<!-- never closed")


NAMES = ["user-comments", "ad-slot", "cookie-law-info", "comment-list-wrapper", "gdpr_banner_v2", "newsletter-signup", "popup-overlay", "breadcrumbs-trail", "sponsored-content-unit"]


def test_names_that_say_what_a_box_holds():
    for name in NAMES:
        assert html_text.main_text(f"<body><div>{P * 2}</div><div class='{name}'>{P}</div></body>") == f"{T}\n\n{T}", name
        assert html_text.main_text(f"<article>{P}<div id='{name}'>{P}</div>{P}</article>") == f"{T}\n\n{T}", name
    for name in ("has-comments", "no-ads", "with-cookie-notice", "share-price-history", "menu-of-the-day", "widget-factory-report"):
        assert html_text.main_text(f"<body><div class='{name}'>{P * 2}</div></body>") == f"{T}\n\n{T}"
        assert html_text.main_text(f"<article>{P * 2}<div class='{name}'>{P}</div></article>") == "\n\n".join([T] * 3)
    links = "".join(f"<a href=/{i}>Another page {i}</a> " for i in range(9))
    assert html_text.main_text(f"<article>{P * 2}<div class='menu-of-the-day'>Go {links}</div></article>") == f"{T}\n\n{T}"
    assert html_text.main_text(f"<body><article>{P}</article><div class='user-comments'>{P * 5}</div></body>") == T


def test_pages_put_together_from_known_parts():
    """Without <article>: what was put in as main text, and nothing else, comes out."""
    rng = random.Random(12)
    for _ in range(150):
        words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
        links = lambda: "".join(f"<li><a href='/{i}'>{words(2)}</a></li>" for i in range(rng.randint(4, 8)))
        blocks = [words(rng.randint(15, 60)) for _ in range(rng.randint(3, 8))]
        body = []
        for b in blocks:
            cut = b.split(" ")
            at = rng.randrange(len(cut))
            body.append("<p>" + " ".join([*cut[:at], f"<b>{cut[at]}</b>", *cut[at + 1 :]]) + rng.choice(["", "\n ", "<svg class=i/>"]) + "</p>")
            if rng.random() < 0.3:
                body.append(rng.choice([f"<div class='{rng.choice(NAMES)}'>{words(12)}</div>", f"<aside>{words(9)}</aside>", "<script>if (a < b) x('</p>')</script>", f"<form>{words(5)}</form>"]))
        page = f"<html><head><title>{words(3)}</title></head><body><header>{words(4)}</header><nav><ul>{links()}</ul></nav><div class='{rng.choice(['content', 'has-sidebar', 'x'])}'>{''.join(body)}</div><div class='sidebar'><ul>{links()}</ul></div><div class='user-comments'>{words(25)}</div><footer>{words(9)}</footer></body></html>"
        assert html_text.main_text(page) == "\n\n".join(blocks)

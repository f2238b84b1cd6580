"""URL filter and HTML extraction."""

import re
from collections import Counter

from pyspark.sql import functions as F

from tabvet.llm import html_text as H
from tabvet.llm import url_filter as U

URLS = [
    "https://A.example.org/en/1234?x#y", "http://example.org/es/9", "http://example.orgx/es/9", "https://x.com/fr/1", "https://x.com/de/", "https://xcom/de/",
    "ftp://org", "org/", None, "no scheme", "http://h.net?q=/de/", "http://a://b/c", "://x.org/p", "http://x.org/es", "HTTP://X.COM/DE/1", "http://x.com/de/1",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    path = tail[:stop]
    fits = [h + p for h, p, _ in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def pages(spark, urls):
    rows = [(i, u, "<p>x", u, "host") for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, verdict string, host string")


def test_rules_equal_brute_force(spark):
    verdict = {h + p: v for h, p, v in U.RULES}
    got = {r.page_id: r for r in U.url_filter(pages(spark, [*URLS, URLS[0]])).collect()}
    assert len(got) == len(URLS) + 1
    for i, u in enumerate(URLS):
        host, path, rule = brute(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict.get(rule, got[i].verdict) and got[i].verdict in ("allow", "block")
    assert U.url_filter(pages(spark, URLS).limit(0)).count() == 0


def test_templates_learn_from_labelled_branches(spark):
    """A host whose labelled urls are all blocked blocks its other urls; a mixed host does not."""
    bad = [f"http://bad.com/de/{i}" for i in range(60)] + ["http://bad.com/shop/a1", "http://bad.com/shop/b2"]
    fine = [f"http://fine.com/fr/{i}" for i in range(60)] + ["http://fine.com/shop/a1"]
    got = {r.path + r.host: r for r in U.url_filter(pages(spark, bad + fine)).collect()}
    assert got["/shop/a1bad.com"].verdict == "block" and got["/shop/a1fine.com"].verdict == "allow"
    assert got["/de/3bad.com"].template == got["/de/4bad.com"].template


def judged(spark, rows, **options):
    """{(host, path): row} of the tree over (host, path, label) rows."""
    df = spark.createDataFrame(rows, "host string, path string, label int").select("host", U.lexical_template(F.col("path")).alias("segments"), "label")
    return {(r.host, "/" + "/".join(r.segments)): r for r in U.template_tree(df, **options).collect()}


def test_merged_branches_pool_their_evidence(spark):
    names = ["".join(chr(97 + int(c)) for c in f"{i:03d}") for i in range(300)]
    rows = [("h.com", f"/{n}/spam", 1) for n in names] + [("h.com", f"/{n}/ham", 0) for n in names] + [("h.com", "/new/spam", None)]
    got = judged(spark, rows)
    assert got["h.com", "/new/spam"].template == "/*/spam" and got["h.com", "/new/spam"].purity > 0.9
    assert got["h.com", f"/{names[0]}/ham"].purity < 0.1


def test_alike_siblings_meet_and_deep_paths_are_told_apart(spark):
    rows = [("h.com", f"/{a}/x", 1) for a in ("one", "two") for _ in range(40)] + [("h.com", f"/{a}/x", 0) for a in ("six", "ten") for _ in range(40)]
    rows += [("g.com", f"/a/b/c/d/e/{x}", y) for x, y in (("bad", 1), ("good", 0)) for _ in range(40)] + [("g.com", "/a/b/c/d/e/bad", None)]
    got = judged(spark, rows)
    assert got["h.com", "/one/x"].template == got["h.com", "/two/x"].template != got["h.com", "/six/x"].template == got["h.com", "/ten/x"].template
    assert got["g.com", "/a/b/c/d/e/bad"].purity > 0.9 and got["g.com", "/a/b/c/d/e/good"].purity < 0.1


def test_hosts_without_labels_back_off_to_pooled_templates(spark):
    """A template that is blocked on all labelled hosts is blocked on a host without labels; other branches are not."""
    bad = [f"http://h{i}.com/de/{i}" for i in range(60)] + [f"http://h{i}.com/fr/{i}" for i in range(60)]
    new = ["http://casino.win/de/1", "http://casino.win/fr/2", "http://casino.win/shop/x"]
    got = {(r.host, r.path): r for r in U.judged(pages(spark, bad + new)).collect()}
    assert got["casino.win", "/de/1"].verdict == "block" and got["casino.win", "/de/1"].level == "pooled"
    assert got["casino.win", "/fr/2"].verdict == "allow" and got["casino.win", "/fr/2"].level == "pooled"
    assert got["casino.win", "/shop/x"].level == "prior" and got["h3.com", "/de/3"].level == "rule"


ARTICLE = " ".join(["the river was calm and it ran to the sea with a low sound of stones"] * 4)


def test_main_text_of_typical_pages():
    page = f"""<html><head><title>t</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head><body>
    <header>Site name</header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- <p>gone</p> --><div class="cookie-notice">We use cookies</div>
    <article><h1>Title &amp; more</h1><p>{ARTICLE}<br>second   line<p>{ARTICLE} &lt;b&gt;</article>
    <form><p>your mail</p><input></form><div id="comments"><p>{ARTICLE} says me</p></div><aside>{ARTICLE}</aside><footer>&copy; all</footer>"""
    assert H.main_text(page).split("\n") == ["Title & more", ARTICLE, "second line", ARTICLE + " <b>"]


def test_page_without_article_element():
    page = f"<body><div><a href=1>one</a> <a href=2>two</a></div><div>{ARTICLE}</div><div>short one</div><div>{ARTICLE}</div><div><a href=1>next</a></div>"
    assert H.main_text(page).split("\n") == [ARTICLE, "short one", ARTICLE]


def test_broken_pages_do_not_crash(spark):
    odd = [None, "", "plain", "<", "<p", "<p>a<script>x", "<!-- open", "</div></p>x", "<a href='>x", "&#xZZ; &amp &notanentity;", "<p>" * 3000 + "deep", "<div>" * 3000 + "deep", f"<article><p>{ARTICLE * 500}"]
    rows = [(i, None, h, 1) for i, h in enumerate(odd)] + [(None, "u", "<p>plain", 1)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[0] == by[1] == "" and by[2] == "plain" and by[5] == "a" and by[10] == "deep" == by[11] and len(by[12]) > 30_000


def test_extraction_equals_the_articles_of_the_pages(spark, sf):
    import html

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in re.split(r"</?(?:h1|p|br)>", inside))
        want = "\n".join(b for b in blocks if b)
        a, b = Counter(want.split()), Counter(got[r.page_id].split())
        assert sum((a - b).values()) + sum((b - a).values()) <= 0.02 * sum(a.values())


def test_wrappers_and_attribute_values_do_not_hide_the_article():
    inside = [f"<p>{ARTICLE}</p>", f"<article><p>{ARTICLE}</p></article>", f"<div class='post'><p>{ARTICLE}</p></div>"]
    wrappers = [
        'style="overflow:hidden"', 'data-hidden="false"', 'title="a hidden gem"', "title='class=\"menu\" hidden'", 'data-class="menu"',
        'class="has-sidebar"', 'id="no-sidebar"', 'class="page header-fixed"', "class=no-sidebar",
    ]
    for text in inside:
        for attributes in wrappers:
            page = f"<body><div {attributes}><div class='menu'>Home and more</div>{text}<div class='comments'><p>{ARTICLE[:150]}</p></div></div>"
            assert H.main_text(page) == ARTICLE, (attributes, text)
    for attributes in ("hidden", "HIDDEN=''", "class=x hidden", 'aria-hidden="true"', 'hidden="until-found"'):
        assert H.main_text(f"<body><p>{ARTICLE}</p><div {attributes}><p>{ARTICLE} unseen</p></div>") == ARTICLE, attributes
        assert H.main_text(f"<body><article {attributes}><p>{ARTICLE}</p></article>") == "", attributes


def test_unfinished_tags_take_linear_time():
    import time

    start = time.time()
    megabyte = ["<a " * 350_000, '<a href="x ' * 95_000, "<a '\"><b \"'>" * 80_000, '<a "><a " ' * 100_000 + '"', "<div><a " * 120_000, "<!--" * 250_000, "<script>" * 130_000, "</" * 500_000]
    for tail in megabyte:
        assert H.main_text(f"<article><p>{ARTICLE}</p></article>" + tail).startswith(ARTICLE), tail[:20]
    assert time.time() - start < 2 * len(megabyte)
    assert H.main_text(f'<b title="x>y</b><p>{ARTICLE}</p>') == "y\n" + ARTICLE  # an open quote ends with its tag


def test_header_of_the_article_and_pages_inside_a_form():
    head = "<header><h1>Its title</h1><p>by someone</p></header>"
    page = f"<body><header><h1>Site</h1></header><article>{head}<p>{ARTICLE}</p></article>"
    assert H.main_text(page) == "Its title\n" + ARTICLE
    form = f"<body><form action=x><nav>menu</nav><div><p>{ARTICLE}</p><form class=search><p>find it</p></form></div></form>"
    assert H.main_text(form).split("\n")[0] == ARTICLE and "menu" not in H.main_text(form)
    assert H.main_text(f"<p>{ARTICLE}</p><form><p>your mail</p></form>") == ARTICLE

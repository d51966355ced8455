import html as H
import random
import re
from collections import Counter

import pyarrow as pa

from tessera.llm import html as T


def rows_of(spark, pages, **limits):
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in sorted(T.extract(df, ["page_id"], **limits).collect(), key=lambda r: r.page_id)]


def test_articles(spark, sf_dir):
    """The supplied pages hold one flat article each: a plain expression gives its text."""
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages = {r.page_id: r.html for r in df.collect()}
    got = T.extract(df, ["page_id", "url"]).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"(?s)<article>(.*?)</article>", pages[r.page_id])[1]
        want = " ".join(H.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:h1|p|br)>", " ", article))).split())
        assert r.text == want and r.n_chars == len(want)


def test_parts_left_out(spark):
    page = """<html><head><title>t</title><style>p{}</style></head><body><header>Top</header><ul class="main-menu"><li>Home</ul>
    <main><article><h1>Head&eacute;r  one</h1><p>First <b>bo</b>ld &lt;x&gt; 1 < 2<p>Second<br>line<!-- no --><script>var x = "</p><p>no";</script>
    <div class="cookie-notice">Cookies</div><aside>side</aside><form><label>Mail</label></form><div id="comments"><p>great post</p></div>
    <ul><li>one<li>two</ul></article></main><div class="ad">Buy</div><footer>foot</footer>"""
    assert rows_of(spark, [("http://a.b/", page)]) == ["Headér one First bold <x> 1 < 2 Second line one two"]


def test_template_of_a_host(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(30)) + f" {k}" for k in range(12)]
    pages = [("http://h.x/%d" % k, f"<body><div>Welcome to our site</div><div><p>{t}</p><i>x{k}</i></div><div>All rights reserved</div><i>{k}y</i></body>") for k, t in enumerate(texts)]
    assert rows_of(spark, pages) == [f"{t} x{k}" for k, t in enumerate(texts)]
    # alone on its host, the same page keeps all
    assert rows_of(spark, pages[:1]) == [f"Welcome to our site {texts[0]} x0 All rights reserved 0y"]
    # no element holds most of the text: all slots, less template texts
    flat = [("http://h.x/%d" % k, f"<body><p>Welcome to our site</p><p>{t}</p><p>All rights reserved</p><p>{t[::-1]}</p></body>") for k, t in enumerate(texts)]
    assert rows_of(spark, flat) == [f"{t} {t[::-1]}" for t in texts]
    # an article that all pages of a host repeat stays
    same = [("http://h.x/%d" % k, "<body><article><p>same text</p></article><div>All rights reserved</div></body>") for k in range(9)]
    assert rows_of(spark, same) == ["same text"] * 9


def stripped(page):
    """The page without what names its parts: semantic elements are divs, and class, id and role are gone."""
    page = re.sub(r"<(/?)(?:article|main|nav|header|footer|aside|section|form)\b", r"<\1div", page)
    return re.sub(r"\s(?:class|id|role)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*)", "", page)


def test_the_template_finds_the_article(spark, sf_dir):
    """Without any name of a part, what the classes' slots hold tells the article; without templates it is lost."""
    df = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/pages.parquet")
    named = T.extract(df, ["page_id", "url"]).collect()
    want, hosts = {r.page_id: r.text for r in named}, Counter(r.url.split("/")[2] for r in named)
    bare = spark.createDataFrame([(r.page_id, r.url, stripped(r.html)) for r in df.collect()], "page_id long, url string, html string")
    got = T.extract(bare, ["page_id", "url"]).collect()
    right, plenty = [r.text == want[r.page_id] for r in got if hosts[r.url.split("/")[2]] >= 4], sum(n for n in hosts.values() if n >= 4)
    assert len(right) == plenty > 100 and sum(right) > 0.95 * plenty
    without = T.extract(bare, ["page_id"], min_pages=10**6).collect()
    assert sum(r.text == want[r.page_id] for r in without) < 0.05 * len(want)


def brute_classes(pages, min_pages, support, min_tokens):
    """Sets of tokens that occur equally often in the same pages of a host."""
    vectors, top, out = {}, set(), set()
    for k, (host, page) in enumerate(pages):
        got = next(T.tokens_of(iter([pa.RecordBatch.from_pydict({"host": [host], "html": pa.array([page], pa.string())})])))
        for t in got.column("tokens").to_pylist()[0]:
            vectors.setdefault((host, t["token"]), {})[k] = t["n"]
            top |= {t["token"]} if t["part"] == 1 else set()
    groups = {}
    for (host, token), v in vectors.items():
        groups.setdefault((host, tuple(sorted(v.items()))), set()).add(token)
    total = Counter(h for h, _ in pages)
    for (host, v), tokens in groups.items():
        valid = tokens if len(tokens) >= min_tokens else tokens & top
        if len(v) >= min_pages and len(v) >= support * total[host] and valid:
            out.add((host, frozenset(valid)))
    return out


def test_classes(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet").select(T.host_column("url").alias("host"), "html")
    more = spark.createDataFrame([("h", f"<div class=a>{'<p>x</p>' * (k % 3)}same<b>{k}</b></div><hr><p>{k // 2}") for k in range(9)], "host string, html string")
    df = df.union(more).repartition(3)
    for limits in ((3, 0.8, 2), (2, 0.3, 1)):
        found = {}
        for r in T.classes(df, *limits).collect():
            found.setdefault((r.host, r["class"], r.pages), set()).add(r.token)
        assert {(h, frozenset(t)) for (h, _, _), t in found.items()} == brute_classes([(r.host, r.html) for r in df.collect()], *limits)


def test_nesting():
    """Only elements with an unbroken line of template elements to the root are the template's."""
    token = lambda t, up, holds=1.0, part=2, text=False: {"token": t, "up": up, "holds": holds, "part": part, "text": text, "place": t}
    tokens = [token(3, 2, 9.0), token(1, 0, 10.0, 1), token(2, 1, 9.5), token(7, 6), token(9, 2, 0, 0, True)]
    assert set(T.nested(tokens)) == {1, 2, 3}
    assert T.article(T.nested(tokens)) == 3
    assert T.article(T.nested([*tokens[1:], token(3, 2, 9.0, 0)])) == 2
    assert T.article(T.nested([token(1, 0, 10.0, 1), token(2, 1, 5.0), token(3, 1, 5.0)])) is None


def test_names_of_parts(spark):
    """Only names made of hints name a part; the title stays though it is a header's."""
    page = """<body><div class="comments-page"><article><header><h1>Title</h1></header>Let <math><mi>x</mi></math> be
    <div class="social-science">science</div><div class="share-buttons">share</div><div id="adHocWork">work</div><p class="ad">buy</p></article></div>
    <div class="comments"><article class="comment">nice</article></div></body>"""
    assert rows_of(spark, [("http://a.b/", page.replace("comments-page", "page"))]) == ["Title Let x be science work"]
    assert rows_of(spark, [("http://a.b/%d" % k, page.replace("science</div>", f"science {'long ' * 20}{k}</div>")) for k in range(4)]) == [f"Title Let x be science {'long ' * 20}{k} work" for k in range(4)]


def test_articles_outside_the_template(spark):
    """Where a host's pages have their article in one place, articles elsewhere (teasers, replies) are no main text."""
    pages = [("http://h.x/%d" % k, f"<body><div class='c'><article><p>text {k}</p></article></div></body>") for k in range(8)]
    teaser = "<body><div class='c'><article><p>text</p></article></div><section><article>teaser</article></section></body>"
    alone = "<body><section><article>only</article></section><p>not</p></body>"
    assert rows_of(spark, [*pages, ("http://h.x/a", teaser), ("http://h.x/b", alone)])[8:] == ["text", "only"]


def words_of(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


PARTS = (("<section class=comments>", "</section>"), ("<div class='replies'>", "</div>"), ("<div id=comment-list>", "</div>"), ("<aside>", "</aside>"), ("<div class=sidebar-widget><div><div>", "</div></div></div>"), ("<div class='advert'><section>", "</section></div>"))


def test_comments_are_never_the_article(spark):
    """Threads that hold far more than the article, named by class, id or element, on hosts of one to twenty pages."""
    rng, pages, want = random.Random(4), [], []
    for n in (1, 2, 3, 6, 20):
        for j, (begin, end) in enumerate(PARTS):
            for k in range(n):
                own, thread = words_of(rng, 13), "".join(f"<div class=c><p>{words_of(rng, 25)}</p></div>" for _ in range(40))
                pages.append((f"http://h{n}.{j}/{k}", f"<body><div class=menu>Home News</div><div class=post><p>{own}</p></div>{begin}{thread}{end}</body>"))
                want.append(own)
    assert rows_of(spark, pages) == want


def test_no_slot_is_lost(spark):
    """An article in two or three uneven blocks, side by side or nested, on hosts with a template."""
    rng, pages, want = random.Random(5), [], []
    for j, sizes in enumerate(((80, 20), (60, 39, 1), (20, 80), (30, 30, 34), (9, 9, 82))):
        for k in range(6):
            parts = [words_of(rng, x) for x in sizes]
            inner = "".join(f"<div><p>{x}</p></div>" for x in parts)
            page = f"<body><div>Welcome to this site</div><div><a href='/x'>Home {k}</a></div><div><div>{inner}</div></div><div>All rights reserved</div></body>"
            pages += [(f"http://flat{j}/{k}", page), (f"http://deep{j}/{k}", page.replace("<div><p>", "<div><div><div><p>", 1).replace("</p></div>", "</p></div></div></div>", 1))]
            want += [" ".join(parts)] * 2
    assert rows_of(spark, pages) == want


def test_two_layouts_on_a_host(spark):
    rng = random.Random(6)
    pages, want = [], []
    for k in range(20):
        a, b = words_of(rng, 60), words_of(rng, 20)
        page = f"<body><div>Welcome</div><div><div><p>{a}</p></div><div><p>{b}</p></div></div><div>Imprint</div></body>" if k % 2 else f"<body><div>Welcome</div><section><p>{a}</p><p>{b}</p></section><div>Imprint</div></body>"
        pages.append(("http://h.x/%d" % k, page))
        want.append(f"{a} {b}")
    met = lost = more = 0
    for text, own in zip(rows_of(spark, pages), want):
        got, own = Counter(text.split()), Counter(own.split())
        met, lost, more = met + sum((got & own).values()), lost + sum((own - got).values()), more + sum((got - own).values())
    assert met / (met + lost) > 0.95 and met / (met + more) > 0.95


def test_a_form_around_the_page(spark):
    pages = [("http://h.x/%d" % k, f"<body><form id=aspnet><div>Menu</div><div><h1>Title {k}</h1><p>text {k} of the page</p></div><div>Imprint</div></form></body>") for k in range(5)]
    assert rows_of(spark, pages) == [f"Title {k} text {k} of the page" for k in range(5)]


def test_odd(spark):
    odd = [(None, None), ("", ""), ("x", "plain"), ("http://a/", "<"), ("http://a/", "<p"), ("http://a/", "<p title=\"x>y"), ("http://a/", "</b></p></div>a<b>c"), ("http://a/", "<script>no"), ("http://a/", "a&nbsp;&amp; b&#x41;&bogus;"), ("http://a/", "<p>" * 5000 + "deep" + "<div>" * 3000 + "er")]
    assert rows_of(spark, odd) == ["", "", "plain", "<", "", "y", "ac", "", "a & bA&bogus;", "deep er"]
    long = [("http://l/", "<body>" + "<p>w<b>x</b>" * 20_000 + "<i>" * 3000 + "</u>" * 3000)] * 2  # repeated rows, long and deep
    assert rows_of(spark, long) == [" ".join(["wx"] * 20_000)] * 2
    none = spark.createDataFrame([], "page_id long, url string, html string, text int")
    assert T.extract(none, ["page_id", "text"]).columns == ["page_id", "text", "n_chars"] and T.extract(none, ["page_id"]).count() == 0

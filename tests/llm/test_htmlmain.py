import html
import re
from collections import Counter

import numpy as np
import pytest

from waveloom.llm import htmlmain
from waveloom.llm.htmlmain import blocks_text, deduce_templates, judge, main_text, signed, tokens


def text_of(page):
    return blocks_text(tokens(page))


def brute(page):
    """For pages of the test tables: what stands in the article, cut at its h1 and p tags."""
    article = re.search(r"<article>(.*)</article>", page or "", re.S)
    parts = re.split(r"</?(?:h1|p)>", article[1]) if article else []
    plain = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " ")))).strip() for p in parts)
    return "\n\n".join(p for p in plain if p)


def test_tables_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: (r.url, brute(r.html)) for r in pages.collect()}
    got = main_text(pages).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)


#: Names that tell nothing.
SCRAMBLED = {"<article>": "<div class='q7'>", "</article>": "</div>", "<nav>": "<div>", "</nav>": "</div>", "<footer>": "<div class='z2'>", "</footer>": "</div>", 'class="ad"': 'class="w"'}


def host_of(url):
    return url.split("/")[2]


def test_slots_of_the_template_decide(spark, monkeypatch):
    """Where no name tells the article, it is found by the template of its host, and only by that."""
    rows = []
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        page = r.html
        for name, other in SCRAMBLED.items():
            page = page.replace(name, other)
        rows.append((r.page_id, r.url, page, brute(r.html)))
    count = Counter(host_of(r[1]) for r in rows)
    want = {r[0]: r[3] for r in rows if count[host_of(r[1])] >= htmlmain.LEAST_PAGES}
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in main_text(df).collect()}
    right = [got[i] == text for i, text in want.items()]
    print(f"{sum(right)} of {len(right)} pages")
    assert len(right) > 120 and np.mean(right) > 0.95
    monkeypatch.setattr(htmlmain, "LEAST_PAGES", 10**9)
    assert not any(r.text == want[r.page_id] for r in main_text(df).collect() if r.page_id in want)


def test_template_in_an_article_goes(spark):
    """Boilerplate under neutral names inside an article; two layouts of one host; a broken page."""
    rows = [(i, "http://h.example/x", f"<body><article><h1>T{i}</h1><div class='k'>Read this next</div><p>own text {i} of some length</p></article></body>") for i in range(60)]
    rows += [(i, "http://h.example/y", f"<body><div class='m'><h2>U{i}</h2><p>first {i}, and more words</p><p>second {i}</p></div><div class='n'><p>Hear more</p><b>{i}</b></div></body>") for i in range(100, 130)]
    rows[7] = (7, "http://h.example/x", "<body><div class='k'>Read this next</div><article><p>own</p></article></body>")
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert all(got[i] == f"T{i}\n\nown text {i} of some length" for i in range(60) if i != 7)
    assert all(got[i] == f"U{i}\n\nfirst {i}, and more words\n\nsecond {i}" for i in range(100, 130))
    assert got[7] == "own"


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""),
        ("plain & simple", "plain & simple"),
        ("<p>a<p>b <b>c</b>\n d<br>e", "a\n\nb c d e"),
        ("<body><nav>menu</nav><header>top</header><main><h1>T</h1><p>x &lt;y&gt; &eacute;&#x41;</p><aside>s</aside><form>f<p>g</form></main><footer>z</footer>", "T\n\nx <y> éA"),
        ("<article><header><h2>H</h2></header><p>a</p><section class='comments'><article><p>no</p></article></section><footer>f</footer></article>", "H\n\na"),
        ("<div id='cookie-notice'>ok?</div><div class='post-body'>Hello<div>in</div>there</div><div class='sidebar'>x</div>", "Hello\n\nin\n\nthere"),
        ("<script>if(a<b){'</p>'}</script><style>p{}</style><p>t<!-- <p>c --> u</p><noscript>n</noscript>", "t u"),
        ("<p title='a>b' class=it's>x</p> 1 < 2 <", "x\n\n1 < 2 <"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "a\n\nb\n\nc"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
        ("<p hidden>x</p><p style='display: none'>y</p><p>z</p>", "z"),
        ("<body class='has-sidebar'><div class='article-header'>t</div><p>u</p></body>", "t\n\nu"),
        ("<article></article><p>only here</p>", "only here"),
        ("</p></div>a</b>b<p", "ab"),
        ("<!-- open", ""),
    ],
)
def test_markup(page, text):
    assert text_of(page) == text


def template_page(i, host="h.example"):
    body = "".join(f"<div class='x'>text {i} {j}</div>" for j in range(1 + i % 4))
    return (i, f"http://{host}/{i}", f"<div><span>Site name</span></div><div>Home</div>{body}<div>All rights reserved</div><div>same words</div>")


def test_template_strings_go_without_an_article(spark):
    rows = [template_page(i) for i in range(20)] + [template_page(i + 50, f"one{i}.example") for i in range(3)] + [(90, None, None), (91, "x", "<p>a</p>"), (91, "x", "<p>b</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "'c' as template", "2 as page")
    got = {}
    for r in main_text(df.repartition(3)).collect():
        got.setdefault(r.page_id, []).append(r.text)
    for i in range(20):
        assert got[i] == ["\n\n".join(f"text {i} {j}" for j in range(1 + i % 4))]
    assert got[51] == ["Site name\n\nHome\n\n" + "\n\n".join(f"text 51 {j}" for j in range(4)) + "\n\nAll rights reserved\n\nsame words"]
    assert got[90] == [""] and sorted(got[91]) == ["a", "b"]
    assert main_text(df.where("false")).count() == 0


def test_classes_must_keep_order_and_nest(spark):
    crossing, turns = judge([(1, 10), (2, 20), (1, 11), (2, 21)], {1: 2, 2: 2})
    assert crossing and turns[1, 10] == 0
    assert judge([(1, 10), (2, 20), (2, 21), (2, 20), (2, 21), (1, 11)], {1: 2, 2: 2})[0] == set()
    assert judge([(1, 10), (1, 11), (1, 11), (1, 10)], {1: 2})[1][1, 10] == -1
    # two strings that change places on some pages are no template
    pages = [(str(i), "h", f"<div>one</div><div>two</div><p>x</p><i>{i}</i>" if i % 2 else f"<div>two</div><div>one</div><p>x</p><i>{i}</i>") for i in range(8)]
    found = deduce_templates(spark.createDataFrame(pages, "page string, host string, html string")).collect()
    strings = {t[1] for t in tokens(pages[0][2]) if t[0] == 2}
    held = {x for r in found for x in np.frombuffer(r.strings, ">i8").tolist()}
    assert not {signed(s) for s in strings} & held


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "layout-with-sidebar", "no-sidebar", "comments-open", "social-share-enabled", "sidebar-right"])
def test_wrappers_named_after_a_layout_keep_their_article(name):
    for inner in ("article", "main"):
        assert text_of(f"<div class='{name}'><{inner}><h1>T</h1><p>a</p></{inner}><div class='sidebar'>s</div></div>") == "T\n\na"
    if name != "sidebar-right":
        assert text_of(f"<div class='{name}'><p>a</p><aside>s</aside></div>") == "a"


@pytest.mark.parametrize("page", ["<div class='comment-list'><article>c</article></div>", "<div class='related-posts'><article>c</article></div>", "<div class='post-sidebar'><p>s</p></div>", "<aside class='no-sidebar'><main>s</main></aside>", "<div hidden><main>s</main></div>", "<div class='cookie-notice-wrapper'>ok?</div>"])
def test_other_matter_stays_out(page):
    assert text_of(page + "<p>a</p>") == "a"


def by_id(df):
    return {r.page_id: r.text for r in main_text(df).collect()}


SCHEMA = "page_id long, url string, html string"


def test_paragraphs_beside_the_body_stay(spark):
    """A lead and an end around the element that holds most of the article."""
    lines = [f"Menu {k}" for k in range(3)]
    menu = "".join(f"<div class='m'>{m}</div>" for m in lines)
    body = lambda i: "".join(f"<p>paragraph {j} of page {i}, long enough to be most of the text by far</p>" for j in range(4 + i % 3))
    article = lambda i, name: f"<{name} class='w'><p class='lead'>lead {i}</p><div class='body'>{body(i)}</div><p class='end'>end {i}</p></{name}>"
    want = lambda i: "\n\n".join([f"lead {i}", *(f"paragraph {j} of page {i}, long enough to be most of the text by far" for j in range(4 + i % 3)), f"end {i}"])
    for name in ("article", "section"):
        pages = [(i, "http://h.example/a", f"<body>{menu}{article(i, name)}<div class='f'>Imprint</div></body>") for i in range(12)]
        got = by_id(spark.createDataFrame(pages, SCHEMA))
        assert got == {i: want(i) for i in range(12)}
    # with changing strings around the article only its name tells how far it goes
    pages = [(i, "http://h.example/a", f"<body>{menu}<div class='c'>visitor {i * 7}</div>{article(i, 'article')}</body>") for i in range(12)]
    assert by_id(spark.createDataFrame(pages, SCHEMA)) == {i: want(i) for i in range(12)}


def test_copies_of_an_article_are_no_template(spark):
    page = lambda n, i, extra="": f"<body><div class='m'>Menu</div><article id='post-{n}'><h1>Title {i}</h1><p>one {i}</p><blockquote>said {i}</blockquote>{extra}</article><div>Imprint</div></body>"
    rows = [(n, f"http://h.example/{n}", page(n, n)) for n in range(19)] + [(n, f"http://h.example/{n}", page(n, 99, "<pre>only here</pre>")) for n in range(19, 24)]
    # the same article with another menu: near copies
    near = [(n, f"http://h.example/{n}", page(n, 77, "<h4>rare</h4>").replace("Menu", f"Menu {n}")) for n in range(30, 36)]
    want = {n: f"Title {n}\n\none {n}\n\nsaid {n}" for n in range(19)} | {n: "Title 99\n\none 99\n\nsaid 99\n\nonly here" for n in range(19, 24)}
    assert by_id(spark.createDataFrame(rows, SCHEMA).repartition(3)) == want
    assert by_id(spark.createDataFrame(rows + near, SCHEMA).repartition(3)) == want | {n: "Title 77\n\none 77\n\nsaid 77\n\nrare" for n in range(30, 36)}
    # a host of one page under many addresses has no template
    same = [(n, f"http://h.example/{n}", page(1, 1)) for n in range(9)]
    assert set(by_id(spark.createDataFrame(same, SCHEMA)).values()) == {"Title 1\n\none 1\n\nsaid 1"}


def test_no_block_is_lost_against_containers(spark):
    """Nothing that the page's own article holds is dropped on the test tables."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in pages.join(main_text(pages).select("page_id", "text"), "page_id").collect():
        assert not Counter(text_of(r.html or "").split("\n\n")) - Counter(r.text.split("\n\n"))

import pytest

from vigilflow.llm import pages as p

CASES = [
    ("", ""),
    ("plain &amp; text", "plain & text"),
    ("<body><div class='menu'>m</div><div><h1>T</h1>a &lt;b&gt;  c<br>d<p>x<div class=comments>no</div><p>y</div><footer>f</footer>", "T\na <b> c d\nx\ny"),
    ("<nav>n</nav><article><h1>H</h1><p><b>one.<br><p>two</p><div class='ad'>buy</div><p>thr", "H\none.\ntwo\nthr"),
    ("<main><article>a<ul><li>1<li>2</ul></article><aside>s</aside></main>", "a\n1\n2"),
    ("<article><header><h1>t</h1></header><p>a</p><form><input>q</form></article><article class='comment'>z</article>", "t\na"),
    ("<p>a<p>b <!-- c <p> --> <b>d</b>e</p><script>var x='<p>'</script><style>p{}</style>f<p", "a\nb de\nf"),
    ("<title>no</title><p title='a > b'>x &#233; &eacute; &nosuch; 1 < 2</p>", "x é é &nosuch; 1 < 2"),
    ("<body class='has-sidebar'><div id='sidebar'>s</div><div class='cookie-notice'>c</div><div style='display: none'>h</div><p hidden>h</p><p>x</p>", "x"),
    ("<table><tr><td>a<td>b<tr><td>c</table></p></div></zz>d", "a\nb\nc\nd"),
    ("<div class='share-price'>Shares rose.</div><div class='content related-topics'>Topics.</div><div class='share-box-2'>Share</div>", "Shares rose.\nTopics."),
    ("<article><p>a<section class='ad-hoc'><p>b</section><div id='menu-reform'>c</div><div class='site_menu'>d</div><div id='c-ad__wrap'>e</div></article>", "a\nb\nc"),
    ("<div>" * 3000 + "deep" + "</div>" * 10, "deep"),
]


@pytest.mark.parametrize("html, want", CASES)
def test_one_page(html, want):
    assert p.main_text(p.parse(html)) == want


def page(k: int, host="a.example", body=""):
    return f"http://{host}/x/{k}", f"<div class='q7'>Site <b>name</b></div><div><h1>Title {k}</h1><p>Text of page {k}.</p>{body}</div><div class='q9'>Seen today</div>"


def test_recurring_subtrees_go(spark):
    rows = [(i, *page(i)) for i in range(40)] + [(100 + i, *page(i, "few.example")) for i in range(3)] + [(200 + i, *page(0, "copies.example")) for i in range(40)]
    same = "<article><p>A passage on all pages.</p><div>Share it</div><p>{}</p></article>"
    rows += [(300 + i, f"https://u@b.example:80/{i}", same.format(i)) for i in range(30)]
    rows += [(400, None, "<p>x</p>"), (401, "odd", None), (402, "http://a.example/", ""), (0, *page(0))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'own' as host", "'own' as text", "'own' as common")
    got = p.extract(df).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert [text[i] for i in (0, 39)] == ["Title 0\nText of page 0.", "Title 39\nText of page 39."]
    # too few different pages to tell
    assert text[100] == "Site name\nTitle 0\nText of page 0.\nSeen today" == text[239]
    # inside an article the passage stays, the container goes
    assert text[305] == "A passage on all pages.\n5"
    assert (text[400], text[401], text[402]) == ("x", "", "")
    assert p.extract(df.limit(0)).collect() == []


def test_pages_without_paragraphs_and_sections(spark):
    """Pages are told apart by all their text; a section's template goes however large its host is."""
    foot = "<div class='q9'><div>Follow our letters</div></div>"
    rows = [(i, f"http://div.example/{i}", f"<div>Text {i}<br>and more</div>{foot}") for i in range(20)]
    # 12 pages of a section in a host of 400
    rows += [(100 + i, f"http://big.example/s/{i}.html", f"<div>Words {i}</div>{foot}") for i in range(12)]
    rows += [(200 + i, f"http://big.example/t{i % 40}/{i}.html", f"<div>Lines {i}</div><div>Seen {i // 12}</div>") for i in range(388)]
    got = {r.page_id: r.text for r in p.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == "Text 7 and more" and got[105] == "Words 5" and got[205] == "Lines 5\nSeen 0"


def test_extraction_equals_plain_counting(spark):
    """Against counting every subtree of every page in one process, over the given pages."""
    import os
    from collections import Counter

    df = spark.read.parquet(os.path.join(os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.01"), "pages.parquet"))
    urls = df.select("page_id", "url", "html", p.host_of(df.url).alias("host"), p.section_of(df.url).alias("section")).collect()
    seen = set()
    for r in urls:
        page, outside, inside = p.subtrees(p.parse(r.html or ""))
        for scope in ((r.host, None), (r.host, r.section)):
            seen |= {(scope, page, h, False) for h in outside} | {(scope, page, h, True) for h in inside} | {(scope, page, 0, False)}
    n = Counter((scope, h, inside) for scope, _, h, inside in seen)
    sets = {}
    for (scope, h, inside), k in n.items():
        share = p.LEAST_SHARE_IN_ARTICLE if inside else p.LEAST_SHARE
        if h and k >= p.LEAST_PAGES and k >= share * n[scope, 0, False]:
            sets.setdefault(scope[0], (set(), set()))[inside].add(h)
    want = sorted((r.page_id, p.main_text(p.parse(r.html or ""), *map(frozenset, sets.get(r.host, ((), ()))))) for r in urls)
    assert sorted((r.page_id, r.text) for r in p.extract(df).collect()) == want


def test_very_long_page():
    """Time grows with the page, also where tags never end."""
    import time

    def seconds(n):
        t = time.perf_counter()
        text = p.main_text(p.parse("<article>" + "<p class='x'>some words <b>and</b> more</p><div>" * n + "<"))
        assert text.count("some words and more") == n
        return time.perf_counter() - t

    seconds(1000)
    assert seconds(40_000) < 4 * seconds(20_000) + 0.5

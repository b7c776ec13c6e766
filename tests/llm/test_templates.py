from __future__ import annotations

import html
import re
from collections import defaultdict

import pytest

from shelfscan.llm import templates
from tests.conftest import DATA

LAYOUT = "page_id long, url string, html string, host string, text string"


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], LAYOUT)


def text_of(page: str) -> str:
    return " ".join(templates.blocks(page)[0])


def test_generated_pages(spark):
    """Their articles hold only headings, paragraphs, unclosed b and br."""
    df = spark.read.parquet(f"{DATA}/pages.parquet")
    raw = {r["page_id"]: r["html"] for r in df.collect()}
    for r in templates.main_text(df).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", raw[r["page_id"]], re.S)[1]
        inner = re.sub(r"<[^>]*\Z", "", inner)
        blocks = [re.sub(r"</?(?:b|br)>", " ", b) for b in re.split(r"</?(?:p|h1)>", inner)]
        expected = " ".join(t for b in blocks if (t := " ".join(html.unescape(b).split())))
        assert r["text"] == expected and r["n_chars"] == len(expected)


def test_what_is_no_article():
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><p>menu</p></nav>
    <div class="cookie-notice">We use</div><main><header><h1>Head &amp; line</h1></header>
    <p>One <b>bo</b>ld&nbsp;&#233;<br>two<p>next<div class='ad'>buy</div><form>f</form><ul><li>a<li>b</ul>
    <script>if (a < b) "</p>"</script><style>p{}</style><!-- <p>no</p> --><aside>side</aside>a < b
    <section id="comments"><article><p>me too</p></article></section></main><footer>&copy;</footer>"""
    assert text_of(page) == "Head & line One bold é two next a b a < b"


def test_attributes_are_read_by_name():
    assert text_of('<article>a<p title="Hidden gems of Paris">b</p><a href="/hidden/x">c</a><p data-x="role=search">d</p></article>') == "a b c d"
    assert text_of('<p>a<a href="/x?class=comment">b</a></p><p data-hidden=1>c</p><p hidden>d</p><p HIDDEN="">e</p>') == "ab c"
    assert text_of('<article title="comment rules">a</article>') == "a"
    assert text_of("<p class=&#97;d>a</p><p class=x class=ad>b</p>") == "b"


def test_classes_count_as_a_whole():
    for kept in ("layout has-sidebar", "social-news", "widget Blog", "cookie-recipes", "article-header", "no-comments-yet", "nav-less"):
        assert text_of(f'<body><div class="{kept}"><p>text</p></div></body>') == "text", kept
    for gone in ("ad", "wide sidebar", "cookie-notice", "site-footer", "ad-slot-3", "post-comments", "related-articles", "nav_main"):
        assert text_of(f'<body><div class="{gone}"><p>junk</p></div><p>text</p></body>') == "text", gone


def test_what_holds_an_article_stays():
    page = "<body><nav>menu</nav><p>outside</p><article>text</article></body>"
    for start, end in (("<form id=aspnetForm>", "</form>"), ("<div class=sidebar>", "</div>"), ("<div role=banner>", "</div>"),
                       ("<aside>", "</aside>"), ("<div style='display:none'>", "</div>"), ("<head>", ""), ("<main><div class=widget>", "</div></main>")):
        assert text_of(f"<html>{start}{page}{end}</html>").replace("outside ", "") == "text", start
    assert text_of("<form><header>top</header><div><p>text</p></div><footer>end</footer></form>") == "text"
    assert text_of("<article>a</article><aside><article>b</article></aside><section class=comments><article>c</article></section>") == "a"


def test_inline_elements_leave_no_gap():
    assert text_of("<body><p>a<b>b</b>c <span> d</span></p>tail<div>x</div>y") == "abc d tail x y"
    assert text_of("plain") == "plain"
    assert text_of("<p>a</p><p hidden>b</p><p style='display: none'>c</p><div role=navigation>d</div><p>e") == "a e"
    assert text_of("<article>x<article>y</article>z</article>out") == "x y z"


def test_broken_pages():
    assert text_of("<p>a &am") == "a &am"
    assert text_of("<p>a<p") == "a"
    assert text_of("<p>a<!-- b") == "a"
    assert text_of("<script>a") == ""
    assert text_of("</div></p>a</b>") == "a"
    assert text_of("<div>" * 5000 + "deep") == "deep"


def test_repeated_subtrees_go(spark):
    box = "<div><p>Read more of this site</p><p>every day</p></div>"
    rows = [(i, f"https://h.example/{i}", f"<body>{box}<p>article {i}</p>{box if i % 2 else ''}</body>") for i in range(30)]
    rows += [(100 + i, f"https://h.example/copy{i}", "<body><p>same article</p></body>") for i in range(40)]
    rows += [(200 + i, f"https://few.example/{i}", f"<body>{box}<p>other {i}</p></body>") for i in range(5)]
    rows += [(300, None, f"<body>{box}</body>")]
    got = {r["page_id"]: r["text"] for r in templates.main_text(pages(spark, *rows)).collect()}
    assert all(got[i] == f"article {i}" for i in range(30))
    assert all(got[100 + i] == "same article" for i in range(40))  # one article under many addresses
    assert all(got[200 + i] == f"Read more of this site every day other {i}" for i in range(5))
    assert got[300] == "Read more of this site every day"


def test_recurrence_does_not_depend_on_the_size_of_the_host(spark):
    box = "<div><p>Notice</p><p>on few pages</p></div>"
    rows = [(i, f"https://big.example/{i}", f"<body>{box if i < 12 else ''}<p>article {i}</p></body>") for i in range(600)]
    rows += [(1000 + i, f"https://small.example/{i}", f"<body>{box if i < 12 else ''}<p>other {i}</p></body>") for i in range(20)]
    rows += [(2000 + i, f"https://nine.example/{i}", f"<body>{box if i < 9 else ''}<p>nine {i}</p></body>") for i in range(30)]
    got = {r["page_id"]: r["text"] for r in templates.main_text(pages(spark, *rows, *rows[:5])).collect()}
    assert all(got[i] == f"article {i}" for i in range(600))
    assert all(got[1000 + i] == f"other {i}" for i in range(20))
    assert all(got[2000 + i] == f"{'Notice on few pages ' if i < 9 else ''}nine {i}" for i in range(30))


def test_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (2, "http://x/", "<p> \n </p>"), (3, "http://x/", "<p>" + "a " * 50_000)]
    got = [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in templates.main_text(pages(spark, *rows)).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, "u", "", 0), (1, "u", "", 0), (None, None, "", 0), (2, "http://x/", "", 0), (3, "http://x/", ("a " * 50_000).strip(), 99_999)],
        key=str,
    )
    assert templates.main_text(pages(spark)).collect() == []


def plain_main_text(rows: list[tuple], min_pages: int) -> list[tuple]:
    """Parse, count and delete without Spark; an element is known by its way to the root."""
    parsed, articles = [], defaultdict(set)
    for page_id, url, page in rows:
        found = templates.blocks(page or "")
        host = (re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "") or ["", ""])[1].lower()
        for code in found.codes:
            articles[host, code].add(found.article)
        parsed.append((page_id, url, host, found))
    out = []
    for page_id, url, host, found in parsed:
        kept = []
        for text, at in zip(found.texts, found.inside, strict=True):
            around = []
            while at >= 0:
                around.append(found.codes[at])
                at = found.parents[at]
            if all(len(articles[host, code]) < min_pages for code in around):
                kept.append(text)
        text = " ".join(kept)
        out.append((page_id, url, text, len(text)))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_pages", [2, 10])
def test_equals_a_plain_count(spark, min_pages):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in df.collect()]
    # site boxes that no class gives away, nested ones too, on hosts of different sizes, in several parts
    box = "<div><p>Read our {0} rules</p><div><p>Call {0}</p></div></div>"
    rows += [
        (10_000 + i, f"http://h{i % 5}.x/{i}", f"<div><p>own text {i}</p>{box.format(i % 5)}<p>more {i // 9}</p></div>") for i in range(90)
    ]
    rows += [(None, None, None), (1, "http://h1.x/1", ""), (20_000, "http://h1.x/2", "<p>text")]
    want = plain_main_text(rows, min_pages)
    assert any("own text" in t and "rules" not in t for _, _, t, _ in want)
    for parts in (1, 7):
        got = templates.main_text(pages(spark, *rows).repartition(parts), min_pages).collect()
        assert sorted(map(tuple, got), key=str) == want


def test_texts_are_not_shuffled(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = templates.main_text(df)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")]
    texts = [line for line in final.splitlines() if "FileScan" in line and "texts" in line]
    assert len(texts) == 1 and "Bucketed: true" in texts[0]
    above = final[: final.index(texts[0])].rpartition("FlatMapCoGroupsInArrow")[2]
    assert "Exchange" not in above
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("blocks_")]


@pytest.mark.parametrize("page", ["<div>x " * 100_000, "<b>" * 100_000 + "</i>" * 100_000 + "<p>a</p>" * 50_000, "<ul><li>" * 60_000 + "x"])
def test_deep_pages(spark, page):
    """Time and memory in proportion to the page."""
    found = templates.blocks(page)
    assert len(found.codes) <= 120_000 and len(found.parents) == len(found.codes)
    (row,) = templates.main_text(pages(spark, (1, "http://a/", page))).collect()
    assert row["n_chars"] == len(" ".join(found.texts)) > 0


def test_empty_table(spark):
    assert templates.main_text(pages(spark).limit(0)).collect() == []

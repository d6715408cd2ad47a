from html.parser import HTMLParser

from rotaspark.llm.html_extract import extract_pages, lines_of, main_text, op5_html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><!-- x --><div class="ad">Buy</div><div id="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p><b>First   para<br>goes on<p>Second &lt;b&gt; &#233;.</p><aside>Related</aside><p>Short.</p>
<form><label>Mail</label><input></form><section class="comments"><p>Nice post!</p></section></article>
<div class="sidebar"><p>Side text that is long enough to be text of its own, really.</p></div><footer>&copy; 2020</footer></body></html>"""


def test_marked_article():
    assert main_text(PAGE) == "Head & line\nFirst para goes on\nSecond <b> é.\nShort."


def test_distribution_finds_the_unmarked_text():
    menu = "".join(f"<div><a href='#'>Item {i}</a></div>" for i in range(30))
    body = "<h1>Title</h1>" + "".join(f"<p>{'Some longer sentence of the text. ' * 5}{i}</p>" for i in range(6))
    got = main_text(f"<html><body>{menu}{body}{menu}</body></html>")
    assert got.split("\n")[0] == "Title" and len(got.split("\n")) == 7
    assert "Item" not in got


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""
    assert main_text("just text") == "just text"
    assert main_text("a < b & c") == "a < b & c"
    assert main_text("<nav>menu<article><p>Text</p></article>") == "Text"
    assert main_text("<article><p>Text<script>x") == "Text"
    assert main_text('<article><p title="a>b">Q</p></article>') == "Q"
    assert main_text("<article><p>a&nbsp;&#x41;\n\t b</p></article>") == "a A b"
    assert len(main_text("<article>" + "<p>w</p>" * 20_000 + "</article>")) == 39_999
    assert main_text("<" * 50_000)
    assert lines_of("<div>" * 5000 + "x")[0].text == "x"


def test_pages(spark, sf):
    rows = op5_html(spark, sf).collect()
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(html)
    for r in rows:
        page = html[r.page_id]
        assert r.n_chars == len(r.text) > 0
        inside = page[page.index("<article>") : page.index("</article>")]
        assert r.text.count("\n") + 1 >= inside.count("<p>") // 2
        assert "track(" not in r.text and "©" not in r.text


class Article(HTMLParser):
    """The given pages' articles: blocks of text between tags, but for those inside a line."""

    def __init__(self):
        super().__init__()
        self.depth, self.blocks = 0, [[]]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag == "br":
            self.blocks[-1].append(" ")
        elif tag not in ("b", "a"):
            self.blocks.append([])

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag not in ("b", "a"):
            self.blocks.append([])

    def handle_data(self, data):
        if self.depth:
            self.blocks[-1].append(data)


def test_whole_texts_of_all_pages():
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.1/pages.parquet")["html"].to_pylist()
    for page in pages:
        p = Article()
        p.feed(page)
        p.close()
        blocks = [" ".join("".join(b).split()) for b in p.blocks]
        assert main_text(page) == "\n".join(b for b in blocks if b)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, "y")], "page_id long, url string, html string, text string")
    assert {(r.page_id, r.n_chars) for r in extract_pages(df).collect()} == {(1, len(main_text(PAGE))), (None, 0)}
    assert extract_pages(df.limit(0)).count() == 0


def paragraphs(n, size=170, word="story"):
    return [f"{word} {i} ".ljust(size - 1, "x") + "." for i in range(n)]


def page_of(lines):
    return "".join(f"<p>{x}</p>" for x in lines)


def test_story_beside_teaser_articles():
    story = paragraphs(8)
    cards = "".join(f"<article class=teaser><h3><a href='#'>Card {i}</a></h3><p>Blurb {i} in brief.</p></article>" for i in range(6))
    for a, b in (("<div class=story>", "</div>"), ("<main><div>", "</div></main>"), ("<article>", "</article>"), ("<main><article>", "</article></main>")):
        for page in (a + page_of(story) + b + cards, cards + a + page_of(story) + b):
            assert main_text(page) == "\n".join(story)
    assert main_text("<div role=main>" + page_of(story) + "<p><a href='#'>Source</a></p></div><div>Imprint, all rights</div>") == "\n".join([*story, "Source"])
    beyond = paragraphs(6, 250, "beyond")
    assert main_text("<article>" + page_of(story) + "</article><div>" + page_of(beyond) + "</div>") == "\n".join(story + beyond)


def test_nothing_in_the_article_is_dropped():
    menu = "<ul>" + "".join(f"<li><a href='#'>Item {i}</a></li>" for i in range(30)) + "</ul>"
    short = ["Why?", "So."]
    for lines in (
        ["x" * 5000, *paragraphs(10, 100)],
        [*paragraphs(10, 100), "x" * 5000],
        [*paragraphs(4, 300), *["item"] * 20, *paragraphs(2, 100)],
        [*short, *paragraphs(5), *short, *short, *short],
        [*paragraphs(3), *[f"<a href='#'>{x}</a>" for x in paragraphs(6, 60, "linked")], *paragraphs(2, 90)],
    ):
        want = "\n".join(x.removeprefix("<a href='#'>").removesuffix("</a>") for x in lines)
        assert main_text(f"<body>{menu}<div>{page_of(lines)}</div>{menu}</body>") == want
    assert main_text(f"<article>{page_of(paragraphs(8))}</article><div>{page_of(paragraphs(3, 900, 'beyond'))}</div>").count("\n") == 10
    labels = "".join(f"<div>Item {i}</div>" for i in range(20))
    assert main_text(f"{labels}{menu}<div>{page_of(paragraphs(6))}</div>{menu}{labels}") == "\n".join(paragraphs(6))


def test_wrappers_hide_nothing():
    story = paragraphs(5)
    ad = "<div class=ad>Buy</div><nav>Menu of this site</nav>"
    want = "\n".join(story)
    for kind in (
        "class='site has-sidebar'", "class='content no-comments'", "class='layout with-nav'", "title='the hidden costs'", "data-state='hidden'",
        "data-testid='sidebar'", "data-x='a' data-class=\"sidebar\"", "class='sidebar'", "class=comments id=widget", "style='display: none'",
    ):
        for a, b in (("<article>", "</article>"), ("<div>", "</div>"), ("", "")):
            assert main_text(f"<body>{ad}<div {kind}>{ad}{a}{page_of(story)}{b}{ad}</div><footer>End of it</footer></body>") == want
    assert main_text(f"<form>{ad}{page_of(story)}</form>") == want
    for kind in ("class='ad'", "id='cookie-notice'", "class='x sidebar-left'", "hidden", "title=\"a 'b'\" hidden", "class='AdBox'", "aria-hidden=true", "class=a class=b role=banner"):
        assert main_text(f"<div>{page_of(story)}</div><div {kind}><p>Not of the story</p></div>") == want
    assert main_text(f"<div>{page_of(story)}</div><div class=related><article><p>Not of the story</p></article></div>") == want
    assert main_text("<p>One <span class=ad>Buy <b>it</b></span> two <a href=x>three <i class=ad>x</i> four</a></p><nav><div class=ad>x</nav><p>Five") == "One two three four\nFive"

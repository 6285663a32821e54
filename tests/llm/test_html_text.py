import html as entities
import re

from loomwork.llm import html_text

PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header class="site"><h1>Site</h1></header>
<div id="cookie-notice">We use cookies</div><div class="wrap"><div class="sidebar">Side text, rather long</div>
<div class="content post-12"><h2>Title</h2><p>One &lt;b&gt; two<br>three &nbsp; x<ul><li>item <a href=x>link</a></li><li>two</ul>
<blockquote>q</blockquote><table><tr><td>c1<td>c2</table><div class="comments"><p>reader</p></div><form><p>name</p></form>
<p>a < b and 5<6 end</p></div></div><footer>foot</footer><!-- x > y --></body></html>"""


def test_main_text_of_a_page():
    assert html_text.best_path(PAGE)[0] == ">body>div.wrap>div.content.post-#"
    want = "Title\n\nOne <b> two three x\n\nitem link\n\ntwo\n\nq\n\nc1\n\nc2\n\na < b and 5<6 end"
    assert html_text.text_at(PAGE, None) == want


def test_ids_of_an_article_are_slugs():
    """Headings and sections of an article stay whatever their ids; boilerplate by its whole id and links goes."""
    text = "This is a paragraph of running text that is long enough to count as one, by itself and without any links in it."
    links = "<a href=1>One of the other stories</a> <a href=2>Another one</a>"
    page = (
        f'<body><div id="search-box">site</div><article><h2 id="search">Search</h2><p id="notice">{text}</p>'
        f'<section id="related-work"><h3>Related</h3><p>{text}</p></section><div id="legal">{text}</div>'
        f'<ul id="legal-basis"><li>Short item</li></ul><div id="social-impact">Impact</div>'
        f'<div id="related">{links}</div><div id="share">Share this</div><div id="comments">{text} Reader</div>'
        f'<div id="newsletter-signup">{text} Sign up</div><div class="ad">{text} Buy</div></article></body>'
    )
    want = ["Search", text, "Related", text, text, "Short item", "Impact"]
    assert html_text.text_at(page, None) == "\n\n".join(want)
    assert html_text.text_at(page, ">body>article") == "\n\n".join(want)


def test_hosts_agree_on_a_path(spark):
    """A page whose teaser outweighs its article still gives the article, as its host's other pages do."""
    def page(article, extra):
        return f"<body><div class=story-{len(article)}><p>{article}</p></div><div class=latest><p>{extra}</p></div></body>"

    rows = [(i, "https://Example.org:80/x", page("word " * (40 + i), "short")) for i in range(6)]
    rows.append((6, "https://example.org/y", page("tiny words here", "more " * 90)))
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    texts = {r.page_id: r.text for r in got.collect()}
    assert texts[6] == "tiny words here" and texts[0] == ("word " * 40).strip()


def test_pages_of_another_template(spark):
    """A page whose winning container is empty, or a teaser beside another template's article, gives its own article."""
    def page(teaser, article):
        return f'<body><div class="story">{teaser}</div><div class="gallery"><p>{article}</p></div></body>'

    long = "word " * 150
    rows = [(i, "https://example.org/x", page(f"<p>{long}{i}</p>", "short")) for i in range(6)]
    rows += [(6, "https://example.org/y", page("", long)), (7, "https://example.org/y", page("A teaser of a few words", long))]
    rows += [(8, "https://example.org/y", page("x", long)), (9, "https://other.org/y", page("<p>alone</p>", ""))]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    texts = {r.page_id: r.text for r in got.collect()}
    assert all(texts[i] == f"{long}{i}" for i in range(6))
    assert texts[6] == texts[7] == texts[8] == long.strip() and texts[9] == "alone"
    # Alone on its host, without a second vote for its path, a page follows its own only below SHARE.
    assert html_text.text_at(page("x", long), ">body>div.story") == long.strip()
    assert html_text.text_at(page("word " * 20, long), ">body>div.story") == ("word " * 20).strip()


def plain_article(page):
    at, to = page.find("<article>"), page.find("</article>")
    body = re.sub(r"<[a-z/][^>]*$", "", page[at + 9 : to if to >= 0 else len(page)])
    blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
    return "\n\n".join(b for b in blocks if b)


def test_query_against_the_template(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = html_text.op3_main_text(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == plain_article(pages[r.page_id].html) and r.n_chars == len(r.text)


def test_odd_pages(spark):
    rows = [
        (1, None, None, "a"), (2, "no url", "", "b"), (3, "http://h/", "<p>only", "c"), (3, "http://h/", "<p>only", "c"),
        (None, "http://h/", "<body><div hidden>x</div><p>a</p><", None), (5, "http://h/", "<!-- never ended <p>x", "d"),
        (6, "http://h/", "plain text &am", "e"), (7, "http://h/", "<div>" * 3000 + "deep", "f"), (8, "http://h/", "</div></p><p class=\"x>y", "g"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract_pages(df).collect()
    assert len(got) == len(rows) and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == by[5] == by[8] == ""
    assert html_text.extract_pages(df.filter("false")).count() == 0

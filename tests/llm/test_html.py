import html
import re

from geowarden.llm.html import extract, main_texts

SF = "/root/testdata/sf0.01"


def article(page):
    """Brute force for the tables' one template: the article's blocks."""
    found = re.search(r"<article>(.*?)(?:</article>|$)", page, re.DOTALL)[1]
    blocks = [html.unescape(re.sub(r"<[^>]+>", "", b)) for b in re.split(r"</?(?:p|h1)>", found.replace("<br>", " "))]
    return "\n\n".join(filter(None, (" ".join(b.split()) for b in blocks)))


def test_on_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: (r.url, article(r.html)) for r in pages.collect()}
    got = {r.page_id: (r.url, r.text) for r in main_texts(pages).collect()}
    assert got == want


TEXT = "A sentence of the page that is long enough to be read, and another clause."
NOISE = """<header><h1>Site</h1><a href=/>Home</a></header><nav><a href=a>A</a></nav><div class="cookie-notice">We use cookies a lot here.</div>"""
END = """<aside>Other things to read, at some length, or not.</aside><div id="comments"><p>First! And many more words by a reader, a whole lot of them.</p></div><form>Mail <input><button>Go</button></form><footer>&copy; all</footer>"""


def test_pages_of_other_kinds():
    want = f"Head & line\n\n{TEXT}\n\nOne\n\nTwo"
    inner = f"<h1>Head &amp; line</h1><p>{TEXT}<ul><li>One<li>Two</ul>"
    for before, after in (("<article>", "</article>"), ("<main><article><header>", "</header></article></main>"), ("<main>", "</main>"), ("<div class=content>", "</div>"), ("<article>", "")):
        assert extract(f"<!doctype html><html><head><title>x</title><style>p{{}}</style></head><body>{NOISE}{before}{inner}{after}{END}</body></html>") == want, before
    assert extract(f"<body>{NOISE}<div><p>{TEXT}</p><script>var a = '<p>no</p>';</script><p>{TEXT} <b>Bold</b>.</p><p>{TEXT}</p></div>{END}") == f"{TEXT}\n\n{TEXT} Bold.\n\n{TEXT}"


def test_malformed_and_deep_pages():
    assert extract("plain words only") == "plain words only"
    assert extract("") == extract("<html></html>") == extract("<![bad") .replace("<![bad", "") == ""
    assert extract("<article>" + "<div><b>" * 3000 + "deep" + "</div>" * 10) == "deep"
    assert extract("<article><p>a&nbsp;b &#233;&lt;</p>\n\t<p>c<br>d") == "a b é<\n\nc d"


def test_defined_cases(spark):
    schema = "text int, page_id long, html string, url string"
    rows = [(1, 5, None, "u"), (1, 5, "", None), (None, None, "<p>hi", "u")]
    got = [tuple(r) for r in main_texts(spark.createDataFrame(rows, schema)).collect()]
    assert got == [(5, "u", "", 0), (5, None, "", 0), (None, "u", "hi", 2)]
    assert main_texts(spark.createDataFrame([], schema)).count() == 0


def unnamed(page):
    """The page without the names that tell what its parts are for."""
    for t in ("article", "nav", "footer"):
        page = page.replace(f"<{t}>", "<div>").replace(f"</{t}>", "</div>")
    return page.replace(' class="ad"', "")


def test_density_decides_where_nothing_is_named(monkeypatch):
    """Unnamed list pages: links and thin text beside the article go by density, and a constant in its place does not do it."""
    from geowarden.llm import html as module

    text = "".join(f"<p>{TEXT}</p>" for _ in range(4))
    links = "".join(f'<li><a href="/{k}">Some other headline number {k} on the site</a></li>' for k in range(40))
    want = "\n\n".join([TEXT] * 4)
    pages = [
        f"<body><div><ul>{links}</ul></div><div>{text}</div></body>",
        f"<body><div><div><ul>{links}</ul></div><div><div>{text}</div></div></div></body>",
        f"<body><table><tr><td><ul>{links}</ul></td><td><div>{text}</div></td></tr></table></body>",
        f"<body><div>{text}</div><div>{''.join(f'<div><b>x</b><i>{k}</i></div>' for k in range(40))}</div></body>",
    ]
    assert [extract(p) for p in pages] == [want] * 4
    monkeypatch.setattr(module, "_density", lambda chars, *more: 1.0 if chars else 0.0)
    assert all(extract(p) != want for p in pages)


def test_the_tables_pages_under_other_names(spark, monkeypatch):
    """The article may be any element; with no names at all density keeps every article whole and finds more of them exactly than a constant."""
    from geowarden.llm import html as module

    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    want = [article(p) for p in pages]
    assert [extract(p.replace("<article>", "<div>").replace("</article>", "</div>")) for p in pages] == want
    bare = [extract(unnamed(p)) for p in pages]
    assert all(w in b for w, b in zip(want, bare, strict=True))
    monkeypatch.setattr(module, "_density", lambda chars, *more: 1.0 if chars else 0.0)
    flat = [extract(unnamed(p)) for p in pages]
    right = lambda found: sum(a == b for a, b in zip(found, want, strict=True))
    assert right(bare) > 1.1 * right(flat)


def test_names_count_only_where_the_text_agrees():
    two = f"{TEXT}\n\n{TEXT}"
    for before, after in (('<div id="main-related">', "</div>"), ('<div class="post comment-enabled">', "</div>"), ("<section><article>", "</article></section>")):
        assert extract(f"<body>{NOISE}{before}<p>{TEXT}<p>{TEXT}{after}{END}") == two, before
    assert extract(f"<body>{NOISE}<article><p>{TEXT}</article><article><p>{TEXT}</article>{END}") == two
    section = f"<section><h2>Part</h2>{'<p>' + TEXT + '</p>'}{'<p>' + TEXT + '</p>'}</section>"
    assert extract(f"<body>{NOISE}<div><h1>Title</h1><div>{section * 3}</div></div>{END}") == "\n\n".join(["Title"] + ["Part", TEXT, TEXT] * 3)
    comments = "".join(f'<div class="comment"><p>{TEXT}</p></div>' for _ in range(30))
    assert extract(f'<body><div><h1>Title</h1><p>{TEXT}</p></div><div class="comment-list">{comments}</div>') == f"Title\n\n{TEXT}"


def test_deep_nesting_is_fast_and_bad_declarations_cut_nothing():
    import time

    began = time.time()
    for page in ("<div>" * 20_000 + "deep", "<p>" + "<b>" * 20_000 + "deep", "<ul>" + "<li><ul>" * 10_000 + "deep", "<p><table>" + "<div>" * 20_000 + "deep"):
        assert extract(page) == "deep"
    assert time.time() - began < 4
    assert extract(f"<![if x]><body><![bad thing><p>{TEXT}<![CDATA[ a > <p>{TEXT}") .count(TEXT) == 2


def test_bytes_that_are_no_text(spark):
    pages = spark.sql("SELECT 1L AS page_id, 'u' AS url, CAST(X'3C703E61FF62' AS STRING) AS html")
    assert [r.text for r in main_texts(pages).collect()] == ["a�b"]

"""Main text of pages of many shapes."""

import re
import time
from html import unescape

import pytest

from conftest import DATA
from tessera.llm import html

BODY = ["A first paragraph of the article, which is long enough to be one of them for sure, and then some.", "A second one with <a href=x>a link</a> in it, again long enough to count &amp; to be kept by the rule."]
TEXT = "\n".join(unescape(re.sub("<[^>]*>", "", b)) for b in BODY)
PARAGRAPHS = "".join(f"<p>{b}</p>" for b in BODY)
MENU = "<nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>"


@pytest.mark.parametrize("name", ["with-sidebar", "has-sidebar", "content no-comments", "layout tags-open", "post-with-header", "page-search", "ad-free", "sidebar", "page header-fixed"])
def test_wrappers_with_suspicious_names(name):
    side = '<div class="sidebar"><p>Some words of a sidebar that nobody wants to read, long as they are here.</p></div>'
    for inner in (PARAGRAPHS, f"<article>{PARAGRAPHS}</article>", f"<h1>Title</h1>{PARAGRAPHS}{side}"):
        want = ("Title\n" if "h1" in inner else "") + TEXT
        assert html.main_text(f'<body>{MENU}<div class="{name}">{inner}</div><footer>Imprint</footer></body>') == want


@pytest.mark.parametrize("box", [
    "<div class=ad>{}</div>", "<div id='cookie-notice'>{}</div>", "<div class='site-header'>{}</div>", "<aside>{}</aside>", "<form>{}</form>", "<div role=navigation>{}</div>",
    "<section class=comments><ol class=comment-list><li><article class=comment>{0} {0} {0} {0}</article></ol></section>", "<div class='newsletter box'>{}</div>",
    "<div style='display:none'>{}</div>", "<div class=relatedPosts>{}</div>", "<script>{}</script>", "<footer>{}</footer>", "<header>{}</header>",
])
def test_other_boxes_go(box):
    junk = box.format("Words that are not part of the article, but long enough to look like a paragraph of it to a rule.")
    for page in (f"{junk}<article><h1>T</h1>{PARAGRAPHS}</article>{junk}", f"{junk}<div><h1>T</h1>{PARAGRAPHS}</div>{junk}"):
        assert html.main_text(f"<html><body>{MENU}{page}</body></html>") == f"T\n{TEXT}"


def test_teasers_short_and_linked_articles():
    assert html.main_text(f"<body><article>short teaser</article><div>{PARAGRAPHS * 2}</div></body>").endswith(f"{TEXT}\n{TEXT}")
    assert html.main_text(f"<body>{MENU}<div><p>Only a few words.</p></div></body>") == "Only a few words."
    linked = "".join(f"<a href=x><p>{re.sub('<[^>]*>', '', b)}</p></a>" for b in BODY)
    assert html.main_text(f"<body>{MENU}<div>{linked}</div></body>") == TEXT
    assert html.main_text(f"<body><div><p>{BODY[0]}</p><p><a href=y>See more</a></p><p>{BODY[1]}</p></div>{MENU}</body>") == TEXT.replace("\n", "\nSee more\n")


PLAIN = [f"Paragraph number {i} of a plain page, which goes on for a good while so that it is a long one, as they are." for i in range(4)]
COMMENT = "I have an opinion about this and I write it down at length, so that it is as long as the article is, or longer."


def plain(*more):
    return "".join(f"<p>{t}</p>" for t in (*PLAIN, *more))


@pytest.mark.parametrize("comment", ["<article class=comment><p>{}</p></article>", "<div class='comment-body'><article><p>{}</p></article></div>", "<article id=comment-7 class=comment><h1>Re</h1><p>{}</p></article>"])
def test_a_comment_article_hides_nothing_after_it(comment):
    talk = comment.format(COMMENT)
    half = "".join(f"<p>{t}</p>" for t in PLAIN[:2]), "".join(f"<p>{t}</p>" for t in PLAIN[2:])
    for page in (f"<main>{half[0]}{talk}{half[1]}</main><div>{COMMENT[:70]}</div>", f"{talk}<article>{plain()}</article><div><p>{COMMENT}</p></div>"):
        assert html.main_text(f"<body>{page}</body>") == "\n".join(PLAIN)


@pytest.mark.parametrize("wrap", ["<form id=aspnetForm action=x>{}</form>", "<fieldset>{}</fieldset>", "<form><fieldset><legend>Page</legend>{}</fieldset></form>", "<form><div class=page>{}</div><input name=q></form>"])
def test_forms_around_the_page(wrap):
    search = "<form><label>Search this site</label><input name=q><button>Go</button><p>Type a word.</p></form>"
    assert html.main_text(f"<body>{wrap.format(MENU + plain())}</body>") == "\n".join(PLAIN)
    assert html.main_text(f"<body>{wrap.format(MENU + '<article>' + plain() + '</article>')}</body>") == "\n".join(PLAIN)
    assert html.main_text(f"<body>{MENU}{search}{plain()}{search}</body>") == "\n".join(PLAIN)


@pytest.mark.parametrize("inner", ["<h1>Comments</h1><p>{0}</p><p>{0}</p>", "<article><p>{0}</p></article><article><p>{0}</p></article>", "<div class=sidebar><h1>x</h1><p>{0}</p></div>"])
def test_comments_are_never_saved(inner):
    talk = f"<section id=comments>{inner.format(COMMENT * 4)}</section>"
    for page in (f"{plain()}{talk}", f"<article>{plain()}</article>{talk}", f"<main>{plain()}{talk}</main>", f"<div class=widget-area>{plain()}{talk}</div>"):
        assert html.main_text(f"<body>{MENU}{page}</body>") == "\n".join(PLAIN)
    assert html.main_text(f"<body>{talk}</body>") == ""


def test_prefixed_names_of_sidebars():
    side = "".join(f"<p>{COMMENT[:80]}</p>" for _ in range(3))
    for name in ("c-aside", "l-sidebar", "o-aside u-right", "m-promo"):
        assert html.main_text(f"<body>{MENU}<div>{plain()}</div><div class='{name}'>{side}</div></body>") == "\n".join(PLAIN)


@pytest.mark.parametrize("around", ["{}", "<div>{}</div>", "<div class=text>{}</div>"])
def test_closing_paragraphs_after_a_link(around):
    page = plain() + "<p><a href=x>Read on</a></p><p>So it ended.</p><p>The end.</p><p><a href=y>Next</a></p>"
    assert html.main_text(f"<body>{MENU}{around.format(page)}<div><a href=z>Home</a></div><div>Made by us.</div></body>") == "\n".join([*PLAIN, "Read on", "So it ended.", "The end."])


def test_title_in_the_header_of_the_page():
    head = "<header><div>Site name</div><nav><a href=x>Menu</a></nav><h1>A title</h1><p>Some words of a slogan, which may be as long as they like, for a header.</p></header>"
    assert html.main_text(f"<body>{head}{plain()}</body>") == "\n".join(["A title", *PLAIN])
    assert html.main_text(f"<body>{head}<h1>Own title</h1>{plain()}</body>") == "\n".join(["Own title", *PLAIN])
    assert html.main_text(f"<body>{head}<article>{plain()}</article></body>") == "\n".join(PLAIN)
    assert html.main_text(f"<body>{head}</body>") == ""


def test_empty_pages():
    for page in (None, "", "   ", MENU, "<script>var a = 1</script>", "<!-- open"):
        assert html.main_text(page) == ""
    assert html.main_text("plain &lt;text&gt;  without\n markup") == "plain <text> without markup"


def test_every_page_of_the_template(spark):
    for r in spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", body)]
        assert html.main_text(r["html"]) == "\n".join(b for b in blocks if b)
        bare = r["html"].replace("<article>", '<div class="story">').replace("</article>", "</div>")
        assert html.main_text(bare) == html.main_text(r["html"])


def test_time_grows_with_length():
    began = time.time()
    n = 300_000
    for page in ("<a " * n, "<!" * n, '<a "' * n, "<div>" * n + "</p>" * n, "<span>" * n + "<p>" * n, "</script" * n, "<p class='" * n, "<div class=ad>" * n + "x", "&" * n, "<a b" + " " * n):
        html.main_text(page)
    assert time.time() - began < 60


def test_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>Some text"), (2, "v", "x" * 1_000_000)]
    pages = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r["page_id"], r["url"], r["n_chars"]) for r in html.extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", 0), (1, "u", 0), (None, None, 9), (2, "v", 1_000_000)], key=str)
    assert html.extract(pages.where("page_id = 9")).count() == 0

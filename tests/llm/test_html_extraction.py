"""Main text of pages: what a site repeats goes, the article stays whole."""

import html
import re

import pytest

pytest.importorskip("passagework.llm")

from passagework.llm import html_extraction as H  # noqa: E402
from passagework.llm import queries as Q  # noqa: E402

SCHEMA = "page_id long, url string, html string"


def texts(spark, pages, **more):
    return {r["page_id"]: r["text"] for r in H.extract_pages(spark.createDataFrame(pages, SCHEMA), **more).collect()}


def one(page):
    return H.main_text(H._deep(page), frozenset())


def test_query_against_cutting_by_hand(spark, sf_dir):
    """The pages have one article each, so a few expressions can find its text."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = Q.op12_html_extraction(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.DOTALL).group(1)
        assert r["text"] == " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split())
        assert r["n_chars"] == len(r["text"])


def test_unnamed_template_is_found_by_its_recurrence(spark):
    def page(i):
        links = "".join(f"<a href='/{j}'>Part {i + j}</a>" for j in range(5))
        return (
            f"<html><body><div class=x1><div>Welcome to the site. We store crumbs.</div></div><div class=x2>{links}</div>"
            f"<div class=x3><h1>Title {i}</h1><p>{f'Words of page {i} and more of them. ' * 6}</p><div>Read all about it every day!</div></div>"
            f"<div class=x4>Seen {i * 7} times</div></body></html>"
        )

    pages = [(i, f"https://Site.example/{i}", page(i)) for i in range(8)]
    got = texts(spark, pages + [(100, "https://other.example/", page(0)), (101, None, page(0)), (102, "nowhere", page(0))])
    for i in range(8):
        assert got[i] == " ".join(f"Title {i} {f'Words of page {i} and more of them. ' * 6}".split())
    for i in (100, 101, 102):  # nothing recurs there
        assert got[i].startswith("Welcome to the site.") and got[i].endswith("Seen 0 times")


def test_copies_of_an_article_are_no_template(spark):
    article = "<body><nav>Menu</nav><div><p>" + "The same story at many addresses. " * 9 + "</p></div></body>"
    other = [(20 + i, f"http://a.example/x{i}", f"<body><nav>Menu</nav><div><p>{'Story ' * (20 + i)}</p></div></body>") for i in range(6)]
    got = texts(spark, [(i, f"http://a.example/{i}", article) for i in range(9)] + other + other)
    assert got[0] == got[8] == ("The same story at many addresses. " * 9).strip()
    assert got[20] == ("Story " * 20).strip()
    shared = "<article><h1>{0}</h1><p>A passage that every page of the site cites.</p><p>{0} again</p></article>"
    got = texts(spark, [(i, f"http://b.example/{i}", shared.format(f"Head {i}")) for i in range(9)])
    assert got[3] == "Head 3 A passage that every page of the site cites. Head 3 again"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>A &amp; b&nbsp;c &eacute;<br>d<p>e<b>f</b>g <!-- <p>no --> h", "A & b c é d efg h"),
        ("<script>var a = '<p>no</p>';</script><style>p{}</style><p>x</p><noscript>no</noscript><textarea>no<p></textarea>", "x"),
        ("<header>Site</header><main><header><h1>Head</h1></header><p>Body</p><aside>no</aside><section id=comments><article>no</article></section></main><footer>no</footer>", "Head Body"),
        ("<nav>no</nav><article><p>One</p><div class='ad big'>no</div><form>no</form><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article><p>no</p>", "One a b c d"),
        ("<form action=/><article><p>kept</p></article><p>no</p></form>", "kept"),
        ("<body><p>a < b and 1 <2</p><div hidden>no</div><div style='display: none'>no</div></div></b></p></article>z", "a < b and 1 <2 z"),
        ("<article><p>cut <b>here <a href=\"x>y\">link</a> &am &ampx &#x41; <a hre", "cut here link &am &x A"),
        ("<TITLE>no</TITLE><P>UP<P/>Down<!doctype x><?php no ?>", "UP Down"),
        ("", ""), (None, ""), ("just text", "just text"), ("<article></article><p>no</p>", ""),
        ("<div>" * 3000 + "deep <p>text</p>" + "</div>" * 3000, "deep text"),
        ("<p>" + "long " * 200_000, ("long " * 200_000).strip()),
        ("<!--->a<!-->b<!-- c --!>d<!-- e", "abd"),
    ],
)
def test_markup(page, want):
    assert one(page) == want


def test_odd_rows(spark):
    pages = spark.createDataFrame([(None, None, None, 1, "x"), (1, "http://h/", "<p>a</p>", 2, "y"), (1, "http://h/", "<p>a</p>", 2, "y")], SCHEMA + ", text int, templates string")
    out = H.extract_pages(pages)
    assert out.columns == ["page_id", "url", "text"]
    assert sorted(((r["page_id"], r["text"]) for r in out.collect()), key=str) == [(1, "a"), (1, "a"), (None, "")]
    assert H.extract_pages(pages.where("false")).count() == 0


def test_templates_joined_by_host(spark, monkeypatch):
    monkeypatch.setattr(H, "BROADCAST_HASHES", 0)
    pages = [(i, f"http://s.example/{i}", f"<div><div>Same on all.</div><p>{'Own ' * (30 + i)}</p></div>") for i in range(6)]
    assert texts(spark, pages)[0] == ("Own " * 30).strip()

import html
import re
import time

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidemark.llm import site_tree
from tidemark.llm.markup import read

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("text, want", [
    ("", ""),
    ("a < b & c", "a < b & c"),
    ("<p>x<br>y &amp;&#233;&nbsp;z</p>", "x y &é z"),
    ("<p><b>One.<br><p>Two</b></p><p>Three", "One.\nTwo\nThree"),
    ("<html><head><title>t</title><body><p>only<script>if(a<b){'</p>'}</script> more</p><div class=ad-box>z</div>", "only more"),
    ("<body><header>S</header><main><header><h1>T</h1></header><p>a<span class='ad'>buy</span> b</p><form>q</form></main><aside>s</aside>", "T\na b"),
    ("<div class='with-sidebar'><nav>n<article><h1>T</h1><p title='a>b'>two</p></article></div><div id=comments><article class=comment>c</article></div>", "T\ntwo"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><!-- no --><p hidden>h</p></article><footer>&copy;</footer>", "a\nb\nc\nd"),
    ("<main><div class='article-header'><h1>K</h1></div><section class='comments'>x</section>p</main>", "K\np"),
    ("<div class='cookie-notice'>c</div><div role=search>s</div><p>x</p><!-- open", "x"),
    ("<p title=\"odd>abc</p><p>d</p>", "abc\nd"),
])
def test_main_text(text, want):
    assert site_tree.main_text(text, set()) == want


def test_template_of_the_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in site_tree.extracted(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def site(n, host="h.example", first=0):
    return [(first + i, f"https://{host}/{i}", f"<body><div class='x7'>Follow us everywhere</div><div class='y'><p>Story {i} alone</p>"
             f"<div class='z'>Read on and on</div></div></body>") for i in range(n)]


def test_repeated_branches_go_unlabelled(spark):
    table = site(12) + site(3, "few.example", 100) + site(2, "two.example", 150) + [(200, None, None), (201, "odd", ""), (202, "https://H.example/q?x", "<div class=x7>New words</div>")]
    got = {r.page_id: r.text for r in site_tree.extracted(spark.createDataFrame(table, PAGES)).collect()}
    assert got[3] == "Story 3 alone" and got[200] == "" and got[201] == ""
    assert got[101] == "Story 1 alone"
    assert got[151] == "Follow us everywhere\nStory 1 alone\nRead on and on"  # two pages are too few to tell


def test_importance_is_the_entropy_by_hand(spark):
    pages = spark.createDataFrame(site(8), PAGES).withColumn("host", F.lit("h.example"))
    body, x, y, p, z = read(site(1)[0][2])[0]
    assert [e.tag for e in (body, x, y, p, z)] == ["body", "div", "div", "p", "div"] and body.children == ["div.x", "div.y"]
    paths = {x.node: "/body/div.x", y.node: "/body/div.y", z.node: "/body/div.y/div.z"}
    got = {paths[r.node]: (r.pages, round(r.importance, 6)) for r in site_tree.importance(pages).collect()}
    # .x has one text on all pages; half of the 16 blocks of .y are its own (nothing repeats), half stand on all 8 pages
    assert got == {"/body/div.x": (8, 0.0), "/body/div.y": (8, 0.45), "/body/div.y/div.z": (8, 0.0)}


def test_shared_paragraphs_of_an_article_stay(spark):
    table = [(i, f"https://h.example/{i}", "<article><h1>Same</h1><p>Same words</p></article><footer>f</footer>") for i in range(30)]
    df = spark.createDataFrame(table, PAGES).selectExpr("*", "1 AS host", "2 AS removed", "3 AS text")
    got = site_tree.extracted(df)
    assert {r.text for r in got.collect()} == {"Same\nSame words"} and got.count() == 30


def test_repeated_ids_long_pages_and_empty_table(spark):
    long = "<article>" + "<p>word &amp; word</p>" * 20000 + "</article>"
    got = rows(site_tree.extracted(spark.createDataFrame([(1, "u", long), (1, "u", long), (None, None, "<p>x</p>")], PAGES)), "page_id", "n_chars")
    assert got == sorted([(1, 20000 * 12 - 1), (1, 20000 * 12 - 1), (None, 1)], key=repr)
    assert site_tree.extracted(spark.createDataFrame([], PAGES)).count() == 0


def test_copies_of_a_page_do_not_remove_article_text(spark):
    def plain(i):
        return f"<body><div class=top>Follow us</div><div class=body><p>Story {i} alone</p><ul><li>Point {i}</ul><table><tr><td>Cell {i}</table></div></body>"

    table = [(i, f"https://h.example/{i}", plain(max(0, i - 180))) for i in range(200)]  # 181 copies
    table += [(1000 + i, f"https://a.example/{i}", "<article><h1>T</h1><div class=body>Same words</div></article>") for i in range(12)]
    table += [(2000 + i, f"https://b.example/{i}", f"<article><h1>T{i}</h1><div class=body>Same words</div></article>") for i in range(12)]
    got = {r.page_id: r.text for r in site_tree.extracted(spark.createDataFrame(table, PAGES)).collect()}
    assert got[0] == "Story 0 alone\nPoint 0\nCell 0" and got[199] == "Story 19 alone\nPoint 19\nCell 19"
    assert got[1003] == "T\nSame words" and got[2003] == "T3\nSame words"


def test_topics_of_an_article_are_no_furniture():
    inside = ("<section id='discussion'><h2 id='Navigation'>N</h2><p>d</p></section><h2 id='comments'>C</h2><p class='ad-hoc'>a <span class='ad-hoc'>b</span></p>"
              "<div id='menu-engineering'>m</div><section id='subscription-model'>s</section>")
    furniture = "<div class='ad'>x</div><div id='comments'>x</div><section class='comments'>x</section><p hidden>x</p><p>y<span class='ad'>x</span></p>"
    for tag in ("article", "main"):
        assert site_tree.main_text(f"<{tag}>{inside}{furniture}</{tag}><div id='menu-bar'>x</div>", set()) == "N\nd\nC\na b\nm\ns\ny"


def text_of(page):
    return site_tree.main_text(page, set())


def test_deep_and_unclosed_pages_take_time_in_proportion():
    deep = "<div><p>some words " * 30_000
    began = time.perf_counter()
    assert text_of(deep).count("some words") == 30_000
    assert time.perf_counter() - began < 20
    assert text_of("<div>" * 100_000 + "x" + "</div>" * 100_000) == "x"
    assert text_of("<svg><p>word</p>" * 5000).count("word") == 5000


def test_elements_whose_end_is_optional_or_missing_lose_nothing_after_them():
    assert text_of("<article><p>One</p><datalist><option value=a>A<option value=b>B</datalist><p>Two</p></article>") == "One\nTwo"
    assert text_of("<article><select><option>A<option>B</select><p>Two</p></article>") == "Two"
    assert text_of("<article><p>One</p><svg><path d='x'><p>Two</p></article>") == "One\nTwo"
    assert text_of("<p>a</p><script>var x = '<p>no</p>'") == "a"


def test_formulas_stay_in_their_sentence():
    assert text_of("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be so.</p>") == "Let x=2 be so."


def test_names_that_may_be_topics_are_kept():
    for page in ("<div id=discussion>Words</div>", "<div class=social-history>Words</div>", "<article><section class=discussion>Words</section></article>",
                 "<article><div class='subscription-model'>Words</div></article>", "<div class=subscription-economy>Words</div>"):
        assert text_of(page) == "Words", page
    for page in ("<div class=social>Words</div>", "<div class=social-links>Words</div>", "<div class='comments'>Words</div>", "<div id=subscription>Words</div>"):
        assert text_of(page) == "", page

import html as entities
import random
import time

import pytest

from billweave.llm.html_text import Page, density, extract, main_text

PROSE = "Some sentences about a thing, which go on for a while and then end."


def page(inner, head="<title>T</title><style>p{}</style><script>var t='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{inner}</body></html>"


MENU = "<nav><ul>" + "".join(f"<li><a href='/{i}'>Entry {i}</a></li>" for i in range(9)) + "</ul></nav>"


@pytest.mark.parametrize(
    "boilerplate",
    [
        MENU,
        f"<header><h1>Site</h1><p>{PROSE * 3}</p></header>",
        f"<footer>&copy; <p>{PROSE * 3}</p></footer>",
        f"<aside><p>{PROSE * 5}</p><p>{PROSE}</p></aside>",
        f"<div class='sidebar'><p>{PROSE * 5}</p><p>{PROSE}</p></div>",
        f"<div id=cookieNotice><p>{PROSE * 5}</p></div>",
        f"<div class='box ad-top'>{PROSE * 5}</div>",
        f"<div role='alert'><p>{PROSE * 2}</p></div>",
        f"<form><p>{PROSE * 2}</p><textarea>text <b></textarea><select><option>a<option>b</select></form>",
        f"<section id='comments'><h2>Comments</h2><article class='comment'><p>{PROSE * 5}</p></article></section>",
        f"<ol class='post-comments'><li>{PROSE * 5}<li>{PROSE * 5}</ol>",
        f"<div hidden><p>{PROSE * 5}</p></div><div style='display: none'>{PROSE}</div><noscript>{PROSE}</noscript>",
        f"<!-- <p>{PROSE}</p> --><script>document.write('<p>{PROSE}</p>')</script><template><p>{PROSE}</p></template>",
        "<ul class=links>" + "".join(f"<li><a href=/{i}>{PROSE}</a></li>" for i in range(20)) + "</ul>",
    ],
)
@pytest.mark.parametrize("article", ["<article>%s</article>", "<main class='page has-sidebar'>%s</main>", "<div class=content><div>%s</div></div>"])
def test_boilerplate_goes_and_the_article_stays(boilerplate, article):
    inner = article % f"<h1>A heading</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE} <a href=x>A link</a>.</p>"
    want = f"A heading\n\n{PROSE}\n\nShort.\n\n{PROSE} A link."
    for body in (boilerplate + inner, inner + boilerplate, boilerplate + inner + boilerplate):
        assert main_text(page(body)) == want


def test_white_space_references_and_unclosed_elements():
    inner = f"<article><h1>A &amp;\n  B&nbsp;&#x43;</h1><p><b>One<br>two<p>th<i>r</i>ee &lt;p&gt;<ul><li>a<li>b</ul>{PROSE}</article>"
    assert main_text(page(inner)) == f"A & B C\n\nOne two\n\nthree <p>\n\na\n\nb\n\n{PROSE}"


def test_short_and_odd_pages():
    assert [main_text(x) for x in (None, "", "<p>", "<!-- a", "<script>x")] == [""] * 5
    assert main_text("no markup & more") == "no markup & more"
    assert main_text("<p>a<p>b") == "a\n\nb"
    assert main_text(page("<article><h1>A.</h1></article><footer>long long footer</footer>")) == "A."
    assert main_text("<body><div class=ad><p>only this</p></div>") == "only this"
    assert main_text(page("<article><header><h1>T</h1></header><p>x</p></article>")) == "T\n\nx"


def test_longest_sum_wins_without_an_article():
    inner = f"<div><p>{PROSE}</p><p>{PROSE}</p></div><div><span>one</span></div>"
    assert main_text(page(MENU + inner)).startswith(PROSE + "\n\n" + PROSE)


def test_density_falls_with_links_and_tags():
    assert density(100, 1, 0, 0, 0.1) > density(100, 5, 0, 0, 0.1) > density(100, 5, 50, 3, 0.1) > density(100, 5, 100, 5, 0.1) >= 0
    assert density(0, 3, 0, 0, 0.0) == 0


def test_time_is_linear_in_odd_pages():
    for part in ("<div>", "<p><b>", "<b><div></div>", '<a href="', "<", "<!--", "<a b='c' ", "</p>", "<table><tr><td>", "&#"):
        start = time.perf_counter()
        main_text(part * 20_000 + "x")
        assert time.perf_counter() - start < 10


def test_random_nesting_loses_no_word_of_the_article():
    rng = random.Random(1)
    for _ in range(200):
        words = iter([f"w{i}" for i in range(1000)])

        def inside(depth):
            out = []
            for _ in range(rng.randint(1, 4)):
                tag = rng.choice("p div ul blockquote b i a span h2 pre".split())
                text = " ".join(next(words) for _ in range(rng.randint(1, 6)))
                inner = inside(depth + 1) if depth < 3 and rng.random() < 0.4 else ""
                out.append(f"<{tag}> {text} {inner} " + (f"</{tag}>" if rng.random() < 0.8 else ""))
            return " ".join(out)

        body = inside(0)
        found = main_text(page(MENU + f"<article>{body}</article>")).split()
        assert sorted(found) == sorted(w for w in entities.unescape(__import__("re").sub(r"<[^>]*>", " ", body)).split())


def test_tree_of_a_small_page():
    tree = Page("<ul><li>a<li>b</ul><p>c<div>d</div>")
    assert [(t, tree.tags[p]) for t, p in zip(tree.tags[1:], tree.parents[1:])] == [("ul", "html"), ("li", "ul"), ("li", "ul"), ("p", "html"), ("div", "html")]


def test_on_spark(spark):
    rows = [(1, page(f"<article><p>{PROSE}</p></article>"), 7), (2, None, 7), (2, "", 7), (3, "<p>é" + " long" * 100_000, 7)]
    df = spark.createDataFrame(rows, "page_id long, html string, N_chars int")
    got = sorted(extract(df).select("page_id", "text", "n_chars").collect())
    assert [(r.page_id, len(r.text), r.n_chars) for r in got] == [(1, len(PROSE), len(PROSE)), (2, 0, 0), (2, 0, 0), (3, 500_001, 500_001)]
    assert extract(df.limit(0)).collect() == []


def test_a_wrapper_named_like_chrome_keeps_its_article():
    prose = "<p>" + "The river rose over its banks, and the town waited for the night to end. " * 6 + "</p>"
    for name in ("post category-search", "social-history", "formHistory", "alert-fatigue"):
        for attribute in ("class", "id"):
            page = f"<h1>News</h1><div {attribute}='{name}'>{prose * 3}<div class='share-story'>Share this</div></div><div class='related-news'><p>Other news</p></div>"
            text = main_text(page)
            assert text.count("The river rose") == 18 and "Share this" not in text and "Other news" not in text, name
    page = f"<div class='post'>{prose}</div><div class='comment-list'>{prose.replace('river', 'reader') * 9}</div>"
    assert "river" in main_text(page) and "reader" not in main_text(page)


ARTICLE = "<p>" + "The river rose over its banks, and the town waited for the night to end. " * 6 + "</p>"


@pytest.mark.parametrize(
    "wrapped",
    [
        "<div class='elementor-widget-container'>%s</div>",
        "<div class='elementor-element elementor-widget elementor-widget-text-editor'><div class='elementor-widget-container'>%s</div></div>",
        "<div class='content-sidebar-wrap'><main>%s</main><aside>beside</aside></div>",
        "<div class='widget Blog'>%s</div>",
        "<section id='discussion'>%s</section><section id='more'><p>A smaller section.</p></section>",
        "<form id='aspnetForm'><input type=hidden name=__VIEWSTATE value=x><input name=q>%s</form>",
        *[f"<div class='{name}'>%s</div>" for name in ("banner", "search", "overlay", "content-widget", "popup page", "alert")],
    ],
)
def test_page_builders_wrappers_keep_the_article(wrapped):
    for body in (f"<p>Welcome to the site.</p>{wrapped % (ARTICLE * 3)}", f"{wrapped % (ARTICLE * 3)}<p>See you again.</p>", wrapped % (ARTICLE * 3)):
        text = main_text(page(MENU + body + "<div class='sidebar'><p>Left out.</p></div>"))
        assert text.count("The river rose") == 18 and "Left out" not in text and "beside" not in text, body[:80]


def test_forms_and_comments_do_not_win():
    comments = f"<div class='comments'>{ARTICLE.replace('river', 'reader') * 30}</div>"
    assert main_text(page(f"<div>{ARTICLE}</div>{comments}")).count("rose") == 6
    terms = f"<form>{ARTICLE * 5}<button>Agree</button></form>"
    assert main_text(page(f"<article><p>{PROSE}</p></article>{terms}")) == PROSE


def test_attributes_comments_and_references_as_in_a_browser():
    assert main_text("<p>First.</p><p title=it's>Second isn't lost.</p><p>Third's.</p>") == "First.\n\nSecond isn't lost.\n\nThird's."
    assert main_text("<p title = 'a>b' x=\"c>d\" y==z>One</p>") == "One"
    assert main_text("<p>a<!-->b<!--->c<!-- x --!>d<!-- y -->e</p>") == "abcde"
    assert main_text("<p>&<b>lt;</b> &lt;x&gt; &am<i>p;</i></p>") == "&lt; <x> &amp;"

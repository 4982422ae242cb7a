"""Pages whose article stands in what is elsewhere a menu, a form or a notice, and pages that learning and the scan decide."""

import pytest

from evidara.llm.html_extraction import Weights, believed, best_run, extract, learn, parse, scores_of

ARTICLE = "<h1>A title here</h1><p>" + "body word " * 30 + "</p><p>" + "more prose " * 20 + "</p>"
TEXT = "A title here\n" + ("body word " * 30).strip() + "\n" + ("more prose " * 20).strip()
BOX = "<div class='author'>" + "author bio " * 12 + "</div>"
PRIOR = Weights()


def test_a_form_around_the_page_is_passed_through():
    page = '<html><body><form id="aspnetForm"><nav><a href="/">menu one</a></nav>%s<p><label>Send</label></p></form></body></html>' % ARTICLE
    assert extract(page, PRIOR).startswith(TEXT) and "menu" not in extract(page, PRIOR)


@pytest.mark.parametrize("name", ["section-promo", "alert-box", "tags", "search-item", "related-posts", "page-widget", "newsletter"])
def test_a_named_wrapper_with_the_title_and_most_prose_is_passed_through(name):
    assert extract(f"<div class='{name}'>{ARTICLE}</div>{BOX}", PRIOR).startswith(TEXT)
    # Beside a larger article the same box goes.
    other = "<article><h1>Other</h1><p>" + "real text " * 90 + "</p></article>"
    assert extract(f"{other}<div class='{name}'>{ARTICLE}</div>", PRIOR) == "Other\n" + ("real text " * 90).strip()


def test_comments_and_hidden_parts_are_never_passed_through():
    said = "<div class='comments'><h1>Replies</h1>" + "<p>" + "said so " * 200 + "</p></div>"
    assert extract(ARTICLE + said, PRIOR) == extract(said + ARTICLE, PRIOR) == TEXT
    assert extract(ARTICLE + said.replace("comments'", "x' hidden"), PRIOR) == TEXT
    inside = f"<div class='comments'><article>{ARTICLE}</article></div>" + "<p>" + "the page itself " * 9 + "</p>"
    assert extract(inside, PRIOR) == ("the page itself " * 9).strip()


@pytest.mark.parametrize("depth", [90, 150, 2000])
def test_a_menu_is_a_menu_at_any_depth(depth):
    page = "<nav>" + '<div class="z">' * depth + "menu item " * 9 + "</div>" * depth + "</nav>" + ARTICLE
    assert extract(page, PRIOR) == TEXT


def test_an_item_ends_where_the_next_begins_whatever_is_open_inside():
    page = "<ul><li class=share><p>" + "<b>" * 300 + "share this<li>kept words here and more of them</ul>" + ARTICLE
    assert extract(page, PRIOR) == "kept words here and more of them\n" + TEXT


def test_learning_decides_on_names_that_no_list_has():
    labelled = ["<div class='zorkbar'>" + "zork " * 40 + "</div><article>" + ARTICLE + "</article>"] * 20
    page = "<div class='zorkbar'>" + "buy zork now " * 8 + "</div><div>" + ARTICLE + "</div>"
    assert "zork" in extract(page, PRIOR) and extract(page, learn(labelled)) == TEXT
    # And against the list: a name that labelled pages show inside their articles.
    inside = ["<article><div class='widget'>" + ARTICLE + "</div></article>"] * 20
    page = "<div class='widget'>" + "<p>plain words of the text</p>" * 12 + "</div>" + "<p>" + "other words " * 9 + "</p>"
    assert "plain" not in extract(page, PRIOR) and "plain" in extract(page, learn(inside))


def test_the_scan_decides_on_what_stands_far_from_the_content():
    page = "<div>" + ARTICLE + "</div>" + "<button></button>" * 40 + "<div>stray words</div>"
    tokens, elements = parse(page)
    low, high = best_run(scores_of(tokens, elements, PRIOR))
    assert extract(page, PRIOR) == TEXT and high < len(tokens) and all(x == 0 for x in believed(*parse("<p>a</p>"), PRIOR)[1:])


def test_very_long_pages():
    for page in ("<div class='a'><li><p><b>" * 30_000, "x " * 600_000, "<" * 500_000, "<nav>" + "<i>" * 100_000):
        assert isinstance(extract(page, PRIOR), str)
